"""Dates held as text in several shapes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .text import strip


def parse_date(c: Column, kind: T.DataType = T.StringType(), long_form: bool = False) -> Column:
    """Date of a text in one of Y-m-d, m/d/Y, d-m-Y, Y/m/d (and ``Month d, Y`` on request).

    The shape picks the layout, the text is turned into ISO order and cast. No formatter is
    tried in vain, so bad text costs one regular expression and never an exception.
    """
    if isinstance(kind, T.DateType):
        return c
    if not isinstance(kind, T.StringType):
        return F.to_date(c)
    text = strip(c)
    iso = (F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text)
           .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"),
                 F.regexp_replace(text, r"^(\d+)/(\d+)/(\d+)$", "$3-$1-$2"))
           .when(text.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$"),
                 F.regexp_replace(text, r"^(\d+)-(\d+)-(\d+)$", "$3-$2-$1"))
           .when(text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.translate(text, "/", "-")))
    parsed = iso.try_cast("date")
    if long_form:
        named = F.when(text.rlike(r"^[A-Za-z]+ \d{1,2}, \d{4}$"), text)
        parsed = F.coalesce(parsed, F.to_date(F.try_to_timestamp(named, F.lit("MMMM d, yyyy"))))
    return parsed


def iso_text(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")
