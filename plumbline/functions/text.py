"""Text expressions. All but ``indel_ratio`` stay inside whole-stage codegen."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .fixed_values import NUMBER_TEXT, WHITESPACE

NON_ASCII = r"[^\x00-\x7F]"
# A lower-case letter that starts a word, or an upper-case letter inside one.
BREAKS_TITLE_CASE = r"(?<!\p{L})\p{Ll}|(?<=\p{L})[\p{Lu}\p{Lt}]"


def strip(c: Column) -> Column:
    """Drop all leading and trailing white space, Unicode spaces included.

    Text that starts and ends with a visible ASCII character, nearly all of it, is left alone
    without a search: its bytes and those of its last character are compared with the ends of that range.
    """
    last = F.substring(c, -1, 1)
    plain = (c >= F.lit("!")) & (c < F.lit("\x7f")) & (last >= F.lit("!")) & (last < F.lit("\x7f"))
    return F.when(plain, c).otherwise(F.btrim(c, F.lit(WHITESPACE)))


def non_ascii_sql(c: str) -> str:
    """SQL test for what ``NON_ASCII`` finds, without a search: a character of several bytes, or bytes that are none."""
    return f"octet_length({c}) <> length({c}) OR NOT is_valid_utf8({c})"


def not_title_case(c: Column) -> Column:
    return c.rlike(BREAKS_TITLE_CASE)


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                 F.lower(F.substr(r, F.lit(2)))))
    return F.array_join(cased, "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\d]", "")


def number(c: Column, kind: T.DataType) -> Column:
    """Numeric view of a column as double; unreadable text and NaN become null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.nanvl(c, F.lit(None)).cast("double")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    text = c.cast("string")
    return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))


def money(c: Column) -> Column:
    """Numeric view of text with currency marks: ``$`` and ``,`` are dropped first."""
    return number(F.regexp_replace(c, "[,$]", ""), T.StringType())


def contains_any(name: str, words: list[str]) -> bool:
    lowered = name.lower()
    return any(word in lowered for word in words)


def indel_ratio(left: Column | str, right: Column | str) -> Column:
    """100 * 2 * LCS / (len a + len b), in Arrow batches.

    The helper is nested so that it travels with the job and executors need no copy of this package.
    """
    def common_subsequence(a: str, b: str) -> int:
        # One big-integer step per character of b; bit i stands for character i of a.
        places: dict[str, int] = {}
        for i, ch in enumerate(a):
            places[ch] = places.get(ch, 0) | (1 << i)
        full = (1 << len(a)) - 1
        row = full
        for ch in b:
            hit = row & places.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(a) - row.bit_count()

    def ratio(lefts: pd.Series, rights: pd.Series) -> pd.Series:
        known: dict[tuple, float | None] = {}     # the same values meet again within a batch
        for a, b in set(zip(lefts, rights)):
            if a is None or b is None:
                known[a, b] = None
            elif not a and not b:
                known[a, b] = 100.0
            else:
                known[a, b] = 200.0 * common_subsequence(a, b) / (len(a) + len(b))
        return pd.Series([known[pair] for pair in zip(lefts, rights)], dtype="float64")

    return F.pandas_udf(ratio, T.DoubleType())(left, right)
