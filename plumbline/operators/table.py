"""The table under test: a DataFrame, its column kinds and shared derived columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import dates, text

PREFIX = "__pl_"


class Table:
    """Wraps a DataFrame so that all rules share one parse of each column.

    ``number(c)`` and ``date(c)`` register a derived column and return a reference to it; the
    frame used for measuring projects every derived column once, before the aggregate.
    """

    def __init__(self, df: DataFrame, row_key: str | list[str] | None = None):
        self.df = df
        self.row_key = [row_key] if isinstance(row_key, str) else list(row_key or [])
        self.kinds = {f.name: f.dataType for f in df.schema.fields}
        self.columns = [c for c in df.columns if c not in self.row_key]
        self._columns: dict[str, Column] = {}
        self._derived: dict[str, Column] = {}
        self._references: dict[str, Column] = {}

    def has(self, *names: str) -> bool:
        return all(n in self.columns for n in names)

    def is_text(self, name: str) -> bool:
        return isinstance(self.kinds[name], T.StringType)

    def is_number(self, name: str) -> bool:
        return isinstance(self.kinds[name], T.NumericType)

    def is_time(self, name: str) -> bool:
        return isinstance(self.kinds[name], (T.DateType, T.TimestampType, T.TimestampNTZType))

    def is_simple(self, name: str) -> bool:
        return not isinstance(self.kinds[name], (T.ArrayType, T.MapType, T.StructType, T.VariantType))

    @property
    def texts(self) -> list[str]:
        return [c for c in self.columns if self.is_text(c)]

    @property
    def numbers(self) -> list[str]:
        return [c for c in self.columns if self.is_number(c)]

    def col(self, name: str) -> Column:
        """The column itself; NaN counts as null."""
        if name not in self._columns:
            self._columns[name] = F.expr(self.sql(name))
        return self._columns[name]

    def sql(self, name: str) -> str:
        """The column as SQL text; NaN counts as null."""
        floating = isinstance(self.kinds[name], (T.DoubleType, T.FloatType))
        return f"nanvl(`{name}`, NULL)" if floating else f"`{name}`"

    def text(self, name: str) -> Column:
        return self.col(name) if self.is_text(name) else self.col(name).cast("string")

    def _derive(self, tag: str, name: str, make: Callable[[], Column]) -> Column:
        alias = f"{PREFIX}{tag}_{name}"
        if alias not in self._derived:
            self._derived[alias] = make()
            self._references[alias] = F.col(f"`{alias}`")
        return self._references[alias]

    def number(self, name: str) -> Column:
        return self._derive("num", name,
                            lambda: text.number(F.col(f"`{name}`"), self.kinds[name]))

    def number_sql(self, name: str) -> str:
        self.number(name)
        return f"`{PREFIX}num_{name}`"

    def date_sql(self, name: str) -> str:
        self.date(name)
        is_date = isinstance(self.kinds[name], T.DateType)
        return f"`{name}`" if is_date else f"`{PREFIX}date_{name}`"

    def stripped_sql(self, name: str) -> str:
        self.stripped(name)
        return f"`{PREFIX}strip_{name}`"

    def money(self, name: str) -> Column:
        if not self.is_text(name):
            return self.number(name)
        return self._derive("money", name, lambda: text.money(F.col(f"`{name}`")))

    def date(self, name: str) -> Column:
        if isinstance(self.kinds[name], T.DateType):
            return self.col(name)
        return self._derive("date", name,
                            lambda: dates.parse_date(F.col(f"`{name}`"), self.kinds[name]))

    def stripped(self, name: str) -> Column:
        return self._derive("strip", name, lambda: text.strip(self.text(name)))

    def flag(self, tag: str, name: str, make: Callable[[], Column]) -> Column:
        """A named test of a column that several rules share."""
        return self._derive(tag, name, make)

    def frame(self) -> DataFrame:
        """The table plus every derived column asked for so far."""
        if not self._derived:
            return self.df
        return self.df.select("*", *[e.alias(a) for a, e in self._derived.items()])


def classify(df: DataFrame) -> DataFrame:
    """(column_name, kind) with kind numeric, datetime or categorical, by name."""
    table = Table(df)
    rows = [(c, "numeric" if table.is_number(c) else "datetime" if table.is_time(c)
             else "categorical") for c in sorted(table.columns)]
    return df.sparkSession.createDataFrame(rows, "column_name string, kind string")
