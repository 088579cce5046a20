"""Reading tables: files, JSON pages, databases, catalog tables and DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import fixed_values as fv


def format_of(path: str) -> str:
    """csv, parquet or json from the suffix, query string and fragment ignored; csv otherwise."""
    bare = path.split("?")[0].split("#")[0].rstrip("/")
    name = bare.rsplit("/", 1)[-1]
    suffix = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    return fv.FORMAT_OF_SUFFIX.get(suffix, "csv")


def is_remote(path: str) -> bool:
    return urlparse(path).scheme in fv.REMOTE_SCHEMES


def null_tokens(df: DataFrame, tokens: list[str] = fv.NULL_TOKENS) -> DataFrame:
    """Turn the usual spellings of a missing value into null, in text columns."""
    def clean(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, T.StringType):
            return c
        return F.when(~c.isin(tokens), c).alias(field.name)
    return df.select(*[clean(f) for f in df.schema.fields])


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns that hold only integers or only numbers; one scan over all of them.

    Runs after null tokens are gone, so one ``N/A`` no longer turns a number column into text.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    tests = []
    for i, c in enumerate(texts):
        v = F.col(f"`{c}`")
        tests += [F.count(v).alias(f"n{i}"),
                  F.count_if(v.rlike(r"^\s*[+-]?\d{1,18}\s*$")).alias(f"i{i}"),
                  F.count_if(v.rlike(fv.NUMBER_TEXT)).alias(f"d{i}")]
    row = df.agg(*tests).first()
    casts = {}
    for i, c in enumerate(texts):
        n = row[f"n{i}"]
        if n and row[f"i{i}"] == n:
            casts[c] = F.trim(F.col(f"`{c}`")).cast("bigint")
        elif n and row[f"d{i}"] == n:
            casts[c] = F.trim(F.col(f"`{c}`")).cast("double")
    return df.withColumns(casts) if casts else df


def has_broken_lines(spark: SparkSession, path: str) -> bool:
    """Whether a quoted value may hold a line break: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).limit(1).isEmpty()


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", schema=None,
             clean_nulls: bool = True, multi_line: bool | None = None) -> DataFrame:
    """CSV with a header. Without a schema the types are found after cleaning null tokens.

    Quotes inside quoted values are doubled, and quoted values may hold newlines. Files with such values
    are read by one task each, all others are split; which it is, a scan for lines with an odd
    number of quotes tells, unless ``multi_line`` does.
    """
    if multi_line is None:
        multi_line = encoding.lower().replace("-", "") not in ("utf8", "usascii", "ascii", "latin1", "iso88591") \
            or has_broken_lines(spark, path)
    reader = (spark.read.option("header", True).option("encoding", encoding)
              .option("quote", '"').option("escape", '"').option("multiLine", multi_line))
    if schema is not None:
        return reader.schema(schema).csv(path)
    texts = reader.csv(path)
    return infer_types(null_tokens(texts)) if clean_nulls else infer_types(texts)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json_layouts(spark: SparkSession, path: str) -> dict[bool, list[str]]:
    """The files of a path by layout: True for files whose first line is a whole JSON object.

    Only the first part of each file is read; a list of files reaches the driver, no records.
    """
    lines = spark.read.text(path).where((F.col("_metadata.file_block_start") == 0) & (F.length(F.trim("value")) > 0))
    first = (lines.select(F.col("_metadata.file_path").alias("file"), F.ltrim("value").alias("line"),
                          F.monotonically_increasing_id().alias("at"))
             .groupBy("file").agg(F.min_by("line", "at").alias("line")))
    found = first.select("file", (F.col("line").startswith("{") & F.try_parse_json("line").isNotNull()).alias("whole")).collect()
    out: dict[bool, list[str]] = {}
    for r in found:
        out.setdefault(bool(r["whole"]), []).append(r["file"])
    return out


def read_json(spark: SparkSession, path: str, schema=None, multi_line: bool | None = None) -> DataFrame:
    """JSON arrays and objects over several lines, or JSON lines, whatever the suffix.

    The layout is found per file. Lines can be split between tasks, the other layouts not.
    """
    def read(paths, several: bool) -> DataFrame:
        reader = spark.read.option("multiLine", several)
        return (reader.schema(schema) if schema is not None else reader).json(paths)

    if multi_line is not None or path.split("?")[0].lower().endswith(".jsonl"):
        return read(path, bool(multi_line))
    layouts = json_layouts(spark, path)
    if len(layouts) < 2:
        return read(path, not layouts.get(True))
    return read(layouts[True], False).unionByName(read(layouts[False], True), allowMissingColumns=True)


def read_file(spark: SparkSession, path: str, file_type: str = "auto", encoding: str = "utf-8",
              schema=None) -> DataFrame:
    """Read by the given format, or by the suffix. Remote paths go to Spark's file systems as they
    are. A failed read raises; no other data takes its place."""
    kind = format_of(path) if file_type.lower() == "auto" else fv.FORMAT_OF_SUFFIX.get(
        file_type.lower(), "csv")
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind == "json":
        return read_json(spark, path, schema)
    return read_csv(spark, path, encoding, schema)


def from_frame(df: DataFrame) -> DataFrame:
    """A DataFrame as a source; NaN becomes null once, here."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c in floats}) \
        if floats else df


# --- databases ----------------------------------------------------------------------------------

JDBC_URLS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={database}",
    "sqlite": "jdbc:sqlite:{database}",
    "snowflake": "jdbc:snowflake://{host}/?db={database}",
}
PORTS = {"postgresql": 5432, "mysql": 3306, "sqlserver": 1433}
TABLE_LISTS = {
    "postgresql": "SELECT table_name FROM information_schema.tables WHERE table_schema = 'public'",
    "mysql": "SELECT table_name FROM information_schema.tables WHERE table_schema = DATABASE()",
    "sqlserver": "SELECT table_name FROM information_schema.tables WHERE table_type = 'BASE TABLE'",
    "sqlite": "SELECT name AS table_name FROM sqlite_master WHERE type = 'table'",
    "snowflake": "SELECT table_name FROM information_schema.tables",
}


def jdbc_options(db_type: str, host: str = "", database: str = "", user: str = "",
                 password: str = "", port: int | None = None) -> dict[str, str]:
    kind = db_type.lower().replace(" ", "")
    if kind not in JDBC_URLS:
        raise ValueError(f"unknown database type: {db_type}")
    url = JDBC_URLS[kind].format(host=host, port=port or PORTS.get(kind, ""), database=database)
    out = {"url": url}
    if user:
        out |= {"user": user, "password": password}
    return out


def table_options(options: dict, table: str, partition_column: str | None = None,
                  bounds: tuple | None = None, partitions: int = 32) -> dict[str, str]:
    """Options of a whole-table read, split into ranges of a column so that executors share it."""
    out = {**options, "dbtable": table}
    if partition_column and bounds:
        out |= {"partitionColumn": partition_column, "lowerBound": str(bounds[0]),
                "upperBound": str(bounds[1]), "numPartitions": str(partitions)}
    return out


def read_table(spark: SparkSession, options: dict, table: str, **split) -> DataFrame:
    return spark.read.format("jdbc").options(**table_options(options, table, **split)).load()


def read_query(spark: SparkSession, options: dict, sql: str) -> DataFrame:
    """A query that the database runs; filters and columns added in Spark are pushed down too."""
    return spark.read.format("jdbc").options(**options).option("query", sql).load()


def list_tables(spark: SparkSession, options: dict | None = None,
                db_type: str | None = None) -> list[str]:
    """Tables of a database, or of the Spark catalog when no database is given."""
    if options is None:
        return sorted(t.name for t in spark.catalog.listTables())
    rows = read_query(spark, options, TABLE_LISTS[db_type.lower().replace(" ", "")]).collect()
    return sorted(r[0] for r in rows)


def first_table(names: list[str]) -> str:
    if not names:
        raise ValueError("the source holds no tables")
    return names[0]


# --- JSON pages -----------------------------------------------------------------------------------

def records_at(df: DataFrame, path: str, carry: tuple = ()) -> DataFrame:
    """Rows of the record array (or object) at a dot path, with the columns of ``carry``.

    As in a tolerant look-up, a step that does not exist is skipped, and the walk ends at an array.
    """
    kind, c = T.StructType([f for f in df.schema.fields if f.name not in carry]), None
    for step in [s for s in path.split(".") if s]:
        if not isinstance(kind, T.StructType):
            break
        if step in kind.names:
            c = F.col(f"`{step}`") if c is None else c.getField(step)
            kind = kind[step].dataType
    if c is None:
        return df
    if isinstance(kind, T.ArrayType):
        rows = df.select(*carry, F.explode(c).alias("r"))
        return rows.select(*carry, "r.*") if isinstance(kind.elementType, T.StructType) else rows
    return df.select(*carry, c.alias("r")).select(*carry, "r.*") if isinstance(kind, T.StructType) else df.select(*carry, c)


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects become columns ``a_b``; arrays stay as they are."""
    def walk(kind: T.StructType, path: tuple) -> list[Column]:
        out = []
        for f in kind.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias("_".join(here)))
        return out
    return df.select(*walk(df.schema, ()))


def clean_name(name: str) -> str:
    return name.replace(".", "_").replace(" ", "_").replace("-", "_").lower()


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


PAGE, AT = "__page", "__at"
PLACE_BITS = 33         # monotonically_increasing_id: task number above, place in the task below


def in_order(page: str) -> list:
    """Sort key of a page's path: numbers inside count as numbers."""
    return [(1, int(x), "") if x.isdigit() else (0, 0, x) for x in re.split(r"(\d+)", page)]


def first_rows(rows: DataFrame, max_rows: int, order: Callable = in_order) -> DataFrame:
    """The rows of the first pages, in the order of the pages, the last one cut after ``max_rows`` rows.

    ``rows`` has PAGE and AT (a monotonically increasing id). One number per page and task reaches the
    driver; the rows kept are told by page and place, so nothing is sorted or gathered.
    """
    parts = sorted(rows.groupBy(PAGE, F.shiftright(AT, PLACE_BITS).alias("part"))
                   .agg(F.count(F.lit(1)).alias("n"), F.min(AT).alias("first")).collect(),
                   key=lambda r: (order(r[PAGE]), r["part"]))
    left, ends = max_rows, []
    for r in parts:
        if left > 0:
            ends.append((r[PAGE], r["part"], r["first"] + min(left, r["n"])))
            left -= r["n"]
    kept = rows.sparkSession.createDataFrame(ends, f"{PAGE} string, part bigint, before bigint")
    return (rows.withColumn("part", F.shiftright(AT, PLACE_BITS)).join(F.broadcast(kept), [PAGE, "part"])
            .where(F.col(AT) < F.col("before")).drop("part", "before"))


def combine_pages(pages: list[DataFrame], max_rows: int | None = None) -> DataFrame:
    """Pages one after the other, columns matched by name; an empty result is an error.

    With ``max_rows``, pages are taken in the given order and the last one is cut, its rows in the order
    in which Spark reads them.
    """
    if not pages:
        raise ValueError("no pages")
    if max_rows is not None:
        pages = [p.withColumn(PAGE, F.lit(str(i))) for i, p in enumerate(pages)]
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page, allowMissingColumns=True)
    if max_rows is not None:
        out = first_rows(out.withColumn(AT, F.monotonically_increasing_id()), max_rows).drop(PAGE, AT)
    if out.isEmpty():
        raise ValueError("the pages hold no records")
    return out


def read_pages(spark: SparkSession, path: str, json_path: str = "", max_rows: int | None = None,
               schema=None) -> DataFrame:
    """Landed JSON pages (a folder of responses) as one table: navigate, flatten, clean names.

    With ``max_rows``, files are taken in the order of their names (page2 before page10) and the last
    one is cut after its first records.
    """
    pages = read_json(spark, path, schema, multi_line=True).withColumn(PAGE, F.col("_metadata.file_path"))
    rows = clean_names(flatten(records_at(pages, json_path, (PAGE,))))
    if max_rows is not None:
        rows = first_rows(rows.withColumn(AT, F.monotonically_increasing_id()), max_rows).drop(AT)
    return combine_pages([rows.drop(PAGE)])


# --- descriptors ------------------------------------------------------------------------------------

def describe(spark: SparkSession, source_type: str, location: str, label: str | None = None,
             **extra: str) -> DataFrame:
    """One row about a source. Credentials inside the location are masked, none are kept."""
    parts = urlparse(location)
    if parts.password:
        location = location.replace(f":{parts.password}@", ":****@")
    name = label or location.split("?")[0].rstrip("/").rsplit("/", 1)[-1]
    secret = {"password", "token", "auth_token", "secret"}
    notes = {k: "****" if k.lower() in secret else str(v) for k, v in extra.items()}
    return spark.createDataFrame(
        [(source_type, location, name, format_of(location).upper(), is_remote(location), notes)],
        "source_type string, location string, label string, file_type string, remote boolean, "
        "notes map<string,string>")
