"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def _flat_text(df: DataFrame) -> DataFrame:
    """CSV and XML hold no arrays or maps; they are written as JSON text."""
    nested = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested}) if nested else df


def write_csv(df: DataFrame, folder: str, domain: str, stamp: str) -> str:
    """{folder}/{domain}_cleaned_{stamp}.csv, a folder of part files with headers."""
    path = f"{folder.rstrip('/')}/{domain}_cleaned_{stamp}.csv"
    _flat_text(df).write.mode("error").option("header", True).option("escape", '"').csv(path)
    return path


def write_xml(df: DataFrame, path: str) -> str:
    """Root ``DQCleanedDataset``, one ``record`` per row, nulls as empty elements."""
    names = [c.replace(" ", "_").replace("-", "_") for c in df.columns]
    (_flat_text(df).toDF(*names).write.mode("error").format("xml")
     .option("rootTag", "DQCleanedDataset").option("rowTag", "record").option("nullValue", "")
     .save(path))
    return path


def write_bundle(raw: DataFrame, cleaned: DataFrame, change_log: DataFrame, folder: str) -> dict:
    """The three tables of a repair under one folder, as Parquet."""
    paths = {}
    for name, df in (("raw", raw), ("cleaned", cleaned), ("change_log", change_log)):
        paths[name] = f"{folder.rstrip('/')}/{name}"
        df.write.mode("error").parquet(paths[name])
    return paths


def write_drilldown(issues: DataFrame, dimension: str, folder: str) -> str:
    """The issues of one dimension as CSV."""
    path = f"{folder.rstrip('/')}/dq_drilldown_{dimension}.csv"
    picked = issues.where(F.col("dimension") == dimension)
    _flat_text(picked).write.mode("error").option("header", True).option("escape", '"').csv(path)
    return path
