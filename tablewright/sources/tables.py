"""Catalog tables: save with load metadata, query with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

METADATA = "load_metadata"


def metadata_table(name: str) -> str:
    """The metadata table beside a table: in the same database."""
    database, dot, _ = name.rpartition(".")
    return f"{database}{dot}{METADATA}"


MODES = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}


def save_table(
    df: DataFrame, name: str, mode: str = "replace", add_metadata: bool = True
) -> None:
    """Write a table; its row count is observed during the write, not recounted.

    One metadata row per load is appended: name, time, rows, columns.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}")
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows")) if add_metadata else df
    out.write.mode(MODES[mode]).format("parquet").saveAsTable(name)
    if add_metadata:
        row = [(name, seen.get["rows"], len(df.columns))]
        meta = df.sparkSession.createDataFrame(row, "table_name string, rows long, columns int")
        meta = meta.select("table_name", F.current_timestamp().alias("created_at"), "rows", "columns")
        meta.coalesce(1).write.mode("append").format("parquet").saveAsTable(metadata_table(name))


def run_sql(spark: SparkSession, query: str) -> DataFrame:
    return spark.sql(query)
