"""File scans and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GEOCODE_SCHEMA = (
    "ID string, input_address string, match_status string, match_type string, "
    "matched_address string, location string, tigerline_id string, side string, "
    "statefips string, countyfips string, tractcode string, blockcode string"
)

# Cells the usual data-frame readers take for missing.
CSV_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _csv(spark: SparkSession, multiline: bool, encoding: str | None) -> DataFrameReader:
    reader = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
    )
    return reader.option("encoding", encoding) if encoding else reader


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    overrides: Mapping[str, str] | None = None,
    encodings: Sequence[str] | None = None,
    multiline: bool = False,
    null_tokens: Sequence[str] = CSV_NULLS,
) -> DataFrame:
    """CSV with a header row.

    With ``schema`` nothing is inferred, which is the way to read large inputs.
    ``overrides`` gives types for single columns, e.g. text for identifiers with
    leading zeros.  Cells equal to one of ``null_tokens`` become NULL.  ``multiline`` allows
    line breaks inside quotes, at the price that a file is read by one task: turn it on only
    where cells hold line breaks, and write such inputs as many files.
    """
    encoding = pick_encoding(spark, path, encodings) if encodings else None
    if schema is None:
        names = _csv(spark, multiline, encoding).csv(path).columns
        inferred = _csv(spark, multiline, encoding).option("inferSchema", True).csv(path).schema
        kinds = dict(overrides or {})
        schema = T.StructType(
            [
                T.StructField(n, T.DataType.fromDDL(kinds[n]) if n in kinds else f.dataType)
                for n, f in zip(names, inferred.fields)
            ]
        )
    elif overrides:
        given = schema if isinstance(schema, T.StructType) else T.DataType.fromDDL(schema)
        schema = T.StructType(
            [
                T.StructField(f.name, T.DataType.fromDDL(overrides[f.name]))
                if f.name in overrides
                else f
                for f in given.fields
            ]
        )
    return _nulls(_csv(spark, multiline, encoding).schema(schema).csv(path), null_tokens)


def _nulls(df: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Missing-value tokens and NaN to NULL, column by column."""

    def fix(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType) and tokens:
            return F.when(~c.isin(list(tokens)), c).alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return F.when(~F.isnan(c), c).alias(f.name)
        return c

    return df.select(*[fix(f) for f in df.schema.fields])


def pick_encoding(spark: SparkSession, path: str, encodings: Sequence[str]) -> str:
    """First encoding every byte of the input is valid in.

    Single-byte encodings accept any byte, so only UTF-8 needs a look; that scan runs
    in parallel and stops at the first bad line.
    """
    for name in encodings:
        if name.lower().replace("-", "") != "utf8":
            return {"latin1": "ISO-8859-1"}.get(name.lower(), name)
        lines = spark.read.text(path)
        if not lines.where(~F.is_valid_utf8("value")).limit(1).count():
            return "UTF-8"
    raise ValueError(f"none of {list(encodings)} can read {path}")


def write_csv(
    df: DataFrame, path: str, mode: str = "errorifexists", encoding: str = "UTF-8"
) -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').option("encoding", encoding).csv(path)


def read_geocode_results(spark: SparkSession, path: str) -> DataFrame:
    """Header-less, quoted answers of a batch geocoder."""
    return spark.read.schema(GEOCODE_SCHEMA).option("quote", '"').option("escape", '"').csv(path)


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Nested rows as JSON lines."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)
