"""Row and column selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sample_n(df: DataFrame, n: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Exactly ``n`` rows (all, if fewer), the same ones for any partitioning.

    Rows are ranked by a hash of seed and key; the plan is a distributed top-n.
    """
    text = [F.col(k).cast("string") for k in key]
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), *text))
    return df.orderBy(rank, *key).limit(n)


def missing_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in names if c not in df.columns]


def project(
    df: DataFrame,
    keep: Sequence[str] | None = None,
    drop: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Keep or drop columns; ``strict`` refuses names the table does not have."""
    asked = list(keep or []) + list(drop)
    absent = missing_columns(df, asked)
    if strict and absent:
        raise ValueError(f"columns not in the table: {absent}")
    kept = [c for c in (keep or df.columns) if c in df.columns and c not in set(drop)]
    return df.select(*kept)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL (and NaN) in the columns, as filters a scan can take over."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    out = df
    for c in subset or df.columns:
        col = F.col(f"`{c}`")
        out = out.where(col.isNotNull() & ~F.isnan(col) if c in floats else col.isNotNull())
    return out


def fill_sentinel(
    df: DataFrame, value: str = "__NULL__", columns: Sequence[str] | None = None
) -> DataFrame:
    """NULL becomes ``value``; the columns become strings."""
    chosen = set(columns or df.columns)
    return df.select(
        *[
            F.coalesce(F.col(c).cast("string"), F.lit(value)).alias(c)
            if c in chosen
            else F.col(c)
            for c in df.columns
        ]
    )
