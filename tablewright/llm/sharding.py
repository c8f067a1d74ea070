"""Shards along a Hilbert curve through several metadata columns.

Each column is quantised into 2^bits bins at its quantiles (all rows, mergeable sketch), so
a bin holds about as many rows as the next; strings are ordered by their first seven bytes.
A row's cell lies at one place of the Hilbert curve through the grid of bins.  Rows are
ranked along the curve and cut into runs: a shard covers a compact box of every column, and a
reader that filters on any of them skips most shards.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import col, global_rank, table, whole

#: Cells of the grid, whose table is broadcast: at most about 2 MB.
MAX_CELL_BITS = 16


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows x dimensions, below 2^bits).

    Skilling's transposition: undo the rotations of each level, Gray-decode, interleave bits.
    """
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(dims):
            turned = (x[d] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, dims):
        x[d] = x[d] ^ x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip = np.where(x[-1] & (1 << level), flip ^ ((1 << level) - 1), flip)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | (((x[d] ^ flip) >> level) & 1)
    return out


def ordinal(df: DataFrame, name: str) -> Column:
    """A number in the order of the column; null stays null."""
    kind, c = df.schema[name].dataType, col(name)
    if isinstance(kind, T.StringType):
        seven = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 7)), 14, "0")
        return F.conv(seven, 16, 10).cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_timestamp(c.cast("timestamp")).cast("double")
    return c.cast("double")


def hilbert_shards(
    df: DataFrame, dimensions: Sequence[str], shards: int, bits: int = 4, order: Sequence[str] = (), accuracy: int = 2000
) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 in a shard); counts differ by one at most.

    A shard is a run of the curve; rows of one cell follow each other by ``order``, up to the
    salts that split a cell of very many rows.  Nulls, in any column, are in the first bin.
    Equal rows may stand in either's place.  Columns of ``df`` with clashing names are kept;
    ``shard`` and ``slot`` themselves are replaced.
    """
    dims, cells = list(dimensions), bits * len(dimensions)
    if not dims or cells > MAX_CELL_BITS:
        raise ValueError(f"dimensions times bits must lie between 1 and {MAX_CELL_BITS}")
    df = df.drop("shard", "slot")
    names = {f"c{i}": c for i, c in enumerate(df.columns)}  # names that clash with none used here
    short = {c: n for n, c in names.items()}
    df = df.select(*[col(c).alias(n) for n, c in names.items()])
    dims = [short[d] for d in dims]
    by = [F.col(short[c]) for c in order] or [F.xxhash64(*df.columns)]
    bins, index, rank = [f"bin{i}" for i in range(len(dims))], "curve_index", "curve_rank"
    share = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = df.agg(
        *[F.percentile_approx(ordinal(df, d), share, accuracy).alias(b) for d, b in zip(dims, bins)]
    ).first()

    def bin_of(d: str, at: list[float] | None) -> Column:
        x = ordinal(df, d)
        below = [F.when(x > c, 1).otherwise(0) for c in (at or [])]
        return reduce(lambda a, b: a + b, below, F.lit(0))

    binned = df.withColumns({b: bin_of(d, cuts[b]) for d, b in zip(dims, bins)})

    @F.pandas_udf("long")
    def curve(*x: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([s.to_numpy() for s in x], axis=1), bits))

    counted = binned.groupBy(*bins).agg(F.count(F.lit(1)).alias("cell_rows"))
    along = W.orderBy(index)  # over the cells of the grid, 2^16 at most
    groups = counted.withColumn(index, curve(*bins)).select(
        *bins, "cell_rows", (F.sum("cell_rows").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("cell_rows")).alias("first")
    )
    n_rows = df.count()
    ranked = global_rank(binned, groups, bins, by, rank)
    # The first n_rows % shards shards get one row more.
    small, more = divmod(n_rows, shards)
    edge = more * (small + 1)
    shard = F.when(F.col(rank) < edge, F.floor(F.col(rank) / (small + 1))).otherwise(
        more + F.floor((F.col(rank) - edge) / max(small, 1))
    )
    first = F.when(F.col(rank) < edge, shard * (small + 1)).otherwise(edge + (shard - more) * max(small, 1))
    return ranked.select(
        *[F.col(n).alias(c) for n, c in names.items()], shard.cast("int").alias("shard"), (F.col(rank) - first).cast("long").alias("slot")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = whole(F.col("text"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = hilbert_shards(docs, ["lang", "source", "n_chars"], 16, order=["doc_id", "text_crc32"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
