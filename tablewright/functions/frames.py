"""Helpers on whole frames: size-checked broadcast, joins, shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Where it is unset a local session, whose tasks run in the driver, gets a temporary one; on a
    cluster that would be the driver's alone, so it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="tablewright-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept_table(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder: what it was made from may be released."""
    known = shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(known)
    return df.checkpoint()


def is_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True if the rows of ``df``, as text, stay below ``max_bytes``.

    One aggregate over ``df``; keep ``df`` cheap or persisted.
    """
    widths = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in df.columns]
    row = reduce(lambda a, b: a + b, widths) + 8 * len(widths)
    return (df.agg(F.sum(row).alias("b")).first()["b"] or 0) <= max_bytes


def lookup(
    facts: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    check_size: bool = True,
) -> DataFrame:
    """Left join of ``facts`` to a table that is unique on ``keys``.

    A small table is broadcast.  Beyond the size bound the join shuffles: rows with a
    NULL key cannot match, so they are spread by partition number instead of meeting in
    one task, and adaptive execution splits the partitions of hot keys.
    """
    if check_size:
        table = table.persist()
        if is_small(table):
            return facts.join(F.broadcast(table), list(keys), "left")
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread = F.when(no_key, F.spark_partition_id()).otherwise(-1)
    # One struct holds keys and spread: a constant column of its own would be taken out of
    # the join keys, and with it the spreading.
    fields = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    left = facts.withColumn("__key", F.struct(*fields, spread.alias("spread")))
    right = table.select(
        F.struct(*fields, F.lit(-1).alias("spread")).alias("__key"),
        *[F.col(f"`{c}`") for c in table.columns if c not in keys],
    )
    return left.join(right, "__key", "left").drop("__key")


def map_values(
    df: DataFrame, column: str, make: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Rewrite ``column`` by a function of its distinct values.

    ``make`` gets the frame ``(__old)`` of distinct values and returns
    ``(__old, __new)``.  Only changed values are joined back.
    """
    whole = F.col(quoted(column))
    # Persisted, or the test below would be pushed under the distinct: ``make`` for every row.
    values = df.select(whole.alias("__old")).where("__old is not null").distinct().persist()
    changed = make(values).select("__old", "__new").where("not (__new <=> __old)")
    changed = changed.withColumn("__hit", F.lit(True))
    joined = lookup(df.withColumn("__old", whole), changed, ["__old"])
    values.unpersist()
    return joined.withColumn(
        column, F.when(F.col("__hit"), F.col("__new")).otherwise(whole)
    ).select(*map(quoted, df.columns))


def quoted(name: str) -> str:
    """A column name as it stands, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def unpivot_strings(df: DataFrame, columns: Sequence[str], keep: Sequence[Column] = ()) -> DataFrame:
    """``(column, value, *keep)`` with every value as a string; NULLs kept."""
    parts = [
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in columns
    ]
    each = df.select(F.explode(F.array(*parts)).alias("__p"), *keep)
    return each.select("__p.column", "__p.value", *each.columns[1:])


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, NULL for an empty whole."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def first_by_key(
    df: DataFrame, key: Sequence[str], order_by: Sequence[Column], columns: Sequence[str]
) -> DataFrame:
    """One row per key: the first in ``order_by``; NULL is a key of its own.

    A minimum over (order, row) combines before the shuffle, so a hot key costs no
    more than a rare one.  ``order_by`` should be total for a repeatable choice.
    """
    rest = [c for c in columns if c not in key]
    order = F.struct(*order_by)
    row = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(1).alias("x"))
    picked = df.groupBy(*key).agg(F.min_by(row, order).alias("__row"))
    return picked.select(
        *[F.col(c) if c in key else F.col(f"__row.`{c}`").alias(c) for c in columns]
    )
