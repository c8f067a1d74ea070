"""What the operators share: words, scratch tables, fresh names, row-wise Arrow maps, ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a run of anything but ASCII white space; ``bytes.split()`` cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share, ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster that would be
    a folder of the driver alone, so it is refused.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tablewright-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a lost executor costs no rerun."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole(text: Column) -> Column:
    """The text, empty for null."""
    return F.coalesce(text, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


class Recent(dict):
    """Values made on demand; of those not asked for lately, about ``size`` or more are forgotten."""

    def __init__(self, make: Callable, size: int):
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def map_batches(
    df: DataFrame, schema: StructType, fn: Callable[[dict[str, list]], Iterable[tuple]], rows: int = 512
) -> DataFrame:
    """``fn`` over slices of at most ``rows`` rows, as lists by column; it yields result rows."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = list(fn(batch.slice(at, rows).to_pydict()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow
                )

    return df.mapInArrow(run, schema)


def global_rank(
    df: DataFrame, groups: DataFrame, cell: Sequence[str], order: Sequence[Column], rank: str, chunk: int = 200_000
) -> DataFrame:
    """``df`` with ``rank``: its place from 0 in the order of ``groups.first`` and, in a cell, of salts.

    ``groups`` has one row per cell with its size ``cell_rows`` and the number of rows before it
    ``first``; it must have a bound of its own (say, a grid), for it is broadcast.  A cell of more
    than ``chunk`` rows is dealt over salts by a hash of all its columns, so that none is one
    task's; equal rows may take each other's places, which no one can tell.
    """
    salt = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.ceil(F.col("cell_rows") / chunk))
    dealt = df.join(F.broadcast(groups), list(cell)).withColumn("salt", salt)
    parts = dealt.groupBy(*cell, "salt").agg(F.count(F.lit(1)).alias("salt_rows"), F.first("first").alias("first"))
    upto = W.partitionBy(*cell).orderBy("salt").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = parts.select(
        *cell, "salt", (F.col("first") + F.sum("salt_rows").over(upto) - F.col("salt_rows")).alias("base")
    )
    within = F.row_number().over(W.partitionBy(*cell, "salt").orderBy(*order)) - 1
    return (
        dealt.drop("first", "cell_rows")
        .withColumn("within", within)
        .join(parts, [*cell, "salt"])
        .withColumn(rank, F.col("base") + F.col("within"))
        .drop("salt", "within", "base")
    )
