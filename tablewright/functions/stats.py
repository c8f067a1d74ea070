"""Statistics Spark has no ready aggregate for.

Columns are turned into rows ``(i, v)`` first: one small aggregate over many rows runs
as compiled code, where one aggregate per column would outgrow what the JVM compiles.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Size of the quantile sketches, the number of even steps at which they are read, and the steps of
# room on either side of a rank: some six times the error that 99 of 100 such sketches stay below.
SKETCH = 8192
STEPS = 512
ROOM = 2
# A bracket that may hold more rows than this is sketched again, inside, before it is counted.
BRACKET_ROWS = 5_000_000


def adjusted_skewness(c: Column) -> Column:
    """Bias-adjusted skewness (Spark's own is the population value)."""
    n = F.count(c).cast("double")
    g = F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n > 2, F.coalesce(F.nanvl(g, F.lit(None)), F.lit(0.0)))


def adjusted_kurtosis(c: Column) -> Column:
    """Bias-adjusted excess kurtosis."""
    n = F.count(c).cast("double")
    g = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)
    return F.when(n > 3, F.coalesce(F.nanvl(g, F.lit(None)), F.lit(0.0)))


def long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(i, v)``: column number and value as a double; NULL and NaN left out."""
    each = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v"))
            for i, c in enumerate(columns)
        ]
    )
    return df.select(F.inline(each)).where(F.col("v").isNotNull() & ~F.isnan("v"))


class Target(NamedTuple):
    """Quantile number ``k`` of column number ``i`` and the two ranks it lies between."""

    i: int
    k: int
    low: int
    high: int


class Bracket(NamedTuple):
    """A closed range of values that should hold both ranks, and about how many rows it holds."""

    lo: float
    hi: float
    rows: int


Brackets = dict[Target, Bracket]


def _read(sketch: Column) -> Column:
    """The sketch's values at all steps, the least and the greatest value included."""
    return F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(x / STEPS) for x in range(STEPS + 1)]))


def _bracket(steps: Sequence[float], low: int, high: int, rows: int, room: int) -> Bracket:
    """The steps around two ranks of ``rows`` values."""
    first = max(0, low * STEPS // rows - room)
    last = min(STEPS, -(-(high + 1) * STEPS // rows) + room)
    return Bracket(steps[first], steps[last], min(rows, (last - first) * rows // STEPS + 1))


def number_report(
    df: DataFrame, columns: Sequence[str], qs: Sequence[float] = ()
) -> tuple[dict[str, dict[str, float]], dict[str, list[float | None]]]:
    """Moments and exact quantiles of number columns, on the driver.

    Moments: count, mean, sd, range, adjusted skewness and kurtosis; a column without
    values has none.  Quantiles are linearly interpolated between the two values around
    their rank.  The same two scans serve a column of any size: the first makes the moments and
    a mergeable sketch, from which every rank gets a bracket of values; the second counts,
    for all columns and quantiles at once, the rows below each bracket and the values inside it.
    Where even a bracket would be too large to put in order, it is sketched once more before.
    """
    values = long_numbers(df, columns)
    v, n = F.col("v"), F.col("count")
    told = values.groupBy("i").agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std_dev"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        adjusted_skewness(v).alias("skewness"),
        adjusted_kurtosis(v).alias("kurtosis"),
        *([F.kll_sketch_agg_double(v, SKETCH).alias("sketch")] if qs else []),
    )
    if qs:
        told = told.withColumn("steps", _read(F.col("sketch"))).drop("sketch")
    rows = {r["i"]: r.asDict() for r in told.collect()}
    brackets: Brackets = {}
    for i, r in rows.items():
        steps = r.pop("steps", None)
        for k, q in enumerate(qs):
            low = int((r["count"] - 1) * q)
            t = Target(i, k, low, min(low + 1, r["count"] - 1))
            brackets[t] = _bracket(steps, t.low, t.high, r["count"], ROOM)
    found: dict[Target, tuple[float, float]] = {}
    room = ROOM
    while brackets:
        large = {t: b for t, b in brackets.items() if b.rows > BRACKET_ROWS}
        if large:
            brackets = brackets | _narrow(values, large, room)
            continue
        found |= _rank(values, brackets)
        room = 4 * room + 1  # what a sketch got wrong by more: with a wider bracket, once more
        brackets = {t: _anew(values, t, room) for t in brackets if t not in found}
    out: dict[str, list[float | None]] = {c: [None] * len(qs) for c in columns}
    for t, (low, high) in found.items():
        part = (rows[t.i]["count"] - 1) * qs[t.k] - t.low
        out[columns[t.i]][t.k] = low + (high - low) * part
    return {columns[i]: r for i, r in rows.items()}, out


def exact_quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles; NULL for a column without values."""
    return number_report(df, columns, qs)[1]


def _bounds(brackets: Brackets, side: str) -> Column:
    """Bounds of a row's column, one per quantile; NULL where none is asked for."""
    ks = range(max(t.k for t in brackets) + 1)
    known = {(t.i, t.k): float(getattr(b, side)) for t, b in brackets.items()}
    by_column = {i: F.array(*[F.lit(known.get((i, k))).cast("double") for k in ks]) for i in {t.i for t in brackets}}
    return F.element_at(F.create_map(*[x for i, b in by_column.items() for x in (F.lit(i), b)]), F.col("i"))


def _between(values: DataFrame, brackets: Brackets) -> DataFrame:
    """``(i, k, v, b)``: every value that is not above the bracket ``b`` of a quantile of its column."""
    wanted = values.where(F.col("i").isin(sorted({t.i for t in brackets})))
    both = F.arrays_zip(_bounds(brackets, "lo").alias("lo"), _bounds(brackets, "hi").alias("hi"))
    return wanted.select("i", "v", F.posexplode(both).alias("k", "b")).where(F.col("v") <= F.col("b.hi"))


def _counted(values: DataFrame, brackets: Brackets) -> DataFrame:
    """``(i, k, v, n)``: rows of each value in a bracket, and under NULL those below it; one scan."""
    inside = F.when(F.col("v") >= F.col("b.lo"), F.col("v"))
    return _between(values, brackets).groupBy("i", "k", inside.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def _ranks(spark: SparkSession, brackets: Brackets) -> DataFrame:
    """A row per column and quantile."""
    rows = [(t.i, t.k, t.low, t.high) for t in brackets]
    return F.broadcast(spark.createDataFrame(rows, "i int, k int, low long, high long"))


def _rank(values: DataFrame, brackets: Brackets) -> dict[Target, tuple[float, float]]:
    """The values at both ranks of those targets whose bracket holds them."""
    upto = F.sum("n").over(Window.partitionBy("i", "k").orderBy(F.col("v").asc_nulls_first()))
    counts = _counted(values, brackets).withColumn("upto", upto)

    def at(rank: str) -> Column:
        hit = (F.col("upto") > F.col(rank)) & (F.col("upto") - F.col("n") <= F.col(rank))
        return F.max(F.when(hit, F.col("v"))).alias(f"v_{rank}")

    ranked = counts.join(_ranks(values.sparkSession, brackets), ["i", "k"])
    rows = ranked.groupBy("i", "k").agg(at("low"), at("high")).collect()
    got = {(r["i"], r["k"]): (r["v_low"], r["v_high"]) for r in rows}
    return {t: got[t.i, t.k] for t in brackets if (t.i, t.k) in got and None not in got[t.i, t.k]}


def _narrow(values: DataFrame, brackets: Brackets, room: int) -> Brackets:
    """Tighter brackets from a sketch of the values inside; what missed its ranks starts anew."""
    v, lo = F.col("v"), F.col("b.lo")
    within = F.when(v >= lo, v)
    told = _between(values, brackets).groupBy("i", "k").agg(
        F.count_if(v < lo).alias("below"), F.count(within).alias("n"), F.kll_sketch_agg_double(within, SKETCH).alias("sketch")
    )
    told = told.where("n > 0").select("i", "k", "below", "n", _read(F.col("sketch")).alias("steps"))
    rows = {(r["i"], r["k"]): r for r in told.collect()}
    out = {}
    for t, old in brackets.items():
        r = rows.get((t.i, t.k))
        if r is None or not (r["below"] <= t.low and t.high < r["below"] + r["n"]):
            out[t] = _anew(values, t, 4 * room + 1)
            continue
        new = _bracket(r["steps"], t.low - r["below"], t.high - r["below"], r["n"], room)
        same = (new.lo, new.hi) == (old.lo, old.hi)  # as narrow as its few values allow
        out[t] = new._replace(rows=0) if same else new
    return out


def _anew(values: DataFrame, t: Target, room: int) -> Bracket:
    """A bracket for one target from a new sketch of its column, with more room."""
    column = values.where(F.col("i") == t.i)
    told = column.agg(F.count("v").alias("n"), F.kll_sketch_agg_double("v", SKETCH).alias("sketch"))
    r = told.select("n", _read(F.col("sketch")).alias("steps")).first()
    return _bracket(r["steps"], t.low, t.high, r["n"], room)
