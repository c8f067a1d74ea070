"""Inclusion dependencies between the columns of one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns per bit mask.
MASK_BITS = 62
# Letters of a part that stands for a longer value.
GRAM = 16


def _typed_value(df: DataFrame, name: str) -> Column:
    """Type class and value as one string, so that 1 and '1' differ but 1 and 1.0 do not."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 2.0**53)
        number = F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))
        return F.concat(F.lit("n:"), number)
    if isinstance(kind, T.DecimalType):
        digits = c.cast("string")
        return F.concat(F.lit("n:"), F.when(digits.contains("."), F.regexp_replace(digits, r"\.?0+$", "")).otherwise(digits))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.concat(F.lit("n:"), (c.cast("long") if isinstance(kind, T.BooleanType) else c).cast("string"))
    if isinstance(kind, T.StringType):
        return F.concat(F.lit("s:"), c)
    return F.concat(F.lit(f"{kind.simpleString()}:"), c.cast("string"))


def _plain_value(df: DataFrame, name: str) -> Column:
    return F.lower(F.trim(F.col(f"`{name}`").cast("string")))


def _memberships(df: DataFrame, columns: Sequence[str], normalize: bool) -> DataFrame:
    """``(members, n)``: how many values occur in exactly this set of columns.

    A value carries one bit per column; or-ing the bits combines before the shuffle, so
    a value met in every row costs one row per task.
    """
    value = _plain_value if normalize else _typed_value
    each = F.array(
        *[F.struct(F.lit(i).alias("i"), value(df, c).alias("v")) for i, c in enumerate(columns)]
    )
    long = df.select(F.explode(each).alias("e")).select("e.i", "e.v").where("v is not null")
    masks = range((len(columns) + MASK_BITS - 1) // MASK_BITS)

    def bit(m: int) -> Column:
        mine = F.floor(F.col("i") / MASK_BITS) == m
        power = F.expr(f"shiftleft(1L, cast(i % {MASK_BITS} as int))")
        return F.bit_or(F.when(mine, power).otherwise(F.lit(0).cast("long"))).alias(f"m{m}")

    patterns = long.groupBy("v").agg(*[bit(m) for m in masks]).groupBy(*[f"m{m}" for m in masks])
    counted = patterns.agg(F.count(F.lit(1)).alias("n"))
    members = F.filter(
        F.array(*[F.lit(i) for i in range(len(columns))]),
        lambda i: sum_bits(i, masks) == 1,
    )
    return counted.select(members.alias("members"), "n")


def sum_bits(i: Column, masks: range) -> Column:
    """Bit ``i`` of the concatenated masks."""
    picked = F.lit(0).cast("long")
    for m in masks:
        mine = F.floor(i / MASK_BITS) == m
        picked = F.when(mine, F.col(f"m{m}")).otherwise(picked)
    return F.call_function("getbit", picked, (i % MASK_BITS).cast("int"))


def discover_inds(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    min_conf: float = 0.95,
    normalize: bool = False,
) -> DataFrame:
    """``(lhs, rhs, n_common, n_lhs, confidence, is_exact)`` for all column pairs.

    Pairs are formed on the few membership patterns, not on values.
    """
    cols = list(columns or df.columns)
    patterns = _memberships(df, cols, normalize)
    pairs = (
        patterns.select(F.explode("members").alias("a"), "members", "n")
        .select("a", F.explode("members").alias("b"), "n")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n_common"))
    )
    sizes = pairs.where("a = b").select("a", F.col("n_common").alias("n_lhs"))
    name = F.array(*[F.lit(c) for c in cols])
    conf = F.col("n_common") / F.col("n_lhs")
    return (
        pairs.where("a != b")
        .join(F.broadcast(sizes), "a")  # one row per column
        .where(conf >= min_conf)
        .select(
            F.get(name, F.col("a")).alias("lhs"),
            F.get(name, F.col("b")).alias("rhs"),
            "n_common",
            "n_lhs",
            conf.alias("confidence"),
            (F.col("n_common") == F.col("n_lhs")).alias("is_exact"),
        )
    )


def _with_grams(values: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Distinct grams of the given sizes per value."""

    def of(k: int) -> Column:
        at = F.sequence(F.lit(1), F.length("v") - (k - 1))
        grams = F.transform(at, lambda i: F.substring("v", i, k))
        return F.when(F.length("v") >= k, grams).otherwise(F.array().cast("array<string>"))

    none = F.array().cast("array<string>")
    grams = F.array_distinct(F.flatten(F.array(none, *[of(k) for k in sizes])))
    return values.withColumn("g", F.explode(grams))


def discover_substring_inds(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    min_conf: float = 1.0,
    normalize: bool = True,
) -> DataFrame:
    """As ``discover_inds``; a value counts if it is part of any value of the other column.

    Values equal to one of the other column are settled by an equi-join.  Others of up to ``GRAM``
    letters meet the distinct parts of just their lengths; a longer one meets the texts that hold
    its rarest part of ``GRAM`` letters, and a semi join stops at the first hit.  Both are linear
    in the length of all texts, and no short, hot gram is joined on.
    """
    cols = list(columns or df.columns)
    plain = _plain_value if normalize else (lambda d, c: F.col(f"`{c}`").cast("string"))
    each = F.array(
        *[F.struct(F.lit(i).alias("c"), plain(df, c).alias("v")) for i, c in enumerate(cols)]
    )
    values = (
        df.select(F.explode(each).alias("e"))
        .select("e.c", "e.v")
        .where("v is not null")
        .distinct()
        .persist()
    )
    sizes = values.groupBy("c").agg(F.count(F.lit(1)).alias("n_lhs"))
    # Every column pair is a target: at most columns - 1 rows per value.
    others = F.array(*[F.lit(i) for i in range(len(cols))])
    needles = values.withColumn("d", F.explode(others)).where("c != d")
    texts = values.select(F.col("c").alias("d"), F.col("v").alias("t"))

    equal = needles.join(
        texts, (needles["d"] == texts["d"]) & (needles["v"] == texts["t"]), "left_semi"
    )
    left = needles.join(
        texts, (needles["d"] == texts["d"]) & (needles["v"] == texts["t"]), "left_anti"
    ).persist()
    short = left.where(F.length("v") <= GRAM)
    # At most GRAM numbers go to the driver.
    lengths = short.where("v != ''").select(F.length("v").alias("k")).distinct().orderBy("k").collect()
    small = _with_grams(texts.withColumnRenamed("t", "v"), [r["k"] for r in lengths])
    small = small.select("d", F.col("g").alias("v")).distinct()
    blank = short.where(F.length("v") == 0).join(
        texts.select("d").distinct(), "d", "left_semi"
    )
    by_short = short.join(small, ["d", "v"], "left_semi")

    grams = _with_grams(values, [GRAM])
    rarity = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    long_values = left.where(F.length("v") > GRAM).select("v").distinct()
    rarest = (
        _with_grams(long_values, [GRAM])
        .join(rarity, "g")
        .groupBy("v")
        .agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    )
    asked = left.where(F.length("v") > GRAM).join(rarest, "v")
    held = grams.select(F.col("c").alias("d"), "g", F.col("v").alias("t"))
    by_gram = asked.join(
        held,
        (asked["d"] == held["d"]) & (asked["g"] == held["g"]) & F.contains(held["t"], asked["v"]),
        "left_semi",
    )
    cols_cdv = ["c", "d", "v"]
    hits = equal.select(*cols_cdv)
    for part in (by_short, blank, by_gram):
        hits = hits.union(part.select(*cols_cdv))
    name = F.array(*[F.lit(c) for c in cols])
    conf = F.col("n_common") / F.col("n_lhs")
    return (
        hits.groupBy("c", "d")
        .agg(F.count(F.lit(1)).alias("n_common"))
        .join(F.broadcast(sizes), "c")  # one row per column
        .where(conf >= min_conf)
        .select(
            F.get(name, F.col("c")).alias("lhs"),
            F.get(name, F.col("d")).alias("rhs"),
            "n_common",
            "n_lhs",
            conf.alias("confidence"),
            (F.col("n_common") == F.col("n_lhs")).alias("is_exact"),
        )
    )


# --- summaries of found dependencies (frames with one row per column pair) ---------


def ind_roles(inds: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` columns most often contained, and most often containing."""
    out = None
    for side, role in (("lhs", "subset"), ("rhs", "superset")):
        counts = inds.groupBy(F.col(side).alias("column")).agg(F.count(F.lit(1)).alias("n"))
        part = counts.orderBy(F.desc("n"), "column").limit(k)
        part = part.select("column", F.lit(role).alias("role"), "n")
        out = part if out is None else out.union(part)
    return out


def ind_chains(inds: DataFrame) -> DataFrame:
    """A in B in D with A and D different."""
    one = inds.select(F.col("lhs").alias("a"), F.col("rhs").alias("b"), F.col("confidence").alias("conf_ab"))
    two = inds.select(F.col("lhs").alias("b"), F.col("rhs").alias("d"), F.col("confidence").alias("conf_bd"))
    return one.join(two, "b").where("a != d").select("a", "b", "d", "conf_ab", "conf_bd")


def ind_equivalences(inds: DataFrame) -> DataFrame:
    """Columns contained in each other, each pair once."""
    one = inds.select(F.col("lhs").alias("a"), F.col("rhs").alias("b"), F.col("confidence").alias("conf_ab"))
    two = inds.select(F.col("rhs").alias("a"), F.col("lhs").alias("b"), F.col("confidence").alias("conf_ba"))
    return one.join(two, ["a", "b"]).where("a < b")


def ind_edges(inds: DataFrame) -> DataFrame:
    return inds.select(
        F.col("lhs").alias("source"), F.col("rhs").alias("target"), F.col("confidence").alias("weight")
    )


