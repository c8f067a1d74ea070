"""Counts over attribute sets: the kernel under keys, exact and approximate dependencies.

All attribute sets of a lattice level are counted by one ``GROUPING SETS`` aggregate:
the values stay typed, combine before the shuffle, and a hot value costs one row per
task.  NULL is a value like any other; ``grouping_id`` tells it from "not in this set".
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AttributeSet = tuple[str, ...]
Pair = tuple[AttributeSet, str]

# Sets counted by one job: each input row is expanded once per set.
SETS_PER_JOB = 64


def _ordered(columns: Sequence[str], names: Sequence[str]) -> AttributeSet:
    return tuple(c for c in columns if c in set(names))


def set_id(columns: Sequence[str], names: Sequence[str]) -> int:
    """``grouping_id`` of a set: one bit per column, 1 where it is left out."""
    out = 0
    for c in columns:
        out = out * 2 + (c not in names)
    return out


def set_counts(df: DataFrame, columns: Sequence[str], sets: Sequence[AttributeSet]) -> DataFrame:
    """``(set_id, c0, c1, ..., n)``: rows per combination of values, for every set.

    Column number i of ``columns`` is called ``c{i}``, so no table column can clash.
    """
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    names = {c: F.col(f"c{i}") for i, c in enumerate(columns)}
    grouped = plain.groupingSets([[names[c] for c in s] for s in sets], *names.values())
    return grouped.agg(F.grouping_id().alias("set_id"), F.count(F.lit(1)).alias("n")).select(
        "set_id", *names.values(), "n"
    )


def _chunks(items: Sequence, size: int) -> Iterator[Sequence]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


def partition_stats(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Per attribute set: classes, rows in classes of more than one row, key error.

    ``error`` is the share of rows to remove before the set becomes a key.
    """
    columns = _ordered(df.columns, [c for s in sets for c in s])
    unique = list(dict.fromkeys(_ordered(columns, s) for s in sets))
    out = None
    for chunk in _chunks(unique, SETS_PER_JOB):
        big = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
        stats = set_counts(df, columns, chunk).groupBy("set_id").agg(
            F.count(F.lit(1)).alias("classes"),
            F.sum("n").alias("rows"),
            F.sum(big).alias("grouped_rows"),
            F.count_if(F.col("n") > 1).alias("grouped_classes"),
        )
        names = df.sparkSession.createDataFrame(
            [(set_id(columns, s), list(s)) for s in chunk],
            "set_id long, attributes array<string>",
        )
        part = stats.join(F.broadcast(names), "set_id").select(
            "attributes",
            "classes",
            "rows",
            "grouped_rows",
            ((F.col("grouped_rows") - F.col("grouped_classes")) / F.col("rows")).alias("error"),
        )
        out = part if out is None else out.union(part)
    return out


def class_counts(
    df: DataFrame, sets: Sequence[AttributeSet]
) -> tuple[dict[frozenset, int], int]:
    """Number of classes per attribute set, and the row count, on the driver."""
    if not sets:
        return {}, 0
    found = partition_stats(df, sets).select("attributes", "classes", "rows").collect()
    rows = max((r["rows"] for r in found), default=0)
    return {frozenset(r["attributes"]): r["classes"] for r in found}, rows


def _pair_rows(df: DataFrame, pairs: Sequence[Pair]) -> tuple[DataFrame, list[str]]:
    """One row per (pair, X value, Y value), and the columns' order.

    ``c{i}`` are the X values, ``y{i}`` the Y value where the Y is column i; ``n`` counts rows.
    Each union X+Y is counted once; dropping Y in turn from those counts serves every
    pair on the same attributes.  Groups with a NULL in X are left out.
    """
    columns = _ordered(df.columns, [c for x, y in pairs for c in (*x, y)])
    unions: dict[AttributeSet, list[int]] = {}
    for x, y in pairs:
        unions.setdefault(_ordered(columns, (*x, y)), []).append(columns.index(y))
    counts = None
    for chunk in _chunks(list(unions), SETS_PER_JOB):
        part = set_counts(df, columns, chunk)
        counts = part if counts is None else counts.union(part)
    drops = F.create_map(
        *[
            v
            for u, ds in unions.items()
            for v in (
                F.lit(set_id(columns, u)).cast("long"),
                F.array(*[F.lit(d) for d in sorted(set(ds))]),
            )
        ]
    )
    each = counts.withColumn("rhs_id", F.explode(F.element_at(drops, F.col("set_id"))))

    def member(i: int) -> Column:
        bit = len(columns) - 1 - i
        return F.shiftright("set_id", bit).bitwiseAND(F.lit(1)) == 0

    x_null, y_null = F.lit(False), F.lit(False)
    for i in range(len(columns)):
        null = F.col(f"c{i}").isNull()
        x_null = x_null | (member(i) & (F.col("rhs_id") != i) & null)
        y_null = y_null | ((F.col("rhs_id") == i) & null)
    masked = [F.when(F.col("rhs_id") != i, F.col(f"c{i}")).alias(f"c{i}") for i in range(len(columns))]
    ys = [F.when(F.col("rhs_id") == i, F.col(f"c{i}")).alias(f"y{i}") for i in range(len(columns))]
    return each.where(~x_null).select("set_id", "rhs_id", *masked, *ys, "n", y_null.alias("y_null")), list(columns)


def pair_groups(df: DataFrame, pairs: Sequence[Pair], mode: bool = False) -> DataFrame:
    """One row per (pair, X value): group size and the spread of Y inside.

    NULL counts as a value of Y.  ``mode`` adds the most frequent one that is not NULL, the smallest
    of several, as field ``y{i}`` of a struct.
    """
    flat, columns = _pair_rows(df, pairs)
    present = F.when(~F.col("y_null"), F.col("n")).otherwise(0)
    ys = [F.col(f"y{i}") for i in range(len(columns))]
    order = F.when(~F.col("y_null"), F.struct(-F.col("n"), *ys))
    most = [F.min_by(F.struct(*ys), order).alias("mode")] if mode else []
    return flat.groupBy("set_id", "rhs_id", *[f"c{i}" for i in range(len(columns))]).agg(
        F.sum("n").alias("size"),
        F.count(F.lit(1)).alias("n_values"),
        F.count_if(~F.col("y_null")).alias("n_present"),
        F.sum(present).alias("present_rows"),
        F.max("n").alias("largest"),
        *most,
    )


def pair_stats(df: DataFrame, pairs: Sequence[Pair]) -> DataFrame:
    """Per pair X -> Y the sums every dependency measure is made of."""
    columns = _ordered(df.columns, [c for x, y in pairs for c in (*x, y)])
    bad = F.col("n_values") > 1
    stats = pair_groups(df, pairs).groupBy("set_id", "rhs_id").agg(
        F.count(F.lit(1)).alias("groups"),
        F.max("n_present").alias("max_present"),
        F.count_if(bad).alias("bad_groups"),
        F.sum(F.when(bad, F.col("size") - 1).otherwise(0)).alias("bad_rows"),
        F.sum(F.col("size") - F.col("largest")).alias("minority_rows"),
        F.sum(F.when(bad, F.col("present_rows") - 1).otherwise(0)).alias("surplus_values"),
    )
    names = df.sparkSession.createDataFrame(
        [
            (set_id(columns, (*x, y)), columns.index(y), list(_ordered(columns, x)), y)
            for x, y in dict.fromkeys(pairs)
        ],
        "set_id long, rhs_id int, lhs array<string>, rhs string",
    )
    # One row per asked pair; a pair without groups keeps zeros.
    sums = ["groups", "max_present", "bad_groups", "bad_rows", "minority_rows", "surplus_values"]
    return (
        F.broadcast(names)
        .join(stats, ["set_id", "rhs_id"], "left")
        .select("lhs", "rhs", *[F.coalesce(s, F.lit(0).cast("long")).alias(s) for s in sums])
    )


def single_keys(df: DataFrame, columns: Sequence[str]) -> frozenset[str]:
    """Columns without two equal rows."""
    counts, rows = class_counts(df, [(c,) for c in columns])
    return frozenset(c for s, n in counts.items() if n == rows for c in s)


def spread_stats(
    df: DataFrame, pairs: Sequence[Pair], nulls: bool, keys: frozenset[str] | None = None
) -> DataFrame:
    """``(lhs, rhs, max_present, bad_rows)`` per pair X -> Y, from one group per X and none per Y.

    ``max_present`` tells 0, 1 or 2 (and more) values of Y in the group that holds most, ``bad_rows``
    sums size - 1 over groups with several.  ``nulls`` makes NULL a value of Y.  Groups with a NULL
    in X are left out.  All Y of an X share its groups: the least and greatest 64-bit hash differ
    where values do.  An X that holds one of ``keys`` (found if not given) has groups of one row:
    those are looked at in place.
    """
    columns = _ordered(df.columns, [c for x, y in pairs for c in (*x, y)])
    pairs = [(_ordered(columns, x), y) for x, y in dict.fromkeys(pairs)]
    attributes = _ordered(columns, [c for x, _ in pairs for c in x])
    keys = single_keys(df, attributes) if keys is None else keys
    at = {c: i for i, c in enumerate(columns)}
    hashed = [F.xxhash64(f"`{c}`") if nulls else F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(f"`{c}`")) for c in columns]
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], *[h.alias(f"h{i}") for i, h in enumerate(hashed)])
    parts = []
    for chunk in _chunks([p for p in pairs if keys & set(p[0])], SETS_PER_JOB):
        def one_row(x: AttributeSet, y: str) -> Column:
            there = F.col(f"h{at[y]}").isNotNull()
            for c in x:
                there = there & F.col(f"c{at[c]}").isNotNull()
            return F.coalesce(F.max(there.cast("long")), F.lit(0).cast("long"))

        found = plain.agg(*[one_row(x, y).alias(f"p{i}") for i, (x, y) in enumerate(chunk)])
        told = [
            F.struct(F.array(*map(F.lit, x)).alias("lhs"), F.lit(y).alias("rhs"), F.col(f"p{i}").alias("max_present"), F.lit(0).cast("long").alias("bad_rows"))
            for i, (x, y) in enumerate(chunk)
        ]
        parts.append(found.select(F.inline(F.array(*told))))
    rights: dict[AttributeSet, list[str]] = {}
    for x, y in pairs:
        if not keys & set(x):
            rights.setdefault(x, []).append(y)
    for chunk in _chunks(list(rights), SETS_PER_JOB):
        parts.append(_spread(plain, columns, {x: rights[x] for x in chunk}))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _spread(plain: DataFrame, columns: Sequence[str], rights: dict[AttributeSet, list[str]]) -> DataFrame:
    """``spread_stats`` of left sides that are grouped, by one ``GROUPING SETS`` aggregate."""
    at = {c: i for i, c in enumerate(columns)}
    used = _ordered(columns, [c for x in rights for c in x])
    ys = _ordered(columns, [y for some in rights.values() for y in some])
    names = {c: F.col(f"c{at[c]}") for c in used}
    spread = [f(f"h{at[y]}").alias(f"{name}{at[y]}") for y in ys for name, f in (("lo", F.min), ("hi", F.max))]
    groups = plain.groupingSets([[names[c] for c in x] for x in rights], *names.values()).agg(
        F.grouping_id().alias("set_id"), F.count(F.lit(1)).alias("n"), *spread
    )
    whole = F.lit(True)
    for i, c in enumerate(used):
        member = F.shiftright("set_id", len(used) - 1 - i).bitwiseAND(F.lit(1)) == 0
        whole = whole & ~(member & names[c].isNull())
    sums = []
    for y in ys:
        lo, hi = F.col(f"lo{at[y]}"), F.col(f"hi{at[y]}")
        sums.append(F.max(F.when(lo.isNull(), 0).when(lo == hi, 1).otherwise(2).cast("long")).alias(f"most{at[y]}"))
        sums.append(F.sum(F.when(lo != hi, F.col("n") - 1).otherwise(0)).alias(f"bad{at[y]}"))
    per_set = groups.where(whole).groupBy("set_id").agg(*sums)
    each = [F.struct(F.lit(y).alias("rhs"), F.col(f"most{at[y]}").alias("max_present"), F.col(f"bad{at[y]}").alias("bad_rows")) for y in ys]
    told = per_set.select("set_id", F.inline(F.array(*each)))
    asked = plain.sparkSession.createDataFrame(
        [(set_id(used, x), list(x), y) for x, some in rights.items() for y in some], "set_id long, lhs array<string>, rhs string"
    )
    zero = F.lit(0).cast("long")
    # One row per asked pair; a pair without groups keeps zeros.
    return F.broadcast(asked).join(told, ["set_id", "rhs"], "left").select(
        "lhs", "rhs", F.coalesce("max_present", zero).alias("max_present"), F.coalesce("bad_rows", zero).alias("bad_rows")
    )
