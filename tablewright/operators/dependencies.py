"""Exact and approximate functional dependencies, and keys."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.lattice import class_counts, pair_stats, single_keys, spread_stats

FD_SCHEMA = "lhs array<string>, rhs string"


def _minimal(found: list[frozenset], candidate: frozenset) -> bool:
    return not any(f <= candidate for f in found)


def _free_sets(
    df: DataFrame, cols: Sequence[str], top: int
) -> tuple[dict[str, list[frozenset]], list[frozenset], int]:
    """Minimal left sides per attribute, minimal keys, and the number of rows.

    Level by level: X -> A holds iff X and X+A split the rows into equally many classes.  Only
    sets that no known key or dependency reduces to a smaller one are counted, and only they
    are led on to the next level.  The driver keeps one number per counted set; the rows stay
    in Spark, one aggregate per level (in batches of sets).
    """
    lhs_of: dict[str, list[frozenset]] = {c: [] for c in cols}
    counts, rows = class_counts(df, [(c,) for c in cols])
    if not counts:
        return lhs_of, [], 0
    keys = [s for s, n in counts.items() if n == rows]

    def known(s: frozenset) -> int | None:
        while s not in counts:
            if any(k <= s for k in keys):
                return rows
            implied = next((a for a in s if not _minimal(lhs_of[a], s - {a})), None)
            if implied is None:
                return None
            s = s - {implied}
        return counts[s]

    level = list(counts)
    for _ in range(top):
        tried = [(x, a) for x in level for a in cols if a not in x and _minimal(lhs_of[a], x)]
        unknown = [s for s in dict.fromkeys(x | {a} for x, a in tried) if known(s) is None]
        counts |= class_counts(df, [tuple(sorted(s, key=cols.index)) for s in unknown])[0]
        new = [(x, a) for x, a in tried if known(x) == known(x | {a})]
        for x, a in new:
            lhs_of[a].append(x)
        keys += [s for s in unknown if counts[s] == rows]
        level = [s for s in unknown if all(_minimal(lhs_of[a], s - {a}) for a in s)]
        if not level:
            break
    return lhs_of, keys, rows


def discover_fds(
    df: DataFrame, columns: Sequence[str] | None = None, max_lhs: int | None = None
) -> DataFrame:
    """All minimal exact dependencies ``(lhs, rhs)`` with a non-empty left side.

    On an empty table every dependency holds; the minimal ones have one attribute.
    """
    cols = list(columns or df.columns)
    lhs_of, _, rows = _free_sets(df, cols, min(max_lhs or len(cols) - 1, len(cols) - 1))
    if not rows:
        out = [([x], a) for a in cols for x in cols if x != a]
    else:
        out = [(sorted(x, key=cols.index), a) for a in cols for x in lhs_of[a]]
    return df.sparkSession.createDataFrame(out, FD_SCHEMA)


def discover_keys(
    df: DataFrame, columns: Sequence[str] | None = None, max_size: int | None = None
) -> DataFrame:
    """Minimal attribute sets without two equal rows, as ``(attributes)``.

    If even all attributes together are no key, nothing else is counted.
    """
    cols = list(columns or df.columns)
    whole, rows = class_counts(df, [tuple(cols)])
    keys: list[frozenset] = []
    if whole and whole[frozenset(cols)] == rows:
        keys = _free_sets(df, cols, (max_size or len(cols)) - 1)[1]
    out = [(sorted(k, key=cols.index),) for k in keys]
    return df.sparkSession.createDataFrame(out, "attributes array<string>")


def _pairs(cols: Sequence[str], size: int) -> list[tuple[tuple[str, ...], str]]:
    return [
        (x, y) for y in cols for x in combinations([c for c in cols if c != y], size)
    ]


def fds_of_size(
    df: DataFrame, size: int, columns: Sequence[str] | None = None, keys: frozenset[str] | None = None
) -> DataFrame:
    """Dependencies with ``size`` attributes on the left; NULLs of either side are ignored.

    ``keys`` are the columns without two equal rows, if known.
    """
    pairs = _pairs(list(columns or df.columns), size)
    if not pairs:
        return df.sparkSession.createDataFrame([], FD_SCHEMA)
    stats = spread_stats(df, pairs, nulls=False, keys=keys)
    return stats.where("max_present = 1").select("lhs", "rhs")


def minimal_fds(fds: DataFrame) -> DataFrame:
    """Dependencies whose left side holds no smaller left side for the same right side."""
    a, b = fds.select("lhs", "rhs").distinct(), fds.select(
        F.col("lhs").alias("lhs2"), F.col("rhs").alias("rhs2")
    )
    nested = (
        (F.col("rhs") == F.col("rhs2"))
        & (F.size("lhs2") < F.size("lhs"))
        & (F.size(F.array_except("lhs2", "lhs")) == 0)
    )
    return a.join(b, nested, "left_anti")


def discover_minimal_fds(
    df: DataFrame, max_lhs: int = 4, columns: Sequence[str] | None = None
) -> DataFrame:
    """Sizes 1 to ``max_lhs`` together, minimal ones kept."""
    found, keys = None, single_keys(df, list(columns or df.columns))
    for size in range(1, max_lhs + 1):
        part = fds_of_size(df, size, columns, keys)
        found = part if found is None else found.union(part)
    return minimal_fds(found)


def g3_score(df: DataFrame, x: Sequence[str], y: str) -> DataFrame:
    """Sum of (size - 1) over X groups with several Y values, per row; empty table 1.0."""
    return _scored(df, [(tuple(x), y)], "bad_rows")


def g3_canonical(df: DataFrame, x: Sequence[str], y: str) -> DataFrame:
    """Smallest share of rows to drop until X -> Y holds; empty table 1.0."""
    return _scored(df, [(tuple(x), y)], "minority_rows")


def _scored(df: DataFrame, pairs, measure: str, keys: frozenset[str] | None = None) -> DataFrame:
    rows = df.agg(F.count(F.lit(1))).scalar()
    g3 = F.when(rows == 0, 1.0).otherwise(F.col(measure) / rows)
    # How large the largest group of a Y is takes counts of X and Y together; how many rows err does not.
    stats = spread_stats(df, pairs, nulls=True, keys=keys) if measure == "bad_rows" else pair_stats(df, pairs)
    return stats.select("lhs", "rhs", g3.alias("g3"))


def discover_afds(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_lhs: int = 2,
    threshold: float = 0.1,
    remove_redundant: bool = True,
) -> DataFrame:
    """Approximate dependencies ``(lhs, rhs, g3, confidence)``, level by level.

    All pairs of a level are scored in one job.
    """
    cols = list(columns or df.columns)
    found, keys = None, single_keys(df, cols)
    for size in range(1, max_lhs + 1):
        if size >= len(cols):
            break
        level = _scored(df, _pairs(cols, size), "bad_rows", keys).where(F.col("g3") <= threshold)
        # One row per accepted pair: small, and every later level looks at it.
        level = level.persist()
        if found is not None and remove_redundant:
            level = _not_covered(level, found)
        found = level if found is None else found.union(level)
    return found.withColumn("confidence", (1 - F.col("g3")) * 100).orderBy("g3", "rhs", "lhs")


def _not_covered(afds: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows without a kept smaller left side whose g3 is at most 10 % worse."""
    k = kept.select(
        F.col("lhs").alias("lhs2"), F.col("rhs").alias("rhs2"), F.col("g3").alias("g3_2")
    )
    covered = (
        (F.col("rhs") == F.col("rhs2"))
        & (F.size("lhs2") < F.size("lhs"))
        & (F.size(F.array_except("lhs2", "lhs")) == 0)
        & (F.col("g3_2") <= F.col("g3") * 1.1)
    )
    return afds.join(k, covered, "left_anti")


def filter_redundant(afds: DataFrame, max_lhs: int = 2) -> DataFrame:
    """Drop what a kept smaller dependency covers; sizes up to ``max_lhs`` in turn."""
    kept = afds.where(F.size("lhs") == 1)
    for size in range(2, max_lhs + 1):
        kept = kept.union(_not_covered(afds.where(F.size("lhs") == size), kept))
    return kept


# --- summaries of found dependencies ----------------------------------------------


def attribute_involvement(fds: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` attributes that occur most often on either side."""
    each = fds.select(F.explode(F.concat("lhs", F.array("rhs"))).alias("attribute"))
    counts = each.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "attribute").limit(k)


def attribute_roles(fds: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(attribute, role, lhs, rhs)``: where it determines and where it is determined."""
    left = fds.select(F.explode("lhs").alias("attribute"), F.lit("determines").alias("role"), "lhs", "rhs")
    right = fds.select(F.col("rhs").alias("attribute"), F.lit("determined").alias("role"), "lhs", "rhs")
    both = left.union(right)
    if columns is not None:
        return both.where(F.col("attribute").isin(list(columns)))
    top = attribute_involvement(fds).select("attribute")
    return both.join(F.broadcast(top), "attribute", "left_semi")


def fd_edges(fds: DataFrame, strength: str | None = None) -> DataFrame:
    """Edges attribute -> left side (0.5) and left side -> right side (strength)."""
    node = F.array_join("lhs", " + ")
    weight = F.col(strength) if strength else F.lit(1.0)
    into = (
        fds.where(F.size("lhs") > 1)
        .select(F.explode("lhs").alias("source"), node.alias("target"), F.lit(0.5).alias("weight"))
        .distinct()
    )
    return into.union(fds.select(node, "rhs", weight))


