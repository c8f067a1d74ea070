"""Profiling and quality reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.frames import share, unpivot_strings
from tablewright.functions.stats import exact_quantiles, number_report
from tablewright.operators.fuzzy import close_matches
from tablewright.operators.lattice import set_counts, set_id
from tablewright.operators.rows import drop_nulls, sample_n

QUARTILES = (0.25, 0.5, 0.75)


def _rows() -> Column:
    return F.count(F.lit(1))


def _kind(field: T.StructField) -> str:
    if isinstance(field.dataType, T.BooleanType):
        return "boolean"
    if isinstance(field.dataType, T.NumericType):
        return "numerical"
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "categorical"


def value_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` for the non-NULL values, as strings: one shuffle."""
    long = unpivot_strings(df, columns).where("value is not null")
    return long.groupBy("column", "value").agg(_rows().alias("n"))


def _distinct_and_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct count per column and, for text, the smallest most frequent value.

    The values of all columns are counted by one aggregate with their own types.
    """
    ids = [set_id(columns, (c,)) for c in columns]
    is_text = {f.name: _kind(f) == "categorical" for f in df.schema.fields}
    counts = set_counts(df, columns, [(c,) for c in columns])
    present = reduce(
        lambda a, b: a | b, [F.col(f"c{i}").isNotNull() for i in range(len(columns))]
    )
    texts = [F.col(f"c{i}").cast("string") for i, c in enumerate(columns) if is_text[c]]
    value = F.coalesce(*texts) if texts else F.lit(None).cast("string")
    order = F.when(value.isNotNull(), F.struct(-F.col("n"), value))
    name = F.create_map(*[x for i, c in zip(ids, columns) for x in (F.lit(i).cast("long"), F.lit(c))])
    return (
        counts.where(present)
        .groupBy("set_id")
        .agg(
            _rows().alias("unique_count"),
            F.min_by(F.struct(value.alias("value"), "n"), order).alias("top"),
        )
        .select(
            F.element_at(name, F.col("set_id")).alias("column"),
            "unique_count",
            F.col("top.value").alias("top_value"),
            F.col("top.n").alias("top_freq"),
        )
    )


DESCRIPTION = (
    "column string, dtype string, kind string, total_count long, missing_count long, "
    "missing_pct double, mean double, std_dev double, min double, q25 double, "
    "median double, q75 double, max double, skewness double, kurtosis double, "
    "min_date string, max_date string, range_days long, true_count long, "
    "false_count long, true_pct double"
)


def describe_columns(df: DataFrame) -> DataFrame:
    """One row per column; fields that do not fit its type are NULL.

    Counts and ranges come from one aggregate, moments and quartiles from the two scans of
    ``number_report``; distinct values and modes from one grouping of all columns.
    """
    kinds = {f.name: _kind(f) for f in df.schema.fields}
    numbers = [c for c, k in kinds.items() if k == "numerical"]
    aggs = [_rows().alias("rows")]
    for c, kind in kinds.items():
        col = F.col(f"`{c}`")
        aggs.append(F.count(col).alias(f"{c}|count"))
        if kind == "datetime":
            aggs += [
                F.min(col).cast("string").alias(f"{c}|min_date"),
                F.max(col).cast("string").alias(f"{c}|max_date"),
                whole_days(F.min(col), F.max(col)).alias(f"{c}|range_days"),
            ]
        elif kind == "boolean":
            aggs.append(F.count_if(col).alias(f"{c}|true_count"))
    row = df.agg(*aggs).first()
    found, quartiles = number_report(df, numbers, QUARTILES) if numbers else ({}, {})

    def line(c: str) -> dict:
        n, total = row[f"{c}|count"], row["rows"]
        out = {
            "column": c,
            "dtype": df.schema[c].dataType.simpleString(),
            "kind": kinds[c],
            "total_count": total,
            "missing_count": total - n,
            "missing_pct": (total - n) * 100 / total if total else None,
        }
        if kinds[c] == "numerical":
            out |= {k: v for k, v in found.get(c, {}).items() if k not in ("i", "count")}
            out |= dict(zip(("q25", "median", "q75"), quartiles[c]))
        elif kinds[c] == "datetime":
            out |= {k: row[f"{c}|{k}"] for k in ("min_date", "max_date", "range_days")}
        elif kinds[c] == "boolean":
            true = row[f"{c}|true_count"]
            out |= {"true_count": true, "false_count": n - true}
            out["true_pct"] = true * 100 / n if n else None
        return out

    names = [f.split()[0] for f in DESCRIPTION.split(", ")]
    lines = [tuple(line(c).get(f) for f in names) for c in kinds]
    stats = df.sparkSession.createDataFrame(lines, DESCRIPTION)
    joined = stats.join(_distinct_and_mode(df, list(kinds)), "column", "left")
    text = F.col("kind") == "categorical"
    zero = F.lit(0).cast("long")
    return joined.withColumns(
        {
            "unique_count": F.coalesce("unique_count", zero),
            "top_value": F.when(text, F.col("top_value")),
            "top_freq": F.when(text, F.coalesce("top_freq", zero)),
            "top_pct": F.when(text, share(F.coalesce("top_freq", zero) * 100, F.col("total_count"))),
        }
    )


def whole_days(start: Column, end: Column) -> Column:
    """Full days between two points in time."""
    return F.extract(F.lit("DAY"), end - start).cast("long")


def describe_by_type(df: DataFrame) -> dict[str, DataFrame]:
    """The same report in one table per kind of column the input has."""
    stats = describe_columns(df)
    common = ["column", "dtype", "total_count", "missing_count", "missing_pct", "unique_count"]
    special = {
        "numerical": ["mean", "std_dev", "min", "q25", "median", "q75", "max", "skewness", "kurtosis"],
        "categorical": ["top_value", "top_freq", "top_pct"],
        "datetime": ["min_date", "max_date", "range_days"],
        "boolean": ["true_count", "false_count", "true_pct"],
    }
    kinds = {_kind(f) for f in df.schema.fields} | {"numerical", "categorical"}
    return {
        k: stats.where(F.col("kind") == k).select(*common, *cols)
        for k, cols in special.items()
        if k in kinds
    }


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column, most missing first."""
    counts = df.agg(
        _rows().alias("__rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"`{c}`").alias("missing"),
            share(F.col(f"`{c}`") * 100, F.col("__rows")).alias("pct"),
        )
        for c in df.columns
    ]
    return counts.select(F.inline(F.array(*rows))).orderBy(F.desc("missing"), "column")


def nullity_correlation(df: DataFrame) -> DataFrame:
    """Correlation of "is NULL" for column pairs; always or never NULL columns drop out.

    Rows collapse to their NULL pattern first; pairs are formed on the patterns.
    """
    cols = df.columns
    flags = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in cols])
    patterns = df.groupBy(flags.alias("p")).agg(_rows().alias("n"))
    pairs = F.array(
        *[
            F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                     F.lit(i).alias("i"), F.lit(j).alias("j"))
            for i, a in enumerate(cols)
            for j, b in enumerate(cols)
            if i < j
        ]
    )
    each = patterns.select("p", "n", F.inline(pairs))
    a = F.substr("p", F.col("i") + 1, F.lit(1)) == "1"
    b = F.substr("p", F.col("j") + 1, F.lit(1)) == "1"
    sums = each.groupBy("col_a", "col_b").agg(
        F.sum("n").cast("double").alias("n"),
        F.sum(F.when(a, F.col("n")).otherwise(0)).cast("double").alias("na"),
        F.sum(F.when(b, F.col("n")).otherwise(0)).cast("double").alias("nb"),
        F.sum(F.when(a & b, F.col("n")).otherwise(0)).cast("double").alias("nab"),
    )
    spread = F.expr("na * (n - na)") * F.expr("nb * (n - nb)")
    corr = F.expr("n * nab - na * nb") / F.sqrt(spread)
    return sums.where(spread > 0).select("col_a", "col_b", corr.alias("correlation"))


def column_profile(df: DataFrame, samples: int = 2) -> DataFrame:
    """Missing percentage, distinct values and the first sample values in text order."""
    values = value_table(df, df.columns)
    # rank <= samples is pushed below the shuffle: few rows per column meet.
    order = Window.partitionBy("column").orderBy("value")
    firsts = values.withColumn("r", F.row_number().over(order)).where(F.col("r") <= samples)
    shown = firsts.groupBy("column").agg(
        F.array_sort(F.collect_list("value")).alias("v")
    )
    distinct = values.groupBy("column").agg(_rows().alias("unique_values"))
    report = missing_report(df).join(distinct, "column", "left").join(shown, "column", "left")
    return report.select(
        "column",
        F.format_string("%.3f%%", "pct").alias("missing_values"),
        F.coalesce("unique_values", F.lit(0).cast("long")).alias("unique_values"),
        F.coalesce(F.array_join("v", ", "), F.lit("")).alias("sample_values"),
    )


def summary(df: DataFrame) -> DataFrame:
    """Spark's generic summary, with exact, interpolated quartiles for its percentiles."""
    shown = df.summary("count", "mean", "stddev", "min", "max")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numbers = [c for c in shown.columns[1:] if isinstance(kinds[c], T.NumericType)]
    quartiles = exact_quantiles(df, numbers, [0.25, 0.5, 0.75]) if numbers else {}
    for i, name in enumerate(("25%", "50%", "75%")):
        cells = [F.lit(quartiles[c][i] if c in quartiles else None).cast("string").alias(c) for c in shown.columns[1:]]
        shown = shown.union(df.sparkSession.range(1).select(F.lit(name).alias("summary"), *cells))
    return shown


def value_counts(
    df: DataFrame,
    columns: Sequence[str],
    dropna: bool = True,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Count and share per value; ``order`` gives a fixed domain of the one column."""
    kept = drop_nulls(df, columns) if dropna else df
    total = kept.agg(_rows()).scalar()
    counts = kept.groupBy(*columns).agg(_rows().alias("n"))
    shared = counts.withColumn("share", F.col("n") / total)
    if order is None:
        return shared
    domain = df.sparkSession.createDataFrame(
        [(v, i) for i, v in enumerate(order)], f"{columns[0]} string, position int"
    )
    return domain.join(shared, columns[0], "left").orderBy("position")


def domain_check(
    df: DataFrame, column: str, domain: Sequence[str], fill: str | None = None
) -> DataFrame:
    """Invalid values with their counts; a value filled in for NULL counts as one."""
    c = F.coalesce(F.col(column), F.lit(fill)) if fill is not None else F.col(column)
    bad = df.where(~F.coalesce(c.isin(list(domain)), F.lit(False)))
    return bad.groupBy(c.alias("value")).agg(_rows().alias("n"))


def domain_summary(
    df: DataFrame, column: str, domain: Sequence[str], fill: str | None = None
) -> DataFrame:
    c = F.coalesce(F.col(column), F.lit(fill)) if fill is not None else F.col(column)
    bad = ~F.coalesce(c.isin(list(domain)), F.lit(False))
    return df.agg(
        F.count_if(F.col(column).isNull()).alias("missing_before_fill"),
        F.count_if(bad).alias("invalid_count"),
    )


# Outcome classes in the order they are shown.
OUTCOME_RANKS = (("Pass", 0), ("Fail", 1), ("Condition", 2))


def ranked_distribution(
    df: DataFrame, column: str, ranks: Sequence[tuple[str, int]] = OUTCOME_RANKS, rest: int = 3
) -> DataFrame:
    """Counts and percentages, ordered by the first rank rule a value contains."""
    c = F.col(column)
    rank = reduce(lambda w, r: w.when(c.contains(r[0]), r[1]), ranks[1:],
                  F.when(c.contains(ranks[0][0]), ranks[0][1])).otherwise(rest)
    counts = value_counts(df, [column])
    return counts.select(
        rank.alias("rank"), column, "n", (F.col("share") * 100).alias("pct")
    ).orderBy("rank", F.desc("n"), column)


def temporal_profile(df: DataFrame, column: str) -> DataFrame:
    """``(part, label, position, n)``: rows per year and per calendar month."""
    c = F.col(column)
    parts = F.array(
        F.struct(F.lit("year").alias("part"), F.year(c).cast("string").alias("label"),
                 F.year(c).alias("position")),
        F.struct(F.lit("month").alias("part"), F.date_format(c, "MMMM").alias("label"),
                 F.month(c).alias("position")),
    )
    each = df.where(c.isNotNull()).select(F.inline(parts))
    return each.groupBy("part", "label", "position").agg(_rows().alias("n"))


def temporal_summary(df: DataFrame, column: str) -> DataFrame:
    """First and last date, most active year and month; ties go to the earlier one."""
    counts = temporal_profile(df, column)

    def busiest(part: str) -> Column:
        mine = F.col("part") == part
        return F.min_by(
            F.when(mine, F.col("label")),
            F.when(mine, F.struct(-F.col("n"), F.col("position"))),
        )

    active = counts.agg(busiest("year").alias("busiest_year"), busiest("month").alias("busiest_month"))
    span = df.agg(F.min(column).alias("first"), F.max(column).alias("last"))
    return span.select(
        F.to_date("first").alias("first_date"),
        F.to_date("last").alias("last_date"),
        active.select("busiest_year").scalar().alias("busiest_year"),
        active.select("busiest_month").scalar().alias("busiest_month"),
    )


def crosstab(
    df: DataFrame, a: str, b: str, normalize: bool = False, margins: bool = False
) -> DataFrame:
    """Long cross table ``(a, b, n)``; margins carry ``All``.

    ``normalize`` adds the percentage within each value of ``a``.
    """
    kept = drop_nulls(df, [a, b])
    if margins:
        cube = kept.cube(a, b).agg(
            _rows().alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb")
        )
        out = cube.select(
            F.when(F.col("ga") == 1, "All").otherwise(F.col(a).cast("string")).alias(a),
            F.when(F.col("gb") == 1, "All").otherwise(F.col(b).cast("string")).alias(b),
            "n",
        )
    else:
        out = kept.groupBy(a, b).agg(_rows().alias("n"))
    if normalize:
        row = kept.groupBy(F.col(a).cast("string").alias("__a")).agg(_rows().alias("__t"))
        total = kept.agg(_rows()).scalar()
        out = (
            out.join(row, F.col(a).cast("string") == F.col("__a"), "left")
            .withColumn("pct", F.col("n") * 100.0 / F.coalesce("__t", total))
            .drop("__a", "__t")
        )
    return out


def crosstab_wide(df: DataFrame, a: str, b: str, domain: Sequence[str]) -> DataFrame:
    """Wide cross table with one column per value of a bounded domain."""
    wide = drop_nulls(df, [a, b]).groupBy(a).pivot(b, list(domain)).agg(_rows())
    return wide.na.fill(0)


def group_rate(df: DataFrame, group: Column, predicate: Column, name: str = "grp") -> DataFrame:
    """Percentage of rows per group that meet ``predicate``."""
    return df.groupBy(group.alias(name)).agg(
        _rows().alias("n"),
        F.count_if(predicate).alias("hits"),
        share(F.count_if(predicate) * 100, _rows()).alias("rate"),
    )


def top_k(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    counts = drop_nulls(df, columns).groupBy(*columns).agg(_rows().alias("n"))
    return counts.orderBy(F.desc("n"), *columns).limit(k)


def length_distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.length(F.col(column).cast("string")).alias("length")).agg(
        _rows().alias("n")
    )


def prefix_summary(
    df: DataFrame,
    column: str,
    classes: Sequence[tuple[str, str]],
    rest: str = "Other",
    examples: int = 3,
) -> DataFrame:
    """Count and first examples per class; ``classes`` are ``(label, prefix)``, first wins."""
    c = F.trim(F.col(column).cast("string"))
    label = reduce(lambda w, r: w.when(c.startswith(r[1]), r[0]), classes[1:],
                   F.when(c.startswith(classes[0][1]), classes[0][0])).otherwise(rest)
    values = (
        df.where(F.col(column).isNotNull())
        .groupBy(label.alias("region"), c.alias("v"))
        .agg(_rows().alias("n"))
    )
    counts = values.groupBy("region").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("region").orderBy("v")
    firsts = values.withColumn("r", F.row_number().over(order)).where(F.col("r") <= examples)
    shown = firsts.groupBy("region").agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("examples"))
    labels = [c[0] for c in classes] + [rest]
    all_labels = df.sparkSession.createDataFrame([(x,) for x in labels], "region string")
    return (
        all_labels.join(counts, "region", "left")
        .join(shown, "region", "left")
        .select("region", F.coalesce("n", F.lit(0).cast("long")).alias("n"),
                F.coalesce("examples", F.lit("")).alias("examples"))
    )


def not_prefixed(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Values that do not start with ``prefix``, sorted."""
    c = F.trim(F.col(column).cast("string"))
    return df.select(c.alias(column)).where(~F.col(column).startswith(prefix)).orderBy(column)


def duplicates(df: DataFrame, key: Sequence[str] | None = None) -> DataFrame:
    """Surplus rows, repeated groups and rows in them, for whole rows or a key."""
    groups = df.groupBy(*(key or df.columns)).agg(_rows().alias("__n"))
    groups = groups.select(F.col("__n").alias("n")).where("n > 1")
    zero = F.lit(0).cast("long")
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicate_rows"),
        _rows().alias("duplicate_groups"),
        F.coalesce(F.sum("n"), zero).alias("rows_in_groups"),
    )


def duplicate_examples(df: DataFrame, key: Sequence[str], groups: int = 5) -> DataFrame:
    """All rows of the first repeated keys."""
    repeated = df.groupBy(*key).agg(_rows().alias("__n")).where("__n > 1")
    first = repeated.orderBy(*key).limit(groups)
    # A handful of keys by construction.
    same = reduce(lambda x, y: x & y, [df[k].eqNullSafe(first[k]) for k in key])
    return df.join(F.broadcast(first), same, "left_semi")


def mapping_conflicts(
    df: DataFrame, key: str, value: str, nulls: str = "ignore"
) -> DataFrame:
    """Keys with more than one value; ``nulls='value'`` counts NULL as a value."""
    pairs = df.where(F.col(key).isNotNull()).select(key, value).distinct()
    if nulls == "ignore":
        pairs = pairs.where(F.col(value).isNotNull())
    return pairs.groupBy(key).agg(_rows().alias("n_values")).where("n_values > 1")


def conflict_rows(df: DataFrame, key: str, value: str, nulls: str = "ignore") -> DataFrame:
    """All rows whose key is in conflict."""
    return df.join(mapping_conflicts(df, key, value, nulls).select(key), key, "left_semi")


def date_order(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows with both dates, and rows where the first lies after the second."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        aggs += [
            F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"c{i}"),
            F.count_if(F.col(a) > F.col(b)).alias(f"w{i}"),
        ]
    rows = [
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"),
                 F.col(f"c{i}").alias("compared"), F.col(f"w{i}").alias("wrong_order"))
        for i, (a, b) in enumerate(pairs)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def category_consistency(
    df: DataFrame, columns: Sequence[str], limit: int = 20, cutoff: float = 0.8, n: int = 3
) -> DataFrame:
    """Columns with more than ``limit`` values: similar values of the most frequent ones."""
    out = None
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(_rows().alias("n")).persist()
        asked = counts.orderBy(F.desc("n"), c).limit(limit).select(c)
        # The search counts the value itself as one of the n.
        near = close_matches(counts, c, cutoff, n - 1, queries=asked)
        size = counts.agg(_rows()).scalar()
        a = counts.select(F.col(c).alias("value"), F.col("n").alias("value_count"))
        b = counts.select(F.col(c).alias("match"), F.col("n").alias("match_count"))
        rows = (
            near.join(a, "value")
            .join(b, "match")
            .where(size > limit)
            .select(F.lit(c).alias("column"), size.alias("distinct_values"), "value",
                    "value_count", "match", "match_count", "ratio")
        )
        out = rows if out is None else out.union(rows)
    return out


# Days since the newest row and the score for being newer than that.
FRESHNESS = ((30, 1.0), (90, 0.9), (180, 0.8), (365, 0.6))
STALE = 0.4


def quality_score(
    df: DataFrame,
    key: Sequence[str],
    group: str,
    outcome: str,
    valid: Sequence[str],
    date: str,
    as_of: str,
) -> DataFrame:
    """Completeness, uniqueness, consistency, validity, timeliness and their mean."""
    n = len(df.columns)
    nulls = reduce(lambda x, y: x + y, [F.col(f"`{c}`").isNull().cast("long") for c in df.columns])
    o = F.col(outcome)
    one = df.agg(
        _rows().alias("rows"),
        F.sum(nulls).alias("nulls"),
        F.count_if(o.isNotNull() & ~o.isin(list(valid))).alias("invalid"),
        F.max(F.col(date)).alias("newest"),
    )
    keys = df.select(*key).distinct().agg(_rows()).scalar()
    # Share of each outcome within its group, then the spread of each outcome.
    cells = drop_nulls(df, [group, outcome]).groupBy(group, outcome).agg(_rows().alias("n"))
    totals = cells.groupBy(F.col(group).alias("__g")).agg(F.sum("n").alias("t"))
    shares = cells.join(totals, F.col(group) == F.col("__g")).withColumn("s", F.col("n") / F.col("t"))
    spread = shares.groupBy(outcome).agg(F.stddev_samp("s").alias("sd")).agg(F.avg("sd")).scalar()
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("newest"))
    fresh = reduce(lambda w, r: w.when(age < r[0], r[1]), FRESHNESS[1:],
                   F.when(age < FRESHNESS[0][0], FRESHNESS[0][1]))
    scores = one.select(
        (1 - F.col("nulls") / (F.col("rows") * n)).alias("completeness"),
        (1 - (F.col("rows") - keys) / F.col("rows")).alias("uniqueness"),
        (1 - F.least(F.lit(1.0), F.coalesce(spread * 5, F.lit(0.0)))).alias("consistency"),
        (1 - F.col("invalid") / F.col("rows")).alias("validity"),
        fresh.otherwise(STALE).alias("timeliness"),
    )
    mean = reduce(lambda x, y: x + y, [F.col(c) for c in scores.columns]) / len(scores.columns)
    return scores.withColumn("overall", mean)


def invalid_causes(df: DataFrame, raw: str, flag: str) -> DataFrame:
    """Invalid rows, their share, and whether all of them were NULL before cleaning."""
    bad = ~F.coalesce(F.col(flag), F.lit(False))
    return df.agg(
        F.count_if(bad).alias("invalid_rows"),
        share(F.count_if(bad), _rows()).alias("invalid_share"),
        F.coalesce(F.bool_and(F.when(bad, F.col(raw).isNull())), F.lit(True)).alias("all_null"),
    )


def coordinate_sample(
    df: DataFrame, lat: str, lon: str, n: int, seed: int, key: Sequence[str]
) -> DataFrame:
    return sample_n(df.select(*key, lat, lon), n, seed, key).select(lat, lon)
