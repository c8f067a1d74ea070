"""Baskets, frequent itemsets and association rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.frames import kept_table, unpivot_strings
from tablewright.operators.multivalue import CODES

# Between column and value where items of several columns meet: in no column name.
SEP = "\x1f"
CODE_PREFIX = "Violation_"
RULES_SCHEMA = (
    "antecedents array<string>, consequents array<string>, "
    "support double, confidence double, lift double"
)


def top_categories(
    df: DataFrame, columns: Sequence[str], k: int, weight: str | None = None
) -> dict[str, list[str]]:
    """The ``k`` most frequent values per column, on the driver (at most k per column).

    A row counts once, or as often as its ``weight`` says.
    """
    if not columns:
        return {}
    rows = F.col(weight) if weight else F.lit(1)
    counts = (
        unpivot_strings(df, columns, [rows.alias("__rows")])
        .where("value is not null")
        .groupBy("column", "value")
        .agg(F.sum("__rows").alias("n"))
    )
    # rank <= k is pushed below the shuffle: k rows per task and column meet.
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    out: dict[str, list[str]] = {c: [] for c in columns}
    for row in top.orderBy("column", "r").collect():
        out[row["column"]].append(row["value"])
    return out


def build_baskets(
    df: DataFrame,
    columns: Sequence[str],
    text_column: str | None = None,
    max_categories: int = 20,
    pattern: str = CODES,
    keep: Sequence[str] = (),
    sep: str = "_",
) -> DataFrame:
    """``(*keep, items)``: ``column_value`` items of frequent categories and code items.

    Where one column name starts with another and ``sep``, only a ``sep`` that no name holds
    (``SEP``) tells their items apart.

    Each row builds its own basket; a row without items keeps an empty one.
    """
    top = top_categories(df, columns, max_categories)
    codes = _codes(text_column, pattern) if text_column else None
    return df.select(*keep, F.array_distinct(_basket(top, codes, sep)).alias("items"))


def _basket(top: Mapping[str, Sequence[str]], codes: Column | None, sep: str) -> Column:
    """Items of frequent categories, then of codes."""
    items: list[Column] = []
    for c, values in top.items():
        v = F.col(f"`{c}`").cast("string")
        items.append(F.when(v.isin(values), F.concat(F.lit(f"{c}{sep}"), v)))
    basket = F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")
    if codes is not None:
        basket = F.concat(basket, F.transform(codes, lambda x: F.concat(F.lit(CODE_PREFIX), x)))
    return basket


def _codes(text_column: str, pattern: str) -> Column:
    """The codes of a text, none for NULL."""
    found = F.regexp_extract_all(F.col(text_column), F.lit(pattern), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))


def count_baskets(
    df: DataFrame,
    columns: Sequence[str],
    text_column: str | None = None,
    max_categories: int = 20,
    pattern: str = CODES,
    sep: str = "_",
) -> DataFrame:
    """``(items, rows)``: the baskets of ``build_baskets``, equal rows as one, and how many they are.

    ``df`` is read once: what follows reads one row per combination of values and codes, kept in
    the shared folder.
    """
    plain = [F.col(f"`{c}`").cast("string").alias(c) for c in columns]
    if text_column:
        plain.append(F.sort_array(F.array_distinct(_codes(text_column, pattern))).alias("__codes"))
    each = df.select(*plain)
    counts = each.groupBy(*[f"`{c}`" for c in each.columns]).agg(F.count(F.lit(1)).alias("__rows"))
    counts = kept_table(counts)
    top = top_categories(counts, columns, max_categories, "__rows")
    basket = _basket(top, F.col("__codes") if text_column else None, sep)
    return counts.select(F.array_distinct(basket).alias("items"), F.col("__rows").alias("rows"))


def one_hot(df: DataFrame, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """0/1 columns ``column_value`` for the values of a bounded domain."""
    new = {
        f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0))
        for c, values in columns.items()
        for v in values
    }
    return df.withColumns(new).drop(*columns)


def _starts(item: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [item.startswith(p) for p in prefixes])


def frequent_itemsets(
    baskets: DataFrame,
    min_support: float,
    prefixes: Sequence[str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """``(items, freq, n, support)`` with support of at least ``min_support``, items sorted.

    A basket counts once, or as often as its ``weight`` says; equal ones are one row from the start.
    """
    return itemsets_by_analysis(baskets, {"": (prefixes, min_support)}, weight).drop("analysis")


def itemsets_by_analysis(
    baskets: DataFrame,
    analyses: Mapping[str, tuple[Sequence[str] | None, float]],
    weight: str | None = None,
) -> DataFrame:
    """``(analysis, items, freq, n, support)``: the frequent itemsets of several analyses at once.

    Each analysis names the prefixes of its items (None: all) and its least support.  Itemsets grow
    by one item a round, from the rarest to the most frequent: each round holds, per analysis and
    itemset, what its baskets hold of more frequent items, equal remainders as one row.
    """
    rows = F.col(weight) if weight else F.lit(1)
    taken = [
        F.struct(
            F.lit(name).alias("analysis"),
            (F.filter("items", lambda i: _starts(i, p)) if p is not None else F.col("items")).alias("items"),
        )
        for name, (p, _) in analyses.items()
    ]
    chosen = baskets.select(rows.cast("long").alias("w"), F.inline(F.array(*taken)))
    counted = chosen.groupBy("analysis", F.array_distinct("items").alias("items")).agg(F.sum("w").alias("w"))
    counted = kept_table(counted)
    # Every analysis holds all baskets.
    n = counted.where(F.col("analysis") == next(iter(analyses))).agg(F.sum("w")).first()[0] or 0
    least = F.create_map(*[F.lit(v) for name, (_, support) in analyses.items() for v in (name, float(support))])

    def frequent(found: DataFrame, *key: str) -> DataFrame:
        freq = found.groupBy("analysis", *key).agg(F.sum("w").alias("freq"))
        return freq.where(F.col("freq") / F.lit(n) >= least[F.col("analysis")])

    each = counted.select("analysis", "items", "w", F.explode("items").alias("item"))
    ranked = each.join(frequent(each, "item"), ["analysis", "item"]).groupBy("analysis", "items", "w")
    rest = F.transform(F.array_sort(F.collect_list(F.struct("freq", "item"))), lambda x: x["item"])
    state = ranked.agg(rest.alias("rest")).select(
        "analysis", F.array().cast("array<string>").alias("head"), "rest", "w"
    )
    sets = None
    while True:
        state = kept_table(state.groupBy("analysis", "head", "rest").agg(F.sum("w").alias("w")))
        each = state.select("analysis", "head", F.explode("rest").alias("item"), "w")
        found = kept_table(frequent(each, "head", "item"))
        sets = found if sets is None else sets.union(found)
        if found.isEmpty():
            break
        longer = state.select("analysis", "head", "rest", "w", F.posexplode("rest").alias("at", "item"))
        longer = longer.where(F.col("at") < F.size("rest") - 1).join(found, ["analysis", "head", "item"])
        state = longer.select(
            "analysis",
            F.array_append("head", F.col("item")).alias("head"),
            F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"),
            "w",
        )
    return sets.select(
        "analysis", F.array_sort(F.array_append("head", F.col("item"))).alias("items"), "freq",
        F.lit(n).cast("long").alias("n"), (F.col("freq") / F.lit(n)).alias("support"),
    )


def association_rules(
    itemsets: DataFrame, metric: str = "lift", min_threshold: float = 1.0, by: Sequence[str] = ()
) -> DataFrame:
    """Every split of every frequent itemset into antecedents and consequents.

    Consequents grow by one item a round, each in the order of the items, so a split is made
    once.  Moving items to the consequents only raises the count of the antecedents: a split
    whose confidence is too low is grown no further, nor one whose lift cannot be reached by
    any consequent that holds the whole itemset's rows.  Each round is kept in the shared folder.
    The ``by`` columns come first in the result; itemsets that differ in them never meet.
    """
    sets = itemsets.where(F.size("items") > 1)
    most = sets.agg(F.max(F.size("items"))).first()[0] or 1
    ante = itemsets.select(*by, F.col("items").alias("antecedents"), F.col("freq").alias("freq_a"))
    cons = itemsets.select(*by, F.col("items").alias("consequents"), F.col("freq").alias("freq_c"))
    confidence = F.col("freq") / F.col("freq_a")
    can_grow = {"confidence": confidence, "lift": F.col("n") / F.col("freq_a") * (1 + 1e-12)}.get(metric)
    grown = sets.withColumn("consequents", F.array().cast("array<string>"))
    splits = None
    for done in range(max(most - 1, 1)):
        last = F.try_element_at("consequents", F.lit(-1))
        following = F.filter("items", lambda i: last.isNull() | (i > last))
        longer = grown.where(F.size("items") > done + 1).select(
            *by, "items", "freq", "n", "support", F.explode(following).alias("__i"), "consequents"
        )
        longer = longer.withColumn("consequents", F.array_append("consequents", F.col("__i"))).drop("__i")
        longer = longer.withColumn("antecedents", F.array_except("items", "consequents"))
        grown = longer.join(ante, [*by, "antecedents"])
        if can_grow is not None:
            grown = grown.where(can_grow >= min_threshold)
        grown = kept_table(
            grown.select(*by, "items", "freq", "n", "support", "antecedents", "consequents", "freq_a")
        )
        splits = grown if splits is None else splits.union(grown)
        if grown.isEmpty():
            break
    # Counts first, one division: no rounding in between.
    lift = (F.col("freq") * F.col("n")) / (F.col("freq_a") * F.col("freq_c"))
    rules = splits.join(cons, [*by, "consequents"]).select(
        *by, "antecedents", "consequents", "support", confidence.alias("confidence"), lift.alias("lift")
    )
    return rules.where(F.col(metric) >= min_threshold)


def rules_between(
    baskets: DataFrame,
    antecedent_prefix: str,
    consequent_prefix: str,
    min_support: float = 0.01,
    metric: str = "confidence",
    min_threshold: float = 0.5,
    weight: str | None = None,
) -> DataFrame:
    """Rules from items of one prefix to items of another; neither may start another's prefix."""
    both = [antecedent_prefix, consequent_prefix]
    rules = association_rules(
        frequent_itemsets(baskets, min_support, both, weight).persist(), metric, min_threshold
    )
    return _between(rules, antecedent_prefix, consequent_prefix)


def _between(rules: DataFrame, antecedent_prefix: str, consequent_prefix: str) -> DataFrame:
    return rules.where(
        F.forall("antecedents", lambda i: i.startswith(antecedent_prefix))
        & F.forall("consequents", lambda i: i.startswith(consequent_prefix))
    )


def format_rules(rules: DataFrame, metric: str = "lift", k: int = 10) -> DataFrame:
    """The ``k`` best rules as text."""
    a, c = F.array_join("antecedents", ", "), F.array_join("consequents", ", ")
    shown = F.format_string(
        "%s => %s (support: %.3f, confidence: %.3f, lift: %.3f)",
        a, c, "support", "confidence", "lift",
    )
    top = rules.orderBy(F.desc(metric), "antecedents", "consequents").limit(k)
    return top.select(shown.alias("rule"), metric)


def mine_rules(
    df: DataFrame,
    columns: Sequence[str],
    text_column: str | None = None,
    analysis: str | None = None,
) -> dict[str, DataFrame]:
    """The three standard analyses by name: codes, categories, category to codes.

    One analysis alone takes the items it asks for: codes need no categories, and the other way round.
    """
    families = [c for c in columns if c != text_column] if analysis != "violations" else []
    baskets = count_baskets(df, families, text_column if analysis != "categories" else None, sep=SEP)
    lift: dict[str, tuple[Sequence[str], float]] = {}
    between: dict[str, tuple[Sequence[str], float]] = {}
    if analysis in (None, "violations") and text_column:
        lift["violations"] = [CODE_PREFIX], 0.1
    if analysis in (None, "categories") and columns:
        lift["categories"] = [f"{c}{SEP}" for c in columns], 0.05
    if analysis in (None, "category_violations") and text_column:
        between = {f"{c}_to_violations": ([f"{c}{SEP}", CODE_PREFIX], 0.02) for c in columns}
    if not lift and not between:
        return {}
    # Together: as many rounds as the analysis with the longest itemset takes, not the sum of all.
    sets = itemsets_by_analysis(baskets, lift | between, "rows").persist()
    out: dict[str, DataFrame] = {}
    for asked, metric, least in ((lift, "lift", 1.0), (between, "confidence", 0.05)):
        if asked:
            rules = association_rules(sets.where(F.col("analysis").isin(*asked)), metric, least, ["analysis"])
            out |= {name: rules.where(F.col("analysis") == name).drop("analysis") for name in asked}
    out |= {name: _between(out[name], *prefixes) for name, (prefixes, _) in between.items()}
    return {name: _named(rules) for name, rules in out.items()}


def _named(rules: DataFrame) -> DataFrame:
    """Items written ``column_value``."""
    plain = {
        side: F.transform(side, lambda i: F.replace(i, F.lit(SEP), F.lit("_")))
        for side in ("antecedents", "consequents")
    }
    return rules.withColumns(plain)


def rule_edges(rules: DataFrame, agg: str = "sum") -> DataFrame:
    """Edges item -> item weighted by summed lift, or by the lift of the weakest rule.

    ``agg='last'`` keeps what remains when rules are drawn from the strongest down.
    """
    each = rules.select(
        F.explode("antecedents").alias("source"), "consequents", "lift"
    ).select("source", F.explode("consequents").alias("target"), "lift")
    weight = F.sum("lift") if agg == "sum" else F.min("lift")
    return each.groupBy("source", "target").agg(weight.alias("weight"))


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
