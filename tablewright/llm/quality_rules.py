"""Quality rules with thresholds learned per language and source, in DataFrame functions only.

Each text gets a few ratios.  Their distribution per (language, source) goes into a sketch of
logarithmic bins: counts that merge by addition, whatever the order, with a bounded relative
error.  Fences are taken from its quartiles; a group of few texts borrows the sketch merged
over its language, or over all.  The fences are joined back and texts outside them rejected.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.common import SPACE, col, let, table, whole, written

#: Ratio of a bin's edges: values are known to about one per cent.
GAMMA = 1.02
ZERO = -1_000_000
#: Texts that a group needs for fences of its own.
ENOUGH = 200
#: Quartile ranges beyond the quartile at which the fence stands.
REACH = 3.0
#: Per ratio: how it is made, the least range that counts, and if it has a lower fence too.
RATIOS = {
    "symbols_per_word": ("n_symbols / n_words", 0.1, False),
    "chars_per_word": ("word_chars / n_words", 0.45, True),
    "dup_lines_share": ("n_dup_lines / n_lines", 0.2, False),
    "repeat_share": ("n_repeat_words / n_words", 0.15, False),
}


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text, first included.

    Windows are sorted by hash (64 bits) and place; equal neighbours are the repeated ones, and
    the union of their three words is summed along their places.
    """
    n = F.size(words)

    def of_windows(found: Column) -> Column:
        def equal(a: Column, i: Column) -> Column:
            before, after = F.get(found, i - 1)["h"], F.get(found, i + 1)["h"]
            return F.coalesce(a["h"] == before, F.lit(False)) | F.coalesce(a["h"] == after, F.lit(False))

        places = F.sort_array(F.transform(F.filter(found, equal), lambda a: a["at"]))
        start = F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last"))
        return F.aggregate(
            places,
            start,
            lambda s, p: F.struct((s["sum"] + F.least(F.lit(3), p - s["last"])).alias("sum"), p.alias("last")),
            lambda s: s["sum"],
        )

    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at")),
    )
    return F.when(n >= 4, let(F.array_sort(windows), of_windows)).otherwise(0).cast("long")


def measured(df: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(key, lang, source)`` as ``(id, lang, source)`` and the counts of each text."""
    body = whole(col(text))

    def measures(parts: Column) -> Column:
        # Splitting leaves an empty string before leading and after trailing white space.
        head, tail = (F.get(parts, F.lit(0)) == "").cast("int"), (F.element_at(parts, -1) == "").cast("int")
        count = F.greatest(F.size(parts) - head - tail, F.lit(0))

        def of_words(w: Column) -> Column:
            return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))

        return let(F.slice(parts, head + 1, count), of_words)

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")
        )

    full = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m, lines = let(F.split(body, SPACE, -1), measures), let(full, of_lines)
    out = df.select(
        col(key).alias("id"),
        col(lang).alias("lang"),
        col(source).alias("source"),
        F.length(F.translate(body, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        m.alias("m"),
        lines.alias("l"),
    )
    return out.select("id", "lang", "source", "m.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "m.n_repeat_words", "l.n_lines")


def ratio(name: str) -> Column:
    """Null for a text without a word: it has no say in any fence."""
    return F.when(F.col("n_words") > 0, F.expr(RATIOS[name][0]))


def bin_of(value: Column) -> Column:
    return F.when(value > 0, F.floor(F.log(value) / math.log(GAMMA))).otherwise(ZERO).cast("long")


def sketches(texts: DataFrame) -> DataFrame:
    """``(lang, source, ratio, bin, n)``: the mergeable sketch of each group and ratio."""
    each = F.array(*[F.struct(F.lit(r).alias("ratio"), bin_of(ratio(r)).alias("bin")) for r in RATIOS])
    binned = texts.where("n_words > 0").select("lang", "source", F.explode(each).alias("x"))
    return binned.groupBy("lang", "source", "x.ratio", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, level: list[str]) -> DataFrame:
    """``(level..., ratio, total, q1, q3)`` of the sketch merged to ``level``."""
    merged = sketch.groupBy(*level, "ratio", "bin").agg(F.sum("n").alias("n"))
    along = W.partitionBy(*level, "ratio").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = merged.withColumn("upto", F.sum("n").over(along))  # as many rows as a sketch has bins
    middle = 2.0 / (GAMMA + 1)
    value = F.when(F.col("bin") == ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin") + 1) * middle)
    whole_group = W.partitionBy(*level, "ratio")
    placed = upto.withColumn("total", F.sum("n").over(whole_group)).withColumn("value", value)
    first = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("value")))
    return placed.groupBy(*level, "ratio").agg(
        F.max("total").alias("total"), first(0.25).alias("q1"), first(0.75).alias("q3")
    )


def fences(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): ``lo_<ratio>`` and ``hi_<ratio>``."""
    own = quartiles(sketch, ["lang", "source"])
    by_lang = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l"), F.col("ratio").alias("r"), F.struct("total", "q1", "q3").alias("of_lang"))
    overall = quartiles(sketch, []).select(F.col("ratio").alias("o"), F.struct("total", "q1", "q3").alias("of_all"))
    both = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("ratio") == F.col("r"))).join(overall, F.col("ratio") == F.col("o"))
    pick = lambda x: F.when(F.col("total") >= ENOUGH, F.col(x)).when(F.col("of_lang.total") >= ENOUGH, F.col(f"of_lang.{x}")).otherwise(F.col(f"of_all.{x}"))
    least = F.create_map(*[F.lit(x) for r in RATIOS for x in (r, RATIOS[r][1])])
    q1, q3 = pick("q1"), pick("q3")
    reach = F.greatest(q3 - q1, F.element_at(least, F.col("ratio"))) * REACH
    level = both.select("lang", "source", "ratio", (q1 - reach).alias("lo"), (q3 + reach).alias("hi"))
    at = lambda r, x: F.max(F.when(F.col("ratio") == r, F.col(x))).alias(f"{x}_{r}")
    return level.groupBy("lang", "source").agg(*[at(r, x) for r in RATIOS for x in ("lo", "hi")])


def apply_rules(df: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of each text, one row per row of ``df``.

    Base rule: under 50 words, or more than half of the words in repeated windows.  A text that
    passes it is kept if each ratio lies within the fences of its language and source; null is a
    language and a source like any other.  Null or empty text: no words, fails.  Repeated rows
    count each in the sketches.  Other columns are not read.
    """
    texts = written(measured(df, text, key, lang, source), "measures")
    limits = written(fences(sketches(texts)), "fences").withColumnsRenamed({"lang": "l", "source": "s"})
    joined = texts.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = [ratio(r) <= F.col(f"hi_{r}") for r in RATIOS] + [ratio(r) >= F.col(f"lo_{r}") for r in RATIOS if RATIOS[r][2]]
    return joined.select(
        F.col("id").alias(key),
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        failed.alias("base_failed"),
        (~failed & F.coalesce(reduce(lambda a, b: a & b, inside), F.lit(False))).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    bins = " union all ".join(f"select lang, source, '{r}' as ratio, {RATIOS[r][0]} as v from t where n_words > 0" for r in RATIOS)

    def quart(level: str) -> str:
        part = f"partition by {level} ratio" if level else "partition by ratio"
        value = f"case when bin = {ZERO} then 0.0 else pow({GAMMA}, bin + 1) * {2.0 / (GAMMA + 1)!r} end"
        return f"""select {level} ratio, max(total) as total, min(case when upto >= 0.25 * total then v end) as q1,
            min(case when upto >= 0.75 * total then v end) as q3 from (
            select {level} ratio, sum(n) over ({part} order by bin) as upto, sum(n) over ({part}) as total, {value} as v
            from (select {level} ratio, bin, sum(n) as n from sk group by all)) group by all"""

    pick = lambda x: f"case when o.total >= {ENOUGH} then o.{x} when l.total >= {ENOUGH} then l.{x} else a.{x} end"
    least = "case o.ratio " + " ".join(f"when '{r}' then {RATIOS[r][1]}" for r in RATIOS) + " end"
    inside = " and ".join(
        [f"{RATIOS[r][0]} <= max(case when f.ratio = '{r}' then f.hi end)" for r in RATIOS]
        + [f"{RATIOS[r][0]} >= max(case when f.ratio = '{r}' then f.lo end)" for r in RATIOS if RATIOS[r][2]]
    )
    return rf"""
    with d as materialized (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as x from documents),
    w as (select rid, doc_id, lang, source, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as ws,
        list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) as ls from d),
    p as (select rid, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as a from w),
    g as (select rid, i, a || ' ' || lead(a, 1) over (partition by rid order by i)
        || ' ' || lead(a, 2) over (partition by rid order by i) as gram from p),
    c as (select rid, i, count(*) over (partition by rid, gram) as k from g where gram is not null),
    r as (select rid, count(distinct j) as n from (select rid, unnest([i, i + 1, i + 2]) as j from c where k > 1) group by 1),
    t as (select w.rid, doc_id, lang, source, cast(len(ws) as bigint) as n_words,
        cast(coalesce(list_sum(list_transform(ws, lambda y: length(y))), 0) as bigint) as word_chars,
        cast(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
        cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(r.n, 0) as bigint) as n_repeat_words,
        cast(len(ls) as bigint) as n_lines from w left join r using (rid)),
    sk as (select lang, source, ratio, cast(case when v > 0 then floor(ln(v) / {math.log(GAMMA)!r}) else {ZERO} end as bigint) as bin,
        count(*) as n from ({bins}) group by all),
    f as (select o.lang, o.source, o.ratio, {pick("q1")} - {REACH} * greatest({pick("q3")} - {pick("q1")}, {least}) as lo,
        {pick("q3")} + {REACH} * greatest({pick("q3")} - {pick("q1")}, {least}) as hi
        from ({quart("lang, source,")}) o join ({quart("lang,")}) l on o.lang is not distinct from l.lang and o.ratio = l.ratio
        join ({quart("")}) a on o.ratio = a.ratio),
    b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from t)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        not base_failed and coalesce({inside}, false) as kept
    from b left join f on b.lang is not distinct from f.lang and b.source is not distinct from f.source
    group by rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines"""


ORACLE = _oracle()
