"""Mixing sources to target weights in fixed-length blocks.

The words of a source, document after document, are cut into blocks of a fixed length.  Each
output shard draws its number of blocks per source from a multinomial distribution over what
the targets still ask for, so that the shards together meet them.  The slots of a source are
mapped to blocks by a pseudorandom permutation of its block numbers: a pass over the
permutation takes every block once.  Slots and blocks are joined by block number.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import WORD, col, table, whole, written

BLOCK = 128
SHARDS = 64
#: Weights of the sources in their order, repeating; words of the mix per word of
#: the corpus; times that a source is used at most.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
TIMES = 2
#: Rows of a source in one sorted run; slots made from one row.
RUN = 20_000
MANY = 50_000


def target_words(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, share: float = SHARE, times: int = TIMES) -> list[float]:
    """Words asked of each source: by weight, ``times`` its size at most, the excess shared anew."""
    caps = [float(times * s) for s in sizes]
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_ = caps[:], list(range(len(sizes)))
    rest = share * sum(sizes)
    while open_:
        per = rest / sum(weight[i] for i in open_)
        over = [i for i in open_ if per * weight[i] > caps[i]]
        if not over:
            for i in open_:
                out[i] = per * weight[i]
            break
        rest -= sum(caps[i] for i in over)
        open_ = [i for i in open_ if per * weight[i] <= caps[i]]
    return out


def draw_counts(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (column) in each shard (row); columns add up to ``slots``."""
    left, out = slots.astype(np.int64).copy(), np.zeros((shards, len(slots)), np.int64)
    for m in range(shards):
        rng = np.random.default_rng((seed, m))
        need = -(-int(left.sum()) // (shards - m))
        while need:
            drawn = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[m] += drawn
            left -= drawn
            need -= int(drawn.sum())
    return out


def permuted(slot: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, one per key: a Feistel network walked into range."""
    half = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    x, n = slot.astype(np.uint64), n.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> half[todo], x[todo] & low[todo]
        for r in range(rounds):
            f = (right + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ key[todo].astype(np.uint64)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & low[todo])
        x[todo] = (left << half[todo]) | right
        todo[todo] = x[todo] >= n[todo]
    return x.astype(np.int64)


def sources_of(docs: DataFrame, block: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(source, no, source_size, target, salts)`` and the draws ``(no, shard, first, n, ...)``.

    One row per source on the driver, and one per source and shard: neither grows with the rows.
    """
    spark = docs.sparkSession
    found = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    targets = target_words(sizes)
    table_ = [(r["source"], i, s, t, max(1, -(-r["rows"] // RUN))) for i, (r, s, t) in enumerate(zip(found, sizes, targets))]
    schema = T.StructType([T.StructField("source", docs.schema["source"].dataType)])
    for name, kind in (("no", T.IntegerType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("salts", T.IntegerType())):
        schema = schema.add(name, kind)
    named = spark.createDataFrame(table_, schema)

    words = np.array([min(round(t), TIMES * s) for s, t in zip(sizes, targets)], np.int64)
    blocks = np.array([-(-s // block) for s in sizes], np.int64)
    passes = np.array([w // s if s else 0 for w, s in zip(words, sizes)], np.int64)
    rest = np.array([w % s if s else 0 for w, s in zip(words, sizes)], np.int64)
    slots = passes * blocks + -(-rest // block)
    counts = draw_counts(slots, shards, seed) if len(slots) and slots.sum() else np.zeros((0, len(slots)), np.int64)
    firsts = np.cumsum(counts, axis=0) - counts
    # The last slot of a source takes only the words that are still asked for.
    cut = [int(r - (-(-r // block) - 1) * block) if r else block for r in rest]
    rows = [
        (i, m, int(firsts[m, i]), int(counts[m, i]), int(blocks[i]), int(slots[i]) - 1, cut[i])
        for m in range(len(counts))
        for i in range(len(slots))
        if counts[m, i]
    ]
    draws = spark.createDataFrame(rows, "no int, shard int, first long, n long, blocks long, last long, cut int")
    return named, draws


def slot_blocks(draws: DataFrame, block: int, seed: int) -> DataFrame:
    """``(no, shard, slot, block, words)``: the block that each slot of the mix takes, and how much."""

    @F.pandas_udf("long")
    def block_of(slot: pd.Series, n: pd.Series, no: pd.Series) -> pd.Series:
        at = slot.to_numpy() % n.to_numpy()
        return pd.Series(permuted(at, n.to_numpy(), no.to_numpy() * 7919 + seed))

    starts = F.sequence(F.col("first"), F.col("first") + F.col("n") - 1, F.lit(MANY).cast("long"))
    runs = draws.withColumn("from", F.explode(starts)).withColumn(
        "to", F.least(F.col("from") + MANY, F.col("first") + F.col("n")) - 1
    )
    slots = runs.repartition(F.col("no"), F.col("from")).withColumn("slot", F.explode(F.sequence("from", "to")))
    words = F.when(F.col("slot") == F.col("last"), F.col("cut")).otherwise(block)
    return slots.select("no", "shard", "slot", block_of("slot", "blocks", "no").alias("block"), words.alias("words"))


def placed(docs: DataFrame, named: DataFrame) -> DataFrame:
    """``docs`` with ``no``, ``source_size``, ``target`` and ``start``: words of its source before it.

    Sources of many rows are dealt over salted runs, summed first and then within.
    """
    dealt = docs.join(named.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("id", "digest"), F.col("salts")))
    runs = dealt.groupBy("no", "salt").agg(F.sum("size").alias("words"))
    upto = W.partitionBy("no").orderBy("salt").rowsBetween(W.unboundedPreceding, W.currentRow)
    runs = runs.select("no", "salt", (F.sum("words").over(upto) - F.col("words")).alias("base"))
    within = W.partitionBy("no", "salt").orderBy("id", "digest").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        dealt.withColumn("within", F.sum("size").over(within) - F.col("size"))
        .join(runs, ["no", "salt"])
        .withColumn("start", F.col("base") + F.col("within"))
        .drop("salt", "salts", "within", "base")
    )


def takes(docs: DataFrame, draws: DataFrame, block: int, seed: int) -> DataFrame:
    """``(no, start, lo, hi)``: each run of words, counted in its document, that a slot takes."""
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = docs.where("size > 0").select("no", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    # Made from few rows, the slots look small to the planner: never to be broadcast.
    slots = slot_blocks(draws, block, seed).select("no", "block", "words").hint("merge")
    lo = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    hi = F.least(F.col("block") * block + F.col("words") - F.col("start"), F.col("size"))
    return pieces.join(slots, ["no", "block"]).select("no", "start", lo.alias("lo"), hi.alias("hi")).where("hi > lo")


def sized(df: DataFrame, text: str, key: str, source: str) -> DataFrame:
    body = whole(col(text))
    return df.select(
        col(key).alias("id"), col(source).alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(body).alias("digest")
    )


def mix_counts(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", block: int = BLOCK, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """``(key, size, source_size, target, taken)``, one row per row of ``df``.

    Size: words of the text, none for null.  A source takes its target to the word, less at most
    what its last block is short of; no document is taken more than twice.  Null is a source like
    any other, in the last place.  Repeated rows are documents of their own.  The seed decides.
    """
    docs = written(sized(df, text, key, source), "sizes")
    named, draws = sources_of(docs, block, shards, seed)
    docs = written(placed(docs, named), "places")
    taken = takes(docs, draws, block, seed).groupBy("no", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    full = docs.where("size > 0").join(taken, ["no", "start"], "left")
    empty = docs.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    return full.unionByName(empty).select(
        F.col("id").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def cut_words(text: str, runs: list[tuple[int, int]]) -> list[str]:
    """The first and the second copy that the runs make of a text: words in one run or more, in two."""
    ends: dict[int, int] = {}
    for lo, hi in runs:
        ends[lo] = ends.get(lo, 0) + 1
        ends[hi] = ends.get(hi, 0) - 1
    words = [m.span() for m in re.finditer(WORD, text)]
    copies: list[list[str]] = [[] for _ in range(TIMES)]
    level, at = 0, sorted(ends)
    opened = [0] * TIMES
    for edge in at:
        new = level + ends[edge]
        for c in range(TIMES):
            if level <= c < new:
                opened[c] = edge
            elif new <= c < level:
                whole_text = opened[c] == 0 and edge == len(words)
                copies[c].append(text if whole_text else text[words[opened[c]][0] : words[edge - 1][1]])
        level = new
    return ["\n".join(c) for c in copies if c]


def mix(df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", chars: str = "n_chars", block: int = BLOCK, shards: int = SHARDS, seed: int = 11) -> DataFrame:
    """The mix as rows of ``df``: a document whose words are taken comes with the words taken, a
    second time with those taken twice; ``chars``, if there, is counted anew.

    Runs of words that were apart are joined by a line break.  Documents of which no word is
    taken, and those without words, are not in the mix.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    docs = written(sized(df, text, key, source), "sizes")
    named, draws = sources_of(docs, block, shards, seed)
    docs = written(placed(docs, named), "places")
    runs = takes(docs, draws, block, seed).groupBy("no", "start").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    # A row is told by its key, source and text; equal rows stand side by side in the order of
    # their source, and the n-th of them gets the n-th place.
    row, same = F.xxhash64(F.struct("id", "source")), W.partitionBy("row", "digest")
    chosen = docs.where("size > 0").withColumn("row", row).withColumn("nth", F.row_number().over(same.orderBy("start")))
    chosen = chosen.select("row", "digest", "nth", "no", "start").join(runs, ["no", "start"])
    body = whole(col(text))
    full = df.select(
        *[col(c).alias(n) for c, n in names.items()], col(key).alias("id"), col(source).alias("source"), F.xxhash64(body).alias("digest")
    )
    full = full.withColumn("row", row).withColumn("nth", F.row_number().over(same.orderBy("id")))
    joined = full.join(chosen.select("row", "digest", "nth", "runs"), ["row", "digest", "nth"])

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def copies(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t, [(r["lo"], r["hi"]) for r in runs_]) for t, runs_ in zip(texts, lists)], dtype=object)

    made = joined.select(*names.values(), F.explode(copies(names[text], "runs")).alias("new"))
    new = {text: F.col("new")}
    if chars in names:
        new[chars] = F.length("new").cast(df.schema[chars].dataType)
    return made.select(*[new.get(c, F.col(n)).alias(c) for c, n in names.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))
