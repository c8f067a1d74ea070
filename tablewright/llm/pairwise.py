"""A quality score learned by pairwise ranking (Bradley-Terry).

A text of label 1 is preferred to one of label 0.  The chance that x beats y is
sigmoid(w . (f(x) - f(y))); the weights minimise the logistic loss over feature differences.
The score of a text is w . f(x), moved so that the quantile of the labelled scores which
leaves the labelled share of label 0 below it comes to the limit, and squeezed to 0..1.

Every labelled row counts: rows are dealt to blocks, a Newton step adds up what the pairs of each
block say, and the quantile is found among all scores.  Sums are decimals, so their order is all one.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.llm.common import col, fresh, table, whole, written

FEATURES = (
    "symbols_per_word", "exclamations_per_word", "capitals_share", "bars_per_word", "digits_share",
    "distinct_words", "stutter", "top_word", "chars_per_word", "dup_lines", "lower_lines", "stops_per_word",
)
#: Rows of the more frequent label in a block, about, and the fewest of the other that it should have.
BLOCK = 1024
SHARED = 32
#: Pairs that each row takes part in, about.
PAIRS = 8
HELD_OUT = 2
LIMIT = 0.7

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_CAPITALS = np.arange(ord("A"), ord("Z") + 1)
_DIGITS = np.arange(ord("0"), ord("9") + 1)


def featurise(text: str) -> list[float]:
    """Numbers of a text that do not grow with its length; all 0 for one without a word."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    signs = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = sum(map(len, words))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    bounded = lambda x: x / (1 + x)
    # A text of few words has few chances to repeat one: compare with 100 words at a time.
    parts = [words[i : i + 100] for i in range(0, n, 100)]
    distinct = sum(len(set(p)) for p in parts) / n
    return [
        bounded(signs[_SYMBOLS].sum() / n),
        bounded(signs[33] / n),
        signs[_CAPITALS].sum() / chars,
        bounded(signs[124] / n),
        signs[_DIGITS].sum() / chars,
        distinct,
        sum(map(eq, words, words[1:])) / n,
        sum(Counter(p).most_common(1)[0][1] for p in parts if len(p) > 20) / n,
        bounded(chars / n / 5),
        1 - len(set(lines)) / len(lines),
        sum(x[:1].islower() for x in lines) / len(lines),
        bounded(signs[46] / n),
    ]


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    offset: float

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.clip(features @ np.array(self.weights) + self.offset, -30, 30)
        return 1 / (1 + np.exp(-x))


def pairs(good: np.ndarray, bad: np.ndarray, seed: int) -> np.ndarray:
    """Feature differences of preferred and other rows of a block."""
    if not len(good) or not len(bad):
        return np.zeros((0, len(FEATURES)))
    rng = np.random.RandomState(seed % (1 << 32))
    n = PAIRS * max(len(good), len(bad))
    # Every row takes part; partners are dealt by permutations.
    i = np.concatenate([rng.permutation(len(good)) for _ in range(-(-n // len(good)))])[:n]
    j = np.concatenate([rng.permutation(len(bad)) for _ in range(-(-n // len(bad)))])[:n]
    return good[i] - bad[j]


def total(values: Column) -> Column:
    """A sum that does not depend on the order of the rows."""
    return F.sum(values.cast("decimal(38,15)"))


def dealt(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """``(block, good, bad)``: the features of each block's rows, flat, by id.

    Where the rarer label has too few rows for all blocks, each of them goes to several.
    """
    blocks = math.ceil(max(good, bad) / BLOCK)
    copies = min(blocks, math.ceil(blocks * SHARED / min(good, bad)))
    rarer = F.col("label") == (1 if good < bad else 0)
    last = F.when(rarer, copies - 1).otherwise(0)
    first = F.pmod(F.xxhash64("id"), F.lit(blocks))
    placed = rows.select("*", F.explode(F.transform(F.sequence(F.lit(0), last), lambda k: F.pmod(first + k, F.lit(blocks)))).alias("block"))

    def of(label: int) -> Column:
        held = F.collect_list(F.when(F.col("label") == label, F.struct("id", "features")))
        return F.flatten(F.transform(F.sort_array(held), lambda r: r["features"]))

    return placed.groupBy("block").agg(of(1).alias("good"), of(0).alias("bad"))


def fit_pairs(blocks: DataFrame, scale: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of least logistic loss over the pairs of all blocks, by Newton steps: one job each."""
    k = len(FEATURES)
    upper = np.triu_indices(k)
    size = 1 + k + len(upper[0])
    w = np.zeros(k)
    for _ in range(50):
        at = w.copy()

        @F.pandas_udf("array<double>")
        def sums(block: pd.Series, good: pd.Series, bad: pd.Series) -> pd.Series:
            out = []
            for number, x, y in zip(block, good, bad):
                d = pairs(np.reshape(x, (-1, k)) / scale, np.reshape(y, (-1, k)) / scale, int(number))
                p = 1 / (1 + np.exp(np.clip(d @ at, -30, 30)))
                curved = (d * (p * (1 - p))[:, None]).T @ d
                out.append(np.concatenate([[len(d)], d.T @ p, curved[upper]]))
            return pd.Series(out)

        each = blocks.select(sums("block", "good", "bad").alias("s"))
        found = np.array([float(v or 0) for v in each.agg(*[total(F.get("s", F.lit(i))).alias(str(i)) for i in range(size)]).first()])
        n, slope, curve = max(found[0], 1.0), found[1 : 1 + k], np.zeros((k, k))
        curve[upper] = found[1 + k :]
        curve = curve + np.triu(curve, 1).T
        step = np.linalg.solve(curve / n + ridge * np.eye(k), slope / n - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def edge(scores: DataFrame, good: int, bad: int, share_bad: float) -> float:
    """Of ``scores (label, s)`` the quantile that leaves ``share_bad`` below it; each label weighs as in all labelled rows.

    At the quantile of the share, or the widest gap within a thirtieth of it: equal scores are not
    parted.  Scores are put in order by ranges; the driver sees each range's sums.
    """
    n = [F.count_if(F.col("label") == label).alias(name) for label, name in ((1, "good"), (0, "bad"))]
    distinct = scores.groupBy("s").agg(*n).repartitionByRange("s")
    ranked = written(distinct.withColumn("part", F.spark_partition_id()), "ranked")
    parts = ranked.groupBy("part").agg(F.min("s").alias("first"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    known, before, rows = sorted(parts.collect(), key=lambda r: r["first"]), (0, 0), []
    for r, after in zip(known, [*known[1:], None]):
        rows.append((r["part"], *before, after and after["first"]))
        before = before[0] + r["good"], before[1] + r["bad"]
    table = ranked.sparkSession.createDataFrame(rows, "part int, good0 long, bad0 long, following double")
    order = W.partitionBy("part").orderBy("s")
    upto = (F.col("good0") + F.sum("good").over(order)) * ((1 - share_bad) / good) + (F.col("bad0") + F.sum("bad").over(order)) * (share_bad / bad)
    gap = F.coalesce(F.lead("s").over(order), "following", "s") - F.col("s")
    told = ranked.join(F.broadcast(table), "part").select("s", upto.alias("upto"), gap.alias("gap"))
    at, near = F.struct("s", "gap"), F.abs(F.col("upto") - share_bad) <= share_bad / 30
    found = told.agg(
        F.max_by(F.when(near, at), F.when(near, F.struct("gap", -F.col("s")))).alias("near"),
        F.min_by(at, F.when(F.col("upto") >= share_bad * (1 - 1e-9), F.col("s"))).alias("over"),
        F.max_by(at, "s").alias("last"),
    ).first()
    chosen = found["near"] or found["over"] or found["last"]
    return chosen["s"] + chosen["gap"] / 2


def fit(rows: DataFrame, share_bad: float) -> Model:
    """The model of all ``rows (id, label, features)``; ``share_bad``: label 0 among all labelled rows."""
    k = len(FEATURES)
    x = [F.get("features", F.lit(i)) for i in range(k)]
    found = rows.agg(
        F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0), *map(total, x), *[total(c * c) for c in x]
    ).first()
    good, bad = found[:2]
    if not good or not bad:  # nothing to compare: every text is as likely as the labels say
        p = min(max(1 - share_bad, 1e-3), 1 - 1e-3) if good + bad else 0.5
        return Model((0.0,) * k, math.log(p / (1 - p)))
    mean, square = (np.array(found[i : i + k], float) / (good + bad) for i in (2, 2 + k))
    scale = np.maximum(np.sqrt(np.maximum(square - mean * mean, 0)), 1e-6)
    w = fit_pairs(written(dealt(rows, good, bad), "blocks"), scale) / scale

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        return pd.Series((np.array(features.tolist(), float).reshape(-1, k) * w).sum(axis=1), dtype=float)

    return Model(tuple(w), math.log(LIMIT / (1 - LIMIT)) - edge(rows.select("label", score("features").alias("s")), good, bad, share_bad))


def held_out(key: Column) -> Column:
    """Whether a row's label may not be learned from."""
    return F.pmod(F.crc32(whole(key.cast("string")).cast("binary")), F.lit(4)) == HELD_OUT


def featured(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``(id, features)`` of every row's whole text (null: empty)."""

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([featurise(t) for t in texts], dtype=object)

    return docs.select(col(key).alias("id"), features(whole(col(text))).alias("features"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id") -> Model:
    """Fit on all labelled rows, none of them held out.  Features are joined to the labels, not texts."""
    known = labels.where(col(label).isNotNull() & col(key).isNotNull() & ~held_out(col(key)))
    known = known.groupBy(col(key).alias("id")).agg(F.max(col(label)).alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    # Of several texts of one id the least features count.
    found = featured(docs, text, key).join(known.where("label in (0, 1)"), "id")
    found = found.groupBy("id").agg(F.first("label").alias("label"), F.min("features").alias("features"))
    among = sum(counts.values())
    return fit(written(found, "labelled"), counts.get(0, 0) / among if among else 0.5)


def scored(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with ``out``, a score from 0 to 1 of every row's whole text (null: empty)."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        features = np.array([featurise(t) for t in texts], float).reshape(len(texts), len(FEATURES))
        return pd.Series(model.score(features), dtype=float)

    return docs.withColumn(out, score(whole(col(text))))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose score reaches the limit, with their columns."""
    (score,) = fresh(docs, "score")
    rated = scored(docs, train(docs, labels, text=text, key=key), score, text)
    return rated.where(col(score) >= LIMIT).select(*[col(c) for c in docs.columns])


def rate(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, held_out, score, predicted)``, one row per row of ``docs``.

    Null or empty text: the score of features that are all 0.  Without two labels to compare
    every score is the labelled share of label 1.  Repeated rows get equal scores.
    """
    rated = scored(docs.select(col(key).alias("id"), col(text).alias("text")), train(docs, labels, text=text, key=key))
    return rated.select(
        F.col("id").alias(key), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
