"""Fingerprints by a randomised edit embedding.

All texts take the same random walk: at step j the character under the pointer is put out, and
a random bit of (j, character) says whether the pointer moves on.  Texts a few edits apart
fall into step again, so their walks differ in few steps: edit distance becomes Hamming
distance.  A fingerprint samples steps of the walk, a bit of the character put out at each.
The sampled steps are chosen the same way for all lengths: slot s looks at the step below the
walk's end whose random rank for s is lowest, so walks of like length sample like steps.
Equal bits over the slots estimate the likeness of two walks; bands of bits find candidates,
and the edit distance itself confirms them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablewright.llm.common import col, map_batches, table, whole, written
from tablewright.llm.near_dups import open_buckets, rooted

SLOTS = 256
#: Steps after which the random bits of the walk repeat; characters that share their bits.
PERIOD, CLASSES = 4096, 64
SEED = 20
#: Texts in one run of the order, about, and runs at most: a run is streamed, not held.
RUN, MOST_RUNS = 5_000, 4096


@lru_cache(maxsize=1)
def strides() -> list[list[int]]:
    """Per class of character and step (modulo the period): steps until the pointer has moved on."""
    moves = np.random.RandomState(SEED).randint(0, 2, (CLASSES, 2 * PERIOD)).astype(bool)
    moves[:, PERIOD:] = moves[:, :PERIOD]
    moves[:, PERIOD - 1] = moves[:, 2 * PERIOD - 1] = True
    out = np.zeros((CLASSES, 2 * PERIOD), np.int64)
    wait = np.full(CLASSES, 0)
    for j in range(2 * PERIOD - 1, -1, -1):
        wait = np.where(moves[:, j], 1, wait + 1)
        out[:, j] = wait
    return out[:, :PERIOD].tolist()


def hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def ladders() -> np.ndarray:
    """Per slot (row), ascending, the steps that have a lower rank than all before, up to 2^50.

    The next one after step j lies at j / u for a random u: each slot's sample is a uniform step
    of the walk, and stays the same until the walk is long enough to reach the next.
    """
    rng = np.random.RandomState(SEED + 1)
    out = []
    for _ in range(SLOTS):
        steps = [0]
        while steps[-1] < 1 << 50:
            steps.append(int((steps[-1] + 1) / max(rng.random_sample(), 1e-9)))
        out.append(steps)
    longest = max(map(len, out))
    return np.array([x + [1 << 60] * (longest - len(x)) for x in out])


class Walk:
    """The steps at which the pointer leaves each character; can be left and taken up again."""

    def __init__(self):
        self.step = 0
        self.leaves: list[int] = []
        self.codes: list[np.ndarray] = []

    def copy_at(self, chars: int) -> Walk:
        other = Walk()
        other.leaves = self.leaves[:chars]
        other.step = other.leaves[-1] if other.leaves else 0
        other.codes = [np.concatenate(self.codes)[:chars]] if self.codes else []
        return other

    def take(self, text: str) -> Walk:
        # The walk goes over code points; their class gives the bits, themselves the output.
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        table_, step, mask = strides(), self.step, PERIOD - 1
        put = self.leaves.append
        for c in ((codes * np.uint32(0x9E3779B1)) >> np.uint32(26)).tolist():
            step += table_[c][step & mask]
            put(step)
        self.step = step
        self.codes.append(codes)
        return self

    def fingerprint(self) -> str:
        """The sampled bits, as hexadecimal digits; all 0 for an empty text."""
        if not self.step:
            return "0" * (SLOTS // 4)
        steps = ladders()
        at = steps[np.arange(SLOTS), (steps < self.step).sum(axis=1) - 1]
        char = np.concatenate(self.codes)[np.searchsorted(np.array(self.leaves), at, side="right")]
        slots = np.arange(SLOTS, dtype=np.uint64)
        mix = hashed(hashed(char.astype(np.uint64) + (slots << np.uint64(32))) ^ at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.packbits((mix & np.uint64(1)).astype(np.uint8)).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Share of like steps estimated from equal bits: 1 for equal prints, 0 for chance or less."""
    apart = (int(a, 16) ^ int(b, 16)).bit_count()
    return max(0.0, 1.0 - 2.0 * apart / SLOTS)


def place(key: Column, edges: list) -> Column:
    """How many of the descending ``edges`` lie above the key, by bisection; all for null."""
    if not edges:
        return F.lit(0)
    top = F.array(*[F.lit(c) for c in edges])
    halves = F.array(*[F.lit(1 << k) for k in range(len(edges).bit_length() - 1, -1, -1)])
    found = F.aggregate(
        halves,
        F.lit(0),
        lambda at, half: at + F.when((at + half <= len(edges)) & (key < F.get(top, at + half - 1)), half).otherwise(0),
    )
    return F.when(key.isNull(), len(edges)).otherwise(found)


def in_order(texts: DataFrame) -> DataFrame:
    """``texts (id, text)`` dealt over ``run``s of descending id, each led on by the next run's first.

    Columns ``run``, ``mark`` (1: only there as the next of the last row), ``tie``.  Runs are cut at
    quantiles of the ids, which evens them for distinct ids and changes no result.  The first of
    all follows the last.  Null ids come last; equal ids are ordered by a digest of the text.
    """
    stats = texts.agg(F.count(F.lit(1)).alias("n")).first()
    n_runs = min(max(1, -(-stats["n"] // RUN)), MOST_RUNS)
    share = [i / n_runs for i in range(1, n_runs)]
    cuts = texts.agg(F.percentile_approx("id", share, 10 * n_runs).alias("c")).first()["c"] if share else []
    dealt = texts.withColumns(
        {"tie": F.sha2(F.col("text").cast("binary"), 256), "run": place(F.col("id"), sorted(set(cuts or []), reverse=True))}
    )
    order = F.struct(F.col("id").isNull().alias("none"), (-F.col("id")).alias("neg"), "tie")
    heads = dealt.groupBy("run").agg(F.min(order).alias("head"))  # one row per run: MOST_RUNS at most
    before = F.lag("run").over(W.orderBy("run"))
    heads = heads.select("run", "head", F.coalesce(before, F.max("run").over(W.partitionBy())).alias("before"))
    led = dealt.join(F.broadcast(heads), "run")
    own, copy = F.struct("run", F.lit(0).alias("mark")), F.struct(F.col("before").alias("run"), F.lit(1).alias("mark"))
    is_head = F.col("head").eqNullSafe(order)
    places = F.when(is_head, F.array(own, copy)).otherwise(F.array(own))
    return led.select("id", "text", "tie", F.explode(places).alias("x")).select("id", "text", "tie", "x.run", "x.mark")


def prints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, fingerprint)`` of every row; equal texts have equal fingerprints."""

    def rows(batch):
        for i, t in zip(batch["id"], batch["text"]):
            yield i, Walk().take(t).fingerprint()

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("fingerprint", T.StringType())])
    return map_batches(df.select(col(key).alias("id"), whole(col(text)).alias("text")), schema, rows)


def with_edits(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The edited text: the last third of the code points replaced by as many of the next row's
    first, in descending order of the key.  One row per row of ``df``.  Null text: empty.  Null
    keys come last, equal ones by a digest of the text; a single row is its own next.  Other
    columns are not read.
    """
    texts = df.select(col(key).alias("id"), whole(col(text)).alias("text"))
    ordered = in_order(texts)
    dealt = ordered.repartition("run").sortWithinPartitions("run", "mark", F.col("id").desc_nulls_last(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # run, id, text, walk, print of the row before, of its run
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for row in batch.slice(at, 256).to_pylist():
                    walk = Walk().take(row["text"])
                    here = row["run"], row["id"], row["text"], walk, walk.fingerprint()
                    if last is not None and last[0] == row["run"]:
                        out.append(compared(last, here))
                    last = None if row["mark"] else here
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_chars", T.LongType())])
    for name in ("edited_sha256", "fingerprint", "edited_fingerprint"):
        schema = schema.add(name, T.StringType())
    schema = schema.add("near_edited", T.DoubleType()).add("near_next", T.DoubleType())
    arrow = to_arrow_schema(schema)

    def compared(this: tuple, following: tuple) -> dict:
        _, i, body, walk, print_ = this
        third = len(body) // 3
        head, tail = body[: len(body) - third], following[2][:third]
        edited = walk.copy_at(len(head)).take(tail).fingerprint()
        digest = hashlib.sha256((head + tail).encode()).hexdigest()
        row = i, len(body), digest, print_, edited, likeness(print_, edited), likeness(print_, following[4])
        return dict(zip(arrow.names, row))

    return dealt.mapInArrow(run, schema)


def band_bits(bands: int, bits: int) -> list[list[int]]:
    """The bits of a fingerprint that each band samples."""
    rng = np.random.RandomState(SEED + 2)
    return [sorted(rng.choice(SLOTS, bits, replace=False).tolist()) for _ in range(bands)]


def buckets(texts: DataFrame, bands: int, bits: int, edits: int, walks: int) -> DataFrame:
    """``(node, n, bucket)`` of ``texts (node, text)``: a row or two per walk and band of its fingerprint.

    Each walk takes a prefix of its own, which sets it to other random bits from there on.  Texts
    whose lengths differ by more than ``edits`` cannot be linked: a bucket holds a cell of lengths,
    and a text stands in its own and, near the end of it, in the next.
    """
    sampled, value = np.array(band_bits(bands, bits)), 1 << np.arange(bits, dtype=object)
    cell, prime = 4 * (edits + 1), (1 << 61) - 1  # keys that clash add candidates only

    def rows(batch):
        for node, t in zip(batch["node"], batch["text"]):
            keys = []
            for w in range(walks):
                print_ = Walk().take("\0" * (5 * w) + t).fingerprint()
                all_bits = np.unpackbits(np.frombuffer(bytes.fromhex(print_), np.uint8)).astype(object)
                keys += [(v * walks + w) * bands + i for i, v in enumerate(all_bits[sampled] @ value)]
            cells = sorted({len(t) // cell, (len(t) + edits) // cell})
            yield node, len(t), [int((c * (bands * walks << bits) + k) % prime) for c in cells for k in keys]

    schema = T.StructType([T.StructField("node", T.StringType()), T.StructField("n", T.LongType())])
    schema = schema.add("keys", T.ArrayType(T.LongType()))
    return map_batches(texts, schema, rows).select("node", "n", F.explode("keys").alias("bucket"))


def near_texts(
    df: DataFrame, text: str = "text", key: str = "doc_id", edits: int = 20, bands: int = 48, bits: int = 14, rounds: int = 2, walks: int = 4
) -> DataFrame:
    """``(key, component_id)``: texts that chains of at most ``edits`` edits each connect.

    Texts that agree in all bits of a band, in one of the walks, are candidates; the edit distance confirms each link.
    In every bucket a centre is tested first, then what is still apart, so no pairs are formed
    inside a group that is one already.  Fingerprints of texts a few edits apart may still differ
    in every band: a share of links is missed, fewer with more walks, or more bands of fewer bits.  Equal texts
    are one node; null is empty; null keys are passed over by the minimum.
    """
    body = whole(col(text))
    rows_in = df.select(col(key).alias("id"), F.sha2(body.cast("binary"), 256).alias("node"), body.alias("text"))
    texts = rows_in.groupBy("node").agg(F.first("text").alias("text"))
    members = written(buckets(texts, bands, bits, edits, walks), "bits").withColumn("root", F.col("node"))
    members = open_buckets(members).select("bucket", "node", "n")
    x, y = (texts.select(F.col("node").alias(n), F.col("text").alias(t)) for n, t in (("a", "x"), ("b", "y")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        distance = F.levenshtein("x", "y", edits)  # -1 beyond the bound, found without the whole table
        return pairs.join(x, "a").join(y, "b").where(distance >= 0).select("a", "b")

    apart = (F.col("root") != F.col("other_root")) & (F.abs(F.col("n") - F.col("m")) <= edits)
    partner = ["bucket", F.col("node").alias("other"), F.col("n").alias("m"), F.col("root").alias("other_root")]
    pair = F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
    found = None
    for r in range(rounds + 1):
        waiting = written(open_buckets(rooted(members, found)), "waiting")
        if r < rounds:
            order = F.struct(F.xxhash64(F.lit(r), "node"), "node")
            left, right = waiting, waiting.groupBy("bucket").agg(F.max_by(F.struct("node", "n", "root"), order).alias("c"))
            right = right.select("bucket", "c.*").select(*partner)
        else:
            parts = waiting.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
            main = parts.groupBy("bucket").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
            left, right = waiting.join(main, "bucket").where("root <> main"), waiting.select(*partner)
        new = confirmed(left.join(right, "bucket").where(apart).select(*pair).distinct())
        found = written(new if found is None else found.union(new), "edit-links")
    nodes = rooted(rows_in.select("node").distinct(), found)
    named = rows_in.select("id", "node").join(nodes, "node")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return named.join(least, "root").select(F.col("id").alias(key), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))


def links_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(table(spark, sf_dir, "documents"))
