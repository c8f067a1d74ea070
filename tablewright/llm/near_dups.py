"""Near-duplicate groups by min-max hashing.

Each document is the set of its word shingles.  Under every permutation both the smallest and
the largest value are kept, so one evaluation gives two entries of the signature, each equal
in two sets with the probability of their similarity.  Bands of the signature make buckets.

Buckets are joined without forming all pairs of their members: texts with equal sets are one
node; each node is first tested against the one bucket centre it shares most buckets with, in
a few rounds with other centres, and links are closed into components.  What then is still
apart in a common bucket is tested pair by pair, but for the pairs inside the largest
component of the bucket and those whose common items are too few.  Every link is confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import col, fresh, map_batches, table, whole, written

#: Chance of missing a pair just at the threshold.
MISS = 1e-6
#: Nodes that have a rare item, at most.
RARE = 16
#: Columns of a node and of its partner in a pair.
PARTNER = {"node": "other", "n": "m", "most": "most2", "root": "other_root"}
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(9, 14)]] = True


def bands_for(percent: int, rows: int = 4, miss: float = MISS) -> int:
    """Bands of ``rows`` entries that miss a pair at the threshold with chance ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number over all of it."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of the text, its letters A-Z in lower case.

    A word is taken in blocks of eight bytes, each mixed with its place before they are added.
    """
    data = np.frombuffer(text.encode().lower() + bytes(8), np.uint8)
    edge = np.diff(np.concatenate([[True], IS_SPACE[data[:-8]], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    blocks = (end - start + 7) // 8
    first = np.cumsum(blocks) - blocks
    place = np.arange(blocks.sum()) - np.repeat(first, blocks)
    at = np.repeat(start, blocks) + 8 * place
    value = np.lib.stride_tricks.sliding_window_view(data, 8)[at].view("<u8").ravel()
    spare = np.maximum(8 - (np.repeat(end, blocks) - at), 0).astype(np.uint64)  # bytes behind the word
    value = (value << (spare * np.uint64(8))) >> (spare * np.uint64(8))
    terms = mixed(mixed(value) + BASE * (place.astype(np.uint64) + np.uint64(1)))
    return mixed(np.add.reduceat(terms, first) + (end - start).astype(np.uint64))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``width`` words; of all words if there are fewer."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = mixed(total * MIX[2] + words[i : i + n])
    return np.unique(total + np.uint64(width))


@lru_cache(maxsize=4)
def permutations(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(seed)
    pair = [rng.randint(0, 1 << 62, n).astype(np.uint64) for _ in range(2)]
    return (pair[0] * np.uint64(2) + np.uint64(1))[:, None], pair[1][:, None]


def band_keys(items: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys of a set: both extremes under each permutation, ``rows`` entries to a band."""
    a, b = permutations(-(-bands * rows // 2))
    low = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    high = np.zeros(len(a), np.uint64)
    for at in range(0, len(items), 4096):  # keeps the table of a long text in cache
        values = items[None, at : at + 4096] * a + b
        low, high = np.minimum(low, values.min(axis=1)), np.maximum(high, values.max(axis=1))
    entries = np.stack([low, high], axis=1).ravel()[: bands * rows].reshape(bands, rows)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        keys = mixed(keys * MIX[2] + entries[:, i])
    return keys.view(np.int64)


def located(df: DataFrame, text: str, key: str) -> DataFrame:
    """``(id, digest, text)``: a row is told by its id and a hash of its text."""
    t = whole(col(text))
    return df.select(col(key).alias("id"), F.xxhash64(t).alias("digest"), t.alias("text"))


def features(rows_in: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``(id, digest, node, n_shingles, bands)``: node names the set; none for an empty one."""

    def run(batch):
        for i, d, t in zip(batch["id"], batch["digest"], batch["text"]):
            items = shingle_set(t, width)
            if len(items):
                node = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
                yield i, d, node, len(items), band_keys(items, bands, rows)
            else:
                yield i, d, None, 0, None

    schema = T.StructType(
        [
            rows_in.schema["id"],
            rows_in.schema["digest"],
            T.StructField("node", T.BinaryType()),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )
    return map_batches(rows_in, schema, run)


def node_sets(rows_in: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``(node, items)`` for ``nodes (node, id, digest)``, from the text of one row each."""

    def run(batch):
        for node, t in zip(batch["node"], batch["text"]):
            yield node, shingle_set(t, width).view(np.int64)

    schema = T.StructType(
        [T.StructField("node", T.BinaryType()), T.StructField("items", T.ArrayType(T.LongType(), False))]
    )
    where = [rows_in["id"].eqNullSafe(nodes["id"]), rows_in["digest"] == nodes["digest"]]
    texts = rows_in.join(nodes, where).select("node", "text").groupBy("node").agg(F.first("text").alias("text"))
    return map_batches(texts, schema, run)


def shared_items(sets: DataFrame) -> DataFrame:
    """``(node, most)``: how many items of each node another one has too."""
    once = sets.select("node", F.explode("items").alias("item")).groupBy("item")
    once = once.agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1")
    own = once.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    sizes = sets.select("node", F.size("items").alias("size"))
    return sizes.join(own, "node", "left").select("node", (F.col("size") - F.coalesce("own", F.lit(0))).alias("most"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs ``(a, b)`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where(100 * both >= percent * (F.size("x") + F.size("y") - both))
        .select("a", "b")
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges (a, b)``; root is its least node.

    Alternating large and small stars: a few rounds, each written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        turned = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        around = e.union(turned) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = around.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    state, seen = edges, None
    while True:
        state = written(star(star(state, True), False), "stars")
        mark = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
        if mark == seen:
            break
        seen = mark
    roots = state.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def rooted(members: DataFrame, edges: DataFrame | None) -> DataFrame:
    """``members`` with the root of each node's component so far, itself if it has no link."""
    if edges is None:
        return members.withColumn("root", F.col("node"))
    found = members.join(components(edges), "node", "left")
    return found.withColumn("root", F.coalesce("root", "node"))


def open_buckets(members: DataFrame) -> DataFrame:
    """Rows of those buckets that still hold more than one component."""
    apart = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return members.join(apart.select("bucket"), "bucket")


def links(rows_in: DataFrame, feats: DataFrame, width: int, percent: int, rounds: int = 2) -> DataFrame | None:
    """Confirmed links between nodes: enough of them to connect all that any chain connects."""
    nodes = feats.where("node is not null").groupBy("node").agg(
        F.min_by(F.struct("id", "digest"), F.struct("id", "digest")).alias("at"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
    )
    members = nodes.select("node", "n", "at", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    members = written(members.join(shared.select("bucket"), "bucket"), "buckets")
    if members.isEmpty():
        return None
    owners = members.select("node", "at.id", "at.digest").distinct()
    sets = written(node_sets(rows_in, owners, width), "sets")
    # Shingles that no other node here has are in no intersection: the others bound it, for a
    # node as a whole (it has no link at all) and for each pair.
    members = members.select("bucket", "node", "n").join(shared_items(sets), "node")
    members = written(members.where(100 * F.col("most") >= percent * F.col("n")), "members")

    found: DataFrame | None = None
    both = F.least("most", "most2")
    near = 100 * both >= percent * (F.col("n") + F.col("m") - both)
    for r in range(rounds):
        waiting = written(open_buckets(rooted(members, found)), "open") if r else members.withColumn("root", F.col("node"))
        if r and waiting.isEmpty():
            return found
        # First the node that shares most of its shingles, then one by chance.
        order = F.struct(F.lit(r) if r else -F.col("most") / F.col("n"), F.xxhash64(F.lit(r), "node"))
        centres = waiting.groupBy("bucket").agg(F.min_by(F.struct("node", "n", "most", "root"), order).alias("c"))
        votes = waiting.join(centres, "bucket").select(
            "node", "n", "most", "root", F.col("c.node").alias("centre"), F.col("c.n").alias("m"), F.col("c.most").alias("most2"), F.col("c.root").alias("other")
        )
        # A member tests one centre a round: the one that shares most buckets with it.
        votes = votes.where((F.col("root") != F.col("other")) & near)
        tally = votes.groupBy("node", "centre").agg(F.count(F.lit(1)).alias("k"))
        best = tally.groupBy("node").agg(F.max_by("centre", F.struct("k", "centre")).alias("centre"))
        pairs = best.select(F.col("node").alias("a"), F.col("centre").alias("b"))
        new = confirm(pairs, sets, percent)
        found = written(new if found is None else found.union(new), "links")

    waiting = written(open_buckets(rooted(members, found)), "open")
    if waiting.isEmpty():
        return found
    return written(found.union(confirm(apart_pairs(waiting, sets, percent), sets, percent)), "links")


def apart_pairs(waiting: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of different components that may be linked, of nodes with a common bucket.

    Items that more than ``RARE`` of these nodes have are common, the others rare.  A pair with a
    rare item in common is found by it, at most ``RARE`` nodes to an item.  Any other pair can only
    share common items: few enough of them rule a node or a pair out, and of what is left all but
    the largest component of a bucket meets what is in another one.
    """
    roots = waiting.select("node", "n", "root").distinct()
    items = sets.join(roots, "node").select("node", F.explode("items").alias("item"))
    rare = written(items.groupBy("item").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= RARE), "rare")
    held = written(items.join(rare, "item").select("node", "item", "k"), "held")
    bound = roots.join(held.groupBy("node").agg(F.count(F.lit(1)).alias("few")), "node", "left")
    bound = bound.select("node", (F.col("n") - F.coalesce("few", F.lit(0))).alias("most"))
    able = waiting.drop("most").join(bound, "node").where(100 * F.col("most") >= percent * F.col("n"))

    parts = able.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("bucket").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    rest = able.join(main, "bucket").where("root <> main")
    # A pair stands in its first common bucket only, tested where the two meet.
    lists = able.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))
    rest = rest.join(lists, "node")
    other = able.join(lists, "node").join(main, "bucket")
    other = other.select("bucket", "main", F.col("buckets").alias("buckets2"), *[F.col(c).alias(n) for c, n in PARTNER.items()])
    both = F.least("most", "most2")
    either = (F.col("other_root") == F.col("main")) | (F.col("node") < F.col("other"))
    first = F.array_min(F.array_intersect("buckets", "buckets2")) == F.col("bucket")
    fits = (F.col("root") != F.col("other_root")) & (100 * both >= percent * (F.col("n") + F.col("m") - both))
    by_bucket = rest.drop("main").join(other, "bucket").where(fits & either & first)

    left = held.where("k > 1").join(roots, "node")
    right = left.select("item", *[F.col(c).alias(n) for c, n in PARTNER.items() if c != "most"])
    by_item = left.join(right, "item").where(
        (F.col("node") < F.col("other")) & (F.col("root") != F.col("other_root")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    )
    pair = F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
    return by_bucket.select(*pair).union(by_item.select(*pair)).distinct()


def groups(df: DataFrame, text: str, key: str, width: int, percent: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Features of every row and ``(node, root)`` of every node."""
    rows_in = located(df, text, key)
    feats = written(features(rows_in, width, bands_for(percent, rows), rows), "features")
    nodes = feats.where("node is not null").select("node").distinct()
    return feats.drop("bands"), rooted(nodes, links(rows_in, feats, width, percent))


def near_duplicates(
    df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80, rows: int = 4
) -> DataFrame:
    """``(key, n_shingles, component_id, kept)``, one row per row of ``df``.

    Links: 100 * intersection >= ``percent`` * union of the shingle sets.  ``component_id`` is the
    least key that links reach, the row's own included; ``kept`` says that it is the row's own.
    Null or empty text, or one without a word: an empty set, linked with nothing.  Repeated rows
    and equal texts share a component; null keys are passed over by the minimum.  Other columns
    are not read.
    """
    feats, roots = groups(df, text, key, width, percent, rows)
    least = feats.join(roots, "node").groupBy("root").agg(F.min("id").alias("component"))
    named = roots.join(least, "root").select("node", "component")
    out = feats.join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def keep_one(
    df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80, rows: int = 4
) -> DataFrame:
    """The rows of ``df`` that stay: one of each component, the one of least key.

    Rows without a word stay.  Of rows equal in key and text one stays; a null key is the largest.
    """
    feats, roots = groups(df, text, key, width, percent, rows)
    order = F.struct(F.col("id").isNull(), "id", "digest")
    first = feats.join(roots, "node").groupBy("root").agg(F.min(order).alias("o"))
    stay = first.select(F.col("o.id").alias("id"), F.col("o.digest").alias("digest"), F.lit(True).alias("hit"))
    k, d, hit = fresh(df, "id_", "digest_", "hit_")
    stay = stay.toDF(k, d, hit)
    marked = df.withColumn(d, F.xxhash64(whole(col(text))))
    joined = marked.join(stay, [marked[key].eqNullSafe(stay[k]), marked[d] == stay[d]], "left").select(
        *[marked[f"`{c}`"] for c in df.columns], stay[hit], marked[d].alias(d)
    )
    wordless = ~whole(col(text)).rlike(r"[^\x20\x09-\x0D]")
    times = feats.where("node is not null").groupBy("id", "digest").count().where("count > 1")
    again = times.select(F.col("id").alias(k), F.col("digest").alias(d))
    once = joined.where(F.col(hit) & ~wordless)
    same = [once[key].eqNullSafe(again[k]), once[d] == again[d]]
    single = once.join(again, same, "left_anti").select(*[col(c) for c in df.columns])
    repeated = once.join(again, same, "left_semi").groupBy(col(key), d)
    repeated = repeated.agg(F.first(F.struct(*[col(c) for c in df.columns])).alias(hit)).select(
        *[F.col(hit).getField(c).alias(c) for c in df.columns]
    )
    return single.unionByName(repeated).unionByName(df.where(wordless))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
