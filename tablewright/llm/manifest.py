"""A Merkle manifest of a dataset: postorder logs, and proofs addressed in closed form.

The leaves of a group, ascending by key, form a tree of 16 children a node; the groups' roots,
in the order of the groups, form one more tree above.  Nodes are written in *completion order*:
after a leaf come all nodes that it completes, from the lowest up.  Builders work on aligned
stretches of 16^3 leaves, so the subtree of each is whole (but for the last one's ragged edge)
and its log, a *page*, depends on no other page.  A page's last node is a leaf of the page above.

In completion order the place of any node follows from its level and number alone: before leaf
``e`` stand ``e`` leaves and the ``e // 16 + e // 256 + ...`` nodes finished by then, and a node
stands its level's number of places behind its last leaf.  So siblings are looked up in the
page without any pointers, and a proof is read from the log, not from the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablewright.functions.frames import lookup
from tablewright.llm.common import col, table, written

#: Children a node has, as bits; levels of the subtree that one builder makes.
BITS, LEVELS = 4, 3
FAN, PAGE_BITS = 1 << BITS, BITS * LEVELS
STEP = "struct<before: string, after: string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- one page -----------------------------------------------------------------------


def append_log(leaves: list[str], height: int) -> list[str]:
    """Digests of a subtree of ``height`` levels over its leaves, in completion order."""
    log: list[str] = []
    open_: list[list[str]] = [[] for _ in range(height + 1)]

    def put(node: str, level: int) -> None:
        log.append(node)
        open_[level].append(node)
        if level < height and len(open_[level]) == FAN:
            close(level)

    def close(level: int) -> None:
        node, open_[level] = digest("".join(open_[level])), []
        put(node, level + 1)

    for leaf in leaves:
        put(leaf, 0)
    for level in range(height):  # the ragged edge
        if open_[level]:
            close(level)
    return log


def position(level: int, number: int, leaves: int) -> int:
    """Place in the log of the ``number``-th node of a level, of a tree over so many leaves."""
    last = min((number + 1) << (BITS * level), leaves) - 1
    place = last + level
    while last:
        last >>= BITS
        place += last
    return place


def siblings(log: list[str], leaves: int, height: int) -> Callable[[int], list[tuple[str, str]]]:
    """A function from the number of a leaf to ``(before, after)`` per level: the others of its run."""
    runs: dict[tuple[int, int], list[str]] = {}

    def run(level: int, number: int) -> list[str]:
        """The nodes of one run, read from the log by position."""
        if (level, number) not in runs:
            first, size = number << BITS, -(-leaves >> (BITS * level))
            runs[level, number] = [log[position(level, n, leaves)] for n in range(first, min(first + FAN, size))]
        return runs[level, number]

    def path(leaf: int) -> list[tuple[str, str]]:
        out = []
        for level in range(height):
            nodes, at = run(level, leaf >> BITS), leaf & (FAN - 1)
            out.append(("".join(nodes[:at]), "".join(nodes[at + 1 :])))
            leaf >>= BITS
        return out

    return path


# --- the trees of all groups --------------------------------------------------------


def field(value: Column) -> Column:
    """A value as a leaf takes it in: ``-`` for null, else its UTF-8 length, a colon, itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def numbered(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``nodes`` written once with ``n``: the number from 0 in its group ``g``, in the order ``by``.

    One range shuffle puts them in order; ids made in that order, less the first of the group in
    the partition, number them without a window over a group, however hot it is.
    """
    order = [F.col("g"), *[F.col(c).asc_nulls_first() for c in by]]
    dealt = nodes.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("row", F.monotonically_increasing_id()), "manifest-leaves")
    dealt = dealt.withColumn("part", F.shiftright("row", 33))
    # One row per group and partition that holds some of it.
    held = dealt.groupBy("g", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    upto = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = held.select("g", "part", (F.sum("rows").over(upto) - F.col("rows") - F.col("first")).alias("shift"))
    return lookup(dealt, held, ["g", "part"]).withColumn("n", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def mapped(df: DataFrame, schema: str, fn: Callable[[dict], Iterator[dict]], rows: int = 512) -> DataFrame:
    """The rows that ``fn`` makes of each row, sent on by ``rows``."""
    kinds = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                made = fn(batch.slice(at, 1).to_pylist()[0])
                while out := list(islice(made, rows)):
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, kinds)


def pages(nodes: DataFrame) -> DataFrame:
    """``(g, page, size, height, log)`` of nodes ``(g, n, digest, height)``: a row per aligned stretch.

    ``height`` counts the levels of the whole tree above the nodes; a page makes three at most.
    """
    blocks = nodes.groupBy("g", F.shiftright("n", PAGE_BITS).alias("page")).agg(
        F.max("height").alias("height"), F.array_sort(F.collect_list(F.struct("n", "digest"))).alias("nodes")
    )

    def build(row: dict) -> Iterator[dict]:
        log = append_log([x["digest"] for x in row["nodes"]], min(row["height"], LEVELS))
        yield dict(g=row["g"], page=row["page"], size=len(row["nodes"]), height=row["height"], log=log)

    return mapped(blocks, "g string, page long, size int, height int, log array<string>", build)


def height_of(leaves: Column) -> Column:
    """Levels above the leaves: how often a run of 16 must close until one node remains."""
    tests = [(leaves > (1 << (BITS * h))).cast("int") for h in range(64 // BITS)]
    return sum(tests[1:], tests[0])


def build_log(nodes: DataFrame) -> list[DataFrame]:
    """The log of nodes ``(g, n, digest)``, a written table of pages per round of three levels."""
    sizes = nodes.groupBy("g").agg(height_of(F.count(F.lit(1))).alias("height"))
    rounds = []
    todo = lookup(nodes, sizes, ["g"])
    while True:
        log = written(pages(todo), f"manifest-log-{len(rounds)}")
        rounds.append(log)
        left = log.where(F.col("height") > LEVELS)
        if left.isEmpty():
            return rounds
        todo = left.select(
            "g", F.col("page").alias("n"), F.element_at("log", -1).alias("digest"), (F.col("height") - LEVELS).alias("height")
        )


def roots(rounds: list[DataFrame]) -> DataFrame:
    """``(g, root)``: the last node of each group's last page."""
    done = [log.where(F.col("height") <= LEVELS).select("g", F.element_at("log", -1).alias("root")) for log in rounds]
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def paths(rows: DataFrame, rounds: list[DataFrame], ends: DataFrame) -> DataFrame:
    """``(g, item, path, subroot)`` of rows ``(g, n, item)``: the siblings of each, read from the log.

    ``ends (g, above, subroot)`` tells what stands above each group's root.  From the top down, a
    page learns the path of its own last node from the page above and passes it on to its leaves.
    """
    known = None  # (g, page, above, subroot) of the pages of a round
    for depth in range(len(rounds) - 1, -1, -1):
        log = rounds[depth]
        last = log.where(F.col("height") <= LEVELS).select("g", "page").join(ends, "g")
        known = last if known is None else last.unionByName(known)
        if depth:
            below = rounds[depth - 1].where(F.col("height") > LEVELS)
            asked = below.select("g", F.col("page").alias("n"), F.col("page").alias("item"))
        else:
            asked = rows.select("g", "n", "item")
        kind = asked.schema["item"].dataType.simpleString()
        asked = asked.groupBy("g", F.shiftright("n", PAGE_BITS).alias("page")).agg(
            F.collect_list(F.struct("n", "item")).alias("asked")
        )

        def prove(row: dict) -> Iterator[dict]:
            path = siblings(row["log"], row["size"], min(row["height"], LEVELS))
            for x in row["asked"]:
                steps = [dict(before=b, after=a) for b, a in path(x["n"] & ((1 << PAGE_BITS) - 1))]
                yield dict(g=row["g"], item=x["item"], path=steps + row["above"], subroot=row["subroot"])

        met = asked.join(log, ["g", "page"]).join(known, ["g", "page"])
        found = mapped(met, f"g string, item {kind}, path array<{STEP}>, subroot string", prove)
        if not depth:
            return found
        known = found.select("g", F.col("item").alias("page"), F.col("path").alias("above"), "subroot")


# --- manifests ----------------------------------------------------------------------


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, start, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(
    df: DataFrame,
    group: str,
    key: str,
    fields: Sequence[Column],
    carry: Mapping[str, Column] | None = None,
    asked: Column | None = None,
) -> DataFrame:
    """``(key, group, leaf, subroot, root, path, ...)`` of every row, or of those ``asked`` for.

    A leaf is the digest of ``fields``; a group's leaves ascend by ``key``.  ``path`` is the proof:
    per level up to the root, the digests of the node's run before and after it.  ``carry`` names
    further columns, computed where the row is read.

    A null group is one of its own, before all others; null keys come first; rows of equal group
    and key follow each other by leaf, and a repeated row is a leaf of its own each time.  An empty
    table has an empty manifest.  A text, however long, is hashed where it is read: digests move.
    Other columns of ``df`` are not read.
    """
    own = F.struct(col(key).alias("key"), *[c.alias(n) for n, c in (carry or {}).items()])
    g = F.coalesce(F.concat(F.lit("."), col(group).cast("string")), F.lit(""))
    wanted = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    rows = df.select(g.alias("g"), col(key).alias("key"), leaf(*fields).alias("digest"), own.alias("own"), wanted.alias("wanted"))
    rows = numbered(rows, ["key", "digest"])
    rounds = build_log(rows.select("g", "n", "digest"))
    # The tree over the groups: one group, its leaves in the order of theirs.
    tops = roots(rounds).select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("digest"))
    tops = numbered(tops, ["name"])
    upper = build_log(tops.select("g", "n", "digest"))
    top = roots(upper).first()
    nothing = F.array().cast(f"array<{STEP}>")
    over = upper[-1].select("g", nothing.alias("above"), F.lit(None).cast("string").alias("subroot")).limit(1)
    ends = paths(tops.withColumn("item", F.struct("name", "digest")), upper, over)
    ends = ends.select(F.col("item.name").alias("g"), F.col("path").alias("above"), F.col("item.digest").alias("subroot"))
    rows = rows.where("wanted").select("g", "n", F.struct("own", "digest").alias("item"))
    found = paths(rows, rounds, written(ends, "manifest-groups"))
    return found.select(
        F.col("item.own.key").alias(key),
        F.when(F.col("g") != "", F.substring("g", 2, (1 << 31) - 1)).alias(group),
        F.col("item.digest").alias("leaf"),
        "subroot",
        F.lit(top and top["root"]).cast("string").alias("root"),
        "path",
        *[F.col(f"item.own.`{n}`").alias(n) for n in carry or {}],
    )


#: The fields of a document in the order a leaf takes them in.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [F.col(c) for c in FIELDS]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    shown = F.when(hit, leaf(*fields[:-1], lower))
    out = manifest(table(spark, sf_dir, "documents"), "source", "doc_id", fields, {"shown": shown})
    folded = fold(F.coalesce("shown", "leaf"), F.col("path"))
    return out.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"), (folded == F.col("root")).alias("verified"),
    )


def _trees(name: str, leaves: str, levels: int) -> str:
    """SQL: per level the nodes ``(g, n, digest, paths)`` over ``leaves (g, n, digest)``; the last has one a group."""
    steps = [f"{name}0 as ({leaves})"]
    for i in range(levels):
        # A group of one node is done: its node goes up as it is.
        steps.append(
            f"{name}{i + 1} as (select g, n // 16 n, case when any_value(size) = 1 then min(digest) else sha256(string_agg(digest, '' order by n)) end digest"
            f" from (select *, count(*) over (partition by g) size from {name}{i}) group by g, n // 16)"
        )
    return ", ".join(steps)


def _folds(name: str, start: str, keep: str, levels: int) -> str:
    """SQL: ``(keep, g, n, digest, proof)`` carried up the trees from ``start``, one level a step."""
    steps = [f"{name}up0 as ({start})"]
    for i in range(levels):
        others = f"string_agg(t.digest, '' order by t.n) filter (where t.n {{}} u.n)"
        before, after = (f"coalesce({others.format(o)}, '')" for o in "<>")
        steps.append(
            f"{name}up{i + 1} as (select {keep}, u.g, u.n // 16 n, case when s.size = 1 then u.digest else sha256({before} || u.digest || {after}) end digest,"
            f" u.proof || {before} || {after} proof from {name}up{i} u join {name}{i} t on t.g = u.g and t.n // 16 = u.n // 16"
            f" join (select g, count(*) size from {name}{i} group by g) s on s.g = u.g group by {keep}, u.g, u.n, u.digest, u.proof, s.size)"
        )
    return ", ".join(steps)


def _field(c: str) -> str:
    return f"case when {c} is null then '-' else octet_length(encode({c}::varchar)) || ':' || {c} end"


def _oracle(levels: int = 6) -> str:
    """Up to 16^6 leaves a source."""
    head = " || ".join(map(_field, FIELDS[:-1]))
    low = "translate(\"text\", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
with table_ as (select list(c order by i) crc from (select i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) c from (select range::bigint i from range(256)))),
docs as (select doc_id, coalesce('.' || source, '') g, sha256({head} || {_field('"text"')}) leaf, sha256({head} || {_field(low)}) low,
    xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(doc_id::varchar) + 1), lambda k: ascii(substr(doc_id::varchar, k, 1))::bigint)),
    lambda c, b: xor(crc[(xor(c, b) % 256) + 1], c // 256))) h from documents, table_),
placed as (select *, row_number() over (partition by g order by doc_id, leaf) - 1 n, case when h % 5 = 0 then low else leaf end shown from docs),
{_trees("t", "select g, n, leaf digest from placed", levels)},
subs as (select '' g, row_number() over (order by encode(g)) - 1 n, digest, g as name from t{levels}),
{_trees("s", "select g, n, digest from subs", levels)},
{_folds("t", "select doc_id, g, n, shown digest, '' proof from placed", "doc_id", levels)},
{_folds("s", f"select doc_id, s.g, s.n, u.digest, u.proof from tup{levels} u join subs s on s.name = u.g", "doc_id", levels)},
ends as (select u.doc_id, u.digest folded, u.proof, r.digest root from sup{levels} u cross join s{levels} r)
select d.doc_id, d.leaf, b.digest subroot, e.root, sha256(e.proof) proof_sha256, e.folded folded_root, e.folded = e.root verified
from placed d join ends e using (doc_id) join subs b on b.name = d.g
"""


ORACLE = _oracle()
