"""Periodic runs of words, by the dictionary of basic factors.

For every power of two L, the dictionary names each stretch of L words so that equal stretches
have equal names (the names of 2L are pairs of names of L).  A stretch and its next occurrence,
if no further away than 2L, propose their distance as a period; within a run they come one after
the other, all at the same distance: an arithmetic progression.  For a run of period q, of four
periods or more, the next occurrence of a stretch of L words, q <= L < 2q, is exactly q words on,
and so is the one after it; so no run is missed.  Proposals are extended to both sides as far as
the period holds, and runs that several lengths propose are kept once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import SPACE, col, let, map_batches, table, whole

#: A run has this many words at least, and this many periods.
MIN_WORDS, MIN_PERIODS = 6, 4
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def extended(words: np.ndarray, first: int, last: int, period: int) -> tuple[int, int]:
    """The stretch of ``words[first:last]``, of this period, made as wide as the period holds."""
    size = 64
    while first:
        lo = max(0, first - size)
        differ = np.flatnonzero(words[lo:first] != words[lo + period : first + period])
        if differ.size:
            first = lo + int(differ[-1]) + 1
            break
        first, size = lo, 2 * size
    size, end = 64, len(words)
    while last < end:
        hi = min(end, last + size)
        differ = np.flatnonzero(words[last:hi] != words[last - period : hi - period])
        if differ.size:
            last += int(differ[0])
            break
        last, size = hi, 2 * size
    return first, last


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start and period, of a text as word numbers."""
    n = len(words)
    found: set[tuple[int, int, int]] = set()
    names, length = words, 1
    # A stretch longer than the longest period cannot propose anything new.
    while 2 * length <= n and length < 2 * max(1, n // MIN_PERIODS):
        order = np.argsort(names, kind="stable")
        same = names[order[1:]] == names[order[:-1]]
        if not same.any():
            break  # nothing occurs twice, and so nothing longer does
        ahead = np.zeros(n + 1, np.int64)  # distance to the next occurrence, 0 for none near
        ahead[order[:-1]] = np.where(same, order[1:] - order[:-1], 0)
        ahead[ahead > 2 * length] = 0
        at = np.flatnonzero(ahead)
        gap = ahead[at]
        # Progressions: the next occurrence has its own next at the same distance.
        go_on = ahead[np.minimum(at + gap, n)] == gap
        at, gap = at[go_on], gap[go_on]
        head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (gap[1:] != gap[:-1])))) if at.size else at
        known: dict[int, int] = {}  # per period, where the last stretch tried ends
        for i, p in zip(at[head].tolist(), gap[head].tolist()):
            if i + p < known.get(p, 0):
                continue
            first, last = extended(words, i, i + p + length, p)
            known[p] = last
            if last - first >= max(MIN_WORDS, MIN_PERIODS * p):
                found.add((first, last - first, p))
        # Names of twice the length: pairs of names, numbered in order.
        pairs = names[: len(names) - length] * (n + 1) + names[length:]
        names, length = np.unique(pairs, return_inverse=True)[1].astype(np.int64), 2 * length
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those no run holds behind its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth)[:n] == 0


def find_runs(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(key, n_words, runs, collapsed)``: the periodic runs of each text, and it without repeats.

    A run is a stretch of words with least period q, of max(6, 4q) words or more, that no word
    beside it carries on.  ``collapsed`` has of each run the first period, words joined by one
    space.  Null text: no words, no runs, an empty ``collapsed``.  Repeated rows give repeated
    results; other columns are not read.  A very long text is one row of one task, which holds
    some 100 bytes a word.
    """
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T._parse_datatype_string(f"array<{RUN}>")),
            T.StructField("collapsed", T.StringType()),
        ]
    )

    def rows(batch: dict[str, list]) -> Iterator[tuple]:
        for k, t in zip(batch["k"], batch["t"]):
            words = t.encode().split()
            number: dict[bytes, int] = {}
            numbers = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
            runs = runs_of(numbers)
            if runs:
                words = [w for w, stays in zip(words, kept(len(words), runs).tolist()) if stays]
            out = [dict(start=s, length=n, period=p) for s, n, p in runs]
            yield k, len(numbers), out, b" ".join(words).decode()

    return map_batches(df.select(col(key).alias("k"), whole(col(text)).alias("t")), schema, rows)


def planted(key: Column, text: Column) -> Column:
    """The text, of every tenth key (by CRC-32) with a stretch of it over and over up to its end."""
    h = F.crc32(key.cast("string").cast("binary"))
    g, every_tenth = F.floor(h / 10), h % 10 == 0

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.when(n > 0, g % n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p))), " ")

    words = F.filter(F.split(whole(text), SPACE), lambda w: w != "")
    return F.when(every_tenth, let(words, repeated)).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = find_runs(docs)
    line = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    ranked = F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"].alias("length")))
    best = F.array_min(ranked)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"),
        best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )  # fmt: skip


#: The same by a join of equal triples of words: stretches that repeat ``p`` words on are islands of ``j - i = p``.
ORACLE = r"""
with table_ as (select list(c order by i) crc from (select i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) c from (select range::bigint i from range(256)))),
coded as (select doc_id, xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, length(doc_id::varchar) + 1), lambda k: ascii(substr(doc_id::varchar, k, 1))::bigint)),
    lambda c, b: xor(crc[(xor(c, b) % 256) + 1], c // 256))) h, regexp_extract_all(coalesce("text", ''), '[^ 	-]+') w0 from documents, table_),
dealt as (select *, h // 10 g, len(w0) n from coded),
placed as (select *, case when n > 0 then g % n end a from dealt),
moved as (select *, 1 + (n - a) // (3 + g % 8) p from placed),
texts as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: case when i < a then w0[i + 1] else w0[a + (i - a) % p + 1] end) else w0 end w from moved),
words as (select doc_id, n, unnest(w) word, generate_subscripts(w, 1) - 1 i from texts),
triples as (select doc_id, n, i, word, lead(word, 1) over (partition by doc_id order by i) w1, lead(word, 2) over (partition by doc_id order by i) w2 from words),
same as (select a.doc_id, a.i, b.i - a.i p from triples a join triples b on a.doc_id = b.doc_id and a.word = b.word and a.w1 = b.w1 and a.w2 = b.w2 and b.i > a.i and 4 * (b.i - a.i) <= a.n),
islands as (select *, i - row_number() over (partition by doc_id, p order by i) k from same),
stretches as (select doc_id, p, min(i) s, max(i) + 3 + p e from islands group by doc_id, p, k having max(i) + 3 + p - min(i) >= greatest(6, 4 * p)),
runs as (select doc_id, s, e - s n, p, e from stretches r where not exists (select 1 from stretches q where q.doc_id = r.doc_id and q.p < r.p and q.s <= r.s and q.e >= r.e)),
dropped as (select distinct doc_id, unnest(range(s + p, e)) i from runs),
stay as (select w.doc_id, string_agg(w.word, ' ' order by w.i) t from words w left join dropped d on d.doc_id = w.doc_id and d.i = w.i where d.i is null group by w.doc_id),
best as (select doc_id, count(*) c, min({'l': -n, 's': s, 'p': p}) b, string_agg(s || ',' || n || ',' || p || chr(10), '' order by s, p) t from runs group by doc_id)
select d.doc_id, coalesce(c, 0)::bigint n_runs, b.s::bigint as "start", (-b.l)::bigint as "length", b.p::bigint as "period", ((-1000 * b.l) // b.p)::bigint exponent_milli,
    sha256(coalesce(best.t, '')) runs_sha256, sha256(coalesce(stay.t, '')) collapsed_sha256
from documents d left join best using (doc_id) left join stay using (doc_id)
"""
