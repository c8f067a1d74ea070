"""Short texts a few letters apart, met on what is left of them.

Two texts of ``la`` and ``lb`` letters that have ``m`` letters in common, in order, read the same once
``la - m`` letters of one and ``lb - m`` of the other are left out.  For a score ``2m / (la + lb)`` near
1 these are few letters, so each text sends all that may be left of it for partners of each length, and
what meets has the score that its lengths tell: nothing is compared.  In the same way a text meets the
longer ones that it stands in, by their stretches of its length.

Much is left of a text and little of it meets anything, so a filter of bounded size (bits for some
hashes of each key) is made of the keys of the side that has fewer; it lets through few keys of the
other side, of which a second one is made for the first side.  What passes by chance meets nothing:
keys are the letters themselves, so no pair is missed and none is made up.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations
from math import comb, floor

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Executors need no copy of this package on their path for the functions below.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What is left of one text, for partners of all lengths, at most; longer texts are left to others.
MOST_LEFT = 2000
#: Letters of the longest texts that are looked for inside longer ones.
INSIDE = 32
#: Bits of the filter for a key, its least and its greatest size as powers of two, the hashes of a key.
KEY_BITS, LEAST_BITS, MOST_BITS, HASHES = 8, 16, 28, 3
#: Parts in which the filter is put together, tasks that write one each.
SLICES, WRITERS = 64, 8
#: Keys that are made at once, and that are written at once.
ROOM, PASSED = 1 << 19, 1 << 16
#: Kinds of keys besides the partner's length: stretches of texts up to 8 times as long, of still
#: longer ones, and whole texts.
STRETCH, FAR, WHOLE = 0, -1, -2
#: Rounding of products of lengths and shares.
NEAR = 1e-9

ODD = 0x9E3779B97F4A7C15
#: A kind, a score, the rows of ``Texts`` that have such keys, their hashes and the places of a key's letters.
Keys = Iterator[tuple[int, int, np.ndarray, np.ndarray, Callable]]


@dataclass(frozen=True)
class Reach:
    """Which texts may meet: like ones by the score ``c``, where ``window`` also one inside the other.

    ``window`` is the share of letters that a stretch must match; only lengths for which that is every
    letter are served.  ``far`` asks for texts more than 8 times as long, ``same`` for equal ones.
    ``least`` is the length of the shortest text.
    """

    c: float
    window: float | None
    far: bool
    same: bool
    least: int

    @cached_property
    def inside(self) -> int:
        """Letters of the longest texts that are looked for inside longer ones."""
        return max((n for n in range(1, INSIDE + 1) if self.window and floor(n * (1 - self.window) + NEAR) < 1), default=0)

    @cached_property
    def _choices(self) -> dict:
        return {}

    def choices(self, n: int, d: int) -> tuple[np.ndarray, np.ndarray]:
        """The places that are left out, and those that are left, for each choice of ``d`` of ``n`` letters."""
        if (n, d) not in self._choices:
            out = np.array(list(combinations(range(n), d)), np.int64).reshape(comb(n, d), d)
            kept = np.ones((len(out), n), bool)
            np.put_along_axis(kept, out, False, 1)
            self._choices[n, d] = out, np.nonzero(kept)[1].reshape(len(out), n - d)
        return self._choices[n, d]

    @cached_property
    def longest(self) -> int:
        """Letters of the longest texts of which no more than ``MOST_LEFT`` is left, and that are all looked for."""
        n, most = 0, self.inside if self.window else INSIDE
        while n < most and sum(comb(n + 1, a) for _, a, _ in self._met(n + 1, floor((n + 1) * (2 - self.c) / self.c + NEAR))) <= MOST_LEFT:
            n += 1
        return n

    def _met(self, la: int, most: int) -> Iterator[tuple[int, int, int]]:
        """``(lb, da, db)``: a partner's length, and the letters that may be left out on either side."""
        for lb in range(1, most + 1):
            for d in range(abs(la - lb), floor((1 - self.c) * (la + lb) + NEAR) + 1, 2):
                if d or self.same:
                    yield lb, (d + la - lb) // 2, (d + lb - la) // 2

    def asked(self, n: int) -> list[tuple[int, int, int]]:
        """``(kind, left out, score)`` of the keys by which a text of ``n`` letters looks for like ones."""
        if n > self.longest:
            return []
        return [(lb, da, round(200 * (n - da) / (n + lb))) for lb, da, _ in self._met(n, self.longest)]

    def held(self, n: int) -> list[int]:
        """Letters to be left out of a text of ``n`` letters by which like ones find it."""
        return [] if n > self.longest else sorted({da for _, da, _ in self._met(n, self.longest)})

    def stretches(self, n: int) -> list[int]:
        """Lengths of the texts that are looked for inside one of ``n`` letters."""
        return [m for m in range(self.least, min(self.inside, n) + 1) if n / m >= 1.5 and (self.far or n / m <= 8)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(ODD)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(of: int, n: int) -> np.ndarray:
    """``of`` to the powers below ``n``, in 64 bits."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, of % (1 << 64), np.uint64)]))


class Texts:
    """Texts of one length, with the hashes of what is left of them: a sum of letters times powers."""

    def __init__(self, texts: list[str], n: int, at: np.ndarray):
        self.n, self.at = n, at
        self.letters = np.array(texts, f"U{n}").view(np.uint32).reshape(-1, n)
        self.back = powers(pow(ODD, -1, 1 << 64), n + 1)
        self.sums = np.zeros((len(texts), n + 1), np.uint64)
        np.cumsum(mixed(self.letters) * powers(ODD, n), axis=1, out=self.sums[:, 1:])

    def without(self, out: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, Callable]:
        """Hashes, a row for each text, of what each choice leaves; and the places of the letters left."""
        d = out.shape[1]
        hashes = np.repeat(self.sums[:, -1:] * self.back[d], len(out), 1)
        for k in range(d):
            step = self.sums[:, :-1] * self.back[k] - self.sums[:, 1:] * self.back[k + 1]
            hashes += step[:, out[:, k]]
        return hashes, lambda choice: kept[choice]

    def within(self, m: int) -> tuple[np.ndarray, Callable]:
        """The same of all stretches of ``m`` letters."""
        hashes = (self.sums[:, m:] - self.sums[:, : self.n - m + 1]) * self.back[: self.n - m + 1]
        return hashes, lambda choice: choice[:, None] + np.arange(m)

    def all(self, rows: np.ndarray) -> tuple[np.ndarray, Callable]:
        """The same of whole texts, of some rows."""
        return self.sums[rows, -1:], lambda choice: choice[:, None] + np.arange(self.n)

    def spelled(self, rows: np.ndarray, places: np.ndarray) -> pa.Array:
        text = np.ascontiguousarray(self.letters[rows[:, None], places])
        return pa.array(text.view(f"U{places.shape[1]}")[:, 0], pa.string())


def _texts(forms: list[str], reach: Reach) -> Iterator[Texts]:
    """The texts by length, not more at once than have ``ROOM`` keys of a kind."""
    sizes = np.fromiter(map(len, forms), np.int64, len(forms))
    for n in map(int, np.unique(sizes[sizes > 0])):
        all_at, most = np.flatnonzero(sizes == n), max([n, *(comb(n, d) for _, d, _ in reach.asked(n))])
        step = max(1, ROOM // most)
        for k in range(0, len(all_at), step):
            at = all_at[k : k + step]
            yield Texts([forms[i] for i in at], n, at)


def _bits(hashes: np.ndarray, kind: int, power: int) -> Iterator[np.ndarray]:
    """The bits of each key, one hash after the other."""
    first = mixed(hashes ^ mixed(np.array([kind + 8]))[0])
    step = (first * np.uint64(ODD)) | np.uint64(1)
    for k in range(HASHES):
        yield ((first + np.uint64(k) * step) >> np.uint64(64 - power)).astype(np.int64)


def _passing(table: np.ndarray, hashes: np.ndarray, kind: int) -> np.ndarray:
    """Places in ``hashes``, taken as one row, of the keys that the filter lets through."""
    power, flat = len(table).bit_length() + 2, hashes.ravel()
    at = np.arange(len(flat))
    first = next(_bits(flat, kind, power))
    at = at[(table[first >> 3] >> (first & 7)) & 1 > 0]
    bits = _bits(flat[at], kind, power)
    alive = np.ones(len(at), bool)
    for b in bits:
        alive &= (table[b >> 3] >> (b & 7)) & 1 > 0
    return at[alive]


def held(t: Texts, whole: np.ndarray, reach: Reach) -> Keys:
    """All keys by which like texts and the shorter ones inside them find ``t``; ``whole`` marks texts as they are."""
    for d in reach.held(t.n):
        yield t.n, 0, np.arange(len(t.at)), *t.without(*reach.choices(t.n, d))
    rows = np.flatnonzero(whole)
    for m in reach.stretches(t.n):
        hashes, places = t.within(m)
        yield STRETCH if t.n / m <= 8 else FAR, 0, rows, hashes[rows], places


def asked(t: Texts, whole: np.ndarray, reach: Reach) -> Keys:
    """All keys by which ``t`` looks for like texts and for the longer ones that it stands in."""
    made: dict = {}
    for kind, d, score in reach.asked(t.n):
        made[d] = made.get(d) or t.without(*reach.choices(t.n, d))
        yield kind, score, np.arange(len(t.at)), *made[d]
    if t.n <= reach.inside:
        rows = np.flatnonzero(whole)
        for kind, score in ((STRETCH, 90), (FAR, 60)) if reach.far else ((STRETCH, 90),):
            yield kind, score, rows, *t.all(rows)


def stretches(t: Texts, whole: np.ndarray, reach: Reach) -> Keys:
    """The stretches of ``t`` that may be whole texts of the other side."""
    rows = np.flatnonzero(whole)
    for m in reach.stretches(t.n):
        hashes, places = t.within(m)
        yield WHOLE, 90 if t.n / m <= 8 else 60, rows, hashes[rows], places


def wholes(t: Texts, whole: np.ndarray, reach: Reach) -> Keys:
    rows = np.flatnonzero(whole)
    yield WHOLE, 0, rows, *t.all(rows)


def known(t: Texts, kinds: np.ndarray, reach: Reach) -> Keys:
    """Keys that were made before."""
    for kind in map(int, np.unique(kinds)):
        rows = np.flatnonzero(kinds == kind)
        yield kind, 0, rows, *t.all(rows)


def _made(batch: pa.RecordBatch, keys: Callable, reach: Reach, form: str = "form", of: str = "whole") -> Iterator[tuple]:
    texts, marks = batch.column(form).to_pylist(), batch.column(of).to_numpy(zero_copy_only=False)
    for t in _texts(texts, reach):
        for key in keys(t, marks[t.at], reach):
            if key[3].size:
                yield t, *key


def number_of_keys(forms: DataFrame, keys: Callable, reach: Reach) -> int:
    """How many keys ``forms (form, whole)`` have."""
    sizes = forms.groupBy(F.length("form").alias("n")).agg(F.count(F.lit(1)).alias("texts")).collect()
    if keys is wholes:
        return sum(r["texts"] for r in sizes)
    within = {r["n"]: sum(r["n"] - m + 1 for m in reach.stretches(r["n"])) for r in sizes}
    if keys is asked:
        return sum(r["texts"] * (1 + sum(comb(r["n"], d) for _, d, _ in reach.asked(r["n"]))) for r in sizes)
    return sum(r["texts"] * (within[r["n"]] + sum(comb(r["n"], d) for d in reach.held(r["n"]))) for r in sizes)


def key_filter(forms: DataFrame, keys: Callable, reach: Reach, number: int) -> Broadcast:
    """The filter of the ``number`` keys that ``keys`` makes of ``forms (form, whole)``, or, if it is ``known``, of
    the rows ``(key, kind)``; broadcast."""
    power = min(max((KEY_BITS * number).bit_length(), LEAST_BITS), MOST_BITS)
    length, columns = 1 << (power - 3), ("key", "kind") if keys is known else ("form", "whole")

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(length, np.uint8)
        for batch in batches:
            for _, kind, _, _, hashes, _ in _made(batch, keys, reach, *columns):
                for b in _bits(hashes.ravel(), kind, power):
                    for k in range(8):
                        table[b[b & 7 == k] >> 3] |= np.uint8(1 << k)
        for k, part in enumerate(table.reshape(SLICES, -1)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "bits": pa.array([part.tobytes()], pa.binary())})

    def joined(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b.as_py(), np.uint8) for b in table.column("bits")]
        return pa.table({"slice": table.column("slice")[:1], "bits": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary())})

    schema, table = "slice int, bits binary", np.zeros((SLICES, length // SLICES), np.uint8)
    # Fetched part by part: the driver holds the filter and little else.
    for r in forms.select(*columns).coalesce(WRITERS).mapInArrow(made, schema).groupBy("slice").applyInArrow(joined, schema).toLocalIterator():
        table[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return forms.sparkSession.sparkContext.broadcast(table.ravel())


def keys_passing(forms: DataFrame, keys: Callable, reach: Reach, table: Broadcast) -> DataFrame:
    """``(key, kind, score, ref, many)``: the keys that ``keys`` makes of ``forms (form, whole, ref, many)`` and that
    pass the filter ``table``."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, kind, score, rows, hashes, places in _made(batch, keys, reach):
                at = _passing(table.value, hashes, kind)
                own, choice = np.divmod(at, hashes.shape[1])
                of = pa.array(t.at[rows[own]])
                for k in range(0, len(at), PASSED):
                    part = slice(k, k + PASSED)
                    number = len(at[part])
                    yield pa.RecordBatch.from_pydict({
                        "key": t.spelled(rows[own[part]], places(choice[part])),
                        "kind": pa.array(np.full(number, kind, np.int32)), "score": pa.array(np.full(number, score, np.int32)),
                        "ref": batch.column("ref").take(of[part]), "many": batch.column("many").take(of[part]),
                    })

    ref = forms.schema["ref"].dataType.simpleString()
    return forms.select("form", "whole", "ref", "many").mapInArrow(made, f"key string, kind int, score int, ref {ref}, many boolean")


def meeting_keys(left: DataFrame, right: DataFrame, reach: Reach, sent: list) -> tuple[DataFrame, DataFrame]:
    """What ``left`` asks for and what ``right`` holds, as far as they may meet, each ``(key, kind, score, ref, many)``.

    What is persisted and broadcast goes to ``sent``.
    """
    sides = [(left, asked, number_of_keys(left, asked, reach)), (right, held, number_of_keys(right, held, reach))]
    (few, few_keys, number), (many, many_keys, _) = sorted(sides, key=lambda side: side[2])
    sent.append(table := key_filter(few, few_keys, reach, number))
    sent.append(passed := keys_passing(many, many_keys, reach, table).persist())
    sent.append(table := key_filter(passed, known, reach, passed.count()))
    other = keys_passing(few, few_keys, reach, table)
    return (other, passed) if few is left else (passed, other)
