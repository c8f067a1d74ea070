"""String similarity scores, as Arrow UDFs.

Spark does the blocking, joining and ranking; these functions only score the
candidate pairs it hands over.  Scores of a batch are computed once per distinct pair.

``ratio`` and ``token_set`` follow their definition exactly.  ``partial`` takes the
best window over all alignments, which is never below the usual block-aligned value.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Executors need no copy of this package on their path for the UDFs below.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel over the letters of ``a``."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> int:
    """2 * matches / total length, in percent."""
    if not a or not b:
        return 0
    return round(200 * lcs_length(a, b) / (len(a) + len(b)))


def partial(a: str, b: str) -> int:
    """Best ``ratio`` of the shorter text against a window of the longer one."""
    if not a or not b:
        return 0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 100
    n = len(short)
    return max(ratio(short, long[i : i + n]) for i in range(len(long) - n + 1))


def plain(text: str) -> str:
    """Lower case; everything but letters, digits and ``_`` becomes a blank."""
    return re.sub(r"\W", " ", text).lower().strip()


def token_sort(a: str, b: str, score: Callable[[str, str], int] = ratio) -> int:
    return score(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str, score: Callable[[str, str], int] = ratio) -> int:
    """Best score among shared words, shared + rest of a, shared + rest of b."""
    left, right = set(a.split()), set(b.split())
    shared = " ".join(sorted(left & right))
    with_a = (shared + " " + " ".join(sorted(left - right))).strip()
    with_b = (shared + " " + " ".join(sorted(right - left))).strip()
    return max(score(shared, with_a), score(shared, with_b), score(with_a, with_b))


def weighted(a: str, b: str) -> int:
    """Best of the scorers above, each scaled by how much it forgives."""
    if not a or not b:
        return 0
    spread = max(len(a), len(b)) / min(len(a), len(b))
    if " " not in a and " " not in b:  # one word each: every order is the same
        if spread < 1.5:
            return ratio(a, b)
        return round(max(ratio(a, b), (0.9 if spread <= 8 else 0.6) * partial(a, b)))
    if spread < 1.5:
        return round(max(ratio(a, b), 0.95 * token_sort(a, b), 0.95 * token_set(a, b)))
    scale = 0.9 if spread <= 8 else 0.6
    return round(
        max(
            ratio(a, b),
            scale * partial(a, b),
            scale * 0.95 * token_sort(a, b, partial),
            scale * 0.95 * token_set(a, b, partial),
        )
    )


def matcher(a: str, b: str) -> float:
    """Standard-library block matcher on lower-case text; not symmetric."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def matcher_raw(a: str, b: str) -> float:
    """Block matcher as the close-match search calls it: ``b`` is the query."""
    return SequenceMatcher(None, a, b).ratio()


def _plain(score: Callable[[str, str], int]) -> Callable[[str, str], int]:
    return lambda a, b: score(plain(a), plain(b))


SCORERS: dict[str, Callable[[str, str], float]] = {
    "ratio": _plain(ratio),
    "partial": _plain(partial),
    "token_set": _plain(token_set),
    "weighted": _plain(weighted),
    "matcher": matcher,
    "matcher_raw": matcher_raw,
}


def score(name: str, a: Column, b: Column, least: float = 0.0) -> Column:
    """Score of two string columns; NULL where a side is NULL.

    For the block matchers, pairs that cannot reach ``least`` letter by letter get 0.
    """
    low = name == "matcher"

    def bounded(x: str, y: str) -> float:
        p, q = (x.lower(), y.lower()) if low else (x, y)
        if least and 2 * lcs_length(p, q) < least * (len(p) + len(q)) - 1e-9:
            return 0.0
        return SCORERS[name](x, y)

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        cached = lru_cache(maxsize=None)(bounded if least else SCORERS[name])
        return pd.Series(
            [
                None if x is None or y is None else float(cached(x, y))
                for x, y in zip(left, right)
            ],
            dtype="float64",
        )

    return run(a, b)


def best_of(value: Column, canonical: list[str], scorers: list[str]) -> Column:
    """Best canonical value over all scorers, as ``struct<match, score>``.

    Earlier scorers and earlier canonical values win ties.
    """

    @F.pandas_udf("struct<match: string, score: double>")
    def run(values: pd.Series) -> pd.DataFrame:
        @lru_cache(maxsize=None)
        def pick(text: str) -> tuple[str, float]:
            tops = []
            for name in scorers:
                scored = [(SCORERS[name](text, c), c) for c in canonical]
                tops.append(max(scored, key=lambda t: t[0]))
            top, match = max(tops, key=lambda t: t[0])
            return match, float(top)

        rows = [(None, None) if v is None else pick(v) for v in values]
        return pd.DataFrame(rows, columns=["match", "score"])

    return run(value)
