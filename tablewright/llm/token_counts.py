"""Token counts with a whole-token shortcut.

Offline, once per vocabulary, every end-of-word entry is put through the merges; those that
come out as one token form the shortcut set.  A pre-token in the set counts one at once;
only the rest is merged.  Counts are those of the ``tokenizers`` library.
"""

from __future__ import annotations

import gc
import heapq
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewright.llm import vocabulary
from tablewright.llm.common import Recent, col, map_batches, whole
from tablewright.llm.vocabulary import Vocabulary

NEVER = 1 << 60
#: Words and chunks that a worker remembers, twice as many at most.
REMEMBERED = 250_000


def merge(symbols: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none has a rank."""
    if len(symbols) > 60:
        return merge_long(symbols, ranks)
    parts, rank = list(symbols), ranks.get
    costs = [rank(p, NEVER) for p in zip(parts, parts[1:])]
    while costs:
        low = min(costs)
        if low == NEVER:
            break
        i = costs.index(low)
        parts[i] += parts.pop(i + 1)
        del costs[i]
        if i:
            costs[i - 1] = rank((parts[i - 1], parts[i]), NEVER)
        if i < len(costs):
            costs[i] = rank((parts[i], parts[i + 1]), NEVER)
    return parts


def merge_long(symbols: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same over a heap: a run of 100,000 signs must not take quadratic time."""
    parts: list[str | None] = list(symbols)
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    heap = [
        (ranks[p], i, p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks
    ]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if parts[i] != pair[0] or j >= len(parts) or parts[j] != pair[1]:
            continue
        parts[i], parts[j] = pair[0] + pair[1], None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
            new = (parts[i], parts[after[j]])
            if new in ranks:
                heapq.heappush(heap, (ranks[new], i, new))
        if before[i] >= 0:
            new = (parts[before[i]], parts[i])
            if new in ranks:
                heapq.heappush(heap, (ranks[new], before[i], new))
    return [p for p in parts if p is not None]


def proven_whole(vocab: Vocabulary) -> set[str]:
    """Entries, as symbols, that the merges make one token when they stand alone."""
    return {t for t in vocab.ids if len(t) == 1 or merge(t, vocab.merges) == [t]}


class Counter:
    """``chunks``: chunk (bytes between white space) -> its number of tokens."""

    def __init__(self, spec: str):
        self.vocab = vocabulary.load(spec)
        self.whole = proven_whole(self.vocab)
        self.words = Recent(self.count_word, REMEMBERED)
        self.chunks = Recent(self.count_chunk, REMEMBERED)
        gc.freeze()  # the tables stay: no use in walking them again and again

    def count_word(self, word: str) -> int:
        symbols = self.vocab.spell(word)
        return 1 if symbols in self.whole else len(merge(symbols, self.vocab.merges))

    def count_chunk(self, chunk: bytes) -> int:
        return sum(
            1 if isinstance(p, int) else self.words[p] for p in self.vocab.pieces(chunk.decode())
        )


@lru_cache(maxsize=2)
def counter(spec: str) -> Counter:
    return Counter(spec)


def count_tokens(
    df: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 2048
) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)``, one row per row of ``df``.

    Null text: empty, 0 bytes and 0 tokens.  Repeated rows give repeated results; other
    columns are not read.  A very long text is one row of one task, cut into chunks.
    """
    spec = df.sparkSession.sparkContext.broadcast(vocabulary.read(path))

    def rows(batch):
        known = counter(spec.value).chunks
        for k, t in zip(batch["k"], batch["t"]):
            data = t.encode()
            n = sum(map(known.__getitem__, data.split()))
            yield k, len(data), n, n > limit

    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    return map_batches(df.select(col(key).alias("k"), whole(col(text)).alias("t")), schema, rows)
