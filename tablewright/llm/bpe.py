"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token exactly one vocabulary entry can be the last token of its
encoding.  A suffix automaton, its states made as they are reached, lists the entries
that end each prefix; an entry is the last token if it is the whole prefix, or if
it is compatible with the last token of what is left.  Two tokens are compatible if no merge
across their border would come before the merges that build them.  Back-pointers from the
end give the ids.
"""

from __future__ import annotations

import gc
import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewright.llm import vocabulary
from tablewright.llm.common import Recent, col, map_batches, whole

NEVER = 1 << 60
#: Words, chunks and token pairs that a worker remembers, twice as many at most.
REMEMBERED = 250_000


class State:
    __slots__ = ("read", "ends", "next")

    def __init__(self, read: str, ends: list[tuple[int, int]]):
        self.read, self.ends, self.next = read, ends, {}


class Encoder:
    """Ids of pre-tokens."""

    def __init__(self, spec: str, remembered: int = REMEMBERED):
        self.vocab = v = vocabulary.load(spec)
        n = self.n = max(v.names) + 1
        self.rank: dict[int, int] = {}
        #: The token of each border of a token from its outermost letter to itself, each with
        #: the rank of the merge that makes the next.
        self.first: dict[int, list[tuple[int, int]]] = {}
        self.last: dict[int, list[tuple[int, int]]] = {}
        for t, i in v.ids.items():
            if len(t) == 1:
                self.first[i] = self.last[i] = [(i, NEVER)]
        for (a, b), rank in v.merges.items():  # by rank: parts come before what they make
            x, y, xy = v.ids[a], v.ids[b], v.ids[a + b]
            self.rank[x * n + y] = rank
            if xy not in self.first and x in self.first and y in self.first:
                self.first[xy] = [*self.first[x][:-1], (x, rank), (xy, NEVER)]
                self.last[xy] = [*self.last[y][:-1], (y, rank), (xy, NEVER)]
                if not self._whole(x, y, rank):
                    del self.first[xy], self.last[xy]
        self.entries = {t: (len(t), i) for t, i in v.ids.items() if i in self.first}
        self.starts = {t[:k] for t in self.entries for k in range(len(t) + 1)}
        #: Per state its string, the entries that end there (longest first), its next states.
        self.states: dict[str, State] = {}
        self.start = self.state("")
        self.pairs = Recent(lambda k: self._meet(*divmod(k, self.n), NEVER), remembered)

    def _whole(self, x: int, y: int, rank: int) -> bool:
        """True if x and y come to stand side by side, so that their merge makes one token."""
        return self._meet(x, y, rank)

    def _meet(self, x: int, y: int, below: int) -> bool:
        """True if no merge of a rank under ``below`` crosses the border of tokens x and y."""
        left, right = self.last[x], self.first[y]
        i = j = 0
        while True:
            (a, up), (b, on) = left[i], right[j]
            crossing = self.rank.get(a * self.n + b, NEVER)
            # Of equal pairs the leftmost goes first: the left token's own before the
            # crossing one, the crossing one before the right token's own.
            if crossing < below and crossing < up and crossing <= on:
                return False
            if up == on == NEVER:
                return True
            if up <= on:
                i += 1
            else:
                j += 1

    def state(self, read: str) -> State:
        """The state after ``read``: its longest suffix with which an entry starts."""
        while read not in self.starts:
            read = read[1:]
        if read not in self.states:
            ends = [self.entries[read[k:]] for k in range(len(read)) if read[k:] in self.entries]
            self.states[read] = State(read, ends)
        return self.states[read]

    def encode(self, symbols: str) -> list[int]:
        last = [-1] * len(symbols)
        size = [0] * len(symbols)
        state, n, pairs = self.start, self.n, self.pairs
        for end, letter in enumerate(symbols):
            after = state.next.get(letter)
            if after is None:
                after = state.next[letter] = self.state(state.read + letter)
            state = after
            for k, t in state.ends:
                if k > end or pairs[last[end - k] * n + t]:
                    last[end], size[end] = t, k
                    break
        out, at = [], len(symbols) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]


class Chunks:
    """``ids``: chunk (bytes between white space) -> its ids as text; ``names``: id as text -> token."""

    def __init__(self, spec: str, remembered: int = REMEMBERED):
        self.encoder = Encoder(spec, remembered)
        self.vocab = self.encoder.vocab
        self.names = {str(i): t for i, t in self.vocab.names.items()}
        self.words = Recent(self.encode_word, remembered)
        self.ids = Recent(self.encode_chunk, remembered)
        gc.freeze()  # the tables stay: no use in walking them again and again

    def encode_word(self, word: str | int) -> str:
        ids = [word] if isinstance(word, int) else self.encoder.encode(self.vocab.spell(word))
        return " ".join(map(str, ids))

    def encode_chunk(self, chunk: bytes) -> str:
        return " ".join([self.words[p] for p in self.vocab.pieces(chunk.decode())])


@lru_cache(maxsize=2)
def chunks(spec: str, remembered: int = REMEMBERED) -> Chunks:
    return Chunks(spec, remembered)


def encode_text(text: str, known: Chunks) -> str:
    """The ids of a text, as text."""
    return " ".join(filter(None, map(known.ids.__getitem__, text.encode().split())))


def decode_text(ids: str, known: Chunks) -> str:
    """Tokens joined by a space: the format has no decoder that would join words again."""
    return " ".join(map(known.names.__getitem__, ids.split()))


def encode(
    df: DataFrame, path: str, text: str = "text", key: str = "doc_id", with_ids: bool = True, remembered: int = REMEMBERED
) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256[, ids array<int>])``, one row per row of ``df``.

    Null text: empty, no ids, digests of the empty string.  Repeated rows give repeated
    results; other columns are not read.  A worker remembers ``remembered`` words, chunks and pairs of
    tokens, or twice as many: fewer take less memory and more time.
    """
    spec = df.sparkSession.sparkContext.broadcast(vocabulary.read(path))

    def rows(batch):
        known = chunks(spec.value, remembered)
        for k, t in zip(batch["k"], batch["t"]):
            ids = encode_text(t, known)
            out = k, ids.count(" ") + 1 if ids else 0, sha(ids), sha(decode_text(ids, known))
            yield (*out, [*map(int, ids.split())]) if with_ids else out

    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType(), False))
    return map_batches(df.select(col(key).alias("k"), whole(col(text)).alias("t")), schema, rows)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
