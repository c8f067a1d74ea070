"""Word-level BPE vocabularies: file, normaliser, pre-tokens, byte alphabet.

Reads the public ``tokenizers`` JSON format for models with an end-of-word suffix.  A
pre-token becomes a string of *symbols*: one character per byte, the last one moved up by
``FINAL``, so that an end-of-word byte is a letter of its own.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import regex

FINAL = 0x1000
#: A pattern (fixed value of the format) under which a run of letters is one pre-token.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte (the byte-level convention)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Vocabulary:
    """``ids`` of tokens as symbol strings, ``merges`` (pair of symbol strings -> rank)."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        kinds = [n["type"] for n in data["normalizer"]["normalizers"]]
        split, byte_level = data["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or not self.suffix or odd or kinds != ["NFC", "Replace", "Lowercase"] or data.get("decoder") or data.get("post_processor"):
            raise ValueError("only word-end BPE with NFC, space and case folding is read")
        if split["behavior"] != "Removed" or not split["invert"] or byte_level["add_prefix_space"]:
            raise ValueError("only pre-tokens found by a pattern are read")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.runs = split["pattern"]["Regex"] == LETTER_RUNS
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        if any(set(" \t\n\x0b\f\r") & set(t) for t in self.added):
            raise ValueError("added tokens with white space are not read")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.added.items()}
        self.ids = {self.symbols(t): i for t, i in model["vocab"].items()}
        self.merges: dict[tuple[str, str], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((a, self.symbols(b)), rank)

    def symbols(self, token: str) -> str:
        """A vocabulary entry as a symbol string."""
        if token.endswith(self.suffix) and token != self.suffix:
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + FINAL)
        return token

    def spell(self, word: str) -> str:
        """A pre-token as a symbol string."""
        letters = word.encode().decode("latin-1").translate(self.letters)
        return letters[:-1] + chr(ord(letters[-1]) + FINAL)

    def pieces(self, chunk: str) -> list[str | int]:
        """Pre-tokens of a text, and the ids of added tokens found in it, in order.

        White space ends every pre-token, composes with nothing and is in no added token, so
        the pieces of a text are those of its chunks between ASCII white space.
        """
        if self.cut is not None and self.cut.search(chunk):
            out: list[str | int] = []
            for n, part in enumerate(self.cut.split(chunk)):
                out += [self.added[part]] if n % 2 else self.plain(part)
            return out
        return self.plain(chunk)

    def plain(self, text: str) -> list[str]:
        if text.isascii():
            low = text.lower()
        else:  # characters are lowered one by one: no final form of sigma
            low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.runs:
            if low.isalpha():
                return [low]
            if low[-1:] in (".", ",") and low[:-1].isalpha():
                return [low[:-1], low[-1]]
        return self.words.findall(low)


@lru_cache(maxsize=4)
def load(spec: str) -> Vocabulary:
    return Vocabulary(spec)


def read(path: str) -> str:
    """The file's text, for shipping to the tasks: its size is that of a vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()
