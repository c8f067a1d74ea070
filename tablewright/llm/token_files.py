"""Token ids in seekable zstandard files.

A data file is a row of independent zstandard frames, one per document, each holding the ids of
its document as little-endian unsigned 32-bit integers, then a skippable frame with the
documents' keys (JSON, compressed), and at the end the seek table of the public *seekable
format*: per frame its compressed size, its size and the low half of the xxHash64 of its
content.  Any zstandard tool unpacks a file to the plain ids; a reader that wants some documents
reads the table from the tail, and of the rest only their frames.

Tasks write files of their own names and report them; the manifest, a table that Spark commits,
names those that count.  What a lost executor had begun is in no manifest and never read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablewright.llm import vocabulary
from tablewright.llm.common import Recent, col, scratch, table, whole

# Fixed values of the seekable format: https://github.com/facebook/zstd, contrib/seekable_format.
SEEK_TABLE_FRAME = 0x184D2A5E
SEEKABLE_END = 0x8F92EAB1
HAS_CHECKSUMS = 0x80
#: The skippable frame of the keys, a number free for users.
KEYS_FRAME = 0x184D2A50

#: A file is closed once it holds so many bytes.
FILE_BYTES = 256 << 20
#: Chunks that a worker remembers (twice as many at most), none of more letters than LONGEST.
REMEMBERED, LONGEST = 300_000, 48
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
#: A line break before a letter; white space with what follows, up to the next or, behind plain letters,
#: up to a sign other than an apostrophe.  Separators 1C to 1F are no white space to the tokenizer.
CHUNK = re.compile(rf"\n(?=[{LETTERS}])|\s*(?:[{LETTERS}]+(?=[\s!-&(-/:-@\[-`{{-~]|\Z)|[\S\x1c-\x1f]+)|\s+")
PLAIN = re.compile(rf" ?[{LETTERS}]+")


# --- ids ----------------------------------------------------------------------------


class Encoder:
    """Ids of texts, as bytes, by the ``tokenizers`` library, asked once per chunk.

    A byte-level pre-token may start with white space but goes on with none, a run of letters
    ends before any sign but an apostrophe, a single line break stands alone, and an added token
    holds no white space and starts with a sign: there every text may be cut, and the ids of the
    pieces are those of the text.  A chunk of plain letters is one pre-token and goes to the
    library's model at once.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the cores
        from tokenizers import Tokenizer

        data = json.loads(spec)
        cut = data["pre_tokenizer"]
        if cut["type"] != "ByteLevel" or cut["add_prefix_space"] or not cut["use_regex"] or data["normalizer"]:
            raise ValueError("only plain byte-level vocabularies are read")
        for t in data["added_tokens"]:
            if t["lstrip"] or t["rstrip"] or t["single_word"] or not re.fullmatch(r"[<\[{][^\s]+", t["content"]):
                raise ValueError("added tokens with white space, or that start with no bracket, are not read")
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = {b: c for b, c in enumerate(vocabulary.byte_alphabet())}
        self.chunks = Recent(self.encode, REMEMBERED)

    def encode(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk):
            ids = [t.id for t in self.model.tokenize(chunk.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        known, encode = self.chunks, self.encode
        return b"".join([known[c] if len(c) <= LONGEST else encode(c) for c in CHUNK.findall(text)])


@lru_cache(maxsize=2)
def encoder(spec: str) -> Encoder:
    return Encoder(spec)


# --- frames and files ---------------------------------------------------------------


def checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class FrameWriter:
    """One data file: frames are written as they come, the tables when it is closed."""

    def __init__(self, out):
        self.out, self.keys, self.entries, self.size = out, [], [], 0

    def add(self, key, frame: bytes, size: int, check: int) -> None:
        self.out.write(frame)
        self.keys.append(key)
        self.entries.append((len(frame), size, check))
        self.size += len(frame)

    def close(self) -> int:
        """Write keys and seek table; the bytes of the whole file."""
        keys = zstandard.ZstdCompressor().compress(json.dumps(self.keys).encode())
        self.out.write(struct.pack("<II", KEYS_FRAME, len(keys)) + keys)
        entries = [*self.entries, (len(keys) + 8, 0, checksum(b""))]
        body = b"".join(struct.pack("<III", *e) for e in entries)
        tail = struct.pack("<IBI", len(entries), HAS_CHECKSUMS, SEEKABLE_END)
        self.out.write(struct.pack("<II", SEEK_TABLE_FRAME, len(body) + len(tail)) + body + tail)
        self.out.close()
        return self.size + len(keys) + 8 + 8 + len(body) + len(tail)


def read_table(file, size: int) -> tuple[list, list[tuple[int, int, int, int]]]:
    """Keys of a data file and, per frame, ``(place, compressed size, size, checksum)``."""
    file.seek(size - 9)
    n, kind, end = struct.unpack("<IBI", file.read(9))
    if end != SEEKABLE_END or kind != HAS_CHECKSUMS:
        raise ValueError("no seek table with checksums at the end of the file")
    file.seek(size - 9 - 12 * n - 8)
    magic, length = struct.unpack("<II", file.read(8))
    if magic != SEEK_TABLE_FRAME or length != 12 * n + 9:
        raise ValueError("the seek table is damaged")
    place, entries = 0, []
    for packed, plain, check in struct.iter_unpack("<III", file.read(12 * n)):
        entries.append((place, packed, plain, check))
        place += packed
    place, packed, _, _ = entries.pop()
    file.seek(place)
    magic, length = struct.unpack("<II", file.read(8))
    if magic != KEYS_FRAME or length != packed - 8:
        raise ValueError("the frame of keys is damaged")
    return json.loads(zstandard.decompress(file.read(length))), entries


def read_frame(file, entry: tuple[int, int, int, int]) -> bytes:
    """The content of one frame, checked against the seek table."""
    place, packed, size, check = entry
    file.seek(place)
    content = zstandard.decompress(file.read(packed), max_output_size=size) if size else b""
    if len(content) != size or checksum(content) != check:
        raise ValueError(f"frame at {place}: the content does not match its checksum")
    return content


def opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder and its path there; what has no scheme is local."""
    return pa.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa.fs.LocalFileSystem(), folder)


# --- writing and reading ------------------------------------------------------------

MANIFEST = T.StructType(
    [T.StructField("part", T.IntegerType()), T.StructField("nth", T.IntegerType()), T.StructField("file", T.StringType())]
    + [T.StructField(n, T.LongType()) for n in ("documents", "tokens", "bytes")]
)


def write_tokens(
    df: DataFrame,
    folder: str,
    path: str,
    end: int | None = None,
    text: str = "text",
    key: str = "doc_id",
    level: int = 3,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encode ``text`` and write it below ``folder`` in ascending order of ``key``; the manifest.

    ``path`` names a byte-level vocabulary of the ``tokenizers`` library; ``end`` is added to
    every document.  ``key`` must be a number or a text; null comes first, equal keys are ordered
    by their content.  Null text is empty; repeated rows are written as often; other columns
    are not read.  An empty table has an empty manifest.  A text, its ids and a file's table are
    held by one task, a file is not.  ``folder`` is a path or address that executors reach alike.

    One range shuffle puts the texts in order; a task encodes its range and writes it, so a lost
    one repeats no more than that.
    """
    if not isinstance(df.schema[key].dataType, (T.IntegralType, T.StringType)):
        raise ValueError("the key must be a whole number or a text")
    spark = df.sparkSession
    spec = spark.sparkContext.broadcast(vocabulary.read(path))
    last = b"" if end is None else struct.pack("<I", end)
    texts = df.select(col(key).alias("key"), whole(col(text)).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.octet_length("text")]
    ordered = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    place = f"{folder.rstrip('/')}/data"
    arrow = to_arrow_schema(MANIFEST)
    files, inside = opened(place)
    files.create_dir(inside, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, writer, name = TaskContext.get().partitionId(), 0, None, ""
        files, inside = opened(place)
        encode, pack = encoder(spec.value), zstandard.ZstdCompressor(level=level)

        def closed() -> pa.RecordBatch:
            tokens = sum(e[1] for e in writer.entries) // 4
            row = dict(part=part, nth=nth, file=name, documents=len(writer.keys), tokens=tokens, bytes=writer.close())
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for k, t in zip(*(batch.column(n) for n in ("key", "text"))):
                if writer is None:
                    name = f"{part:06d}-{nth:06d}-{uuid.uuid4().hex}.zst"
                    writer = FrameWriter(files.open_output_stream(f"{inside}/{name}", compression=None))
                ids = encode(t.as_py()) + last
                writer.add(k.as_py(), pack.compress(ids) if ids else b"", len(ids), checksum(ids))
                if writer.size >= file_bytes:
                    yield closed()
                    writer, nth = None, nth + 1
        if writer is not None:
            yield closed()

    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder.rstrip('/')}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")


def read_tokens(
    spark: SparkSession, folder: str, key: str = "doc_id", kind: str = "long", wanted: Iterable | None = None
) -> DataFrame:
    """``(key, start, n_tokens, tokens)`` of the documents, or of the ``wanted`` keys, from the files.

    ``start`` counts the ids of all documents before it; ``tokens`` are its ids as little-endian
    unsigned 32-bit integers.  ``kind`` is the type of the key.  Of a file, the seek table and the
    frames of the documents asked for are read, each checked; a frame that does not match its
    checksum fails.  ``wanted`` is a list the caller holds; a key that is not there has no row.
    """
    place = f"{folder.rstrip('/')}/data"
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
    before = W.orderBy("part", "nth").rowsBetween(W.unboundedPreceding, W.currentRow)  # a row per file
    based = manifest.select("file", "bytes", "documents", (F.sum("tokens").over(before) - F.col("tokens")).alias("base"))
    asked = None if wanted is None else set(wanted)
    schema = T.StructType(
        [
            T.StructField(key, T._parse_datatype_string(kind)),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("tokens", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inside = opened(place)
        for listed in batches:
            for row in listed.to_pylist():
                with files.open_input_file(f"{inside}/{row['file']}") as file:
                    keys, entries = read_table(file, row["bytes"])
                    at, out, held = row["base"], [], 0
                    for k, entry in zip(keys, entries):
                        if asked is None or k in asked:
                            out.append((k, at, entry[2] // 4, read_frame(file, entry)))
                            held += entry[2]
                        at += entry[2] // 4
                        if held > 1 << 23 or len(out) == 1024:
                            yield batch(out)
                            out, held = [], 0
                    if out:
                        yield batch(out)

    # A number of partitions of its own, or these few rows would all be put into one task.
    return based.repartition(max(1, manifest.count()), "file").mapInArrow(read, schema)


def ids_of(tokens: bytes) -> list[int]:
    return list(struct.unpack(f"<{len(tokens) // 4}I", tokens))


def query(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), folder, path, end=2)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))
