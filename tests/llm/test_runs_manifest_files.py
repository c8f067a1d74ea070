"""Periodic runs, the Merkle manifest and the token files against plain versions, on odd rows too."""

import hashlib
import random
import re
import struct
import subprocess
import sys
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tests.llm.fixtures import SCHEMA, odd_rows, row
from tokenizers import Tokenizer

from tablewright.llm import manifest, periodic, queries, token_files

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_only_this_folder_is_needed():
    code = "import tablewright.llm.periodic, tablewright.llm.manifest, tablewright.llm.token_files"
    assert subprocess.run([sys.executable, "-c", code], cwd=queries.__file__.rsplit("/tablewright", 1)[0]).returncode == 0


# --- runs -----------------------------------------------------------------------------


def plain_runs(words):
    """Every maximal stretch for every period, those of a smaller period within left out."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.append((i, j - i + q, q))
            i = j + 1
    least = [r for r in out if not any(s[2] < r[2] and s[0] <= r[0] and s[0] + s[1] >= r[0] + r[1] for s in out)]
    return sorted(least, key=lambda r: (r[0], r[2]))


def repetitive(rnd, n):
    words = []
    while len(words) < n:
        unit = [rnd.choice("abc") for _ in range(rnd.randint(1, 7))]
        words += unit * rnd.randint(1, 7) + unit[: rnd.randint(0, len(unit))]
    return words[:n]


def test_runs_of_random_texts():
    rnd = random.Random(11)
    for _ in range(1500):
        words = [rnd.choice("ab") for _ in range(rnd.randint(0, 40))] if rnd.random() < 0.3 else repetitive(rnd, rnd.randint(1, 150))
        numbers = np.array([ord(w) for w in words], np.int64) - ord("a")
        assert periodic.runs_of(numbers) == plain_runs(words), words
    assert periodic.runs_of(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    fib = [0], [0, 1]
    while len(fib[1]) < 50_000:
        fib = fib[1], fib[1] + fib[0]
    assert periodic.runs_of(np.array(fib[1])) == []  # no power of four or more in it


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_find_runs(spark, docs, none):
    more = [row(500, "the same line\n" * 50), row(501, "a b " * 4 + "a c"), row(502, "x " * 5), row(503, "x\x0b" * 6 + "é x x"), row(504, None)]
    df = docs.union(spark.createDataFrame(more, SCHEMA))
    texts = [(r.doc_id, r.text or "") for r in df.collect()]
    got = periodic.find_runs(df).collect()
    want = []
    for i, t in texts:
        words = re.findall(WORD, t)
        runs = plain_runs(words) if len(words) < 2000 else []
        want.append((i, len(words), runs, collapsed(words, runs)))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got], key=key) == sorted(want, key=key)
    by_id = {r.doc_id: r for r in got}
    assert by_id[500].collapsed == "the same line" and by_id[503].collapsed.startswith("x é") and not by_id[502].runs
    assert periodic.find_runs(none).count() == 0


def test_planted_repetition(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(50 + i))) for i in range(300)] + [(300, ""), (None, "a b")], "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("t")).collect()}
    hit = 0
    for r in df.collect():
        words, h = r.text.split(), zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            hit += 1
            assert got[r.doc_id] == " ".join(words)
        else:
            assert got[r.doc_id] == r.text
    assert hit > 10


# --- manifest -------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """Levels of the tree, from the leaves to the one root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([h("".join(level[i : i + 16])) for i in range(0, len(level), 16)])
    return levels


def plain_path(levels, at):
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        run = level[first : first + 16]
        out.append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        at //= 16
    return out


def plain_leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 272, 273, 700, 4095, 4096])
def test_positions_are_those_of_the_log(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = plain_tree(leaves)
    height = len(levels) - 1
    log = manifest.append_log(leaves, height)
    assert sorted(log) == sorted(x for level in levels for x in level)
    for depth, level in enumerate(levels):
        assert [log[manifest.position(depth, i, n)] for i in range(len(level))] == level
    path = manifest.siblings(log, n, height)
    for i in {0, 1, n // 2, n - 1} - {n}:
        assert path(i) == plain_path(levels, i)


def check_manifest(rows, got):
    """``rows`` and ``got`` as (doc_id, source, leaf ...): against trees made by hand."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"], plain_leaf([r[c] for c in manifest.FIELDS])))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {s: plain_tree([x[1] for x in g]) for s, g in groups.items()}
    top = plain_tree([trees[s][-1][0] for s in order])
    want = []
    for at, s in enumerate(order):
        for i, (key, leaf) in enumerate(groups[s]):
            path = plain_path(trees[s], i) + plain_path(top, at)
            want.append((key, s, leaf, trees[s][-1][0], top[-1][0], tuple(path)))
    found = [(r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((p.before, p.after) for p in r.path)) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_manifest_of_odd_rows(docs, none):
    fields = [F.col(c) for c in manifest.FIELDS]
    got = manifest.manifest(docs, "source", "doc_id", fields, {"n_chars": F.col("n_chars")}).collect()
    check_manifest(docs.collect(), got)
    assert manifest.manifest(none, "source", "doc_id", fields).count() == 0
    some = manifest.manifest(docs, "source", "doc_id", fields, asked=F.col("doc_id") > 100).collect()
    assert {r.doc_id for r in some} == {r.doc_id for r in got if r.doc_id is not None and r.doc_id > 100}


def test_manifest_of_many_rows(spark):
    """Groups over several pages, a hot one, and more groups than one run holds."""
    df = spark.range(15_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 7 != 0, F.concat(F.lit("é"), F.col("id") % 40)).alias("source"),
        F.lit("en").alias("lang"), F.col("id").alias("n_chars"), F.md5(F.col("id").cast("string").cast("binary")).alias("text"),
    )
    out = manifest.manifest(df, "source", "doc_id", [F.col(c) for c in manifest.FIELDS])
    check_manifest(df.collect(), out.collect())
    good = out.withColumn("folded", manifest.fold(F.col("leaf"), F.col("path"))).where("folded = root")
    bad = out.withColumn("folded", manifest.fold(F.sha2("leaf", 256), F.col("path"))).where("folded = root")
    assert good.count() == 15_000 and bad.count() == 0


# --- files ----------------------------------------------------------------------------


def test_chunks_give_the_ids_of_the_whole():
    spec = open(queries.BYTE_VOCABULARY, encoding="utf-8").read()
    encode, library = token_files.Encoder(spec), Tokenizer.from_file(queries.BYTE_VOCABULARY)
    rnd = random.Random(4)
    parts = ["a", "b", "é", "'", "s", "'ll", " ", "  ", "\n", "\n\n", "\t", ".", "<|endoftext|>", "<|", "|>", "endoftext", "1", "²", "́", "\x1c", "\xa0", "ſ", "漢", "$", "_", "-", "\r"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(20_000)]
    texts += [f"x.{chr(c)}  y{chr(c)}\n{chr(c)}a'{chr(c)}s" for c in range(0x3100)] + ["", "z" * 100_000, "word " * 20_000]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert token_files.ids_of(encode(t)) == e.ids, t[:40]


def test_token_files(spark, docs, none, tmp_path):
    library = Tokenizer.from_file(queries.BYTE_VOCABULARY)
    folder = str(tmp_path / "tokens")
    listed = token_files.write_tokens(docs, folder, queries.BYTE_VOCABULARY, end=2, file_bytes=2000).collect()
    got = token_files.read_tokens(spark, folder).orderBy("start", "doc_id").collect()
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append(library.encode(r.text or "", add_special_tokens=False).ids + [2])
    assert len(got) == docs.count() and sum(r.documents for r in listed) == len(got)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.tokens) // 4
        ids[r.doc_id].remove(token_files.ids_of(bytes(r.tokens)))
        at += r.n_tokens
    assert not any(ids.values()) and at == sum(r.tokens for r in listed)
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    some = token_files.read_tokens(spark, folder, wanted=[3, 9, 12345]).collect()
    assert sorted((r.doc_id, r.start, bytes(r.tokens)) for r in some) == sorted((r.doc_id, r.start, bytes(r.tokens)) for r in got if r.doc_id in (3, 9))
    # Any zstandard reader unpacks a file to the ids of its documents, one after the other.
    names = sorted((r.part, r.nth, r.file) for r in listed)
    assert len(names) > 3
    plain = b""
    for _, _, name in names:
        with open(f"{folder}/data/{name}", "rb") as f:
            plain += zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert plain == b"".join(bytes(r.tokens) for r in got)
    empty = str(tmp_path / "none")
    assert token_files.write_tokens(none, empty, queries.BYTE_VOCABULARY).count() == 0
    assert token_files.read_tokens(spark, empty).count() == 0


def test_damage_is_found(spark, tmp_path):
    folder = str(tmp_path / "t")
    df = spark.createDataFrame([(f"k{i}", f"text number {i} " * 9) for i in range(40)], "doc_id string, text string").coalesce(1)
    (one,) = token_files.write_tokens(df, folder, queries.BYTE_VOCABULARY).collect()
    path = f"{folder}/data/{one.file}"
    data = bytearray(open(path, "rb").read())
    assert len(data) == one.bytes
    with open(path, "rb") as f:
        keys, entries = token_files.read_table(f, len(data))
        assert keys == sorted(f"k{i}" for i in range(40))
        content = token_files.read_frame(f, entries[7])
        assert entries[7][3] == xxhash.xxh64_intdigest(content) & 0xFFFFFFFF
        # A reader of one document touches no other frame.
        place, packed, size, _ = entries[7]
        assert zstandard.decompress(bytes(data[place : place + packed])) == content
        with pytest.raises(ValueError):
            token_files.read_frame(f, (*entries[7][:3], entries[7][3] ^ 1))
    assert struct.unpack("<I", data[-4:])[0] == token_files.SEEKABLE_END
    got = token_files.read_tokens(spark, folder, kind="string", wanted=["k7"]).collect()
    assert [r.doc_id for r in got] == ["k7"]
    with pytest.raises(ValueError):
        token_files.write_tokens(df.withColumn("doc_id", F.lit(1.5)), folder, queries.BYTE_VOCABULARY)


def test_unequal_words_have_unequal_hashes():
    from tablewright.llm import near_dups

    swap = str.maketrans("ab", "ba")
    word = "a"
    while len(word) < 2048:  # the words that defeat a polynomial modulo a power of two
        word += word.translate(swap)
    words = [word, word.translate(swap), "x" * 7, "x" * 8, "x" * 9, "x" * 7 + "y", "\0", "\0\0", "é", word + "a"]
    got = near_dups.word_hashes(" \n".join(words) + " ").tolist()
    assert len(set(got)) == len(words)
    assert [near_dups.word_hashes(w.upper() if w.isascii() else w)[0] for w in words] == got
    assert not len(near_dups.word_hashes(" \t")) and not len(near_dups.word_hashes(""))


BODY = "".join(f"<p>Sentence {i} of the article, which goes on for a while and ends here.</p>" for i in range(12))
PLAIN = "\n\n".join(f"Sentence {i} of the article, which goes on for a while and ends here." for i in range(12))
BESIDE = [
    "comments-area", "comment-list", "comments-list", "comment-thread", "replies-section", "sidebar-left", "sidebar-right",
    "site-footer-inner", "ad-slot", "ad-container", "newsletter-box", "cookie-bar", "related-posts", "share-buttons",
    "widget-area", "notice-bar", "promo-box", "popup-content",
]


@pytest.mark.parametrize("name", BESIDE)
def test_blocks_beside_the_article_go(name):
    from tablewright.llm.html_text import main_text

    page = f"<body><div class=post>{BODY}</div><div class='{name}'><p>What others say about it here.</p><p>And more of it.</p></div></body>"
    assert main_text(page) == PLAIN


@pytest.mark.parametrize("mark", ["title='a hidden gem'", "data-note='not hidden now'", "title='its role=menu item'", "class='post comments-open'",
                                  "class='content with-sidebar'", "class='ad-free'", "class=related-links-enabled"])
def test_what_stands_in_other_attributes_is_no_name(mark):
    from tablewright.llm.html_text import main_text

    assert main_text(f"<body><div {mark}>{BODY}</div></body>") == PLAIN
    assert main_text(f"<body><form action=/x><div>{BODY}</div><input name=q></form></body>") == PLAIN
    assert main_text(f"<body><div>{BODY}</div><form><label>Your name</label><input><button>Go</button></form></body>") == PLAIN


def test_damaged_markup_takes_linear_time():
    import time

    from tablewright.llm.html_text import main_text

    start = time.time()
    for page in ("<" + "a" * 1_000_000, "<a " + "b" * 1_000_000, "<div>" * 20_000 + "</span>" * 20_000, "<a '" * 200_000):
        main_text(page)
    assert time.time() - start < 20
