import random
from difflib import SequenceMatcher, get_close_matches

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tablewright.functions import similarity as sim
from tablewright.functions.grams import similar_pairs, window_pairs
from tablewright.operators import fuzzy

LETTERS = st.text("abcde ", max_size=12)


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(LETTERS, LETTERS)
def test_lcs(a, b):
    assert sim.lcs_length(a, b) == naive_lcs(a, b)


def strings(rng, n, longest, letters):
    """Random texts, some of them edited copies of others."""
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            t = list(rng.choice(out))
            for _ in range(rng.randint(0, 1 + len(t) // 5)):
                at = rng.randrange(len(t) + 1)
                if rng.random() < 0.5:
                    t.insert(at, rng.choice(letters))
                elif at < len(t):
                    del t[at]
            t = "".join(t)
        else:
            t = "".join(rng.choice(letters) for _ in range(rng.randint(1, longest)))
        out.append(t)
    return sorted(set(out) | {"", "a", "ab", "acb"})


@pytest.mark.parametrize("cutoff,longest,letters", [(0.95, 40, "abcd"), (0.895, 14, "abc"), (0.8, 20, "abcdef"), (0.6, 9, "abcd"), (0.3, 6, "abcdefg"), (1.0, 5, "ab")])
def test_similar_pairs_miss_none(spark, cutoff, longest, letters):
    texts = strings(random.Random(longest), 150, longest, letters)
    df = spark.createDataFrame([(t, t) for t in texts], "id string, form string")
    rows = [tuple(r) for r in similar_pairs(df, df, cutoff).collect()]
    want = {(a, b) for a in texts for b in texts if a and b and 2 * naive_lcs(a, b) / (len(a) + len(b)) >= cutoff - 1e-12}
    assert want <= set(rows)
    half = {tuple(r) for r in similar_pairs(df, df, cutoff, ordered=True).collect()}
    assert {(a, b) for a, b in want if a < b} <= half and all(a < b for a, b in half)


@pytest.mark.parametrize("cutoff", [0.995, 0.885, 0.7, 0.4])
def test_window_pairs_miss_none(spark, cutoff):
    texts = strings(random.Random(3), 90, 14, "abcd")
    df = spark.createDataFrame([(t, t) for t in texts], "id string, form string")
    found = {tuple(r) for r in window_pairs(df, df, cutoff).collect()}
    for a in filter(None, texts):
        for b in filter(None, texts):
            if len(a) <= len(b):
                windows = [b[i : i + len(a)] for i in range(len(b))]
                if max(2 * naive_lcs(a, w) / (len(a) + len(w)) for w in windows) >= cutoff:
                    assert (a, b) in found


def test_index_of_long_texts_stays_small(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(150)) for _ in range(300)]
    df = spark.createDataFrame([(t, t) for t in texts + [texts[0][:70] + "q" + texts[0][72:]]], "id string, form string")
    got = [tuple(r) for r in similar_pairs(df, df, 0.9, ordered=True).collect()]
    assert len(got) < 300 * 299 / 8
    assert any(a[:60] == b[:60] for a, b in got)


def test_scores():
    assert sim.ratio("CHICAGOO", "CHICAGO") == 93
    assert sim.ratio("", "x") == 0
    assert sim.partial("bolt", "thunderbolts") == 100
    assert sim.token_set("new york city", "york new") == 100
    assert sim.weighted("store", "storefront") == 90


def test_snap(spark):
    df = spark.createDataFrame([("CHICAGOO",), ("CICERO",), (None,), ("CHICAGO",)], "c string")
    once = fuzzy.snap_to(df, "c", ["CHICAGO"])
    assert [r.c for r in once.collect()] == ["CHICAGO", "CICERO", None, "CHICAGO"]
    assert [r.c for r in fuzzy.snap_to(once, "c", ["CHICAGO"]).collect()] == [r.c for r in once.collect()]


CITIES = ["CHICAGO", "OLYMPIA FIELDS", "BEDFORD PARK", "EVERGREEN"]


def best_by_hand(city):
    if "CHICAGO" in city or city.startswith("CH"):
        if sim.token_set("chicago", city.lower()) > 90:
            return "CHICAGO"
    if city in CITIES:
        return city
    tops = []
    for name in ("ratio", "partial", "token_set"):
        scored = [(sim.SCORERS[name](city, c), c) for c in CITIES]
        tops.append(max(scored, key=lambda t: t[0]))
    score, match = max(tops, key=lambda t: t[0])
    return match if score > 85 else city


def test_best_match(spark):
    names = ["CHICAGO HEIGHTS", "CHCAGO", "OLYMPIA FIELD", "BEDFORDPARK", "EVERGREEN PARK", "CICERO", "CHESTERTON", "FIELDS"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    got = fuzzy.best_match(df.selectExpr("c as k", "c"), "c", CITIES, dominant=("CHICAGO", "CH"))
    assert {r.k: r.c for r in got.collect()} == {n: best_by_hand(n) for n in names}


def words(rng, n):
    stems = ["restaurant", "children's", "grocery", "facility", "store", "kitchen", "tavern"]
    out = []
    for _ in range(n):
        w = rng.choice(stems)
        kind = rng.random()
        at = rng.randrange(len(w) - 1)
        if kind < 0.2:
            w = w[:at] + w[at + 1 :]
        elif kind < 0.4:
            w = w[:at] + w[at + 1] + w[at] + w[at + 2 :]
        elif kind < 0.5:
            w += rng.choice(["front", "s", "'s", "house"])
        out.append(w)
    return out


@pytest.mark.parametrize("threshold", [95, 90, 86, 80, 60])
def test_typos_equal_brute_force(spark, threshold):
    rng = random.Random(3)
    texts = [" ".join(words(rng, 4)) for _ in range(150)] + ["1234 12 abc", None]
    blob = "".join(rng.choice("abcdefgh") for _ in range(60))
    texts += [blob] * 10 + [blob[:30] + "q" + blob[30:], blob + blob[::-1], "store" * 300, "k" * 3000]
    texts += ["rock'n'roll o'cl'ock's'd"] * 10 + ["roll'n'rock ock's'cl'o'd rollin'rock'n'rolls s'rabbit s'children x's"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    counts = {r.word: r.n for r in fuzzy.token_counts(df, "t").collect()}
    common = sorted(w for w, n in counts.items() if n >= 10)
    expected = {}
    for w, n in counts.items():
        if n < 10:
            top = max(common, key=lambda c: sim.SCORERS["weighted"](w, c))
            if sim.SCORERS["weighted"](w, top) >= threshold and w[0] == top[0]:
                expected[w] = top
    got = {r.typo: r.correction for r in fuzzy.detect_typos(df, "t", threshold=threshold).collect()}
    assert got == expected and len(got) > 10


def test_close_matches_equal_brute_force(spark):
    rng = random.Random(5)
    values = sorted(set(words(rng, 120)) | {"a", "ab", "abc", "abcd"})
    df = spark.createDataFrame([(v,) for v in values] * 2, "v string")
    got = {}
    for r in fuzzy.close_matches(df, "v", 0.8, 3).collect():
        got.setdefault(r.value, set()).add((round(r.ratio, 9)))
    for v in values:
        near = [m for m in get_close_matches(v, values, n=4, cutoff=0.8) if m != v][:3]
        expected = {round(SequenceMatcher(None, m, v).ratio(), 9) for m in near}
        assert got.get(v, set()) == expected


def test_compare_columns(spark):
    rows = [("Abc", "aBC", 1.0, "similar"), ("x", None, 0.0, "missing"), ("abcde", "abcdx", 0.8, "some_similarity"),
            ("abc", "xyz", 0.0, "missing")]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    out = fuzzy.compare_columns(df, "a", "b", fill_missing=False).collect()
    assert [(r.similarity, r.relationship) for r in out] == [r[2:] for r in rows]
    summary = fuzzy.comparison_summary(fuzzy.compare_columns(df, "a", "b"), "a", "b").first()
    assert (summary.missing_initial, summary.missing_filled, summary.exact_matches, summary.similar_count) == (1, 1, 1, 3)


def test_cluster_corrections(spark):
    names = ["CHICAGO", "CHICAGOO", "CCHICAGO", "OLYMPIA FIELDS", "OLYMPIA FIELD", "EVERGREEN", "CICERO", "BEDFORD PARK"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    found = {r.typo: r.correction for r in fuzzy.cluster_corrections(df, "c", CITIES, k=4).collect()}
    assert all(sim.SCORERS["token_set"](t, c) > 85 and c in CITIES for t, c in found.items())
    assert found.get("CHICAGOO", "CHICAGO") == "CHICAGO"
    lonely = spark.createDataFrame([("x",)], "c string")
    assert fuzzy.cluster_corrections(lonely, "c", CITIES).count() == 0


def test_equal_rows_keep_their_own_corrected_words(spark):
    from tablewright.operators import fuzzy

    df = spark.createDataFrame([("red bolt",), ("red bolt",), (None,), ("",)], "`t.x` string")
    fixes = spark.createDataFrame([("red", "crimson")], "typo string, correction string")
    by_frame = fuzzy.correct_words(df.toDF("t"), "t", fixes).collect()
    by_dict = fuzzy.correct_words(df.toDF("t"), "t", {"red": "crimson"}).collect()
    assert sorted(map(str, by_frame)) == sorted(map(str, by_dict))
    assert [r["t"] for r in by_frame].count("crimson bolt") == 2


def test_a_dot_in_a_column_name(spark):
    from tablewright.functions.frames import map_values

    df = spark.createDataFrame([("a", 1), ("b", 2)], "`t.x` string, n int")
    out = map_values(df, "t.x", lambda v: v.selectExpr("__old", "upper(__old) as __new"))
    assert sorted(r["t.x"] for r in out.collect()) == ["A", "B"] and out.columns == ["t.x", "n"]


def test_only_like_texts_meet(spark):
    """Texts that are far apart make no candidates, however many share their rarest letters."""
    from hashlib import md5

    whole = [md5(str(i).encode()).hexdigest() for i in range(1500)]
    texts = whole + [w[:4] + w[5:] for w in whole]
    df = spark.createDataFrame([(t, t) for t in texts], "id string, form string")
    got = {tuple(r) for r in similar_pairs(df, df, 0.95, ordered=True).collect()}
    assert got == {tuple(sorted(p)) for p in zip(whole, texts[1500:])}
    words = spark.createDataFrame([(w, w) for w in ["store", "storefront", "torestore", "rotes", "stores", "tore stone"]], "id string, form string")
    inside = {tuple(r) for r in window_pairs(words.where("id = 'store'"), words, 0.995, 4, 1.5).collect()}
    assert inside == {("store", "storefront"), ("store", "torestore")}


def best_common(texts, min_count, threshold):
    """``(typo, correction)`` by brute force; texts of words between blanks."""
    counts = {}
    for w in " ".join(texts).lower().split():
        counts[w] = counts.get(w, 0) + 1
    common, out = sorted(w for w, n in counts.items() if n >= min_count), {}
    for w, n in counts.items():
        if n < min_count:
            top = max(common, key=lambda c: sim.SCORERS["weighted"](w, c))
            if sim.SCORERS["weighted"](w, top) >= threshold and w[0] == top[0]:
                out[w] = top
    return out


@pytest.mark.parametrize("most_common", [False, True])
@pytest.mark.parametrize("bits,in_memory", [(28, 1 << 25), (9, 0)])
def test_short_words_meet_by_their_keys_alone(spark, monkeypatch, most_common, bits, in_memory):
    """Words of a few syllables share pieces with nearly all others: none is compared with another one,
    whichever side has more words, whether the filter tells anything and whether words are looked up in memory."""
    from tablewright.functions import spellings

    def never(*args, **kwargs):
        raise AssertionError("compared")

    for name in ("similar_pairs", "window_pairs"):
        monkeypatch.setattr(fuzzy, name, never)
    monkeypatch.setattr(fuzzy.sim, "score", never)
    monkeypatch.setattr(fuzzy, "LOOKED_UP_BYTES", in_memory)
    monkeypatch.setattr(spellings, "LEAST_BITS", 9)
    monkeypatch.setattr(spellings, "MOST_BITS", bits)
    rng = random.Random(7)
    syllables = ["the", "an", "tion", "ing", "ä", "𝒳y", "lich", "a", "ss", "0"]
    some = ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 7))) for _ in range(700)]
    some += [w[:i] + rng.choice("aäns") + w[i + rng.randint(0, 1) :] for w in some[:300] for i in [rng.randrange(1, len(w))]]
    some = sorted({w for w in some if 4 <= len(w) <= 20})
    rng.shuffle(some)
    cut = 500 if most_common else 200
    texts = [" ".join(some[:cut])] * 10 + [" ".join(some[cut:])]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.typo: r.correction for r in fuzzy.detect_typos(df, "t").collect()}
    expected = best_common(texts, 10, 90)
    assert got == expected and len(got) > 50


def test_a_mark_inside_a_word_is_a_blank_to_the_score(spark):
    """The lower case of a dotted capital I is two characters, the second of which is no letter."""
    texts = ["İstanbulular Anstanbulular rock's'roll"] * 10 + ["İstanbulula İstanbulularx stanbulular rocks'roll"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.typo: r.correction for r in fuzzy.detect_typos(df, "t").collect()}
    assert got == best_common(texts, 10, 90) and len(got) > 2
