"""Fuzzy text matching.

Values are made distinct first, candidate pairs come from equi-joins on blocking keys
that miss no qualifying pair, and only then a score is computed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations
from math import ceil

from pyspark import Broadcast
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import similarity as sim
from tablewright.functions import text
from tablewright.functions.frames import is_small, kept_table, lookup, map_values
from tablewright.functions.grams import NEAR, similar_pairs, window_pairs
from tablewright.functions.spellings import Reach, key_filter, keys_passing, meeting_keys, number_of_keys, stretches, wholes


# Starts of the clustering.
STARTS = 10
# Letters of the longest grams by which windows are found.
WINDOW_GRAM = 4
# Bytes of the common words, as text, that are looked up in memory by the stretches of rare ones.
LOOKED_UP_BYTES = 32 << 20
# Bits of a word's place in the alphabet, below its score's distance from 100 in the same number.
PLACES = 50


def _table(df: DataFrame, mapping: Mapping[str, str] | DataFrame) -> DataFrame:
    """A correction dictionary as a frame ``(typo, correction)``."""
    if isinstance(mapping, DataFrame):
        return mapping.select("typo", "correction")
    rows = list(mapping.items())
    return df.sparkSession.createDataFrame(rows, "typo string, correction string")


# --- words and corrections --------------------------------------------------------


def token_counts(df: DataFrame, column: str, min_len: int = 4) -> DataFrame:
    """Lower-case words of at least ``min_len`` letters that are not plain numbers."""
    words = df.select(F.explode(text.words(F.col(column))).alias("w"))
    kept = words.where((F.length("w") >= min_len) & ~F.col("w").rlike(r"^\p{Nd}+$"))
    return kept.groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"))


def detect_typos(
    df: DataFrame,
    column: str,
    min_len: int = 4,
    min_count: int = 10,
    threshold: int = 90,
    known: Mapping[str, str] | None = None,
) -> DataFrame:
    """``(typo, correction)``: rare words close to a common one with the same first letter.

    The best common word is taken first, ties to the alphabetically first, and the letter is
    tested after.  Any threshold above 0 may be asked for: each part of the weighted score sets
    a bound of its own for the pairs that can reach it (``_keyed``, ``_typo_candidates``).
    """
    words = token_counts(df, column, min_len).select("word", "n", _plain("word").alias("plain")).persist()
    held: list[Broadcast | DataFrame] = []
    try:
        rare, common = words.where(F.col("n") < min_count), words.where(F.col("n") >= min_count)
        if known:
            rare = rare.where(~F.col("word").isin(list(known)))
        close = _best_common(rare, common, threshold, held)
        close = close.where((F.col("score") >= threshold) & (F.substring("rare", 1, 1) == F.substring("common", 1, 1)))
        found = kept_table(close.select(F.col("rare").alias("typo"), F.col("common").alias("correction")))
    finally:
        words.unpersist()
        for sent in held:
            sent.unpersist()
    return found.union(_table(df, known)) if known else found


def _plain(word: str) -> Column:
    """What the scorer sees of a word: blanks for all but letters, digits and ``_``."""
    return F.trim(F.regexp_replace(word, r"[^\p{L}\p{N}_]", " "))


def _need(threshold: float, scale: float) -> float | None:
    """The share of letters a part of the score must match for ``scale`` times it to reach the threshold."""
    points = ceil((threshold - 0.5) / scale - 1e-9)
    return (points - 0.5) / 100 if points <= 100 else None


def _orders(tokens: Column) -> Column:
    """A text's words in every order, for up to three; sorted letters for more are made elsewhere."""
    def joined(*at: int) -> Column:
        return F.concat_ws(" ", *[F.get(tokens, F.lit(i)) for i in at])

    by_size = {n: F.array(*[joined(*p) for p in permutations(range(n))]) for n in (1, 2, 3)}
    out = F.array().cast("array<string>")
    for n, forms in by_size.items():
        out = F.when(F.size(tokens) == n, forms).otherwise(out)
    return out


def _forms(side: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, form)``: texts as they are, and by their words in any order."""
    tokens = F.split("plain", r"\s+")
    made = F.array_union(F.array(F.col("plain"), F.array_join(F.array_sort(tokens), " ")), _orders(F.array_distinct(tokens)))
    return side.select(*keep, F.explode(F.when(_single("plain"), F.array("plain")).otherwise(made)).alias("form"))


def _single(plain: str) -> Column:
    return ~F.contains(F.col(plain), F.lit(" "))


def _typo_candidates(rare: DataFrame, common: DataFrame, threshold: float, reach: Reach, most: int, longest: int) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """``(pairs, rare, common)`` with pairs ``(id, other)``, some more than once: every pair whose weighted score may
    reach the threshold and that meets neither by its keys (``_keyed``) nor by ``_shared_words``, with the words it
    is of.

    - Whole texts longer than ``reach`` serves, as they are or by words in any order: pairs of like forms.
    - One at least 1.5 times as long, and the shorter one longer than ``reach`` serves or not one word each:
      the shorter against windows of the longer one.

    ``most`` is the number of words of a text, ``longest`` that of letters, at most.
    """
    c, window = _need(threshold, 1.0), _need(threshold, 0.9)
    tokens = F.split("plain", r"\s+")
    distinct = F.array_distinct(tokens)
    n, single = F.length("plain"), _single("plain")

    def letters(side: DataFrame) -> DataFrame:
        """Letters in order: what two texts share of them bounds every order of their words."""
        texts = F.array_distinct(F.array(F.col("plain"), F.array_join(distinct, " ")))
        one_each = side.select("id", F.explode(texts).alias("text"))
        return one_each.select("id", F.array_join(F.array_sort(F.split("text", "")), "").alias("form"))

    def inside(left: DataFrame, right: DataFrame, size: int) -> list[DataFrame]:
        times = 1.5 if most == 1 else 1.0  # a text's forms may be shorter than itself
        turned = window_pairs(right, left, window, size, times)
        return [window_pairs(left, right, window, size, times), turned.select(F.col("other").alias("id"), F.col("id").alias("other"))]

    found, edge = [], reach.longest
    low = ceil((edge + 1) * (c / (2 - c)) - NEAR)
    if longest > edge:
        left, right = rare.where(n >= low), common.where(n >= low)
        found.append((similar_pairs(_forms(left, "id"), _forms(right, "id"), c), left, right))
    if window and longest > 1.5 * reach.inside:
        left, right = rare.where(n > reach.inside), common.where(n > reach.inside)
        found += [(p, left, right) for p in inside(_forms(left, "id"), _forms(right, "id"), WINDOW_GRAM)]
    if most > 1 and window and _need(threshold, 0.9 * 0.95):
        for left, right in ((rare.where(~single), common), (rare.where(single), common.where(~single))):
            found += [(p, left, right) for p in inside(_forms(left, "id"), _forms(right, "id"), WINDOW_GRAM)]
    if most > 3:
        many = F.size(distinct) > 3
        for left, right in ((rare.where(many), common), (rare, common.where(many))):
            pairs = [similar_pairs(letters(left), letters(right), c)] + (inside(letters(left), letters(right), 1) if window else [])
            found += [(p, left, right) for p in pairs]
    return found


def _shared_words(rare: DataFrame, common: DataFrame, threshold: float) -> DataFrame:
    """``(id, other)``: pairs that the words they share may lift to the threshold (texts with apostrophes only).

    The shared words may make up most of a text, or, beside a much longer one, score by themselves
    whatever the rest.
    """
    tokens = F.array_distinct(F.split("plain", r"\s+"))

    def parts(side: DataFrame, name: str) -> DataFrame:
        made = side.select(F.col("id").alias(name), "word", F.length("plain").alias("n"), F.size(tokens).alias("parts"), F.explode(tokens).alias("part"))
        return made.withColumnsRenamed({c: f"{name}_{c}" for c in ("word", "n", "parts")})

    a, b = parts(rare, "id"), parts(common, "other")
    out = None
    need = _need(threshold, 0.95)
    if need:
        # The longest shared word is this long at least, if the shared ones make up enough of a text.
        def long_enough(name: str) -> Column:
            return F.length("part") + 1 >= (F.col(f"{name}_n") * (need / (2 - need)) + 1) / F.col(f"{name}_parts") - 1e-9

        out = a.where(long_enough("id")).join(b, "part").select("id", "other")
        out = out.union(a.join(b.where(long_enough("other")), "part").select("id", "other"))
    # A much longer text that holds one of the words scores alike whatever it is: of each length
    # the first in the alphabet stands for all.
    first = b.groupBy("part", "other_n").agg(F.min_by("other", "other_word").alias("other"))
    spread = F.greatest("id_n", "other_n") / F.least("id_n", "other_n")
    for scale, fits in ((0.9, (spread >= 1.5) & (spread <= 8)), (0.6, spread > 8)):
        if _need(threshold, scale * 0.95):
            more = a.join(first, "part").where(fits).select("id", "other")
            out = more if out is None else out.union(more)
    return a.join(b, "part").select("id", "other").limit(0) if out is None else out


def _packed(score: Column, place: Column) -> Column:
    """One number, the less the better the score and then the earlier the place."""
    return F.shiftleft((100 - score).cast("long"), PLACES) + place


def _keyed(rare: DataFrame, placed: DataFrame, reach: Reach, most: int, held: list[Broadcast | DataFrame]) -> DataFrame:
    """``(rare, packed, places)``: of the pairs that meet by what is left of them (``spellings``) the best one of single
    words, and the places of the common words to be scored where either is none.  ``placed`` is ``(word, plain, place)``."""
    many = ~_single("plain")

    def forms(side: DataFrame, ref: str) -> DataFrame:
        made = _forms(side.select(F.col(ref).alias("ref"), many.alias("many"), "plain"), "ref", "many", "plain")
        return made.withColumn("whole", F.col("form") == F.col("plain"))

    left, right = forms(rare, "word"), forms(placed, "place")
    theirs = [F.col("ref").alias("place"), F.col("many").alias("many_b")]
    a, b = meeting_keys(left, right, reach, held)
    # Both sides are many times what the planner takes them for: never broadcast.
    met = a.hint("merge").join(b.select("key", "kind", *theirs), ["key", "kind"]).drop("kind")
    if reach.inside:
        texts = right.where("whole").select(F.col("form").alias("key"), *theirs)
        held.append(table := key_filter(right, wholes, reach, number_of_keys(right, wholes, reach)))
        inside = keys_passing(left, stretches, reach, table).drop("kind")
        met = met.unionByName(inside.join(F.broadcast(texts) if is_small(texts, LOOKED_UP_BYTES) else texts, "key"))
    met, packed = met.withColumnRenamed("ref", "rare"), _packed(F.col("score"), F.col("place"))
    if most == 1:
        return met.groupBy("rare").agg(F.min(packed).alias("packed"), F.lit(None).cast("array<bigint>").alias("places"))
    sure = ~F.col("many") & ~F.col("many_b")
    return kept_table(met.groupBy("rare").agg(F.min(F.when(sure, packed)).alias("packed"), F.collect_set(F.when(~sure, F.col("place"))).alias("places")))


def _best_common(rare: DataFrame, common: DataFrame, threshold: float, held: list[Broadcast | DataFrame]) -> DataFrame:
    """``(rare, common, score)``: the best common word of each rare one that has any in reach."""
    n = F.length("plain")
    size = rare.unionByName(common).agg(F.max(F.size(F.split("plain", r"\s+"))).alias("most"), F.min(n).alias("least"), F.max(n).alias("longest")).first()
    most, least, longest = size["most"] or 1, size["least"] or 1, size["longest"] or 0
    reach = Reach(_need(threshold, 1.0), _need(threshold, 0.9), bool(_need(threshold, 0.6)), most > 1, least)
    placed = kept_table(common.sort("word").select("word", "plain", F.monotonically_increasing_id().alias("place")))
    names = placed.select("place", F.col("word").alias("common"))

    met = _keyed(rare, placed, reach, most, held)
    place, score = F.expr(f"packed & {(1 << PLACES) - 1}L"), (100 - F.shiftright("packed", PLACES)).cast("double")
    best = met.where("packed is not null").select("rare", place.alias("place"), score.alias("score"))
    best = lookup(best, names, ["place"]).select("rare", "common", "score")

    ids = F.unhex(F.md5("word")).alias("id")
    rare, common = rare.select("word", "plain", ids), common.select("word", "plain", ids)
    pairs = []
    if most > 1:
        pairs.append(lookup(met.select("rare", F.explode("places").alias("place")), names, ["place"]).select("rare", "common"))
        shared = _shared_words(rare.withColumn("id", F.col("word")), common.withColumn("id", F.col("word")), threshold)
        pairs.append(shared.toDF("rare", "common"))
    for found, left, right in _typo_candidates(rare, common, threshold, reach, most, longest):
        told = lookup(found, left.select("id", F.col("word").alias("rare")), ["id"])
        told = lookup(told, right.select(F.col("id").alias("other"), F.col("word").alias("common")), ["other"])
        pairs.append(told.select("rare", "common"))
    if not pairs:
        return best
    every = best.unionByName(_scored(reduce(DataFrame.unionByName, pairs), threshold))
    top = every.groupBy("rare").agg(F.min(F.struct((-F.col("score")).alias("score"), "common")).alias("t"))
    return top.select("rare", F.col("t.common").alias("common"), (-F.col("t.score")).alias("score"))


def _scored(pairs: DataFrame, threshold: float) -> DataFrame:
    """``(rare, common, score)`` of the pairs ``(rare, common)`` that may reach the threshold."""
    told = pairs.withColumns({"a": _plain("rare"), "b": _plain("common")})
    la, lb = F.length("a"), F.length("b")
    short, long = F.when(la <= lb, F.col("a")).otherwise(F.col("b")), F.when(la <= lb, F.col("b")).otherwise(F.col("a"))
    spread = F.greatest(la, lb) / F.least(la, lb)
    single = _single("a") & _single("b")
    wide, inside = single & (spread >= 1.5), F.contains(long, short)
    # Of two single words one inside the other scores all of the window's share, and no more.
    told = told.withColumn("sure", F.when(wide & inside, F.when(spread <= 8, 90.0).otherwise(60.0)))
    # One word that may leave no letter out must be inside the other; two of like lengths are no
    # more edits apart than letters may stay unmatched.
    whole, window = _need(threshold, 1.0), _need(threshold, 0.9) or 1.0
    hopeless = wide & ~inside & (F.least(la, lb) * (2 * (1 - window) / (2 - window)) < 1) & F.lit(whole > 0.8)
    far = single & ~wide & (F.levenshtein("a", "b") > (la + lb) * (1 - whole) + 1e-9)
    told = told.where(~(hopeless | far))
    told = told.select("rare", "common", "sure").distinct()
    unsure = F.when(F.col("sure").isNull(), F.col("rare"))
    score = F.coalesce("sure", sim.score("weighted", unsure, F.col("common")))
    return told.select("rare", "common", score.alias("score"))


def correct_words(
    df: DataFrame, column: str, mapping: Mapping[str, str] | DataFrame
) -> DataFrame:
    """Replace whole words; words with an apostrophe stay.  Words are joined by blanks."""
    tokens = text.words(F.col(column))
    if not isinstance(mapping, DataFrame):
        pairs = [F.lit(x) for kv in mapping.items() for x in kv]
        if not pairs:
            return df.withColumn(column, F.array_join(tokens, " "))
        known = F.create_map(*pairs)

        def fix(w: Column) -> Column:
            hit = F.try_element_at(known, w)
            return F.when(w.contains("'"), w).otherwise(F.coalesce(hit, w))

        return df.withColumn(column, F.array_join(F.transform(tokens, fix), " "))
    # Distinct texts are taken apart and put together again, so equal rows cannot merge.
    fixes = _table(df, mapping).where(~F.col("typo").contains("'"))

    def rebuilt(values: DataFrame) -> DataFrame:
        words = F.posexplode_outer(text.words(F.col("__old"))).alias("__pos", "typo")
        fixed = lookup(values.select("__old", words), fixes, ["typo"])
        word = F.struct("__pos", F.coalesce("correction", "typo").alias("w"))
        back = fixed.groupBy("__old").agg(F.array_sort(F.collect_list(word)).alias("__ws"))
        return back.select("__old", F.array_join(F.transform("__ws", lambda w: w["w"]), " ").alias("__new"))

    return map_values(df, column, rebuilt)


def apply_corrections(
    df: DataFrame,
    column: str,
    mapping: Mapping[str, str] | DataFrame,
    level: str = "value",
) -> DataFrame:
    """Correct whole values, or word by word, through the distinct values."""
    if level == "token":
        return correct_words(df, column, mapping)
    table = _table(df, mapping)

    def make(values: DataFrame) -> DataFrame:
        return lookup(values.withColumn("typo", F.col("__old")), table, ["typo"]).select(
            "__old", F.coalesce("correction", "__old").alias("__new")
        )

    return map_values(df, column, make)


# --- canonical values -------------------------------------------------------------


def snap_to(
    df: DataFrame, column: str, canonical: Sequence[str], threshold: int = 85
) -> DataFrame:
    """Canonical value if its ratio reaches ``threshold``, else the value itself."""

    def make(values: DataFrame) -> DataFrame:
        best = sim.best_of(F.col("__old"), list(canonical), ["ratio"])
        scored = values.withColumn("b", best)
        new = F.when(F.col("b.score") >= threshold, F.col("b.match")).otherwise(F.col("__old"))
        return scored.select("__old", new.alias("__new"))

    return map_values(df, column, make)


def _best_match(
    value: Column, valid: Sequence[str], threshold: int, dominant: tuple[str, str] | None
) -> Column:
    """Best of three scorers; the dominant value has a rule of its own."""
    best = sim.best_of(value, list(valid), ["ratio", "partial", "token_set"])
    chosen = F.when(value.isin(list(valid)), value).when(best["score"] > threshold, best["match"])
    if dominant:
        name, prefix = dominant
        special = (value.contains(name) | value.startswith(prefix)) & (
            sim.score("token_set", F.lit(name), value) > 90
        )
        return F.when(special, F.lit(name)).otherwise(chosen.otherwise(value))
    return chosen.otherwise(value)


def best_match(
    df: DataFrame,
    column: str,
    valid: Sequence[str],
    threshold: int = 85,
    dominant: tuple[str, str] | None = None,
) -> DataFrame:
    """Best canonical value over three scorers; ``dominant`` is ``(value, prefix)``."""

    def make(values: DataFrame) -> DataFrame:
        new = _best_match(F.col("__old"), valid, threshold, dominant)
        return values.select("__old", new.alias("__new"))

    return map_values(df, column, make)


# --- clusters ---------------------------------------------------------------------


def _grams(c: Column, n: tuple[int, int]) -> Column:
    """Character n-grams of a lower-case text, repeats kept."""
    low = F.lower(c)
    none = F.array().cast("array<string>")

    def of(k: int) -> Column:
        at = F.sequence(F.lit(1), F.length(low) - (k - 1))
        return F.when(
            F.length(low) >= k, F.transform(at, lambda i: F.substring(low, i, k))
        ).otherwise(none)

    return F.flatten(F.array(*[of(k) for k in range(n[0], n[1] + 1)]))


def char_tfidf(
    df: DataFrame, column: str, n: tuple[int, int] = (2, 3), min_df: int = 2
) -> DataFrame:
    """``(value, term, weight)``: smoothed, length-normalised TF-IDF of distinct values."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    tf = (
        values.select("value", F.explode(_grams(F.col("value"), n)).alias("term"))
        .groupBy("value", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    docs = values.agg(F.count(F.lit(1))).scalar()
    idf = (
        tf.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
        .where(F.col("df") >= min_df)
        .select("term", (F.log((docs + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    )
    raw = tf.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    # One value holds only its own grams, so the norm window stays small.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("value")))
    return raw.select("value", "term", (F.col("w") / norm).alias("weight"))


def tfidf_model(
    values: DataFrame, column: str, n: tuple[int, int] = (2, 3), min_df: int = 2
) -> tuple[PipelineModel, DataFrame]:
    """The same weights as vectors: fitted stages and the frame with ``features``.

    The vocabulary goes to the driver: no more than the alphabet allows, uncut.
    """
    grams = values.withColumn("__grams", _grams(F.col(column), n))
    counting = CountVectorizer(
        inputCol="__grams", outputCol="__tf", minDF=float(min_df), vocabSize=(1 << 31) - 1
    ).fit(grams)
    counted = counting.transform(grams)
    idf = IDF(inputCol="__tf", outputCol="__idf").fit(counted)
    scale = ElementwiseProduct(
        inputCol="__tf", outputCol="__w", scalingVec=Vectors.dense(idf.idf.toArray() + 1.0)
    )
    norm = Normalizer(inputCol="__w", outputCol="features", p=2.0)
    model = Pipeline(stages=[scale, norm]).fit(counted)
    return model, model.transform(counted).select(column, "features")


def cluster_values(
    df: DataFrame, column: str, k: int | None = None, seed: int = 42
) -> DataFrame:
    """``(value, cluster)`` for the distinct values, by k-means on their TF-IDF vectors.

    Of ``STARTS`` runs, each until it settles, the one of least cost counts.
    """
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    values = values.persist()
    n = values.count()
    k = min(k or min(50, max(5, n // 5)), n)
    if k < 2 or not char_tfidf(values, "value").limit(1).count():
        # Nothing to tell values apart by: no clusters.
        return values.limit(0).withColumn("cluster", F.lit(0))
    _, vectors = tfidf_model(values, "value")
    vectors = vectors.persist()
    start = KMeans(k=k, maxIter=300, featuresCol="features", predictionCol="cluster")
    models = [start.copy({start.seed: seed + i}).fit(vectors) for i in range(STARTS)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(vectors).select("value", "cluster")


def cluster_corrections(
    df: DataFrame,
    column: str,
    valid: Sequence[str],
    threshold: int = 85,
    dominant: tuple[str, str] | None = None,
    k: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """``(typo, correction)``: members of a cluster close to its base value.

    The base is the longest valid member, else the best match of any member.
    """
    clusters = cluster_values(df, column, k, seed)
    match = _best_match(F.col("value"), valid, threshold, dominant)
    scored = clusters.withColumns(
        {"is_valid": F.col("value").isin(list(valid)), "match": match}
    ).withColumn("match_score", sim.score("token_set", F.col("value"), F.col("match")))
    matched = ~F.col("is_valid") & (F.col("match") != F.col("value"))
    base = (
        scored.groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.min_by(
                F.when(F.col("is_valid"), F.col("value")),
                F.when(F.col("is_valid"), F.struct(-F.length("value"), F.col("value"))),
            ).alias("longest"),
            F.min_by(
                F.when(matched, F.col("match")),
                F.when(matched, F.struct(-F.col("match_score"), F.col("value"))),
            ).alias("nearest"),
        )
        .where("members >= 2")
        .select("cluster", F.coalesce("longest", "nearest").alias("correction"))
        .where("correction is not null")
    )
    # At most k bases: one row per cluster.
    pairs = clusters.join(F.broadcast(base), "cluster").where("value != correction")
    score = sim.score("token_set", F.col("value"), F.col("correction"))
    return pairs.where(score > threshold).select(
        F.col("value").alias("typo"), "correction"
    )


# --- pairs ------------------------------------------------------------------------


def compare_columns(
    df: DataFrame, a: str, b: str, threshold: float = 0.8, fill_missing: bool = True
) -> DataFrame:
    """Adds ``similarity`` and ``relationship`` of two columns; ``b`` may be filled from ``a``.

    The distinct pairs of different values are scored, once each, and joined back; equal and
    missing pairs take no part.
    """
    was_missing = F.col(b).isNull()
    out = df.withColumn("missing_initial", was_missing)
    if fill_missing:
        out = out.withColumn(b, F.coalesce(F.col(b), F.col(a)))
    same = F.lower(F.col(a)) == F.lower(F.col(b))
    out = out.withColumns({"__a": F.when(~same, F.col(a)), "__b": F.when(~same, F.col(b))})
    pairs = out.select("__a", "__b").where("__a is not null and __b is not null").distinct()
    scored = pairs.withColumn("__s", sim.score("matcher", F.col("__a"), F.col("__b")))
    out = lookup(out, scored, ["__a", "__b"])
    similarity = F.when(same, F.lit(1.0)).otherwise(F.coalesce("__s", F.lit(0.0)))
    out = out.withColumn("similarity", similarity).drop("__a", "__b", "__s")
    return out.withColumn("relationship", relationship(F.col("similarity"), threshold))


def relationship(score: Column, threshold: float = 0.8) -> Column:
    """Right-closed bins: a score equal to ``threshold`` is ``some_similarity``."""
    return (
        F.when(score <= 0, "missing")
        .when(score <= 0.1, "different")
        .when(score <= threshold, "some_similarity")
        .otherwise("similar")
    )


def comparison_summary(
    compared: DataFrame, a: str, b: str, threshold: float = 0.8, filled: bool = True
) -> DataFrame:
    missing = F.count_if(F.col("missing_initial"))
    return compared.agg(
        missing.alias("missing_initial"),
        (missing if filled else F.lit(0).cast("long")).alias("missing_filled"),
        F.count_if(F.col(a) == F.col(b)).alias("exact_matches"),
        F.count_if(F.col("similarity") >= threshold).alias("similar_count"),
        F.avg("similarity").alias("avg_similarity"),
    )


def close_matches(
    df: DataFrame,
    column: str,
    cutoff: float = 0.8,
    n: int = 5,
    queries: DataFrame | None = None,
) -> DataFrame:
    """``(value, match, ratio, rank)``: the ``n`` closest other values per distinct value.

    ``queries`` (one column of the same name) limits the values searched for.  A block
    ratio is never above the letter-wise one, so the candidates of ``similar_pairs`` miss no pair.
    """
    values = df.select(F.col(column).alias("v")).where("v is not null").distinct()
    texts = values.select(F.unhex(F.md5("v")).alias("id"), F.col("v").alias("form"))
    if queries is None:
        once = similar_pairs(texts, texts, cutoff, ordered=True)
        pairs = once.distinct().select(F.inline(F.array(F.struct("id", "other"), F.struct(F.col("other").alias("id"), F.col("id").alias("other")))))
    else:
        asked = queries.select(F.col(column).alias("form")).where("form is not null").distinct()
        asked = asked.select(F.unhex(F.md5("form")).alias("id"), "form")
        pairs = similar_pairs(asked, texts, cutoff).where("id != other").distinct()
        texts = texts.union(asked).distinct()
    told = lookup(pairs, texts.select("id", F.col("form").alias("value")), ["id"])
    told = lookup(told, texts.select(F.col("id").alias("other"), F.col("form").alias("match")), ["other"])
    # As many edits as unmatched letters at most: most candidates need no score.
    edits = (F.length("value") + F.length("match")) * (1 - cutoff) + 1e-9
    told = told.where(F.levenshtein("value", "match") <= edits)
    ratio = sim.score("matcher_raw", F.col("match"), F.col("value"), cutoff)
    scored = told.select("value", "match", ratio.alias("ratio")).where(F.col("ratio") >= cutoff)
    # rank <= n is pushed below the shuffle, so a value with many matches sends n rows.
    order = Window.partitionBy("value").orderBy(F.desc("ratio"), F.desc("match"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


# --- frequency reports ------------------------------------------------------------


def term_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Count, rarity weight and single-use flag per trimmed, non-empty value."""
    term = F.trim(F.col(column).cast("string"))
    counts = df.select(term.alias("term")).where("term != ''").groupBy("term")
    return counts.agg(F.count(F.lit(1)).alias("n")).select(
        "term",
        "n",
        F.greatest(F.lit(1), 10 - F.col("n")).cast("long").alias("rarity"),
        (F.col("n") <= 1).alias("single_use"),
    )


def top_terms(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return term_frequencies(df, column).orderBy(F.desc("n"), "term").limit(k)


def _ranked(df: DataFrame, column: str, k: int, prefix: str) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v"))
    top = counts.agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "__v").limit(k)
    # k rows only: numbering them in one task is fine.
    rank = F.row_number().over(Window.orderBy(F.desc("__n"), "__v"))
    return top.select(
        rank.alias("rank"),
        F.col("__v").alias(f"{prefix}_value"),
        F.col("__n").alias(f"{prefix}_count"),
    )


def compare_top(df: DataFrame, before: str, after: str, k: int = 20) -> DataFrame:
    """The ``k`` most frequent values of two columns, side by side by rank."""
    left, right = _ranked(df, before, k, "before"), _ranked(df, after, k, "after")
    return left.join(right, "rank", "full")


def change_impact(df: DataFrame, before: str, after: str, k: int = 20) -> DataFrame:
    """The ``k`` changes that touch most rows."""
    changed = df.where(F.col(before) != F.col(after)).groupBy(before, after)
    counts = changed.agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), before, after).limit(k)


def term_containment(
    df: DataFrame, column: str, groups: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Rows whose value contains a term, ignoring case, per (group, term).

    All terms are counted in one pass over the rows.
    """
    terms = [(g, t) for g, ts in groups.items() for t in ts]
    low = F.lower(F.col(column))
    counts = df.agg(
        *[F.count_if(low.contains(t.lower())).alias(f"t{i}") for i, (_, t) in enumerate(terms)]
    )
    rows = [
        F.struct(F.lit(g).alias("group_name"), F.lit(t).alias("term"), F.col(f"t{i}").alias("n"))
        for i, (g, t) in enumerate(terms)
    ]
    return counts.select(F.inline(F.array(*rows)))
