"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived that every match satisfies.
Postings tell which texts hold which of these trigrams; intersecting and uniting them gives
the candidates of each rule, whose texts are then searched with the pattern itself.  A rule
without a mandatory trigram is searched in every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import col, fresh, let, table, whole, written


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping; ``group``, if any, needs ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def native(self) -> str:
        """The pattern for Java, where a repeated group takes stack for each round unless it gives nothing back."""
        return self.pattern.replace(")*", ")*+")


#: What may stand between the lines of a key, escaped or quoted ones too.
BETWEEN = r"""(?:\\r)?[\x09-\x0D\x20"',>|#*+\\]+"""
#: The header, encapsulated ones as of encrypted keys, then all up to the end mark; or, without
#: one, lines of 16 base64 characters or more and a shorter last one.  No part needs a group's
#: rounds given back (``Rule.native``).
KEY_BLOCK = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
    rf"(?:{BETWEEN}[A-Z][A-Za-z0-9]{{0,30}}-[A-Z][A-Za-z0-9-]{{0,30}}:[A-Za-z0-9,\x20-]+)*"
    r"""(?:[A-Za-z0-9+/=\x09-\x0D\x20\\"',>|#*;]*-----END [A-Z ]{0,30}PRIVATE KEY-----"""
    rf"|{BETWEEN}[A-Za-z0-9+/]{{16,}}={{0,2}}(?:{BETWEEN}[A-Za-z0-9+/]{{16,}}={{0,2}})*"
    rf"(?:{BETWEEN}[A-Za-z0-9+/]+={{1,2}}|\\[A-Za-z0-9+/]+|\r?\n[\x09\x20>|#*]*[A-Za-z0-9+/]+(?m:$))?)?"
)
#: The three base rules, then those that the method adds.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("key_block", KEY_BLOCK),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+)?"),
)
RULES = BASE + MORE

#: A query: True (every text), a trigram, or ("and" | "or", parts).
Query = bool | str | tuple
MANY = 64


def both(parts: Sequence[Query]) -> Query:
    kept = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def either(parts: Sequence[Query]) -> Query:
    kept = list(dict.fromkeys(parts))
    if True in kept or not kept:
        return True
    # What asks for all that another part asks for, and more, adds nothing.
    flat = {p: frozenset(trigrams(p)) for p in kept if isinstance(p, str) or p[0] == "and" and all(isinstance(x, str) for x in p[1])}
    kept = [p for p in kept if not (p in flat and any(q < flat[p] for q in flat.values()))]
    return kept[0] if len(kept) == 1 else ("or", tuple(kept))


def of_strings(strings: set[str]) -> Query:
    """What a text that holds one of the strings holds."""
    return either([both([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def letters(items) -> set[str] | None:
    """The lower-case characters of a class, or None if they are many."""
    out: set[str] = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value).lower())
        elif op is sre.RANGE and value[1] - value[0] < 8:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def known(tree) -> tuple[set[str] | None, Query]:
    """The strings that the pattern matches, lower-cased, or None; and the query of its matches."""
    run: set[str] = {""}
    queries: list[Query] = []
    exact = True

    def add(strings: set[str] | None, query: Query) -> None:
        nonlocal run, exact
        longer = {a + b for a in run for b in strings} if strings is not None else set()
        if strings is None or len(longer) > MANY:
            queries.extend([of_strings(run), query])
            run, exact = {""}, False
        else:
            run = longer

    for op, value in tree:
        if op is sre.LITERAL:
            add({chr(value).lower()}, True)
        elif op is sre.IN:
            add(letters(value), True)
        elif op is sre.SUBPATTERN:
            add(*known(value[-1]))
        elif op is sre.BRANCH:
            parts = [known(p) for p in value[1]]
            strings = None if any(s is None for s, _ in parts) else set().union(*[s for s, _ in parts])
            add(strings, either([of_strings(s) if s is not None else q for s, q in parts]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            strings, query = known(inner)
            if (least, most) == (0, 1) and strings is not None:
                add(strings | {""}, True)
                continue
            for _ in range(min(least, 3)):
                add(strings, query)
            if most > min(least, 3):
                add(None, True)
        elif op is not sre.AT:
            add(None, True)
    if exact:
        return run, of_strings(run)
    return None, both([*queries, of_strings(run)])


def trigram_query(pattern: str) -> Query:
    """A query, over lower-cased trigrams, that each text with a match satisfies."""
    return known(parser.parse(pattern))[1]


def trigrams(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def postings(texts: DataFrame, grams: Sequence[str]) -> DataFrame:
    """``(gram, digest)`` for ``texts (digest, text)``: which texts hold which of the trigrams."""
    low = texts.select("digest", F.lower("text").alias("low"))
    held = [F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]
    return low.select("digest", F.explode(F.array_compact(F.array(*held))).alias("gram"))


def candidates(posted: DataFrame, grams: Sequence[str], queries: Sequence[Query]) -> DataFrame:
    """``(digest, rules)``: numbers of the queries whose postings, intersected and united, hold it."""
    at = {g: i for i, g in enumerate(grams)}

    def holds(query: Query) -> Column:
        if isinstance(query, str):
            return F.array_contains("grams", at[query])
        join = (lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b)
        return reduce(join, map(holds, query[1]))

    by_text = posted.groupBy("digest").agg(F.collect_set("gram").alias("grams"))  # len(grams) at most
    rules = [F.when(holds(q), F.lit(r)) for r, q in enumerate(queries) if q is not True]
    return by_text.select("digest", F.array_compact(F.array(*rules)).alias("rules")).where(F.size("rules") > 0)


def spans_of(text: Column, rule: Rule, number: int) -> Column:
    """``array<struct<start, number, stop, kind>>`` of the rule's matches, in code points."""
    hits = F.regexp_extract_all(text, F.lit(rule.native), F.lit(0))
    checked = F.regexp_extract_all(text, F.lit(rule.native), F.lit(rule.group)) if rule.least else hits
    gaps = F.split(text, rule.native, -1)
    none = F.array().cast("array<struct<start:int,number:int,stop:int,kind:string>>")

    def located(parts: Column) -> Column:
        found, inner, between = parts["hits"], parts["checked"], parts["gaps"]

        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(between, i))
            stop = start + F.length(F.get(found, i))
            span = F.struct(start.alias("start"), F.lit(number).alias("number"), stop.alias("stop"), F.lit(rule.kind).alias("kind"))
            good = F.length(F.get(inner, i)) >= rule.least
            out = F.when(good, F.concat(state["out"], F.array(span))).otherwise(state["out"])
            return F.struct(stop.alias("at"), out.alias("out"))

        first = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), first, step, lambda s: s["out"])

    parts = F.struct(hits.alias("hits"), checked.alias("checked"), gaps.alias("gaps"))
    return F.when(text.rlike(rule.native), let(parts, located)).otherwise(none)


def find_secrets(df: DataFrame, out: str = "spans", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``df`` with ``out``: spans ``<start, number, stop, kind>`` by start, then rule number.

    Offsets are code points, ``stop`` exclusive.  A null or empty text has no span.  Spans of
    different rules may overlap; equal texts, however many, share their postings.  All columns
    of ``df`` are kept; one named ``out`` is replaced.
    """
    df = df.drop(out)
    digest, chosen = fresh(df, "digest", "rules")
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(trigrams, queries)))
    body = whole(col(text))
    texts = df.select(F.xxhash64(body).alias("digest"), body.alias("text"))
    # Texts of one digest share candidates: more than needed if digests ever clash, never fewer.
    found = written(candidates(postings(texts, grams), grams, queries), "candidates").toDF(digest, chosen)
    marked = df.withColumn(digest, F.xxhash64(body)).join(found, digest, "left")
    per_rule = []
    for n, (rule, query) in enumerate(zip(rules, queries)):
        spans = spans_of(body, rule, n)
        if query is not True:
            empty = F.array().cast("array<struct<start:int,number:int,stop:int,kind:string>>")
            asked = F.coalesce(F.array_contains(col(chosen), n), F.lit(False))
            spans = F.when(asked, spans).otherwise(empty)
        per_rule.append(spans)
    return marked.withColumn(out, F.array_sort(F.concat(*per_rule))).select(*[col(c) for c in df.columns], col(out))


def written_out(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def mask_secrets(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, chars: str | None = None) -> DataFrame:
    """``df`` with each secret of ``text`` replaced by ``[kind]``; overlapping ones by the first's.

    Every row stays; a null text stays null.  ``chars``, if given, is the length of masked texts.
    """
    (spans,) = fresh(df, "spans")

    def step(state: Column, s: Column) -> Column:
        new = s["start"] >= state["at"]
        before = F.substr(col(text), state["at"] + 1, s["start"] - state["at"])
        out = F.when(new, F.concat(state["out"], before, F.lit("["), s["kind"], F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), out.alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate(col(spans), first, step, lambda s: F.concat(s["out"], F.substr(col(text), s["at"] + 1)))
    found = find_secrets(df, spans, text, rules)
    new = F.when(F.size(col(spans)) > 0, masked).otherwise(col(text))
    changed = {text: new}
    if chars is not None:
        length = F.when(F.size(col(spans)) > 0, F.length(masked)).otherwise(col(chars))
        changed[chars] = length.cast(df.schema[chars].dataType)
    return found.withColumns(changed).select(*[col(c) for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["number"] < len(BASE))
    return found.select(
        "doc_id",
        *[count(r.kind).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(written_out(base).cast("binary"), 256).alias("base_sha256"),
        written_out(F.col("spans")).alias("spans"),
    )


def _oracle() -> str:
    parts = []
    for n, r in enumerate(RULES):
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(
            f"""select rid, {n} as n, '{r.kind}' as kind, s, s + length(f[i]) as e from (select rid, f, i, inner_,
            list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) as s
            from (select rid, f, unnest(range(1, len(f) + 1)) as i, unnest(c) as inner_, g from (select rid,
            regexp_extract_all(t, {pattern}, 0) as f, regexp_extract_all(t, {pattern}, {r.group if r.least else 0}) as c,
            string_split_regex(t, {pattern}) as g from d where regexp_matches(t, {pattern})))) where length(inner_) >= {r.least}"""
        )
    text = "kind || ':' || s::bigint || ':' || e::bigint"
    counts = ", ".join(f"count(*) filter (n = {n}) as n_{r.kind}" for n, r in enumerate(BASE))
    return f"""with d as materialized (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
    found as ({' union all '.join(parts)})
    select doc_id, {counts}, sha256(coalesce(string_agg({text}, ',' order by s, n) filter (n < {len(BASE)}), '')) as base_sha256,
    coalesce(string_agg({text}, ',' order by s, n), '') as spans from d left join found using (rid) group by rid, doc_id"""


ORACLE = _oracle()
