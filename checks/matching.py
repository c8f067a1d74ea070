"""Fuzzy text matching and the composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import cte, table
from checks.registry import query
from tablewright.operators import fuzzy

NAMES = ["small ring", "red widget", "blue bolt", "hot gear"]
WORDS = """words as (select lower(unnest(regexp_extract_all(text,
  '[\\p{L}\\p{N}_](?:[\\p{L}\\p{N}_'']*[\\p{L}\\p{N}_])?'))) as word from documents),
  counted as (select word, count(*) as n from words where length(word) >= 4
  and not regexp_full_match(word, '\\p{Nd}+') group by 1)"""


def lcs_sql(a: str, b: str) -> str:
    """Longest common subsequence of two texts, row by row of the textbook table."""
    cell = (f"case when ascii({b}[j[1]]) = x[1] then prev[j[1]] + 1 "
            "else greatest(prev[j[1] + 1], cur[j[1]]) end")
    row = (f"list_reduce(list_transform(range(1, length({b}) + 1), lambda i: [i]), "
           f"lambda cur, j: list_append(cur, {cell}), [0::bigint])")
    start = f"list_transform(range(0, length({b}) + 1), lambda i: 0::bigint)"
    letters = f"list_transform(string_split({a}, ''), lambda c: [ascii(c)::bigint])"
    return f"list_reduce({letters}, lambda prev, x: {row}, {start})[-1]"


@query("t1_token_counts", f"with {WORDS} select word, n from counted")
def t1(spark, sf):
    return fuzzy.token_counts(table(spark, sf, "documents"), "text")


@query("t2_detect_typos")
def t2(spark, sf):
    return fuzzy.detect_typos(table(spark, sf, "documents"), "text", min_count=10)


# Words without apostrophes: a score of 90 is a close spelling, or one word inside another
# that is 1.5 to 8 times as long.
@query("t2_detect_name_typos", f"""{cte('name_typos')}, w as (select lower(unnest(regexp_extract_all(typed_name, '[a-zA-Z]+'))) as w
  from name_typos), n as (select w, count(*) as n from w where length(w) >= 4 group by 1),
  pairs as (select r.w as typo, c.w as correction, greatest(length(r.w), length(c.w)) / least(length(r.w), length(c.w))::double as spread
  from n r join n c on r.n < 10 and c.n >= 10 and r.w != 'hott'),
  scored as (select typo, correction, case when spread < 1.5 then round_even(200.0 * {lcs_sql('typo', 'correction')}
  / (length(typo) + length(correction)), 0) when spread <= 8 and (contains(typo, correction) or contains(correction, typo)) then 90 else 0 end as score from pairs),
  best as (from scored qualify row_number() over (partition by typo order by score desc, correction) = 1)
  select typo, correction from best where score >= 90 and typo[1] = correction[1] union all select 'hott', 'hot'""")
def t2_names(spark, sf):
    return fuzzy.detect_typos(table(spark, sf, "name_typos"), "typed_name", known={"hott": "hot"})


@query("t3_apply_corrections_value", """select p_partkey, case p_type when 'ECONOMY' then 'Economy' when 'PROMO'
  then 'Promotion' else p_type end as p_type from part""")
def t3(spark, sf):
    return fuzzy.apply_corrections(
        table(spark, sf, "part").select("p_partkey", "p_type"), "p_type",
        {"ECONOMY": "Economy", "PROMO": "Promotion", "TINY": "SMALL"},
    )


@query("t3_apply_corrections_token", """select p_partkey, array_to_string(list_transform(string_split(p_name, ' '),
  lambda w: case w when 'red' then 'crimson' when 'bolt' then 'screw' else w end), ' ') as p_name from part""")
def t3_tokens(spark, sf):
    words = spark.createDataFrame([("red", "crimson"), ("bolt", "screw")], "typo string, correction string")
    return fuzzy.apply_corrections(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", words, "token")


@query("t4_snap_to", f"""{cte('name_typos')}, vals as (select distinct typed_name as v, lower(typed_name) as a
  from name_typos where typed_name is not null),
  scored as (select v, c, round_even(200.0 * {lcs_sql('a', 'c')} / (length(a) + length(c)), 0) as score, i
  from vals, (values {', '.join(f"('{n}', {i})" for i, n in enumerate(NAMES))}) t(c, i)),
  best as (select v, arg_max(c, score * 100 - i) as c, max(score) as score from scored group by v)
  select p_partkey, p_name, case when score >= 85 then c else typed_name end as typed_name
  from name_typos left join best on v = typed_name""")
def t4(spark, sf):
    t = table(spark, sf, "name_typos").select("p_partkey", "p_name", "typed_name")
    return fuzzy.snap_to(t, "typed_name", NAMES)


@query("t5_best_match")
def t5(spark, sf):
    t = table(spark, sf, "name_typos").select("p_partkey", F.upper("typed_name").alias("name"))
    return fuzzy.best_match(t, "name", [n.upper() for n in NAMES], dominant=("RED WIDGET", "RE"))


@query("t6_cluster_corrections")
def t6(spark, sf):
    t = table(spark, sf, "name_typos").select(F.upper("typed_name").alias("name"))
    return fuzzy.cluster_corrections(t, "name", [n.upper() for n in NAMES])


# A dropped letter leaves L-1 matches of L + L-1 letters, a swap L-1 of 2L; equal letters
# make the swap invisible, and case does not count.
@query("t7_compare_columns", f"""{cte('name_typos')}, s as (select *, length(p_name)::double as l from name_typos),
  r as (select *, case when typed_name is null then 0.0 when lower(typed_name) = lower(p_name) then 1.0
  when length(typed_name) < l then 2 * (l - 1) / (2 * l - 1) else 2 * (l - 1) / (2 * l) end::double as similarity from s)
  select p_partkey, p_name, typed_name, typed_name is null as missing_initial, similarity,
  case when similarity <= 0 then 'missing' when similarity <= 0.8 then 'some_similarity' else 'similar' end as relationship from r""")
def t7(spark, sf):
    t = table(spark, sf, "name_typos").select("p_partkey", "p_name", "typed_name")
    return fuzzy.compare_columns(t, "p_name", "typed_name", fill_missing=False)


@query("t7_comparison_counts", f"""{cte('name_typos')} select count(*) filter (typed_name is null) as missing_initial,
  count(*) filter (typed_name is null) as missing_filled,
  count(*) filter (typed_name = p_name or typed_name is null) as exact_matches from name_typos""")
def t7_counts(spark, sf):
    t = table(spark, sf, "name_typos").select("p_partkey", "p_name", "typed_name")
    compared = fuzzy.compare_columns(t, "p_name", "typed_name")
    out = fuzzy.comparison_summary(compared, "p_name", "typed_name")
    return out.select("missing_initial", "missing_filled", "exact_matches")


@query("t7_relationship_bins", """select o_orderkey, case when s <= 0 then 'missing' when s <= 0.1 then 'different'
  when s <= 0.8 then 'some_similarity' else 'similar' end as relationship from (select o_orderkey, (o_orderkey % 11) / 10.0::double as s from orders)""")
def t7_bins(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", fuzzy.relationship(F.col("o_orderkey") % 11 / F.lit(10.0)).alias("relationship"))


def gram_sql(src: str, col: str) -> str:
    """Smoothed, normalised TF-IDF of character 2- and 3-grams."""
    return f"""vals as (select distinct {col} as value from {src} where {col} is not null),
    tf as (select value, lower(value)[i:i + k - 1] as term, count(*) as tf from vals, unnest([2, 3]) u(k),
      lateral (select unnest(generate_series(1, length(value) - k + 1)) as i) group by all),
    idf as (select term, ln(((select count(*) from vals) + 1)::double / (count(*) + 1)) + 1 as idf from tf
      group by 1 having count(*) >= 2),
    w as (select value, term, tf * idf as w from tf join idf using (term))"""


@query("t8_char_tfidf", f"""{cte('name_typos')}, {gram_sql('name_typos', 'typed_name')}
  select value, term, round(w / sqrt(sum(w * w) over (partition by value)), 9) as weight from w""")
def t8(spark, sf):
    out = fuzzy.char_tfidf(table(spark, sf, "name_typos"), "typed_name")
    return out.withColumn("weight", F.round("weight", 9))


@query("t9_cluster_values")
def t9(spark, sf):
    return fuzzy.cluster_values(table(spark, sf, "name_typos"), "typed_name")


# Five groups of four values that share no letter with another group: whatever the numbers of the
# clusters, their members are known, and so is what each is corrected to.
GROUPS = "concat(repeat(substr('abcdefghij', {at}, 2), 8), {n})"
GROUPED = f"""with g as (select distinct c_custkey % 5 as g, {GROUPS.format(at='cast(c_custkey % 5 * 2 + 1 as int)',
  n='(c_custkey % 20 - c_custkey % 5) // 5')} as value from customer)"""


def grouped(spark, sf):
    text = GROUPS.format(at="cast(c_custkey % 5 * 2 + 1 as int)", n="(c_custkey % 20 - c_custkey % 5) div 5")
    return table(spark, sf, "customer").select(F.expr(text).alias("value"))


@query("t9_cluster_groups", f"{GROUPED} select value, min(value) over (partition by g) as first_member from g")
def t9_groups(spark, sf):
    found = fuzzy.cluster_values(grouped(spark, sf), "value", k=5)
    least = found.groupBy("cluster").agg(F.min("value").alias("first_member"))
    return found.join(least, "cluster").select("value", "first_member")


@query("t6_cluster_corrections_groups", f"""{GROUPED} select a.value as typo, b.value as correction
  from g a join g b using (g) where b.value like '%0' and a.value != b.value""")
def t6_groups(spark, sf):
    valid = [letters * 8 + "0" for letters in ("ab", "cd", "ef", "gh", "ij")]
    return fuzzy.cluster_corrections(grouped(spark, sf), "value", valid, k=5)


# Digests are far apart; with one letter dropped, 31 of 32 + 31 letters are matched twice.
@query("t10_close_matches_planted", """with v as (select md5(c_custkey::varchar) as a from customer),
  p as (select a, concat(substr(a, 1, 4), substr(a, 6)) as b from v)
  select a as value, b as "match", 62 / 63.0::double as ratio, 1::integer as rank from p union all select b, a, 62 / 63.0::double, 1 from p""")
def t10_planted(spark, sf):
    whole = table(spark, sf, "customer").select(F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("v"))
    dropped = whole.select(F.concat(F.substring("v", 1, 4), F.substring("v", 6, 40)).alias("v"))
    return fuzzy.close_matches(whole.union(dropped), "v", cutoff=0.95)


@query("t10_close_matches")
def t10(spark, sf):
    return fuzzy.close_matches(table(spark, sf, "name_typos"), "typed_name")


@query("t11_term_frequencies", """select trim(source) as term, count(*) as n, greatest(1, 10 - count(*)) as rarity,
  count(*) <= 1 as single_use from documents group by 1""")
def t11(spark, sf):
    return fuzzy.term_frequencies(table(spark, sf, "documents"), "source")


@query("t11_top_terms", f"""{cte('name_typos')} select trim(typed_name) as term, count(*) as n, greatest(1, 10 - count(*)) as rarity,
  count(*) <= 1 as single_use from name_typos where trim(typed_name) != '' group by 1 order by n desc, 1 limit 20""")
def t11_top(spark, sf):
    return fuzzy.top_terms(table(spark, sf, "name_typos"), "typed_name")


TOP = """select row_number() over (order by count(*) desc, {c})::integer as rank, {c} as {p}_value, count(*) as {p}_count
  from name_typos where {c} is not null group by {c} order by 3 desc, 2 limit 20"""


@query("t12_compare_top", f"""{cte('name_typos')}, b as ({TOP.format(c='typed_name', p='before')}),
  a as ({TOP.format(c='p_name', p='after')}) select * from b full join a using (rank)""")
def t12(spark, sf):
    return fuzzy.compare_top(table(spark, sf, "name_typos"), "typed_name", "p_name")


@query("t13_change_impact", f"""{cte('name_typos')} select typed_name, p_name, count(*) as n from name_typos
  where typed_name != p_name group by all order by n desc, 1, 2 limit 20""")
def t13(spark, sf):
    return fuzzy.change_impact(table(spark, sf, "name_typos"), "typed_name", "p_name")


TERMS = {"license": ["Apache License", "MIT"], "words": ["the", "und", "les"]}


@query("t14_term_containment", " union all ".join(
    f"select '{g}' as group_name, '{t}' as term, count(*) filter (contains(lower(text), '{t.lower()}')) as n from documents"
    for g, ts in TERMS.items() for t in ts))
def t14(spark, sf):
    return fuzzy.term_containment(table(spark, sf, "documents"), "text", TERMS)
