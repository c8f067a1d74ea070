"""Dependencies, inclusion, repair and rules."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from checks.inputs import cte, table
from checks.registry import query
from tablewright.operators import dependencies as dep
from tablewright.operators import inclusion as inc
from tablewright.operators import lattice, repair
from tablewright.operators import rules as ar

FACTS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "c_mktsegment", "n_name", "n_regionkey"]
SETS = [("o_orderstatus",), ("n_name",), ("n_name", "n_regionkey"), ("o_orderstatus", "n_name"), ("o_orderkey",)]


def joined(column: str):
    return F.array_join(column, ",").alias(column)


def facts(spark, sf):
    return table(spark, sf, "order_facts")


# --- SQL twins for dependencies: distinct counts of attribute sets, compared ---------


def subsets(size: int, cols=FACTS):
    return list(combinations(cols, size))


def class_table(top: int, cols=FACTS, src="order_facts") -> str:
    """``cls(attrs, k)``: classes of every attribute set up to a size."""
    parts = [
        f"select '{','.join(s)}' as attrs, count(distinct ({', '.join(s)},)) as k from {src}"
        for size in range(1, top + 1)
        for s in subsets(size, cols)
    ]
    return "cls as materialized (" + " union all ".join(parts) + ")"


def candidates(top: int, cols=FACTS) -> str:
    """``cand(lhs, rhs, both)``: X, A and X+A as comma lists."""
    rows = []
    for size in range(1, top + 1):
        for x in subsets(size, cols):
            for a in cols:
                if a not in x:
                    both = [c for c in cols if c in (*x, a)]
                    rows.append(f"('{','.join(x)}', '{a}', '{','.join(both)}')")
    return f"cand(lhs, rhs, both_attrs) as (values {', '.join(rows)})"


SUBSET = "list_has_all(string_split(f.lhs, ','), string_split(g.lhs, ',')) and len(g.lhs) < len(f.lhs)"


def fd_sql(top: int = len(FACTS) - 1, cols=FACTS) -> str:
    return f"""{cte('order_facts')}, {class_table(top + 1, cols)}, {candidates(top, cols)},
    fds as (select lhs, rhs from cand join cls a on a.attrs = lhs join cls b on b.attrs = both_attrs where a.k = b.k),
    minimal as (select f.* from fds f where not exists (select 1 from fds g where g.rhs = f.rhs and {SUBSET}))"""


@query("d1_partition_stats", cte("order_facts") + " " + " union all ".join(
    f"""select '{','.join(s)}' as attributes, count(*) as classes, sum(n)::bigint as rows,
    coalesce(sum(n) filter (n > 1), 0)::bigint as grouped_rows,
    (coalesce(sum(n) filter (n > 1), 0) - count(*) filter (n > 1)) / sum(n)::double as error
    from (select count(*) as n from order_facts group by {', '.join(s)})""" for s in SETS))
def d1(spark, sf):
    return lattice.partition_stats(facts(spark, sf), SETS).withColumn("attributes", joined("attributes"))


# Eight columns and no bound on the left side.
EIGHT = [*FACTS, "o_orderdate"]


@query("d2_discover_fds", f"{fd_sql(7, EIGHT)} select * from minimal")
def d2(spark, sf):
    return dep.discover_fds(facts(spark, sf), EIGHT).withColumn("lhs", joined("lhs"))


@query("d3_discover_keys", f"""{cte('order_facts')}, {class_table(len(FACTS))},
  keys as (select attrs as lhs from cls where k = (select count(*) from order_facts))
  select lhs as attributes from keys f where not exists (select 1 from keys g where {SUBSET})""")
def d3(spark, sf):
    return dep.discover_keys(facts(spark, sf), FACTS).withColumn("attributes", joined("attributes"))


NULLY = ["c_custkey", "c_nationkey", "c_mktsegment", "n_name", "r_name"]


def single_rhs(size: int) -> str:
    """FDs by the largest number of distinct non-NULL right values of a group."""
    parts = []
    for y in NULLY:
        for x in subsets(size, [c for c in NULLY if c != y]):
            whole = " and ".join(f"{c} is not null" for c in x)
            parts.append(
                f"select '{','.join(x)}' as lhs, '{y}' as rhs from (select count(distinct {y}) as d from cust_nation "
                f"where {whole} group by {', '.join(x)}) having max(d) = 1"
            )
    return " union all ".join(parts)


@query("d4_fds_of_size", f"{cte('cust_nation')} {single_rhs(2)}")
def d4(spark, sf):
    return dep.fds_of_size(table(spark, sf, "cust_nation"), 2, NULLY).withColumn("lhs", joined("lhs"))


@query("d5_minimal_fds", f"""{fd_sql(2)}, kept as (select lhs, rhs from fds where lhs != 'o_orderkey')
  select f.* from kept f where not exists (select 1 from kept g where g.rhs = f.rhs and {SUBSET})""")
def d5(spark, sf):
    found = dep.fds_of_size(facts(spark, sf), 1, FACTS).union(dep.fds_of_size(facts(spark, sf), 2, FACTS))
    some = found.where(F.array_join("lhs", ",") != "o_orderkey")
    return dep.minimal_fds(some).withColumn("lhs", joined("lhs"))


@query("d6_discover_minimal_fds", f"""{cte('cust_nation')}, fds as ({' union all '.join(map(single_rhs, range(1, 5)))})
  select f.* from fds f where not exists (select 1 from fds g where g.rhs = f.rhs and {SUBSET})""")
def d6(spark, sf):
    return dep.discover_minimal_fds(table(spark, sf, "cust_nation"), 4, NULLY).withColumn("lhs", joined("lhs"))


@query("d7_g3_score", f"""{cte('cust_nation')} select 'c_nationkey' as lhs, 'n_name' as rhs,
  sum(case when d > 1 then n - 1 else 0 end)::double / (select count(*) from cust_nation) as g3
  from (select count(*) as n, count(distinct coalesce(n_name, '?')) as d from cust_nation group by c_nationkey)""")
def d7(spark, sf):
    return dep.g3_score(table(spark, sf, "cust_nation"), ["c_nationkey"], "n_name").withColumn("lhs", joined("lhs"))


@query("d8_g3_canonical", f"""{cte('cust_nation')} select 'c_nationkey' as lhs, 'n_name' as rhs,
  sum(n - m)::double / (select count(*) from cust_nation) as g3 from (select sum(n) as n, max(n) as m from
  (select c_nationkey, count(*) as n from cust_nation group by c_nationkey, n_name) group by c_nationkey)""")
def d8(spark, sf):
    return dep.g3_canonical(table(spark, sf, "cust_nation"), ["c_nationkey"], "n_name").withColumn("lhs", joined("lhs"))


AFD_COLS = ["c_nationkey", "c_mktsegment", "n_name", "r_name", "bucket"]
AFD_SRC = f"""{cte('cust_nation')}, afd as materialized (select c_nationkey, c_mktsegment, r_name, bucket,
  case when c_custkey % 97 = 1 then 'NATION_X' else full_name end as n_name from (
  select c.*, n.n_name as full_name, c_custkey // 2 as bucket from cust_nation c join nation n on c_nationkey = n_nationkey)
  where r_name is not null)"""


def afd_input(spark, sf):
    c = table(spark, sf, "cust_nation")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("full_name"))
    return (
        c.join(n, "c_nationkey")
        .where("r_name is not null")
        .withColumn("n_name", F.expr("case when c_custkey % 97 = 1 then 'NATION_X' else full_name end"))
        .withColumn("bucket", F.expr("c_custkey div 2"))
        .select(*AFD_COLS)
    )


def scores(sizes) -> str:
    parts = []
    for size in sizes:
        for y in AFD_COLS:
            for x in subsets(size, [c for c in AFD_COLS if c != y]):
                parts.append(
                    f"select '{','.join(x)}' as lhs, '{y}' as rhs, {size} as size, "
                    f"sum(case when d > 1 then n - 1 else 0 end)::double / (select count(*) from afd) as g3 from "
                    f"(select count(*) as n, count(distinct {y}) as d from afd group by {', '.join(x)})"
                )
    return "scores as materialized (" + " union all ".join(parts) + ")"


COVERED = ("g.rhs = f.rhs and list_has_all(string_split(f.lhs, ','), string_split(g.lhs, ',')) "
           "and g.size < f.size and g.g3 <= f.g3 * 1.1")


@query("d9_discover_afds", f"""{AFD_SRC}, {scores((1, 2))}, one as (select * from scores where size = 1 and g3 <= 0.25),
  two as (select * from scores f where size = 2 and g3 <= 0.25 and not exists (select 1 from one g where {COVERED}))
  select lhs, rhs, g3, (1 - g3) * 100 as confidence from (from one union all from two)""")
def d9(spark, sf):
    return dep.discover_afds(afd_input(spark, sf), AFD_COLS, 2, 0.25).withColumn("lhs", joined("lhs"))


@query("d10_filter_redundant", f"""{AFD_SRC}, {scores((1, 2))}, one as (select * from scores where size = 1 and g3 <= 0.9),
  two as (select * from scores f where size = 2 and g3 <= 0.9 and not exists (select 1 from one g where {COVERED}))
  select lhs, rhs, g3 from (from one union all from two)""")
def d10(spark, sf):
    every = dep.discover_afds(afd_input(spark, sf), AFD_COLS, 2, 0.9, remove_redundant=False)
    return dep.filter_redundant(every, 2).select(joined("lhs"), "rhs", "g3")


PICK = [(("c_nationkey",), "n_name"), (("c_nationkey", "c_mktsegment"), "r_name"), (("zip",), "n_name")]
SELECTED = ["c_nationkey → n_name", "c_nationkey,c_mktsegment → r_name"]


def violation_sql(x: str, y: str) -> str:
    return f"""(select {x}, count(*) as d, sum(n) filter (y is not null) as present from
    (select {x}, {y} as y, count(*) as n from cust_nation group by all) group by {x} having count(*) > 1)"""


@query("d11_validate_fds", f"""{cte('cust_nation')} select 'c_nationkey → n_name' as fd, 96.0::double as confidence,
  true as selected_for_repair, count(*) as violation_count, sum(present - 1)::bigint as total_violations, null::varchar as error
  from {violation_sql('c_nationkey', 'n_name')}
  union all select 'c_nationkey,c_mktsegment → r_name', 99.0, true, count(*), sum(present - 1)::bigint, null
  from {violation_sql('c_nationkey, c_mktsegment', 'r_name')}
  union all select 'zip → n_name', 97.0, false, null, null, 'Missing attributes in dataset'""")
def d11(spark, sf):
    fds = list(zip(PICK, (96.0, 99.0, 97.0)))
    return repair.validate_fds(table(spark, sf, "cust_nation"), fds, SELECTED)


MODE = """(select {x}, y from (select {x}, {y} as y, count(*) as n from cust_nation where {y} is not null group by all)
  qualify row_number() over (partition by {x} order by n desc, y) = 1)"""


@query("d11_fd_violations", f"""{cte('cust_nation')} select 'c_nationkey → n_name' as fd, c_nationkey::varchar as x_value,
  d as n_values, present::bigint as n_rows, y as most_common_y, true as will_fix
  from {violation_sql('c_nationkey', 'n_name')} join {MODE.format(x='c_nationkey', y='n_name')} using (c_nationkey)""")
def d11_violations(spark, sf):
    out = repair.fd_violations(table(spark, sf, "cust_nation"), PICK[:1], SELECTED)
    return out.withColumn("x_value", joined("x_value"))


@query("d11_first_violations", f"""{cte('cust_nation')}, bad as (from {violation_sql('c_nationkey', 'n_name')}
  order by c_nationkey limit 5) select 'c_nationkey → n_name' as fd, c_nationkey::varchar as x_value, n_name as y_value,
  count(*) as n from cust_nation where c_nationkey in (select c_nationkey from bad) group by all""")
def d11_first(spark, sf):
    c = table(spark, sf, "cust_nation")
    first = repair.fd_violations(c, PICK[:1], SELECTED, detail=5)
    return repair.violation_values(c, first, PICK[0]).withColumn("x_value", joined("x_value"))


# A group makes a suggestion only if it disagrees or misses a value itself.
REPAIRED = f"""select c_custkey, c_nationkey, coalesce(c.n_name, a.y) as n_name, coalesce(c.r_name, b.y) as r_name
  from cust_nation c left join {MODE.format(x='c_nationkey', y='n_name')} a using (c_nationkey)
  left join (from {MODE.format(x='n_name', y='r_name')} where n_name in (select n_name from cust_nation group by 1
    having count(distinct r_name) > 1 or count(*) > count(r_name))) b on coalesce(c.n_name, a.y) = b.n_name"""
FIXES = ["c_nationkey → n_name", "n_name → r_name", "n_name → no_such_column"]


def nations(spark, sf):
    return table(spark, sf, "cust_nation").select("c_custkey", "c_nationkey", "c_mktsegment", "n_name", "r_name")


@query("d12_repair_by_fd", f"{cte('cust_nation')} {REPAIRED}")
def d12(spark, sf):
    fixed, _ = repair.repair_by_fd(nations(spark, sf), FIXES)
    return fixed.drop("c_mktsegment")


@query("d12_repair_stats", f"""{cte('cust_nation')}, r as ({REPAIRED.replace('c.n_name, a.y) as n_name', 'c.n_name, a.y) as n_name, c.n_name as n0, c.r_name as r0')})
  select 'c_nationkey → n_name' as fd, count(distinct c_nationkey) as repairs_applied, count(*) as rows_affected from r
  where n0 is null and n_name is not null and c_nationkey not in (3, 4)
  union all select 'n_name → r_name', count(distinct n_name), count(*) from r
  where r0 is null and r_name is not null and not (n0 is null and c_nationkey in (3, 4))""")
def d12_stats(spark, sf):
    _, stats = repair.repair_by_fd(nations(spark, sf), FIXES, {"c_nationkey": [3, 4]})
    return stats


@query("d12_repair_potential", f"""{cte('cust_nation')}, g as (select c_nationkey, count(distinct n_name) as d,
  count(*) filter (n_name is null) as missing from cust_nation group by 1)
  select 'c_nationkey → n_name' as fd, count(*) as potential, count(*) filter (c_nationkey in (3, 4)) as skipped
  from g where d > 1 or (d = 1 and missing > 0)""")
def d12_potential(spark, sf):
    return repair.repair_potential(nations(spark, sf), FIXES[:1], {"c_nationkey": [3, 4]})


@query("d13_repair_from_report", f"""{cte('cust_nation')} select c_custkey, c_nationkey, c_mktsegment,
  coalesce(c.n_name, a.y) as n_name, coalesce(c.r_name, b.y) as r_name from cust_nation c
  left join {MODE.format(x='c_nationkey', y='n_name')} a using (c_nationkey)
  left join {MODE.format(x='c_nationkey, c_mktsegment', y='r_name')} b using (c_nationkey, c_mktsegment)""")
def d13(spark, sf):
    c = nations(spark, sf)
    report = repair.fd_violations(c, PICK, SELECTED)
    fixed, _ = repair.repair_from_report(c, report)
    return fixed


@query("d14_attribute_involvement", f"""{fd_sql()} select attribute, count(*) as n from (select unnest(string_split(lhs, ',')) as attribute
  from minimal union all select rhs from minimal) group by 1 order by 2 desc, 1 limit 5""")
def d14(spark, sf):
    return dep.attribute_involvement(dep.discover_fds(facts(spark, sf), FACTS))


@query("d14_attribute_roles", f"""{fd_sql()} select 'n_name' as attribute, 'determines' as role, lhs, rhs from minimal
  where list_contains(string_split(lhs, ','), 'n_name') union all select 'n_name', 'determined', lhs, rhs from minimal where rhs = 'n_name'""")
def d14_roles(spark, sf):
    fds = dep.discover_fds(facts(spark, sf), FACTS)
    return dep.attribute_roles(fds, ["n_name"]).withColumn("lhs", joined("lhs"))


@query("d15_fd_edges", f"""{fd_sql()} select distinct unnest(string_split(lhs, ',')) as source, replace(lhs, ',', ' + ') as target,
  0.5::double as weight from minimal where contains(lhs, ',') union all select replace(lhs, ',', ' + '), rhs, 1.0 from minimal""")
def d15(spark, sf):
    return dep.fd_edges(dep.discover_fds(facts(spark, sf), FACTS))


# --- inclusion --------------------------------------------------------------------

LINES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"]


def ind_pairs(cols, src, value, conf) -> str:
    parts = []
    for a, b in [(a, b) for a in cols for b in cols if a != b]:
        parts.append(
            f"select '{a}' as lhs, '{b}' as rhs, (select count(*) from (select {value(a)} from {src} where {a} is not null "
            f"intersect select {value(b)} from {src} where {b} is not null)) as n_common, "
            f"count(distinct {value(a)}) as n_lhs from {src}"
        )
    return (f"inds as (select *, n_common / n_lhs::double as confidence, n_common = n_lhs as is_exact from ("
            + " union all ".join(parts) + f") where n_common / n_lhs::double >= {conf})")


NUMBERS = LINES[:5]
IND_SQL = "with " + ind_pairs(NUMBERS, "lineitem", lambda c: f"{c}::double", 0.3)


@query("d16_discover_inds", f"{IND_SQL} select * from inds")
def d16(spark, sf):
    return inc.discover_inds(table(spark, sf, "lineitem"), LINES, 0.3)


MIXED = ["p_name", "typed_name", "p_type", "p_partkey"]


@query("d17_discover_inds_normalized", cte("name_typos") + ", "
       + ind_pairs(MIXED, "name_typos", lambda c: f"lower(trim({c}::varchar))", 0.3) + " select * from inds")
def d17(spark, sf):
    return inc.discover_inds(table(spark, sf, "name_typos"), MIXED, 0.3, normalize=True)


def contained(cols, src, conf) -> str:
    parts = []
    for a, b in [(a, b) for a in cols for b in cols if a != b]:
        parts.append(
            f"select '{a}' as lhs, '{b}' as rhs, count(*) filter (hit) as n_common, count(*) as n_lhs from ("
            f"select exists (select 1 from vals y where y.c = '{b}' and contains(y.v, x.v)) as hit from vals x where x.c = '{a}')"
        )
    values = " union all ".join(
        f"select distinct '{c}' as c, lower(trim({c}::varchar)) as v from {src} where {c} is not null" for c in cols
    )
    return (f"vals as materialized ({values}), inds as (select *, n_common / n_lhs::double as confidence, "
            "n_common = n_lhs as is_exact from (" + " union all ".join(parts)
            + f") where n_common / n_lhs::double >= {conf})")


@query("d18_substring_inds", cte("facility_text") + ", "
       + contained(["p_type", "facility_type", "p_size"], "(select * from facility_text join part using (p_partkey))", 0.3)
       + " select * from inds")
def d18(spark, sf):
    both = table(spark, sf, "facility_text").join(table(spark, sf, "part"), "p_partkey")
    return inc.discover_substring_inds(both, ["p_type", "facility_type", "p_size"], 0.3)


def line_inds(spark, sf):
    return inc.discover_inds(table(spark, sf, "lineitem"), NUMBERS, 0.3)


@query("d19_ind_roles", f"""{IND_SQL} select * from (select lhs as "column", 'subset' as role, count(*) as n from inds
  group by 1 order by 3 desc, 1 limit 5) union all select * from (select rhs, 'superset', count(*) from inds
  group by 1 order by 3 desc, 1 limit 5)""")
def d19(spark, sf):
    return inc.ind_roles(line_inds(spark, sf))


@query("d20_ind_chains", f"""{IND_SQL} select x.lhs as a, x.rhs as b, y.rhs as d, x.confidence as conf_ab,
  y.confidence as conf_bd from inds x join inds y on x.rhs = y.lhs where x.lhs != y.rhs""")
def d20(spark, sf):
    return inc.ind_chains(line_inds(spark, sf))


EQ_SQL = cte("order_facts") + ", " + ind_pairs(
    ["c_nationkey", "n_nationkey", "n_regionkey"],
    "(select * from customer join nation on c_nationkey = n_nationkey)", lambda c: f"{c}::bigint", 0.95)


@query("d21_ind_equivalences", f"""{EQ_SQL} select x.lhs as a, x.rhs as b, x.confidence as conf_ab, y.confidence as conf_ba
  from inds x join inds y on x.lhs = y.rhs and x.rhs = y.lhs where x.lhs < x.rhs""")
def d21(spark, sf):
    both = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
    return inc.ind_equivalences(inc.discover_inds(both, ["c_nationkey", "n_nationkey", "n_regionkey"]))


@query("d22_ind_edges", f"{IND_SQL} select lhs as source, rhs as target, confidence as weight from inds")
def d22(spark, sf):
    return inc.ind_edges(line_inds(spark, sf))


# --- rules ------------------------------------------------------------------------

CATS = ["p_type", "l_returnflag", "o_orderpriority", "o_orderstatus"]
TOP5 = """brands as (select p_brand from lineitem join part on l_partkey = p_partkey group by 1
  order by count(*) desc, 1 limit 5)"""


def lines(spark, sf):
    return table(spark, sf, "line_facts")


@query("a1_build_baskets", f"""{cte('line_facts')}, {TOP5}, b as (select concat_ws(',', 'l_returnflag_' || l_returnflag,
  case when p_brand in (from brands) then 'p_brand_' || p_brand end,
  case when notes is not null then 'Violation_' || notes[1] end,
  case when notes is not null then 'Violation_' || regexp_extract(notes, '(\\d+)\\. SIZE', 1) end) as items from line_facts)
  select items, count(*) as n from b group by 1""")
def a1(spark, sf):
    li = lines(spark, sf).select("l_returnflag", "p_brand", "notes")
    baskets = ar.build_baskets(li, ["l_returnflag", "p_brand"], "notes", max_categories=5)
    return baskets.groupBy(F.array_join("items", ",").alias("items")).agg(F.count(F.lit(1)).alias("n"))


@query("a2_one_hot", """select o_orderkey, (o_orderstatus = 'F')::integer as "o_orderstatus_F",
  (o_orderstatus = 'O')::integer as "o_orderstatus_O" from orders""")
def a2(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return ar.one_hot(o, {"o_orderstatus": ["F", "O"]})


def itemset_sql(min_support: float) -> str:
    """Itemsets as groups over subsets of the category columns: one item per column."""
    label = {c: f"'{c}_' || {c}" for c in CATS}
    items = ", ".join(f"case when grouping({c}) = 0 then {label[c]} end" for c in CATS)
    return f"""{cte('line_facts')}, total as (select count(*) as n from line_facts),
    sets as materialized (select list_sort(list_filter([{items}], lambda x: x is not null)) as items, count(*) as freq,
    (select n from total) as n from line_facts group by cube ({', '.join(CATS)})
    having count(*) >= {min_support} * (select n from total) and len(items) > 0)"""


@query("a3_frequent_itemsets", f"""{itemset_sql(0.05)} select array_to_string(items, ',') as items, freq, n,
  freq::double / n as support from sets""")
def a3(spark, sf):
    baskets = ar.count_baskets(lines(spark, sf), CATS)
    return ar.frequent_itemsets(baskets, 0.05, weight="rows").withColumn("items", joined("items"))


# A rule is an itemset and a proper part of it that is frequent too (all parts are).
RULES = """rules as (select array_to_string(a.items, ',') as antecedents, array_to_string(c.items, ',') as consequents,
  s.freq::double / s.n as support, s.freq::double / a.freq as confidence,
  (s.freq * s.n)::double / (a.freq * c.freq) as lift from sets s
  join sets a on len(a.items) < len(s.items) and list_has_all(s.items, a.items)
  join sets c on len(c.items) = len(s.items) - len(a.items) and list_has_all(s.items, c.items)
  and not list_has_any(a.items, c.items))"""


def shown(rules):
    return rules.select(joined("antecedents"), joined("consequents"), "support", "confidence", "lift")


@query("a4_association_rules", f"{itemset_sql(0.05)}, {RULES} select * from rules where lift >= 1")
def a4(spark, sf):
    baskets = ar.count_baskets(lines(spark, sf), CATS)
    return shown(ar.association_rules(ar.frequent_itemsets(baskets, 0.05, weight="rows").persist(), "lift", 1.0))


# One item of each column at most: the rules are pairs of values, their counts two plain groupings.
@query("a5_rules_between", f"""{cte('line_facts')}, n as (select count(*) as n from line_facts),
  fa as (select o_orderstatus as a, count(*) as fa from line_facts where o_orderstatus is not null group by 1),
  fc as (select o_orderpriority as c, count(*) as fc from line_facts where o_orderpriority is not null group by 1),
  met as (select o_orderstatus as a, o_orderpriority as c, count(*) as f from line_facts
    where o_orderstatus is not null and o_orderpriority is not null group by all)
  select 'o_orderstatus_' || a as antecedents, 'o_orderpriority_' || c as consequents, f::double / n as support,
  f::double / fa as confidence, (f * n)::double / (fa * fc) as lift
  from met join fa using (a) join fc using (c), n where f >= 0.02 * n and f::double / fa >= 0.1""")
def a5(spark, sf):
    baskets = ar.count_baskets(lines(spark, sf), CATS)
    return shown(ar.rules_between(baskets, "o_orderstatus_", "o_orderpriority_", 0.02, "confidence", 0.1, "rows"))


@query("a6_format_rules", f"""{itemset_sql(0.05)}, {RULES} select printf('%s => %s (support: %.3f, confidence: %.3f, lift: %.3f)',
  replace(antecedents, ',', ', '), replace(consequents, ',', ', '), support, confidence, lift) as rule, lift
  from rules where lift >= 1 order by lift desc, string_split(antecedents, ','), string_split(consequents, ',') limit 10""")
def a6(spark, sf):
    baskets = ar.count_baskets(lines(spark, sf), CATS)
    return ar.format_rules(ar.association_rules(ar.frequent_itemsets(baskets, 0.05, weight="rows").persist()), "lift", 10)


@query("a7_mine_rules_categories", f"{itemset_sql(0.05)}, {RULES} select * from rules where lift >= 1")
def a7(spark, sf):
    return shown(ar.mine_rules(lines(spark, sf), CATS, "notes", "categories")["categories"])


CODE_SETS = f"""{cte('line_facts')}, total as (select count(*) as n from line_facts), coded as (select 'Violation_' || notes[1] as x,
  'Violation_' || regexp_extract(notes, '(\\d+)\\. SIZE', 1) as y, o_orderstatus as st from line_facts),
  sets as materialized (select list_sort(list_filter([case when grouping(x) = 0 then x end, case when grouping(y) = 0 then y end],
  lambda v: v is not null)) as items, count(*) as freq, (select n from total) as n from coded where x is not null
  group by cube (x, y) having count(*) >= 0.1 * (select n from total) and len(items) > 0)"""


@query("a7_mine_rules_codes", f"{CODE_SETS}, {RULES} select * from rules where lift >= 1")
def a7_codes(spark, sf):
    return shown(ar.mine_rules(lines(spark, sf), CATS, "notes", "violations")["violations"])


@query("a7_mine_rules_between", f"""{cte('line_facts')}, coded as (select 'o_orderstatus_' || o_orderstatus as a,
  unnest(['Violation_' || notes[1], 'Violation_' || regexp_extract(notes, '(\\d+)\\. SIZE', 1)]) as c, notes[1] as l,
  regexp_extract(notes, '(\\d+)\\. SIZE', 1) as s, o_orderstatus as o from line_facts where notes is not null),
  n as (select count(*) as n from line_facts), fa as (select 'o_orderstatus_' || o_orderstatus as a, count(*) as fa from line_facts group by 1),
  one as (select a, c as consequents, count(*) as f from coded group by all),
  two as (select 'o_orderstatus_' || o_orderstatus as a, array_to_string(list_sort(['Violation_' || notes[1],
    'Violation_' || regexp_extract(notes, '(\\d+)\\. SIZE', 1)]), ',') as consequents, count(*) as f from line_facts where notes is not null group by all),
  fc as (select consequents, sum(f) as fc from (from one union all from two) group by 1)
  select a as antecedents, consequents, f::double / n as support, f::double / fa as confidence,
  (f * n)::double / (fa * fc) as lift from (from one union all from two) join fa using (a) join fc using (consequents), n
  where f >= 0.02 * n and f::double / fa >= 0.05""")
def a7_between(spark, sf):
    found = ar.mine_rules(lines(spark, sf), ["o_orderstatus"], "notes", "category_violations")
    return shown(found["o_orderstatus_to_violations"])


@query("a8_rule_edges", f"""{itemset_sql(0.05)}, {RULES} select source, target, round(sum(lift), 9) as weight from (
  select source, unnest(string_split(consequents, ',')) as target, lift from (
  select unnest(string_split(antecedents, ',')) as source, consequents, lift from rules where lift >= 1)) group by all""")
def a8(spark, sf):
    baskets = ar.count_baskets(lines(spark, sf), CATS)
    edges = ar.rule_edges(ar.association_rules(ar.frequent_itemsets(baskets, 0.05, weight="rows").persist()))
    return edges.withColumn("weight", F.round("weight", 9))
