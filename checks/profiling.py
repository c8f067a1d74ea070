"""Profiles, quality reports and multi-valued text."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import cte, table
from checks.registry import query
from tablewright.operators import clean, multivalue, profile

ON = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def moments(col: str, src: str) -> str:
    return f"""select '{col}' as "column", count(*) as total_count, count(*) - count({col}) as missing_count,
    count(distinct {col}) as unique_count, round(avg({col}), 7) as mean, round(stddev_samp({col}), 6) as std_dev,
    min({col})::double as min, quantile_cont({col}::double, 0.25) as q25, median({col}::double) as median,
    quantile_cont({col}::double, 0.75) as q75, max({col})::double as max, round(skewness({col}), 6) as skewness,
    round(kurtosis({col}), 6) as kurtosis from {src}"""


NUMERIC = ["column", "total_count", "missing_count", "unique_count", "mean", "std_dev", "min",
           "q25", "median", "q75", "max", "skewness", "kurtosis"]


def rounded(df, names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("p1_describe_columns", f"""{cte('orders_null')}
  {moments('o_orderkey', 'orders_null')} union all {moments('o_totalprice', 'orders_null')}""")
def p1(spark, sf):
    stats = profile.describe_columns(table(spark, sf, "orders_null").select(*ON))
    numbers = stats.where("kind = 'numerical'").select(*NUMERIC)
    return rounded(rounded(numbers, ["std_dev", "skewness", "kurtosis"]), ["mean"], 7)


@query("p1_describe_lineitem", " union all ".join(
    moments(c, "lineitem") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                                     "l_extendedprice", "l_discount", "l_tax")))
def p1_lineitem(spark, sf):
    stats = profile.describe_columns(table(spark, sf, "lineitem"))
    numbers = stats.where("kind = 'numerical'").select(*NUMERIC)
    return rounded(rounded(numbers, ["std_dev", "skewness", "kurtosis"]), ["mean"], 7)


KINDS = {
    "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "datetime", "late": "boolean", "l_quantity": "numerical",
}
LATE = "case when l_orderkey % 8 = 0 then null else l_quantity > 25 end"


def kind_row(c: str, kind: str) -> str:
    """What the description says of a column besides its moments."""
    text, date, flag = (kind == k for k in ("categorical", "datetime", "boolean"))
    top = f"(select {{}} from (select {c} v, count(*) n from d where {c} is not null group by 1 order by 2 desc, 1 limit 1))"
    return f"""select '{c}' as "column", '{kind}' as kind, count(*) as total_count, count(*) - count({c}) as missing_count,
      (count(*) - count({c})) * 100.0::double / count(*) as missing_pct, count(distinct {c}) as unique_count,
      {top.format("v") if text else "null::varchar"} as top_value, {top.format("n") if text else "null::bigint"} as top_freq,
      {top.format("n") + " * 100.0::double / count(*)" if text else "null::double"} as top_pct,
      {f"strftime(min({c}), '%Y-%m-%d %H:%M:%S')" if date else "null::varchar"} as min_date,
      {f"strftime(max({c}), '%Y-%m-%d %H:%M:%S')" if date else "null::varchar"} as max_date,
      {f"date_diff('day', min({c}), max({c}))" if date else "null::bigint"} as range_days,
      {f"count(*) filter ({c})" if flag else "null::bigint"} as true_count,
      {f"count(*) filter (not {c})" if flag else "null::bigint"} as false_count,
      {f"count(*) filter ({c}) * 100.0::double / count({c})" if flag else "null::double"} as true_pct from d"""


@query("p1_describe_kinds", f"with d as (select *, {LATE} as late from lineitem) "
       + " union all ".join(kind_row(c, k) for c, k in KINDS.items()))
def p1_kinds(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("late", F.expr(LATE)).select(*KINDS)
    return profile.describe_columns(rows).select(
        "column", "kind", "total_count", "missing_count", "missing_pct", "unique_count", "top_value", "top_freq", "top_pct",
        "min_date", "max_date", "range_days", "true_count", "false_count", "true_pct",
    )


def modes(col: str, src: str) -> str:
    return f"""select '{col}' as "column", t.total as total_count, v as top_value, n as top_freq,
    n * 100.0::double / t.total as top_pct, u as unique_count from (
      select {col} as v, count(*) as n, count(*) over () as u from {src} where {col} is not null
      group by 1 order by 2 desc, 1 limit 1), (select count(*) as total from {src}) t"""


@query("p2_describe_categorical", f"""{cte('orders_null')} select * from ({modes('o_orderstatus', 'orders_null')})
  union all select * from ({modes('o_orderpriority', 'orders_null')})""")
def p2(spark, sf):
    by_type = profile.describe_by_type(table(spark, sf, "orders_null").select(*ON))
    return by_type["categorical"].select("column", "total_count", "top_value", "top_freq", "top_pct", "unique_count")


@query("p2_describe_datetime", """select 'o_orderdate' as "column", count(*) as total_count,
  strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') as min_date, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') as max_date,
  date_diff('day', min(o_orderdate), max(o_orderdate)) as range_days from orders""")
def p2_dates(spark, sf):
    by_type = profile.describe_by_type(table(spark, sf, "orders").select(*ON))
    return by_type["datetime"].select("column", "total_count", "min_date", "max_date", "range_days")


@query("p2_describe_boolean", """select 'late' as "column", count(*) as total_count, count(*) filter (late) as true_count,
  count(*) filter (not late) as false_count, count(*) filter (late) * 100.0::double / count(late) as true_pct
  from (select case when o_orderkey % 8 = 0 then null else o_totalprice > 200000 end as late from orders)""")
def p2_booleans(spark, sf):
    late = F.when(F.col("o_orderkey") % 8 == 0, None).otherwise(F.col("o_totalprice") > 200000)
    by_type = profile.describe_by_type(table(spark, sf, "orders").select("o_orderkey", late.alias("late")))
    return by_type["boolean"].select("column", "total_count", "true_count", "false_count", "true_pct")


def missing(col: str) -> str:
    return (f"select '{col}' as \"column\", count(*) - count({col}) as missing, "
            f"(count(*) - count({col})) * 100.0::double / count(*) as pct from orders_null")


@query("p3_missing_report", cte("orders_null") + " " + " union all ".join(missing(c) for c in ON))
def p3(spark, sf):
    return profile.missing_report(table(spark, sf, "orders_null").select(*ON))


@query("p4_nullity_correlation", f"""{cte('orders_null')} select 'o_totalprice' as col_a, 'o_orderpriority' as col_b,
  round(corr(case when o_totalprice is null then 1 else 0 end, case when o_orderpriority is null then 1 else 0 end), 6)
  as correlation from orders_null""")
def p4(spark, sf):
    out = profile.nullity_correlation(table(spark, sf, "orders_null").select(*ON))
    return rounded(out, ["correlation"])


def profiled(col: str) -> str:
    return f"""select '{col}' as "column", printf('%.3f%%', (count(*) - count({col})) * 100.0 / count(*)) as missing_values,
    count(distinct {col}) as unique_values, (select string_agg(v, ', ' order by v) from (select distinct
    {col}::varchar as v from orders_null where {col} is not null order by 1 limit 2)) as sample_values from orders_null"""


@query("p5_column_profile", cte("orders_null") + " " + " union all ".join(
    profiled(c) for c in ("o_orderkey", "o_orderstatus", "o_orderpriority")))
def p5(spark, sf):
    return profile.column_profile(
        table(spark, sf, "orders_null").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    )


@query("p6_summary", """select 'count' as summary, count(l_quantity)::varchar as l_quantity,
  count(l_returnflag)::varchar as l_returnflag from lineitem
  union all select 'min', min(l_quantity)::varchar, min(l_returnflag) from lineitem
  union all select 'max', max(l_quantity)::varchar, max(l_returnflag) from lineitem
  union all select s, round(v, 6)::varchar, null from (select unnest(['mean', 'stddev', '25%', '50%', '75%']) as s,
    unnest([avg(l_quantity), stddev_samp(l_quantity), quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5),
    quantile_cont(l_quantity, 0.75)]) as v from lineitem)""")
def p6(spark, sf):
    out = profile.summary(table(spark, sf, "lineitem").select("l_quantity", "l_returnflag"))
    rounded = F.round(F.col("l_quantity").cast("double"), 6).cast("string")
    exact = F.col("summary").isin("count", "min", "max")
    return out.withColumn("l_quantity", F.when(exact, F.col("l_quantity")).otherwise(rounded))


@query("p7_value_counts", f"""{cte('orders_null')} select o_orderpriority, count(*) as n,
  count(*)::double / (select count(*) from orders_null) as share from orders_null group by 1""")
def p7(spark, sf):
    return profile.value_counts(table(spark, sf, "orders_null"), ["o_orderpriority"], dropna=False)


@query("p7_value_counts_ordered", f"""{cte('orders_null')} select d.v as o_orderpriority, position, n, share
  from (values ('5-LOW', 0::integer), ('1-URGENT', 1), ('9-NONE', 2)) d(v, position) left join
  (select o_orderpriority as v, count(*) as n, count(*)::double / (select count(o_orderpriority) from orders_null)
   as share from orders_null group by 1) using (v)""")
def p7_ordered(spark, sf):
    return profile.value_counts(
        table(spark, sf, "orders_null"), ["o_orderpriority"], order=["5-LOW", "1-URGENT", "9-NONE"]
    )


@query("p7_value_counts_pairs", """select l_returnflag, l_linestatus, count(*) as n,
  count(*)::double / (select count(*) from lineitem) as share from lineitem group by 1, 2""")
def p7_pairs(spark, sf):
    return profile.value_counts(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("p8_domain_check", f"""{cte('orders_null')} select coalesce(o_orderpriority, 'All') as value, count(*) as n
  from orders_null where coalesce(o_orderpriority, 'All') not in ('1-URGENT', '2-HIGH', 'All') group by 1""")
def p8(spark, sf):
    return profile.domain_check(
        table(spark, sf, "orders_null"), "o_orderpriority", ["1-URGENT", "2-HIGH", "All"], fill="All"
    )


@query("p8_domain_summary", f"""{cte('orders_null')} select count(*) filter (o_orderpriority is null) as missing_before_fill,
  count(*) filter (o_orderpriority not in ('1-URGENT', '2-HIGH')) as invalid_count from orders_null""")
def p8_summary(spark, sf):
    return profile.domain_summary(
        table(spark, sf, "orders_null"), "o_orderpriority", ["1-URGENT", "2-HIGH", "All"], fill="All"
    )


@query("p9_ranked_distribution", f"""{cte('order_types')} select case when o like 'Pass%' then 0 when o = 'Fail' then 1
  else 3 end::integer as rank, o as outcome, count(*) as n,
  count(*)::double / (select count(*) from order_types) * 100 as pct from (
  select case trim(outcome) when 'pass' then 'Pass' when 'fail' then 'Fail' else 'Pass W/ Conditions' end as o
  from order_types) group by all""")
def p9(spark, sf):
    t = clean.title_case(table(spark, sf, "order_types"), "outcome")
    return profile.ranked_distribution(t, "outcome")


@query("p10_temporal_profile", """select 'year' as part, year(o_orderdate)::varchar as label,
  year(o_orderdate)::integer as position, count(*) as n from orders group by all
  union all select 'month', monthname(o_orderdate), month(o_orderdate)::integer, count(*) from orders group by all""")
def p10(spark, sf):
    return profile.temporal_profile(table(spark, sf, "orders"), "o_orderdate")


@query("p10_temporal_summary", """select min(o_orderdate)::date as first_date, max(o_orderdate)::date as last_date,
  (select year(o_orderdate)::varchar from orders group by 1 order by count(*) desc, 1 limit 1) as busiest_year,
  (select monthname(o_orderdate) from orders group by 1, month(o_orderdate)
   order by count(*) desc, month(o_orderdate) limit 1) as busiest_month from orders""")
def p10_summary(spark, sf):
    return profile.temporal_summary(table(spark, sf, "orders"), "o_orderdate")


@query("p11_crosstab", """select o_orderstatus, o_orderpriority, count(*) as n,
  count(*) * 100.0::double / sum(count(*)) over (partition by o_orderstatus) as pct from orders group by 1, 2""")
def p11(spark, sf):
    return profile.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", normalize=True)


@query("p11_crosstab_margins", """select coalesce(o_orderstatus, 'All') as o_orderstatus,
  coalesce(o_orderpriority, 'All') as o_orderpriority, count(*) as n from orders
  group by cube (o_orderstatus, o_orderpriority)""")
def p11_margins(spark, sf):
    return profile.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", margins=True)


@query("p11_crosstab_wide", """select o_orderpriority, count(*) filter (o_orderstatus = 'F') as "F",
  count(*) filter (o_orderstatus = 'O') as "O", count(*) filter (o_orderstatus = 'P') as "P" from orders group by 1""")
def p11_wide(spark, sf):
    return profile.crosstab_wide(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("p12_group_rate", """select year(o_orderdate)::integer as grp, count(*) as n,
  count(*) filter (o_orderstatus = 'F') as hits,
  count(*) filter (o_orderstatus = 'F') * 100 / count(*)::double as rate from orders group by 1""")
def p12(spark, sf):
    return profile.group_rate(table(spark, sf, "orders"), F.year("o_orderdate"), F.col("o_orderstatus") == "F")


@query("p13_top_k", "select l_partkey, count(*) as n from lineitem group by 1 order by 2 desc, 1 limit 5")
def p13(spark, sf):
    return profile.top_k(table(spark, sf, "lineitem"), ["l_partkey"], 5)


@query("p14_length_distribution", f"{cte('zip_text')} select length(zip)::integer as length, count(*) as n from zip_text group by 1")
def p14(spark, sf):
    return profile.length_distribution(table(spark, sf, "zip_text"), "zip")


@query("p15_prefix_summary", f"""{cte('zip_text')}, z as (select trim(zip) as v, case when trim(zip) like '606%' then 'inner'
  when trim(zip) like '60%' then 'suburb' else 'Other' end as region from zip_text)
  select region, (select count(*) from z where z.region = r.region) as n, coalesce((select string_agg(v, ', ' order by v) from
  (select distinct v from z where z.region = r.region order by v limit 3)), '') as examples
  from (values ('inner'), ('suburb'), ('Other')) r(region)""")
def p15(spark, sf):
    return profile.prefix_summary(table(spark, sf, "zip_text"), "zip", [("inner", "606"), ("suburb", "60")])


@query("p16_not_prefixed", f"{cte('zip_text')} select trim(zip) as zip from zip_text where trim(zip) not like '60%'")
def p16(spark, sf):
    return profile.not_prefixed(table(spark, sf, "zip_text"), "zip", "60")


@query("p17_duplicates_by_key", """select (sum(n) - count(*))::bigint as duplicate_rows, count(*) as duplicate_groups,
  sum(n)::bigint as rows_in_groups from (select count(*) as n from lineitem group by l_orderkey, l_linenumber) where n > 1""")
def p17(spark, sf):
    return profile.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("p17_duplicate_rows", """select coalesce(sum(n) - count(*), 0)::bigint as duplicate_rows, count(*) as duplicate_groups,
  coalesce(sum(n), 0)::bigint as rows_in_groups from (select count(*) as n from
  lineitem group by l_suppkey, l_linenumber, l_quantity) where n > 1""")
def p17_rows(spark, sf):
    return profile.duplicates(table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity"))


@query("p17_duplicate_examples", """select l_orderkey, l_linenumber, l_partkey from lineitem where (l_orderkey, l_linenumber) in
  (select (l_orderkey, l_linenumber) from lineitem group by l_orderkey, l_linenumber having count(*) > 1
   order by l_orderkey, l_linenumber limit 5)""")
def p17_examples(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return profile.duplicate_examples(li, ["l_orderkey", "l_linenumber"])


@query("p18_mapping_conflicts", f"""{cte('cust_nation')} select c_nationkey, count(distinct n_name) as n_values
  from cust_nation group by 1 having count(distinct n_name) > 1""")
def p18(spark, sf):
    return profile.mapping_conflicts(table(spark, sf, "cust_nation"), "c_nationkey", "n_name")


@query("p18_conflict_rows", f"""{cte('cust_nation')} select c_custkey, c_nationkey, n_name from cust_nation where c_nationkey in
  (select c_nationkey from cust_nation group by 1 having count(distinct coalesce(n_name, '?')) > 1)""")
def p18_rows(spark, sf):
    c = table(spark, sf, "cust_nation").select("c_custkey", "c_nationkey", "n_name")
    return profile.conflict_rows(c, "c_nationkey", "n_name", nulls="value")


@query("p19_date_order", """select 'l_shipdate' as first, 'o_orderdate' as second, count(*) as compared,
  count(*) filter (l_shipdate > o_orderdate) as wrong_order from lineitem join orders on l_orderkey = o_orderkey
  union all select 'o_orderdate', 'l_shipdate', count(*), count(*) filter (o_orderdate > l_shipdate)
  from lineitem join orders on l_orderkey = o_orderkey""")
def p19(spark, sf):
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
    return profile.date_order(both, [("l_shipdate", "o_orderdate"), ("o_orderdate", "l_shipdate")])


@query("p20_category_consistency")
def p20(spark, sf):
    return profile.category_consistency(table(spark, sf, "name_typos"), ["typed_name", "p_type"])


@query("p21_quality_score", f"""{cte('orders_null')}, n as (select count(*) as rows, sum((o_totalprice is null)::int
  + (o_orderpriority is null)::int) as nulls, count(distinct o_custkey) as keys,
  count(*) filter (o_orderstatus not in ('O', 'F')) as invalid, max(o_orderdate)::date as newest from orders_null),
  cells as (select o_orderpriority as g, o_orderstatus as o, count(*) as c from orders_null where o_orderpriority is not null
  group by all), shares as (select o, c / sum(c) over (partition by g) as s from cells),
  sd as (select avg(d) as d from (select stddev_samp(s) as d from shares group by o)),
  scores as (select 1 - nulls / (rows * 6)::double as completeness, 1 - (rows - keys) / rows::double as uniqueness,
  1 - least(1, coalesce(d * 5, 0)) as consistency, 1 - invalid / rows::double as validity,
  case when date_diff('day', newest, date '2002-06-01') < 30 then 1.0 when date_diff('day', newest, date '2002-06-01') < 90 then 0.9
  when date_diff('day', newest, date '2002-06-01') < 180 then 0.8 when date_diff('day', newest, date '2002-06-01') < 365 then 0.6
  else 0.4 end::double as timeliness from n, sd)
  select round(completeness, 6) as completeness, round(uniqueness, 6) as uniqueness, round(consistency, 6) as consistency,
  round(validity, 6) as validity, timeliness,
  round((completeness + uniqueness + consistency + validity + timeliness) / 5, 6) as overall from scores""")
def p21(spark, sf):
    scores = profile.quality_score(
        table(spark, sf, "orders_null"), ["o_custkey"], "o_orderpriority", "o_orderstatus", ["O", "F"],
        "o_orderdate", "2002-06-01",
    )
    return rounded(scores, ["completeness", "uniqueness", "consistency", "validity", "overall"])


@query("p22_coordinate_sample", f"""{cte('cust_address')} select latitude, longitude from cust_address
  order by md5(concat('42:', c_custkey)), c_custkey limit 1000""")
def p22(spark, sf):
    return profile.coordinate_sample(
        table(spark, sf, "cust_address"), "latitude", "longitude", 1000, 42, ["c_custkey"]
    )


@query("p23_invalid_causes", f"""{cte('zip_text')}, z as (select nullif(zip, '00000') as zip from zip_text)
  select count(*) filter (bad) as invalid_rows, count(*) filter (bad)::double / count(*) as invalid_share,
  bool_and(zip is null) filter (bad) as all_null from (select zip, nullif(regexp_extract(trim(zip), '\\d{{5}}'), '') is null as bad from z)""")
def p23(spark, sf):
    z = table(spark, sf, "zip_text").withColumn("zip", F.nullif("zip", F.lit("00000")))
    return profile.invalid_causes(clean.clean_zip(z), "zip", "zip_valid")


# --- multi-valued text ------------------------------------------------------------

# Written from how the cells were put together, not by parsing them.
PARTS = """select l_orderkey, l_linenumber, p_size::bigint as violation_code, upper(p_type) as category, p_name as comment
  from lineitem join part on l_partkey = p_partkey where l_linenumber not in (5, 6)
  union all select l_orderkey, l_linenumber, 100 + l_linenumber, 'FLAG ' || l_returnflag || l_linestatus, 'sold, ' || p_brand
  from lineitem join part on l_partkey = p_partkey where l_linenumber in (3, 4, 7)"""


def parsed(spark, sf):
    return multivalue.parse_multivalue(table(spark, sf, "line_text"), ["l_orderkey", "l_linenumber"], "notes")


@query("v1_profile_multivalue", f"""{cte('line_text')}, t as (select notes, case l_linenumber when 1 then 1 when 2 then 2
  when 7 then 3 else 2 end as entries from line_text where notes != '')
  select count(*) as total_samples, avg(length(notes)) as avg_length,
  avg(length(notes) - length(replace(notes, '|', ''))) as avg_pipe, avg(length(notes) - length(replace(notes, '.', ''))) as avg_period,
  avg(length(notes) - length(replace(notes, '-', ''))) as avg_hyphen, avg(length(notes) - length(replace(notes, ':', ''))) as avg_colon,
  avg(length(notes) - length(replace(notes, ';', ''))) as avg_semicolon, min(entries)::integer as min_entries,
  max(entries)::integer as max_entries, avg(entries) as avg_entries, avg((notes not like '%see 12%')::int) as share_numbered,
  1.0::double as share_commented from t""")
def v1(spark, sf):
    return multivalue.profile_multivalue(table(spark, sf, "line_text"), "notes")


@query("v1_entries_distribution", """select case l_linenumber when 1 then 1 when 7 then 3 else 2 end::integer as entries,
  count(*) as n from lineitem where l_linenumber not in (5, 6) group by 1""")
def v1_entries(spark, sf):
    return multivalue.entries_distribution(table(spark, sf, "line_text"), "notes")


@query("v2_validate_multivalue", """select count(*) as total_checked, count(*) filter (l_linenumber != 7) as valid_entries,
  count(*) filter (l_linenumber = 7) as invalid_entries,
  round(count(*) filter (l_linenumber != 7) * 100.0::double / count(*), 2) as validity_percentage
  from lineitem where l_linenumber not in (5, 6)""")
def v2(spark, sf):
    return multivalue.validate_multivalue(table(spark, sf, "line_text"), "notes")


@query("v2_invalid_samples", f"""{cte('line_text')} select notes from line_text where l_linenumber = 7 order by notes limit 5""")
def v2_samples(spark, sf):
    return multivalue.invalid_samples(table(spark, sf, "line_text"), "notes")


@query("v3_parse_multivalue", PARTS)
def v3(spark, sf):
    return parsed(spark, sf)


@query("v4_extract_codes", """select l_orderkey, l_linenumber, case when l_linenumber in (5, 6) then '' else
  p_size || case when l_linenumber = 2 then ',77' when l_linenumber in (3, 4, 7) then ',' || 100 + l_linenumber else '' end end as codes
  from lineitem join part on l_partkey = p_partkey""")
def v4(spark, sf):
    got = multivalue.extract_codes(table(spark, sf, "line_text"), "notes")
    return got.select("l_orderkey", "l_linenumber", F.array_join("codes", ",").alias("codes"))


@query("v5_top_labels", f"select violation_code || '-' || category as code_category, count(*) as n from ({PARTS}) group by 1 order by 2 desc, 1 limit 20")
def v5(spark, sf):
    return multivalue.top_labels(parsed(spark, sf))


@query("v6_attach", f"""select o_orderkey as l_orderkey, o_orderstatus, v.violation_code from orders
  left join ({PARTS}) v on o_orderkey = v.l_orderkey""")
def v6(spark, sf):
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return multivalue.attach(base, parsed(spark, sf), ["l_orderkey"]).select(
        "l_orderkey", "o_orderstatus", "violation_code"
    )


@query("v7_normalize_entity", """select o_custkey, o_orderstatus, o_orderpriority from orders
  qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1""")
def v7(spark, sf):
    entity, _ = multivalue.normalize_tables(
        table(spark, sf, "orders"), "o_custkey", ["o_custkey", "o_orderstatus", "o_orderpriority"],
        ["o_orderkey"], [F.col("o_orderdate"), F.col("o_orderkey")],
    )
    return entity


@query("v7_normalize_event", "select o_orderkey, o_custkey, o_orderdate::date as o_orderdate, o_orderpriority from orders")
def v7_event(spark, sf):
    _, event = multivalue.normalize_tables(
        table(spark, sf, "orders"), "o_custkey", ["o_custkey"],
        ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"], [F.col("o_orderkey")],
    )
    return event.withColumn("o_orderdate", F.to_date("o_orderdate"))


@query("v8_top_codes", f"select violation_code, min(category) as category, count(*) as n from ({PARTS}) group by 1 order by 3 desc, 1 limit 10")
def v8(spark, sf):
    return multivalue.top_codes(parsed(spark, sf))


@query("v9_top_codes_dimension", f"""with c as (select distinct p_size::bigint as violation_code, 'size ' || p_size as category from part)
  select violation_code, c.category, count(*) as n from ({PARTS}) v join c using (violation_code) group by 1, 2 order by 3 desc, 1 limit 10""")
def v9(spark, sf):
    sizes = table(spark, sf, "part").select(
        F.col("p_size").cast("bigint").alias("violation_code"),
        F.concat(F.lit("size "), "p_size").alias("category"),
    )
    return multivalue.top_codes(parsed(spark, sf), sizes.distinct())
