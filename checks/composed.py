"""The composed jobs over the supplied tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.inputs import cte, table
from checks.mining import FACTS, fd_sql
from checks.registry import query
from tablewright.functions.frames import scratch_path
from tablewright.plans import jobs


def zips(spark, sf) -> DataFrame:
    """One state and city per zip of the raw inspections."""
    n = table(spark, sf, "nation")
    return n.select(
        (60600 + F.col("n_nationkey")).cast("string").alias("zip"),
        F.lit("IL").alias("state"),
        F.lit("CHICAGO").alias("city"),
    )


def answers(spark, sf) -> DataFrame:
    """Geocoder answers for every customer, a match for the even ones."""
    c = table(spark, sf, "customer")
    even = F.col("c_custkey") % 2 == 0
    line = F.concat(F.col("c_custkey"), F.lit(" Main ST, Chicago, IL, "), 60600 + F.col("c_nationkey"))
    return c.select(
        F.col("c_custkey").cast("string").alias("ID"), line.alias("input_address"),
        F.when(even, "Match").otherwise("No_Match").alias("match_status"),
        F.when(even, F.concat(F.lit("-88."), "c_custkey", F.lit(",42.0"))).alias("location"),
    )


def cleaned(spark, sf) -> DataFrame:
    return jobs.clean_inspections(table(spark, sf, "raw_inspections"), zips(spark, sf), answers(spark, sf))


# Expected values from how the raw rows were made.  Facility types come back per license
# (dba_name), zips per address; an address without any zip keeps none.
CLEANED = f"""{cte('raw_inspections')}, base as (select o_orderkey as k, o_custkey as cust, o_orderpriority as p,
  o_orderstatus as st, o_orderdate as d, c_nationkey as nat, c_name, o_orderkey % 11 = 0 as no_zip, o_orderkey % 7 as city_case,
  o_orderkey % 6 = 5 as no_type from orders join customer on o_custkey = c_custkey),
  known as (select cust, bool_or(not no_type) as has_type, bool_or(not no_zip) as has_zip from base group by 1)
  select k as inspection_id, cust::varchar as license_num, lower(c_name) as dba_name, lower(c_name) as aka_name,
  case p when '1-URGENT' then 'High' when '2-HIGH' then 'Medium' when '3-MEDIUM' then 'Low' else 'All' end as risk,
  case cust % 5 when 0 then 'Grocery Store' when 1 then 'Restaurant' when 2 then 'Ice Cream Shop' when 3 then 'Hookah Lounge'
    else 'School' end as facility_type,
  case when has_zip then (60600 + nat)::varchar end as zip, d::date as inspection_date
  from base join known using (cust) where has_type"""


@query("w1_clean", CLEANED)
def w1(spark, sf):
    out = cleaned(spark, sf)
    return out.select(
        "inspection_id", "license_num", "dba_name", "aka_name", "risk", "facility_type", "zip",
        F.to_date("inspection_date").alias("inspection_date"),
    )


# Names as they stand when missing cities are filled from the same address.
@query("w1_clean_cities", """with base as (select o_custkey as cust, o_orderkey % 6 != 5 as typed, case o_orderkey % 7
    when 0 then case when o_orderkey % 11 = 0 then null else 'CHICAGO' end when 3 then 'BEDFORD  PARK'
    when 4 then 'OLYMPIA FIELD' else 'CHICAGO' end as c from orders),
  usual as (select cust, c as m from (select cust, c, count(*) as n from base where c is not null group by all)
    qualify row_number() over (partition by cust order by n desc, c) = 1),
  kept as (select cust from base group by 1 having bool_or(typed))
  select case coalesce(c, m) when 'BEDFORD  PARK' then 'BEDFORD PARK' when 'OLYMPIA FIELD' then 'OLYMPIA FIELDS'
    else coalesce(c, m) end as city, count(*) as n from base join kept using (cust) left join usual using (cust) group by 1""")
def w1_cities(spark, sf):
    return cleaned(spark, sf).groupBy("city").agg(F.count(F.lit(1)).alias("n"))


def typed(spark, sf) -> DataFrame:
    """Inspections with names and types in order, not cleaned further."""
    from tablewright.operators import clean

    raw = clean.normalize_columns(table(spark, sf, "raw_inspections"))
    return clean.enforce_schema(raw, jobs.INSPECTIONS)


@query("w2_profile_rows", """select * from (values ('states', 2), ('zip_lengths', 2), ('top_zips', 5), ('results', 3),
  ('inspection_types', 2), ('risk', 4), ('coordinates', 1000)) t(report, n)""")
def w2(spark, sf):
    reports = jobs.profile_inspections(typed(spark, sf), as_of="2002-06-01")
    shown = ("states", "zip_lengths", "top_zips", "results", "inspection_types", "risk", "coordinates")
    counts = [
        reports[r].agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(r).alias("report"), "n")
        for r in shown
    ]
    return reduce(DataFrame.union, counts)


@query("w3_normalize_and_load", """select 'violations' as table_name, count(*) * 2 as n from orders where o_orderkey % 4 != 0
  union all select 'facility', count(distinct o_custkey) from orders union all select 'inspection', count(*) from orders""")
def w3(spark, sf):
    path = scratch_path(spark, "inspections_db")
    database = path.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"create database {database} location '{path}'")
    out = jobs.normalize_and_load(typed(spark, sf), database)
    counts = [
        out[t].agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
        for t in ("violations", "facility", "inspection")
    ]
    return reduce(DataFrame.union, counts)


@query("w4_mine_dependencies", f"{fd_sql()} select * from minimal")
def w4(spark, sf):
    out = jobs.mine_dependencies(table(spark, sf, "order_facts"), FACTS)
    return out["fds"].select(F.array_join("lhs", ",").alias("lhs"), "rhs")


@query("w5_repair_by_afds", """select c_custkey, c_nationkey, n_name, r_name from customer
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def w5(spark, sf):
    base = (
        table(spark, sf, "customer")
        .join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    holes = base.select(
        "c_custkey", "c_nationkey",
        F.expr("case when c_custkey % 5 = 0 then null else n_name end as n_name"),
        F.expr("case when c_custkey % 9 = 0 then null else r_name end as r_name"),
    )
    columns = ["c_nationkey", "n_name", "r_name"]
    return jobs.repair_by_afds(holes, columns, ["c_nationkey → n_name", "c_nationkey → r_name"])["repaired"]
