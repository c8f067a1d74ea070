"""Sources, row selection and column cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.inputs import cte, table
from checks.registry import query
from tablewright.functions.frames import scratch_path
from tablewright.operators import clean, rows
from tablewright.sources import files, tables

O_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("s1_csv_scan", f"select cast(o_orderkey as varchar) as o_orderkey, o_custkey, o_orderstatus, "
       "o_totalprice, o_orderpriority from orders")
def s1(spark, sf):
    path = scratch_path(spark, "orders-csv")
    files.write_csv(table(spark, sf, "orders").select(*ORDERS), path)
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    return files.read_table(spark, path, schema, overrides={"o_orderkey": "string"})


@query("s2_csv_encodings", "select doc_id, text from documents")
def s2(spark, sf):
    path = scratch_path(spark, "documents-csv")
    files.write_csv(table(spark, sf, "documents").select("doc_id", "text"), path)
    return files.read_table(
        spark, path, "doc_id bigint, text string",
        encodings=["utf-8", "latin1", "iso-8859-1", "cp1252"], multiline=True,
    )


# The same texts in a single-byte encoding, which is not valid UTF-8.
@query("s2_csv_latin1", "select doc_id, text from documents")
def s2_latin1(spark, sf):
    path = scratch_path(spark, "documents-latin1")
    files.write_csv(table(spark, sf, "documents").select("doc_id", "text"), path, encoding="ISO-8859-1")
    return files.read_table(spark, path, "doc_id bigint, text string", encodings=["utf-8", "latin1"], multiline=True)


@query("s3_csv_sink", "select lang, source, count(*) as n, cast(sum(length(text)) as bigint) as letters "
       "from documents group by all")
def s3(spark, sf):
    path = scratch_path(spark, "documents-csv")
    files.write_csv(table(spark, sf, "documents"), path)
    back = files.read_table(
        spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint", multiline=True
    )
    return back.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("letters")
    )


GEO = """select cast(c_custkey as varchar) as "ID", concat(address, ', ', city) as input_address,
  case when c_custkey % 2 = 0 then 'Match' else 'No_Match' end as match_status,
  concat(c_custkey % 90, '.5,', c_custkey % 45, '.25') as location from cust_address"""


def geo_file(spark, sf):
    """Geocoder answers for the customers, as a header-less quoted file."""
    a = table(spark, sf, "cust_address")
    empty = F.lit(None).cast("string")
    rows_ = a.select(
        F.col("c_custkey").cast("string"),
        F.concat_ws(", ", "address", "city"),
        F.when(F.col("c_custkey") % 2 == 0, "Match").otherwise("No_Match"),
        empty.alias("t"), empty.alias("m"),
        F.concat(F.col("c_custkey") % 90, F.lit(".5,"), F.col("c_custkey") % 45, F.lit(".25")),
        *[empty.alias(f"e{i}") for i in range(6)],
    )
    path = scratch_path(spark, "geocoded")
    rows_.write.option("quoteAll", True).option("escape", '"').option("nullValue", None).csv(path)
    return path


@query("s4_geocode_scan", f"{cte('cust_address')} {GEO}")
def s4(spark, sf):
    got = files.read_geocode_results(spark, geo_file(spark, sf))
    # Blanks around an address survive the file only inside quotes.
    return got.select("ID", "input_address", "match_status", "location")


@query("s5_table_sink", "select 25::bigint as n_rows, 3::integer as n_columns, 2::bigint as loads, "
       "(select count(*) from nation) * 2 as stored")
def s5(spark, sf):
    path = scratch_path(spark, "check_db")
    database = path.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"create database {database} location '{path}'")
    for mode in ("replace", "append"):
        tables.save_table(table(spark, sf, "nation"), f"{database}.nation", mode)
    meta = spark.table(tables.metadata_table(f"{database}.nation"))
    stored = spark.table(f"{database}.nation").agg(F.count(F.lit(1))).scalar()
    return meta.groupBy(F.col("rows").alias("n_rows"), F.col("columns").alias("n_columns")).agg(
        F.count(F.lit(1)).alias("loads"), stored.alias("stored")
    )


@query("s6_run_sql", "select c_mktsegment, count(*) as n, max(c_custkey) as last_key from customer group by all")
def s6(spark, sf):
    table(spark, sf, "customer").createOrReplaceTempView("check_customer")
    return tables.run_sql(
        spark,
        "select c_mktsegment, count(*) as n, max(c_custkey) as last_key from check_customer group by 1",
    )


@query("s7_report_round_trip", """select o_orderpriority as fd, count(*) as n_details,
  count(distinct o_orderstatus) as n_status from orders group by 1""")
def s7(spark, sf):
    o = table(spark, sf, "orders")
    details = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    # At most one entry per status.
    nested = details.groupBy(F.col("o_orderpriority").alias("fd")).agg(
        F.collect_list(F.struct("o_orderstatus", "n")).alias("details")
    )
    path = scratch_path(spark, "report")
    files.write_report(nested, path)
    back = files.read_report(spark, path, nested.schema)
    return back.select(
        "fd",
        F.aggregate("details", F.lit(0).cast("long"), lambda a, d: a + d["n"]).alias("n_details"),
        F.size("details").cast("long").alias("n_status"),
    )


@query("s8_sample_n", f"select {O_COLS} from orders order by md5(concat('7:', o_orderkey)), o_orderkey limit 1000")
def s8(spark, sf):
    return rows.sample_n(table(spark, sf, "orders"), 1000, 7, ["o_orderkey"]).select(*ORDERS)


@query("s9_project", "select o_orderkey, o_orderpriority from orders")
def s9(spark, sf):
    return rows.project(
        table(spark, sf, "orders"),
        keep=["o_orderkey", "o_orderpriority", "o_orderstatus", "no_such_column"],
        drop=["o_orderstatus"],
        strict=False,
    )


@query("s10_drop_nulls", f"{cte('orders_null')} select {O_COLS} from orders_null "
       "where o_orderpriority is not null and o_totalprice is not null")
def s10(spark, sf):
    return rows.drop_nulls(table(spark, sf, "orders_null").select(*ORDERS))


@query("s11_fill_sentinel", f"{cte('orders_null')} select cast(o_orderkey as varchar) as o_orderkey, "
       "coalesce(o_orderpriority, '__NULL__') as o_orderpriority from orders_null")
def s11(spark, sf):
    return rows.fill_sentinel(table(spark, sf, "orders_null").select("o_orderkey", "o_orderpriority"))


@query("c1_normalize_columns", "select o_orderkey as order_id, o_custkey as license_num, "
       "o_orderpriority as inspection_type from orders")
def c1(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Order ID"),
        F.col("o_custkey").alias("License #"),
        F.col("o_orderpriority").alias("Inspection Type"),
    )
    return clean.normalize_columns(raw)


RAW_SCHEMA = T.StructType(
    [
        T.StructField("order_id", T.StringType()),
        T.StructField("order_date", T.DateType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("o_orderkey", T.LongType()),
    ]
)


@query("c2_enforce_schema", f"""{cte('raw_orders')} select o_orderkey,
  case when order_id = 'nan' then null else order_id end as order_id,
  cast(try_strptime(order_date, '%m/%d/%Y') as date) as order_date, try_cast(total as double) as total
  from raw_orders""")
def c2(spark, sf):
    raw = table(spark, sf, "raw_orders").select("o_orderkey", "order_id", "order_date", "total")
    return clean.enforce_schema(raw, RAW_SCHEMA)


@query("c3_schema_compliance", f"""{cte('orders_null')}, c as (select count(*) n,
  count(o_totalprice) p, count(o_orderpriority) q from orders_null)
  select 'o_orderkey' as "column", 'bigint' as expected_type, 'bigint' as actual_type, true as is_compliant,
    0::bigint as missing_values, 0.0::double as missing_pct from c
  union all select 'o_totalprice', 'string', 'double', false, n - p, round((n - p) * 100.0::double / n, 2) from c
  union all select 'o_orderpriority', 'string', 'string', true, n - q, round((n - q) * 100.0::double / n, 2) from c
  union all select 'zip', 'string', 'MISSING', false, null, null from c""")
def c3(spark, sf):
    want = T.StructType(
        [
            T.StructField("o_orderkey", T.LongType()),
            T.StructField("o_totalprice", T.StringType()),
            T.StructField("o_orderpriority", T.StringType()),
            T.StructField("zip", T.StringType()),
        ]
    )
    return clean.schema_compliance(table(spark, sf, "orders_null"), want)


@query("c4_clean_identifier", f"""{cte('raw_orders')} select o_orderkey, case when order_id = 'nan' then null
  when o_orderkey % 3 = 0 then cast(o_orderkey as varchar)
  when o_orderkey % 3 = 1 then '00' || o_orderkey else cast(o_orderkey as varchar) end as order_id
  from raw_orders""")
def c4(spark, sf):
    return clean.clean_identifier(table(spark, sf, "raw_orders").select("o_orderkey", "order_id"), "order_id")


ZIP = "nullif(nullif(regexp_extract(trim(zip), '(\\d{5})', 1), ''), '00000')"


@query("c5_clean_zip", f"""{cte('zip_text')} select c_custkey, zip, {ZIP} as zip_clean,
  {ZIP} is not null as zip_valid from zip_text""")
def c5(spark, sf):
    return clean.clean_zip(table(spark, sf, "zip_text").select("c_custkey", "zip"))


@query("c6_map_exact", f"""{cte('order_types')} select o_orderkey, case risk when 'Risk 1 (High)' then 'High'
  when 'Risk 2 (Medium)' then 'Medium' when 'Risk 3 (Low)' then 'Low' else 'All' end as risk from order_types""")
def c6(spark, sf):
    return clean.map_exact(
        table(spark, sf, "order_types").select("o_orderkey", "risk"), "risk",
        {"Risk 1 (High)": "High", "Risk 2 (Medium)": "Medium", "Risk 3 (Low)": "Low"},
    )


@query("c7_split_category", f"""{cte('order_types')} select o_orderkey, risk,
  case when risk like 'Risk%' then try_cast(substr(risk, 6, 1) as integer) end as risk_level,
  case when risk like 'Risk%' then rtrim(substr(risk, 9), ')') end as frequency from order_types""")
def c7(spark, sf):
    return clean.split_category(
        table(spark, sf, "order_types").select("o_orderkey", "risk"), "risk",
        r"Risk (\d+) \((.*?)\)", {"risk_level": "int", "frequency": "string"},
    )


@query("c8_standardize_text", f"""{cte('raw_orders')} select o_orderkey,
  nullif(lower(trim(priority)), 'nan') as priority, lower(o_orderstatus) as o_orderstatus from raw_orders""")
def c8(spark, sf):
    return clean.standardize_text(table(spark, sf, "raw_orders").select("o_orderkey", "priority", "o_orderstatus"))


@query("c9_fill_from", f"""{cte('name_typos')} select p_partkey, p_name, coalesce(typed_name, p_name) as typed_name
  from name_typos""")
def c9(spark, sf):
    return clean.fill_from(table(spark, sf, "name_typos").select("p_partkey", "p_name", "typed_name"),
                           "typed_name", "p_name")


@query("c10_fill_by_lookup", f"""{cte('cust_nation')} select c_custkey, c_nationkey,
  coalesce(c.n_name, n.n_name) as n_name from cust_nation c left join nation n on c_nationkey = n_nationkey""")
def c10(spark, sf):
    c = table(spark, sf, "cust_nation").select("c_custkey", "c_nationkey", "n_name")
    return clean.fill_by_lookup(c, "n_name", "c_nationkey", table(spark, sf, "nation"), "n_nationkey", "n_name")


# Written from how the addresses were built, not by stripping brackets again.
ADDRESS = """concat(c_custkey % 200, ' N ', upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2)),
  case when c_custkey % 2 = 0 then ' ST' else ' AVE' end)"""


@query("c11_format_address", f"select c_custkey, {ADDRESS} as address from customer")
def c11(spark, sf):
    return clean.format_address(table(spark, sf, "cust_address").select("c_custkey", "address"), "address")


@query("c12_geocode_requests", f"""{cte('cust_address')} select distinct
  md5(concat(street, '|', city, '|', state, '|', zip)) as id, street, city, state, zip from (
  select {ADDRESS} as street, a.city, a.state, a.zip from cust_address a join customer using (c_custkey)
  where latitude is null or longitude is null)""")
def c12(spark, sf):
    return clean.geocode_requests(table(spark, sf, "cust_address"))


ANSWERS = f"""answers as (select street || ', ' || city || ', ' || state || ', ' || zip as full_address,
  max(c_custkey) as k from (select {ADDRESS} as street, a.* from cust_address a join customer using (c_custkey))
  where c_custkey % 4 != 3 group by 1)"""


@query("c13_merge_geocodes", f"""{cte('cust_address')}, {ANSWERS}
  select a.c_custkey, case when (latitude is null or longitude is null) and k is not null
    then (k % 45) + 0.25::double else latitude end as latitude,
  case when (latitude is null or longitude is null) and k is not null
    then (k % 90) + 0.5::double else longitude end as longitude
  from (select {ADDRESS} as street, a.* from cust_address a join customer using (c_custkey)) a
  left join answers on street || ', ' || city || ', ' || state || ', ' || zip = full_address""")
def c13(spark, sf):
    a = table(spark, sf, "cust_address")
    street = clean.format_address(a, "address")
    k = F.col("c_custkey")
    answers = street.select(
        F.lpad(k.cast("string"), 12, "0").alias("ID"),
        F.concat_ws(", ", "address", "city", "state", "zip").alias("input_address"),
        F.when(k % 4 == 3, "No_Match").otherwise("Match").alias("match_status"),
        F.concat(k % 90, F.lit(".5,"), k % 45, F.lit(".25")).alias("location"),
    )
    return clean.merge_geocodes(a, answers).select("c_custkey", "latitude", "longitude")


@query("c14_discretize", """select o_orderkey, cast(cast(floor(o_totalprice) as bigint) as varchar) as o_totalprice
  from orders""")
def c14(spark, sf):
    return clean.discretize(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])


@query("c15_fill_audit", """select case when c_nationkey % 2 = 0 then 'Filled' else 'Still Missing' end as status,
  count(*) as n from customer where c_custkey % 5 = 0 group by 1""")
def c15(spark, sf):
    c = table(spark, sf, "cust_nation").select("c_custkey", "c_nationkey", "n_name")
    nation = table(spark, sf, "nation").withColumn("n_name", F.expr("case when n_nationkey % 2 = 0 then n_name end"))
    filled = clean.fill_by_lookup(c, "n_name", "c_nationkey", nation, "n_nationkey", "n_name")
    return clean.fill_summary(clean.fill_audit(c, filled, "c_custkey", "n_name"))


@query("c16_date_parts", f"""{cte('raw_orders')} select o_orderkey, cast(year(d) as integer) as year,
  cast(month(d) as integer) as month, monthname(d) as month_name
  from (select o_orderkey, try_strptime(order_date, '%m/%d/%Y') as d from raw_orders)""")
def c16(spark, sf):
    r = table(spark, sf, "raw_orders").select("o_orderkey", "order_date")
    return clean.date_parts(r, "order_date", ["MM/dd/yyyy"]).drop("order_date")


@query("c17_categorize", f"""{cte('order_types')} select o_orderkey, case when kind is null then null
  when base = 'other' then base when kind ilike '%re-inspect%' or kind like '%follow.up%'
  then base || ' (re-inspection)' else base end as standardized
  from (select *, case when kind ilike '%canvass%' then 'canvass' when kind ilike '%consumer%' then 'complaint'
  when kind ilike '%license%' then 'license' when kind ilike '%task%force%' then 'task-force inspection'
  else 'other' end as base from order_types)""")
def c17(spark, sf):
    t = table(spark, sf, "order_types").select("o_orderkey", "kind")
    return clean.categorize(t, "kind", "standardized").drop("kind")


@query("c18_clean_category_text", """select p_partkey, case p_type when 'ECONOMY' then 'Hookah ' || p_size
  when 'SMALL' then 'Grocery Store' when 'MEDIUM' then 'Restaurant Restaurant'
  when 'PROMO' then 'Children''S Services Facility' when 'STANDARD' then 'Ice Cream Shop'
  else array_to_string(list_transform(string_split(p_name || ' mobile', ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') end as facility_type from part""")
def c18(spark, sf):
    return clean.clean_category_text(table(spark, sf, "facility_text"), "facility_type")


@query("c19_consolidate", """select p_partkey, case p_type when 'ECONOMY' then 'Hookah Lounge'
  when 'SMALL' then 'Grocery Store' when 'MEDIUM' then 'Restaurant Restaurant'
  when 'PROMO' then 'Children''s Services Facility' when 'STANDARD' then 'Ice Cream Shop'
  else array_to_string(list_transform(string_split(p_name || ' mobile', ' '),
    lambda w: upper(w[1]) || lower(w[2:])), ' ') end as facility_type from part""")
def c19(spark, sf):
    cleaned = clean.clean_category_text(table(spark, sf, "facility_text"), "facility_type")
    return clean.consolidate(cleaned, "facility_type")


@query("c20_title_case", f"""{cte('order_types')} select o_orderkey, case trim(outcome) when 'pass' then 'Pass'
  when 'fail' then 'Fail' else 'Pass W/ Conditions' end as outcome from order_types""")
def c20(spark, sf):
    return clean.title_case(table(spark, sf, "order_types").select("o_orderkey", "outcome"), "outcome")


@query("c21_normalize_name", """select doc_id, regexp_replace(regexp_replace(upper(trim(source || ' - ' || lang
  || '  x.')), '[^A-Z\\s]', '', 'g'), '\\s+', ' ', 'g') as name from documents""")
def c21(spark, sf):
    d = table(spark, sf, "documents")
    named = d.select("doc_id", F.concat("source", F.lit(" - "), "lang", F.lit("  x.")).alias("name"))
    return clean.normalize_name(named, "name")
