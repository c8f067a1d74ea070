"""Input tables derived from the supplied ones, in Spark and as SQL common table expressions.

The supplied tables are clean, so dirt is put in by expressions on keys.  Every row of
every table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# name -> (columns, from clause); the expressions are read by both engines.
DERIVED = {
    # Orders with missing values.
    "orders_null": (
        """o_orderkey, o_custkey, o_orderstatus,
        case when o_orderkey % 11 = 0 then null else o_totalprice end as o_totalprice,
        o_orderdate,
        case when o_orderkey % 7 = 0 then null else o_orderpriority end as o_orderpriority""",
        "orders",
    ),
    # Customers with their nation, partly missing, partly wrong.
    "cust_nation": (
        """c_custkey, c_name, c_nationkey, c_mktsegment,
        case when c_custkey % 5 = 0 then null when c_custkey % 97 = 1 then 'NATION_X'
        else n_name end as n_name,
        case when c_custkey % 9 = 0 then null else r_name end as r_name""",
        """customer join nation on c_nationkey = n_nationkey
        join region on n_regionkey = r_regionkey""",
    ),
    # Orders with customer and nation: many dependencies, no missing values.
    "order_facts": (
        """o_orderkey, o_custkey, o_orderstatus, o_orderpriority, c_mktsegment, n_name,
        n_regionkey, o_orderdate""",
        """orders join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey""",
    ),
    # Orders as raw text.
    "raw_orders": (
        """case when o_orderkey % 10 = 9 then 'nan' when o_orderkey % 3 = 0
        then concat(' ', o_orderkey, '.0 ') when o_orderkey % 3 = 1
        then concat('00', o_orderkey) else cast(o_orderkey as string) end as order_id,
        case when o_orderkey % 13 = 0 then 'unknown' when o_orderkey % 13 = 1 then null
        else concat(lpad(cast(month(o_orderdate) as string), 2, '0'), '/',
        lpad(cast(day(o_orderdate) as string), 2, '0'), '/', year(o_orderdate)) end
        as order_date,
        case when o_orderkey % 17 = 0 then 'n/a'
        else cast(cast(floor(o_totalprice) as bigint) as string) end as total,
        case when o_orderkey % 19 = 0 then 'NaN' else concat('  ', o_orderpriority, ' ')
        end as priority,
        o_orderkey, o_orderstatus""",
        "orders",
    ),
    # Postal codes in five spellings.
    "zip_text": (
        """c_custkey, case when c_custkey % 5 = 0 then '00000'
        when c_custkey % 5 = 1 then concat(lpad(cast(c_custkey as string), 5, '6'), '.0')
        when c_custkey % 5 = 2 then concat(lpad(cast(c_custkey as string), 5, '0'), '-1234')
        when c_custkey % 5 = 3 then concat(' ', lpad(cast(c_custkey % 1000 as string), 4, '1'))
        else lpad(cast(60600 + c_custkey % 50 as string), 5, '0') end as zip,
        n_name, c_mktsegment""",
        "customer join nation on c_nationkey = n_nationkey",
    ),
    # One multi-valued text cell per line item.
    "line_text": (
        """l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
        case when l_linenumber = 6 then null when l_linenumber = 5 then '' else
        concat(p_size, '. ', upper(p_type), ' - Comments: ', p_name,
        case when l_linenumber = 2 then ' | 77. NO COMMENT' else '' end,
        case when l_linenumber >= 3 then concat(' | ', 100 + l_linenumber, '. FLAG ',
        l_returnflag, l_linestatus, ' - Comments: sold, ', p_brand) else '' end,
        case when l_linenumber = 7 then ' | see 12 above |' else '' end) end as notes,
        p_size, p_type, p_name, p_brand, l_returnflag, l_linestatus""",
        "lineitem join part on l_partkey = p_partkey",
    ),
    # Line items with the categories rules are mined from.
    "line_facts": (
        """p_type, l_returnflag, o_orderpriority, o_orderstatus, p_brand,
        case when l_linenumber = 6 then null else concat(l_linenumber % 3, '. LINE - Comments: x | ',
        100 + case when l_linenumber = 1 then 0 else p_size % 3 end, '. SIZE - Comments: y') end as notes""",
        """lineitem join part on l_partkey = p_partkey
        join orders on l_orderkey = o_orderkey""",
    ),
    # Part names, some with a letter dropped or two letters swapped.
    "name_typos": (
        """p_partkey, p_name, p_type, case when p_partkey % 13 = 0
        then concat(substr(p_name, 1, 1), substr(p_name, 3)) when p_partkey % 13 = 1
        then concat(substr(p_name, 1, 2), substr(p_name, 4, 1), substr(p_name, 3, 1),
        substr(p_name, 5)) when p_partkey % 13 = 2 then upper(p_name)
        when p_partkey % 13 = 3 then null else p_name end as typed_name""",
        "part",
    ),
    # Addresses of customers; some lack coordinates.
    "cust_address": (
        """c_custkey, concat(c_custkey % 200, '  n ', lower(c_mktsegment),
        case when c_custkey % 2 = 0 then ' st' else ' ave' end,
        case when c_custkey % 4 = 0 then ' (rear (2nd)) ' when c_custkey % 4 = 1
        then ' (unit ' else '' end) as address,
        upper(r_name) as city, substr(n_name, 1, 2) as state,
        lpad(cast(n_nationkey as string), 5, '7') as zip,
        case when c_custkey % 3 = 0 then null else c_acctbal / 1000 end as latitude,
        case when c_custkey % 6 = 0 then null else -c_acctbal / 1000 end as longitude,
        case when c_custkey % 3 = 0 then null else concat('p', c_custkey) end as location""",
        """customer join nation on c_nationkey = n_nationkey
        join region on n_regionkey = r_regionkey""",
    ),
    # Inspection-like type texts.
    "order_types": (
        """o_orderkey, o_orderdate, o_custkey,
        case when o_orderstatus = 'F' and o_orderkey % 3 = 0 then null else
        concat(case o_orderpriority when '1-URGENT' then ' Canvass'
        when '2-HIGH' then 'Consumer request' when '3-MEDIUM' then 'LICENSE'
        when '4-NOT SPECIFIED' then 'Task  Force' else 'out of hours' end,
        case when o_orderkey % 4 = 0 then ' Re-Inspection ' when o_orderkey % 4 = 1
        then ' follow.up' else '' end) end as kind,
        case o_orderstatus when 'O' then ' pass' when 'F' then 'fail '
        else 'pass w/ conditions' end as outcome,
        case o_orderpriority when '1-URGENT' then 'Risk 1 (High)'
        when '2-HIGH' then 'Risk 2 (Medium)' when '3-MEDIUM' then 'Risk 3 (Low)'
        when '4-NOT SPECIFIED' then 'All' else null end as risk""",
        "orders",
    ),
    # Free-text facility types.
    "facility_text": (
        """p_partkey, case p_type when 'ECONOMY' then concat('(hooka ', p_size, ')')
        when 'SMALL' then 'Grocery  Store 2014' when 'MEDIUM' then 'restuarant tavern'
        when 'PROMO' then 'childrens services facilty' when 'STANDARD'
        then 'ice cream parlor' else concat(upper(p_name), ' mobile') end as facility_type""",
        "part",
    ),
    # Raw inspections under their own headers: text throughout, dirty in every column.
    "raw_inspections": (
        """cast(o_orderkey as string) as `Inspection ID`, concat(' ', upper(c_name)) as `DBA Name`,
        case when o_orderkey % 3 = 0 then 'nan' else c_name end as `AKA Name`,
        concat(o_custkey, '.0') as `License #`,
        case when o_orderkey % 6 = 5 then null when o_custkey % 5 = 0 then 'Grocery  Store 2014'
        when o_custkey % 5 = 1 then 'restuarant' when o_custkey % 5 = 2 then '(ice cream parlor)'
        when o_custkey % 5 = 3 then 'hooka bar' else 'School' end as `Facility Type`,
        case o_orderpriority when '1-URGENT' then 'Risk 1 (High)' when '2-HIGH'
        then 'Risk 2 (Medium)' when '3-MEDIUM' then 'Risk 3 (Low)' else null end as `Risk`,
        concat(o_custkey, ' main st') as `Address`,
        case when o_orderkey % 7 = 0 then null when o_orderkey % 7 = 1 then 'chicago.'
        when o_orderkey % 7 = 2 then 'CHICAGOO' when o_orderkey % 7 = 3 then 'BEDFORD  PARK'
        when o_orderkey % 7 = 4 then 'Olympia Field' else 'Chicago' end as `City`,
        case when o_orderkey % 5 = 0 then null else 'IL' end as `State`,
        case when o_orderkey % 11 = 0 then null
        else concat(60600 + c_nationkey, '.0') end as `Zip`,
        concat(lpad(cast(month(o_orderdate) as string), 2, '0'), '/',
        lpad(cast(day(o_orderdate) as string), 2, '0'), '/', year(o_orderdate))
        as `Inspection Date`,
        case when o_orderkey % 2 = 0 then 'Canvass Re-Inspection' else 'License' end
        as `Inspection Type`,
        case o_orderstatus when 'O' then 'Pass' when 'F' then 'Fail'
        else 'Pass w/ Conditions' end as `Results`,
        case when o_orderkey % 4 = 0 then null else concat(30 + o_orderkey % 4,
        '. FOOD AND - Comments: a b | ', 32 + o_orderkey % 2, '. SEWAGE - Comments: x, 5. Bad')
        end as `Violations`,
        case when o_orderkey % 9 = 0 then null else '41.5' end as `Latitude`,
        case when o_orderkey % 9 = 0 then null else '-87.5' end as `Longitude`,
        case when o_orderkey % 9 = 0 then null else concat('(41.5, -', o_custkey, ')') end as `Location`""",
        """orders join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey""",
    ),
}

# Expressions of the texts above that the two engines spell differently.
_SQL_SPELLING = (("cast(o_orderkey as string)", "cast(o_orderkey as varchar)"),
                 (" as string)", " as varchar)"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied or derived table."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    columns, source = DERIVED[name]
    views = {t: table(spark, sf_dir, t) for t in TABLES if t in source.split()}
    # Frames are passed by name, so parallel sessions share no temporary views.
    for t in views:
        source = " ".join("{" + t + "}" if w == t else w for w in source.split())
    return spark.sql(f"select {columns.replace('{', '{{')} from {source}", **views)


def cte(*names: str) -> str:
    """The same derived tables for the SQL side."""
    out = []
    for name in names:
        columns, source = DERIVED[name]
        for ours, theirs in _SQL_SPELLING:
            columns = columns.replace(ours, theirs).replace("`", '"')
        out.append(f"{name} as (select {columns} from {source})")
    return "with " + ",\n".join(out)
