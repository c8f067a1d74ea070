"""Run the registered queries and their SQL twins side by side.

``python -m checks.compare SF_DIR [name-prefix ...]``
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from checks.inputs import TABLES

KINDS = {
    T.LongType: "BIGINT",
    T.IntegerType: "INTEGER",
    T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR",
    T.BooleanType: "BOOLEAN",
    T.DateType: "DATE",
    T.TimestampType: "TIMESTAMP",
    T.TimestampNTZType: "TIMESTAMP",
}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("tablewright-checks")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


def _key(row):
    # Floats last and rounded, so that noise does not change the order.
    return [
        (v is None, f"{v:.6g}" if isinstance(v, float) else str(v))
        for v in sorted_floats_last(row)
    ]


def sorted_floats_last(row):
    return [v for v in row if not isinstance(v, float)] + [v for v in row if isinstance(v, float)]


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(df, con, sql: str) -> str:
    """``ok`` or what differs; ``ok~`` if floats differ in the last digits."""
    names = sorted(df.columns)
    ours = sorted(([_plain(v) for v in r] for r in df.select(*names).collect()), key=_key)
    rel = con.sql(sql)
    theirs_names = list(rel.columns)
    if sorted(theirs_names) != names:
        return f"columns {names} vs {sorted(theirs_names)}"
    order = [theirs_names.index(n) for n in names]
    types = [str(rel.types[i]) for i in order]
    mine = [KINDS.get(type(df.schema[n].dataType), "?") for n in names]
    theirs = sorted(([_plain(r[i]) for i in order] for r in rel.fetchall()), key=_key)
    bad = [f"{n}:{a}/{b}" for n, a, b in zip(names, mine, types) if a != b]
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}\n  {ours[:3]}\n  {theirs[:3]}"
    exact = True
    for a, b in zip(ours, theirs):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"values\n  {names}\n  {a}\n  {b}"
        exact = exact and a == b
    if bad:
        return f"types {bad}"
    return ("ok" if exact else "ok~") + f" {len(ours)} rows"


def main(argv: list[str]) -> int:
    from checks import ORACLES, QUERIES

    spark, con = session(), connect(argv[0])
    names = [n for n in QUERIES if not argv[1:] or any(n.startswith(p) for p in argv[1:])]
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, argv[0])
            if name in ORACLES:
                result = compare(df, con, ORACLES[name])
            else:
                result = f"rows-only {df.count()} rows"
        except Exception as e:  # noqa: BLE001 - report and go on
            result = f"error {type(e).__name__}: {str(e)[:1500]}"
        good = result.startswith(("ok", "rows-only"))
        failed += not good
        print(f"{name:34s} {time.time() - start:6.2f}s  {result}", flush=True)
        spark.catalog.clearCache()
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
