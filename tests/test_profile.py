import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions import stats
from tablewright.operators import clean, profile


def test_moments_and_mode(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "a"), (10, None)], "n int, s string")
    got = {r.column: r for r in profile.describe_columns(df).collect()}
    n = got["n"]
    assert n.skewness == pytest.approx(1.6970563) and n.kurtosis == pytest.approx(3.152)
    assert (n.q25, n.median, n.std_dev) == (2.0, 3.0, pytest.approx(3.5355339))
    assert (got["s"].top_value, got["s"].top_freq, got["s"].top_pct) == ("a", 2, 40.0)


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(None, None, None)], "n double, s string, b boolean")
    got = {r.column: r for r in profile.describe_columns(df).collect()}
    assert got["n"].median is None and got["s"].unique_count == 0 and got["b"].true_pct is None
    assert profile.describe_columns(df.limit(0)).count() == 3


@pytest.mark.parametrize("limit,sketch,room", [(5_000_000, 8192, 2), (30, 8, 60), (500, 8, 0)])
@pytest.mark.parametrize("shape", ["spread", "hot", "few"])
def test_quantiles_by_brackets(spark, monkeypatch, limit, sketch, room, shape):
    """As they are, with brackets that are sketched again, and with sketches that miss their ranks."""
    for name, value in (("BRACKET_ROWS", limit), ("SKETCH", sketch), ("ROOM", room)):
        monkeypatch.setattr(stats, name, value)
    rng = random.Random(limit)
    values = {
        "spread": [rng.gauss(0, 100) for _ in range(2000)],
        "hot": [5.0 if rng.random() < 0.4 else rng.random() * 10 for _ in range(2000)],
        "few": [float(rng.randrange(3)) for _ in range(2000)],
    }[shape]
    df = spark.createDataFrame([(v, -v if i % 5 else None) for i, v in enumerate(values)], "a double, b double")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = stats.exact_quantiles(df, ["a", "b"], qs)
    assert got["a"] == pytest.approx(np.quantile(values, qs).tolist())
    assert got["b"] == pytest.approx(np.quantile([-v for i, v in enumerate(values) if i % 5], qs).tolist())


def test_duplicates(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "c string")
    assert tuple(profile.duplicates(df).first()) == (2, 1, 3)
    assert tuple(profile.duplicates(df.limit(0)).first()) == (0, 0, 0)


def test_nullity_correlation(spark):
    rows = [(1, None, 1, None), (None, 1, 1, None), (None, 1, 1, None), (1, None, 1, None)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    got = {(r.col_a, r.col_b): r.correlation for r in profile.nullity_correlation(df).collect()}
    assert got == {("a", "b"): -1.0}


def test_outcome_ranks(spark):
    df = spark.createDataFrame([("pass w/ conditions",), ("fail",), ("FAIL",), ("no entry",), (None,)], "r string")
    out = profile.ranked_distribution(clean.title_case(df, "r"), "r").collect()
    assert [(r["rank"], r.r, r.n, r.pct) for r in out] == [
        (0, "Pass W/ Conditions", 1, 25.0), (1, "Fail", 2, 50.0), (3, "No Entry", 1, 25.0),
    ]


def test_conflicts_null_flag(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "b"), (2, "c"), (None, "x"), (None, "y")], "k int, v string")
    assert {r.k for r in profile.mapping_conflicts(df, "k", "v").collect()} == {2}
    assert {r.k for r in profile.mapping_conflicts(df, "k", "v", nulls="value").collect()} == {1, 2}
    assert profile.conflict_rows(df, "k", "v").count() == 2


def test_whole_days(spark):
    df = spark.sql("select timestamp '2020-01-01 12:00:00' as a, timestamp '2020-01-03 11:00:00' as b")
    assert df.select(profile.whole_days(F.col("a"), F.col("b"))).first()[0] == 1


def test_timeliness_steps(spark):
    df = spark.sql("select 1 as id, 'g' as grp, 'Pass' as res, timestamp '2020-01-01 00:00:00' as d")
    for as_of, score in (("2020-01-20", 1.0), ("2020-03-01", 0.9), ("2020-06-01", 0.8), ("2020-12-01", 0.6), ("2022-01-01", 0.4)):
        got = profile.quality_score(df, ["id"], "grp", "res", ["Pass"], "d", as_of).first()
        assert got.timeliness == score and got.completeness == 1.0 and got.consistency == 1.0


def test_plans_prune_columns_and_push_filters(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = profile.top_k(li, ["l_partkey"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint>" in plan
    assert "PushedFilters: [IsNotNull(l_partkey)]" in plan
