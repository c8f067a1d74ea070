import random
from itertools import chain, combinations

import pytest
from pyspark.sql import functions as F

from tablewright.operators import dependencies as dep
from tablewright.operators import inclusion as inc
from tablewright.operators import lattice, repair, rules


def named(df):
    return {(tuple(r.lhs), r.rhs) for r in df.collect()}


def test_small_fds(spark):
    df = spark.createDataFrame([(1, "x", "p"), (2, "x", "p"), (3, "y", "q")], "k int, a string, b string")
    assert named(dep.discover_fds(df)) == {(("k",), "a"), (("k",), "b"), (("a",), "b"), (("b",), "a")}
    assert [r.attributes for r in dep.discover_keys(df).collect()] == [["k"]]


def brute_fds(rows, cols):
    def holds(x, y):
        seen = {}
        return all(seen.setdefault(tuple(r[c] for c in x), r[y]) == r[y] for r in rows)

    out = set()
    for y in range(len(cols)):
        rest = [c for c in range(len(cols)) if c != y]
        for x in chain.from_iterable(combinations(rest, n) for n in range(1, len(rest) + 1)):
            if holds(x, y) and not any(set(z) <= set(x) and w == y for z, w in out):
                out.add((x, y))
    return {(tuple(cols[c] for c in x), cols[y]) for x, y in out}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fds_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    cols = ["a", "b", "c", "d", "e"]
    rows = []
    for _ in range(40):
        a, b = rng.randrange(4), rng.randrange(6)
        rows.append((a, b, (a + b) % 3, a // 2, rng.randrange(9) if seed > 1 else None))
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in cols))
    found = named(dep.discover_fds(df, cols))
    assert found == brute_fds(rows, cols)
    # Every exact dependency has score 0.
    some = sorted(found)[:5]
    stats = lattice.pair_stats(df, some).collect()
    assert all(r.bad_rows == 0 and r.minority_rows == 0 for r in stats)


def test_scores(spark):
    df = spark.createDataFrame([("g", "p"), ("g", "p"), ("g", "q")], "x string, y string")
    assert dep.g3_score(df, ["x"], "y").first().g3 == pytest.approx(2 / 3)
    assert dep.g3_canonical(df, ["x"], "y").first().g3 == pytest.approx(1 / 3)
    assert dep.g3_score(df.limit(0), ["x"], "y").first().g3 == 1.0


def test_null_flags(spark):
    df = spark.createDataFrame([(1, "p"), (1, None), (2, None), (None, "z"), (None, "w")], "x int, y string")
    assert (("x",), "y") in named(dep.fds_of_size(df, 1))  # NULLs ignored
    assert dep.g3_score(df, ["x"], "y").first().g3 == pytest.approx(1 / 5)  # NULL is a value


def test_one_group_per_left_side(spark):
    """The spread of all right sides equals the sums over pairs, keys and NULLs included, without groups of keys."""
    rng = random.Random(4)
    rows = [(i, rng.randrange(5), rng.choice("pqr"), rng.choice([None, "u", "v"]), None, i // 2 if i else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, a int, b string, c string, d string, e int")
    assert lattice.single_keys(df, df.columns) == {"k"}
    for size in (1, 2, 3):
        pairs = dep._pairs(df.columns, size)
        plain = {(tuple(r.lhs), r.rhs): r for r in lattice.pair_stats(df, pairs).collect()}
        strict = {(tuple(r.lhs), r.rhs): r for r in lattice.spread_stats(df, pairs, nulls=True).collect()}
        loose = {(tuple(r.lhs), r.rhs): r for r in lattice.spread_stats(df, pairs, nulls=False).collect()}
        assert set(plain) == set(strict) == set(loose)
        for p, r in plain.items():
            assert strict[p].bad_rows == r.bad_rows and loose[p].max_present == min(r.max_present, 2), p


def test_redundancy(spark):
    df = spark.createDataFrame([(["a"], "y", 0.05), (["a", "b"], "y", 0.048), (["b", "c"], "y", 0.01)],
                               "lhs array<string>, rhs string, g3 double")
    kept = {tuple(r.lhs) for r in dep.filter_redundant(df).collect()}
    assert kept == {("a",), ("b", "c")}


def test_report_and_repair(spark):
    rows = [("g", "p"), ("g", "p"), ("g", "q"), ("g", None), (None, None), ("0", "z"), ("0", None), ("h", None), ("i", "r")]
    df = spark.createDataFrame(rows, "x string, y string")
    report = repair.validate_fds(df, [((("x",), "y"), 99.0), ((("w",), "y"), 99.0)], ["x → y"])
    got = {r.fd: (r.violation_count, r.total_violations, r.error) for r in report.collect()}
    assert got["x → y"] == (2, 2, None) and got["w → y"][2] == "Missing attributes in dataset"
    fixed, stats = repair.repair_by_fd(df, ["x → y"], {"x": ["0"]})
    assert sorted(map(str, map(tuple, fixed.collect()))) == sorted(
        map(str, [("g", "p"), ("g", "p"), ("g", "q"), ("g", "p"), (None, None), ("0", "z"), ("0", None), ("h", None), ("i", "r")])
    )
    assert tuple(stats.first()) == ("x → y", 1, 1)
    violations = repair.fd_violations(df, [(("x",), "y")], ["x → y"])
    again, _ = repair.repair_from_report(df, violations)
    assert again.where("x = '0' and y = 'z'").count() == 2


def test_repair_in_order(spark):
    """The second dependency fills what the first left, matching on repaired values."""
    rows = [(1, "a", "m"), (1, None, None), (4, "a", None), (2, None, None), (3, "b", "n"), (3, "b", None)]
    df = spark.createDataFrame(rows, "k int, x string, y string")
    fixed, stats = repair.repair_by_fd(df, ["k → x", "x → y"])
    got = sorted((r.k, str(r.x), str(r.y)) for r in fixed.collect())
    assert got == [(1, "a", "m"), (1, "a", "m"), (2, "None", "None"), (3, "b", "n"), (3, "b", "n"), (4, "a", "m")]
    assert {r.fd: r.rows_affected for r in stats.collect()} == {"k → x": 1, "x → y": 3}


def test_repair_changes_null_cells_only(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(5), rng.choice(["p", "q", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, x int, y string")
    fixed, _ = repair.repair_by_fd(df, ["x → y"])
    after = {r.i: r.y for r in fixed.collect()}
    assert len(after) == 200 and all(after[i] == y for i, _, y in rows if y is not None)
    assert None not in after.values()


def test_hot_group_repair(spark):
    """A third of all rows share one key, a third have none: same result, no lost rows."""
    df = spark.range(3000).selectExpr(
        "id", "case when id % 3 = 0 then 7 when id % 3 = 1 then null else id end as x",
        "case when id % 2 = 0 then null else id % 6 end as y",
    )
    fixed, stats = repair.repair_by_fd(df, ["x → y"])
    assert fixed.count() == 3000
    assert fixed.where("x = 7 and y is null").count() == 0
    assert stats.first().rows_affected == 500


def test_inds(spark):
    df = spark.createDataFrame([(1, 1, "1"), (2, 2, " X"), (None, 3, "x ")], "a int, b int, c string")
    got = {(r.lhs, r.rhs): (r.confidence, r.is_exact) for r in inc.discover_inds(df).collect()}
    assert got == {("a", "b"): (1.0, True)}
    loose = {(r.lhs, r.rhs): r.confidence for r in inc.discover_inds(df, min_conf=0.4, normalize=True).collect()}
    assert loose == {("a", "b"): 1.0, ("b", "a"): pytest.approx(2 / 3), ("a", "c"): 0.5, ("c", "a"): 0.5, ("c", "b"): 0.5}


def test_many_columns_need_several_masks(spark):
    df = spark.range(4).select(*[(F.col("id") % (i % 4 + 1)).alias(f"c{i}") for i in range(70)])
    got = {(r.lhs, r.rhs) for r in inc.discover_inds(df, min_conf=1.0).collect()}
    size = {f"c{i}": i % 4 + 1 for i in range(70)}
    assert got == {(a, b) for a in size for b in size if a != b and size[a] <= size[b]}


def test_substring_inds_equal_brute_force(spark):
    rng = random.Random(11)
    pool = ["60601", "il 60601", "abc", "xabcx", "a", "", "zip 60601 x", "long text here", "text", "no"]
    rows = [tuple(rng.choice([*pool, None]) for _ in range(3)) for _ in range(30)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    got = {(r.lhs, r.rhs): r.n_common for r in inc.discover_substring_inds(df, min_conf=0.0).collect()}
    values = [{r[i] for r in rows} - {None} for i in range(3)]
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            if i != j:
                hits = sum(any(v in t for t in values[j]) for v in values[i])
                assert got.get((a, b), 0) == hits


def test_ind_summaries(spark):
    inds = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0)], "lhs string, rhs string, confidence double")
    assert {(r.a, r.b, r.d) for r in inc.ind_chains(inds).collect()} == {("a", "b", "c")}
    assert [(r.a, r.b) for r in inc.ind_equivalences(inds).collect()] == [("a", "b")]
    assert {(r.column, r.role): r.n for r in inc.ind_roles(inds).collect()}[("b", "subset")] == 2


BASKETS = ["abc", "ab", "ac", "bc", "abc"]


def test_itemsets_and_rules(spark):
    df = spark.createDataFrame([(list(b),) for b in BASKETS], "items array<string>")
    sets = rules.frequent_itemsets(df, 0.4)
    assert {"".join(r["items"]): r.freq for r in sets.collect()} == {
        "a": 4, "b": 4, "c": 4, "ab": 3, "ac": 3, "bc": 3, "abc": 2,
    }
    found = {("".join(r.antecedents), "".join(r.consequents)): r for r in rules.association_rules(sets, "lift", 0.0).collect()}
    assert len(found) == 3 * 2 + 6
    r = found[("a", "bc")]
    assert (r.support, r.confidence, r.lift) == (0.4, 0.5, pytest.approx(0.5 / 0.6))
    assert all(found[(c, a)].lift == pytest.approx(r.lift) for (a, c), r in found.items())


def test_support_bound_is_inclusive(spark):
    """3 of 30 rows is a support of 0.1, although 0.1 * 30 rounds above 3."""
    df = spark.createDataFrame([(["x"],)] * 3 + [([],)] * 27, "items array<string>")
    assert rules.frequent_itemsets(df, 0.1).count() == 1


def test_edges(spark):
    df = spark.createDataFrame([(["a"], ["b"], 2.0), (["a", "c"], ["b"], 1.5)], "antecedents array<string>, consequents array<string>, lift double")
    assert {(r.source, r.target): r.weight for r in rules.rule_edges(df).collect()} == {("a", "b"): 3.5, ("c", "b"): 1.5}


def test_tables_with_the_names_used_inside(spark):
    """Columns called like the engine's own must not clash."""
    rows = [(i, i // 2, i % 3, "v") for i in range(12)]
    names = ["n", "set_id", "size", "mode"]
    df = spark.createDataFrame(rows, "n int, set_id int, size int, mode string")
    assert (("n",), "set_id") in named(dep.discover_fds(df, names))
    assert dep.discover_afds(df, names, 2, 0.5).count() > 0
    fixed, _ = repair.repair_by_fd(df, ["set_id → mode", "mode,size → n"])
    assert fixed.count() == 12
    assert inc.discover_inds(df, names, 0.1).count() > 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b int")
    assert named(dep.discover_fds(df)) == {(("a",), "b"), (("b",), "a")}
    assert inc.discover_inds(df).count() == 0
    assert rules.frequent_itemsets(df.selectExpr("array('x') as items"), 0.5).count() == 0


def plain_fds(rows, cols):
    from itertools import combinations

    def holds(x, a):
        seen = {}
        return all(seen.setdefault(tuple(r[c] for c in x), r[a]) == r[a] for r in rows)

    found = []
    for size in range(1, len(cols)):
        for x in combinations(cols, size):
            for a in cols:
                if a not in x and holds(x, a) and not any(set(y) < set(x) and b == a for y, b in found):
                    found.append((x, a))
    return sorted(found)


def test_unbounded_fds_and_keys_against_brute_force(spark):
    import random
    from itertools import combinations

    from tablewright.operators import dependencies as dep

    rnd, cols = random.Random(4), list("abcde")
    for trial in range(6):
        rows = [{c: rnd.randint(0, 1 + (i + trial) % 3) for i, c in enumerate(cols)} for _ in range(12)]
        if trial % 2:
            for r in rows:
                r["e"], r["d"] = r["a"] * 10 + r["b"], 7
        df = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], cols)
        got = sorted((tuple(r["lhs"]), r["rhs"]) for r in dep.discover_fds(df).collect())
        assert got == plain_fds(rows, cols)
        keys = []
        for size in range(1, 6):
            for s in combinations(cols, size):
                if len({tuple(r[c] for c in s) for r in rows}) == len(rows) and not any(set(k) < set(s) for k in keys):
                    keys.append(s)
        assert sorted(tuple(r["attributes"]) for r in dep.discover_keys(df).collect()) == sorted(keys)


def test_permuted_left_sides_give_one_report_row_each(spark):
    from tablewright.operators import repair

    df = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 1, 1)], "x int, w int, y int")
    report = repair.validate_fds(df, [((("x", "w"), "y"), 90.0), ((("w", "x"), "y"), 90.0)]).collect()
    assert len(report) == 2 and {r["violation_count"] for r in report} == {1}


def test_columns_that_start_alike_are_families_of_their_own(spark):
    from tablewright.operators import rules

    rows = [("high", "a"), ("high", "a"), ("low", "b"), ("low", "b")]
    df = spark.createDataFrame(rows, "risk string, risk_type string")
    baskets = rules.build_baskets(df, ["risk", "risk_type"], sep=rules.SEP)
    found = rules.rules_between(baskets, f"risk{rules.SEP}", f"risk_type{rules.SEP}", 0.1, "confidence", 0.1).collect()
    assert {(r["antecedents"][0], r["consequents"][0]) for r in found} == {(f"risk{rules.SEP}high", f"risk_type{rules.SEP}a"), (f"risk{rules.SEP}low", f"risk_type{rules.SEP}b")}


def test_decimal_and_integer_are_one_value(spark):
    from tablewright.operators import inclusion

    df = spark.sql("select cast(1.00 as decimal(9,2)) as d, 1 as i union all select cast(10.50 as decimal(9,2)), 1")
    found = {(r["lhs"], r["rhs"]) for r in inclusion.discover_inds(df, min_conf=1.0).collect()}
    assert found == {("i", "d")}


def test_rules_of_a_large_itemset_are_not_all_split(spark):
    """Twenty items: only the splits that confidence lets grow are ever made."""
    items = [f"i{k:02d}" for k in range(20)]
    rows = [(items, 10, 1000, 0.01)]
    for k in range(20):  # without the first or the second the rest is nearly as rare
        rest = items[:k] + items[k + 1 :]
        rows += [(rest, 11 if k < 2 else 500, 1000, 0.011), ([items[k]], 600, 1000, 0.6)]
    rows += [(items[2:], 11, 1000, 0.011), (items[:2], 300, 1000, 0.3)]
    sets = spark.createDataFrame(rows, "items array<string>, freq long, n long, support double")
    found = rules.association_rules(sets, "confidence", 0.9).where(F.size("antecedents") + F.size("consequents") == 20).collect()
    got = {tuple(r.consequents): round(r.confidence, 6) for r in found}
    assert got == {("i00",): round(10 / 11, 6), ("i01",): round(10 / 11, 6), ("i00", "i01"): round(10 / 11, 6)}


def test_counted_baskets_give_the_itemsets_of_their_rows(spark):
    """Random rows, repeated: every itemset by brute force, as weighted and as plain baskets."""
    import random
    from itertools import combinations

    rnd = random.Random(7)
    rows = [tuple(rnd.choice([None, "x", "y", "z"]) for _ in range(3)) + (rnd.choice([None, "1. AB | 2. CD", "2. CD", "no"]),) for _ in range(40)]
    df = spark.createDataFrame(rows * 5, "a string, b string, c string, notes string")
    counted = rules.count_baskets(df, ["a", "b", "c"], "notes", max_categories=2)
    plain = rules.build_baskets(df, ["a", "b", "c"], "notes", max_categories=2)
    whole = [frozenset(r["items"]) for r in plain.collect()]
    assert counted.agg(F.sum("rows")).first()[0] == len(whole) == 200
    assert counted.count() == len({(*r[:3], r[3] or "no") for r in rows})  # neither holds a code
    want = {}
    for basket in whole:
        for size in range(1, len(basket) + 1):
            for s in combinations(sorted(basket), size):
                want[s] = want.get(s, 0) + 1
    want = {s: n for s, n in want.items() if n / 200 >= 0.1}
    for sets in (rules.frequent_itemsets(counted, 0.1, weight="rows"), rules.frequent_itemsets(plain, 0.1)):
        assert {tuple(r["items"]): r["freq"] for r in sets.collect()} == want
        assert {r["n"] for r in sets.collect()} == {200}


def test_rules_of_categories_read_no_text(spark):
    rows = [("u", "p"), ("u", "p"), ("v", "q"), ("v", "q")]
    df = spark.createDataFrame(rows, "a string, b string")
    df = df.withColumn("notes", F.when(F.col("a") != "", F.raise_error(F.lit("read")).cast("string")))
    found = rules.mine_rules(df, ["a", "b"], "notes", "categories")["categories"].collect()
    assert {(r["antecedents"][0], r["consequents"][0]) for r in found} == {("a_u", "b_p"), ("b_p", "a_u"), ("a_v", "b_q"), ("b_q", "a_v")}


def test_analyses_share_their_rounds(spark):
    """Five categories to codes take the jobs of one, and every analysis what it takes alone."""
    import uuid

    rows = [("u", "p", "1. AB | 2. CD"), ("u", "q", "2. CD"), ("v", "p", None), ("v", "q", "1. AB")] * 5
    columns = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, "a string, b string, notes string")
    df = df.select("a", "b", "notes", *[F.col("a").alias(c) for c in columns[2:]])

    def jobs(columns, analysis=None):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, group)
        try:
            found = rules.mine_rules(df, columns, "notes", analysis)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    one, few = jobs(columns[:1], "category_violations")
    five, many = jobs(columns, "category_violations")
    assert 0 < many < 1.5 * few
    alone = {**five, **jobs(columns, "violations")[0], **jobs(columns, "categories")[0]}
    every = jobs(columns)[0]
    assert sorted(every) == sorted(alone) and all(every[n].collect() for n in ("categories", "a_to_violations"))
    for name, found in alone.items():
        assert sorted(map(str, every[name].collect())) == sorted(map(str, found.collect()))
    assert sorted(map(str, one["a_to_violations"].collect())) == sorted(map(str, every["a_to_violations"].collect()))
