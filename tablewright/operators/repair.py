"""Reports on violated dependencies, and NULL repair by dependencies."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.frames import kept_table, lookup
from tablewright.operators.lattice import Pair, pair_groups, pair_stats, set_id

ARROW = "→"


def parse_fd(text: str) -> Pair:
    """``"a,b → c"`` to ``(("a", "b"), "c")``."""
    sides = text.split(ARROW)
    if len(sides) != 2:
        raise ValueError(f"not a dependency: {text!r}")
    lhs = tuple(p.strip() for p in sides[0].replace('"', "").split(","))
    return lhs, sides[1].strip()


def fd_text(lhs: Column, rhs: Column) -> Column:
    return F.concat(F.array_join(lhs, ","), F.lit(f" {ARROW} "), rhs)


def _known(df: DataFrame, fd: Pair) -> bool:
    return all(c in df.columns for c in (*fd[0], fd[1]))


class _Groups:
    """X groups of several dependencies with their modes, from one aggregate over the table.

    NULL counts as a value of Y, never as the mode; X values with a NULL form no group.
    """

    def __init__(self, df: DataFrame, fds: Sequence[Pair]):
        self.fds = list(fds)
        self.columns = [c for c in df.columns if c in {a for x, y in self.fds for a in (*x, y)}]
        #: Several dependencies may differ in the order of X only.
        which: dict[tuple[int, int], list[int]] = {}
        for no, (x, y) in enumerate(self.fds):
            which.setdefault((set_id(self.columns, (*x, y)), self.columns.index(y)), []).append(no)
        groups = pair_groups(df, list(dict.fromkeys(self.fds)), mode=True)
        number = F.coalesce(
            *[
                F.when((F.col("set_id") == s) & (F.col("rhs_id") == r), F.array(*[F.lit(n) for n in nos]))
                for (s, r), nos in which.items()
            ]
        )
        #: ``(fd_no, c0, c1, ..., n_values, n_present, present_rows, mode)``.
        self.rows = groups.withColumn("fd_no", F.explode(number))

    def x(self, no: int) -> list[Column]:
        """The X values of a dependency, in its own order."""
        return [F.col(f"c{self.columns.index(c)}") for c in self.fds[no][0]]

    def mode(self, no: int) -> Column:
        return F.col("mode")[f"y{self.columns.index(self.fds[no][1])}"]

    def by_fd(self, value: Callable[[int], Column]) -> Column:
        """A value that each dependency makes in a way of its own."""
        return F.coalesce(*[F.when(F.col("fd_no") == no, value(no)) for no in range(len(self.fds))])

    def name(self) -> Column:
        return self.by_fd(lambda no: F.lit(f"{','.join(self.fds[no][0])} {ARROW} {self.fds[no][1]}"))

    def excluded(self, exclusions: Mapping[str, Sequence]) -> Column:
        """Whether an X value is one of those to pass over."""

        def hit(no: int) -> Column:
            tests = [x.isin(list(exclusions[c])) for c, x in zip(self.fds[no][0], self.x(no)) if c in exclusions]
            return reduce(lambda a, b: a | b, tests, F.lit(False))

        return self.by_fd(hit)


def _suggesting(groups: _Groups) -> DataFrame:
    """Groups with a mode that more than one row, or a missing value, speaks for."""
    return groups.rows.where("mode is not null and (n_present > 1 or n_values > n_present)")


def accepted_fds(afds: DataFrame, min_conf: float = 95.0) -> list[tuple[Pair, float]]:
    """Dependencies at or above a confidence, on the driver (one row per dependency)."""
    rows = afds.where(F.col("confidence") >= min_conf).orderBy("g3", "rhs", "lhs").collect()
    return [((tuple(r["lhs"]), r["rhs"]), r["confidence"]) for r in rows]


def validate_fds(
    df: DataFrame,
    fds: Sequence[tuple[Pair, float]],
    selected: Sequence[str] = (),
) -> DataFrame:
    """One row per dependency: violating X values, surplus Y values, selection, error."""
    chosen = {parse_fd(s) for s in selected}
    usable = [fd for fd, _ in fds if _known(df, fd)]
    listed = df.sparkSession.createDataFrame(
        [
            (list(fd[0]), fd[1], float(conf), fd in chosen,
             None if _known(df, fd) else "Missing attributes in dataset")
            for fd, conf in fds
        ],
        "lhs array<string>, rhs string, confidence double, selected boolean, error string",
    )
    if usable:
        # Attribute order in a dependency is free: match on the sorted left side.
        pairs = dict.fromkeys((tuple(sorted(x)), y) for x, y in usable)
        stats = pair_stats(df, list(pairs)).select(
            F.array_sort("lhs").alias("__l"), "rhs", "bad_groups", "surplus_values"
        )
        listed = listed.withColumn("__l", F.array_sort("lhs")).join(stats, ["__l", "rhs"], "left")
    else:
        none = F.lit(None).cast("long")
        listed = listed.withColumns({"bad_groups": none, "surplus_values": none})
    return listed.select(
        fd_text(F.col("lhs"), F.col("rhs")).alias("fd"),
        "confidence",
        F.col("selected").alias("selected_for_repair"),
        F.col("bad_groups").alias("violation_count"),
        F.col("surplus_values").alias("total_violations"),
        "error",
    )


def fd_violations(
    df: DataFrame,
    fds: Sequence[Pair],
    selected: Sequence[str] = (),
    detail: int | None = None,
) -> DataFrame:
    """One row per violating X value: its mode, for ``detail`` X values (or all).

    ``x_value`` holds the X values as strings in the order of the dependency.
    """
    chosen = {parse_fd(s) for s in selected}
    known = [fd for fd in fds if _known(df, fd)]
    if not known:
        return None
    groups = _Groups(df, known)
    bad = groups.rows.where("n_values > 1")
    if detail is not None:
        # By the typed X values, in the order of each dependency; row_number <= detail is pushed down.
        at = range(max(len(x) for x, _ in known))
        keys = [
            F.when(F.col("fd_no") == no, groups.x(no)[i])
            for i in at
            for no in range(len(known))
            if i < len(known[no][0])
        ]
        place = F.row_number().over(Window.partitionBy("fd_no").orderBy(*keys))
        bad = bad.withColumn("__place", place).where(F.col("__place") <= detail)
    return bad.select(
        groups.name().alias("fd"),
        groups.by_fd(lambda no: F.array(*[x.cast("string") for x in groups.x(no)])).alias("x_value"),
        "n_values",
        F.col("present_rows").alias("n_rows"),
        groups.by_fd(lambda no: groups.mode(no).cast("string")).alias("most_common_y"),
        groups.by_fd(lambda no: F.lit(known[no] in chosen)).alias("will_fix"),
    )


def violation_values(df: DataFrame, violations: DataFrame, fd: Pair) -> DataFrame:
    """``(fd, x_value, y_value, n)``: the Y values behind the listed violations of ``fd``."""
    x, y = fd
    name = f"{','.join(x)} {ARROW} {y}"
    listed = violations.where(F.col("fd") == name).select("fd", "x_value")
    key = F.array(*[F.col(f"`{c}`").cast("string") for c in x]).alias("x_value")
    pairs = df.groupBy(key, F.col(f"`{y}`").cast("string").alias("y_value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return pairs.join(listed, "x_value").select("fd", "x_value", "y_value", "n")


def repair_by_fd(
    df: DataFrame,
    fds: Sequence[str],
    key_exclusions: Mapping[str, Sequence] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fill NULL Y from the most common Y of its X group, dependency by dependency.

    The suggestions come from the table as given; X is matched on the values repaired so
    far.  Returns the table and one row of counts per dependency.
    """
    exclusions = dict(key_exclusions or {})
    usable = [fd for fd in map(parse_fd, fds) if _known(df, fd)]

    if not usable:
        return _apply(df, [])
    groups = _Groups(df, usable)
    # Counted once, then read per dependency.
    rows = kept_table(_suggesting(groups).where(~groups.excluded(exclusions)))

    def suggested(no: int) -> DataFrame:
        keys = [x.alias(f"k{i}") for i, x in enumerate(groups.x(no))]
        return rows.where(F.col("fd_no") == no).select(*keys, groups.mode(no).alias("mode"))

    return _apply(df, [(fd, suggested(no)) for no, fd in enumerate(usable)])


def repair_from_report(df: DataFrame, violations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same repair from the stored rows of ``fd_violations`` marked ``will_fix``."""
    fix = violations.where("will_fix and most_common_y is not null")
    # One name per selected dependency.
    names = [r["fd"] for r in fix.select("fd").distinct().orderBy("fd").collect()]
    maps = []
    for fd in map(parse_fd, names):
        x, y = fd
        rows = fix.where(F.col("fd") == f"{','.join(x)} {ARROW} {y}")
        maps.append(
            (
                fd,
                rows.select(
                    *[
                        F.col("x_value")[i].cast(df.schema[c].dataType).alias(f"k{i}")
                        for i, c in enumerate(x)
                    ],
                    F.col("most_common_y").cast(df.schema[y].dataType).alias("mode"),
                ),
            )
        )
    return _apply(df, maps)


def _apply(
    df: DataFrame, maps: Sequence[tuple[Pair, DataFrame]]
) -> tuple[DataFrame, DataFrame]:
    """Join the suggestions in order; only rows with a NULL target take part."""
    spark = df.sparkSession
    stats_schema = "fd string, repairs_applied long, rows_affected long"
    if not maps:
        return df, spark.createDataFrame([], stats_schema)
    targets = list(dict.fromkeys(y for (_, y), _ in maps))
    lacking = reduce(lambda a, b: a | b, [F.col(f"`{y}`").isNull() for y in targets])
    work = df.where(lacking)
    for i, ((x, y), suggested) in enumerate(maps):
        keys = [f"__k{j}" for j in range(len(x))]
        table = suggested.select(
            *[F.col(f"k{j}").alias(k) for j, k in enumerate(keys)], F.col("mode").alias("__v")
        )
        # A filled row carries NULL keys: it cannot match and is spread evenly.
        need = work.withColumns(
            {k: F.when(F.col(f"`{y}`").isNull(), F.col(f"`{c}`")) for c, k in zip(x, keys)}
        )
        joined = lookup(need, table, keys, check_size=False)
        hit = F.col(f"`{y}`").isNull() & F.col("__v").isNotNull()
        text = F.array(*[F.col(k).cast("string") for k in keys])
        work = joined.withColumns(
            {f"__fix{i}": F.when(hit, text), y: F.coalesce(F.col(f"`{y}`"), F.col("__v"))}
        ).drop("__v", *keys)
    fixed = work.select(*df.columns)
    repaired = df.where(~lacking).unionByName(fixed)
    marks = F.array(
        *[
            F.when(F.col(f"__fix{i}").isNotNull(),
                   F.struct(F.lit(i).alias("i"), F.col(f"__fix{i}").alias("x")))
            for i in range(len(maps))
        ]
    )
    per_x = (
        work.select(F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m"))
        .groupBy("m.i", "m.x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    done = per_x.groupBy("i").agg(
        F.count(F.lit(1)).alias("repairs_applied"), F.sum("n").alias("rows_affected")
    )
    names = spark.createDataFrame(
        [(i, f"{','.join(x)} {ARROW} {y}") for i, ((x, y), _) in enumerate(maps)],
        "i int, fd string",
    )
    zero = F.lit(0).cast("long")
    stats = names.join(done, "i", "left").select(
        "fd",
        F.coalesce("repairs_applied", zero).alias("repairs_applied"),
        F.coalesce("rows_affected", zero).alias("rows_affected"),
    )
    return repaired, stats


def repair_potential(
    df: DataFrame, fds: Sequence[str], key_exclusions: Mapping[str, Sequence] | None = None
) -> DataFrame:
    """``(fd, potential, skipped)``: X groups with a suggestion, and excluded ones."""
    known = [fd for fd in map(parse_fd, fds) if _known(df, fd)]
    if not known:
        return None
    groups = _Groups(df, known)
    skip = groups.excluded(dict(key_exclusions or {}))
    counts = _suggesting(groups).groupBy("fd_no").agg(
        F.count(F.lit(1)).alias("potential"), F.count_if(skip).alias("skipped")
    )
    names = [(no, f"{','.join(x)} {ARROW} {y}") for no, (x, y) in enumerate(known)]
    listed = df.sparkSession.createDataFrame(names, "fd_no int, fd string").join(counts, "fd_no", "left")
    zero = F.lit(0).cast("long")
    return listed.select("fd", F.coalesce("potential", zero).alias("potential"), F.coalesce("skipped", zero).alias("skipped"))
