"""The composed jobs: clean, profile, normalise and load, mine dependencies, repair by them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.frames import scratch_path
from tablewright.operators import clean, dependencies, fuzzy, inclusion, multivalue, profile, repair
from tablewright.operators import rules as mining
from tablewright.operators.rows import drop_nulls, fill_sentinel, project, sample_n
from tablewright.sources.files import write_csv
from tablewright.sources.tables import save_table

_TEXT = (
    "dba_name", "aka_name", "license_num", "facility_type", "risk", "address", "city", "state",
    "zip", "inspection_type", "results", "violations", "location",
)

INSPECTIONS = T.StructType(
    [
        T.StructField("inspection_id", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in _TEXT],
        T.StructField("inspection_date", T.TimestampType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

# Canonical names and dependencies of the inspections table.
RISKS = {"Risk 1 (High)": "High", "Risk 2 (Medium)": "Medium", "Risk 3 (Low)": "Low"}
CITIES = (
    "CHICAGO", "OLYMPIA FIELDS", "MERRILLVILLE", "EVERGREEN", "BEDFORD PARK", "WADSWORTH",
    "BANNOCKBURN DEERFIELD",
)
REPAIRS = (
    "dba_name → facility_type",
    "address → zip",
    "location → zip",
    "address → city",
    "address,inspection_date → facility_type",
    "aka_name,inspection_date → location",
)
ENTITY = (
    "license_num", "dba_name", "aka_name", "facility_type", "risk", "address", "city", "state",
    "zip", "latitude", "longitude", "location",
)
EVENT = ("inspection_id", "license_num", "inspection_date", "inspection_type", "results", "violations")
CATEGORIES = ("facility_type", "risk", "results", "inspection_type")
IND_COLUMNS = (
    "inspection_id", "dba_name", "aka_name", "license_num", "facility_type", "risk", "city",
    "state", "zip", "inspection_type", "results", "location",
)


@dataclass
class CleanOptions:
    """What the cleaning job may be told; the defaults fit the inspections table."""

    schema: T.StructType = field(default_factory=lambda: INSPECTIONS)
    date_formats: Sequence[str] = ("MM/dd/yyyy",)
    risks: Mapping[str, str] = field(default_factory=lambda: RISKS)
    dominant_city: tuple[str, str] = ("CHICAGO", "CH")
    cities: Sequence[str] = CITIES
    repairs: Sequence[str] = REPAIRS
    key_exclusions: Mapping[str, Sequence] = field(default_factory=lambda: {"license_num": ["0"]})
    cluster_cities: bool = True


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    What follows reads columns from files instead of repeating the joins before, also
    after an executor is lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def clean_inspections(
    raw: DataFrame,
    zips: DataFrame,
    geocodes: DataFrame | None = None,
    options: CleanOptions | None = None,
    csv_path: str | None = None,
) -> DataFrame:
    """Raw text table to cleaned table.

    ``zips`` is ``(zip, state, city)``; ``geocodes`` holds answers to
    ``clean.geocode_requests``.  Row-local steps form one scan, written before the joins; the
    repair and each distinct-value step add a shuffle of few columns or a broadcast.
    """
    o = options or CleanOptions()
    df = clean.normalize_columns(raw)
    df = clean.enforce_schema(df, o.schema, o.date_formats)
    df = clean.clean_identifier(df, "license_num")
    df = clean.clean_zip(df).drop("zip", "zip_valid").withColumnRenamed("zip_clean", "zip")
    # Written before the joins: with them one step would be too large to be compiled.
    df = stage(df, "typed")
    for column in ("state", "city"):
        df = clean.fill_by_lookup(df, column, "zip", zips, "zip", column)
    if geocodes is not None:
        df = clean.merge_geocodes(df, geocodes)
    df = clean.map_exact(df, "risk", o.risks)
    df = clean.standardize_text(df, ["dba_name", "aka_name"])
    df = clean.fill_from(df, "aka_name", "dba_name")
    df = df.withColumn("city", F.upper("city"))
    df = fuzzy.snap_to(df, "city", [o.dominant_city[0]])
    # The repair reads its input once per rule: written first, no lookup or score is repeated.
    df, _ = repair.repair_by_fd(stage(df, "filled"), o.repairs, o.key_exclusions)
    df = stage(df, "repaired")
    # Dictionary of the facility texts: known typos and the detected ones.
    typos = fuzzy.detect_typos(df, "facility_type", known=clean.KNOWN_TYPOS)
    df = clean.clean_category_text(df, "facility_type", typo_map=typos)
    df = clean.consolidate(df, "facility_type")
    df = clean_cities(df, o)
    if csv_path:
        write_csv(df, csv_path)
    return df


def clean_cities(df: DataFrame, o: CleanOptions) -> DataFrame:
    """Letters only, best canonical match, then the corrections found by clustering."""
    df = clean.normalize_name(df, "city")
    df = df.withColumn("city", F.nullif("city", F.lit("")))
    matched = fuzzy.best_match(df, "city", o.cities, dominant=o.dominant_city)
    if not o.cluster_cities:
        return matched
    found = fuzzy.cluster_corrections(df, "city", o.cities, dominant=o.dominant_city)
    return fuzzy.apply_corrections(matched, "city", found)


def profile_inspections(df: DataFrame, as_of: str | None = None) -> dict[str, DataFrame]:
    """All reports on a cleaned table, by name; each is an action of its own."""
    kinds = clean.categorize(df, "inspection_type", "standardized_type")
    results = clean.title_case(df, "results")
    compared = fuzzy.compare_columns(df, "dba_name", "aka_name")
    reports = {f"describe_{k}": v for k, v in profile.describe_by_type(df).items()}
    reports |= {
        "names": fuzzy.comparison_summary(compared, "dba_name", "aka_name"),
        "risk": profile.value_counts(df, ["risk"], order=["High", "Medium", "Low", "All"]),
        "risk_invalid": profile.domain_check(df, "risk", ["High", "Medium", "Low", "All"], fill="All"),
        "dates": profile.temporal_profile(df, "inspection_date"),
        "dates_summary": profile.temporal_summary(df, "inspection_date"),
        "inspection_types": profile.value_counts(kinds, ["standardized_type"]),
        "results": profile.ranked_distribution(results, "results"),
        "top_zips": profile.top_k(df, ["zip"], 5),
        "zip_lengths": profile.length_distribution(df, "zip"),
        "states": profile.value_counts(df, ["state"], dropna=False),
        "coordinates": sample_n(
            df.select("inspection_id", "latitude", "longitude"), 1000, 42, ["inspection_id"]
        ),
        "zip_conflicts": profile.mapping_conflicts(df, "zip", "state"),
        "similar_cities": fuzzy.close_matches(df, "city"),
        "similar_states": fuzzy.close_matches(df, "state"),
        "violation_structure": multivalue.profile_multivalue(df, "violations"),
        "violation_validity": multivalue.validate_multivalue(df, "violations"),
        "city_terms": fuzzy.term_frequencies(df, "city"),
    }
    if as_of:
        reports["quality"] = profile.quality_score(
            df, ["inspection_id"], "facility_type", "results",
            ["Pass", "Pass with Conditions", "Fail", "Not Ready"], "inspection_date", as_of,
        )
    return reports


def normalize_and_load(
    df: DataFrame, database: str | None = None, order_by: Sequence[Column] | None = None
) -> dict[str, DataFrame]:
    """Parse, normalise and save the three tables; label counts and rules come along."""
    violations = multivalue.parse_multivalue(df, ["inspection_id"], "violations")
    order = list(order_by or [F.col("inspection_id")])
    facility, inspection = multivalue.normalize_tables(df, "license_num", ENTITY, EVENT, order)
    frames = {"violations": violations, "facility": facility, "inspection": inspection}
    out = {}
    for name, frame in frames.items():
        full = f"{database}.{name}" if database else name
        save_table(frame, full, "replace")
        out[name] = df.sparkSession.table(full)
    out["top_labels"] = multivalue.top_labels(out["violations"])
    found = mining.mine_rules(df.select(*CATEGORIES, "violations"), CATEGORIES, "violations")
    out |= {f"rules_{k}": v for k, v in found.items()}
    return out


def mine_dependencies(
    df: DataFrame,
    columns: Sequence[str],
    max_lhs: int | None = None,
    ind_columns: Sequence[str] | None = None,
    important: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Exact dependencies of the complete rows, their roles, and inclusions."""
    complete = drop_nulls(project(df, columns))
    fds = dependencies.discover_fds(complete, columns, max_lhs)
    filled = fill_sentinel(project(df, list(ind_columns or columns)))
    inds = inclusion.discover_inds(filled, min_conf=0.95)
    return {
        "fds": fds,
        "roles": dependencies.attribute_roles(fds, important),
        "fd_edges": dependencies.fd_edges(fds),
        "inds": inds,
        "ind_roles": inclusion.ind_roles(inds),
        "ind_chains": inclusion.ind_chains(inds),
        "ind_equivalences": inclusion.ind_equivalences(inds),
    }


def repair_by_afds(
    df: DataFrame,
    columns: Sequence[str],
    selected: Sequence[str],
    max_lhs: int = 2,
    threshold: float = 0.1,
    min_conf: float = 95.0,
) -> dict[str, DataFrame]:
    """Mine approximate dependencies, report their violations, repair by the selected ones."""
    complete = drop_nulls(project(df, columns))
    afds = dependencies.discover_afds(complete, columns, max_lhs, threshold)
    afds = dependencies.filter_redundant(afds, max_lhs)
    accepted = repair.accepted_fds(afds, min_conf)
    report = repair.validate_fds(df, accepted, selected)
    chosen = {repair.parse_fd(s) for s in selected}
    to_fix = [
        fd for s, fd in ((frozenset(fd[0]), fd) for fd, _ in accepted)
        if any(s == frozenset(x) and fd[1] == y for x, y in chosen)
    ]
    out = {"afds": afds, "report": report, "repaired": df}
    if to_fix:
        names = [f"{','.join(x)} → {y}" for x, y in to_fix]
        violations = repair.fd_violations(df, to_fix, names)
        out["violations"] = violations
        out["repaired"], out["stats"] = repair.repair_from_report(df, violations)
    return out
