"""Multi-valued text cells: profile, validate, parse, normalise."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.frames import first_by_key

# Shape of one part, and where its fields stand.
PART_SHAPE = r"(?d)^\s*\d+\.\s+.+?(\s+-\s+Comments:\s*.+)?$"
PART_FIELDS = r"(?d)^(\d+)\.\s+(.+?)\s+-\s+Comments:\s*(.+)"
CODES = r"(?=\d)\b(\d+)\.(?=\s+[A-Z])"  # the first test only spares the costly \b
SEPARATORS = ("|", ".", "-", ":", ";")


# Between the fields of a part: EDGE, MARK, EDGE, with more marks than a part holds.
EDGE, MARK = "\x01", "\x02"

# White space around a part.
BLANKS = " \t\n\r\v\f\u0085\u00a0"


def _pieces(c: Column, sep: str) -> Column:
    """Parts as they stand between separators (a plain split, no pattern search)."""
    return F.split(c, re.escape(sep))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def parts(c: Column, sep: str = "|") -> Column:
    """Trimmed, non-empty parts of a cell."""
    return F.filter(F.transform(_pieces(c, sep), strip), lambda p: p != "")


def _non_empty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def profile_multivalue(
    df: DataFrame,
    column: str,
    sep: str = "|",
    sample: int | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Structure of the non-empty cells (the first ``sample`` of them) in one row."""
    cells = _non_empty(df, column)
    if sample is not None:
        cells = cells.orderBy(*(order_by or [column])).limit(sample)
    c, p = F.col(column), parts(F.col(column), sep)
    counted = cells.select(
        F.length(c).alias("len"),
        *[
            (F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))).alias(f"sep{i}")
            for i, s in enumerate(SEPARATORS)
        ],
        F.size(p).alias("entries"),
        F.forall(p, lambda x: x.rlike(r"^\s*\d+\.")).alias("numbered"),
        F.exists(_pieces(c, sep), lambda x: x.contains("Comments:")).alias("commented"),
    )
    named = ["pipe", "period", "hyphen", "colon", "semicolon"]
    return counted.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.avg("len").alias("avg_length"),
        *[F.avg(f"sep{i}").alias(f"avg_{n}") for i, n in enumerate(named)],
        F.min("entries").alias("min_entries"),
        F.max("entries").alias("max_entries"),
        F.avg("entries").alias("avg_entries"),
        F.avg(F.col("numbered").cast("int")).alias("share_numbered"),
        F.avg(F.col("commented").cast("int")).alias("share_commented"),
    )


def entries_distribution(df: DataFrame, column: str, sep: str = "|") -> DataFrame:
    """How many cells hold how many parts."""
    return (
        _non_empty(df, column)
        .groupBy(F.size(parts(F.col(column), sep)).alias("entries"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _valid(c: Column, sep: str, pattern: str) -> Column:
    p = parts(c, sep)
    return (F.size(p) > 0) & F.forall(p, lambda x: x.rlike(pattern))


def validate_multivalue(
    df: DataFrame, column: str, sep: str = "|", pattern: str = PART_SHAPE
) -> DataFrame:
    """Checked, valid and invalid non-empty cells, and the valid percentage."""
    ok = _valid(F.col(column), sep, pattern)
    counts = _non_empty(df, column).agg(
        F.count(F.lit(1)).alias("total_checked"),
        F.count_if(ok).alias("valid_entries"),
        F.count_if(~ok).alias("invalid_entries"),
    )
    pct = F.col("valid_entries") * 100.0 / F.nullif(F.col("total_checked"), F.lit(0))
    return counts.withColumn("validity_percentage", F.coalesce(F.round(pct, 2), F.lit(0.0)))


def invalid_samples(
    df: DataFrame, column: str, sep: str = "|", pattern: str = PART_SHAPE, k: int = 5
) -> DataFrame:
    """The first ``k`` invalid cells in text order."""
    bad = _non_empty(df, column).where(~_valid(F.col(column), sep, pattern))
    return bad.select(column).orderBy(column).limit(k)


def parse_multivalue(
    df: DataFrame,
    key: Sequence[str],
    column: str,
    sep: str = "|",
    pattern: str = PART_FIELDS,
    fields: Sequence[str] = ("violation_code", "category", "comment"),
) -> DataFrame:
    """One row per matching part; the first field is a number, the rest is text."""
    # Exploded first: trimming and matching then run as compiled code, row by row.
    each = df.select(*key, F.explode(_pieces(F.col(column), sep)).alias("__part"))
    each = each.withColumn("__part", strip(F.col("__part")))
    # One search per part: its fields come out between marks.  Exploded too, or the filter would
    # repeat the search; a search per field besides makes the step too large to be compiled.
    part, mark, places = F.col("__part"), F.col("__mark"), range(1, len(fields) + 1)
    more = F.concat(F.lit(EDGE), F.repeat(F.lit(MARK), F.length(part) + 1), F.lit(EDGE))
    each = each.withColumn("__mark", F.when(part.contains(MARK), more).otherwise(EDGE + MARK + EDGE))
    marked = F.concat(mark, *[x for i in places for x in (F.lit(f"${i}"), mark)])
    once = F.when(part != "", F.regexp_replace(part, F.lit(pattern), marked))
    each = each.select(*key, "__mark", F.explode(F.array(once)).alias("__found"))
    hit = each.where(F.col("__found").contains(mark))
    got = [F.trim(F.split_part(F.col("__found"), mark, F.lit(i + 1))) for i in places]
    got[0] = got[0].try_cast("bigint")
    return hit.select(*key, *[g.alias(f) for g, f in zip(got, fields)])


def extract_codes(
    df: DataFrame, column: str, pattern: str = CODES, output: str = "codes"
) -> DataFrame:
    """All codes of a cell as an array; empty for NULL."""
    codes = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1))
    return df.withColumn(output, F.coalesce(codes, F.array().cast("array<string>")))


def top_labels(
    df: DataFrame,
    code: str = "violation_code",
    category: str = "category",
    k: int = 20,
    width: int = 40,
) -> DataFrame:
    """The ``k`` most frequent ``code-category`` labels."""
    label = F.concat_ws("-", F.col(code).cast("string"), F.substring(category, 1, width))
    counts = df.groupBy(label.alias("code_category")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "code_category").limit(k)


def attach(df: DataFrame, parsed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Parsed rows beside their base row; base rows without one stay."""
    return df.join(parsed, list(key), "left")


def normalize_tables(
    df: DataFrame,
    key: str,
    entity_columns: Sequence[str],
    event_columns: Sequence[str],
    order_by: Sequence[Column],
) -> tuple[DataFrame, DataFrame]:
    """Entity table (first row per key) and event table (plain projection)."""
    entity = first_by_key(df, [key], order_by, list(entity_columns))
    return entity, df.select(*event_columns)


def top_codes(
    violations: DataFrame,
    categories: DataFrame | None = None,
    k: int = 10,
    code: str = "violation_code",
    category: str = "category",
) -> DataFrame:
    """The ``k`` most frequent codes with a category.

    With a dimension table the category comes from there.  Counting runs first, as a
    hash aggregate of (code, category), so that the text minimum and the join see few rows.
    """
    if categories is None:
        pairs = violations.groupBy(code, category).agg(F.count(F.lit(1)).alias("n"))
        counts = pairs.groupBy(code).agg(
            F.min(category).alias(category), F.sum("n").alias("n")
        )
    else:
        per_code = violations.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
        counts = per_code.join(categories.select(code, category), code)
        counts = counts.groupBy(code).agg(
            F.min(category).alias(category), F.sum("n").alias("n")
        )
    return counts.orderBy(F.desc("n"), code).limit(k)
