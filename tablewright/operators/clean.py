"""Column cleaning and standardisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import text
from tablewright.functions.frames import first_by_key, lookup, map_values


def clean_name(name: str) -> str:
    return name.lower().replace(" ", "_").replace("#", "num").strip()


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def enforce_schema(
    df: DataFrame, schema: T.StructType, date_formats: Sequence[str] = ("MM/dd/yyyy",)
) -> DataFrame:
    """Cast the columns named in ``schema``; what cannot be cast becomes NULL."""
    target = {f.name: f.dataType for f in schema.fields}

    def cast(name: str) -> Column:
        c, to = F.col(name), target.get(name)
        if to is None:
            return c
        if isinstance(to, T.StringType):
            return text.null_if(c.cast("string"), ["nan"]).alias(name)
        if isinstance(to, (T.TimestampType, T.DateType)):
            tries = [F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in date_formats]
            return F.coalesce(*tries).cast(to).alias(name)
        number = c.try_cast("double") if c_is_text(df, name) else c
        if isinstance(to, T.DoubleType):
            return F.nanvl(number.cast("double"), F.lit(None)).alias(name)
        direct = c.try_cast(to)
        return F.coalesce(direct, number.try_cast(to)).alias(name)

    return df.select(*[cast(c) for c in df.columns])


def c_is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def schema_compliance(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per expected column: expected and actual type, match, missing values."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    present = [f.name for f in schema.fields if f.name in actual]
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in present],
    )
    rows = []
    for f in schema.fields:
        known = f.name in actual
        expected, found = f.dataType.simpleString(), actual.get(f.name, "MISSING")
        missing = F.col(f.name) if known else F.lit(None).cast("long")
        pct = missing * F.lit(100.0) / F.col("__rows")
        rows.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(expected).alias("expected_type"),
                F.lit(found).alias("actual_type"),
                F.lit(expected == found).alias("is_compliant"),
                missing.alias("missing_values"),
                F.round(pct, 2).alias("missing_pct"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))


def clean_identifier(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, text.identifier(F.col(column)))


def clean_zip(df: DataFrame, column: str = "zip") -> DataFrame:
    """Adds ``zip_clean`` and ``zip_valid``."""
    clean = df.withColumn("zip_clean", text.zip5(F.col(column)))
    return clean.withColumn("zip_valid", F.col("zip_clean").isNotNull())


def map_exact(
    df: DataFrame, column: str, mapping: Mapping[str, str], default: str = "All"
) -> DataFrame:
    """Exact category map; anything else, NULL too, becomes ``default``."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    known = F.create_map(*pairs)
    found = F.try_element_at(known, F.col(column))
    return df.withColumn(column, F.coalesce(found, F.lit(default)))


def split_category(
    df: DataFrame, column: str, pattern: str, fields: Mapping[str, str]
) -> DataFrame:
    """Regex groups 1, 2, ... of ``column`` into new columns ``{name: type}``."""
    for i, (name, kind) in enumerate(fields.items(), start=1):
        part = F.when(
            F.col(column).rlike(pattern), F.regexp_extract(F.col(column), pattern, i)
        )
        df = df.withColumn(name, part.try_cast(kind))
    return df


def standardize_text(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    null_tokens: Sequence[str] = ("nan",),
) -> DataFrame:
    """Lower case, trimmed, null tokens to NULL; all string columns by default."""
    chosen = columns or [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)
    ]
    new = {c: text.null_if(F.lower(F.trim(F.col(c))), null_tokens) for c in chosen}
    return df.withColumns(new)


def fill_from(df: DataFrame, target: str, source: str) -> DataFrame:
    return df.withColumn(target, F.coalesce(F.col(target), F.col(source)))


def fill_by_lookup(
    df: DataFrame,
    target: str,
    key: str,
    table: DataFrame,
    table_key: str,
    table_value: str,
    order_by: Sequence[Column] | None = None,
) -> DataFrame:
    """Fill NULL ``target`` from ``table``; of several entries with a value the first by ``order_by``.

    Only rows that need a value carry a join key, so filled rows never meet in one task.
    """
    order = list(order_by or [F.col(table_value)])
    first = first_by_key(
        table.where(F.col(table_key).isNotNull() & F.col(table_value).isNotNull()),
        [table_key],
        order,
        [table_key, table_value],
    ).select(F.col(table_key).alias("__k"), F.col(table_value).alias("__v"))
    need = df.withColumn("__k", F.when(F.col(target).isNull(), F.col(key)))
    filled = lookup(need, first, ["__k"])
    return filled.withColumn(target, F.coalesce(F.col(target), F.col("__v"))).select(
        *df.columns
    )


# Postal abbreviations written in capitals.
POSTAL_ABBREVIATIONS = ("St", "Ave", "Blvd", "Dr", "Ln", "Rd", "Hwy", "Us")


def address_text(c: Column) -> Column:
    out = text.title(text.squeeze(text.strip_brackets(c)))
    for word in POSTAL_ABBREVIATIONS:
        out = F.regexp_replace(out, rf"(?U)\b{word}\b", word.upper())
    return out


def format_address(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, address_text(F.col(column)))


def geocode_requests(
    df: DataFrame,
    street: str = "address",
    city: str = "city",
    state: str = "state",
    zip_code: str = "zip",
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """Distinct addresses of rows without coordinates, with a request id.

    The id is a hash of the address, so it needs no global numbering.
    """
    rows = df.where(F.col(lat).isNull() | F.col(lon).isNull()).select(
        address_text(F.col(street)).alias("street"),
        F.col(city).alias("city"),
        F.col(state).alias("state"),
        F.col(zip_code).cast("string").alias("zip"),
    )
    line = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in rows.columns])
    return rows.distinct().select(F.md5(line).alias("id"), "*")


def merge_geocodes(
    df: DataFrame,
    results: DataFrame,
    street: str = "address",
    city: str = "city",
    state: str = "state",
    zip_code: str = "zip",
    lat: str = "latitude",
    lon: str = "longitude",
    location: str = "location",
) -> DataFrame:
    """Coordinates of matched answers into the rows that lack them.

    Answers are joined on ``street, city, state, zip``; of several answers for one
    address the one with the greatest ID wins.
    """
    parts = F.split(F.col("location"), ",")
    matched = (
        results.where(F.col("match_status") == "Match")
        .groupBy(F.col("input_address").alias("__addr"))
        .agg(F.max_by(F.struct("location"), F.struct("ID", "location")).alias("r"))
        .select("__addr", F.col("r.location").alias("location"))
        .select(
            "__addr",
            parts.getItem(0).try_cast("double").alias("__lon"),
            parts.getItem(1).try_cast("double").alias("__lat"),
            F.col("location").alias("__loc"),
        )
    )
    full = F.concat(
        address_text(F.col(street)), F.lit(", "), F.col(city), F.lit(", "),
        F.col(state), F.lit(", "), F.col(zip_code).cast("string"),
    )
    unresolved = F.col(lat).isNull() | F.col(lon).isNull()
    joined = lookup(df.withColumn("__addr", F.when(unresolved, full)), matched, ["__addr"])
    new = {
        lat: F.coalesce(F.col("__lat"), F.col(lat)),
        lon: F.coalesce(F.col("__lon"), F.col(lon)),
    }
    if location in df.columns:
        new[location] = F.coalesce(F.col("__loc"), F.col(location))
    return joined.withColumns(new).select(*df.columns)


def discretize(df: DataFrame, columns: Sequence[str], whole: bool = True) -> DataFrame:
    """Numbers to strings, by default after cutting the fraction off."""
    return df.withColumns(
        {
            c: (F.col(c).cast("long") if whole else F.col(c)).cast("string")
            for c in columns
        }
    )


def fill_audit(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """``(key, value, status)`` of every row whose ``column`` was NULL before a fill."""
    was = before.where(F.col(column).isNull()).select(key)
    now = after.select(F.col(key), F.col(column).alias("value"))
    status = F.when(F.col("value").isNotNull(), "Filled").otherwise("Still Missing")
    return was.join(now, key, "left").withColumn("status", status)


def fill_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def date_parts(df: DataFrame, column: str, formats: Sequence[str] = ()) -> DataFrame:
    """Adds ``year``, ``month`` and ``month_name``; text is parsed first."""
    c = F.col(column)
    if c_is_text(df, column):
        c = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])
    return df.withColumns(
        {
            column: c,
            "year": F.year(c),
            "month": F.month(c),
            "month_name": F.date_format(c, "MMMM"),
        }
    )


# Inspection categories, first match wins.
INSPECTION_RULES = (
    ("canvass", r"(canvass|routine|periodic|standard|surveillance)"),
    ("consultation", r"(consult|pre.?open|pre.?operat)"),
    ("complaint", r"(complaint|consumer|public\s*health)"),
    ("license", r"(license|permit|new\s*establishment|initial)"),
    ("suspect food poisoning", r"(food\s*poison|outbreak|illness|contaminat)"),
    ("task-force inspection", r"(task\s*force|bar|tavern|special|targeted)"),
)
REINSPECTION_TERMS = ("re-inspect", "reinspect", "follow.up")


def categorize(
    df: DataFrame,
    column: str,
    output: str,
    rules: Sequence[tuple[str, str]] = INSPECTION_RULES,
    flag_terms: Sequence[str] = REINSPECTION_TERMS,
    suffix: str = " (re-inspection)",
) -> DataFrame:
    """First matching rule, else ``other``; the suffix marks flagged known categories."""
    c = F.lower(F.trim(F.col(column)))
    flagged = F.lit(False)
    for term in flag_terms:
        flagged = flagged | c.contains(term)
    tail = F.when(flagged, suffix).otherwise("")
    label = F.when(c.isNull(), F.lit(None).cast("string"))
    for name, pattern in rules:
        label = label.when(c.rlike(f"(?i){pattern}"), F.concat(F.lit(name), tail))
    return df.withColumn(output, label.otherwise("other"))


# Known misspellings, replacements and term rules of the category cleaner.
KNOWN_TYPOS = {
    "childern": "children",
    "assissted": "assisted",
    "restuarant": "restaurant",
    "commisary": "commissary",
    "convnience": "convenience",
    "liquore": "liquor",
    "facilty": "facility",
    "nutriton": "nutrition",
    "herbalcal": "herbalife",
    "cafetaria": "cafeteria",
    "poulty": "poultry",
    "hooka": "hookah",
}
CORRECTIONS = {
    "Childern": "Children",
    "Tavern": "Restaurant",
    "Grocery Store Store": "Grocery Store",
    "Assissted": "Assisted",
    "Restuarant": "Restaurant",
    "Commisary": "Commissary",
    "Hooka": "Hookah",
    "Parlor": "Shop",
    "Cart": "Station",
    "Liqour": "Liquor",
    "Children S Services Facility": "Children's Services Facility",
}
TERM_RULES = {
    r"Hookah (Bar|Lounge)": "Hookah Lounge",
    r"Ice Cream (Parlor|Shop|Store)": "Ice Cream Shop",
    r"Hot Dog (Cart|Station)": "Hot Dog Station",
    r"Long[\s-]Term Care (Facility)?": "Long Term Care",
    r"Day ?Care": "Day Care",
    r"Banquet (Hall|Room|Facility)": "Banquet Hall",
    r"Gas ?Station": "Gas Station",
    r"Shared Kitchen": "Shared Kitchen User",
    r"Mobile (Food|Frozen)": "Mobile Food",
}


def before_typos(c: Column) -> Column:
    """Drop four-digit numbers, unwrap brackets, lower case, words joined by blanks."""
    cut = F.trim(F.regexp_replace(F.trim(c), r"(?U)\b\d{4}\b", ""))
    inner = F.when(
        cut.startswith("(") & cut.endswith(")"), F.trim(F.substr(cut, F.lit(2), F.length(cut) - 2))
    ).otherwise(cut)
    return F.array_join(text.words(F.lower(inner)), " ")


def after_typos(
    c: Column, corrections: Mapping[str, str], terms: Mapping[str, str]
) -> Column:
    """Ordered replacements, first term rule, title case, empty to NULL."""
    out = F.regexp_replace(c, r"(?i)Children'S", "Children's")
    out = F.regexp_replace(out, r"(?i)Childrens", "Children's")
    for wrong, right in corrections.items():
        out = F.regexp_replace(out, rf"(?iU)\b{wrong}\b", right)
    chosen = F.when(F.lit(False), out)
    for pattern, right in terms.items():
        rule = f"(?i){pattern}"
        chosen = chosen.when(out.rlike(rule), F.regexp_replace(out, rule, right))
    return text.null_if(text.title(chosen.otherwise(out)), [""])


def clean_category_text(
    df: DataFrame,
    column: str,
    output: str | None = None,
    typo_map: Mapping[str, str] | DataFrame | None = None,
    corrections: Mapping[str, str] | None = None,
    terms: Mapping[str, str] | None = None,
) -> DataFrame:
    """Free-text category cleaning on the distinct values, joined back.

    ``typo_map`` is a dictionary or a frame ``(typo, correction)``; words with an
    apostrophe are never replaced.
    """
    from tablewright.operators.fuzzy import correct_words

    typos = KNOWN_TYPOS if typo_map is None else typo_map
    fixes = CORRECTIONS if corrections is None else corrections
    rules = TERM_RULES if terms is None else terms

    def make(values: DataFrame) -> DataFrame:
        ready = values.select(F.col("__old").alias("__raw"), before_typos(F.col("__old")).alias("__text"))
        fixed = correct_words(ready, "__text", typos)
        return fixed.select(
            F.col("__raw").alias("__old"), after_typos(F.col("__text"), fixes, rules).alias("__new")
        )

    out = output or column
    return map_values(df.withColumn(out, F.col(column)), out, make)


# Protected category names and the general rules, first match wins.
PROTECTED_TERMS = (
    "School",
    "Grocery Store",
    "Charter School",
    "Private School",
    "Culinary School",
    "Pastry School",
    "Teaching School",
    "Children's Services Facility",
    "Long Term Care",
    "Ice Cream Shop",
    "Hookah Lounge",
    "Hot Dog Station",
    "Convenience Store",
    "Banquet Hall",
    "After School Program",
    "Liquor",
    "Dollar Store",
    "Drug Store",
    "Event Venue",
    "Fitness Center",
    "Gas Station",
)
GENERAL_RULES = (
    (r"Charter School.*", "Charter School"),
    (r"After School (Care|Program)", "After School Program"),
    (r"Before And After School Program", "After School Program"),
    (r".*Culinary.*", "Culinary School"),
    (r"DAY\s?CARE\s?2-14", "Day Care 2 Yrs To 14 Yrs"),
    (r"DAY\s?CARE\s?6\s?WKS-5\s?YRS", "Day Care 5 Weeks To 5 Yrs"),
    (r"Day Care.*2.*6", "Day Care (2 - 6 Years)"),
    (r"Day Care.*Under 2", "Day Care (Under 2 Years)"),
    (r"Day Care.*Combo", "Day Care Combo"),
    (r"Convenient Store", "Convenience Store"),
    (r"Convenience(?! Store)", "Convenience Store"),
    (r".*Dollar.*", "Dollar Store"),
    (r".*Drug.*", "Drug Store"),
    (r".*Event.*", "Event Venue"),
    (r".*Fitness.*", "Fitness Center"),
    (r"Gas\s?[Ss]tation", "Gas Station"),
    (r"Gas Mini Mart", "Gas Station"),
    (r"(Banquet|Banquet Dining)", "Banquet Hall"),
    (r"TAVERN/RESTAURANT", "Restaurant"),
    (r"TAVERN/LIQUOR", "Liquor"),
    (r"Mobile.*Food.*Prepar", "Mobile Prepared Food Vendor"),
    (r"Mobile.*Food.*Dispens", "Mobile Food Dispenser"),
    (r"Long.*Term.*Care", "Long Term Care"),
    (r"Ice Cream.*", "Ice Cream Shop"),
    (r"Hookah.*", "Hookah Lounge"),
    (r"Hot Dog.*", "Hot Dog Station"),
    (r"Paleteria.*", "Ice Cream Shop"),
    (r"(?<!\S)School(?!\S)", "School"),
    (r"GROCERY/", ""),
)


def consolidate(
    df: DataFrame,
    column: str,
    protected: Sequence[str] = PROTECTED_TERMS,
    rules: Sequence[tuple[str, str]] = GENERAL_RULES,
    strip: str = "GROCERY/",
    drop_null: bool = True,
) -> DataFrame:
    """Exact protected term, then contained protected term, then first rule, else as is."""

    def make(values: DataFrame) -> DataFrame:
        original = F.trim(F.col("__old"))
        c = F.regexp_replace(original, strip, "")
        low = F.lower(c)
        label = F.when(low.isNull(), F.lit(None).cast("string"))
        for term in protected:
            label = label.when(low == term.lower(), F.lit(term))
        for term in protected:
            label = label.when(low.contains(term.lower()), F.lit(term))
        for pattern, name in rules:
            label = label.when(c.rlike(f"(?i){pattern}"), F.lit(name))
        return values.withColumn("__new", label.otherwise(original))

    kept = df.where(F.col(column).isNotNull()) if drop_null else df
    return map_values(kept, column, make)


def title_case(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, text.title(F.trim(F.col(column))))


def normalize_name(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, text.letters_only(F.col(column)))
