"""String expressions: every function takes and returns a ``Column``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of letters, digits, ``_`` and ``'`` that starts and ends with a
# letter, digit or ``_``.  Spelled with Unicode classes because ``\w`` is ASCII in Java.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"


def squeeze(c: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def null_if(c: Column, tokens: Iterable[str]) -> Column:
    """NULL where the value is one of ``tokens``."""
    return F.when(~c.isin(list(tokens)), c)


def identifier(c: Column, null_tokens: Iterable[str] = ("nan",)) -> Column:
    """Identifier text: trimmed, without a trailing ``.0``."""
    return null_if(F.regexp_replace(F.trim(c.cast("string")), r"\.0$", ""), null_tokens)


def zip5(c: Column) -> Column:
    """First run of five digits; NULL if there is none or it is all zeros."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return null_if(F.regexp_extract(text, r"(\d{5})", 1), ["", "00000"])


def title(c: Column) -> Column:
    """Title case that starts a new word after every non-letter (``o'hare`` -> ``O'Hare``).

    ``initcap`` only starts words at blanks, so a marker and a blank are put in
    front of the other word starts and taken out again.
    """
    marked = F.regexp_replace(F.lower(c), r"(?<=[^\p{L}\s])(?=\p{L})", "\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def strip_brackets(c: Column) -> Column:
    """Drop bracketed text, nested or not; an unclosed bracket drops the rest."""
    flat = c
    for _ in range(3):
        flat = F.regexp_replace(flat, r"\([^()]*\)", "")

    def step(acc: Column, ch: Column) -> Column:
        opened, closed = ch == "(", (ch == ")") & (acc["depth"] > 0)
        depth = acc["depth"] + F.when(opened, 1).when(closed, -1).otherwise(0)
        keep = ~opened & ~closed & (acc["depth"] == 0)
        return F.struct(
            depth.alias("depth"),
            F.concat(acc["out"], F.when(keep, ch).otherwise("")).alias("out"),
        )

    deep = F.aggregate(
        F.split(flat, ""),
        F.struct(F.lit(0).alias("depth"), F.lit("").alias("out")),
        step,
        lambda acc: acc["out"],
    )
    # Brackets nested deeper than three levels are rare: only they pay for the fold.
    return F.when(flat.rlike(r"\([^()]*\)"), deep).otherwise(
        F.regexp_replace(flat, r"(?s)\(.*$", "")
    )


def words(c: Column) -> Column:
    """All words of a text, in order."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def letters_only(c: Column) -> Column:
    """Upper case, only A-Z and single blanks."""
    return F.regexp_replace(
        F.regexp_replace(F.upper(F.trim(c)), r"[^A-Z\s]", ""), r"\s+", " "
    )
