"""Candidate pairs of like texts, from an index of pieces that the edits between them spare.

Two texts of ``la`` and ``lb`` letters whose score ``2M / (la + lb)`` reaches ``c`` are at most
``D = (1 - c)(la + lb)`` insertions and deletions apart: ``da`` letters of one and ``db`` of the
other stay unmatched.  Of pieces of the first text that do not overlap, an unmatched letter of
either spoils one at most, so of ``da + db + 1`` one stands whole in the other text, moved by
``da`` letters back or ``db`` forth at most.  One side sends so many of its rarest pieces, for each
length that partners may have, the other side all grams of the pieces' lengths.  No pair is missed,
at any ``c`` above 0: single letters are spoilt by the text's own unmatched letters only, and one
of those is matched.

Pieces are as long as their number allows, ``LONGEST`` letters at most; shorter ones meet only at
fitting lengths and near fitting places.  Pairs of short texts are compared where they meet, so what
is no pair is never sent on.  All is made within a text's own row; only pieces are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of the longest pieces.
LONGEST = 6
#: Texts of so many letters go along with their pieces and are compared at once.
CARRIED = 64
#: Counters that tell rare grams from frequent ones; grams may share one.
COUNTERS = 1 << 16
#: Rounding of products of lengths and shares.
NEAR = 1e-9


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unmatched(own: Column, other: Column, c: float) -> Column:
    """Most letters of a text of ``own`` letters that may stay unmatched: ``(D + own - other) / 2``."""
    return F.floor(own * (1 - c / 2) - other * (c / 2) + NEAR)


def partners(n: Column, c: float) -> tuple[Column, Column]:
    """Least and greatest length of a text that may score ``c`` with one of ``n`` letters."""
    return F.ceil(n * (c / (2 - c)) - NEAR).cast("int"), F.floor(n * ((2 - c) / c) + NEAR).cast("int")


def cell(n: Column) -> Column:
    """Number of the cell of lengths that holds ``n``: single lengths below 16, then eight to a doubling."""
    shift = F.greatest(F.floor(F.log2(n.cast("double")) + NEAR) - 3, F.lit(0)).cast("int")
    return F.when(n < 16, n).otherwise(8 * shift + F.call_function("shiftright", n, shift)).cast("int")


def cell_shift(k: Column) -> Column:
    """Lengths of a cell, and places of a stretch in its texts, as a power of two."""
    return F.when(k < 16, 0).otherwise(F.floor(k / 8) - 1).cast("int")


def cell_ends(k: Column) -> tuple[Column, Column]:
    """Least and greatest length of a cell."""
    shift = cell_shift(k)
    low = F.call_function("shiftleft", k - 8 * shift, shift)
    return low, low + F.call_function("shiftleft", F.lit(1), shift) - 1


def cut(n: Column, spoilt: Column, own: Column, longest: int) -> tuple[Column, Column]:
    """Letters of a piece and number of pieces, of ``n`` letters: one piece more than may be spoilt.

    ``spoilt`` bounds the unmatched letters of both texts, ``own`` those of this one.
    """
    q = F.greatest(F.least(F.floor(n / (spoilt + 1)), F.lit(longest)), F.lit(1)).cast("int")
    return q, F.when(q > 1, spoilt + 1).otherwise(F.greatest(F.least(own + 1, n), F.lit(1))).cast("int")


def pieces_for(n: Column, k: Column, c: float) -> Column:
    """``(k, q, most, back, forth)``: pieces of a text of ``n`` letters for partners in the cell ``k``."""
    least, most = partners(n, c)
    low, high = cell_ends(k)
    back, forth = unmatched(n, F.greatest(low, least), c), unmatched(F.least(high, most), n, c)
    both = F.floor((n + F.least(high, most)) * (1 - c) + NEAR)
    q, pieces = cut(n, F.greatest(F.least(back + forth, both), F.lit(0)), back, LONGEST)
    return F.struct(
        k.alias("k"), q.alias("q"), pieces.alias("most"),
        F.greatest(back, F.lit(0)).cast("int").alias("back"), F.greatest(forth, F.lit(0)).cast("int").alias("forth"),
    )


def token(letters: Column, q: Column, at: Column) -> Column:
    """A gram by a 64-bit hash; two that share one only make a candidate more."""
    return F.xxhash64(q, F.slice(letters, at + 1, q))


def meeting(q: Column, gram: Column, k: Column, stretch: Column) -> Column:
    """Where pieces meet grams: long ones anywhere, short ones by the cell and the stretch of the text."""
    weak = q < LONGEST
    return F.xxhash64(gram, F.when(weak, k).otherwise(-1), F.when(weak, stretch).otherwise(-1))


def rarest(letters: Column, q: Column, most: Column, table: bytes) -> Column:
    """``(held, token, at)`` of the ``most`` rarest of a text's pieces; where one will do, of all its grams."""
    step = F.when(most == 1, 1).otherwise(q)
    grams = F.transform(F.sequence(F.lit(0), F.size(letters) - q, step), lambda at: F.struct(token(letters, q, at).alias("token"), at.alias("at")))
    held = F.transform(grams, lambda g: F.struct(rarity(g["token"], table).alias("held"), g["token"].alias("token"), g["at"].alias("at")))
    return F.slice(F.sort_array(held), F.lit(1), most)


def rarity(gram: Column, table: bytes) -> Column:
    return F.substring(F.lit(table), F.pmod(gram, F.lit(COUNTERS)).cast("int") + 1, F.lit(1))


def counted(tokens: DataFrame) -> bytes:
    """How often grams of each counter occur in ``tokens (token)``: a byte each, an eighth of a doubling a step."""
    out = bytearray(COUNTERS)
    of = F.pmod("token", F.lit(COUNTERS)).alias("of")
    for r in tokens.where("token is not null").groupBy(of).agg(F.count(F.lit(1)).alias("held")).collect():
        out[r["of"]] = min(255, round(8 * log2(1 + r["held"])))
    return bytes(out)


def spans(placed: Column) -> Column:
    """``(key, first, last)`` of an array of ``(key, at)``: each key once, with its least and greatest place."""

    def made(rows: Column) -> Column:
        numbered = F.transform(rows, lambda r, i: F.struct(r["key"].alias("key"), r["at"].alias("first"), i.alias("i")))
        begins = F.filter(numbered, lambda r: (r["i"] == 0) | (F.get(rows, r["i"] - 1)["key"] != r["key"]))

        def ended(starts: Column) -> Column:
            def end(i: Column) -> Column:
                return F.coalesce(F.get(starts, i + 1)["i"], F.size(rows)) - 1

            return F.transform(starts, lambda r, i: F.struct(r["key"].alias("key"), r["first"].alias("first"), F.get(rows, end(i))["at"].alias("last")))

        return let(begins, ended)

    return let(F.sort_array(placed), made)


def _texts(side: DataFrame) -> DataFrame:
    """``(id, form, n)``; null and empty forms are left out."""
    return side.select("id", "form", F.length("form").alias("n")).where("n > 0")


def _letters(use: Callable[[Column], Column]) -> Column:
    """``use`` of the letters of ``form``, taken apart once."""
    return let(F.split("form", ""), use)


def _each(rows: Column) -> Column:
    """One row per element; an empty array gives a null, which joins nothing and costs no second look at the array."""
    return F.explode_outer(rows)


def _carried() -> Column:
    return F.when(F.col("n") <= CARRIED, F.col("form")).alias("form")


def similar_pairs(left: DataFrame, right: DataFrame, c: float, ordered: bool = False) -> DataFrame:
    """``(id, other)``: all pairs of forms that may score ``c`` or more, some more than once.

    ``left`` and ``right`` are ``(id, form)``; an id may have several forms.  Null and empty
    forms meet nothing.  ``ordered`` asks for pairs with the smaller id first only.
    """
    if not 0 < c <= 1:
        raise ValueError("the score must lie above 0 and not above 1")
    n = F.col("n")
    least, most = partners(n, c)

    # All grams of the lengths that the pieces of any partner have.
    lengths = F.array_distinct(F.transform(F.sequence(least, most), lambda m: pieces_for(m, F.col("k"), c)["q"]))
    held = _texts(right).withColumn("k", cell(n)).withColumn("q", _each(lengths)).where("n >= q")
    q, k = F.col("q"), F.col("k")
    tokens = _letters(lambda letters: F.transform(F.sequence(F.lit(0), F.size(letters) - q), lambda at: token(letters, q, at)))
    table = counted(held.select(_each(tokens).alias("token")))
    placed = F.transform(tokens, lambda t, at: F.struct(
        meeting(q, t, k, F.call_function("shiftright", at, cell_shift(k))).alias("key"), at.alias("at")))
    b = held.select("id", "n", _carried(), _each(spans(placed)).alias("g"))
    b = b.select("g.key", "id", "n", "g.first", "g.last", "form").alias("b")

    def sent(letters: Column, p: Column) -> Column:
        def places(g: Column) -> Column:
            shift = cell_shift(p["k"])
            first = F.call_function("shiftright", F.greatest(g["at"] - p["back"], F.lit(0)), shift)
            last = F.when(p["q"] < LONGEST, F.call_function("shiftright", g["at"] + p["forth"], shift)).otherwise(first)
            return F.transform(F.sequence(first, last), lambda s: F.struct(meeting(p["q"], g["token"], p["k"], s).alias("key"), g["at"].alias("at")))

        return F.flatten(F.transform(rarest(letters, p["q"], p["most"], table), places))

    cells = F.sequence(cell(least), cell(most))
    dealt = _letters(lambda letters: F.transform(cells, lambda x: let(pieces_for(F.size(letters), x, c), lambda p: sent(letters, p))))
    a = _texts(left).select("id", "n", _carried(), _each(spans(F.flatten(dealt))).alias("g"))
    a = a.select("g.key", "id", "n", "g.first", "g.last", "form").alias("a")

    la, lb = F.col("a.n"), F.col("b.n")
    da, db = unmatched(la, lb, c), unmatched(lb, la, c)
    fits = (da >= 0) & (db >= 0) & (F.col("b.first") - F.col("a.last") <= db) & (F.col("a.first") - F.col("b.last") <= da)
    if ordered:
        fits &= F.col("a.id") < F.col("b.id")
    # No more edits than letters that stay unmatched; null, so kept, where a text was too long to go along.
    edits = F.levenshtein("a.form", "b.form") <= (la + lb) * (1 - c) + NEAR
    # Both sides are many times what the planner takes them for: never broadcast.
    met = a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & fits & F.coalesce(edits, F.lit(True)))
    return met.select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))


def window_pairs(short: DataFrame, long: DataFrame, c: float, longest: int = 3, times: float = 1.0) -> DataFrame:
    """``(id, other)``: pairs where a window of the longer form may score ``c`` against the shorter one,
    some more than once.

    Both sides are ``(id, form)``; the window is as long as the shorter form, or cut off by the
    end of the longer one.  Of the shorter form the rarest pieces are indexed, of the longer one
    all grams: the window may lie anywhere.  The longer one is ``times`` as long at least.  With
    ``longest`` 1 the letters may stand in any order.
    """
    if not 0 < c <= 1:
        raise ValueError("the score must lie above 0 and not above 1")
    n = F.col("n")
    whole, cut_off = F.floor(n * (1 - c) + NEAR), F.floor(n * (2 * (1 - c) / (2 - c)) + NEAR)
    spoilt = F.greatest(2 * whole, F.floor((2 * n - 1) * (1 - c) + NEAR))
    q, most = cut(n, spoilt, F.greatest(whole, cut_off), longest)
    pieces = _texts(short).withColumns({"q": q, "most": most, "all": spoilt == 0})
    used = [r["q"] for r in pieces.select("q").distinct().collect()]

    lengths = F.filter(F.array(*map(F.lit, used)).cast("array<int>"), lambda x: x <= n)
    each = _letters(lambda letters: F.array_distinct(F.flatten(
        F.transform(lengths, lambda x: F.transform(F.sequence(F.lit(0), F.size(letters) - x), lambda at: token(letters, x, at))))))
    held = _texts(long).select("id", "n", _carried(), _each(each).alias("token"))
    table = counted(held.select("token"))
    chosen = _letters(lambda letters: F.array_distinct(F.transform(rarest(letters, F.col("q"), F.col("most"), table), lambda g: g["token"])))
    a = pieces.select("id", "n", _carried(), "all", _each(chosen).alias("token")).alias("a")
    b = held.alias("b")
    met = (F.col("a.token") == F.col("b.token")) & (F.col("a.n") * times <= F.col("b.n"))
    if longest > 1:
        # Where no letter may be left out, the shorter text stands in the longer one.
        met &= ~F.col("a.all") | F.coalesce(F.contains("b.form", "a.form"), F.lit(True))
    return a.hint("merge").join(b, met).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"))
