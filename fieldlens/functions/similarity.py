"""Three measures that must not be mixed up: Indel ratios, capped common-subsequence rates, and matching blocks."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Characters of the shorter text that fit one 64-bit row of the bit-parallel form.
ROW = 61


def _bits(a: Column, b: Column) -> Column:
    """Common subsequence length by Hyyrö's bit-parallel recurrence; b has at most ROW characters."""
    letters = F.array_distinct(F.split(b, ""))
    places = F.sequence(F.lit(0), F.greatest(F.length(b) - 1, F.lit(0)))

    def mask(letter: Column) -> Column:
        return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: F.when(F.substring(b, i + 1, F.lit(1)) == letter, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(acc))

    masks = F.map_from_arrays(letters, F.transform(letters, mask))
    full = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(b)) - 1

    def step(state: Column, letter: Column) -> Column:
        v, f, m = state["v"], state["f"], F.coalesce(F.try_element_at(state["m"], letter), F.lit(0).cast("long"))
        u = v.bitwiseAND(m)
        return F.struct((v + u).bitwiseOR(v - u).bitwiseAND(f).alias("v"), f.alias("f"), state["m"].alias("m"))

    last = F.aggregate(F.split(a, ""), F.struct(full.alias("v"), full.alias("f"), masks.alias("m")), step)
    return F.length(b) - F.bit_count(last["v"])


def _rows(a: Column, b: Column) -> Column:
    """The same by rows of counts, for longer texts."""
    none = F.transform(F.sequence(F.lit(0), F.length(b)), lambda i: F.lit(0))

    def row(prev: Column, letter: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            hit = F.substring(b, j, F.lit(1)) == letter
            return F.concat(acc, F.array(F.when(hit, F.get(prev, j - 1) + 1).otherwise(F.greatest(F.get(prev, j), F.element_at(acc, -1)))))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(F.split(a, ""), none, row), -1)


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    swap = F.length(a) < F.length(b)
    long_, short = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    return F.when(F.length(short) == 0, 0).when(F.length(short) <= ROW, _bits(long_, short)).otherwise(_rows(long_, short)).cast("int")


def indel_error(a: Column, b: Column) -> Column:
    """Insertions and deletions between two texts."""
    return F.length(a) + F.length(b) - 2 * lcs(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """0 to 100: common characters of both texts; two empty texts are 0, so that an empty name finds none."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 0.0).otherwise(200.0 * lcs(a, b) / F.greatest(total, F.lit(1)))


def lcs_rate(a: Column, b: Column, principal: int | None = None, common: Column | None = None) -> Column:
    """(rate, error): common characters by those of text 1, text 2 or both; an empty principal text is matched.

    error is what both texts have beyond them. Two empty texts without a principal have no rate. common is lcs(a, b) where
    a column already holds it.
    """
    n, m, common = F.length(a), F.length(b), lcs(a, b) if common is None else common
    size = {1: n, 2: m}.get(principal, n + m)
    rate = F.when(size > 0, (1.0 if principal else 2.0) * common / F.greatest(size, F.lit(1)))
    error = n + m - 2 * common
    if principal:
        rate, error = F.coalesce(rate, F.lit(1.0)), F.when(size == 0, 0).otherwise(error)
    return F.struct(rate.cast("double").alias("rate"), error.cast("int").alias("error"))


def word_similarity(a: Column, b: Column) -> Column:
    """Mean over the words of the text that has fewer (the second of equals) of the best rate with a word of the other."""
    x, y = F.split(F.lower(a), " ", -1), F.split(F.lower(b), " ", -1)
    first = F.size(x) < F.size(y)
    few, many = F.when(first, x).otherwise(y), F.when(first, y).otherwise(x)

    def best(w: Column) -> Column:
        return F.array_max(F.transform(many, lambda v: F.coalesce(lcs_rate(w, v)["rate"], F.lit(0.0))))

    return F.aggregate(few, F.lit(0.0), lambda acc, w: acc + best(w)) / F.size(few)


def capped_rate(a: Column, b: Column, common: Column | None = None, by_first: bool = True) -> Column:
    """Common characters by those of one text (0 if it is empty); only equal texts reach 1, full ones end at 0.999."""
    size = F.length(a) if by_first else F.length(b)
    rate = F.when(size == 0, 0.0).otherwise((lcs(a, b) if common is None else common) / F.greatest(size, F.lit(1)))
    return F.when(a == b, 1.0).when(rate == 1, 0.999).otherwise(rate)


def block_rate_of(expected: str, got: str) -> float:
    """Characters in matching blocks by those expected; what is full but unequal stays just under 1."""
    want, have = expected.replace("\n", " "), got.replace("\n", " ")
    if want == have:
        return 1.0
    common = sum(block.size for block in difflib.SequenceMatcher(None, want, have).get_matching_blocks())
    if want and common < len(want):
        return common / len(want)
    bare_want, bare_have = want.replace(" ", ""), have.replace(" ", "")
    extra = len(want) + len(have) - 2 * common
    return 0.9998 if bare_want == bare_have else 0.9997 if extra <= 2 else 0.9996 if bare_want in bare_have else 0.9995


@F.pandas_udf(DoubleType())
def block_rate(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """block_rate_of in Arrow batches: matching blocks depend on one another, so there is no columnar form."""
    for expected, got in pairs:
        yield pd.Series([block_rate_of(e or "", g or "") for e, g in zip(expected, got)])


def match_label(rate: Column) -> Column:
    """How a rate is called: equal, full, high, half, low, none."""
    return F.when(rate == 1, "equal").when(rate >= 0.9995, "full").when(rate >= 0.75, "high").when(rate >= 0.5, "half").when(rate >= 0.125, "low").otherwise("none")
