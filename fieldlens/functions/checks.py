"""Check digits: CPF and CNPJ numbers, and what a field's text may hold of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlens.functions.text import collapse, keep_chars


def mod11(n: Column) -> Column:
    """0 if the remainder by 11 is below 2, else 11 less it."""
    r = F.pmod(n, F.lit(11))
    return F.when(r < 2, 0).otherwise(11 - r).cast("int")


def check_digit(s: Column, first: int, last: int, base: int) -> Column:
    """The digit for characters first to last (from 0): weights 2 to base run from the right. Not digits: empty."""
    part = F.substring(s, first + 1, last - first + 1)
    n = last - first + 1
    total = sum(((F.ascii(F.substring(part, n - y, 1)) - 48) * (y % (base - 1) + 2) for y in range(n)), F.lit(0))
    return F.when(part.rlike(f"^[0-9]{{{n}}}$"), mod11(total).cast("string")).otherwise("")


def _digits(s: Column) -> Column:
    return F.transform(F.split(s, ""), lambda c: F.ascii(c) - 48)


def _sums(d: Column, at: Column, length: int, base: int) -> Column:
    """Whether both last digits of the `length` digits from a place are right. The second check may read the first digit as
    it stands: where that is wrong, so is the number."""

    def right(n: int) -> Column:
        total = sum((F.get(d, at + (n - 1 - y)) * (y % (base - 1) + 2) for y in range(n)), F.lit(0))
        last = F.get(d, at + n)  # 11 less the remainder, so both add up to a multiple; 0 also for a remainder of 1
        return (F.pmod(total + last, F.lit(11)) == 0) | ((last == 0) & (F.pmod(total, F.lit(11)) == 1))

    return right(length - 2) & right(length - 1)


def _valid(s: Column, length: int, base: int) -> Column:
    held = F.transform(F.array(_digits(s)), lambda d: _sums(d, F.lit(0), length, base))
    return F.when(s.rlike(f"^[0-9]{{{length}}}$"), F.get(held, 0)).otherwise(False)


def cpf_valid(s: Column) -> Column:
    """11 digits with right check digits; numbers of one repeated digit pass."""
    return F.coalesce(_valid(s, 11, 11), F.lit(False))


def cnpj_valid(s: Column) -> Column:
    """14 digits with right check digits."""
    return F.coalesce(_valid(s, 14, 9), F.lit(False))


def find_cpfs(s: Column) -> Column:
    """Valid numbers among all stretches of 11 characters, each once, in order."""
    n = F.length(s)
    starts = F.when(n >= 11, F.sequence(F.lit(0), n - 11)).otherwise(F.array().cast("array<int>"))

    def numbers(d: Column) -> Column:
        good = F.filter(starts, lambda i: F.substring(s, i + 1, F.lit(11)).rlike("^[0-9]{11}$") & _sums(d, i, 11, 11))
        return F.array_distinct(F.transform(good, lambda i: F.substring(s, i + 1, F.lit(11))))

    found = F.get(F.transform(F.array(_digits(s)), numbers), 0)
    return F.when(s.rlike("[0-9]{11}"), found).when(s.isNotNull(), F.array().cast("array<string>"))


def cpf_field(s: Column) -> Column:
    """The first valid number in the text's digits and spaces, then in its digits alone, else these digits."""
    spaced = keep_chars(s, "0-9 ")
    digits = F.replace(spaced, F.lit(" "), F.lit(""))
    return F.coalesce(F.get(find_cpfs(spaced), 0), F.when(digits != spaced, F.get(find_cpfs(digits), 0)), digits)


# Licence categories.
CATEGORIES = "acc", "a", "a1", "b", "b1", "c", "c1", "d", "d1", "be", "ce", "c1e", "de", "d1e", "ab", "ad", "ae"


def category_field(s: Column) -> Column:
    """The last accepted category among the words, upper-cased; lower-case text is lost before it is looked at."""
    kept = collapse(F.trim(keep_chars(s, "A-Z0-9 ")))
    found = F.filter(F.split(F.lower(kept), " ", -1), lambda w: w.isin(*CATEGORIES))
    return F.upper(F.coalesce(F.element_at(F.when(F.size(found) > 0, found), -1), F.lit("")))
