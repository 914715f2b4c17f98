"""Text and date columns: folding, cleaning, tokenising, canonical dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlens.functions.folding import fold_table


def fold_chars(extra: dict[str, str] | None = None) -> tuple[str, str]:
    """The characters that fold and what they become, as translate() takes them."""
    table = fold_table() | (extra or {})
    return "".join(table), "".join(table.values())


def fold(s: Column) -> Column:
    """Marked and look-alike letters to plain lower-case ones; tab, LF and CR to a space; plain capitals stay."""
    return F.translate(s, *fold_chars({"\t": " ", "\n": " ", "\r": " "}))


def fold_strict(s: Column) -> Column:
    """Folded, lower-cased, and everything but letters and the apostrophe a space."""
    return F.lower(F.regexp_replace(F.translate(s, *fold_chars()), "[^A-Za-z']", " "))


def collapse(s: Column) -> Column:
    """Runs of spaces to one; ends are not trimmed and tabs stay."""
    return F.regexp_replace(s, " {2,}", " ")


def keep_chars(s: Column, allowed: str) -> Column:
    """Only characters of a regex class body, such as "0-9/"."""
    return F.regexp_replace(s, f"[^{allowed}]", "")


def positions(s: Column, char: str, start: int = 0) -> Column:
    """Places (from 0) of a character, from start on."""
    n = F.length(s)
    places = F.when(n > start, F.sequence(F.lit(start), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.substring(s, i + 1, F.lit(1)) == char)


def phrases(s: Column, plain: bool = False) -> Column:
    """(words, separator) pairs: runs of letters, digits and spaces, then runs of anything but letters and digits.

    A words run gives its trailing spaces to the separator. Runs are found on the folded text and cut from the original
    (or from the folded text if plain); spaces in each collapse.
    """
    folded = fold(s)
    pattern = F.lit("(?s)((?:[A-Za-z0-9 ]*[A-Za-z0-9])?)([^A-Za-z0-9]*)")
    # the pieces are consecutive, so their lengths give their places
    pairs = F.zip_with(F.regexp_extract_all(folded, pattern, 1), F.regexp_extract_all(folded, pattern, 2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    source = folded if plain else s
    begun = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<words:string,separator:string>>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        n1, n2 = F.length(pair["a"]), F.length(pair["b"])
        piece = F.struct(collapse(F.substring(source, state["at"], n1)).alias("words"), collapse(F.substring(source, state["at"] + n1, n2)).alias("separator"))
        return F.struct((state["at"] + n1 + n2).alias("at"), F.when(n1 + n2 > 0, F.concat(state["out"], F.array(piece))).otherwise(state["out"]).alias("out"))

    return F.aggregate(pairs, begun, step)["out"]


def int_or(s: Column, default: Column | int) -> Column:
    return F.coalesce(s.try_cast("int"), default if isinstance(default, Column) else F.lit(default))


def clean_value(s: Column, allowed: str = "") -> Column:
    """As compared in evaluation: folded, upper, only the allowed class (all if empty), collapsed, trimmed."""
    upper = F.upper(fold(s))
    return F.trim(collapse(keep_chars(upper, allowed) if allowed else upper))


#: Fields whose value is never cleaned: outer classes, photos, signatures and prints.
UNTOUCHED = r"^(cnh|cnh_frente|rg_frente|rg_verso|rg2_frente|rg2_verso)$|^(foto|assinatura|digital)"


def clean_field(field: Column, s: Column) -> Column:
    """clean_value by field: untouched ones as they are, cpf_ fields their digits, all others cleaned."""
    return F.when(field.rlike(UNTOUCHED), s).when(field.startswith("cpf_"), keep_chars(s, "0-9")).otherwise(clean_value(s))


def dictionary_word(s: Column) -> Column:
    """A dictionary's words: apostrophes joined or opened, folded, letters only, lower, collapsed, trimmed."""
    opened = F.replace(F.replace(F.replace(s, F.lit(" '"), F.lit(" ")), F.lit("' "), F.lit(" ")), F.lit("'"), F.lit("e "))
    return F.trim(collapse(F.lower(F.regexp_replace(fold(opened), "[^A-Za-z]", " "))))


def identity_tokens(s: Column) -> Column:
    """Single / or -, digit runs, a-z runs, runs of others; a caret takes the rest of the text with it."""
    return F.regexp_extract_all(fold(s), F.lit(r"(?s)([/-]|\d+|[a-z]+|[^0-9^a-z/-]+|\^.*)"), 1)


def drop_one_word_line(s: Column) -> Column:
    """Without a first line that has no space, if there are more lines."""
    return F.regexp_replace(s, r"^[^ \n]*\n", "")


def normal_ocr(s: Column) -> Column:
    """LF and CR to spaces, collapsed, trimmed."""
    return F.trim(collapse(F.translate(s, "\n\r", "  ")))


def final_adjust(s: Column) -> Column:
    """Each line folded and upper-cased."""
    return F.array_join(F.transform(F.split(s, "\n", -1), lambda line: F.upper(fold(line))), "\n")


def repeat_to(s: Column, length: int | None = None, times: int | None = None) -> Column:
    """The text over and over, cut at a length or so many times."""
    if length is None:
        return F.repeat(s, times or 1)
    return F.when(F.length(s) > 0, F.substring(F.repeat(s, F.ceil(F.lit(length) / F.greatest(F.length(s), F.lit(1))).cast("int")), F.lit(1), F.lit(length))).otherwise("")


def distinct_chars(s: Column) -> Column:
    """Each character once, in order of first use."""
    return F.array_join(F.array_distinct(F.split(s, "")), "")


def renamed(path: Column, ext: str | None = None, folder: str | None = None, name_suffix: str = "", ext_suffix: str = "") -> Column:
    """A path with another extension or folder, or with more at the end of its name or extension."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    stem, old = F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(base, r"(?<=.)(\.[^.]*)$", 1)
    where = F.lit(folder.rstrip("/") + "/") if folder is not None else F.regexp_extract(path, r"^(.*/)?", 1)
    return F.concat(where, stem, F.lit(name_suffix), F.lit(ext) if ext is not None else old, F.lit(ext_suffix))


# Words printed beside a field, by the field's prefix.
TITLES = {
    "nome": ["NOME"],
    "filiacao": ["FILIACAO"],
    "identidade": ["DOC", "IDENTIDADE", "ORG", "EMISSOR", "UF"],
    "registro_geral": ["REGISTRO", "GERAL"],
    "local_emissao": ["LOCAL"],
    "naturalidade": ["NATURALIDADE"],
    "observacao": ["OBSERVACOES"],
    "categoria": ["CAT", "HAB"],
}


def title_words(field: Column, titles: dict[str, list[str]] = TITLES) -> Column:
    """The printed words to leave out of a field's text."""
    out = F.array().cast("array<string>")
    for prefix, words in reversed(titles.items()):
        out = F.when(field.startswith(prefix), F.array(*map(F.lit, words))).otherwise(out)
    return out


def console_clean(s: Column, comma: bool = True) -> Column:
    r"""LF as a literal \n, CR and tab as spaces, collapsed, only letters, digits, \ / . - space (and comma)."""
    flat = F.translate(F.replace(s, F.lit("\n"), F.lit("\\n")), "\r\t", "  ")
    return keep_chars(collapse(flat), r"A-Za-z0-9\\/" + ("," if comma else "") + r".\- ")


# --- dates -----------------------------------------------------------------------------------------------------------

# Month names as printed, each before its slash.
MONTHS = "jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"
_MASK = "[0-9]{2}/[0-9]{2}/[0-9]{4}"


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def slashes(digits: Column) -> Column:
    """Eight digits for a text of digits and slashes: its last three parts cut or filled to 2, 2 and 4, as dd/mm/yyyy."""
    return bound(digits, lambda d: bound(F.split(d, "/", -1), lambda parts: _eight(d, parts)))


def _eight(digits: Column, parts: Column) -> Column:
    n = F.size(parts)
    two = F.concat(F.lit("00"), F.right(F.concat(F.lit("00"), F.get(parts, n - 2)), F.lit(2)), F.right(F.concat(F.lit("0000"), F.get(parts, n - 1)), F.lit(4)))
    three = F.concat(F.right(F.concat(F.lit("00"), F.get(parts, n - 3)), F.lit(2)), F.substring(two, 3, 6))
    flat = F.when(n == 1, F.right(F.concat(F.lit("00000000"), digits), F.lit(8))).when(n == 2, two).otherwise(three)
    return bound(flat, lambda x: F.concat_ws("/", F.substring(x, 1, 2), F.substring(x, 3, 2), F.substring(x, 5, 4)))


def canonical_date(s: Column) -> Column:
    """dd/mm/yyyy of the digits and slashes in a text, filled with zeros."""
    return slashes(keep_chars(s, "0-9/"))


def is_canonical(s: Column) -> Column:
    """Whether canonical_date only had to format: three parts, or eight digits without a slash."""
    digits = keep_chars(s, "0-9/")
    return (F.size(F.split(digits, "/", -1)) >= 3) | digits.rlike("^[0-9]{8}$")


def strict_date(s: Column) -> Column:
    return F.try_to_date(s, "dd/MM/yyyy")


def recognised_date(s: Column, strict: bool = False) -> Column:
    """The date that a misread text most likely holds, as dd/mm/yyyy; strict: null where it is no calendar date.

    Month names before a slash, l and i for 1, - and . for slashes; then a full dd/mm/yyyy, three parts or eight digits
    count as they stand. Otherwise a 7 may have been a slash and a 4 a slash and a 1: the first of them is read so if
    there is one slash, the first two if there is none.
    """
    t = F.lower(s)
    for i, month in enumerate(MONTHS):
        t = F.replace(t, F.lit(month + "/"), F.lit(f"{i + 1:02}/"))
    digits = keep_chars(F.replace(F.translate(t, "li-.", "11//"), F.lit("//"), F.lit("/")), "0-9/")

    def opened(x: Column) -> Column:
        before = F.regexp_extract(x, "^([^47]*)([47])", 1)
        mark = F.regexp_extract(x, "^([^47]*)([47])", 2)
        return F.concat(before, F.when(mark == "7", "/").otherwise("/1"), F.substring(x, F.length(before) + 2, F.length(x)))

    def chosen(x: Column) -> Column:
        n = F.length(x) - F.length(F.translate(x, "/", ""))
        marks = F.length(x) - F.length(F.translate(x, "47", ""))
        stands = x.rlike(_MASK) | (n >= 2) | ((n == 0) & (F.length(x) == 8))
        return F.when(stands, x).when((n == 1) & (marks >= 1), opened(x)).when((n == 0) & (marks >= 2), bound(opened(x), opened)).otherwise(x)

    def read(x: Column) -> Column:
        return F.when(x.rlike(_MASK), F.regexp_extract(x, _MASK, 0)).otherwise(slashes(x))

    out = bound(bound(digits, chosen), read)
    return bound(out, lambda x: F.when(strict_date(x).isNotNull(), x)) if strict else out


def rounded_year(year: Column, as_of: Column | int, digits: int = 2) -> Column:
    """The year of two or three digits that lies nearest to as_of; others stay."""
    if digits not in (2, 3):
        return year
    span = 10**digits
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    off = year + F.floor(now / span) * span - now
    return (now + F.when(off < -(span // 2), off + span).when(off >= span // 2, off - span).otherwise(off)).cast("int")


def date_parts(year: Column, month: Column, day: Column | None, as_of_year: Column | int) -> Column:
    """(year, month, day) as numbers: a bad month or day is 0, a bad year that of as_of."""
    return F.struct(int_or(year, as_of_year).alias("year"), int_or(month, 0).alias("month"), (F.lit(0) if day is None else int_or(day, 0)).alias("day"))


def now_text(ts: Column | None = None, pattern: str | None = None) -> Column:
    """A time as text, to the second or by a pattern; without a time, that of the query."""
    return F.date_format(F.current_timestamp() if ts is None else ts, pattern or "yyyy-MM-dd HH:mm:ss")


def stamp(ts: Column) -> Column:
    """Date and time as they stand in file names: yyyyMMdd and HHmmss_micros."""
    return F.concat_ws("/", F.date_format(ts, "yyyyMMdd"), F.date_format(ts, "HHmmss_SSSSSS"))
