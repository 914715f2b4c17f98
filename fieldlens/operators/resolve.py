"""Nearest names: cities, issuers and headers that a misread text most likely means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.functions.similarity import indel_error, indel_ratio, word_similarity
from fieldlens.functions.text import fold, fold_strict

#: Names up to which a list is broadcast; a plain join beyond.
NAMES_BROADCAST = 200_000

# Large cities and what of their name tells them.
SPECIAL = {
    "sao paulo sp": ("paulo",),
    "rio de janeiro rj": ("janeiro", "rio de"),
    "belo horizonte mg": ("horizonte",),
    "brasilia df": ("distrito", "federal", "brasilia"),
    "curitiba pr": ("curitiba",),
    "florianopolis sc": ("florianopolis",),
    "porto alegre rs": ("alegre rs",),
    "fortaleza ce": ("fortaleza",),
}


def squeezed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, " +", " "))


def _small(names: DataFrame, bounded: bool = False) -> DataFrame:
    """A list that every text is compared with, broadcast. Longer lists than NAMES_BROADCAST are joined by length where an
    error is bounded, and refused where none is: each text with each name would grow with the square of the data."""
    if names.count() <= NAMES_BROADCAST:
        return F.broadcast(names)
    if bounded:
        return names
    raise ValueError(f"a list of more than {NAMES_BROADCAST} names needs a largest error")


def nearest(inputs: DataFrame, names: DataFrame, text: str = "text", name: str = "name", max_error: int | None = None) -> DataFrame:
    """(text, best, score, error) of each distinct text: least error, then largest score, then the list's order (pos).

    Texts that are in the list join it by equality; only the rest are compared, each once, with names whose length alone
    does not exceed max_error. Without a name in reach best is null.
    """
    texts = inputs.select(F.col(text).alias("text")).where("text is not null").distinct()
    listed = names.select(F.col(name).alias("name"), "pos")
    exact = listed.where(F.length("name") > 0).groupBy(F.col("name").alias("text")).agg(F.min("pos").alias("pos"))
    same = texts.join(exact, "text").select("text", F.col("text").alias("best"), F.lit(100.0).alias("score"), F.lit(0).alias("error"))
    others = texts.join(exact, "text", "left_anti")
    gap = F.abs(F.length("text") - F.length("name"))
    within = gap <= max_error if max_error is not None else F.lit(True)
    names_held = _small(listed, max_error is not None)
    if max_error is not None and names_held is listed:  # too long a list to ship: names meet texts by their length
        lengths = F.sequence(F.length("text") - max_error, F.length("text") + max_error)
        within = F.length("name") == F.col("_length")
        others = others.withColumn("_length", F.explode(lengths))
    compared = others.join(names_held, within).drop("_length")
    compared = compared.withColumn("error", indel_error(F.col("text"), F.col("name"))).withColumn("score", indel_ratio(F.col("text"), F.col("name")))
    good = F.col("score") >= 0.25 if max_error is None else F.col("error") <= max_error
    best = F.min_by(F.struct("name", "score", "error"), F.struct("error", -F.col("score"), "pos"))
    found = compared.where(good).groupBy("text").agg(best.alias("b")).select("text", F.col("b.name").alias("best"), F.col("b.score").alias("score"), F.col("b.error").alias("error"))
    missed = others.join(found.select("text"), "text", "left_anti").select("text", F.lit(None).cast("string").alias("best"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("error"))
    return same.unionByName(found).unionByName(missed)


def issuers(inputs: DataFrame, codes: DataFrame, text: str = "text") -> DataFrame:
    """(text, issuer): the nearest code within an error of 4, else the text itself."""
    found = nearest(inputs, codes, text, "code", max_error=4)
    return found.select("text", F.coalesce("best", "text").alias("issuer"))


def issuer_codes(codes: DataFrame, states: DataFrame) -> DataFrame:
    """codes (pos, code) and, after them, each with each state: state ex only with codes that end in ex, the rest with the others."""
    pairs = codes.join(_small(states.select("uf", F.col("pos").alias("uf_pos"))), F.col("code").endswith("ex") == (F.col("uf") == "ex"))
    first = codes.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))
    numbered = pairs.crossJoin(F.broadcast(first)).select(
        (F.col("last") + F.row_number().over(Window.orderBy("pos", "uf_pos"))).cast("int").alias("pos"), F.concat("code", "uf").alias("code")
    )
    return codes.select(F.col("pos").cast("int"), "code").unionByName(numbered)


def special_city(text: Column, special: dict[str, tuple[str, ...]] = SPECIAL) -> Column:
    """The one large city whose marks are in a folded text, null if none or several are."""
    hits = F.array_compact(F.array(*[F.when(F.greatest(*[text.contains(m).cast("int") for m in marks], F.lit(0)) > 0, F.lit(city)) for city, marks in special.items()]))
    return F.when(F.size(hits) == 1, F.get(hits, 0))


def city_label(city_uf: Column) -> Column:
    """NAME, UF; both spellings of the capital are one."""
    s = F.upper(city_uf)
    out = F.concat(F.substring(s, F.lit(1), F.length(s) - 3), F.lit(","), F.right(s, F.lit(3)))
    return F.when(out.isin("BRASILIA, DF", "BRASILIA DISTRITO FEDERAL, DF"), "BRASILIA-DISTRITO FEDERAL, DF").otherwise(out)


def cities(inputs: DataFrame, towns: DataFrame, states: DataFrame, text: str = "text", special: dict[str, tuple[str, ...]] = SPECIAL) -> DataFrame:
    """(text, city) of each distinct text: the nearest of a town list (pos, city_uf), formatted.

    A town is compared as "name uf", "name" and "name state"; its best score counts. A large city's mark decides if the
    city is then no farther. Without any town the text is trimmed and upper-cased.
    """
    texts = inputs.select(F.col(text).alias("text")).where("text is not null").distinct()
    texts = texts.withColumn("plain", squeezed(fold_strict(F.col("text"))))
    plain = texts.select("plain").distinct()
    named = towns.join(_small(states.select("uf", F.col("name").alias("state")), True), F.right("city_uf", F.lit(2)) == F.col("uf"), "left")
    town = F.substring("city_uf", F.lit(1), F.greatest(F.length("city_uf") - 3, F.lit(0)))
    forms = named.select("pos", "city_uf", F.posexplode(F.array("city_uf", town, F.concat_ws(" ", town, F.coalesce("state", F.lit(""))))).alias("form", "name"))
    exact = forms.join(plain, forms["name"] == plain["plain"]).where("plain <> ''").groupBy("plain").agg(F.min_by("city_uf", "pos").alias("best"))
    exact = exact.withColumn("score", F.lit(100.0)).withColumn("error", F.lit(0))
    others = plain.join(exact, "plain", "left_anti")
    compared = others.crossJoin(_small(forms)).withColumn("score", indel_ratio(F.col("plain"), F.col("name"))).withColumn("error", indel_error(F.col("plain"), F.col("name")))
    per_town = compared.groupBy("plain", "pos", "city_uf").agg(F.max_by(F.struct("score", "error"), F.struct("score", -F.col("form"))).alias("f"))
    best = F.min_by(F.struct(F.col("city_uf").alias("best"), "f.score", "f.error"), F.struct("f.error", -F.col("f.score"), "pos")).alias("b")
    found = per_town.where(F.col("f.score") >= 0.25).groupBy("plain").agg(best).select("plain", "b.*")
    found = exact.unionByName(found)
    cue = special_city(F.col("plain"), special)
    marked = texts.join(found, "plain", "left").withColumn("cue", cue)
    nearer = (F.col("score") < 100) & F.col("cue").isNotNull() & ((F.col("score") <= indel_ratio(F.col("cue"), F.col("plain"))) | (F.col("error") >= indel_error(F.col("cue"), F.col("plain"))))
    chosen = F.when(nearer, F.col("cue")).otherwise(F.col("best"))
    return marked.select("text", F.coalesce(city_label(chosen), F.upper(F.trim("text"))).alias("city"))


def headers(inputs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """(text, header) of each distinct text, by a cascade over known headers (pos, header, detail1, detail2).

    By falling similarity of detail1 the list is cut below 0.95 if its first reaches that, else below 0.85 (not if none or
    all reach it); then so by detail2; of what is left the largest score wins if it is 70 or alone; else the folded text.
    """
    texts = inputs.select(F.col(text).alias("text")).where("text is not null").distinct()
    texts = texts.withColumn("plain", F.lower(squeezed(fold(F.col("text")))))
    pairs = texts.select("plain").distinct().join(_small(known.select("pos", *[F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("header", "detail1", "detail2")])))
    for d in ("detail1", "detail2"):
        pairs = pairs.withColumn(f"_{d}", F.when(F.col(d) != "", word_similarity(F.col("plain"), F.col(d))).otherwise(0.0))
    pairs = pairs.withColumn("score", indel_ratio(F.col("plain"), F.col("header")))
    w = Window.partitionBy("plain")
    for d in ("_detail1", "_detail2"):
        top = F.max(d).over(w)
        limit = F.when(top >= 0.95, 0.95).otherwise(0.85)
        pairs = pairs.withColumn("_keep", (F.col(d) >= limit) | (top < 0.85)).where("_keep")
    order = F.struct(F.col("score"), F.col("_detail2"), F.col("_detail1"), -F.col("pos"))
    best = pairs.groupBy("plain").agg(F.max_by(F.struct("header", "score"), order).alias("b"), F.count("*").alias("n"))
    chosen = F.when((F.col("b.score") >= 70) | (F.col("n") == 1), F.col("b.header")).otherwise(F.col("plain"))
    return texts.join(best, "plain", "left").select("text", F.upper(F.coalesce(chosen, "plain")).alias("header"))


def only_row(rows: DataFrame, condition: Column) -> DataFrame:
    """The one row that meets a condition; none or several stop the query with an error where it runs."""
    found = rows.where(condition).limit(2)  # two rows are enough to tell
    held = found.agg(F.collect_list(F.struct(*rows.columns)).alias("_rows"))
    checked = held.where(F.assert_true(F.size("_rows") == 1, "not exactly one row meets the condition").isNull())
    return checked.select(F.explode("_rows").alias("_row")).select("_row.*")


def one_random(rows: DataFrame, seed: int = 0) -> DataFrame:
    """A row drawn evenly: the least of seeded random numbers, found in each partition first."""
    return rows.withColumn("_r", F.rand(seed)).orderBy("_r").limit(1).drop("_r")


def combined(items: Column, k: int) -> Column:
    """All combinations of k items of an array, in order."""
    out = F.transform(F.sequence(F.lit(0), F.size(items) - 1), lambda i: F.array(i))
    n = F.size(items)
    for _ in range(k - 1):
        out = F.flatten(F.transform(out, lambda c: F.when(F.element_at(c, -1) + 1 <= n - 1, F.transform(F.sequence(F.element_at(c, -1) + 1, n - 1), lambda j: F.concat(c, F.array(j)))).otherwise(F.array().cast("array<array<int>>"))))
    return F.transform(out, lambda c: F.transform(c, lambda i: F.get(items, i)))
