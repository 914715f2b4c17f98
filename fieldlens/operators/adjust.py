"""The whole correction of field text: spell, characters, special rule, fold and upper-case, by the field's class."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.checks import category_field, cpf_field
from fieldlens.functions.text import collapse, final_adjust, keep_chars, recognised_date
from fieldlens.operators import resolve, spell
from fieldlens.operators.classify import route

#: Letters, accented ones, apostrophe, space and line end: what a name may hold.
NAME_CHARS = "A-Za-zÀ-ÖØ-öø-ÿ' \n"
# Printed titles by the beginning of a field's name, and the capital letters that a name keeps.
TITLES = {
    "nome": ("NOME",),
    "filiacao": ("FILIACAO",),
    "identidade": ("DOC", "IDENTIDADE", "ORG", "EMISSOR", "UF"),
    "registro_geral": ("REGISTRO", "GERAL"),
    "local_emissao": ("LOCAL",),
    "naturalidade": ("NATURALIDADE",),
    "observacao": ("OBSERVACOES",),
    "categoria": ("CAT", "HAB"),
}
_NOT_OF_NAMES = re.compile("[^ABCDEFGHIJKLMNOPQRSTUVWXYZÇÑÁÉÍÓÚÀÈÌÒÙÃÕÂÊÎÔÛÄËÏÖÜ' \n]")


def titles_of(field: str) -> tuple[str, ...]:
    return next((titles for start, titles in TITLES.items() if field.startswith(start)), ())


def native_adjust(fields: DataFrame) -> DataFrame:
    """(…, kind, adjusted) of (family, obj_name, ocr_text) for the classes whose rules are column expressions.

    Names keep their characters, numbers their digits, dates, numbers of persons and categories their special rule;
    cities, headers and identities stay as read: adjust() resolves them. Everything is then folded and upper-cased line by
    line. Non-value fields are empty.
    """
    kind = route(F.col("family"), F.lower("obj_name"))
    return fields.withColumn("kind", kind).withColumn("adjusted", final_adjust(_by_rule(F.coalesce("ocr_text", F.lit("")))))


def _by_rule(text):
    kind = F.col("kind")
    digits = F.replace(keep_chars(text, "0-9 "), F.lit(" "), F.lit(""))
    return (
        F.when(kind == "non_value", "")
        .when(kind.isin("name", "filiation"), F.trim(collapse(keep_chars(text, NAME_CHARS))))
        .when(kind == "numeric", digits)
        .when(kind == "cpf", cpf_field(text))
        .when(kind == "date", recognised_date(text))
        .when(kind == "category", category_field(text))
        .otherwise(text)
    )


def two_parents(text: str) -> list[str]:
    """The first two lines of a parents' field; more are dropped."""
    return text.split("\n")[:2]


def spelled(kind: str, field: str, text: str, speller: spell.Speller) -> str:
    """The spelling half of a class's correction; classes without one give the text."""
    titles = titles_of(field)
    if kind == "filiation" and "\n" in text:
        return "\n".join(spelled("name", field, line, speller) for line in two_parents(text))
    if kind in ("name", "filiation"):
        plain = spell.adjusted(text, speller, correct=False, strip_short=True, titles=titles)
        return spell.adjusted(re.sub(" +", " ", _NOT_OF_NAMES.sub("", plain).strip()), speller)
    if kind == "identity":
        return spell.adjusted(text, speller, correct=False, strip_short=True, numeric_first=True, titles=titles)
    if kind in ("city", "header", "multiline"):
        return spell.adjusted(text, speller, correct=False, titles=titles)
    return text


def adjust(fields: DataFrame, words: DataFrame, towns: DataFrame, states: DataFrame, issuers: DataFrame, headers: DataFrame, **city_options) -> DataFrame:
    """(…, kind, adjusted) of (family, obj_name, ocr_text): the whole correction of every class.

    Spelling comes first where a class has it, in Arrow batches with the dictionary of (word, count) shipped; then its
    characters and its special rule: names are spelled again with corrections, identities repaired with issuers (pos,
    code) and states (uf, name), cities resolved among towns (pos, city_uf) and headers among headers (pos, header,
    detail1, detail2), each distinct text once; the others by column expressions. Null text counts as empty.
    """
    rows = fields.withColumn("kind", route(F.col("family"), F.lower("obj_name")))
    shipped = fields.sparkSession.sparkContext.broadcast(spell.speller_of(words))
    codes = {r["code"]: r["pos"] for r in spell.listed(issuers.select("code", "pos"))}
    ufs = {r["uf"] for r in spell.listed(states.select("uf").distinct())}

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, names, texts in batches:
            out = []
            for kind, name, text in zip(kinds, names, texts):
                s = spelled(kind, name, text or "", shipped.value)
                out.append(spell.identity(s, codes, ufs) if kind == "identity" else s)
            yield pd.Series(out, dtype="object")

    rows = rows.withColumn("_s", run("kind", F.lower("obj_name"), F.coalesce("ocr_text", F.lit(""))))
    rows = rows.withColumn("_city", F.when(F.col("kind") == "city", F.col("_s"))).withColumn("_header", F.when(F.col("kind") == "header", F.col("_s")))
    found = resolve.cities(rows.select("_city").distinct(), towns, states, "_city", **city_options).toDF("_city", "_town")
    known = resolve.headers(rows.select("_header").distinct(), headers, "_header").toDF("_header", "_known")
    rows = rows.join(found, "_city", "left").join(known, "_header", "left")
    spelled_already = F.col("kind").isin("name", "filiation", "identity", "multiline")
    value = F.when(F.col("kind") == "city", F.col("_town")).when(F.col("kind") == "header", F.col("_known")).when(spelled_already, F.col("_s")).otherwise(_by_rule(F.col("_s")))
    return rows.withColumn("adjusted", final_adjust(value)).select(*fields.columns, "kind", "adjusted")
