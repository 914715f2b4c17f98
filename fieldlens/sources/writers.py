"""Writers: reports, ground truth, labels, dictionaries, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.geometry import printed_label


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object a line; types stay as the schema has them."""
    results.write.mode("overwrite").json(path)


def write_wide(wide: DataFrame, path: str) -> None:
    """The accuracy report: a row for a file, blank where a field is not expected."""
    wide.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_csv(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def run_log(rows: DataFrame) -> DataFrame:
    """(value) lines of (file, accuracy): semicolons between, decimal comma."""
    return rows.select(F.concat_ws(";", "file", F.translate(F.format_string("%.2f", F.col("accuracy") * 100), ".", ",")).alias("value"))


def truth_json(fields: Column, doc_type: Column) -> Column:
    """A sidecar's JSON: the type and the upper-cased fields, escaped as JSON needs it."""
    upper = F.transform_values(fields, lambda k, v: F.upper(F.coalesce(v, F.lit(""))))
    return F.to_json(F.map_concat(F.create_map(F.lit("tipo_doc"), doc_type), upper))


def edited_truth(fields: Column, doc_type: Column, always: dict[str, list[str]]) -> Column:
    """What an editor saves: empty fields are left out but for those its type always has; others has its type alone."""
    out = F.map_filter(fields, lambda k, v: F.coalesce(v, F.lit("")) != "")
    kept = F.lit(None).cast("map<string,string>")
    for kind, names in always.items():
        must = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n), F.lit("")) for n in names]), lambda e: ~F.map_contains_key(out, e["col1"]))) if names else F.create_map().cast("map<string,string>")
        kept = F.when(doc_type == kind, F.map_concat(out, must)).otherwise(kept)
    kept = F.when(doc_type == "outros", F.create_map().cast("map<string,string>")).otherwise(F.coalesce(kept, out))
    return F.map_concat(F.create_map(F.lit("tipo_doc"), doc_type), kept)


def label_lines(labels: DataFrame) -> DataFrame:
    """(file, text) of label files from (file, pos, cls, label)."""
    line = F.struct("pos", printed_label(F.col("cls"), F.col("label")).alias("text"))
    return labels.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda l: l["text"]), "\n").alias("text"))


def write_words(words: DataFrame, path: str) -> None:
    """A dictionary, by length and alphabet: range-partitioned, so its parts are in order and no task holds all of it."""
    words.orderBy(F.length("word"), "word").select("word").write.mode("overwrite").text(path)


def upload_keys(files: DataFrame, root: str) -> DataFrame:
    """(path, key): keys are paths relative to a root; files outside it are left out."""
    base = root.rstrip("/") + "/"
    return files.where(F.col("path").startswith(base)).select("path", F.substring("path", F.lit(len(base) + 1), F.length("path")).alias("key"))


def client_grid(rows: DataFrame) -> DataFrame:
    """(field, score %, match %, extracted, expected) as the client lists them."""
    return rows.select("field", F.bround(F.col("score") * 100, 2).alias("score"), F.bround(F.col("rate") * 100, 2).alias("match"), F.col("text").alias("extracted"), "expected")
