"""Queries over reports, requests, labels and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.functions import geometry
from fieldlens.operators import boxes, classify, evaluate, metrics, resolve
from fieldlens.plans.document_queries import _DET, _EXP, _ROWS, _detections, _expected, _matched
from fieldlens.plans.registry import lcs_cte, query, table
from fieldlens.sources import readers, writers


@query(f"SELECT file, array_to_string(list_sort(list(DISTINCT obj_name)), ',') AS names FROM {_DET} GROUP BY 1")
def detected_names(spark, d):
    rows = _detections(spark, d).withColumnRenamed("obj_name", "field")
    return evaluate.detected_names(rows).select("file", F.array_join("names", ",").alias("names"))


@query(f"SELECT file, round(avg(h), 6) AS height FROM {_DET} WHERE NOT starts_with(obj_name, 'filiacao') GROUP BY 1")
def field_height(spark, d):
    rows = _detections(spark, d).withColumnRenamed("h", "height")
    return metrics.mean_field_height(rows).select("file", F.round("height", 6).alias("height"))


@query(f"SELECT file, round(avg(rate)::DOUBLE * 100, 6) AS match FROM {_ROWS} WHERE text IS NOT NULL GROUP BY 1")
def client_match(spark, d):
    return evaluate.client_report(_matched(spark, d)).select("file", F.round("match", 6).alias("match"))


@query(f"WITH f AS (SELECT file, sum(rate)::DOUBLE / count(DISTINCT field) AS a FROM {_ROWS} GROUP BY 1) SELECT file || ';' || replace(printf('%.2f', a * 100), '.', ',') AS value FROM f")
def run_log(spark, d):
    return writers.run_log(evaluate.file_accuracy(_matched(spark, d)).withColumn("file", F.col("file").cast("string")))


@query("""
WITH s AS (SELECT event_type AS name, 'events of a kind' AS help, count(*)::DOUBLE AS n FROM events GROUP BY 1)
SELECT name, '# HELP ' || name || ' ' || help || chr(10) || '# TYPE ' || name || ' summary' || chr(10) || name || '_count ' || printf('%.1f', n) || chr(10) || name || '_sum ' || printf('%.1f', n * 2) AS text FROM s""")
def exposition(spark, d):
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("count"))
    return metrics.exposition(n.withColumn("help", F.lit("events of a kind")).withColumn("sum", F.col("count") * 2))


@query("""
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""")
def json_values(spark, d):
    return table(spark, d, "events").select("event_id", readers.json_value(F.col("props"), "$.k", -1, "int").alias("k"), readers.json_value(F.col("props"), "$.missing", "none").alias("missing"))


@query("""
SELECT s_suppkey, length(n) > 0 AND length(n) <= 255 AND (NOT ends_with(n, '.') OR len(list_filter(string_split(regexp_replace(n, '\\.$', ''), '.'), lambda l: NOT (regexp_matches(l, '^[A-Za-z0-9-]{1,63}$')
  AND NOT starts_with(l, '-') AND NOT ends_with(l, '-')))) = 0) AS valid
FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_name WHEN 1 THEN lower(replace(s_name, '#', '-')) || '.org.' WHEN 2 THEN '-a.b.' ELSE s_name || '.' END AS n FROM supplier)""")
def host_names(spark, d):
    k = F.col("s_suppkey") % 4
    n = F.when(k == 0, F.col("s_name")).when(k == 1, F.concat(F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".org."))).when(k == 2, "-a.b.").otherwise(F.concat("s_name", F.lit(".")))
    return table(spark, d, "supplier").select("s_suppkey", classify.host_valid(n).alias("valid"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey > 450 AND l_partkey <= 1800 THEN l_partkey::INT ELSE 800 END AS resize, CASE WHEN l_linenumber = 1 THEN l_suppkey::INT ELSE 1 END AS rotate, 48 AS crop_height FROM lineitem""")
def request_params(spark, d):
    p = F.col("l_partkey").cast("string")
    headers = F.map_filter(F.create_map(F.lit("resize"), p, F.lit("rotate"), F.when(F.col("l_linenumber") == 1, F.col("l_suppkey").cast("string"))), lambda k, v: v.isNotNull())
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", readers.request_params(headers).alias("p")).select("l_orderkey", "l_linenumber", "p.resize", "p.rotate", "p.crop_height")


@query(f"""
WITH l AS (SELECT file, pos, printf('%d %.8f %.8f %.8f %.8f', class_index, (x + w / 2.0) / 100, (y + h / 2.0) / 300, w / 100.0, h / 300.0) AS line FROM {_DET})
SELECT file, string_agg(line, chr(10) ORDER BY pos, line) AS text FROM l GROUP BY 1""")
def label_lines(spark, d):
    rows = _detections(spark, d).select("file", "pos", F.col("class_index").alias("cls"), geometry.normalised(geometry.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")), 100.0, 300.0).alias("label"))
    return writers.label_lines(rows)


@query(f"""
SELECT file, pos, least(x, y) AS x1, least(y, x) AS y1, greatest(x + w, y + w) AS x2, least(greatest(y + h, 0), 200) AS crop_y2, trunc(w * 1.5)::INT AS scaled_w, greatest(w / 100.0 - 0.5, 0)::DOUBLE AS nudged_w FROM {_DET}""")
def rectangles(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")

    def rect(a, b, c, e):
        return F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), e.alias("y2"))

    u = geometry.united(rect(x, y, x + w, y + h), rect(y, x, y + w, x + h), 10_000, 10_000)
    c = geometry.crop(rect(x, y, x + w, y + h), 200, 200)
    n = geometry.nudged(geometry.normalised(geometry.box(x, y, w, h), 100.0, 300.0), dw=-0.5)
    return _detections(spark, d).select("file", "pos", u["x1"].alias("x1"), u["y1"].alias("y1"), u["x2"].alias("x2"), c["y2"].alias("crop_y2"), geometry.scaled(geometry.box(x, y, w, h), 1.5)["width"].alias("scaled_w"), n["w"].alias("nudged_w"))


@query(f"""
WITH b AS (SELECT file, y AS y1, y + h AS y2, y + h // 2 AS m FROM {_DET}), n AS (SELECT file, max(y2 + 2) FILTER (m < 150) AS up, min(y1 - 2) FILTER (m >= 150) AS down FROM b GROUP BY 1)
SELECT file, CASE WHEN up IS NULL AND down IS NULL THEN 150 WHEN up IS NULL THEN down WHEN down IS NULL THEN up WHEN down > up AND NOT abs(up - 150) < abs(down - 150) THEN down ELSE up END AS upper_end,
  CASE WHEN up IS NULL AND down IS NULL THEN 150 WHEN down IS NULL THEN up WHEN up IS NULL THEN down WHEN down > up AND abs(up - 150) < abs(down - 150) THEN up ELSE down END AS lower_start FROM n""")
def half_cuts(spark, d):
    rows = _detections(spark, d)
    bands = rows.select("file", F.col("y").alias("y1"), (F.col("y") + F.col("h")).alias("y2"), (F.col("y") + F.floor(F.col("h") / 2)).cast("int").alias("middle"))
    return boxes.half_cuts(bands, rows.select("file", F.lit(300).alias("height")).distinct())


@query(f"""
SELECT file, min(y) FILTER (obj_name IN ('nome_cnh', 'foto_cnh')) AS front_top, max(y + h) FILTER (obj_name IN ('nome_cnh', 'foto_cnh')) AS front_bottom,
  min(y) FILTER (obj_name = 'local_emissao_cnh') AS back_top, max(y + h) FILTER (obj_name = 'local_emissao_cnh') AS back_bottom FROM {_DET} GROUP BY 1""")
def side_spans(spark, d):
    rows = _detections(spark, d).withColumnRenamed("y", "y_min").withColumnRenamed("h", "height")
    return boxes.side_spans(rows, ["nome_cnh", "foto_cnh"], ["local_emissao_cnh"])


@query(f"SELECT file, max(w * h) AS area, arg_max(pos, w * h * 1000 - pos) AS pos FROM {_DET} GROUP BY 1")
def largest_box(spark, d):
    rows = _detections(spark, d).withColumn("area", F.col("w") * F.col("h"))
    return boxes.largest(rows, "file", "area", ["pos", "area"]).select("file", "area", "pos")


@query("""
SELECT n_nationkey, list_aggregate(list_transform(range(1, 4), lambda i: list_aggregate(list_transform(range(i + 1, 5), lambda j: substr(n_name, i, 1) || substr(n_name, j, 1)), 'string_agg', ',')), 'string_agg', ',') AS pairs FROM nation""")
def combinations(spark, d):
    letters = F.split(F.substring("n_name", 1, 4), "")
    pairs = F.transform(resolve.combined(letters, 2), lambda c: F.array_join(c, ""))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(pairs, ",").alias("pairs"))


@query("""
SELECT n_nationkey, array_to_string(flatten(list_transform(range(1, length(n_name)), lambda i: list_transform(range(i + 1, length(n_name) + 1), lambda j: substr(n_name, i, 1) || substr(n_name, j, 1)))), ',') AS pairs FROM nation""")
def combinations_whole(spark, d):
    """Letter pairs of the whole name."""
    pairs = F.transform(resolve.combined(F.split("n_name", ""), 2), lambda c: F.array_join(c, ""))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(pairs, ",").alias("pairs"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def single_lookup(spark, d):
    return resolve.only_row(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == 7)


@query("SELECT DISTINCT r_name AS kind FROM region UNION SELECT DISTINCT source FROM documents")
def union_of_kinds(spark, d):
    return table(spark, d, "region").select(F.col("r_name").alias("kind")).union(table(spark, d, "documents").select("source")).distinct()


@query(f"""
WITH RECURSIVE q AS (SELECT file, 'nome_' || field AS field, expected, replace(expected, 'o', '0') AS ocr, upper(expected) AS adjusted, row_number() OVER (ORDER BY file, field) AS k FROM {_EXP}),
r AS (SELECT * FROM q WHERE expected <> '' AND ocr <> adjusted),
{lcs_cte("SELECT 2 * k AS id, expected AS a, ocr AS b FROM r UNION ALL SELECT 2 * k + 1, expected, adjusted FROM r").replace("RECURSIVE ", "")},
e AS (SELECT id, length(a) + length(b) - 2 * lcs AS err, round(200.0 * lcs / (length(a) + length(b)), 6) AS rate FROM lcs)
SELECT file, field, o.rate AS rate_oe, o.err AS err_oe, x.rate AS rate_ae, x.err AS err_ae FROM r JOIN e o ON o.id = 2 * k JOIN e x ON x.id = 2 * k + 1""")
def correction_ledger(spark, d):
    e = _expected(spark, d).withColumn("field", F.concat(F.lit("nome_"), "field"))
    seen = e.select("file", "field", F.replace("expected", F.lit("o"), F.lit("0")).alias("ocr"), F.upper("expected").alias("adjusted"))
    return evaluate.ledger(seen, e).select("file", "field", F.round("rate_oe", 6).alias("rate_oe"), "err_oe", F.round("rate_ae", 6).alias("rate_ae"), "err_ae")


@query()
def adjusted_fields(spark, d):
    """The flagship correction over documents that stand for recognised text."""
    from fieldlens.operators.adjust import native_adjust

    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "cnh").otherwise("rg").alias("family"), F.element_at(F.array(*map(F.lit, ("nome_cnh", "cpf_rg", "nascimento_cnh", "registro_geral_rg"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("obj_name"), F.col("text").alias("ocr_text"))
    return native_adjust(rows).select("doc_id", "kind", F.md5("adjusted").alias("adjusted"))
