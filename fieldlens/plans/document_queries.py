"""Queries over detections, boxes, accuracy, names and times, derived from the tables at hand in either engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.functions import geometry
from fieldlens.operators import boxes, classify, evaluate, metrics, resolve, spell
from fieldlens.plans.registry import lcs_cte, query, quoted, table

# A detector's classes, in order.
CLASSES = (
    "foto_cnh nome_cnh identidade_cnh cpf_cnh nascimento_cnh filiacao_cnh registro_cnh validade_cnh pri_habilitacao_cnh local_emissao_cnh data_emissao_cnh cnh "
    "nome_rg foto_rg assinatura_rg digital_rg registro_geral_rg data_expedicao_rg filiacao_rg naturalidade_rg nascimento_rg doc_origem_rg cpf_rg rg_verso rg_frente "
    "cnh_frente categoria_cnh observacao_cnh rg2_frente rg2_verso foto_rg2 nome_rg2 filiacao_rg2 nascimento_rg2 naturalidade_rg2 cpf_rg2 registro_geral_rg2 cabecalho_rg cabecalho_rg2"
).split()
_CLASS_ROWS = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(n)})" for i, n in enumerate(CLASSES)) + ") AS c(class_index, obj_name))"
#: Orders stand for documents and their lines for detections; by order number, classes come from all or from one family.
_DET = f"""(SELECT l_orderkey AS file, (l_linenumber - 1)::INT AS pos, class_index, obj_name, l_quantity::INT AS x, (l_partkey % 300)::INT AS y, (l_suppkey % 90 + 10)::INT AS w, (l_partkey % 40 + 5)::INT AS h,
  l_discount * 10 AS score FROM lineitem JOIN {_CLASS_ROWS} c ON c.class_index = CASE l_orderkey % 3 WHEN 0 THEN l_partkey % 39 WHEN 1 THEN l_partkey % 12 ELSE 12 + l_partkey % 13 END)"""


def _detections(spark, d):
    classes = spark.createDataFrame(list(enumerate(CLASSES)), "class_index int, obj_name string")
    k, p = F.col("l_orderkey") % 3, F.col("l_partkey")
    index = F.when(k == 0, p % 39).when(k == 1, p % 12).otherwise(12 + p % 13).cast("int")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("file"), (F.col("l_linenumber") - 1).cast("int").alias("pos"), index.alias("class_index"), F.col("l_quantity").cast("int").alias("x"),
        (p % 300).cast("int").alias("y"), (F.col("l_suppkey") % 90 + 10).cast("int").alias("w"), (p % 40 + 5).cast("int").alias("h"), (F.col("l_discount") * 10).alias("score"),
    )
    return classify.named(rows, classes)


def _box():
    return geometry.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))


@query(f"SELECT obj_name, count(*) AS n FROM {_DET} GROUP BY 1")
def class_lookup(spark, d):
    return _detections(spark, d).groupBy("obj_name").agg(F.count("*").alias("n"))


def _family_sql(f: str) -> str:
    return f"bool_or(obj_name = '{f}') OR bool_and(regexp_matches(obj_name, '^{f}_|_{f}$'))"


@query(f"SELECT file, CASE WHEN {_family_sql('cnh')} THEN 'cnh' WHEN {_family_sql('rg')} THEN 'rg' WHEN {_family_sql('rg2')} THEN 'rg2' END AS family FROM {_DET} GROUP BY 1")
def doc_family(spark, d):
    return classify.families(_detections(spark, d))


@query(f"""
SELECT file, CASE WHEN sum(CASE WHEN NOT regexp_matches(obj_name, '_rg|^rg') AND regexp_matches(obj_name, '_cnh|^cnh') THEN 1 ELSE 0 END) > sum(CASE WHEN regexp_matches(obj_name, '_rg|^rg') THEN 1 ELSE 0 END)
  THEN 'cnh' ELSE 'rg' END AS kind FROM {_DET} GROUP BY 1""")
def doc_majority(spark, d):
    return classify.majority(_detections(spark, d))


@query(f"""
WITH n AS (SELECT file, count(DISTINCT obj_name) FILTER (obj_name IN ('cnh', 'cnh_frente')) AS cnh, count(DISTINCT obj_name) FILTER (regexp_matches(obj_name, '_cnh$') AND obj_name NOT LIKE 'foto%') AS cf,
  count(DISTINCT obj_name) FILTER (regexp_matches(obj_name, '_rg2?$') AND obj_name NOT LIKE 'foto%') AS rf, count(DISTINCT obj_name) FILTER (obj_name IN ('rg_frente', 'rg2_frente')) AS f,
  count(DISTINCT obj_name) FILTER (obj_name IN ('rg_verso', 'rg2_verso')) AS v FROM {_DET} GROUP BY 1),
k AS (SELECT file, cnh = 0 AND rf >= 1 AND f <= 1 AND v <= 1 AND f + v >= 1 AS rg, f + v = 0 AND cf >= 2 AND cnh = 1 AS c FROM n)
SELECT file, CASE WHEN rg AND NOT c THEN 'RG' WHEN c AND NOT rg THEN 'CNH' ELSE 'Outros' END AS kind FROM k""")
def doc_detected_kind(spark, d):
    return classify.detected_kind(_detections(spark, d))


@query(f"""
WITH n AS (SELECT file, coalesce(min(pos) FILTER (regexp_matches(obj_name, '^cnh|cnh$')), 99) AS c, coalesce(min(pos) FILTER (regexp_matches(obj_name, '^rg2|rg2$')), 99) AS r2,
  coalesce(min(pos) FILTER (NOT regexp_matches(obj_name, '^rg2|rg2$|^cnh|cnh$') AND regexp_matches(obj_name, '^rg|rg$')), 99) AS r,
  coalesce(min(pos) FILTER (obj_name IN ('local_emissao_cnh', 'data_emissao_cnh', 'observacao_cnh')), 99) AS b FROM {_DET} GROUP BY 1)
SELECT file, CASE WHEN c < least(r, r2) AND b < least(r, r2) THEN 'cnh' WHEN c < least(r, r2) THEN 'cnh_frente' WHEN r < r2 THEN 'rg' ELSE 'rg2' END AS kind FROM n""")
def doc_client_kind(spark, d):
    return classify.client_kind(_detections(spark, d))


_ROUTE = "CASE " + " ".join(f"WHEN family = '{f}' AND starts_with(obj_name, '{p}') THEN '{k}'" for f, p, k in classify.ROUTES) + " ELSE 'non_value' END"


@query(f"SELECT family, obj_name, {_ROUTE} AS kind, count(*) AS n FROM (SELECT *, CASE WHEN file % 2 = 0 THEN 'cnh' ELSE 'rg' END AS family FROM {_DET}) GROUP BY ALL")
def route_field(spark, d):
    rows = _detections(spark, d).withColumn("family", F.when(F.col("file") % 2 == 0, "cnh").otherwise("rg"))
    return rows.withColumn("kind", classify.route(F.col("family"), F.col("obj_name"))).groupBy("family", "obj_name", "kind").agg(F.count("*").alias("n"))


@query(f"""
SELECT file, pos, (CASE WHEN starts_with(obj_name, 'cnh') THEN 0 WHEN ends_with(obj_name, '_cnh') THEN 100 WHEN starts_with(obj_name, 'rg_') THEN 200 WHEN ends_with(obj_name, '_rg') THEN 300
  WHEN starts_with(obj_name, 'rg2_') THEN 400 ELSE 500 END + class_index)::INT AS sort_key FROM {_DET} WHERE score > 0.9""")
def detection_order(spark, d):
    rows = _detections(spark, d).where("score > 0.9")
    return rows.select("file", "pos", classify.sort_key(F.col("obj_name"), F.col("class_index")).alias("sort_key"))


@query(f"""
WITH o AS (SELECT *, coalesce(min(pos) FILTER (obj_name IN ('cnh', 'rg_frente', 'rg_verso')) OVER (PARTITION BY file), 0) AS a FROM {_DET})
SELECT file, pos, CASE WHEN pos = a THEN 0 WHEN pos = 0 THEN a ELSE pos END AS report_pos FROM o""")
def outer_first(spark, d):
    return classify.outer_first(_detections(spark, d)).select("file", "pos", "report_pos")


@query(f"SELECT file, obj_name FROM {_DET} WHERE obj_name IN ('cnh', 'cnh_frente', 'rg_frente', 'rg_verso', 'rg2_frente', 'rg2_verso')")
def outer_only(spark, d):
    return classify.outer_only(_detections(spark, d)).select("file", "obj_name")


@query(f"SELECT file, CASE WHEN count(*) FILTER (starts_with(obj_name, 'foto')) = 1 THEN max(pos) FILTER (starts_with(obj_name, 'foto')) END AS face FROM {_DET} GROUP BY 1")
def face_attach(spark, d):
    return classify.with_face(_detections(spark, d))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 1.0 * (l_partkey % 100) / 100 END AS quality_in,
  CASE WHEN l_suppkey * 9 < 300 AND l_partkey < 300 THEN 1 WHEN l_partkey < 450 THEN 2 ELSE 3 END AS bucket, CASE WHEN l_partkey >= 450 THEN 1.0 ELSE 0.0 END AS quality,
  array_to_string(list_filter([1, 2], lambda b: l_linenumber & b <> 0), ',') AS bits, CASE WHEN l_partkey > 450 AND l_partkey <= 1800 THEN l_partkey::INT ELSE 800 END AS width,
  CASE l_linenumber WHEN 1 THEN 404 WHEN 2 THEN 412 WHEN 3 THEN 400 ELSE 513 END AS status
FROM lineitem""")
def request_gates(spark, d):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    error = F.when(n == 1, "base64").when(n == 2, "quality").when(n == 3, "no_image").otherwise("other")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(p % 5 != 0, (p % 100) / 100.0).alias("quality_in"), classify.triage(p, F.col("l_suppkey") * 9).alias("bucket"),
        classify.quality(p).alias("quality"), F.array_join(classify.preproc_bits(n).cast("array<string>"), ",").alias("bits"), classify.width_param(p.cast("string")).alias("width"), classify.status(error).cast("int").alias("status"),
    )


@query("SELECT l_orderkey, l_linenumber, CASE WHEN greatest(l_discount * 10, l_tax * 12, 0.5) > 0.9 THEN CASE WHEN l_discount * 10 >= l_tax * 12 THEN 0 ELSE 1 END END AS best FROM lineitem")
def detection_threshold(spark, d):
    scores = F.array(F.col("l_discount") * 10, F.col("l_tax") * 12, F.lit(0.5))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", classify.detected(scores)["class_index"].alias("best"))


# --- geometry


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, trunc(l_discount * 640)::INT AS cx, trunc(l_tax * 480)::INT AS cy, trunc(l_quantity / 50 * 640)::INT AS w, trunc(l_quantity / 100 * 480)::INT AS h FROM lineitem)
SELECT l_orderkey, l_linenumber, trunc(cx - w / 2.0)::INT AS x_min, trunc(cy - h / 2.0)::INT AS y_min, w AS width, h AS height FROM b""")
def box_decode(spark, d):
    q = F.col("l_quantity")
    b = geometry.decoded(F.col("l_discount"), F.col("l_tax"), q / 50, q / 100, 640, 480)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", b.alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query(f"""
SELECT file, pos, greatest(x - 20, 0) AS cx, least(x - 20 + w, 60) - greatest(x - 20, 0) AS cw, greatest(y - 20, 0) AS cy, least(y - 20 + h, 200) - greatest(y - 20, 0) AS ch,
  CASE WHEN greatest(x - 20, 0) + w > 60 THEN 60 - greatest(x - 20, 0) ELSE w END AS tw, CASE WHEN greatest(y - 20, 0) + h > 200 THEN 200 - greatest(y - 20, 0) ELSE h END AS th FROM {_DET}""")
def box_clip(spark, d):
    b = geometry.box(F.col("x") - 20, F.col("y") - 20, F.col("w"), F.col("h"))
    rows = _detections(spark, d).select("file", "pos", geometry.clipped(b, 60, 200).alias("c"), geometry.trimmed(b, 60, 200).alias("t"))
    return rows.select("file", "pos", *[F.col(s).alias(n) for s, n in (("c.x_min", "cx"), ("c.width", "cw"), ("c.y_min", "cy"), ("c.height", "ch"), ("t.width", "tw"), ("t.height", "th"))])


@query(f"""
WITH n AS (SELECT file, pos, class_index, (x + w / 2.0) / 100 AS cx, (y + h / 2.0) / 300 AS cy, w / 100.0 AS lw, h / 300.0 AS lh FROM {_DET}),
r AS (SELECT *, cx - lw / 2 AS x1, cy - lh / 2 AS y1, cx + lw / 2 AS x2, cy + lh / 2 AS y2 FROM n)
SELECT file, pos, round(cx, 6) AS cx, round(cy, 6) AS cy, CASE WHEN x2 > 0 AND x1 < 1 AND y2 > 0 AND y1 < 1 THEN round(least(greatest(x1, 0), 1), 6) END AS x1,
  CASE WHEN x2 > 0 AND x1 < 1 AND y2 > 0 AND y1 < 1 THEN round(least(greatest(y2, 0), 1), 6) END AS y2,
  CASE WHEN trunc((cx - lw / 2) * 640) >= 0 THEN trunc(lw * 640)::INT END AS screen_w FROM r""")
def label_geometry(spark, d):
    rows = _detections(spark, d).select("file", "pos", geometry.normalised(_box(), 100.0, 300.0).alias("n"))
    rows = rows.withColumn("r", geometry.rect_of(F.col("n"), trim=True)).withColumn("s", geometry.screen_box(F.col("n"), 640, 480))
    return rows.select("file", "pos", F.round("n.cx", 6).alias("cx"), F.round("n.cy", 6).alias("cy"), F.round("r.x1", 6).alias("x1"), F.round("r.y2", 6).alias("y2"), F.col("s.width").alias("screen_w"))


_ANGLE = "degrees(atan2((l_partkey % 50 - 25)::DOUBLE, (l_suppkey % 40 - 20)::DOUBLE))"
_SNAP = "CASE WHEN abs(a) < 2 THEN 0 WHEN abs(a - 90) < 2 THEN 90 WHEN abs(a + 90) < 2 THEN -90 WHEN 180 - abs(a) < 2 THEN 180 ELSE a END"


@query(f"""
WITH a AS (SELECT l_orderkey, l_linenumber, {_ANGLE} AS raw FROM lineitem), m AS (SELECT *, CASE WHEN -raw <= -180 THEN -raw + 360 ELSE -raw END AS a FROM a), s AS (SELECT *, {_SNAP} AS s FROM m)
SELECT l_orderkey, l_linenumber, round(raw, 6) AS angle, round(CASE WHEN abs(s) < 2 THEN 0 ELSE s END, 6) AS turn,
  trunc(480 * abs(sin(radians(round(raw, 3)))) + 640 * abs(cos(radians(round(raw, 3)))))::INT AS canvas_w FROM s""")
def angles(spark, d):
    a = geometry.point_angle(F.lit(0), F.lit(0), F.col("l_suppkey") % 40 - 20, F.col("l_partkey") % 50 - 25)
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"))
    width = geometry.canvas(F.lit(640), F.lit(480), F.round("a", 3))["width"]
    return rows.select("l_orderkey", "l_linenumber", F.round("a", 6).alias("angle"), F.round(geometry.turn(F.col("a")), 6).alias("turn"), width.alias("canvas_w"))


@query(f"""
SELECT file, pos, (x + floor(w / 2.0))::INT AS centre,
  round(x - w * 0.4, 6) AS face_x, round(h + h * 0.55, 6) AS face_h, round(sqrt((x * x + y * y)::DOUBLE), 6) AS dist, (class_index * 70000) & 255 AS red,
  least(greatest(x + 30, 35), 60) AS clamped, CASE WHEN w * h <= 0 THEN '00' WHEN w * h >= 500 THEN '99' ELSE right('0' || (100 * w * h // 500)::VARCHAR, 2) END AS band FROM {_DET}""")
def box_arithmetic(spark, d):
    w, h, x, y = (F.col(c) for c in "whxy")
    face = geometry.padded_face(_box())
    return _detections(spark, d).select(
        "file", "pos", geometry.centre(x, w).alias("centre"),
        F.round(face["x_min"], 6).alias("face_x"), F.round(face["height"], 6).alias("face_h"), F.round(geometry.distance(F.lit(0), F.lit(0), x, y), 6).alias("dist"), geometry.rgb(F.col("class_index") * 70000)["r"].alias("red"),
        geometry.clamped_sum(x, F.lit(30), F.lit(35), F.lit(60)).alias("clamped"), geometry.percent_band(w * h, F.lit(500)).alias("band"),
    )


@query(f"""
WITH b AS (SELECT file, y AS y1, y + h AS y2 FROM {_DET}), m AS (SELECT *, max(y2) OVER (PARTITION BY file ORDER BY y1, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR y1 >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY y1, y2 ROWS UNBOUNDED PRECEDING) AS band FROM m)
SELECT file, min(y1) AS y1, max(y2) AS y2, ((min(y1) + max(y2)) // 2)::INT AS middle FROM n GROUP BY file, band""")
def y_bands(spark, d):
    return boxes.text_bands(_detections(spark, d).select("file", F.col("y").alias("y1"), (F.col("y") + F.col("h")).alias("y2")))


@query(f"""
WITH p AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{a}', '{b}')" for _, i, a, b in classify.alignment_pairs())}) AS p(ord, a, b)),
j AS (SELECT x.file, ord, x.x + x.w // 2 AS ax, x.y + x.h // 2 AS ay, y.x + y.w // 2 AS bx, y.y + y.h // 2 AS byy FROM {_DET} x JOIN p ON x.obj_name = p.a JOIN {_DET} y ON y.file = x.file AND y.obj_name = p.b),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ord, ax, ay, bx, byy) AS rn FROM j)
SELECT file, round(degrees(atan2((byy - ay)::DOUBLE, (bx - ax)::DOUBLE)), 6) AS angle FROM r WHERE rn = 1""")
def alignment_angle(spark, d):
    pairs = spark.createDataFrame(classify.alignment_pairs(), "family string, pair_order int, field_a string, field_b string")
    rows = _detections(spark, d).withColumn("family", F.lit("cnh")).withColumn("cx", geometry.centre(F.col("x"), F.col("w"))).withColumn("cy", geometry.centre(F.col("y"), F.col("h")))
    return classify.pair_angles(rows, pairs).select("file", F.round("angle", 6).alias("angle"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f}', {i}, '{a}', '{b}')" for f, i, a, b in classify.alignment_pairs()) + ") AS p(family, pair_order, field_a, field_b)")
def alignment_pairs(spark, d):
    return spark.createDataFrame(classify.alignment_pairs(), "family string, pair_order int, field_a string, field_b string")


@query(f"""
WITH b AS (SELECT file, x - 25 AS a, w + h AS s FROM {_DET} WHERE x <> 25), n AS (SELECT file, a, s, (round_even(a / 5.0, 0) * 5)::INT AS bin FROM b),
g AS (SELECT file, bin, sum(s) AS weight, median(a) AS m FROM n GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY weight DESC, bin) AS rn FROM g)
SELECT file, m::DOUBLE AS angle FROM r WHERE rn = 1""")
def dominant_angle(spark, d):
    rows = _detections(spark, d).select("file", (F.col("x") - 25).alias("angle"), "w", "h")
    return boxes.dominant_angle(rows)


@query(f"""
WITH n AS (SELECT file % 50 AS g, h, count(*) AS n FROM {_DET} GROUP BY ALL), f AS (SELECT g, h, row_number() OVER (PARTITION BY g ORDER BY n DESC, h) AS rn FROM n), a AS (SELECT g, h AS first FROM f WHERE rn = 1),
s AS (SELECT n.g, n.h, row_number() OVER (PARTITION BY n.g ORDER BY n.n DESC, n.h) AS rn FROM n JOIN a USING (g) WHERE abs(n.h - a.first) > 6)
SELECT a.g AS file, greatest(least(first, coalesce(s.h, first)) - 6, 0)::INT AS low, (greatest(first, coalesce(s.h, first)) + 6)::INT AS high FROM a LEFT JOIN s ON s.g = a.g AND s.rn = 1""")
def height_mode(spark, d):
    rows = _detections(spark, d).select((F.col("file") % 50).alias("file"), F.lit(100).alias("area"), F.col("h").alias("w"), "h")
    return boxes.letter_heights(rows)


@query(f"""
WITH a AS (SELECT file, coalesce(max(w * h) FILTER (obj_name = 'foto_cnh'), 0) AS p, coalesce(max(w * h) FILTER (obj_name IN ('cnh', 'cnh_frente')), 0) AS c FROM {_DET} GROUP BY 1)
SELECT file, CASE WHEN least(p, c) <= 0 AND NOT (p > 0 AND c > 0) THEN '00' WHEN p >= c THEN '99' ELSE right('0' || (100 * p // c)::VARCHAR, 2) END AS band FROM a""")
def photo_share(spark, d):
    rows = _detections(spark, d).select("file", "obj_name", F.col("w").alias("width"), F.col("h").alias("height"))
    return boxes.photo_share(rows)


_SIDE = "greatest(0, least(s.{0} + s.{1}, b.{0} + b.{1}) - greatest(s.{0}, b.{0}))"
_BOTH = f"({_SIDE.format('x', 'w')} * {_SIDE.format('y', 'h')})"


@query(f"""
WITH RECURSIVE b AS (SELECT file, class_index, x, y, w, h, score, row_number() OVER (PARTITION BY file ORDER BY score DESC, class_index, x, y, w, h) AS i FROM {_DET} WHERE score > 0.9),
k AS (SELECT file, 0::BIGINT AS i, [struct_pack(c := class_index, x := x, y := y, w := w, h := h, score := score)][1:0] AS held FROM b WHERE i = 1
  UNION ALL SELECT k.file, b.i, CASE WHEN len(list_filter(held, lambda s: {_BOTH} / (s.w * s.h + b.w * b.h - {_BOTH}) > 0.3)) > 0 THEN held
    ELSE list_append(held, struct_pack(c := b.class_index, x := b.x, y := b.y, w := b.w, h := b.h, score := b.score)) END FROM k JOIN b ON b.file = k.file AND b.i = k.i + 1),
f AS (SELECT file, max_by(held, i) AS held FROM k GROUP BY 1), u AS (SELECT file, unnest(held) AS s, unnest(range(0, len(held)))::INT AS nms_rank FROM f)
SELECT file, s.c AS class_index, s.x AS x_min, s.y AS y_min, s.w AS width, s.h AS height, s.score AS score, nms_rank FROM u""")
def nms(spark, d):
    rows = _detections(spark, d).select("file", "class_index", "score", F.col("x").alias("x_min"), F.col("y").alias("y_min"), F.col("w").alias("width"), F.col("h").alias("height"))
    return boxes.suppressed(rows)


# --- accuracy

_EXP = "(SELECT doc_id AS file, 'quality' AS field, quality::VARCHAR || ' of ' || doc_id AS expected FROM labels UNION ALL SELECT doc_id, 'cpf_toxic', toxic::VARCHAR || ' in ' || doc_id FROM labels)"
_DETECTED = f"""(SELECT file, field, CASE WHEN file % 5 = 0 THEN replace(expected, 'o', '0') ELSE expected END AS text, 0 AS pos FROM {_EXP} WHERE file % 7 <> 0
  UNION ALL SELECT file, field, 'again' AS text, 1 AS pos FROM {_EXP} WHERE file % 7 <> 0 AND file % 11 = 0)"""
_ROWS = f"(SELECT e.file, e.field, e.expected, t.text, t.pos, CASE WHEN t.text IS NULL THEN 0.0 WHEN t.text = e.expected THEN 1.0 ELSE 0.5 END AS rate FROM {_EXP} e LEFT JOIN {_DETECTED} t USING (file, field))"


def _equal_or_half(expected, got):
    """A rate both engines can say: 1 if equal, else a half."""
    return F.when(expected == got, 1.0).otherwise(0.5)


def _expected(spark, d):
    labels = table(spark, d, "labels")
    q = labels.select(F.col("doc_id").alias("file"), F.lit("quality").alias("field"), F.concat_ws("", F.col("quality").cast("string"), F.lit(" of "), F.col("doc_id").cast("string")).alias("expected"))
    t = labels.select(F.col("doc_id").alias("file"), F.lit("cpf_toxic").alias("field"), F.concat_ws("", F.col("toxic").cast("string"), F.lit(" in "), F.col("doc_id").cast("string")).alias("expected"))
    return q.unionByName(t)


def _matched(spark, d, rate=_equal_or_half):
    expected = _expected(spark, d)
    seen = expected.where("file % 7 <> 0")
    first = seen.select("file", "field", F.when(F.col("file") % 5 == 0, F.replace("expected", F.lit("o"), F.lit("0"))).otherwise(F.col("expected")).alias("text"), F.lit(0).alias("pos"))
    again = seen.where("file % 11 = 0").select("file", "field", F.lit("again").alias("text"), F.lit(1).alias("pos"))
    return evaluate.matched(expected, first.unionByName(again), rate)


@query(f"SELECT file, sum(rate)::DOUBLE AS matches, count(DISTINCT field) AS fields, round(sum(rate)::DOUBLE / count(DISTINCT field), 6) AS accuracy FROM {_ROWS} GROUP BY 1")
def accuracy_file(spark, d):
    return evaluate.file_accuracy(_matched(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH f AS (SELECT file, sum(rate)::DOUBLE AS m, count(DISTINCT field) AS n FROM {_ROWS} GROUP BY 1) SELECT sum(m) AS matches, sum(n)::BIGINT AS fields, round(sum(m) / sum(n), 6) AS accuracy FROM f")
def accuracy_run(spark, d):
    return evaluate.run_accuracy(_matched(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""
WITH l AS (SELECT file, field, rate, row_number() OVER (PARTITION BY file, field ORDER BY coalesce(pos, -1) DESC) AS rn FROM {_ROWS})
SELECT file, max(rate) FILTER (field = 'quality')::DOUBLE AS quality, max(rate) FILTER (field = 'cpf_toxic')::DOUBLE AS cpf_toxic FROM l WHERE rn = 1 GROUP BY 1""")
def accuracy_wide(spark, d):
    return evaluate.wide(evaluate.field_rates(_matched(spark, d)), ["quality", "cpf_toxic"])


@query(f"""
SELECT file, round(CASE WHEN count(text) <= 2 AND count(text) FILTER (trim(text) <> '') <= 1 THEN 0 ELSE sum(rate)::DOUBLE / greatest(count(text), 1) END, 6) AS accuracy,
  round(CASE WHEN count(text) FILTER (trim(text) <> '') > 0 THEN sum(rate) FILTER (trim(text) <> '')::DOUBLE / count(text) FILTER (trim(text) <> '') ELSE 0 END, 6) AS filled_accuracy FROM {_ROWS} GROUP BY 1""")
def accuracy_detected(spark, d):
    return evaluate.detected_accuracy(_matched(spark, d)).select("file", F.round("accuracy", 6).alias("accuracy"), F.round("filled_accuracy", 6).alias("filled_accuracy"))


@query(f"SELECT count(*) FILTER (rate = 1) AS \"right\", count(*) FILTER (rate <> 1) AS wrong FROM {_ROWS} WHERE starts_with(field, 'cpf_') AND text IS NOT NULL")
def cpf_hits(spark, d):
    return evaluate.cpf_hits(_matched(spark, d))


@query()
def accuracy_blocks(spark, d):
    """The flagship: accuracy per file with the matching-block rate."""
    from fieldlens.functions.similarity import block_rate

    return evaluate.file_accuracy(_matched(spark, d, block_rate)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""
SELECT file, field, text FROM {_DETECTED} UNION ALL
SELECT file, field, '' FROM (SELECT DISTINCT file, field FROM {_EXP} WHERE field = 'cpf_toxic') e WHERE NOT EXISTS (SELECT 1 FROM {_DETECTED} t WHERE t.file = e.file AND t.field = e.field)""")
def missing_injected(spark, d):
    rows = _matched(spark, d).where("text is not null").select("file", "field", "text")
    return evaluate.with_missing(_expected(spark, d), rows, "cpf_toxic")


@query("""
SELECT CASE WHEN source LIKE '%1%' AND source NOT LIKE '%2%' THEN 'RG' WHEN source LIKE '%2%' AND source NOT LIKE '%1%' THEN 'CNH' ELSE 'Outros' END AS expected, lang AS detected, count(*) AS files, '' AS ok
FROM documents GROUP BY ALL""")
def confusion(spark, d):
    path = F.concat(F.lit("x"), F.when(F.col("source").contains("1"), "/rg").otherwise(""), F.when(F.col("source").contains("2"), "/cnh").otherwise(""))
    kinds = table(spark, d, "documents").select(classify.expected_kind(path).alias("expected"), F.col("lang").alias("detected"))
    return evaluate.confusion(kinds)


# --- names

#: Nation names differ in digits, which folding drops; here they are letters.
_NAME = "translate(lower(n_name), '0123456789_', 'abcdefghijk')"


def _name():
    return F.translate(F.lower("n_name"), "0123456789_", "abcdefghijk")


@query(f"""
WITH {lcs_cte("SELECT s_suppkey * 100 + n_nationkey AS id, t AS a, lower(n_name) AS b FROM (SELECT s_suppkey, lower(substr(n_name, 2)) AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey) CROSS JOIN nation")},
e AS (SELECT id // 100 AS s_suppkey, id % 100 AS pos, a, b, length(a) + length(b) - 2 * lcs AS err, 200.0 * lcs / (length(a) + length(b)) AS score FROM lcs),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY err, -score, pos) AS rn FROM e WHERE err <= 4)
SELECT s_suppkey, coalesce(b, lower(substr(n_name, 2))) AS issuer FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM r WHERE rn = 1) USING (s_suppkey)""")
def nearest_capped(spark, d):
    nation = table(spark, d, "nation")
    misread = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower(F.substring("n_name", F.lit(2), F.length("n_name"))).alias("text"))
    codes = nation.select(F.col("n_nationkey").alias("pos"), F.lower("n_name").alias("code"))
    return misread.join(resolve.issuers(misread, codes), "text").select("s_suppkey", "issuer")


@query(f"""
WITH u AS (SELECT r_regionkey, lower(substr(r_name, 1, 2)) AS uf, lower(r_name) AS state FROM region),
t AS (SELECT n_nationkey AS pos, {_NAME} || ' ' || uf AS c, {_NAME} AS m, {_NAME} || ' ' || state AS f FROM nation JOIN u ON n_regionkey = r_regionkey),
q AS (SELECT DISTINCT substr({_NAME}, 1, 4) || substr({_NAME}, 6) AS a FROM nation),
forms AS (SELECT pos, c, 0 AS form, c AS b FROM t UNION ALL SELECT pos, c, 1, m FROM t UNION ALL SELECT pos, c, 2, f FROM t), qn AS (SELECT a, row_number() OVER (ORDER BY a) AS qid FROM q),
{lcs_cte("SELECT qid * 10000 + pos * 10 + form AS id, a, b FROM qn CROSS JOIN forms").replace("RECURSIVE ", "")},
s AS (SELECT id // 10000 AS qid, (id // 10) % 1000 AS pos, id % 10 AS form, a, length(a) + length(b) - 2 * lcs AS err, 200.0 * lcs / (length(a) + length(b)) AS score FROM lcs),
best AS (SELECT *, row_number() OVER (PARTITION BY qid, pos ORDER BY score DESC, form) AS rn FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY err, -score, pos) AS rk FROM best WHERE rn = 1)
SELECT a AS text, upper(substr(c, 1, length(c) - 3)) || ',' || upper(right(c, 3)) AS city FROM r JOIN t USING (pos) WHERE rk = 1""".replace("\nWITH u", "\nWITH RECURSIVE u"))
def nearest_city(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    states = region.select("r_regionkey", F.lower(F.substring("r_name", 1, 2)).alias("uf"), F.lower("r_name").alias("name"))
    towns = nation.join(states, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("pos"), F.concat_ws(" ", _name(), "uf").alias("city_uf"))
    asked = nation.select(F.concat(F.substring(_name(), 1, 4), F.substring(_name(), F.lit(6), F.length("n_name"))).alias("text"))
    return resolve.cities(asked, towns, states.select("uf", "name"), special={})


@query("""
WITH c AS (SELECT n_nationkey AS pos, lower(n_name) AS code FROM nation), u AS (SELECT r_regionkey AS up, CASE WHEN r_regionkey = 0 THEN 'ex' ELSE lower(substr(r_name, 1, 2)) END AS uf FROM region)
SELECT pos::INT AS pos, code FROM c UNION ALL
SELECT (24 + row_number() OVER (ORDER BY pos, up))::INT, code || uf FROM c JOIN u ON ends_with(code, 'ex') = (uf = 'ex')""")
def issuer_expand(spark, d):
    codes = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.lower("n_name").alias("code"))
    states = table(spark, d, "region").select(F.col("r_regionkey").alias("pos"), F.when(F.col("r_regionkey") == 0, "ex").otherwise(F.lower(F.substring("r_name", 1, 2))).alias("uf"))
    return resolve.issuer_codes(codes, states)


@query(f"""
WITH RECURSIVE k AS (SELECT n_nationkey AS pos, 'republic of ' || lower(n_name) AS header, lower(n_name) AS detail FROM nation), q AS (SELECT DISTINCT 'repblic of ' || lower(n_name) AS text FROM nation),
w AS (SELECT text, unnest(string_split(text, ' ')) AS word FROM q), ab AS (SELECT DISTINCT word AS a, detail AS b FROM w CROSS JOIN k UNION SELECT text, header FROM q CROSS JOIN k),
{lcs_cte("SELECT row_number() OVER (ORDER BY a, b) AS id, a, b FROM ab").replace("RECURSIVE ", "")},
r AS (SELECT a, b, 2.0 * lcs / (length(a) + length(b)) AS rate FROM lcs),
s AS (SELECT text, pos, header, max(x.rate) AS near, max(y.rate) * 100 AS score FROM w CROSS JOIN k JOIN r x ON x.a = word AND x.b = detail JOIN r y ON y.a = text AND y.b = header GROUP BY text, pos, header),
c AS (SELECT *, max(near) OVER (PARTITION BY text) AS top FROM s), f AS (SELECT * FROM c WHERE top < 0.85 OR near >= CASE WHEN top >= 0.95 THEN 0.95 ELSE 0.85 END),
g AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, near DESC, pos) AS rn, count(*) OVER (PARTITION BY text) AS n FROM f)
SELECT text, upper(CASE WHEN score >= 70 OR n = 1 THEN header ELSE text END) AS header FROM g WHERE rn = 1""")
def header_match(spark, d):
    known = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.concat_ws(" ", F.lit("republic of"), F.lower("n_name")).alias("header"), F.lower("n_name").alias("detail1"), F.lit("").alias("detail2"))
    asked = table(spark, d, "nation").select(F.concat_ws(" ", F.lit("repblic of"), F.lower("n_name")).alias("text"))
    return resolve.headers(asked, known)


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z]', ' ', 'g'), ' {2,}', ' ', 'g')), ' ')) AS word FROM part),
k AS (SELECT DISTINCT lower(r_name) AS word FROM region UNION SELECT 'green') SELECT word FROM w WHERE word <> '' AND word NOT IN (SELECT word FROM k)""")
def dict_new_words(spark, d):
    known = table(spark, d, "region").select(F.lower("r_name").alias("word")).union(spark.sql("select 'green' as word"))
    return spell.new_words(table(spark, d, "part").select(F.col("p_name").alias("text")), known)


@query("""
WITH w AS (SELECT DISTINCT lower(substr(n_name, 2)) AS word FROM nation), k AS (SELECT lower(n_name) AS word, 1 AS n FROM nation),
p AS (SELECT w.word, k.word AS c, levenshtein(w.word, k.word) AS e FROM w CROSS JOIN k), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY e, c) AS rn FROM p WHERE e <= 2)
SELECT w.word, coalesce(c, w.word) AS correction FROM w LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (word)""")
def spell_correction(spark, d):
    nation = table(spark, d, "nation")
    known = nation.select(F.lower("n_name").alias("word"), F.lit(1).cast("long").alias("count"))
    return spell.corrections(nation.select(F.lower(F.substring("n_name", F.lit(2), F.length("n_name"))).alias("word")), known)


@query()
def spell_adjust(spark, d):
    words = table(spark, d, "nation").select(F.lower("n_name").alias("word"), F.lit(1).cast("long").alias("count"))
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return spell.spell_adjust(rows, F.concat_ws(" ", F.lit("NOME"), F.substring("n_name", F.lit(2), F.length("n_name"))), words, titles=("NOME",)).select("s_suppkey", "adjusted")


@query()
def identity_repair(spark, d):
    issuers = spark.createDataFrame([(0, "ssp"), (1, "detran"), (2, "sspsp")], "pos int, code string")
    states = table(spark, d, "region").select(F.lower(F.substring("r_name", 1, 2)).alias("uf"))
    text = F.concat_ws(" ", F.lit("doc"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "8sp").otherwise("detron"), F.lit("/"), F.lit("am"))
    return spell.identity_repair(table(spark, d, "supplier"), text, issuers, states).select("s_suppkey", "identity")


# --- times


@query("""
SELECT event_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS lap_us FROM events""")
def latency_lag(spark, d):
    # event_id breaks ties of ts
    rows = table(spark, d, "events").withColumn("order", F.struct("ts", "event_id"))
    before = F.lag("ts")
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return rows.select("event_id", F.timestamp_diff("MICROSECOND", before.over(w), F.col("ts")).alias("lap_us"))


@query("SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS stdev FROM events GROUP BY 1")
def size_stats(spark, d):
    rows = table(spark, d, "events")
    stats, times = metrics.size_stats(rows, "event_type", "value"), metrics.time_per_item(rows, "event_type", "value")
    return stats.join(times.select("event_type", "total"), "event_type").select("event_type", F.round("total", 4).alias("total"), *[F.round(c, 6).alias(c) for c in ("mean", "median", "stdev")])


@query("""
SELECT count(*) AS requests, round(sum(l_tax), 4) AS detect_sum, round(sum(coalesce(CASE WHEN l_linenumber > 1 THEN l_tax + l_discount END, 0)), 4) AS ocr_sum,
  round(sum(l_tax + coalesce(CASE WHEN l_linenumber > 1 THEN l_tax + l_discount END, 0)), 4) AS total_exported, round(sum(greatest(coalesce(CASE WHEN l_linenumber > 1 THEN l_tax + l_discount END, 0), l_tax)), 4) AS total_actual FROM lineitem""")
def latency_summary(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_tax").alias("detect_s"), F.when(F.col("l_linenumber") > 1, F.col("l_tax") + F.col("l_discount")).alias("ocr_s"))
    return metrics.latency(rows).select("requests", *[F.round(c, 4).alias(c) for c in ("detect_sum", "ocr_sum", "total_exported", "total_actual")])


@query("""
WITH m AS (SELECT user_id AS request, event_type AS clock, ts, event_id, CASE WHEN event_id % 3 = 0 THEN 'end' ELSE 'start' END AS mark FROM events),
p AS (SELECT *, lag(mark) OVER w AS prior FROM m WINDOW w AS (PARTITION BY request, clock ORDER BY ts, mark)),
t AS (SELECT * FROM p WHERE (prior IS NULL AND mark = 'start') OR prior <> mark), u AS (SELECT *, lag(ts) OVER (PARTITION BY request, clock ORDER BY ts, mark) AS began FROM t)
SELECT request, clock, coalesce(sum(date_diff('microsecond', began, ts)) FILTER (mark = 'end'), 0)::BIGINT AS total_us, count(began) FILTER (mark = 'end') AS laps FROM u GROUP BY ALL""")
def timers(spark, d):
    marks = table(spark, d, "events").select(F.col("user_id").alias("request"), F.col("event_type").alias("clock"), "ts", F.when(F.col("event_id") % 3 == 0, "end").otherwise("start").alias("mark"))
    return metrics.timers(marks)


@query("SELECT count(*) AS samples, round(sum(l_quantity), 2) AS used, round(sum(l_extendedprice), 2) AS total, round(sum(l_extendedprice - l_quantity), 2) AS free, round(avg(100 * l_quantity / l_extendedprice), 6) AS used_percent FROM lineitem WHERE l_linenumber - 1 = 0")
def gpu_gauges(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("used"), F.col("l_extendedprice").alias("total"), (F.col("l_linenumber") - 1).alias("index"))
    return metrics.gpu(rows).select("samples", *[F.round(c, 2).alias(c) for c in ("used", "total", "free")], F.round("used_percent", 6).alias("used_percent"))
