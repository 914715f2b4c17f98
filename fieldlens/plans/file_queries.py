"""Queries that write the tables at hand as files and read them back, and queries over requests and settings."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.functions import checks, geometry, text
from fieldlens.operators import boxes, evaluate, metrics, resolve, spell
from fieldlens.plans.document_queries import _DET, _detections
from fieldlens.plans.registry import query, table
from fieldlens.sources import readers, writers


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="fieldlens-files-")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors see it; a temporary one in a local session without such a folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _one_each(rows: DataFrame, key: str, value: str, path: str) -> None:
    """A text file for each key, in a folder named for it."""
    rows.select(key, value).repartition(key).write.partitionBy(key).text(path)


def _key_of(path, name: str):
    return F.regexp_extract(path, f"{name}=(\\d+)/", 1).cast("int")


def _truth(spark, d) -> DataFrame:
    path = _folder(spark, "truth")
    fields = F.create_map(F.lit("Nome"), F.col("n_name"), F.lit("REGIAO"), F.col("n_regionkey").cast("string"))
    _one_each(table(spark, d, "nation").withColumn("json", writers.truth_json(fields, F.lit("cnh"))), "n_nationkey", "json", path)
    return readers.ground_truth(spark, path)


@query("""
SELECT n_nationkey AS file, 'nome' AS field, upper(n_name) AS expected, 'cnh' AS doc_type FROM nation
UNION ALL SELECT n_nationkey, 'regiao', n_regionkey::VARCHAR, 'cnh' FROM nation""")
def truth_files(spark, d):
    return _truth(spark, d).withColumn("file", _key_of(F.col("file"), "n_nationkey"))


@query("SELECT n_nationkey AS file, upper(n_name) AS expected FROM nation")
def truth_field(spark, d):
    return readers.field_values(_truth(spark, d), "nome").withColumn("file", _key_of(F.col("file"), "n_nationkey"))


@query("SELECT n_regionkey::VARCHAR AS key, max(n_nationkey)::VARCHAR AS n_nationkey, max_by(n_name, n_nationkey) AS n_name FROM nation GROUP BY 1")
def keyed_csv(spark, d):
    path = _folder(spark, "csv")
    writers.write_csv(table(spark, d, "nation").orderBy("n_nationkey").coalesce(1), path)
    return readers.keyed_csv(spark, path, "n_regionkey")


@query("SELECT n_nationkey::INT AS class_index, n_name AS obj_name FROM nation")
def class_file(spark, d):
    path = _folder(spark, "classes")
    table(spark, d, "nation").orderBy("n_nationkey").select(F.concat(F.lit(" "), "n_name", F.lit("  "))).coalesce(1).write.text(path)
    return readers.class_names(spark, path)


@query("SELECT DISTINCT unnest(string_split(lower(trim(p_name)), ' ')) AS word, 1::BIGINT AS count FROM part")
def word_file(spark, d):
    path = _folder(spark, "words")
    words = spell.load_words(table(spark, d, "part").select(F.col("p_name").alias("value")))
    writers.write_words(words, path)
    return spell.load_words(spark.read.text(path)).where("word <> ''")


@query("SELECT s_suppkey::VARCHAR AS code, s_name AS name, 'uf' AS uf, s_nationkey::BIGINT AS population, 'x' AS ibge FROM supplier")
def town_file(spark, d):
    path = _folder(spark, "towns")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.lit("uf").alias("uf"), F.col("s_nationkey").alias("population"), F.lit("x").alias("ibge"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return readers.municipalities(spark, path)


_LABELS = "SELECT s_suppkey AS file, s_nationkey % 3 AS cls FROM supplier WHERE s_suppkey % 5 <> 0"


@query(f"SELECT file::INT AS file, 0 AS line, cls::INT AS cls, 0.5 AS cx, 0.25 AS cy, 0.125 AS w, 0.0625 AS h FROM ({_LABELS}) UNION ALL SELECT file::INT, 1, 7, 0.25, 0.5, 0.5, 0.5 FROM ({_LABELS})")
def label_files(spark, d):
    labels, _ = _labels(spark, d)
    return labels.withColumn("file", _key_of(F.col("file"), "s_suppkey"))


@query("SELECT s_suppkey::INT AS file FROM supplier WHERE s_suppkey % 5 = 0")
def bad_label_files(spark, d):
    _, bad = _labels(spark, d)
    return bad.select(_key_of(F.col("file"), "s_suppkey").alias("file"))


def _labels(spark, d) -> tuple[DataFrame, DataFrame]:
    """Suppliers stand for files of two labels; every fifth has a line that is none."""
    path = _folder(spark, "labels")
    first = F.format_string("%d 0.5 0.25 0.125 0.0625", (F.col("s_nationkey") % 3).cast("int"))
    second = F.when(F.col("s_suppkey") % 5 == 0, "no label").otherwise("7 0.25 0.5 0.5 0.5")
    _one_each(table(spark, d, "supplier").withColumn("text", F.concat_ws("\n", first, second)), "s_suppkey", "text", path)
    return readers.label_files(spark, path)


def _images(spark, d) -> str:
    """A file for each region, its name as content: folders a and b by whether the key is even; one working folder."""
    root = _folder(spark, "images")
    jvm = spark._jvm
    for r in table(spark, d, "region").collect():  # five rows
        for name in (f"{'ab'[r['r_regionkey'] % 2]}/{r['r_regionkey']}.PNG", f"a/{r['r_regionkey']}.txt", f"a/.temp__/{r['r_regionkey']}.png"):
            path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
            out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
            out.write(bytearray(r["r_name"].encode()))
            out.close()
    return root


@query("SELECT CASE r_regionkey % 2 WHEN 0 THEN 'a/' ELSE 'b/' END || r_regionkey || '.PNG' AS key, octet_length(encode(r_name))::BIGINT AS length, 10 * r_regionkey::INT AS height, 100 AS width FROM region WHERE r_regionkey <> 3")
def image_files(spark, d):
    root = _images(spark, d)
    files = readers.images(spark, root, recursive=True).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    number = F.regexp_extract("path", r"/(\d+)\.PNG$", 1).cast("int")
    sizes = files.select("path", (number * 10).alias("height"), F.lit(100).alias("width")).where(number != 3)  # one that cannot be read
    stats = readers.image_stats(files, sizes)
    return writers.upload_keys(stats, root.removeprefix("file://").removeprefix("file:")).join(stats, "path").select("key", F.col("bytes").alias("length"), "height", "width")


@query("SELECT r_regionkey || '.PNG' AS name FROM region WHERE r_regionkey % 2 = 1")
def stored_objects(spark, d):
    return readers.object_files(spark, _images(spark, d), "b/*").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"))


@query("""
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN octet_length(encode(coalesce(text, ''))) END::INT AS n, CASE WHEN turn % 2 <> 0 THEN 404 END AS error FROM conversations""")
def request_bodies(spark, d):
    body = F.when(F.col("turn") % 2 == 0, F.base64(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).otherwise(F.lit("* no base64 *"))
    decoded = readers.decoded_body(body)
    return table(spark, d, "conversations").select("conv_id", "turn", F.octet_length(decoded["payload"]).alias("n"), decoded["error"].alias("error"))


@query("""
SELECT conv_id, turn, CASE turn % 3 WHEN 2 THEN NULL ELSE md5(coalesce(text, '')) END AS payload, CASE WHEN turn % 3 = 2 THEN 400 END AS error FROM conversations""")
def multipart_bodies(spark, d):
    content = F.coalesce("text", F.lit(""))
    form = F.concat(F.lit('--mark\r\nContent-Disposition: form-data; name="a"\r\n\r\n1\r\n--mark\r\nContent-Disposition: form-data; name="f"; filename="x.png"\r\n\r\n'), content, F.lit("\r\n--mark--\r\n"))
    k = F.col("turn") % 3
    kind = F.when(k == 0, "multipart/form-data; boundary=mark").when(k == 1, "application/octet-stream").otherwise("text/plain")
    got = readers.request_body(kind, F.encode(F.when(k == 0, form).otherwise(content), "UTF-8"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(got["payload"]).alias("payload"), got["error"].alias("error"))


@query("""
SELECT s_suppkey::INT AS file, 'ok' AS status, 0 AS pos, s_nationkey::INT AS class_index, s_name AS obj_name, 0.5 AS score, 3 AS x_min, 'text' AS ocr_text FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT s_suppkey::INT, 'empty', NULL, NULL, NULL, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 2 <> 0""")
def service_results(spark, d):
    path = _folder(spark, "results")
    box = F.struct(F.lit(3).alias("x_min"), F.lit(1).alias("y_min"), F.lit(2).alias("width"), F.lit(2).alias("height"))
    found = F.struct(F.col("s_nationkey").cast("int").alias("class_index"), F.col("s_name").alias("obj_name"), F.lit(0.5).alias("score"), box.alias("bounding_box"), F.lit("text").alias("ocr_text"))
    even = F.col("s_suppkey") % 2 == 0
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), F.when(even, "ok").otherwise("empty").alias("status"), F.when(even, F.array(found)).alias("resultlist"))
    writers.write_results(rows, path)
    texts = spark.read.text(path).select(F.get_json_object("value", "$.file").cast("int").alias("file"), "value")
    got = readers.results(texts)
    return got.select("file", "status", "pos", "class_index", "obj_name", "score", F.col("bounding_box.x_min").alias("x_min"), "ocr_text")


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey * 40 > 450 AND s_suppkey * 40 <= 1800 THEN s_suppkey * 40 ELSE 800 END::INT AS resize, s_nationkey::INT AS rotate, 3 AS multiline_preproc, 1 AS ocr FROM supplier""")
def request_settings(spark, d):
    headers = F.create_map(F.lit("resize"), (F.col("s_suppkey") * 40).cast("string"), F.lit("rotate"), F.col("s_nationkey").cast("string"), F.lit("ocr"), F.lit("1"), F.lit("multiline_preproc"), F.lit("many"))
    got = readers.request_params(headers)
    return table(spark, d, "supplier").select("s_suppkey", *[got[c].alias(c) for c in ("resize", "rotate", "multiline_preproc", "ocr")])


@query("SELECT event_id, lower(props) AS props, event_type AS kept FROM events")
def payloads(spark, d):
    seen = readers.audit(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("image"), F.lit("bytes"), F.lit("face_img"), F.lit("bytes")))
    kept = F.array_join(F.map_values(seen), ",")
    return table(spark, d, "events").select("event_id", readers.lower_json(F.upper("props")).alias("props"), kept.alias("kept"))


@query("SELECT user_id, date_diff('microsecond', min(ts), max(ts))::BIGINT AS total_us, (count(*) - 1)::BIGINT AS laps FROM events GROUP BY 1")
def request_laps(spark, d):
    """Laps of a run add up to the time from its first mark to its last."""
    rows = metrics.laps(table(spark, d, "events"), "user_id", "ts")
    return rows.groupBy("user_id").agg(F.coalesce(F.sum("lap_us"), F.lit(0)).alias("total_us"), F.count("lap_us").alias("laps"))


@query("""
SELECT doc_id, strftime(TIMESTAMP '2020-01-02 03:04:05' + to_seconds(doc_id), '%Y-%m-%d %H:%M:%S') AS now, strftime(TIMESTAMP '2020-01-02 03:04:05' + to_seconds(doc_id), '%Y%m%d/%H%M%S_000000') AS stamp FROM documents""")
def stamps(spark, d):
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit("2020-01-02 03:04:05").cast("timestamp")) + F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", text.now_text(ts).alias("now"), text.stamp(ts).alias("stamp"))


# --- boxes

_IN = "obj_name IN ('nome_cnh', 'cpf_rg', 'foto_cnh')"


@query(f"""
SELECT file, pos, obj_name, greatest(x, 0)::INT AS x_min, greatest(y, 0)::INT AS y_min, (least(x + w, 90) - greatest(x, 0))::INT AS width, (least(y + h, 200) - greatest(y, 0))::INT AS height FROM {_DET} WHERE {_IN}""")
def filter_and_clip(spark, d):
    rows = _detections(spark, d).select("file", "pos", "obj_name", geometry.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"))
    return boxes.filtered_result(rows, ["nome_cnh", "cpf_rg", "foto_cnh"], 90, 200).select("file", "pos", "obj_name", "box.*")


_H = "CASE WHEN starts_with(obj_name, 'filiacao_') THEN (1 - 0.7::DOUBLE) / 2 ELSE (1 - 0.4::DOUBLE) / 2 END * h"


@query(f"""
SELECT file, pos, trunc(x + {_H})::INT AS x_min, trunc(y + {_H})::INT AS y_min, trunc(w - {_H} * 2)::INT AS width, trunc(h - {_H} * 2)::INT AS height,
  CASE WHEN obj_name = 'local_emissao_cnh' THEN (trunc(y + {_H})::INT - 4 * (trunc(h - {_H} * 2)::INT + 3) + 7 * (trunc(h - {_H} * 2)::INT + 2)) END AS last_line
FROM {_DET} WHERE NOT starts_with(obj_name, 'foto_') AND obj_name NOT IN ('cnh', 'cnh_frente', 'rg_frente', 'rg_verso', 'rg2_frente', 'rg2_verso')""")
def hidden_parts(spark, d):
    b = geometry.box(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    lines = geometry.hidden_lines(F.col("obj_name"), b)
    rows = _detections(spark, d).select("file", "pos", geometry.hidden_part(F.col("obj_name"), b).alias("b"), F.get(lines, F.lit(4))["y_min"].alias("last_line"))
    return rows.where("b is not null").select("file", "pos", "b.*", "last_line")


@query(f"""
SELECT file, pos, (x + w // 10)::INT AS x1, (y + h // 2)::INT AS y1, (x + w - w // 10)::INT AS x2, (y + h - w // 10)::INT AS y2, (x + w // 2)::INT AS head_x, (y + h // 3)::INT AS head_y, least(h // 4, w // 3)::INT AS radius
FROM {_DET} WHERE starts_with(obj_name, 'foto_')""")
def hidden_photos(spark, d):
    hidden = geometry.hidden_photo(geometry.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    rows = _detections(spark, d).where(F.col("obj_name").startswith("foto_")).select("file", "pos", hidden.alias("p"))
    return rows.select("file", "pos", "p.body.*", F.col("p.head.x").alias("head_x"), F.col("p.head.y").alias("head_y"), F.col("p.head.radius").alias("radius"))


@query(f"""
SELECT file, pos, trunc(w * least(200::DOUBLE / w, 100::DOUBLE / h))::INT AS fit_w, trunc(h * greatest(200::DOUBLE / w, 100::DOUBLE / h))::INT AS cover_h,
  trunc(h * least(1::DOUBLE, 50::DOUBLE / w))::INT AS shrunk_h FROM {_DET}""")
def sizes_that_fit(spark, d):
    w, h = F.col("w"), F.col("h")
    return _detections(spark, d).select(
        "file", "pos", geometry.fitted(w, h, F.lit(200), F.lit(100))["width"].alias("fit_w"), geometry.fitted(w, h, F.lit(200), F.lit(100), cover=True)["height"].alias("cover_h"),
        geometry.shrunk(w, h, F.lit(50))["height"].alias("shrunk_h"),
    )


@query("""
SELECT l_orderkey, l_linenumber, trunc(480 * abs(sin(radians(a))) + 640 * abs(cos(radians(a))))::INT AS width FROM (SELECT *, (l_partkey % 89 + 0.5)::DOUBLE AS a FROM lineitem)""")
def canvas_width(spark, d):
    a = (F.col("l_partkey") % 89 + 0.5).cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geometry.canvas(F.lit(640), F.lit(480), a)["width"].alias("width"))


@query("""
SELECT l_orderkey, l_linenumber, (10 * k + 20)::INT AS width, k::INT AS height, 0.0 AS angle FROM (SELECT *, l_partkey % 30 + 1 AS k FROM lineitem)""")
def long_sides(spark, d):
    """Level rectangles k high and ten times as wide and more."""
    k = (F.col("l_partkey") % 30 + 1).cast("int")
    corners = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((F.lit(0), F.lit(0)), (k * 10 + 20, F.lit(0)), (k * 10 + 20, k), (F.lit(0), k))])
    side = geometry.long_side_angle(corners)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", side["width"].alias("width"), side["height"].alias("height"), F.abs(side["angle"]).alias("angle"))


@query("""
SELECT i::INT AS i, ((i & 1) << 7 | 0)::INT AS first, count(*) OVER ()::BIGINT AS n FROM range(0, 8) t(i)""")
def colour_cube(spark, d):
    """One bit a channel: eight colours; red is the lowest bit."""
    rows = table(spark, d, "region").limit(1).select(F.posexplode(geometry.colours(1)).alias("i", "c"))
    n = rows.select(F.count("*").alias("n"))
    return rows.select("i", F.col("c.r").alias("first")).crossJoin(F.broadcast(n))


@query(f"""
SELECT n_nationkey AS file, CASE n_nationkey % 4 WHEN 0 THEN 'OK' WHEN 1 THEN '' WHEN 2 THEN 'OK' ELSE '' END AS ok,
  CASE n_nationkey % 4 WHEN 0 THEN 'RG' WHEN 1 THEN 'CNH' WHEN 2 THEN 'Outros' ELSE 'RG' END AS expected, CASE n_nationkey % 4 WHEN 0 THEN 'RG' WHEN 1 THEN 'RG' WHEN 2 THEN 'Outros' ELSE 'CNH' END AS detected,
  CASE n_nationkey % 4 WHEN 0 THEN 'S' WHEN 3 THEN 'S' ELSE 'N' END AS dir_rg FROM nation""")
def confusion_rows(spark, d):
    k = F.col("n_nationkey") % 4
    path = F.concat(F.element_at(F.array(*map(F.lit, ("/x/RG/", "/x/cnh/", "/x/y/", "/x/rg/"))), (k + 1).cast("int")), F.col("n_nationkey").cast("string"))
    files = table(spark, d, "nation").select(path.alias("file"), k.isin(0, 1).alias("found_rg"), (k == 3).alias("found_cnh"))
    rows = evaluate.confusion_rows(files, F.lit("2020-01-01 00:00:00").cast("timestamp"))
    return rows.select(F.regexp_extract("file", r"(\d+)$", 1).cast("int").alias("file"), "ok", "expected", "detected", "dir_rg")


@query("""
WITH p AS (SELECT n_regionkey AS image, (n_nationkey // 5)::INT AS r, row_number() OVER (PARTITION BY n_regionkey, n_nationkey // 5 ORDER BY n_nationkey)::INT - 1 AS c, n_nationkey % 3 AS v FROM nation),
w AS (SELECT a.image, a.r, a.c, b.v, count(*) AS n FROM p a JOIN p b ON a.image = b.image AND b.r BETWEEN a.r - 2 AND a.r + 1 AND b.c BETWEEN a.c - 2 AND a.c + 1 GROUP BY ALL)
SELECT image, r AS row, c AS col, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM w GROUP BY ALL""")
def window_entropy(spark, d):
    from pyspark.sql import Window

    line = F.floor(F.col("n_nationkey") / 5).cast("int")
    col = F.row_number().over(Window.partitionBy("n_regionkey", line).orderBy("n_nationkey")) - 1
    pixels = table(spark, d, "nation").select(F.col("n_regionkey").alias("image"), line.alias("row"), col.alias("col"), (F.col("n_nationkey") % 3).alias("value"))
    return metrics.window_entropy(pixels, "image", 2).select("image", "row", "col", F.round("entropy", 6).alias("entropy"))


# --- names and fields


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def only_row(spark, d):
    return resolve.only_row(table(spark, d, "nation").select("n_nationkey", "n_name"), F.col("n_nationkey") == 7)


@query()
def corrected_fields(spark, d):
    """The whole correction of all classes, over suppliers that stand for fields misread."""
    from fieldlens.operators.adjust import adjust

    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    plain = F.translate(F.lower("n_name"), "0123456789_", "abcdefghijk")
    names = ("nome_cnh", "identidade_cnh", "cpf_cnh", "nascimento_cnh", "filiacao_cnh", "registro_cnh", "local_emissao_cnh", "observacao_cnh", "categoria_cnh", "cabecalho_rg", "foto_cnh")
    rows = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % len(names)
    read = F.concat(F.lit("NOME "), plain, F.lit(" 12/03/2019 123 AB\n"), plain)
    fields = rows.select("s_suppkey", F.when(k == 9, "rg").otherwise("cnh").alias("family"), F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int")).alias("obj_name"), read.alias("ocr_text"))
    states = region.select("r_regionkey", F.lower(F.substring("r_name", 1, 2)).alias("uf"), F.lower("r_name").alias("name"))
    towns = nation.join(states, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("pos"), F.concat_ws(" ", plain, "uf").alias("city_uf"))
    words = nation.select(plain.alias("word"), F.lit(1).cast("long").alias("count"))
    issuers = spark.createDataFrame([(0, "ssp"), (1, "detran")], "pos int, code string")
    known = nation.select(F.col("n_nationkey").alias("pos"), plain.alias("header"), plain.alias("detail1"), F.lit("").alias("detail2"))
    return adjust(fields, words, towns, states.select("uf", "name"), issuers, known, special={}).select("s_suppkey", "kind", "adjusted")


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'numeric' WHEN 1 THEN 'category' ELSE 'non_value' END AS kind,
  CASE o_orderkey % 3 WHEN 0 THEN o_orderkey::VARCHAR || o_custkey::VARCHAR WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN 'AB' ELSE '' END ELSE '' END AS adjusted FROM orders""")
def native_fields(spark, d):
    from fieldlens.operators.adjust import native_adjust

    k = F.col("o_orderkey") % 3
    name = F.when(k == 0, "registro_cnh").when(k == 1, "categoria_cnh").otherwise("cnh")
    mark = F.when(F.col("o_custkey") % 2 == 0, "Q X AB").otherwise("xyz")
    read = F.when(k == 1, mark).otherwise(F.concat_ws(" ", F.col("o_orderkey").cast("string"), F.lit("n."), F.col("o_custkey").cast("string")))
    rows = table(spark, d, "orders").select("o_orderkey", F.lit("cnh").alias("family"), name.alias("obj_name"), read.alias("ocr_text"))
    return native_adjust(rows).select("o_orderkey", "kind", "adjusted")


@query("""
WITH d AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 9, '0') AS s FROM part), t AS (SELECT *, list_sum(list_transform(range(0, 9), lambda y: substr(s, 9 - y, 1)::INT * (y % 9 + 2))) AS total FROM d)
SELECT p_partkey, CASE WHEN p_partkey % 11 < 2 THEN 0 ELSE 11 - p_partkey % 11 END::INT AS rest, (CASE WHEN total % 11 < 2 THEN 0 ELSE 11 - total % 11 END)::INT::VARCHAR AS digit FROM t""")
def check_digits(spark, d):
    digit = checks.check_digit(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), 0, 8, 10)
    return table(spark, d, "part").select("p_partkey", checks.mod11(F.col("p_partkey")).alias("rest"), digit.alias("digit"))
