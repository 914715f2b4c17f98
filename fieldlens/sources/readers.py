"""Readers: images, ground truth, dictionaries, label files, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlens.functions.geometry import parsed_label

IMAGES = r"(?i)\.(bmp|jpg|jpeg|png|tif|tiff|webp)$"
# The columns of what readers give.
DETECTION = "struct<class_index:int,obj_name:string,score:double,bounding_box:struct<x_min:int,y_min:int,width:int,height:int>,ocr_text:string,adjusted_ocr:string>"
RESULT = f"status string, angle double, predict_time_secs double, detect_time_secs double, detect_ocr_time double, timers string, face_img string, resultlist array<{DETECTION}>"


def images(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, length, content of image files; working folders are left out. Unless asked for, content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where(F.col("path").rlike(IMAGES) & ~F.col("path").contains("/.temp__"))


def decoded_body(body: Column) -> Column:
    """(payload, error) of a base64 text: error 404 where it is none."""
    payload = F.try_to_binary(body, F.lit("base64"))
    return F.struct(payload.alias("payload"), F.when(payload.isNull(), 404).alias("error"))


def request_body(content_type: Column, body: Column) -> Column:
    """(payload, error) of a request's binary body: the first file part of a multipart form, or the bytes themselves of an
    octet stream; error 400 for other types and forms without a file."""
    text = F.decode(body, "ISO-8859-1")  # a character for each byte
    kind = F.lower(F.split(F.coalesce(content_type, F.lit("")), ";")[0])
    mark = F.concat(F.lit("--"), F.regexp_replace(F.regexp_extract(content_type, r"boundary=([^;]+)", 1), '"', ""))
    part = F.element_at(F.filter(F.split(text, F.concat(F.lit(r"\Q"), mark, F.lit(r"\E"))), lambda p: p.rlike(r'(?is)^\r\n.*?filename=.*?\r\n\r\n')), 1)
    content = F.regexp_extract(part, r"(?s)^.*?\r\n\r\n(.*?)(?:\r\n)?$", 1)
    payload = F.when(kind == "application/octet-stream", body).when((kind == "multipart/form-data") & part.isNotNull(), F.encode(content, "ISO-8859-1"))
    return F.struct(payload.alias("payload"), F.when(payload.isNull(), 400).alias("error"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(file, field, expected, doc_type) from flat JSON files: keys lower-cased, files that don't parse give nothing."""
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", "map<string,string>").alias("m"))
    keyed = texts.where("m is not null").select("file", F.transform_keys("m", lambda k, v: F.lower(k)).alias("m"))
    return keyed.select("file", F.try_element_at("m", F.lit("tipo_doc")).alias("doc_type"), F.explode(F.map_filter("m", lambda k, v: k != "tipo_doc")).alias("field", "expected"))


def field_values(truth: DataFrame, field: str) -> DataFrame:
    """(file, expected) of one field, by file."""
    return truth.where(F.col("field") == field).select("file", "expected").orderBy("file")


def keyed_csv(spark: SparkSession, path: str, key: str | int = 0) -> DataFrame:
    """A CSV with its key column first in `key`; of equal keys the last line counts."""
    rows = spark.read.option("header", True).csv(path).withColumn("_pos", F.monotonically_increasing_id())
    columns = [c for c in rows.columns if c != "_pos"]
    name = columns[key] if isinstance(key, int) else key
    best = rows.groupBy(F.col(name).alias("key")).agg(F.max_by(F.struct(*columns), "_pos").alias("v"))
    return best.select("key", *[F.col(f"v.{c}").alias(c) for c in columns if c != name])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): trimmed lines of a small list in file order; empty if there is no such file."""
    try:
        rows = spark.read.text(path, wholetext=True)
        exploded = rows.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("pos", "value"))
        return exploded.select("pos", F.trim("value").alias("value"))
    except Exception as e:  # a list that isn't there is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "pos int, value string")


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """(class_index, obj_name): line numbers are the indices."""
    return lines(spark, path).select(F.col("pos").alias("class_index"), F.col("value").alias("obj_name"))


def municipalities(spark: SparkSession, path: str) -> DataFrame:
    schema = "code string, name string, uf string, population long, ibge string"
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def label_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, bad files): (file, line, cls, cx, cy, w, h), and the files with a line that is none, which give no labels."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    parsed = rows.where(F.trim("text") != "").withColumn("l", parsed_label(F.col("text")))
    good = F.bool_and(F.col("l").isNotNull()).over(Window.partitionBy("file"))
    marked = parsed.withColumn("good", good)
    return marked.where("good").select("file", "line", "l.*"), marked.where(~F.col("good")).select("file").distinct()


def results(texts: DataFrame, column: str = "value") -> DataFrame:
    """Detections of service results in JSON: (file, status, pos, class_index, obj_name, score, box, ocr_text, adjusted_ocr)."""
    parsed = texts.select("file", F.from_json(column, RESULT).alias("r"))
    return parsed.select("file", "r.status", F.posexplode_outer("r.resultlist").alias("pos", "d")).select("file", "status", "pos", "d.*")


def request_params(headers: Column) -> Column:
    """Settings of a request from its headers, with their defaults."""
    from fieldlens.operators.classify import width_param

    def number(name: str, default: int) -> Column:
        return F.coalesce(F.try_element_at(headers, F.lit(name)).try_cast("int"), F.lit(default)).alias(name)

    width = F.coalesce(width_param(F.try_element_at(headers, F.lit("resize"))), F.lit(800)).alias("resize")
    return F.struct(width, number("rotate", 1), number("multiline_preproc", 3), number("preproc", 1), number("ocr", 2), number("crop_height", 48))


def object_files(spark: SparkSession, bucket: str, pattern: str = "") -> DataFrame:
    """Files of an object store by exact key, or by prefix if the pattern ends in a star; all if it is empty."""
    root = bucket.rstrip("/")
    if pattern.endswith("*") or not pattern:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        folder, _, start = pattern.rstrip("*").rpartition("/")  # only this folder is listed
        inside = f"{root}/{folder}".rstrip("/")
        found = reader.load(inside)
        return found.where(F.col("path").contains(inside.split("://")[-1] + "/" + start))
    return spark.read.format("binaryFile").load(f"{root}/{pattern}")


def config(ini: dict[str, str], env: dict[str, str]) -> dict[str, str]:
    """Settings in which the environment's values win over a file's."""
    return {k: env.get(k.upper(), v) for k, v in ini.items()}


def json_value(column: Column, path: str, default, kind: str = "string") -> Column:
    """The value at a JSON path as a type, else the default."""
    return F.coalesce(F.get_json_object(column, path).try_cast(kind), F.lit(default))


def lower_json(column: Column) -> Column:
    """A nested structure with all its keys and values in lower case."""
    return F.lower(column)


def audit(payload: Column, images: tuple[str, ...] = ("image", "face_img", "img_data")) -> Column:
    """A map of a payload without its image fields."""
    return F.map_filter(payload, lambda k, v: ~k.isin(*images))


def image_stats(files: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, height, width, bytes) of files whose sizes (path, height, width) could be read; others are left out."""
    return files.select("path", F.col("length").alias("bytes")).join(sizes, "path").select("path", "height", "width", "bytes")

