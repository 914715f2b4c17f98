"""What a document is, by the names of what was detected on it; how each field is treated; filters and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Class names and rules of the supported documents.
OUTER = "cnh", "cnh_frente", "rg_frente", "rg_verso", "rg2_frente", "rg2_verso"
FAMILIES = "cnh", "rg", "rg2"
ALIGNED = {
    "cnh": [("cpf_cnh", "nascimento_cnh"), ("registro_cnh", "validade_cnh", "pri_habilitacao_cnh"), ("local_emissao_cnh", "data_emissao_cnh")],
    "rg": [],
    "rg2": [],
}
ROUTES = [
    ("cnh", "nome", "name"), ("cnh", "identidade", "identity"), ("cnh", "cpf", "cpf"), ("cnh", "nascimento", "date"), ("cnh", "filiacao", "filiation"),
    ("cnh", "registro", "numeric"), ("cnh", "validade", "date"), ("cnh", "pri_habilitacao", "date"), ("cnh", "local_emissao", "city"), ("cnh", "data_emissao", "date"),
    ("cnh", "cnh", "non_value"), ("cnh", "observacao", "multiline"), ("cnh", "categoria", "category"),
    ("rg", "nome", "name"), ("rg", "assinatura", "non_value"), ("rg", "digital", "non_value"), ("rg", "registro_geral", "numeric"), ("rg", "data_expedicao", "date"),
    ("rg", "filiacao", "multiline"), ("rg", "naturalidade", "city"), ("rg", "nascimento", "date"), ("rg", "doc_origem", "multiline"), ("rg", "cpf", "cpf"),
    ("rg", "cabecalho", "header"), ("rg", "rg_verso", "non_value"), ("rg", "rg_frente", "non_value"), ("rg", "rg2_verso", "non_value"), ("rg", "rg2_frente", "non_value"),
]


def named(detections: DataFrame, classes: DataFrame) -> DataFrame:
    """Detections with obj_name by class_index. Spark broadcasts the classes where their size allows."""
    return detections.join(classes.select("class_index", "obj_name"), "class_index")


def detected(scores: Column, threshold: float = 0.9) -> Column:
    """(class_index, score) of the best class score, null unless above the threshold."""
    best = F.array_max(scores)
    return F.when(best > threshold, F.struct((F.array_position(scores, best) - 1).cast("int").alias("class_index"), best.alias("score")))


def outer_only(detections: DataFrame) -> DataFrame:
    return detections.where(F.lower("obj_name").isin(*OUTER))


def of_family(name: Column, family: str) -> Column:
    """Aggregate: any name is the family's, or all names carry it at an end."""
    return F.bool_or(name == family) | F.bool_and(name.rlike(f"^{family}_|_{family}$"))


def families(detections: DataFrame, key: str = "file") -> DataFrame:
    """key, family (the first that holds, else null) of each document; one stray class leaves it without one."""
    name = F.col("obj_name")
    held = detections.groupBy(key).agg(*[of_family(name, f).alias(f) for f in FAMILIES])
    out = F.lit(None).cast("string")
    for f in reversed(FAMILIES):
        out = F.when(F.col(f), f).otherwise(out)
    return held.select(key, out.alias("family"))


def majority(detections: DataFrame, key: str = "file") -> DataFrame:
    """key, kind: cnh only if more names are of it than of rg."""
    name = F.col("obj_name")
    is_rg = name.rlike("_rg|^rg")
    rg, cnh = F.count_if(is_rg), F.count_if(~is_rg & name.rlike("_cnh|^cnh"))
    return detections.groupBy(key).agg(F.when(cnh > rg, "cnh").otherwise("rg").alias("kind"))


def detected_kind(detections: DataFrame, key: str = "file", other: str = "Outros") -> DataFrame:
    """key, kind by distinct names: RG with at least a field and a side, at most one front and back and no outer CNH; CNH
    with two fields or more, one outer CNH and no side of an RG."""
    name = F.col("obj_name")
    names = detections.select(key, "obj_name").distinct()
    n = names.groupBy(key).agg(
        F.count_if(name.isin("cnh", "cnh_frente")).alias("cnh"), F.count_if(name.rlike("^(?!foto_).*_cnh$")).alias("cnh_fields"), F.count_if(name.rlike("^(?!foto_).*_rg2?$")).alias("rg_fields"),
        F.count_if(name.rlike("^rg2?_frente$")).alias("fronts"), F.count_if(name.rlike("^rg2?_verso$")).alias("backs"),
    )
    sides = F.col("fronts") + F.col("backs")
    rg = (F.col("cnh") == 0) & (F.col("rg_fields") >= 1) & (F.col("fronts") <= 1) & (F.col("backs") <= 1) & (sides >= 1)
    cnh = (sides == 0) & (F.col("cnh_fields") >= 2) & (F.col("cnh") == 1)
    return n.select(key, F.when(rg & ~cnh, "RG").when(cnh & ~rg, "CNH").otherwise(other).alias("kind"))


def expected_kind(path: Column, other: str = "Outros") -> Column:
    """By the folder names in a path; both or none is other."""
    rg, cnh = F.lower(path).contains("/rg"), F.lower(path).contains("/cnh")
    return F.when(rg & ~cnh, "RG").when(cnh & ~rg, "CNH").otherwise(other)


def client_kind(detections: DataFrame, key: str = "file") -> DataFrame:
    """key, kind as the desktop client says it, reading detections by pos up to the first of an RG.

    A name of a CNH before that makes it one, full if a field of its back came, too; else the first RG's kind, rg2 if none.
    """
    name, pos = F.lower("obj_name"), F.col("pos")
    cnh, rg2 = name.rlike("^cnh|cnh$"), name.rlike("^rg2|rg2$")
    back = name.isin("local_emissao_cnh", "data_emissao_cnh", "observacao_cnh")
    at = [("cnh", cnh), ("rg2", ~cnh & rg2), ("rg", ~cnh & ~rg2 & name.rlike("^rg|rg$")), ("back", back)]
    n = detections.groupBy(key).agg(*[F.coalesce(F.min(F.when(c, pos)), F.lit(2**31 - 1)).alias(k) for k, c in at])
    stop = F.least("rg", "rg2")
    return n.select(
        key, F.when((F.col("cnh") < stop) & (F.col("back") < stop), "cnh").when(F.col("cnh") < stop, "cnh_frente").when(F.col("rg") < F.col("rg2"), "rg").otherwise("rg2").alias("kind")
    )


def route(family: Column, name: Column, rules: list[tuple[str, str, str]] = ROUTES) -> Column:
    """The field class by the first rule whose family and prefix fit; else non_value."""
    group = F.when(family == "rg2", "rg").otherwise(family)
    out = F.lit("non_value")
    for rule_family, prefix, kind in reversed(rules):
        out = F.when((group == rule_family) & name.startswith(prefix), kind).otherwise(out)
    return out


def sort_key(name: Column, class_index: Column) -> Column:
    """Where a detection stands in a result: by family, then by class."""
    n = F.lower(name)
    base = F.when(n.startswith("cnh"), 0).when(n.endswith("_cnh"), 100).when(n.startswith("rg_"), 200).when(n.endswith("_rg"), 300).when(n.startswith("rg2_"), 400).otherwise(500)
    return (base + class_index).cast("int")


def outer_first(detections: DataFrame, key: str = "file") -> DataFrame:
    """Detections with report_pos: the first outer class and the first detection (pos 0) change places."""
    first = F.min(F.when(F.lower("obj_name").isin("cnh", "rg_frente", "rg_verso"), F.col("pos"))).over(Window.partitionBy(key))
    at = F.coalesce(first, F.lit(0))
    return detections.withColumn("report_pos", F.when(F.col("pos") == at, 0).when(F.col("pos") == 0, at).otherwise(F.col("pos")).cast("int"))


def alignment_pairs(groups: dict[str, list[tuple[str, ...]]] = ALIGNED) -> list[tuple[str, int, str, str]]:
    """(family, order, field, field): all pairs within a group on one line, the widest apart first."""
    out = []
    for family, lists in groups.items():
        for names in lists:
            pairs = sorted(((j - i, names[i], names[j]) for i in range(len(names)) for j in range(i + 1, len(names))), key=lambda p: -p[0])
            out += [(family, p[1], p[2]) for p in pairs]
    return [(f, i, a, b) for i, (f, a, b) in enumerate(out)]


def pair_angles(detections: DataFrame, pairs: DataFrame, key: str = "file") -> DataFrame:
    """key, angle of the first alignment pair whose two fields are there, from their centres (cx, cy)."""
    from fieldlens.functions.geometry import point_angle

    a = detections.select(key, "family", F.col("obj_name").alias("field_a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    b = detections.select(F.col(key).alias("_key"), F.col("obj_name").alias("field_b"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    joined = a.join(pairs, ["family", "field_a"]).join(b, (F.col(key) == F.col("_key")) & (pairs["field_b"] == b["field_b"]))
    angle = point_angle(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return joined.groupBy(key).agg(F.min_by(angle, F.struct("pair_order", "ax", "ay", "bx", "by")).alias("angle"))


def preproc_bits(mask: Column) -> Column:
    """The preprocessing kinds set in a mask, of 1 and 2."""
    return F.filter(F.array(F.lit(1), F.lit(2)), lambda b: mask.bitwiseAND(b) != 0)


def preproc_kinds(kinds: Column, is_list: bool = False) -> Column:
    """The preprocessing kinds asked for: a list as it is, else a number's bits; anything else is an error where it runs."""
    if is_list:
        return kinds.cast("array<int>")
    mask = kinds.try_cast("int")
    checked = F.when(kinds.isNotNull() & mask.isNull(), F.raise_error("preprocessing kinds must be a number or a list").cast("int")).otherwise(mask)
    return preproc_bits(checked)


def width_param(header: Column, default: int = 800) -> Column:
    """A requested width if it is a number over 450 and at most 1800, else the default."""
    w = header.try_cast("int")
    return F.when((w > 450) & (w <= 1800), w).otherwise(default)


def quality(width: Column) -> Column:
    """1 for images at least 450 wide, else 0."""
    return F.when(width >= 450, 1.0).otherwise(0.0)


def legacy_quality(width: Column, for_ocr: bool) -> Column:
    return quality(width) if for_ocr else F.lit(1.0)


def triage(width: Column, height: Column) -> Column:
    """The bucket of a training image: 0 unreadable, 1 tiny, 2 narrow, 3 usable."""
    return F.when(width.isNull() | height.isNull(), 0).when((height < 300) & (width < 300), 1).when(width < 450, 2).otherwise(3)


def engine(wanted: Column, has_first: bool, has_second: bool, is_cpf: Column | None = None) -> Column:
    """The engine (1 or 2) to use: the wanted one if it is there, else the other, 0 if none; numbers of persons take 2 if both are."""
    if not (has_first or has_second):
        return F.lit(0)
    if not (has_first and has_second):
        return F.lit(1 if has_first else 2)
    kind = F.when(wanted.isin(1, 2), wanted).otherwise(2)
    return kind if is_cpf is None else F.when(is_cpf, 2).otherwise(kind)


def with_face(detections: DataFrame, key: str = "file") -> DataFrame:
    """key, face (its detection) of documents with exactly one photo."""
    photo = F.col("obj_name").startswith("foto")
    kept = detections.groupBy(key).agg(F.count_if(photo).alias("n"), F.max(F.when(photo, F.col("pos"))).alias("face"))
    return kept.select(key, F.when(F.col("n") == 1, F.col("face")).alias("face"))


# The status of each kind of error.
STATUS = {"base64": 404, "quality": 412, "no_image": 400, "preprocessing": 400, "auth": 401, "order": 500}


def status(error: Column) -> Column:
    out = F.lit(513)
    for kind, code in STATUS.items():
        out = F.when(error == kind, code).otherwise(out)
    return out


def host_valid(name: Column) -> Column:
    """1 to 255 characters; names that end in a dot must have labels of letters, digits and inner hyphens, 63 at most."""
    labels = F.split(F.regexp_replace(name, r"\.$", ""), r"\.", -1)
    good = F.forall(labels, lambda l: l.rlike("^(?!-)[A-Za-z0-9-]{1,63}(?<!-)$"))
    return (F.length(name) > 0) & (F.length(name) <= 255) & (~name.endswith(".") | good)
