"""Queries over text, dates, check digits and similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlens.functions import checks, similarity, text
from fieldlens.plans.registry import lcs_cte, query, quoted, table

# What SQL folds is written out here, apart from the library's own table: the bar and the letters of Western Europe.
_FROM = "|ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝßàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_TO = "laaaaaaceeeeiiiinooooouuuuybaaaaaaceeeeiiiinooooouuuuyy"


def _t(inner: str, plain: bool = False) -> str:
    """The fold in SQL; line ends are put in by chr() to keep the text printable."""
    folded = f"translate({inner}, {quoted(_FROM)}, {quoted(_TO)})"
    return folded if plain else f"replace(replace(replace({folded}, chr(9), ' '), chr(10), ' '), chr(13), ' ')"


@query(f"SELECT doc_id, md5({_t('text')}) AS folded FROM documents")
def fold_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


@query(f"SELECT doc_id, md5(lower(regexp_replace({_t('text', True)}, '[^A-Za-z'']', ' ', 'g'))) AS folded FROM documents")
def fold_strict(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold_strict(F.col("text"))).alias("folded"))


@query("SELECT doc_id, md5(regexp_replace(replace(text, 'e', ' '), ' {2,}', ' ', 'g')) AS collapsed FROM documents")
def collapse(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.collapse(F.replace("text", F.lit("e"), F.lit(" ")))).alias("collapsed"))


@query("SELECT doc_id, md5(regexp_replace(text, '[^0-9/]', '', 'g')) AS kept FROM documents")
def keep_chars(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.keep_chars(F.col("text"), "0-9/")).alias("kept"))


def _collapsed(s: str) -> str:
    return f"regexp_replace({s}, ' {{2,}}', ' ', 'g')"


_OPENED = "replace(replace(replace(text, ' ''', ' '), ''' ', ' '), '''', 'e ')"


@query(f"""
SELECT conv_id, turn,
  md5(trim({_collapsed(f"upper({_t('text')})")}, ' ')) AS value,
  md5(trim({_collapsed(f"lower(regexp_replace({_t(_OPENED)}, '[^A-Za-z]', ' ', 'g'))")}, ' ')) AS word,
  md5(trim({_collapsed("replace(replace(text, chr(10), ' '), chr(13), ' ')")}, ' ')) AS ocr,
  md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: upper({_t('x')})), chr(10))) AS adjusted,
  md5(regexp_replace({_collapsed("replace(replace(replace(text, chr(10), '\\n'), chr(13), ' '), chr(9), ' ')")}, '[^A-Za-z0-9\\\\/,. -]', '', 'g')) AS console
FROM conversations""")
def clean_text(spark, d):
    c = F.col("text")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.md5(text.clean_value(c)).alias("value"), F.md5(text.dictionary_word(c)).alias("word"), F.md5(text.normal_ocr(c)).alias("ocr"),
        F.md5(text.final_adjust(c)).alias("adjusted"), F.md5(text.console_clean(c)).alias("console"),
    )


@query("""
SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(s, '((?:[A-Za-z0-9 ]*[A-Za-z0-9])?)([^A-Za-z0-9]*)', 1), lambda x: x <> ''), '|') AS words,
  array_to_string(list_filter(regexp_extract_all(s, '((?:[A-Za-z0-9 ]*[A-Za-z0-9])?)([^A-Za-z0-9]*)', 2), lambda x: x <> ''), '|') AS separators
FROM (SELECT p_partkey, p_name || ' - ' || p_brand || '/' || p_type || '.' AS s FROM part)""")
def phrases(spark, d):
    s = F.concat_ws("", "p_name", F.lit(" - "), "p_brand", F.lit("/"), "p_type", F.lit("."))
    rows = table(spark, d, "part").select("p_partkey", text.phrases(s).alias("p"))

    def joined(name: str):
        return F.array_join(F.filter(F.transform("p", lambda x: x[name]), lambda v: v != ""), "|")

    return rows.select("p_partkey", joined("words").alias("words"), joined("separator").alias("separators"))


@query(r"""
SELECT o_orderkey, array_to_string(regexp_extract_all(lower(o_orderpriority) || ' ' || o_orderkey || '/ab-' || o_custkey, '([/-]|[0-9]+|[a-z]+|[^0-9^a-z/-]+|\^.*)', 1), '|') AS tokens
FROM orders""")
def identity_tokens(spark, d):
    s = F.concat(F.lower("o_orderpriority"), F.lit(" "), F.col("o_orderkey").cast("string"), F.lit("/ab-"), F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(text.identity_tokens(s), "|").alias("tokens"))


@query("""
SELECT p_partkey, len(list_filter(range(0, length(p_name)), lambda i: substr(p_name, i + 1, 1) = 'e'))::INT AS n_e,
  array_to_string(list_filter(range(0, length(p_name)), lambda i: substr(p_name, i + 1, 1) = 'e'), ',') AS at_e,
  substr(repeat(p_brand, 5), 1, 20) AS repeated, regexp_replace('/a/' || p_brand || '.txt', '\\.[^.]*$', '') || '_x.png' AS renamed,
  coalesce(TRY_CAST(right(p_brand, 2) AS INT), -1) AS n
FROM part""")
def string_parts(spark, d):
    c = F.col("p_name")
    at = text.positions(c, "e")
    return table(spark, d, "part").select(
        "p_partkey", F.size(at).alias("n_e"), F.array_join(at.cast("array<string>"), ",").alias("at_e"), text.repeat_to(F.col("p_brand"), length=20).alias("repeated"),
        text.renamed(F.concat(F.lit("/a/"), "p_brand", F.lit(".txt")), ext=".png", name_suffix="_x").alias("renamed"), text.int_or(F.right("p_brand", F.lit(2)), -1).alias("n"),
    )


# --- dates

_DATE_FORMS = ["%d/%m/%Y", "%d-%m-%Y", "%d%m%Y", "%d/%m/%y", "%d7%m/%Y", "%m/%Y"]
_MISREAD = "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN strftime(o_orderdate, {quoted(f)})" for i, f in enumerate(_DATE_FORMS)) + " END"
_CANON = """CASE len(p) WHEN 1 THEN right('00000000' || p[1], 8) WHEN 2 THEN '00' || right('00' || p[1], 2) || right('0000' || p[2], 4)
  ELSE right('00' || p[len(p) - 2], 2) || right('00' || p[len(p) - 1], 2) || right('0000' || p[len(p)], 4) END"""


def _misread():
    c = F.col("o_orderdate")
    forms = ["dd/MM/yyyy", "dd-MM-yyyy", "ddMMyyyy", "dd/MM/yy", "dd'7'MM/yyyy", "MM/yyyy"]
    out = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        out = F.when(F.col("o_orderkey") % 6 == i, F.date_format(c, f)).otherwise(out)
    return out


@query(f"""
WITH s AS (SELECT o_orderkey, string_split(regexp_replace({_MISREAD}, '[^0-9/]', '', 'g'), '/') AS p FROM orders), c AS (SELECT o_orderkey, {_CANON} AS f FROM s)
SELECT o_orderkey, substr(f, 1, 2) || '/' || substr(f, 3, 2) || '/' || substr(f, 5, 4) AS canonical FROM c""")
def canonical_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.canonical_date(_misread()).alias("canonical"))


def _open(s: str) -> str:
    return f"regexp_extract({s}, '^([^47]*)([47])', 1) || CASE WHEN regexp_extract({s}, '^([^47]*)([47])', 2) = '7' THEN '/' ELSE '/1' END || substr({s}, length(regexp_extract({s}, '^([^47]*)([47])', 1)) + 2)"


@query(f"""
WITH t AS (SELECT o_orderkey, regexp_replace(replace(translate(lower({_MISREAD}), 'li-.', '11//'), '//', '/'), '[^0-9/]', '', 'g') AS ns FROM orders),
u AS (SELECT *, length(ns) - length(replace(ns, '/', '')) AS n, length(ns) - length(translate(ns, '47', '')) AS k, regexp_matches(ns, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') AS m, {_open('ns')} AS o1 FROM t),
v AS (SELECT *, {_open('o1')} AS o2 FROM u),
w AS (SELECT o_orderkey, CASE WHEN m OR n >= 2 OR (n = 0 AND length(ns) = 8) THEN ns WHEN n = 1 AND k >= 1 THEN o1 WHEN n = 0 AND k >= 2 THEN o2 ELSE ns END AS x FROM v),
y AS (SELECT o_orderkey, x, string_split(x, '/') AS p FROM w), z AS (SELECT o_orderkey, x, {_CANON} AS f FROM y)
SELECT o_orderkey, CASE WHEN regexp_matches(x, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN regexp_extract(x, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}')
  ELSE substr(f, 1, 2) || '/' || substr(f, 3, 2) || '/' || substr(f, 5, 4) END AS recognised FROM z""")
def recognised_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.recognised_date(_misread()).alias("recognised"))


@query(f"SELECT o_orderkey, strftime(try_strptime({_MISREAD}, '%d/%m/%Y'), '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 6 IN (0, 1, 2, 5)")
def strict_date(spark, d):
    rows = table(spark, d, "orders").where("o_orderkey % 6 in (0, 1, 2, 5)")  # two-digit years are read by no common rule
    return rows.select("o_orderkey", F.date_format(text.strict_date(_misread()), "yyyy-MM-dd").alias("day"))


@query(f"""
WITH s AS (SELECT o_orderkey, {_MISREAD} AS s FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(s, '/[0-9]{{4}}$') THEN strftime(try_strptime(s, '%d/%m/%Y'), '%Y-%m-%d') END AS day FROM s""")
def strict_date_all(spark, d):
    """Every form of every order; a year has four digits."""
    return table(spark, d, "orders").select("o_orderkey", F.date_format(text.strict_date(_misread()), "yyyy-MM-dd").alias("day"))


@query("""
WITH y AS (SELECT o_orderkey, (o_orderkey % 100)::INT AS y2, year(o_orderdate)::INT AS now FROM orders), o AS (SELECT *, y2 + (now // 100) * 100 - now AS f FROM y)
SELECT o_orderkey, (now + CASE WHEN f < -50 THEN f + 100 WHEN f >= 50 THEN f - 100 ELSE f END)::INT AS rounded, strftime(o_orderdate, '%Y%m%d') AS stamp FROM o JOIN orders USING (o_orderkey)""")
def rounded_year(spark, d):
    rows = table(spark, d, "orders")
    return rows.select("o_orderkey", text.rounded_year((F.col("o_orderkey") % 100).cast("int"), F.year("o_orderdate")).alias("rounded"), F.substring_index(text.stamp(F.col("o_orderdate")), "/", 1).alias("stamp"))


# --- check digits


def _digit_sql(s: str, n: int, base: int) -> str:
    total = " + ".join(f"substr({s}, {n - y}, 1)::INT * {y % (base - 1) + 2}" for y in range(n))
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END)::VARCHAR"


def _valid_sql(s: str, n: int, base: int) -> str:
    one = _digit_sql(s, n - 2, base)
    both = f"(substr({s}, 1, {n - 2}) || {one})"
    return f"right({s}, 2) = {one} || {_digit_sql(both, n - 1, base)}"


@query(f"WITH s AS (SELECT o_orderkey, right('00000000000' || (o_orderkey * 7919)::VARCHAR, 11) AS s FROM orders) SELECT o_orderkey, {_valid_sql('s', 11, 11)} AS valid FROM s")
def cpf_valid(spark, d):
    s = F.right(F.concat(F.lit("0" * 11), (F.col("o_orderkey") * 7919).cast("string")), F.lit(11))
    return table(spark, d, "orders").select("o_orderkey", checks.cpf_valid(s).alias("valid"))


@query(f"WITH s AS (SELECT o_orderkey, right('00000000000000' || (o_orderkey * 7919)::VARCHAR, 14) AS s FROM orders) SELECT o_orderkey, {_valid_sql('s', 14, 9)} AS valid FROM s")
def cnpj_valid(spark, d):
    s = F.right(F.concat(F.lit("0" * 14), (F.col("o_orderkey") * 7919).cast("string")), F.lit(14))
    return table(spark, d, "orders").select("o_orderkey", checks.cnpj_valid(s).alias("valid"))


_LONG = "right('00000000000' || (o_orderkey * 7919)::VARCHAR, 11) || right('000000' || (o_custkey * 31)::VARCHAR, 6)"


def _long():
    return F.concat(F.right(F.concat(F.lit("0" * 11), (F.col("o_orderkey") * 7919).cast("string")), F.lit(11)), F.right(F.concat(F.lit("0" * 6), (F.col("o_custkey") * 31).cast("string")), F.lit(6)))


@query(f"""
WITH s AS (SELECT o_orderkey, {_LONG} AS s FROM orders), w AS (SELECT o_orderkey, s, unnest(range(1, length(s) - 9)) AS i FROM s),
v AS (SELECT o_orderkey, i, substr(s, i, 11) AS c FROM w), f AS (SELECT o_orderkey, c, min(i) AS i FROM v WHERE {_valid_sql('c', 11, 11)} GROUP BY ALL)
SELECT s.o_orderkey, coalesce(string_agg(c, ',' ORDER BY i), '') AS found, coalesce(min_by(c, i), any_value(s.s)) AS field FROM s LEFT JOIN f USING (o_orderkey) GROUP BY s.o_orderkey""")
def cpf_find(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(checks.find_cpfs(_long()), ",").alias("found"), checks.cpf_field(_long()).alias("field"))


@query(f"""
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'X AB' WHEN 1 THEN 'ab' WHEN 2 THEN 'CAT  D1 x' ELSE o_orderpriority END AS s FROM orders),
k AS (SELECT o_orderkey, list_filter(string_split(lower({_collapsed("trim(regexp_replace(s, '[^A-Z0-9 ]', '', 'g'), ' ')")}), ' '), lambda x: x IN ({', '.join(map(quoted, checks.CATEGORIES))})) AS l FROM s)
SELECT o_orderkey, coalesce(upper(l[len(l)]), '') AS category FROM k""")
def licence_category(spark, d):
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, "X AB").when(k == 1, "ab").when(k == 2, "CAT  D1 x").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", checks.category_field(s).alias("category"))


# --- similarity

_NEIGHBOURS = "SELECT x.p_partkey AS id, x.p_name AS a, y.p_name AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1"


def _neighbours(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    return part.join(other, "p_partkey").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), "b")


@query(f"WITH {lcs_cte(_NEIGHBOURS)} SELECT id, lcs, length(a) + length(b) - 2 * lcs AS error, round(200.0 * lcs / (length(a) + length(b)), 6) AS ratio FROM lcs")
def indel(spark, d):
    a, b = F.col("a"), F.col("b")
    return _neighbours(spark, d).select("id", similarity.lcs(a, b).alias("lcs"), similarity.indel_error(a, b).cast("long").alias("error"), F.round(similarity.indel_ratio(a, b), 6).alias("ratio"))


@query(f"""WITH {lcs_cte(_NEIGHBOURS)}
SELECT id, round(2.0 * lcs / (length(a) + length(b)), 6) AS both_rate, round(1.0 * lcs / length(a), 6) AS first_rate, round(1.0 * lcs / length(b), 6) AS second_rate,
  round(CASE WHEN a = b THEN 1.0 WHEN lcs = length(a) THEN 0.999 ELSE 1.0 * lcs / length(a) END, 6) AS capped FROM lcs""")
def lcs_rates(spark, d):
    a, b = F.col("a"), F.col("b")
    common = F.col("common")  # counted once for all rates
    rates = [F.round(similarity.lcs_rate(a, b, p, common)["rate"], 6).alias(n) for p, n in ((None, "both_rate"), (1, "first_rate"), (2, "second_rate"))]
    rows = _neighbours(spark, d).withColumn("common", similarity.lcs(a, b))
    return rows.select("id", *rates, F.round(similarity.capped_rate(a, b, common), 6).alias("capped"))


_WORD_PAIRS = "SELECT row_number() OVER (ORDER BY u, v) AS id, u AS a, v AS b FROM (SELECT DISTINCT u, v FROM f JOIN m USING (id))"


@query(f"""
WITH RECURSIVE s AS (SELECT id, string_split(lower(a), ' ') AS x, string_split(lower(b), ' ') AS y FROM ({_NEIGHBOURS})),
f AS (SELECT id, unnest(CASE WHEN len(x) < len(y) THEN x ELSE y END) AS u, unnest(range(0, least(len(x), len(y)))) AS i FROM s), m AS (SELECT id, unnest(CASE WHEN len(x) < len(y) THEN y ELSE x END) AS v FROM s),
{lcs_cte(_WORD_PAIRS).replace("RECURSIVE ", "")},
b AS (SELECT f.id, i, max(2.0 * lcs / (length(a) + length(b))) AS best FROM f JOIN m ON m.id = f.id JOIN lcs ON a = u AND b = v GROUP BY ALL)
SELECT id, round(avg(best), 6) AS similarity FROM b GROUP BY 1""")
def word_similarity(spark, d):
    return _neighbours(spark, d).select("id", F.round(similarity.word_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query()
def block_rate(spark, d):
    rate = similarity.block_rate("a", "b")
    return _neighbours(spark, d).withColumn("rate", rate).select("id", F.round("rate", 6).alias("rate"), similarity.match_label(F.col("rate")).alias("label"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN r = 1 THEN 'equal' WHEN r >= 0.9995 THEN 'full' WHEN r >= 0.75 THEN 'high' WHEN r >= 0.5 THEN 'half' WHEN r >= 0.125 THEN 'low' ELSE 'none' END AS label
FROM (SELECT *, l_quantity / 50.0 AS r FROM lineitem)""")
def match_label(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", similarity.match_label(F.col("l_quantity") / 50.0).alias("label"))


@query("""
WITH c AS (SELECT p_partkey, unnest(string_split(p_name, '')) AS ch FROM part), n AS (SELECT p_partkey, ch, count(*) AS n FROM c GROUP BY ALL),
p AS (SELECT p_partkey, n / sum(n) OVER (PARTITION BY p_partkey) AS p FROM n)
SELECT p_partkey, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY 1""")
def entropy(spark, d):
    from fieldlens.operators.metrics import text_entropy

    return text_entropy(table(spark, d, "part"), "p_partkey", "p_name").select("p_partkey", F.round("entropy", 6).alias("entropy"))
