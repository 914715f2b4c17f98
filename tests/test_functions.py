"""Vectors worked out by hand, and properties."""

import datetime
import difflib
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldlens.functions import checks, geometry, similarity, text
from fieldlens.operators import boxes, classify, metrics, resolve, spell
from fieldlens.sources import readers, writers
from fieldlens.streaming import latency


def values(spark, expr, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, s {kind}")
    return [r.v for r in df.select("i", expr(F.col("s")).alias("v")).orderBy("i").collect()]


DATES = {
    "12/07/1990": "12/07/1990", "12-07-1990": "12/07/1990", "01/JAN/2020": "01/01/2020", "01-jan-2020": "01/00/2020", "l2/07/1990": "12/07/1990", "2O/O7/199O": "02/07/0199",
    "12071990": "12/07/1990", "12/07/90": "12/07/0090", "12707/1990": "12/07/1990", "07/1990": "00/00/1990", "08/1990": "00/08/1990", "1271990": "01/27/1990", "": "00/00/0000",
}


def test_dates(spark):
    assert values(spark, text.recognised_date, list(DATES)) == list(DATES.values())
    assert values(spark, lambda s: text.recognised_date(s, strict=True), ["31/02/2020", "28/02/2020"]) == [None, "28/02/2020"]
    assert values(spark, lambda y: text.rounded_year(y, 2024), [90, 10, 74, 73], "int") == [1990, 2010, 1974, 2073]


def test_folding(spark):
    assert values(spark, text.fold, ["ÁB|Ø", "ção\tã", "ªº°", "Ω"]) == ["aBl0", "cao a", "ªºº", "Ω"]
    assert values(spark, text.fold_strict, ["Sã9o", "D'Á"]) == ["sa o", "d'a"]
    assert values(spark, text.collapse, ["a   b ", "a\t\tb"]) == ["a b ", "a\t\tb"]
    once = values(spark, lambda s: text.normal_ocr(s), ["  a \n\r b  c "])
    assert once == ["a b c"] and values(spark, text.normal_ocr, once) == once
    assert values(spark, text.dictionary_word, ["D' Água  9"]) == ["d agua"]
    assert values(spark, text.drop_one_word_line, ["one\ntwo three", "one two\nthree", "one"]) == ["two three", "one two\nthree", "one"]
    assert values(spark, text.distinct_chars, ["banana"]) == ["ban"]
    assert values(spark, text.title_words, ["identidade_cnh", "x"]) == [["DOC", "IDENTIDADE", "ORG", "EMISSOR", "UF"], []]


def test_tokens_and_phrases(spark):
    assert values(spark, text.identity_tokens, ["12.3-ab/SP x^y9"]) == [["12", ".", "3", "-", "ab", "/", "SP ", "x", "^y9"]]
    for s in ("a  b, c-", " --x y", "", "...", "é ü 9"):
        assert [(p.words, p.separator) for p in values(spark, text.phrases, [s])[0]] == spell.split_phrases(s)


def test_check_digits(spark):
    assert values(spark, checks.cpf_valid, ["00000000000", "12345678909", "12345678900", "1234567890x", ""]) == [True, True, False, False, False]
    assert values(spark, checks.cnpj_valid, ["11222333000181", "11222333000180"]) == [True, False]
    assert values(spark, lambda s: checks.check_digit(s, 0, 8, 11), ["123456789", "12345678x"]) == ["0", ""]
    assert values(spark, checks.find_cpfs, ["x12345678909y12345678909"]) == [["12345678909"]]
    assert values(spark, checks.cpf_field, ["CPF 123.456.789-09", "12 34", "ab"]) == ["12345678909", "1234", ""]
    assert values(spark, checks.category_field, ["X AB", "ab", "B A1 zz"]) == ["AB", "", "A1"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_similarity(spark):
    r = random.Random(1)
    pairs = [("abc", "abc"), ("abcd", "abxd"), ("", ""), ("", "a")] + [("".join(r.choice("abcdé ") for _ in range(r.randint(0, n))), "".join(r.choice("abcdé ") for _ in range(r.randint(0, n)))) for n in (8, 30, 61, 62, 90) for _ in range(12)]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", similarity.lcs(a, b).alias("n"), similarity.lcs(b, a).alias("m"), similarity.indel_ratio(a, b).alias("ratio"), similarity.lcs_rate(a, b).alias("both"), similarity.capped_rate(a, b).alias("cap"), similarity.block_rate(a, b).alias("block")).collect()
    for x in rows:
        assert x.n == x.m == lcs(x.a, x.b)
        assert 0 <= x.ratio <= 100 and (x.cap == 1) == (x.a == x.b)
        if x.a and x.a != x.b:
            common = sum(m.size for m in difflib.SequenceMatcher(None, x.a, x.b).get_matching_blocks())
            assert x.block == common / len(x.a) if common < len(x.a) else 0.9995 <= x.block < 1
    assert rows[1].both.rate == 6 / 8 and rows[1].both.error == 2 and rows[2].both.rate is None
    assert similarity.block_rate_of("", "ab") == 0.9997 and similarity.block_rate_of("", "abc") == 0.9996 and similarity.block_rate_of("a b", "ab") == 2 / 3


def test_geometry(spark):
    one = spark.range(1)
    b = geometry.box(F.lit(-5), F.lit(0), F.lit(20), F.lit(10))
    x = one.select(geometry.clipped(b, 100, 100).alias("c"), geometry.trimmed(b, 100, 100).alias("t")).first()
    assert (x.c.x_min, x.c.width, x.t.x_min, x.t.width) == (0, 15, 0, 20)
    assert values(spark, geometry.snapped, [1.9, 91.0, 270.0, -179.0, 2.0], "double") == [0, 90, -90, 180, 2]
    label = geometry.parsed_label(F.col("s"))
    assert values(spark, lambda s: label, ["3 0.5 0,5 0.2 0.2", "0.1 0.2 0.3 0.4", "x", "1 2 3"])[0].cls == 3
    r = geometry.label_of(geometry.rect_of(label))
    out = values(spark, lambda s: F.when(label.isNotNull(), geometry.printed_label(label["cls"], r)), ["3 0.5 0.5 0.2 0.25", "bad"])
    assert out == ["3 0.50000000 0.50000000 0.20000000 0.25000000", None]


def test_boxes(spark):
    bands = boxes.text_bands(spark.createDataFrame([(1, 0, 10), (1, 5, 25), (1, 20, 30), (2, 0, 10), (2, 10, 20)], "file int, y1 int, y2 int"))
    assert {tuple(x) for x in bands.collect()} == {(1, 0, 30, 15), (2, 0, 10, 5), (2, 10, 20, 15)}
    heights = spark.createDataFrame([(1, 100), (2, 24), (3, 50)], "file int, height int")
    assert {tuple(x) for x in boxes.half_cuts(bands, heights).collect()} == {(1, 32, 32), (2, 12, 8), (3, 25, 25)}
    r = random.Random(2)
    rows = [(str(i % 5), 0, r.uniform(0.85, 1), r.randint(0, 50), r.randint(0, 50), 20, 20) for i in range(200)]
    kept = boxes.suppressed(spark.createDataFrame(rows, "file string, class_index int, score double, x_min int, y_min int, width int, height int")).collect()
    for p in kept:
        for q in kept:
            if p.file == q.file and p.nms_rank < q.nms_rank:
                w, h = (max(0, 20 - abs(p[c] - q[c])) for c in ("x_min", "y_min"))
                assert p.score > 0.9 and w * h / (800 - w * h) <= 0.3


def test_families(spark):
    rows = [(1, "nome_cnh"), (1, "cpf_cnh"), (2, "nome_cnh"), (2, "cpf_rg"), (3, "cnh"), (3, "cpf_rg")]
    out = classify.families(spark.createDataFrame(rows, "file int, obj_name string")).collect()
    assert {r.file: r.family for r in out} == {1: "cnh", 2: None, 3: "cnh"}
    assert [p[:2] for p in classify.alignment_pairs()][:2] == [("cnh", 0), ("cnh", 1)] and classify.alignment_pairs()[1][2:] == ("registro_cnh", "pri_habilitacao_cnh")


def test_spelling(spark):
    speller = spell.Speller({"paralelepipedo": 5, "maria": 9, "silva": 7, "nome": 3})
    assert speller.joined(["Paralelep", "ipedo", "x"]) == ({"X"}, ["PARALELEPIPEDO", "X"])
    assert spell.adjusted("NOME: maria silwa", speller, titles=("NOME",)) == ": MARIA SILVA"
    assert spell.adjusted("de ab MARIA", speller, correct=False, strip_short=True) == "MARIA"
    assert spell.adjusted("foo 12 maria", speller, correct=False, numeric_first=True) == "FOO 12 MARIA"
    assert spell.corrected("maris, silva", speller) == "MARIA, SILVA"
    assert spell.edits("kitten", "sitting", 3) == 3 and spell.edits("a", "bcdef", 2) == 3


def test_identity():
    issuers, states = {"ssp": 0, "detran": 1}, {"sp", "rj"}
    assert spell.identity("12345 SSP SP", issuers, states) == "12345 SSP SP"
    assert spell.identity("doc 123.456-7 8sp/sp xx", issuers, states) == "123456-7 SSP/SP"
    assert spell.identity("1234567 detrn rj", issuers, states) == "1234567 DETRAN RJ"
    assert spell.identity("abc", {}, set()) == "ABC"


def test_cities(spark):
    towns = spark.createDataFrame([(0, "santos sp"), (1, "sao paulo sp"), (2, "rio de janeiro rj")], "pos int, city_uf string")
    states = spark.createDataFrame([("sp", "sao paulo"), ("rj", "rio de janeiro")], "uf string, name string")
    asked = spark.createDataFrame([("Sant0s",), ("S. Paulo",), ("santos sp",), ("",)], "text string")
    out = {r.text: r.city for r in resolve.cities(asked, towns, states).collect()}
    assert out["Sant0s"] == out["santos sp"] == "SANTOS, SP" and out["S. Paulo"] == "SAO PAULO, SP" and out[""] == ""


def test_strict_date_of_every_form(spark, tmp_path):
    """All six misread forms are answered; by the rule only the first one is a date."""
    from fieldlens.plans import catalog

    rows = [(k, datetime.date(1992 + k % 7, k % 12 + 1, k % 28 + 1)) for k in range(600)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    out = {r.o_orderkey: r.day for r in catalog.queries()["strict_date_all"](spark, str(tmp_path)).collect()}
    assert out == {k: day.isoformat() if k % 6 == 0 else None for k, day in rows}


def test_combinations_of_whole_names(spark, tmp_path):
    from itertools import combinations

    from fieldlens.plans import catalog

    names = ["NATION_17", "ab", "abcde"]
    spark.createDataFrame(list(enumerate(names)), "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    out = {r.n_nationkey: r.pairs for r in catalog.queries()["combinations_whole"](spark, str(tmp_path)).collect()}
    assert out == {i: ",".join(a + b for a, b in combinations(s, 2)) for i, s in enumerate(names)}


def test_timers(spark):
    marks = [(1, "a", t, m) for t, m in (("2020-01-01 00:00:00", "start"), ("2020-01-01 00:00:01", "start"), ("2020-01-01 00:00:03", "end"), ("2020-01-01 00:00:09", "end"))]
    df = spark.createDataFrame(marks, "request int, clock string, ts string, mark string").withColumn("ts", F.to_timestamp("ts"))
    assert [tuple(r) for r in metrics.timers(df).collect()] == [(1, "a", 3_000_000, 1)]


def test_round_trips(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"Nome": "Ana \\"x\\"", "tipo_doc": "cnh"}')
    (tmp_path / "b.json").write_text("not json")
    truth = readers.ground_truth(spark, str(tmp_path / "*.json")).collect()
    assert [(r.field, r.expected, r.doc_type) for r in truth] == [("nome", 'Ana "x"', "cnh")]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "x.txt").write_text("1 0.5 0.5 0.1 0.1\n\n")
    (tmp_path / "labels" / "y.txt").write_text("1 0.5 0.5 0.1 0.1\nbad\n")
    good, bad = readers.label_files(spark, str(tmp_path / "labels"))
    assert good.count() == 1 and bad.first().file.endswith("y.txt")
    (tmp_path / "k.csv").write_text("uf,h\nsp,1\nrj,2\nsp,3\n")
    assert {r.key: r.h for r in readers.keyed_csv(spark, str(tmp_path / "k.csv"), "uf").collect()} == {"sp": "3", "rj": "2"}
    assert readers.lines(spark, str(tmp_path / "missing.txt")).count() == 0
    assert values(spark, lambda s: readers.decoded_body(s), ["aGk=", "%%%"])[1].error == 404
    (tmp_path / "p.png").write_bytes(b"1")
    (tmp_path / "q.txt").write_bytes(b"1")
    assert readers.images(spark, str(tmp_path)).count() == 1
    words = spark.createDataFrame([("bb",), ("a",), ("aa",)], "word string")
    writers.write_words(words, str(tmp_path / "words"))
    parts = sorted((tmp_path / "words").glob("part-*.txt"))
    assert "".join(p.read_text() for p in parts) == "a\naa\nbb\n"
    made = spark.range(1).select(writers.truth_json(F.create_map(F.lit("nome"), F.lit('a"b')), F.lit("cnh")).alias("j")).first().j
    assert made == '{"tipo_doc":"cnh","nome":"A\\"B"}'


def test_stream(spark, tmp_path):
    pd.DataFrame({"ts": pd.to_datetime(["2020-01-01 00:10", "2020-01-01 00:20", "2020-01-01 02:00"]), "event_type": ["a", "a", "b"], "value": [1.0, 2.0, 3.0]}).to_parquet(tmp_path / "e.parquet", coerce_timestamps="us")
    events = latency.read_events(spark, str(tmp_path), "ts timestamp_ntz, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    q = latency.windowed(events).writeStream.outputMode("complete").format("memory").queryName("lat").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.event_type, r.n, r.total) for r in spark.table("lat").collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}


def test_folding_by_independent_vectors(spark):
    """Characters by their numbers, with what they must fold to; some stay."""
    want = {490: "q", 493: "q", 696: "y", 1236: "e", 1237: "e", 8340: "d", 124: "l", 176: "º", 163: "e", 216: "0", 223: "b", 305: "i", 399: "d", 461: "a", 570: "a", 572: "e", 913: "a", 919: "h", 951: "n", 962: "c",
            1041: "b", 1061: "x", 1094: "4", 1276: "x", 7869: "e", 8058: "p", 8088: "h", 8096: "w", 8308: "4", 8341: "h", 8722: "-", 203: "e", 241: "n", 336: "o", 376: "y"}
    want |= {c: chr(c) for c in (982, 1008, 1009, 1012, 383, 452, 497, 912, 937, 65, 170, 186)}
    assert values(spark, text.fold, [chr(c) for c in want]) == list(want.values())


def test_numbers_are_known_words():
    speller = spell.Speller({"de": 5, "abc": 1, "da": 3})
    assert spell.adjusted("12 abc 12345", speller) == "12 ABC 12345"
    # a title goes if the word is it and known, or if it is among an unknown word's candidates
    assert spell.adjusted("doc 123 dx", speller, correct=False, titles=("DOC",)) == "DOC 123 DX"
    assert spell.adjusted("d 123 abc", speller, correct=False, titles=("ABC", "DE")) == "123"
    assert speller.knows("1e5") and speller.knows("-") and speller.knows("x" * 10) and not speller.knows("abd")
    assert speller.candidates("db") == ["de", "da"] and speller.candidates("abcde") == ["abc"] and speller.candidates("zzzz") == []


def test_candidates_by_shortened_words(spark):
    import random

    r = random.Random(1)
    known = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(150)})
    asked = sorted({"".join(r.choice("abc") for _ in range(r.randint(0, 8))) for _ in range(60)})
    out = spell.candidate_words(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame([(w, 1) for w in known], "word string, count long")).collect()
    want = {(a, k, spell.edits(a, k, 2)) for a in asked for k in known if spell.edits(a, k, 2) <= 2 and a not in known} | {(a, a, 0) for a in asked if a in known}
    assert {(x.word, x.candidate, x.edits) for x in out} == want and len(out) == len(want)


def test_whole_correction(spark):
    from fieldlens.operators.adjust import adjust

    def rows(schema, *values_):
        return spark.createDataFrame(list(values_), schema)

    fields = rows(
        "id int, family string, obj_name string, ocr_text string",
        (0, "cnh", "nome_cnh", "NOME x maria da silvb 12"), (1, "cnh", "filiacao_cnh", "maria\nsilva\nrest"), (2, "cnh", "identidade_cnh", "DOC 12345 ssp/sp"), (3, "cnh", "local_emissao_cnh", "LOCAL campinaz sp"),
        (4, "cnh", "observacao_cnh", "OBSERVACOES maria"), (5, "rg", "cabecalho_rg", "republica de nadia"), (6, "cnh", "registro_cnh", "1 2x3"), (7, "cnh", "cnh", "what"), (8, "cnh", "nome_cnh", None),
    )
    words = rows("word string, count long", ("maria", 5), ("silva", 4), ("da", 9), ("nome", 1))
    out = adjust(
        fields, words, rows("pos int, city_uf string", (0, "campinas sp"), (1, "santos sp")), rows("uf string, name string", ("sp", "sao paulo")), rows("pos int, code string", (0, "ssp"), (1, "detran")),
        rows("pos int, header string, detail1 string, detail2 string", (0, "republica de nada", "nada", "")),
    )
    got = {r.id: r.adjusted for r in out.collect()}
    assert got == {0: "MARIA DA SILVA", 1: "MARIA\nSILVA", 2: "12345 SSP/SP", 3: "CAMPINAS, SP", 4: "MARIA", 5: "REPUBLICA DE NADA", 6: "123", 7: "", 8: ""}


def test_only_row_needs_one(spark):
    rows = spark.range(5)
    assert resolve.only_row(rows, F.col("id") == 3).collect()[0].id == 3
    for condition in (F.col("id") > 2, F.col("id") > 9):
        with pytest.raises(Exception, match="exactly one"):
            resolve.only_row(rows, condition).collect()


def test_preprocessing_kinds(spark):
    row = spark.createDataFrame([("3", [1, 4], "x")], "a string, b array<int>, c string")
    assert row.select(classify.preproc_kinds(F.col("a")).alias("a"), classify.preproc_kinds(F.col("b"), True).alias("b")).first() == ([1, 2], [1, 4])
    with pytest.raises(Exception, match="number or a list"):
        row.select(classify.preproc_kinds(F.col("c"))).collect()


def test_colours_hold_each_once(spark):
    found = spark.range(1).select(F.explode(geometry.colours(2)).alias("c")).select("c.*").collect()
    assert len(set(found)) == len(found) == 64 and {r.r for r in found} == {0, 8, 128, 136}
