"""The pipeline against a brute-force version over planted documents."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from fieldlens.llm import toxicity
from fieldlens.llm.common import Scratch


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(500)]
    docs, labels = [], []
    for i in range(400):
        text = [r.choice(words) for _ in range(r.randint(30, 90))]
        toxic = int(i % 8 == 0)
        if toxic:
            text[3] = r.choice(["vileword", "vilething"])
        docs.append((i, " ".join(text), "en", f"s{i % 3}" if i % 2 else "hot", 0))
        labels.append((i, 1, toxic))
    for i in range(400, 420):  # copies, near copies, odd ones
        text = docs[i - 395][1]
        docs.append((i, text + " \n" if i < 410 else text.replace(" ", " x ", 1), "en", "s1", 0))
    docs += [(420, None, "en", None, 0), (421, "", "en", "s1", 0), (422, docs[5][1], "en", "s2", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def test_stages(spark, tables):
    from tests.llm.test_operators import near

    path, docs = tables
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "mixing", "packing"]
    scratch = Scratch(spark, "test")
    current, kept = spark.read.parquet(f"{path}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, path)
        if i < 4:
            assert out.columns == current.columns
        current = scratch.save(out, f"stage{i}")
        kept.append(current.collect())
    all_scores = toxicity.score(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")).collect()
    toxic = {r.doc_id for r in all_scores if r.predicted}
    assert {r.doc_id for r in kept[0]} == {d[0] for d in docs} - toxic and toxic

    groups = defaultdict(list)
    for r in kept[0]:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append((-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in kept[1]} == {min(g)[1] for g in groups.values()}

    rows = [(r.doc_id, r.text) for r in kept[1]]
    assert {r.doc_id for r in kept[2]} == {c for _, _, c in near(rows)}

    sizes, taken, source = Counter(), Counter(), {}
    for r in kept[2]:
        sizes[r.source] += len((r.text or "").split())
        source[r.doc_id] = r.source
    for r in kept[3]:
        taken[source[r.doc_id]] += len((r.text or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    total, weights = sum(sizes.values()), {s: [1, 2, 3][i % 3] for i, s in enumerate(order)}
    over = {s for s in order if total * weights[s] / sum(weights.values()) > 3 * sizes[s]}
    for s in order:
        share = 3 * sizes[s] if s in over else (total - sum(3 * sizes[x] for x in over)) * weights[s] / sum(weights[x] for x in order if x not in over)
        assert abs(taken[s] - share) <= 90  # a document
    assert all(n <= 3 for n in Counter(r.doc_id for r in kept[3]).values())

    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in kept[3]:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 1024):
            part = ids[s : s + 1024]
            want[(r.doc_id, s, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in kept[4]) == want
    assert Counter((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, path).collect()) == Counter((k[0], k[1], k[2]) for k in want.elements())


def test_executors_rest_in_every_stage(spark, tables, monkeypatch):
    """Heaps that one stage has grown are given back before the next one's Python workers grow."""
    from pyspark.sql import DataFrameWriter

    rested = []
    save = DataFrameWriter.save
    monkeypatch.setattr(DataFrameWriter, "save", lambda self, *a, **b: (rested.append(self._df.columns), save(self, *a, **b))[1])
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").where("doc_id < 60")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tables[0])
        assert len(rested) == i + 1
    assert rested == [["done"]] * 5
