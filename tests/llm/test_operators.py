"""Each operator against a brute-force version on small documents with every odd case."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from fieldlens.llm import block_naming, compression, fingerprints, mixing, ngram_join, packing, repeats, reply_trees, sharding, toxicity
from fieldlens.llm.common import Scratch, rest_executors
from fieldlens.llm.labels import sample

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, name string, size long, key string, `_bucket` int, `_id` long, a string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(5)
    words = ["".join(r.choice("aeioumnrst") for _ in range(r.randint(2, 7))) for _ in range(300)]

    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))

    base, passage = prose(120), prose(90)
    near = base.split(" ")
    near[60] = "edited"
    chain = base.split(" ")
    for i in (60, 5, 30):
        chain[i] = "other"
    out = [base, base, " ".join(near), " ".join(chain), base + "  \n", prose(40) + passage + prose(30), passage + prose(50), prose(20) + passage]
    out += [None, "", "   \n\t", "one", "one two", "Ünïcode ñandú " * 3, "x" * 3000, "ab " * 900, prose(4000), prose(7), "<|im_end|> ok <|| <|"]
    out += [prose(r.randint(1, 200)) for _ in range(40)]
    return out


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", [None, "s1", "s2", "S3"][i % 4] if i % 3 else "hot", 1, 7, "n", 9, "k", 3, 4, "a") for i, t in enumerate(texts())]
    return out + [out[0], out[20], (None, "no id here at all, really none", "en", "s1", 1, 7, "n", 9, "k", 3, 4, "a")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df, *keys):
    return Counter(tuple(r[k] for k in keys) for r in df.collect())


def test_fingerprints(docs, none, rows):
    assert fingerprints.fingerprint(none).count() == 0
    out = fingerprints.fingerprint(docs, rows_per_bucket=1).collect()
    order = sorted(((d if d is not None else -(2**63), t or "") for d, t, *_ in rows), key=lambda x: (-x[0], -xx(x[1].encode()), x[1]))
    want = Counter()
    for i, (d, t) in enumerate(order):
        nxt, half = order[(i + 1) % len(order)][1], len(t) // 2
        want[(d if d > -(2**63) else None, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == want
    prints = {}
    for r in out:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.doc_id, r)
    assert prints[0].fingerprint == prints[1].fingerprint == prints[4].fingerprint  # words count, not white space
    assert prints[16].near_edited > 0.3 and prints[16].near_next < 0.1
    for d, t, *_ in rows:
        if d not in (0, 20):
            assert (prints[d].fingerprint, prints[d].places) == by_hand(t or "")


def xx(data: bytes, seed: int = 42) -> int:
    """Spark's xxhash64 of one value; a long is its 8 bytes, a further value takes the hash as its seed."""
    h = xxhash.xxh64(data, seed % 2**64).intdigest()
    return h - 2**64 if h >= 2**63 else h


def by_hand(text: str) -> tuple[str, str]:
    """Fingerprint and places of closed syncmers: of four units those whose middle pair is not the least of their three."""
    units = []
    for word in WORD.findall(text):
        units += [word] if len(word) <= 16 else list(word)

    def both(a: int, b: int) -> int:
        return xx(struct.pack("<q", b), xx(struct.pack("<q", a)))

    hashes = [xx(u.encode()) for u in units]
    pairs = [both(a, b) for a, b in zip(hashes, hashes[1:])]
    found = [(both(pairs[i], pairs[i + 2]) % 2**32, i) for i in range(len(units) - 3) if min(pairs[i], pairs[i + 2]) <= pairs[i + 1]]
    if len(units) < 16:
        found += [(h % 2**32, i) for i, h in enumerate(hashes)] or [(0, 0)]
    chosen = sorted(found)[:64]
    chosen.sort(key=lambda x: (x[1], x[0]))
    return "".join(f"{h:08x}" for h, _ in chosen), " ".join(str(i) for _, i in chosen)


def test_syncmers_are_context_free(spark):
    r = random.Random(1)
    words = [str(r.random())[:12] for _ in range(80)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[30:70])), (3, "a b")], "i int, t string")
    a, b, c = [{x >> 31 for x in x.h} for x in fingerprints.with_anchors(rows, "t", "h").orderBy("i").collect()]
    assert b <= a and len(b) > 20 and len(c) == 2


def test_fingerprints_of_unspaced_and_very_long_texts(spark):
    r = random.Random(2)
    plain = "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(4000))
    long = " ".join(str(r.random()) for _ in range(30_000))
    rows = [(4, plain), (3, plain[:2000] + "x" + plain[2000:]), (2, long), (1, "y" * 50_000)]
    out = {x.doc_id: x for x in fingerprints.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[4].near_next > 0.9 and out[4].near_edited > 0.3 and out[2].near_edited > 0.3 > out[2].near_next
    for d, t in rows:
        assert (out[d].fingerprint, out[d].places) == by_hand(t) and len(out[d].fingerprint) <= 8 * 64


def test_buckets_of_any_ids(spark):
    """One id on a third of all rows, ids in far runs, the least and the largest: no bucket holds many rows, order stays."""
    r = random.Random(3)
    ids = [7] * 1000 + [(p << 33) + i for p in range(4) for i in range(500)] + [-(2**63) + 1, 2**63 - 1]
    rows = [(i, str(r.random())) for i in ids]
    out = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string"), rows_per_bucket=50).where("not ghost").collect()
    assert max(Counter(x.bucket for x in out).values()) < 200
    ordered = sorted(out, key=lambda x: (x.bucket, x.doc_id, x.turned))
    assert [(x.doc_id, x.turned) for x in ordered] == sorted((x.doc_id, x.turned) for x in out)


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_dedup(docs, none, rows, block):
    assert block_naming.dedup(none).count() == 0
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d))
    want = Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        for i, m in enumerate(sorted(members, key=lambda m: (m[0], m[1], m[2] or 0))):
            want[(m[2], best[2], len(members), i == 0, hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert got(block_naming.dedup(docs, block), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    kept = block_naming.unique_documents(docs, block)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_packing(docs, none, rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    assert packing.pack(none, path).count() == 0
    out = packing.pack(docs, path, capacity=64).collect()
    want = Counter()
    for d, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for s in range(0, len(ids), 64):
            part = ids[s : s + 64]
            want[(d, s, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_word_encoder_is_the_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    t, encode = Tokenizer.from_file(path), packing.WordEncoder(path)
    odd = ["a  b", "a\n b", " a", "a ", "a<|endoftext|>b", "a   b\n\n c", "don't  ' s", "x  y", "ß.Ω,9", "end.\nNext, word", "é", "a\tb c", "1.5 x.y", "  q"]
    for s in odd + [x for x in texts() if x]:
        assert encode(s) == b"".join(i.to_bytes(4, "little") for i in t.encode(s, add_special_tokens=False).ids), s


def test_encoder_of_another_kind_of_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    t, encode = Tokenizer.from_file(path), packing.WordEncoder(path)
    assert not encode.by_word
    for s in ["a  b", "Ärger, 12.5\n x", *[x for x in texts() if x][:20]]:
        assert encode(s) == b"".join(i.to_bytes(4, "little") for i in t.encode(s, add_special_tokens=False).ids)


def test_packs_have_little_padding():
    r = random.Random(8)
    histogram = Counter(min(1023, int(r.lognormvariate(5, 1)) + 1) for _ in range(5000))
    tokens = sum(length * n for length, n in histogram.items())
    packs = sum(n for n, _ in packing.shortest_pack_first(histogram, 1024))
    assert tokens <= packs * 1024 < 1.03 * tokens


def test_shortest_pack_first():
    r = random.Random(3)
    for _ in range(20):
        histogram = {n: r.randint(1, 500) for n in r.sample(range(1, 256), r.randint(1, 200))}
        patterns = packing.shortest_pack_first(histogram, 256)
        held = Counter()
        for n, pattern in patterns:
            assert sum(pattern) <= 256
            for length in pattern:
                held[length] += n
        assert held == histogram
    assert packing.shortest_pack_first({}, 8) == []


def test_reply_trees(spark):
    rows = [(1, 1, None, 1.0, "user", "q"), (1, 2, 1, 0.2, "assistant", "bad"), (1, 3, 1, 0.9, "assistant", "good"), (1, 4, 3, 0.5, "user", "more"), (1, 5, 4, 0.5, "assistant", "end")]
    rows += [(2, 1, 2, 1.0, "user", "cycle"), (2, 2, 1, 1.0, "user", "cycle"), (3, 1, 99, None, None, None)] + [(4, i, i - 1 if i else None, 1.0, "user", str(i)) for i in range(70)]
    m = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    best = {r.tree: r for r in reply_trees.formatted(m, Scratch(spark, "t")).collect()}
    assert set(best) == {1, 3, 4} and best[1].leaf == 5 and best[4].leaf == 69
    assert [x.strip() for x in re.findall(r"\n(\d+)<", best[4].text)] == [str(i) for i in range(70)]
    every = {(r.tree, r.leaf) for r in reply_trees.formatted(m, Scratch(spark, "t"), branches=5).collect()}
    assert every == {(1, 2), (1, 5), (3, 1), (4, 69)}


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "hi <|im_start|>user\n"), (1, 1, "assistant", reply_trees.PROBE), (1, 2, "assistant", "<"), (2, None, None, None), (2, 5, "assistant", "<|| <||| |>"), (2, 5, "assistant", "<|| <||| |>"), (None, 1, "sys tem\n", "x<|im_end|>")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, extra int")
    out = {r.conv_id: r for r in reply_trees.digests(df).collect()}
    for conv in (1, 2, None):
        mine = sorted(((t[1] is None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        learnt = "".join(t[3] for t in mine if t[2] == "assistant")
        assert out[conv].n_turns == len(mine)
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in mine).encode()).hexdigest()
        assert (out[conv].loss_chars, out[conv].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert reply_trees.digests(df.limit(0)).count() == 0


def test_sharding(docs, none, rows):
    assert sharding.shard(none, [1.0] * 4).count() == 0
    out = sharding.shard(docs, [1.0] * 16, [1.0] * 17, rows_per_bucket=5).collect()
    want = Counter((d, len((t or "").encode()) + (t is not None) if t is not None else 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_winners(spark):
    """The lowest -ln(u) / weight wins, u being 13 hex digits of an MD5."""
    weights = [1.0, 2.5, 0.5, 1.0]

    def winner(key: str, n: int) -> int:
        return min(range(n), key=lambda i: (-math.log((int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / weights[i], i))

    rows = [(i, "x") for i in range(-50, 400)] + [(None, "y")]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), weights[:3], weights).collect()
    for r in out:
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (winner(key, 3), winner(key, 4))


def test_sharding_follows_weights(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    n = Counter(r.s for r in ids.select(sharding.rendezvous(F.col("doc_id"), [1.0, 3.0]).alias("s")).collect())
    assert 2850 < n[1] < 3150


def removed(rows, length=400):
    at = Counter()
    data = [(t or "").encode() for _, t, *_ in rows]
    for b in data:
        at.update(b[i : i + length] for i in range(len(b) - length + 1))
    for (d, *_), b in zip(rows, data):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if at[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        yield d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()


def test_repeats(docs, none, rows):
    assert repeats.remove_repeats(none).count() == 0
    assert got(repeats.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(removed(rows))


def test_repeats_across_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 1000)
    r = random.Random(2)
    passage = "".join(r.choice("abcdef") for _ in range(2500))
    rows = [(i, "".join(r.choice("abcdef") for _ in range(r.randint(0, 1500))) + passage[a:b] + "".join(r.choice("uvw") for _ in range(700))) for i, (a, b) in enumerate([(0, 2500), (100, 2100), (1200, 1650), (300, 600), (0, 401)])]
    assert got(repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(removed(rows))


def near(rows):
    sets = []
    for d, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set(), d))
    group = {d: d for _, d in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (s, d) in enumerate(sets):
        for o, e in sets[:i]:
            if s and o and 100 * len(s & o) >= 80 * len(s | o) and find(d) != find(e):
                a, b = sorted((find(d), find(e)), key=lambda x: (x is not None, x or 0))
                group[b] = a
    return Counter((d, len(s), find(d)) for s, d in sets)


def test_near_duplicates(docs, none, rows):
    assert ngram_join.near_duplicates(none).count() == 0
    assert got(ngram_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == near(rows)
    kept = ngram_join.representatives(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in near(rows)}


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    """Copies of one text with edits of their own: far from each other, near to the original or to one another in chains."""
    monkeypatch.setattr(ngram_join, "RUN", 20)
    r = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        words = base[:] if i % 3 else rows[-1][1].split(" ")
        for _ in range(r.randint(0, 4)):
            words[r.randrange(150)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    r.shuffle(rows)
    assert got(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)), "doc_id", "n_shingles", "component_id") == near(rows)


def test_near_duplicates_of_few_words(spark):
    """Texts of 8 words and the same with one more: 4 shingles and 5, that share one posted token at least."""
    rows = []
    for i in range(150):
        words = [f"p{i}w{j}" for j in range(9)]
        rows += [(2 * i, " ".join(words[:8])), (2 * i + 1, " ".join(words))]
    want = near(rows)
    assert all(c % 2 == 0 for _, _, c in want)
    assert got(ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "doc_id", "n_shingles", "component_id") == want


def test_fewest_shared_is_a_lower_bound(spark):
    sizes = spark.range(1, 301).select(F.col("id").alias("n")).withColumn("m", F.explode(F.sequence(F.ceil(F.col("n") * 4 / F.lit(5)), F.floor(F.col("n") * 5 / F.lit(4)))))
    out = sizes.withColumn("shared", ngram_join.least_shared(F.col("n"), F.col("m"))).collect()
    for r in out:
        assert r["shared"] == ngram_join.shared_at_least(r["n"], r["m"])
        assert r["shared"] >= ngram_join.fewest_shared(r["n"])
    assert ngram_join.fewest_shared(4) == 1


def test_representatives_of_a_group_with_a_null_id(spark):
    base, other = ([f"{c}{i}" for i in range(80)] for c in "ab")
    rows = [(None, " ".join(base)), (None, " ".join(other)), (9, " ".join(f"c{i}" for i in range(80))), (10, ""), (11, None)]
    rows += [(i, " ".join([*(base if i < 6 else other), f"e{i}"])) for i in range(1, 9)]
    kept = ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(rows[:5])


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    out = ngram_join.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c").collect()
    assert {(r.node, r.root) for r in out} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100), (103, 100)}


def test_mixing(docs, none, rows):
    assert mixing.mix(none, [1.0, 2.0, 3.0]).count() == 0
    out = mixing.mix(docs, [1.0, 2.0, 3.0], rows_per_bucket=4).collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((d, len(WORD.findall(t or ""))) for d, t, *_ in rows)
    sizes, taken, goals = Counter(), Counter(), {}
    for r in out:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        goals[r.source] = r.target
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size >= r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights, capped = {s: [1.0, 2.0, 3.0][i % 3] for i, s in enumerate(order)}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: 3 * sizes[s] if s in capped else rest * weights[s] / sum(weights[x] for x in order if x not in capped) for s in order}
        over = {s for s in order if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert abs(goals[s] - share[s]) < 1e-6 and abs(taken[s] - share[s]) <= 1
    again = mixing.mix(docs.repartition(5), [1.0, 2.0, 3.0], rows_per_bucket=50_000)
    assert got(again, "doc_id", "taken") == Counter((r.doc_id, r.taken) for r in out)


def test_mixed_documents(docs):
    whole = {r.doc_id: r.taken // r["size"] if r["size"] else 1 for r in mixing._mixed(docs, [1.0, 2.0, 3.0], 3.0, True, "mix", 4)[0].where("doc_id not in (0, 20)").collect()}
    mixed = mixing.mixed_documents(docs, [1.0, 2.0, 3.0])
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.where("doc_id not in (0, 20)").collect()) == Counter({k: v for k, v in whole.items() if v})


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(900):
        text = [r.choice(words) for _ in range(r.randint(5, 80))]
        toxic, good = int(i % 9 == 0), int(i % 5 != 0)
        if toxic:
            text[r.randrange(len(text))] = r.choice(["nasty", "vilewords", "vilething"])
        if not good:
            text = [w + r.choice(["%%%", "$$$"]) for w in text]
        docs.append((i, " ".join(text), "x"))
        labels.append((i, good, toxic))
    docs += [(900, None, "x"), (901, "", "x"), (902, "z" * 50_000, "x"), (903, docs[0][1], "x"), (None, "what", "x")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4), spark.createDataFrame(labels + [(900, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score, label, divisor, left", [(toxicity.score, "toxic", 4, 2), (compression.score, "quality", 5, 0)])
def test_scores(labelled, score, label, divisor, left):
    docs, labels = labelled
    out = score(docs, labels).collect()
    assert len(out) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % divisor == left)
    held = [(truth[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert score(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in score(docs, labels.limit(0)).collect()} <= {0, 1}
    changed = labels.withColumn(label, F.when(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(divisor)) == left, 1 - F.col(label)).otherwise(F.col(label)))
    same = {(r.doc_id, r.score) for r in score(docs, changed).collect()}
    assert same == {(r.doc_id, r.score) for r in out}  # held-out labels teach nothing


def test_quality_is_the_calibrated_size_difference(labelled):
    """Scores worked out from the two dictionaries, piece by piece."""
    import zstandard

    docs, labels = labelled
    model = compression.train(*sample(docs, labels, "quality", 5, 0, compression.PER_CLASS, compression.CALIBRATION, compression.SAMPLE_BYTES))

    def size(text: str, dictionary: bytes) -> int:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))
        data = text.encode()
        return sum(len(packer.compress(data[i : i + 1024])) for i in range(0, len(data), 1024))

    for r in docs.join(compression.score(docs, labels).select("doc_id", F.col("score").alias("got")), "doc_id").limit(60).collect():
        if not r.text:
            assert r.got == 0.5
            continue
        good, bad = size(r.text, model.good), size(r.text, model.bad)
        share = math.log(min(good, bad) / len(r.text.encode()))
        x = sum(w * f for w, f in zip(model.weights, (1, 10 * (bad - good) / (bad + good), share, share**2)))
        assert r.got == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-9)
    lone = [x for x in (compression._features("word " * 400, [zstandard.ZstdCompressor(level=3)] * 2),)]
    assert lone[0][1] == 0  # equal dictionaries make no difference


def test_nearest_is_exact(labelled):
    """Cosines computed afresh from the examples' texts, all terms of both labels."""
    docs, labels = labelled
    balanced, natural = sample(docs, labels, "toxic", 4, 2, toxicity.PER_CLASS, toxicity.CALIBRATION, toxicity.SAMPLE_BYTES)
    index = toxicity.fitted(docs, labels)
    bags = [(Counter(t for w in toxicity.words_of(text) for t in toxicity.terms_of(w)), v) for text, v in toxicity.distinct(balanced)]
    n = Counter(v for _, v in bags)
    held = {v: Counter(t for bag, u in bags if u == v for t in bag) for v in (0, 1)}

    def vector(bag: Counter) -> dict:
        out = {}
        for t, c in bag.items():
            k = [held[0][t], held[1][t]]
            if sum(k):
                idf = math.log((1 + sum(n.values())) / (1 + sum(k))) + 1
                out[t] = (1 + math.log(c)) * idf * math.log2(2 + ((k[1] + 0.5) / n[1]) / ((k[0] + 0.5) / n[0])) ** 2
        size = math.sqrt(sum(x * x for x in out.values()))
        return {t: x / size for t, x in out.items()}

    examples, read = [(vector(bag), v) for bag, v in bags], index.reader()
    texts = [r.text for r in docs.where("text is not null").limit(150).collect()]
    for text, found in zip(texts, index.nearest([read(t) for t in texts])):
        mine = vector(Counter(t for w in toxicity.words_of(text) for t in toxicity.terms_of(w)))
        every = sorted(((sum(x * e.get(t, 0) for t, x in mine.items()), v) for e, v in examples), reverse=True)
        best = [(s, v) for s, v in every if s > 1e-12][: toxicity.NEIGHBOURS]
        assert [s for s, _ in found] == pytest.approx([s for s, _ in best], abs=1e-9)
        assert sum(index.labels[j] for s, j in found if s > best[-1][0] + 1e-9) == sum(v for s, v in best if s > best[-1][0] + 1e-9)
        assert found or not toxicity.words_of(text) or not mine


def test_examples_that_only_share_a_passage_stay():
    r = random.Random(6)
    texts = [" ".join(f"w{r.random()}" for _ in range(40)) for _ in range(40)]
    rows = [(t + " one passage that many of them share", i % 2) for i, t in enumerate(texts)]
    assert toxicity.distinct(rows + [(rows[0][0] + " more", 0), (rows[1][0], 1), (rows[1][0], 0)]) == rows + [(rows[1][0], 0)]


def test_without_toxic(labelled):
    docs, labels = labelled
    rejected = {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - rejected


def test_plain_columns_only_on_native_paths(docs, spark):
    chats = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    native = [fingerprints.fingerprint(docs), block_naming.dedup(docs), mixing.mix(docs, [1.0]), reply_trees.digests(chats)]
    for df in native:
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def test_toxicity_reader_and_batches():
    """Known terms of a word are all found, and a batch needs hardly more memory beside its sums than its longest text."""
    import tracemalloc

    r = random.Random(6)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    index = toxicity.build([(" ".join(r.choices(words, k=300)), i % 2) for i in range(600)])
    number = {t: i for i, t in enumerate(index.terms)}
    read = index.reader()
    for word in [*words[:300], "abcdefgh", "abcdz", "ünï", "q", "abcde" * 9]:
        ids, _ = read(word)
        assert ids.tolist() == sorted({number[t] for w in toxicity.words_of(word) for t in toxicity.terms_of(w) if t in number})
    queries = [read(" ".join(words))] * 16
    assert index.nearest(queries) == index.nearest(queries[:1]) * 16

    def peak(some):
        tracemalloc.start()
        index.nearest(some)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(queries) < 4 * peak(queries[:1])


@pytest.mark.parametrize("few", [0, 7, 20_000])
def test_components_of_chains_and_stars(spark, monkeypatch, few):
    """However many edges are left to one task, roots are the same; with room for all edges no round comes before it."""
    monkeypatch.setattr(ngram_join, "FEW_EDGES", few)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(-5, 300), (300, -9), (7, 7)]
    scratch = Scratch(spark, "test-components")
    found = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "u long, v long"), scratch, "x").collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {300: -9, -5: -9, -9: -9}
    assert found == want
    if few > len(edges):
        assert "x-parent0" in scratch.names and "x-edges1" not in scratch.names
    none = spark.createDataFrame([], "u long, v long")
    assert ngram_join.components(none, scratch, "none").count() == 0


def test_rest_between_steps(spark):
    """Between steps the driver's garbage is collected, so that its heap does not grow with the number of jobs."""
    scratch = Scratch(spark, "test-rest")
    scratch.save(spark.range(3).toDF("x"), "a")
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    before = sum(b.getCollectionCount() for b in beans())
    scratch.drop("a")
    assert sum(b.getCollectionCount() for b in beans()) > before


def collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_executors_rest(spark):
    """Tasks collect garbage where they run (here in the driver's JVM); Spark neither folds nor skips the call."""
    before = collections(spark)
    rest_executors(spark)
    assert collections(spark) > before
