"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import claim, rest, rest_executors
from fieldlens.llm.labels import remainder, sample

#: Bounds of the labelled sample: examples of a label, rows for calibration, bytes of either's texts.
PER_CLASS = 1500
CALIBRATION = 3000
SAMPLE_BYTES = 12_000_000
#: Examples of a block; neighbours that vote; the share of examples from which a term's postings are kept as a full row.
BLOCK = 128
NEIGHBOURS = 15
COMMON = 1 / 8
#: Texts that are compared with the examples together.
BATCH = 64
#: Bytes of the word beginnings that count as terms beside whole words, so that inflected words meet.
STEMS = (4, 5, 6)
#: Words whose terms a worker keeps.
REMEMBERED = 60_000
#: Word triples that two examples of a label share, of those of either, to count as one.
COPIES = 0.8

#: Bytes that words are cut at: white space and marks.
_CUT = bytes(32 if chr(b) in ".,;:!?\"()[]{}<>|*&%$#@+=~^_/\\`" else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without marks, in UTF-8."""
    return text.lower().encode().translate(_CUT).split()


def terms_of(word: bytes) -> tuple[bytes, ...]:
    """The terms of a word: itself and its beginnings (with a star)."""
    return (word, *(word[:k] + b"*" for k in STEMS if len(word) > k))


class Words(dict):
    """Term numbers of words, packed by make on first use; forgotten when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.make(word)
        return found

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct numbers of a text's terms, and how often each comes."""
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, words_of(text))), np.int32), return_counts=True)


def _triples(text: str) -> np.ndarray:
    words = text.lower().split()
    return np.unique(np.array([zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))], np.uint32))


def distinct(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """rows without copies and near copies of a label: candidates share a min-hash of their word triples, sets decide.

    A text that was copied a hundred times would otherwise fill the places of a hundred neighbours.
    """
    kept: list[tuple[str, int]] = []
    seen: dict[tuple[int, int, int], list[np.ndarray]] = {}
    for text, label in rows:
        mine = _triples(text)
        keys = [(label, odd, int((mine * np.uint32(odd)).min())) for odd in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
        others = {id(o): o for k in keys for o in seen.get(k, ())}
        both = ((len(np.intersect1d(mine, o, assume_unique=True)), len(o)) for o in others.values())
        if any(b >= COPIES * (len(mine) + n - b) for b, n in both):
            continue
        kept.append((text, label))
        for k in keys:
            seen.setdefault(k, []).append(mine)
    return kept


@dataclass
class Index:
    """Examples in blocks, and for each term its postings: weights of the examples that hold it.

    Postings of rare terms are lists. Those of common terms are rows over all examples, with the largest weight of each
    block beside them: they are read for a block only where its bound can still change the nearest examples.
    """

    terms: list[bytes] = field(default_factory=list)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of each term: inverse document frequency and relevance
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # of each term's list
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.full(1, 0.5))  # calibrated score by vote
    none: float = 0.5  # score of texts without a known term

    def __post_init__(self):
        """The rows of common terms (row: its number or -1; rows: row x example, up to whole blocks; block_max)."""
        sizes, width = np.diff(self.starts), -(-len(self.labels) // BLOCK) * BLOCK
        common = np.flatnonzero(sizes > max(8, COMMON * len(self.labels)))
        self.row = np.full(len(sizes), -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), width))
        term = np.repeat(self.row, sizes)
        self.rows[term[term >= 0], self.places[term >= 0]] = self.weights[term >= 0]
        self.block_max = self.rows.reshape(len(common), -1, BLOCK).max(2) if width else np.zeros((len(common), 0))

    def __getstate__(self):
        """Rows stay behind: they are made again from the lists."""
        return {k: v for k, v in self.__dict__.items() if k not in ("row", "rows", "block_max")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def reader(self):
        """A function from a text to its known terms and their weights, of length 1; words are remembered."""
        packed = {t: i.tobytes() for t, i in zip(self.terms, np.arange(len(self.terms), dtype=np.int32))}.get

        def numbers(word: bytes) -> bytes:
            """Of terms_of(word) those that are known: every beginning of a known one is known, too."""
            found = packed(word, b"")
            for k in STEMS:
                if len(word) <= k or (stem := packed(word[:k] + b"*")) is None:
                    break
                found += stem
            return found

        known = Words(numbers)

        def read(text: str | None) -> tuple[np.ndarray, np.ndarray]:
            ids, counts = known.counted(text or "")
            weights = (1 + np.log(counts)) * self.weight[ids]
            return ids, weights / max(np.sqrt((weights**2).sum()), 1e-12)

        return read

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS) -> list[list[tuple[float, int]]]:
        """For each query the k examples of the largest cosine above 0, and their places; ties by place.

        Lists of rare terms are summed first. With them and the largest weights of its common terms each block has a
        bound. A query's best bounded block comes first, then every block whose bound its k-th best does not exceed, so
        the result is exact.
        """
        m, n, width = len(queries), len(self.labels), self.rows.shape[1]
        if not n or not m:
            return [[] for _ in queries]
        heavy, sums = np.zeros((m, len(self.rows))), np.empty((m, width))
        for q, (ids, weights) in enumerate(queries):  # one by one: a text's postings stay in the processor's cache
            row = self.row[ids]
            rare = row < 0
            heavy[q, row[~rare]] = weights[~rare]
            lo = self.starts[ids[rare]]
            count = self.starts[ids[rare] + 1] - lo
            at = np.repeat(lo - (np.cumsum(count) - count), count)
            at += np.arange(len(at))
            share = np.repeat(weights[rare], count)
            share *= self.weights[at]
            sums[q] = np.bincount(self.places[at], share, minlength=width)
        bounds = sums.reshape(m, -1, BLOCK).max(2) + heavy @ self.block_max + 1e-9
        seen = np.zeros(bounds.shape, bool)
        best = np.zeros((m, k))  # the k best cosines so far, unordered

        def look(block: int, who: np.ndarray) -> None:
            part = slice(block * BLOCK, (block + 1) * BLOCK)
            seen[who, block] = True
            sums[who, part] += heavy[who] @ self.rows[:, part]
            best[who] = np.partition(np.hstack([best[who], sums[who, part]]), -k, axis=1)[:, -k:]

        first = bounds.argmax(1)
        for block in np.unique(first):
            look(int(block), np.flatnonzero(first == block))
        for block in np.argsort(-bounds.sum(0), kind="stable"):
            who = np.flatnonzero(~seen[:, block] & (bounds[:, block] >= best.min(1)))
            if len(who):
                look(int(block), who)
        sums = np.round(np.where(np.repeat(seen, BLOCK, axis=1), sums, 0), 12)[:, :n]
        out = []
        for scores in sums:
            some = np.flatnonzero(scores >= max(np.partition(scores, -k)[-k] if n > k else 0, 1e-12))
            some = some[np.lexsort((some, -scores[some]))][:k]
            out.append(list(zip(scores[some].tolist(), some.tolist())))
        return out

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The share of label 1 among the neighbours, each weighted by its nearness; far ones leave room for doubt."""
        weights = np.array([1 / (1.05 - min(s, 1.0)) for s, _ in near])
        return float((weights * self.labels[[j for _, j in near]]).sum() / (weights.sum() + 0.5))

    def score(self, near: list[tuple[float, int]]) -> float:
        return float(np.interp(self.vote(near), *self.steps)) if near else self.none


def term_weights(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Smoothed inverse document frequency times the square of the relevance frequency, for every term.

    ones and zeros are the examples of either label that hold the term. The relevance frequency is log2(2 + r), r being
    how many times as frequent the term is under label 1: it lifts telling terms and leaves none out.
    """
    idf = np.log((1 + n1 + n0) / (1 + ones + zeros)) + 1
    r = ((ones + 0.5) / max(n1, 1)) / ((zeros + 0.5) / max(n0, 1))
    return idf * np.log2(2 + r) ** 2


def build(balanced: list[tuple[str, int]]) -> Index:
    """The index of all examples with a word, over all their terms."""
    vocabulary: dict[bytes, int] = {}
    words = Words(lambda word: array("i", [vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(word)]).tobytes())
    held = [(*words.counted(text), v) for text, v in distinct(balanced)]
    held = [x for x in held if len(x[0])]
    if not held:
        return Index()
    labels = np.array([v for *_, v in held], int)
    ids, counts = (np.concatenate(x) for x in list(zip(*held))[:2])
    of = np.repeat(np.arange(len(held)), [len(x) for x, *_ in held])
    total = np.bincount(ids, minlength=len(vocabulary))
    ones = np.bincount(ids, labels[of], len(vocabulary))
    weight = term_weights(ones, total - ones, int(labels.sum()), int((labels == 0).sum()))
    weights = (1 + np.log(counts)) * weight[ids]
    weights /= np.sqrt(np.bincount(of, weights**2))[of]
    # examples that share their heaviest common term lie together, so that blocks differ and many can be skipped
    common = total[ids] > COMMON * len(held)
    heaviest = np.lexsort((np.where(common, weights, 0), of))[np.cumsum(np.bincount(of)) - 1]
    order = np.argsort(ids[heaviest], kind="stable")
    place = np.empty(len(held), int)
    place[order] = np.arange(len(held))
    by_term = np.lexsort((place[of], ids))
    starts = np.append(0, np.cumsum(total))
    return Index(list(vocabulary), weight, labels[order], starts, place[of][by_term].astype(np.int16), weights[by_term])


def calibrate(index: Index, natural: list[tuple[str, int]]) -> None:
    """Scores that grow with the vote, by pooling adjacent violators on rows that the index doesn't hold."""
    natural, read = distinct(natural), index.reader()
    index.none = (sum(v for _, v in natural) + 0.5) / (len(natural) + 1)
    seen = [(near, natural[i + j][1]) for i in range(0, len(natural), BATCH) for j, near in enumerate(index.nearest([read(t) for t, _ in natural[i : i + BATCH]]))]
    pools: list[list[float]] = []  # vote sum, label sum, weight
    for vote, v in sorted((index.vote(near), v) for near, v in seen if near):
        pools.append([vote, float(v), 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    # the ends stand for a vote of none and of all, each with one row's doubt
    votes = [0.0, *(p[0] / p[2] for p in pools), 1.0]
    rates = [0.0, *((p[1] + 0.05) / (p[2] + 0.1) for p in pools), 1.0]
    index.steps = (np.array(votes), np.maximum.accumulate(np.array(rates)))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def fitted(docs: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> Index:
    balanced, natural = sample(docs, labels, "toxic", divisor, held_out, per_class, CALIBRATION, SAMPLE_BYTES)
    index = build(balanced)
    calibrate(index, natural or balanced)
    return index


def score(docs: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence (label and cosine of its nearest examples).

    The score sees the text alone; labels of the held-out remainder are never read. Examples and so the index are bounded
    by this module's parameters, whatever the tables hold; the terms are all terms of the examples. Null and empty texts,
    and those without any of the terms, have no neighbours: they get the share of label 1. An empty table gives an empty
    result; repeated rows are scored each; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, divisor, held_out))
    rest(docs.sparkSession)
    shape = "doc_id long, score double, evidence array<struct<label:int,cosine:double>>"
    kind = pa.list_(pa.struct([("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        index = shipped.value
        read = index.reader()
        for batch in _small(batches):
            near = index.nearest([read(t.as_py()) for t in batch.column(1)])
            evidence = [[{"label": int(index.labels[j]), "cosine": s} for s, j in n[:3]] for n in near]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([index.score(n) for n in near], pa.float64()), pa.array(evidence, kind)], names=["doc_id", "score", "evidence"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, shape)
    return scored.select("doc_id", (remainder(F.col("doc_id"), divisor) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """docs whose score stays under the threshold, in docs' columns: the scores travel beside the rows, in one pass.

    per_class bounds the examples of a label, and so what each worker holds.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, per_class=per_class))
    rest(docs.sparkSession)
    rest_executors(docs.sparkSession)  # the sample's scans have grown their heaps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        index = shipped.value
        read = index.reader()
        for batch in _small(batches):
            at = batch.schema.get_field_index("text")
            clean = [index.score(near) < threshold for near in index.nearest([read(t.as_py()) for t in batch.column(at)])]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
