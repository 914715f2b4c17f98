"""Quality by compression: zstandard dictionaries of good and of bad labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import claim
from fieldlens.llm.labels import remainder, sample

#: Bytes of a dictionary, and of the pieces that are compressed alone with it, so that all of a text meets it.
DICTIONARY = 112_640
PIECE = 1024
LEVEL = 3
#: Bounds of the labelled sample: rows of a label for the dictionaries, rows for calibration, bytes of either's texts.
PER_CLASS = 1500
CALIBRATION = 4000
SAMPLE_BYTES = 24_000_000


def _pieces(data: bytes) -> Iterator[bytes]:
    return (data[i : i + PIECE] for i in range(0, len(data), PIECE))


@dataclass
class Model:
    """What a score needs; base is given to empty texts and where nothing could be learnt."""

    base: float
    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = ()

    def scorer(self):
        if not self.weights:
            return lambda text: self.base
        import zstandard

        makers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in (self.good, self.bad)]
        weights = np.array(self.weights)

        def score(text: str | None) -> float:
            if not text:
                return self.base
            return float(_logistic(_features(text, makers) @ weights))

        return score


def _features(text: str, makers: list) -> np.ndarray:
    """1, the normalised difference of the sizes (bad less good), and the log share of the smaller one, plain and squared.

    The share tells text that any dictionary packs well, such as one word repeated: of such text the difference is small
    whatever its label.
    """
    data = text.encode()
    good = bad = 0
    for piece in _pieces(data):
        good += len(makers[0].compress(piece))
        bad += len(makers[1].compress(piece))
    share = np.log(min(good, bad) / len(data))
    return np.array([1.0, 10 * (bad - good) / (bad + good), share, share * share])


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps."""

    def loss(w):
        m = x @ w
        return np.logaddexp(0, np.where(y > 0, -m, m)).sum() + ridge / 2 * (w @ w)

    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = _logistic(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * w)
        a = 1.0
        while loss(w + a * step) > loss(w) and a > 1e-4:
            a /= 2
        w = w + a * step
        if np.abs(a * step).max() < 1e-8:
            break
    return w


def train(balanced: list[tuple[str, int]], natural: list[tuple[str, int]]) -> Model:
    """Dictionaries from the balanced sample, the score's calibration from the natural one.

    A score is the chance of label 1 where both labels are as frequent, so that a rare one is not overlooked. Where the
    natural sample lacks a label, the balanced one calibrates; where that does, too, or a dictionary finds too little
    text, every score is the share of label 1 (a half without any labels).
    """
    import zstandard

    usual = natural if len({v for _, v in natural}) == 2 else balanced
    base = (sum(v for _, v in usual) + 1) / (len(usual) + 2)
    made = []
    for label in (1, 0):
        parts = [p for text, v in balanced if v == label for p in list(_pieces(text.encode()))]
        try:
            made.append(zstandard.train_dictionary(min(DICTIONARY, max(256, sum(map(len, parts)) // 8)), parts).as_bytes())
        except (zstandard.ZstdError, ValueError):
            return Model(base)
    calibrating = [(t, v) for t, v in usual if t]
    if len({v for _, v in calibrating}) < 2:
        return Model(base)
    makers = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in made]
    x = np.array([_features(t, makers) for t, _ in calibrating])
    y = np.array([v for _, v in calibrating])
    weights = fit_logistic(x, y)
    weights[0] -= np.log(y.sum() / (len(y) - y.sum()))
    return Model(0.5, *made, tuple(float(w) for w in weights))


def score(docs: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Labels of the held-out remainder are never read.

    The score sees the text alone. Null and empty texts get a half, or the share of label 1 where nothing was learnt. An empty table gives an empty result;
    repeated rows are scored each; other columns are ignored.
    """
    model = train(*sample(docs, labels, "quality", divisor, held_out, PER_CLASS, CALIBRATION, SAMPLE_BYTES))
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries and four weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("compression")
        mark = shipped.value.scorer()
        for batch in batches:
            scores = pa.array([mark(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), divisor) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
