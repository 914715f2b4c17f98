"""Removal of byte strings that start more than once: prefix doubling over sampled positions, sorted by Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import NO_ID, Scratch, claim
from fieldlens.llm.ngram_join import _mix, _texts

#: Bytes of the strings that count as repeats, and of the prefixes that get the first ranks: doubled once, these reach it.
LENGTH = 400
HALF = 200
#: Window starts of a segment of a long text.
SEGMENT = 1 << 19
#: Positions that the second round takes together.
STEP = 16
#: Rows that a task gathers before it merges equal ones.
FLUSH = 400_000

_LOW = np.uint64((1 << 20) - 1)
# Two independent polynomial hashes: one modulo 2^64, one modulo each of two primes, against which texts that are built to
# fool a power of two (such as Thue-Morse strings) have no effect.
_BASE = 0xD6E8FEB86659FD93
_BYTE = _mix(np.arange(256, dtype=np.uint64), 21)
_PRIMES = (2**31 - 1, 48271), (2**31 - 19, 69621)  # modulus, base
_SMALL = [_mix(np.arange(256, dtype=np.uint64), 22 + i) % np.uint64(p) for i, (p, _) in enumerate(_PRIMES)]
_REACH = SEGMENT + 2 * LENGTH + 1


def _powers(base: int) -> np.ndarray:
    out = np.full(_REACH, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers_modulo(base: int, prime: int) -> np.ndarray:
    """base ** i % prime for each i, by doubling what is known: every product fits 62 bits."""
    out = np.ones(1, np.uint64)
    while len(out) < _REACH:
        out = np.append(out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime))
    return out[:_REACH]


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))
_UP_SMALL = [_powers_modulo(b, p) for p, b in _PRIMES]
_DOWN_SMALL = [_powers_modulo(pow(b, -1, p), p) for p, b in _PRIMES]


class Ranks:
    """Names of a segment's substrings: equal strings of equal length have equal 64-bit names, wherever they stand."""

    def __init__(self, data: np.ndarray):
        self.data, self.checks = data, None
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _UP[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names by both hashes: unlike strings share one with a chance of 2^-62 or less."""
        if self.checks is None:
            self.checks = [np.append(np.uint64(0), np.cumsum(table[self.data] * up[: len(self.data)] % np.uint64(p))) for table, up, (p, _) in zip(_SMALL, _UP_SMALL, _PRIMES)]
        named = _mix((self.sums[end] - self.sums[start]) * _DOWN[start], 5)
        for i, (sums, down, (p, _)) in enumerate(zip(self.checks, _DOWN_SMALL, _PRIMES)):
            named = _mix(named + (sums[end] - sums[start]) % np.uint64(p) * down[start] % np.uint64(p), 30 + i)
        return named

    def halves(self) -> np.ndarray:
        """The rank of the HALF bytes from every position, by the first hash alone: it only sorts, names decide."""
        return _mix((self.sums[HALF:] - self.sums[:-HALF]) * _DOWN[: len(self.sums) - HALF], 5)


def _leaders(halves: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes the position in it whose half-length string has the least rank, the first of equals.

    Equal windows have equal leaders, so only windows with a leader whose string starts elsewhere can start elsewhere.
    """
    width = LENGTH - HALF + 1
    values = (halves & ~_LOW) | np.arange(len(halves), dtype=np.uint64)
    rows = -(-len(values) // width)
    table = np.full(rows * width, np.uint64(2**64 - 1))
    table[: len(values)] = values
    table = table.reshape(rows, width)
    left = np.minimum.accumulate(table, axis=1).ravel()
    right = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[: len(values) - width + 1], left[width - 1 : len(values)]) & _LOW).astype(np.int64)


def _packed(lo: np.ndarray, at: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Window starts lo to hi with the leader at: in one number."""
    return (lo << 18) | ((at - lo) << 9) | (hi - lo)


def _unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = x >> 18
    return lo, lo + ((x >> 9) & 511), lo + (x & 511)


ROWS = "g long, k long, doc_id long, place long, times int"
_ROWS = pa.schema([("g", pa.int64()), ("k", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64()), ("times", pa.int32())])
FOUND = "kind int, doc_id long, place long"
_FOUND = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64())])
#: Kinds of FOUND rows: its windows all start elsewhere, too; they must be looked at more closely.
REPEATED, OPEN = 1, 2


class _Merged:
    """Rows of a task, with equal (g, k) merged before they are shuffled: the first stands for all, the rest are repeats.

    So a string that a third of all texts hold comes from each task once.
    """

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, g: np.ndarray, k: np.ndarray, doc_id: int, place: np.ndarray) -> None:
        self.parts.append((g.view(np.int64), k.view(np.int64), np.full(len(g), doc_id, np.int64), place))
        self.size += len(g)

    def batches(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.size < least:
            return
        g, k, doc, place = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.lexsort((k, g))
        g, k, doc, place = g[order], k[order], doc[order], place[order]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        starts = np.flatnonzero(first)
        counts = np.diff(np.append(starts, len(g)))
        times = np.full(len(g), -1, np.int32)  # a repeat, whatever else is found
        times[starts] = np.minimum(counts, 2)
        spread = _mix(doc.view(np.uint64) + place.view(np.uint64) * np.uint64(_BASE)).view(np.int64)
        g = np.where(first, g, spread)
        for at in range(0, len(g), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]) for x in (g, k, doc, place, times)], schema=_ROWS)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First round: each leader with the stretch of windows it leads; g ranks its half-length string, k the stretch."""
    claim("repeats")
    merged = _Merged()
    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
            for s in range(0, len(data) - LENGTH + 1, SEGMENT):
                part = data[s : s + SEGMENT + LENGTH - 1]
                ranks = Ranks(part)
                halves = ranks.halves()
                leader = _leaders(halves)
                lo = np.flatnonzero(np.diff(leader, prepend=-1))
                hi = np.append(lo[1:], len(leader)) - 1
                at = leader[lo]
                k = ranks.of(lo, hi + LENGTH) + _mix((((at - lo) << 9) | (hi - lo)).astype(np.uint64), 6)
                merged.add(halves[at], k, doc_id, _packed(lo + s, at + s, hi + s))
            yield from merged.batches(FLUSH)
    yield from merged.batches()


def _closer(step: int):
    """A later round over texts with open stretches: pieces of step windows, on a grid that starts at the leader.

    With step 1 a window's key is the pair of its half-length ranks, at the window and HALF further: prefix doubling.
    """

    def round_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = _Merged()
        for batch in batches:
            for doc_id, data, places in zip(batch.column(0).to_pylist(), _texts(batch, 1), batch.column(2)):
                lo, at, hi = _unpacked(np.unique(np.asarray(places.values)))
                for s in range(0, len(data) - LENGTH + 1, SEGMENT):
                    mine = (lo >= s) & (lo < s + SEGMENT) & (hi + LENGTH <= len(data))
                    if not mine.any():
                        continue
                    ranks = Ranks(data[s : s + SEGMENT + LENGTH + HALF])
                    l, a, h = lo[mine] - s, at[mine] - s, hi[mine] - s
                    if step == 1:
                        n = h - l + 1
                        first = np.cumsum(n) - n
                        p = np.unique(np.repeat(l - first, n) + np.arange(int(n.sum())))
                        merged.add(ranks.of(p, p + HALF), ranks.of(p + HALF, p + LENGTH), doc_id, _packed(p + s, p + s, p + s))
                        continue
                    near, far = (a - h) // step, (a - l) // step  # grid cells of the distance to the leader
                    n = far - near + 1
                    first = np.cumsum(n) - n
                    cell = np.repeat(near - first, n) + np.arange(int(n.sum()))
                    l, a, h = np.repeat(l, n), np.repeat(a, n), np.repeat(h, n)
                    pl, ph = np.maximum(l, a - cell * step - step + 1), np.minimum(h, a - cell * step)
                    g = _mix(ranks.of(a, a + HALF) + cell.astype(np.uint64), 8)
                    k = ranks.of(pl, ph + LENGTH) + _mix((((a - pl) << 9) | (ph - pl)).astype(np.uint64), 6)
                    merged.add(g, k, doc_id, _packed(pl + s, a + s, ph + s))
                yield from merged.batches(FLUSH)
        yield from merged.batches()

    return round_


def _rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (g, k): those whose (g, k) is not unique are REPEATED; where one g has several k, one row of each is OPEN.

    A g that stays unique ends here. State between batches is at most two rows: the first of the open g and of its last k.
    """
    kept = None
    for batch in batches:
        g, k, doc, place, times = (batch.column(i).to_numpy() for i in range(5))
        known = times < 0
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(known.sum()), REPEATED, np.int32)), pa.array(doc[known]), pa.array(place[known])], schema=_FOUND)
            g, k, doc, place, times = (x[~known] for x in (g, k, doc, place, times))
        if not len(g):
            continue
        told, shown = np.zeros(len(g), bool), np.zeros(len(g), bool)
        if kept is not None:
            g, k, doc, place, times, told, shown = (np.concatenate([a, b]) for a, b in zip(kept, (g, k, doc, place, times, told, shown)))
        new_g = np.ones(len(g), bool)
        new_g[1:] = g[1:] != g[:-1]
        new_k = new_g.copy()
        new_k[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new_k)
        run = np.cumsum(new_k) - 1
        count = np.add.reduceat(times.astype(np.int64), starts)
        group = np.cumsum(new_g) - 1
        several = np.bincount(group[starts]) > 1
        again = (count[run] > 1) & ~told
        shown_now = np.zeros(len(g), bool)
        shown_now[starts] = several[group[starts]] & ~shown[starts]
        for mark, kind in ((again, REPEATED), (shown_now, OPEN)):
            if mark.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(mark.sum()), kind, np.int32)), pa.array(doc[mark]), pa.array(place[mark])], schema=_FOUND)
        head, last = int(np.flatnonzero(new_g)[-1]), int(starts[-1])
        rows = [head] if head == last else [head, last]
        total = min(int(count[-1]), 2)
        kept = (g[rows], k[rows], doc[rows], place[rows], times[rows].copy(), np.array([True] * (len(rows) - 1) + [total > 1]), np.array([len(rows) > 1] * len(rows)))
        kept[4][-1] = total


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by [start, end) stretches; touching ones are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new], np.append(ends[:-1][new[1:]], ends[-1])


KEPT = "doc_id long, n_removed long, n_spans long, kept_sha256 string"
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, data, places in zip(batch.column(0).to_pylist(), _texts(batch, 1), batch.column(2)):
            lo, _, hi = _unpacked(np.asarray(places.values))
            starts, ends = _spans(lo, np.minimum(hi + LENGTH, len(data)))
            kept, at = hashlib.sha256(), 0
            for s, e in zip(starts.tolist(), ends.tolist()):
                kept.update(data[at:s])
                at = e
            kept.update(data[at:])
            out.append((doc_id, int((ends - starts).sum()), len(starts), kept.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _KEPT)], schema=_KEPT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a LENGTH-byte string over it also starts elsewhere, in the same text or another. Positions first get
    the ranks of their HALF-byte prefixes, at one sampled position (the leader) for each stretch of windows; stretches
    whose rank is unique end there, equal stretches are repeats throughout, and only stretches that share a rank but
    differ go on: in pieces of STEP windows, then window by window with the pair of ranks at the window and HALF bytes
    further. Every round is one sort by Spark, of fewer rows than the last; text travels once.
    Null text counts as empty: 0 bytes. Texts under LENGTH bytes lose nothing. Rows are told apart by doc_id and text: a
    null doc_id is a document like others, and rows equal in both are repeats of each other. An empty table gives an empty
    result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    texts, every = _addressed(docs, scratch)

    def ranked(rows: DataFrame, name: str) -> DataFrame:
        return scratch.save(rows.repartition("g").sortWithinPartitions("g", "k").mapInArrow(_rerank, FOUND), name)

    def with_places(texts: DataFrame, found: DataFrame) -> DataFrame:
        return texts.join(found.groupBy("doc_id").agg(F.collect_list("place").alias("places")), "doc_id").select("doc_id", "text", "places")

    first = ranked(texts.mapInArrow(_sample, ROWS), "first")
    held = scratch.save(texts.join(first.select("doc_id").distinct(), "doc_id", "left_semi"), "held")
    second = ranked(with_places(held, first.where(F.col("kind") == OPEN)).mapInArrow(_closer(STEP), ROWS), "second")
    third = ranked(with_places(held, second.where(F.col("kind") == OPEN)).mapInArrow(_closer(1), ROWS), "third")
    repeated = first.unionByName(second).unionByName(third).where(F.col("kind") == REPEATED)
    cut = scratch.save(with_places(held.dropDuplicates(["doc_id"]), repeated).mapInArrow(_keep, KEPT), "cut")
    scratch.keep("rows", "cut")
    return every.join(cut.withColumnRenamed("doc_id", "_key"), "_key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("_sha"))).alias("kept_sha256"),
    )


def _addressed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(texts, rows): texts by a 64-bit address in the place of doc_id, and a row for each document with its address.

    The address hashes doc_id and text; a salt is sought with which no two unlike rows share one.
    """
    salt = 0
    while True:
        doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
        key = F.xxhash64(F.lit(salt), doc_id.isNull(), doc_id, text)
        raw = F.encode(text, "UTF-8")
        rows = docs.select(key.alias("_key"), doc_id.alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(raw, 256)).alias("_sha"))
        rows = scratch.save(rows, "rows")
        told = F.struct(F.coalesce("doc_id", F.lit(NO_ID)), F.col("doc_id").isNull(), "_sha")
        if rows.groupBy("_key").agg(F.min(told).alias("a"), F.max(told).alias("b")).where("a <> b").isEmpty():
            return docs.select(key.alias("doc_id"), raw.alias("text")), rows
        salt += 1
