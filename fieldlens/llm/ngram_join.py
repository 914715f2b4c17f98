"""Near-duplicate documents: an exact Jaccard join on word shingles with several global token orders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import NO_ID, Scratch, claim, fetched, marked, without

#: Words of a shingle.
WORDS = 5
#: Counters of shingles; the first token order puts shingles of crowded counters last.
CELLS = 1 << 16
#: Postings of one token that a task gets before the token is split.
RUN = 50_000
#: Rows that answer a chunk of asking documents in one part.
ANSWERS = 20_000
#: Text bytes hashed at a time.
CHUNK = 1 << 20

_ONE = np.uint64(1)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (splitmix64's finaliser)."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _mix(np.arange(256, dtype=np.uint64), 7)[_LOWER]
_PLACE = _mix(np.arange(64, dtype=np.uint64), 11) | _ONE
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        base = np.uint64(0xD6E8FEB86659FD93)
        more = np.full(max(4096, n), base, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """64 bits for each word (A-Z lower-cased, split at ASCII white space) of UTF-8 bytes, in order."""
    found, at = [], 0
    while at < len(data):
        end = min(at + CHUNK, len(data))
        if end < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # a word longer than a chunk
                gaps = np.flatnonzero(_SPACE[data[end:]])
                end = end + int(gaps[0]) if len(gaps) else len(data)
        part = data[at:end]
        inside = ~_SPACE[part]
        edge = np.diff(inside, prepend=False, append=False)
        marks = np.flatnonzero(edge)
        starts, lengths = marks[::2], marks[1::2] - marks[::2]
        if len(starts):
            flat = part[inside]
            first = np.cumsum(lengths) - lengths
            place = np.arange(len(flat)) - np.repeat(first, lengths)
            terms = _BYTE[flat] * _power(int(lengths.max()))[place]
            found.append(_mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64)))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingles(data: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes; one of all words if they are fewer; none without words."""
    words = word_hashes(data)
    n = len(words)
    if n == 0:
        return words
    if n < size:
        return _mix(np.add.reduce(words * _PLACE[:n], keepdims=True), 100 + n)
    sums = words[: n - size + 1] * _PLACE[0]
    for i in range(1, size):
        sums = sums + words[i : n - size + 1 + i] * _PLACE[i]
    hashed = np.sort(_mix(sums))
    first = np.ones(len(hashed), bool)
    np.not_equal(hashed[1:], hashed[:-1], out=first[1:])
    return hashed[first]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    """The column's texts as bytes; null as empty."""
    for x in batch.column(column):
        buffer = x.as_buffer()
        yield np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what is made of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def prefix_length(n):
    """Of a set of n, so many first tokens hold one of any set of Jaccard similarity 0.8 or more."""
    return n - (4 * n + 4) // 5 + 1


def posted_length(n):
    """First tokens that are posted: three tenths, more than completeness needs. So a linked pair shares a tenth of either
    set among them, and documents that only share a passage are told by counting, before any pair is made."""
    return n - (7 * n + 9) // 10 + 1


def shared_at_least(n, m):
    """First tokens, of as many as are posted, that linked sets of n and m share at least: their overlap less the longer rest."""
    return np.maximum(1, (4 * (n + m) + 8) // 9 - ((7 * np.maximum(n, m) + 9) // 10 - 1))


def fewest_shared(n):
    """The least of shared_at_least(n, m) over all m that fit n.

    Of sizes up to n the smallest asks least, and that is the first term; of larger ones the largest, which from n = 68 on
    asks no less than the first term. Below, all sizes were enumerated: only a set of 4 with one of 5 asks less, 1.
    """
    return np.minimum(np.maximum(1, (4 * n + 4) // 5 - ((7 * n + 9) // 10 - 1)), shared_at_least(n, 5 * n // 4))


def in_order(tokens: np.ndarray, order: int, length: int, crowded: np.ndarray | None = None) -> np.ndarray:
    """The first tokens of a set under one global order: by class of the token's counter, then by the order's scramble."""
    key = _mix(tokens, order)
    if crowded is not None:
        key = (key >> np.uint64(6)) | (crowded[(tokens % np.uint64(CELLS)).astype(np.int64)].astype(np.uint64) << np.uint64(58))
    return tokens[np.argpartition(key, length - 1)[:length]] if length < len(tokens) else tokens


def identity(tokens: np.ndarray, seed: int = 0) -> tuple[int, int]:
    """128 bits that stand for a set; the first 64 are its node in the graph, once shown to be one-to-one."""
    first, second = np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest(), np.int64)
    return int(first), int(second)


SEEN = "doc_id long, n long, a long, b long, cell int, load long"
_SEEN = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int32()), ("load", pa.int64())])


def _see(seed: int):
    """A row for each document (its set's size and identity), then one for each counter of the partition."""

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram join")
        loads = np.zeros(CELLS, np.int64)
        for batch in _small(batches):
            out = []
            for doc_id, data in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
                tokens = shingles(data)
                np.add.at(loads, (tokens % np.uint64(CELLS)).astype(np.int64), 1)
                out.append((doc_id, len(tokens), *identity(tokens, seed)))
            if out:
                cols = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.int64())], schema=_SEEN)
        used = np.flatnonzero(loads)
        if len(used):
            none = pa.nulls(len(used), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(used.astype(np.int32)), pa.array(loads[used])], schema=_SEEN)

    return see


POSTINGS = "token long, salt int, node long"
_POSTINGS = pa.schema([("token", pa.int64()), ("salt", pa.int32()), ("node", pa.int64())])


def _post(crowded: np.ndarray, splits: np.ndarray, seed: int):
    """Postings (token, salt, node) of each set's first tokens under the first order."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram join")
        known: set[int] = set()  # a set that repeats in the partition is posted once
        for batch in _small(batches):
            parts, nodes, salts = [], [], []
            for data in _texts(batch, 0):
                tokens = shingles(data)
                node = identity(tokens, seed)[0]
                if not len(tokens) or node in known:
                    continue
                known.add(node)
                prefix = in_order(tokens, 1, posted_length(len(tokens)), crowded)
                salts.append((node % splits[(prefix % np.uint64(CELLS)).astype(np.int64)]).astype(np.int32))
                parts.append(prefix)
                nodes.append(np.full(len(prefix), node, np.int64))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.concatenate(salts)), pa.array(np.concatenate(nodes))], schema=_POSTINGS)

    return post


SHARED = "token long, node long"
_SHARED = pa.schema([("token", pa.int64()), ("node", pa.int64())])


def _shared(splits: np.ndarray):
    """Of postings sorted by token, salt and node: each (token, node) once, of tokens that several sets post.

    State is one row. A split token's rows all stay, as their partners may be in another task.
    """

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None  # the last row while it is alone; its (token, salt, node)
        for batch in batches:
            token, salt, node = (batch.column(i).to_numpy() for i in range(3))
            if not len(token):
                continue
            again = np.zeros(len(token), bool)  # as the row before
            again[1:] = (token[1:] == token[:-1]) & (salt[1:] == salt[:-1]) & (node[1:] == node[:-1])
            again[0] = last == (int(token[0]), int(salt[0]), int(node[0]))
            token, salt, node = token[~again], salt[~again], node[~again]
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
            new[0] = last is None or last[:2] != (int(token[0]), int(salt[0]))
            lone = new.copy()
            lone[:-1] &= new[1:]
            split = splits[(token.view(np.uint64) % np.uint64(CELLS)).astype(np.int64)] > 1
            whole = pa.RecordBatch.from_arrays([pa.array(token), pa.array(node)], schema=_SHARED)
            if held is not None and not new[0]:
                yield held
            yield whole.filter(pa.array(~lone | split))
            held = whole.slice(len(token) - 1) if lone[-1] and not split[-1] else None
            last = (int(token[-1]), int(salt[-1]), int(node[-1]))

    return shared


ABLE = "node long, n long, tokens array<long>"
_ABLE = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (node, n, token) sorted by node: a row for each node with as many tokens as a link takes at least."""
    kept: tuple[np.ndarray, ...] | None = None

    def grouped(node: np.ndarray, n: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        sizes = np.diff(np.append(starts, len(node)))
        able = sizes >= fewest_shared(n[starts])
        offsets = np.append(0, np.cumsum(sizes[able])).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(token[np.repeat(able, sizes)]))
        return pa.RecordBatch.from_arrays([pa.array(node[starts][able]), pa.array(n[starts][able]), lists], schema=_ABLE)

    for batch in batches:
        cols = tuple(batch.column(i).to_numpy() for i in range(3))
        if not len(cols[0]):
            continue
        if kept is not None:
            cols = tuple(np.concatenate(x) for x in zip(kept, cols))
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last node may go on
        if cut:
            yield grouped(*(c[:cut] for c in cols))
        kept = tuple(c[cut:].copy() for c in cols)
    if kept is not None:
        yield grouped(*kept)


SKETCH = "doc_id long, node long, p2 array<short>, p3 array<short>"
_SKETCH = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("p2", pa.list_(pa.int16())), ("p3", pa.list_(pa.int16()))])


def _sketch(seed: int):
    """16 bits of each of a set's first tokens under the second and the third order."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram join")
        for batch in _small(batches):
            nodes, lists = [], ([], [])
            for data in _texts(batch, 1):
                tokens = shingles(data)
                nodes.append(identity(tokens, seed)[0])
                for order, out in zip((2, 3), lists):
                    out.append(np.unique(_mix(in_order(tokens, order, posted_length(len(tokens))), order).astype(np.uint16)).view(np.int16) if len(tokens) else np.zeros(0, np.int16))
            if nodes:
                both = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in out])).astype(np.int32)), pa.array(np.concatenate(out))) for out in lists]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), *both], schema=_SKETCH)

    return sketch


#: Sets of either side in a block of the verification: each text is shipped once for so many partners.
SIDE = 64

_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Numbers in both of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 80 * union of two sorted sets."""
    both = _common(x, y)
    return 100 * both >= 80 * (len(x) + len(y) - both)


def _verify(seed: int):
    """Blocks sorted so that their x texts come before their y texts: the x sets of one block are held, the y stream by.

    A text whose set is not the node's belongs to another row of the same doc_id: it is passed over.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngram join")
        block, held = None, {}
        for batch in batches:
            out = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for key, kind, node, partners, data in zip(keys, *(batch.column(i).to_pylist() for i in (3, 4, 5)), _texts(batch, 6)):
                if key != block:
                    block, held = key, {}
                tokens = shingles(data)
                if identity(tokens, seed)[0] != node:
                    continue
                if kind == 0:
                    held[node] = tokens
                else:
                    out += [(x, node, similar(held[x], tokens)) for x in partners if x in held]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _LINK)], schema=_LINK)

    return verify


PAIRS = "x long, xn long, xc long, y long, yn long, yc long, k long"
_PAIRS = pa.schema([(n, pa.int64()) for n in ("x", "xn", "xc", "y", "yn", "yc", "k")])
#: Shared tokens that a block's count spells out at a time.
MATCHES = 1 << 18


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows that share their first two columns."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        if not len(cols[0]):
            continue
        new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
        if parts and (parts[-1][0][-1], parts[-1][1][-1]) != (cols[0][0], cols[1][0]):
            yield [np.concatenate(x) for x in zip(*parts)]
            parts = []
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(cols[0])]):
            parts.append([c[lo:hi] for c in cols])
            if hi < len(cols[0]):
                yield [np.concatenate(x) for x in zip(*parts)]
                parts = []
    if parts:
        yield [np.concatenate(x) for x in zip(*parts)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that share enough posted tokens, from blocks (chunk, part) of asking (kind 0) and answering sets.

    A block's asking sets are held by token; answering ones, sorted, go by in stretches of MATCHES shared tokens or one
    set. So a pair that shares a hundred tokens is made once, not a hundred times. The asking set is in the component that
    comes first by size.
    """
    claim("ngram join")
    for _, _, kind, *cols in _blocks(batches):
        (token, node, n, c, s), (rtoken, rnode, rn, rc, rs) = ([x[kind == k] for x in cols] for k in (0, 1))
        if not len(token) or not len(rtoken):
            continue
        names, at, asking = np.unique(node, return_index=True, return_inverse=True)
        by_token = np.argsort(token, kind="stable")
        token, asking = token[by_token], asking[by_token]
        lo, hi = np.searchsorted(token, rtoken, "left"), np.searchsorted(token, rtoken, "right")
        total = np.cumsum(hi - lo)
        ends = np.append(np.flatnonzero(np.diff(rnode)) + 1, len(rnode))  # where an answering set ends
        start = 0
        while start < len(rnode):
            before = int(total[start - 1]) if start else 0
            reach = int(np.searchsorted(total, before + MATCHES, "right"))
            i = int(np.searchsorted(ends, max(reach, start + 1), "right")) - 1
            end = int(ends[i]) if i >= 0 and ends[i] > start else int(ends[np.searchsorted(ends, start, "right")])
            many = (hi - lo)[start:end]
            if many.any():
                first = np.cumsum(many) - many
                spot = np.repeat(lo[start:end] - first, many) + np.arange(int(many.sum()))
                key = np.repeat(np.arange(start, end), many)
                key = np.searchsorted(ends, key, "right") * len(names) + asking[spot]
                pair, k = np.unique(key, return_counts=True)
                y, x = ends[pair // len(names)] - 1, at[pair % len(names)]
                long, short = np.maximum(n[x], rn[y]), np.minimum(n[x], rn[y])
                good = ((s[x] < rs[y]) | (s[x] == rs[y]) & (c[x] < rc[y])) & (4 * long <= 5 * short) & (k >= shared_at_least(short, long))
                x, y, k = x[good], y[good], k[good]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (node[x], n[x], c[x], rnode[y], rn[y], rc[y], k)], schema=_PAIRS)
            start = end


def fits(n: Column, m: Column) -> Column:
    """Sizes that allow a similarity of 0.8."""
    return (F.greatest(n, m) * 4 <= F.least(n, m) * 5)


def _posted(n: Column) -> Column:
    return n - F.ceil(n * 7 / F.lit(10)) + 1


def least_shared(n: Column, m: Column) -> Column:
    """shared_at_least() for columns."""
    return F.greatest(F.lit(1), F.ceil((n + m) * 4 / F.lit(9)) - F.ceil(F.greatest(n, m) * 7 / F.lit(10)) + 1)


#: Edges that one task joins up; graphs of more are contracted first.
FEW_EDGES = 20_000

_PARENT = pa.schema([("node", pa.int64()), ("parent", pa.int64())])


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, parent) of all edges of a graph: the parent is the component's smallest node."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(u), top(v)
            parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], schema=_PARENT)


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root) of an undirected graph (u, v): root is the component's smallest node.

    Each round hooks every node to the neighbour that comes first in a scrambled order and contracts the graph; scrambling
    keeps the rounds logarithmic for chains, too. Once FEW_EDGES are left, one task joins them up: the last rounds would
    be many jobs about few rows.
    """
    current = scratch.save(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{label}-edges0")
    rounds: list[DataFrame] = []

    def key(c: str) -> Column:
        return F.struct(F.xxhash64(F.lit(len(rounds)), F.col(c)).alias("h"), F.col(c).alias("id"))

    while left := current.count():
        if left <= FEW_EDGES:
            rounds.append(scratch.save(current.coalesce(1).mapInArrow(_join_up, "node long, parent long"), f"{label}-parent{len(rounds)}"))
            break
        both = current.select("u", "v").union(current.select("v", "u"))
        parent = both.groupBy(F.col("u").alias("node")).agg(F.min(key("v")).alias("best"))
        parent = scratch.save(parent.select("node", F.least("best", key("node"))["id"].alias("parent")), f"{label}-parent{len(rounds)}")
        rounds.append(parent)
        a, b = parent.toDF("u", "pu"), parent.toDF("v", "pv")
        moved = current.join(a, "u").join(b, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
        current = scratch.save(moved.distinct(), f"{label}-edges{len(rounds)}")
    if not rounds:
        return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = rounds[0].toDF("node", "root")
    for later in rounds[1:]:
        later = later.toDF("root", "next")
        found = found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    found = scratch.save(found, f"{label}-found")
    least = scratch.save(found.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("least")), f"{label}-least")
    return found.join(least, "root").select("node", F.col("least").alias("root"))


def _identified(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """Rows of _see and the seed with which a set's node alone tells it from every other."""
    seed = 0
    while True:
        seen = scratch.save(texts.mapInArrow(_see(seed), SEEN), "seen")
        sets = seen.where("n > 0").select("a", "b").distinct()
        if sets.groupBy("a").count().where("count > 1").isEmpty():
            return seen, seed
        seed += 1


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links reach, its own included).

    Documents with the same set are one node from the start. Each set's prefix under the first order, in which crowded
    shingles come last, is posted; tokens posted by several sets give candidates. First each set is tried with one likely
    original and what links is joined up; then every pair of sets in different components that shares enough first prefix
    tokens is a candidate. Candidates must share enough prefix tokens under the second and the third order, too, by
    16-bit marks of them, before any text is shipped: the filters are intersected, and a mark can only let a pair pass.
    What is left is verified on its whole sets. No links are lost: pairs within one component need no test.
    Null and empty texts, and those without words, have no shingles and are alone; their component is their own doc_id.
    Rows that share a doc_id are documents each, and so are rows with a null doc_id. An empty table gives an empty result;
    other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text"))
    seen, seed = _identified(texts, scratch)
    rows = seen.where("cell is null").select("doc_id", "n", F.col("a").alias("node"))
    loads = np.zeros(CELLS, np.float64)
    for r in seen.where("cell is not null").groupBy("cell").agg(F.sum("load").alias("load")).collect():  # CELLS rows at most
        loads[r["cell"]] = r["load"]
    excess = loads - np.median(loads) - 8 * np.sqrt(np.median(loads) + 1)
    crowded = np.where(excess > 0, np.clip(np.log2(np.maximum(excess, 1)) + 1, 1, 63), 0).astype(np.uint8)
    splits = np.maximum(1, np.ceil(excess / RUN)).astype(np.int64)
    nodes = scratch.save(rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep")), "nodes")

    postings = texts.select("text").mapInArrow(_post(crowded, splits, seed), POSTINGS)
    dealt = postings.repartition("token", "salt").sortWithinPartitions("token", "salt", "node")
    shared = scratch.save(dealt.mapInArrow(_shared(splits), SHARED), "shared")
    # sets with too few shared tokens for any link are out
    by_node = shared.join(nodes.select("node", "n"), "node").select("node", "n", "token").sortWithinPartitions("node")
    able = scratch.save(by_node.mapInArrow(_gather, ABLE), "able")
    scratch.drop("shared")
    reps = able.select("node").join(nodes, "node").select("node", F.col("rep").alias("doc_id"))
    drawn = marked(texts, reps, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sketch(seed), SKETCH)
    sketches = scratch.save(drawn.join(reps, ["node", "doc_id"]).dropDuplicates(["node"]).drop("doc_id"), "sketches")

    # Of a token's other sets the one that shares the largest part of its prefix leads: an original shares all of it, its
    # edited copies what they left. One try for each set with such a leader comes first, by a quarter of the tokens.
    some = able.select("node", "n", (F.size("tokens") / _posted(F.col("n"))).alias("part"), F.explode(F.filter("tokens", lambda t: F.pmod(t, F.lit(4)) == 0)).alias("token"))
    leads = some.groupBy("token").agg(F.max(F.struct("part", "node", "n")).alias("lead")).select("token", F.col("lead.node").alias("x"), F.col("lead.n").alias("xn"))
    stars = some.select("token", F.col("node").alias("y"), F.col("n").alias("yn")).join(scratch.save(leads, "leads"), "token")
    stars = stars.where((F.col("x") != F.col("y")) & fits(F.col("xn"), F.col("yn"))).groupBy("x", "xn", "y", "yn").agg(F.count("*").alias("k"))
    stars = stars.where(F.col("k") * 8 >= least_shared(F.col("xn"), F.col("yn")))  # half of what a link needs, as far as a quarter tells
    stars = stars.groupBy("y", "yn").agg(F.max_by(F.struct("x", "xn"), F.struct("k", "x")).alias("best")).select("best.*", "y", "yn")
    stars = _sieved(stars, sketches).select("x", "y", F.col("x").alias("g"))
    edges = scratch.save(_tried(stars, nodes, texts, "stars", seed, scratch).where("linked").select(F.col("a").alias("u"), F.col("b").alias("v")), "star-links")
    scratch.drop("leads")
    first = components(edges, scratch, "first")
    placed = able.select("node").join(first, "node", "left").select("node", F.coalesce("root", "node").alias("c"))
    labels = scratch.save(placed, "placed")
    sizes = scratch.save(labels.groupBy("c").agg(F.count("*").alias("s")), "sizes")  # written, so that a large component's rows can be split
    posted = scratch.save(able.join(labels.join(sizes, "c"), "node").select("node", "n", "c", "s", "tokens"), "posted")
    scratch.drop("able")
    pairs = scratch.save(_sieved(_open_pairs(posted, scratch), sketches), "rest0")
    scratch.keep("seen", "nodes", "placed", "rest0")

    wanted = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct().join(nodes, "node").select(F.col("rep").alias("doc_id"))
    live = scratch.save(fetched(texts, scratch.save(wanted.distinct(), "live-ids")), "live")
    turn = 0
    while not pairs.isEmpty():
        # the likeliest pair of any two components first: what it joins needs no further test; once that joins none, all
        turn += 1
        two = [F.least("xc", "yc").alias("u"), F.greatest("xc", "yc").alias("v")]
        likely = F.struct(F.col("k") / least_shared(F.col("xn"), F.col("yn")), "x", "y")
        best = pairs.groupBy(*two).agg(F.max_by(F.struct("x", "xc", "y", "yc"), likely).alias("b")).select("b.*")
        tried = scratch.save(_tried(_grouped(best), nodes, live, f"best{turn}", seed, scratch), f"tried{turn}")
        linked = tried.where("linked")
        last_turn = linked.isEmpty()
        done = tried.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        pairs = pairs.withColumns({"_p": F.least("x", "y"), "_q": F.greatest("x", "y")}).join(done.toDF("_p", "_q"), ["_p", "_q"], "left_anti").drop("_p", "_q")
        if last_turn:
            linked = scratch.save(_tried(_grouped(pairs), nodes, live, f"all{turn}", seed, scratch).where("linked"), f"linked-all{turn}")
        edges = linked.select(F.col("a").alias("node"), "b").join(labels, "node").select(F.col("c").alias("u"), F.col("b").alias("node")).join(labels, "node").select("u", F.col("c").alias("v"))
        joined = scratch.save(components(edges, scratch, f"turn{turn}").toDF("c", "root"), f"joined{turn}")
        labels = scratch.save(labels.join(joined, "c", "left").select("node", F.coalesce("root", "c").alias("c")), f"labels{turn}")
        if last_turn:
            break
        for side in ("xc", "yc"):
            pairs = pairs.join(joined.toDF(side, "_root"), side, "left").withColumn(side, F.coalesce("_root", side)).drop("_root")
        pairs = scratch.save(pairs.where("xc <> yc"), f"rest{turn}")
        scratch.keep("seen", "nodes", "live", f"labels{turn}", f"rest{turn}")

    found = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("c", "node").alias("c"))
    least = found.groupBy("c").agg(F.min("rep").alias("component_id"))
    found = scratch.save(found.join(least, "c").select("node", "component_id"), "found")
    scratch.keep("seen", "found")
    out = rows.where("n > 0").join(found, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    back = [F.when(F.col(c) != NO_ID, F.col(c)).alias(c) for c in ("doc_id", "component_id")]
    return out.unionByName(alone).select(back[0], "n_shingles", back[1])


def _sieved(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (x, xn, y, yn, ...) that may share enough first tokens under the second and under the third order, too.

    Marks that fall together within a set are made up for, so no pair is lost whatever collides.
    """
    both = pairs
    for side in ("x", "y"):
        both = both.join(sketches.select(F.col("node").alias(side), F.col("p2").alias(f"_{side}2"), F.col("p3").alias(f"_{side}3")), side)
    enough = least_shared(F.col("xn"), F.col("yn"))
    for order in "23":
        mine, other = f"_x{order}", f"_y{order}"
        both = both.where(F.size(F.array_intersect(mine, other)) + _posted(F.col("xn")) - F.size(mine) >= enough)
    return both.select(*pairs.columns)


def _open_pairs(posted: DataFrame, scratch: Scratch) -> DataFrame:
    """PAIRS between components that share enough of (node, n, c, s, tokens), s being the size of component c.

    Of a token's components, sets of all but the largest ask, and the larger ones answer, so that a pair is always asked
    from the same side. Asking sets that have their least token in common are likely to share the others; they form chunks
    of about SIDE, and a chunk gets each answering row once. A chunk's answers are dealt into parts by their expected
    number, so a token that very many sets hold makes more parts, not a larger one.
    """
    order = F.struct("s", "c")
    spelled = posted.select("node", "n", "c", "s", F.explode("tokens").alias("token"))
    tops = spelled.groupBy("token").agg(F.max(order).alias("top"), F.min(order).alias("low"), F.count("*").alias("df")).where("top <> low").select("token", "top", "df")
    rows = scratch.save(spelled.join(scratch.save(tops, "tops"), "token").withColumn("asks", order < F.col("top")).drop("top"), "open")
    scratch.drop("tops", "posted")
    asking = rows.where("asks")
    homes = scratch.save(asking.groupBy("node").agg(F.min(F.xxhash64("token")).alias("home")), "homes")
    crowds = homes.groupBy("home").agg(F.count("*").alias("m"))
    chunk = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / SIDE)))
    homes = scratch.save(homes.join(crowds, "home").select("node", chunk.alias("chunk")), "chunks")
    asking = scratch.save(asking.join(homes, "node").select("chunk", "token", "node", "n", "c", "s", "df"), "asking")
    wanted = scratch.save(asking.groupBy("chunk", "token").agg(F.first("df").alias("df")), "wanted")
    parts = scratch.save(wanted.groupBy("chunk").agg(F.ceil(F.sum("df") / ANSWERS).cast("int").alias("parts")), "parts")
    own = ["token", "node", "n", "c", "s"]
    left = asking.join(parts, "chunk").select("chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), *own)
    right = rows.drop("df").join(wanted.join(parts, "chunk").select("chunk", "token", "parts"), "token")
    right = right.select("chunk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), *own)
    dealt = left.unionByName(right).repartition("chunk", "part").sortWithinPartitions("chunk", "part", "kind", "node")
    return dealt.mapInArrow(_count, PAIRS)


def _tried(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, label: str, seed: int, scratch: Scratch) -> DataFrame:
    """(a, b, linked) of pairs (x, y, g): candidates of one g share sets, so they are verified in blocks.

    A g's x and y are dealt into chunks of about SIDE; a block is a chunk of either, and gets each of its texts once. No
    text is shipped for each of its pairs, and no block grows with its g.
    """
    pairs = scratch.save(pairs, f"{label}-pairs")
    sizes = pairs.groupBy("g").agg(F.approx_count_distinct("x").alias("nx"), F.approx_count_distinct("y").alias("ny"))
    chunk = [F.pmod(F.xxhash64(c), F.ceil(F.col(f"n{c}") / SIDE)).cast("int").alias(f"{c}b") for c in ("x", "y")]
    dealt = scratch.save(pairs.join(sizes, "g").select("g", *chunk, "x", "y"), f"{label}-blocks")
    key = ["g", "xb", "yb"]
    left = dealt.select(*key, F.lit(0).alias("kind"), F.col("x").alias("node")).distinct().withColumn("partners", F.array().cast("array<bigint>"))
    right = dealt.groupBy(*key, F.col("y").alias("node")).agg(F.collect_list("x").alias("partners")).select(*key, F.lit(1).alias("kind"), "node", "partners")
    rows = scratch.save(left.unionByName(right).join(nodes.select("node", F.col("rep").alias("doc_id")), "node"), f"{label}-sides")
    held = marked(texts, rows.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    blocks = rows.join(held, "doc_id").select(*key, "kind", "node", "partners", "text")
    return blocks.repartition(*key).sortWithinPartitions(*key, "kind").mapInArrow(_verify(seed), "a long, b long, linked boolean")


def _grouped(pairs: DataFrame) -> DataFrame:
    """(x, y, g) of pairs between components: g is the one that has more of the pairs, and y is in it."""
    counts = pairs.select(F.explode(F.array("xc", "yc")).alias("c")).groupBy("c").agg(F.count("*").alias("k"))
    both = pairs.join(counts.toDF("xc", "xk"), "xc").join(counts.toDF("yc", "yk"), "yc")
    more = (F.col("xk") > F.col("yk")) | ((F.col("xk") == F.col("yk")) & (F.col("xc") < F.col("yc")))
    return both.select(F.when(more, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(more, F.col("x")).otherwise(F.col("y")).alias("y"), F.when(more, F.col("xc")).otherwise(F.col("yc")).alias("g"))


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, the one with the component's id, in docs' columns.

    Rows that share a doc_id stay if one of them does. A null doc_id comes first, so where a component has such rows they all stay
    and its other rows go.
    """
    found = near_duplicates(docs).where("doc_id is not null")
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id")).cast("int")).alias("stays")
    drop = Scratch(docs.sparkSession, "near-drop").save(found.groupBy("doc_id").agg(stays).where("stays = 0").select("doc_id"), "ids")
    return without(docs, drop)
