"""Packing tokenised documents into sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import Scratch, claim, group_slots

CAPACITY = 1024
END = 0
#: Words whose ids a worker keeps, at some 200 bytes each; where other stages need the memory, fewer do at more CPU time.
REMEMBERED = 1_600_000
#: Rows of the slot table up to which it is broadcast; a plain join beyond.
SLOTS_BROADCAST = 200_000

_TURNS = re.compile(r"(?<=[^\W\d_])(?=[.,])|(?<=[.,])(?=\n)|(?<=[.,\n])(?=[^\W\d_])")


class _Remembered(dict):
    """Ids of words, made on first use. The older half goes when it is full, except what is used again."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(self) >= self.most // 2:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class _Whole(Exception):
    """The text must go to the tokenizer whole."""


def cuts_at_spaces(tokenizer) -> bool:
    """Whether a tokenizer is plain byte-level BPE, whose pattern cuts texts as WordEncoder does."""
    cut, model = tokenizer.pre_tokenizer, tokenizer.model
    byte_level = type(cut).__name__ == "ByteLevel" and cut.use_regex and not cut.add_prefix_space
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    return bool(byte_level and tokenizer.normalizer is None and type(model).__name__ == "BPE" and not any(getattr(model, k, None) for k in odd))


class WordEncoder:
    """A tokenizer's ids as little-endian unsigned 32-bit bytes, remembered by word.

    The byte-level pattern always starts a new piece at a space that follows a non-space, so a text's ids are those of
    its space-led words, in a row; within a word it also starts one between a letter and a full stop or comma, and
    between these or a line end and a letter. Texts in which a space follows white space, or with the special token's
    string, go to the tokenizer whole, as does every text where the tokenizer is of another kind.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = cuts_at_spaces(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bare = _Remembered(self._encode, remembered // 4)
        self.led = _Remembered(self._led, remembered)
        self.merge = self.tokenizer.model.tokenize
        self.bytes = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())] if self.by_word else []
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 in order
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: 256 + i for i, b in enumerate(others)}
        self.space = chr(self.alphabet[32])
        self.marks = {m: self._encode(m) for m in ".,"} if self.by_word else {}

    def _letters(self, word: str, lead: str) -> bytes:
        """Letters alone are one piece: no splitting is needed before the merges."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([self.bytes[t.id] for t in self.merge(lead + word)])

    def _encode(self, text: str) -> bytes:
        if text.isalpha():
            return self._letters(text, "")
        return b"".join([self.bytes[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _led(self, word: str) -> bytes:
        if word.isalpha():
            return self._letters(word, self.space)
        if not word or word[-1].isspace() or any(s in word for s in self.special):
            raise _Whole
        if word[-1] in self.marks and word[:-1].isalpha():
            return self.led[word[:-1]] + self.marks[word[-1]]
        head, *tail = _TURNS.split(word)
        return (self.led[head] if tail else self._encode(" " + word)) + b"".join(map(self.bare.__getitem__, tail))

    def __call__(self, text: str) -> bytes:
        if not self.by_word:
            return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        first, *words = text.split(" ")
        if not words or first[-1:].isspace() or any(s in first or s in words[-1] for s in self.special):
            return self._encode(text)
        last = words.pop()
        try:
            middle = b"".join(map(self.led.__getitem__, words))
        except _Whole:
            return self._encode(text)
        return (self._encode(first) if first else b"") + middle + self._encode(" " + last)


@cache
def encoder(path: str, remembered: int) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path, remembered)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """Each document's ids and the end id, cut every capacity ids: PIECES. Null text counts as empty: the end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", encoder.cache_clear)
        encode = encoder(tokenizer, remembered)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[tuple] = []
                for doc_id, text in zip(part.column(0), part.column(1)):
                    ids = encode(text.as_py() or "") + END.to_bytes(4, "little")
                    n, key = len(ids) // 4, doc_id.as_py()
                    out.extend((key, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how many packs, their lengths) patterns that hold every length as often as the histogram says.

    Lengths go longest first; each goes to the pack that is shortest, if it fits there, as many at a time as there are
    packs of that pattern; the rest open packs of their own. Work depends on capacity, not on the counts.
    """
    by_fill: dict[int, list[tuple[int, list[int]]]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        moved: list[tuple[int, int, list[int]]] = []
        while left:
            fill = min((f for f in by_fill if f + length <= capacity), default=None)
            if fill is None:
                again = next((i for i, (f, _, _) in enumerate(moved) if f + length <= capacity), None)
                if again is None:
                    moved.append((length, left, [length]))
                    left = 0
                    continue
                fill, n, pattern = moved.pop(again)
            else:
                n, pattern = by_fill[fill].pop()
                if not by_fill[fill]:
                    del by_fill[fill]
            k = min(n, left)
            moved.append((fill + length, k, [*pattern, length]))
            if n > k:
                by_fill.setdefault(fill, []).append((n - k, pattern))
            left -= k
        # packs opened for this length may take it again
        while True:
            own = next((i for i, (f, n, p) in enumerate(moved) if p == [length] and f + length <= capacity and n > 1), None)
            if own is None:
                break
            _, n, _ = moved.pop(own)
            times = capacity // length
            full, over = divmod(n, times)
            if full:
                moved.append((times * length, full, [length] * times))
            if over:
                moved.append((over * length, 1, [length] * over))
        for fill, n, pattern in moved:
            by_fill.setdefault(fill, []).append((n, pattern))
    return [(n, p) for fill in sorted(by_fill) for n, p in by_fill[fill]]


def slots(patterns: list[tuple[int, list[int]]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, end rank, first sequence, offset) of each place in each pattern; the number of sequences."""
    out, used, base = [], Counter(), 0
    for n, pattern in patterns:
        offset = 0
        for length in pattern:
            out.append((length, used[length], used[length] + n, base, offset))
            used[length] += n
            offset += length
        base += n
    return out, base


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: PIECES, sequence_id, offset.

    Documents are cut every capacity ids. Full pieces are sequences of their own. The other pieces' lengths, at most
    capacity - 1 of them, form a histogram on which the driver plans patterns; each piece then finds its place by its
    rank among pieces of its length. Null and empty texts are one end id each; repeated rows are separate documents; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    every = scratch.save(pieces(docs, tokenizer, capacity, remembered), "pieces")
    rest = every.where(F.col("length") < capacity)
    histogram = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # < capacity rows
    places, sequences = slots(shortest_pack_first(histogram, capacity))
    table = spark.createDataFrame(places, "_length long, _first long, _end long, _base long, _offset long")
    ranked = group_slots(rest, rest, ["length"], ["doc_id", "ids_crc32"], "_rank", sum(histogram.values()))
    found = ranked.join(
        F.broadcast(table) if len(places) <= SLOTS_BROADCAST else table,
        (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")),
    ).select(*every.columns, (F.col("_base") + F.col("_rank") - F.col("_first")).alias("sequence_id"), F.col("_offset").alias("offset"))
    full = every.where(F.col("length") == capacity).withColumn("sequence_id", F.lit(sequences) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return found.unionByName(full)
