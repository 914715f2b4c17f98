"""Spelling: unknown words, candidates by edits and frequency, repair of names and of identity numbers.

What a repair decides for one word depends on the words before it, so it runs in Arrow batches with the dictionary
broadcast; the dictionary's size is checked where it is collected.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.functions.folding import fold_table
from fieldlens.functions.text import dictionary_word

#: Words that a broadcast dictionary may have.
WORDS_LIMIT = 2_000_000
#: Letters beyond the longest dictionary word from which a string is not a word.
TOO_LONG = 3
_FOLD = str.maketrans({**fold_table(), "\t": " ", "\n": " ", "\r": " "})


def fold_text(s: str) -> str:
    """fold() of the text functions, for one string."""
    return s.translate(_FOLD)


def load_words(texts: DataFrame, column: str = "value") -> DataFrame:
    """(word, count) of a word file: one word or more on a line."""
    words = texts.select(F.explode(F.split(F.lower(F.trim(column)), r"\s+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("count"))


def new_words(texts: DataFrame, known: DataFrame, column: str = "text") -> DataFrame:
    """Distinct cleaned words of texts that a dictionary (word) lacks, by length, then alphabet."""
    words = texts.select(F.explode(F.split(dictionary_word(F.col(column)), " ")).alias("word")).where("word <> ''").distinct()
    return words.join(known.select("word").distinct(), "word", "left_anti").orderBy(F.length("word"), "word")


def shortened(word: Column, letters: int = 2) -> Column:
    """The distinct strings left of a word when up to so many of its letters are taken out."""
    every = level = F.array(word)

    def without_one(w: Column) -> Column:
        places = F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))

    for _ in range(letters):
        level = F.array_distinct(F.flatten(F.transform(level, without_one)))
        every = F.array_distinct(F.concat(every, level))
    return every


def candidate_words(words: DataFrame, known: DataFrame, distance: int = 2) -> DataFrame:
    """(word, candidate, edits, count) of dictionary words within an edit distance.

    Known words have themselves only. Words within k edits have a string in common once up to k letters are taken out of
    either; that string is the join key, so hardly a pair is made that is not near.
    """
    asked = words.select("word").where("word is not null").distinct()
    same = asked.join(known, "word").select("word", F.col("word").alias("candidate"), F.lit(0).alias("edits"), "count")
    rest = asked.join(known, "word", "left_anti").select("word", F.explode(shortened(F.col("word"), distance)).alias("left"))
    listed = known.select(F.col("word").alias("candidate"), "count", F.explode(shortened(F.col("word"), distance)).alias("left"))
    pairs = rest.join(listed, "left").select("word", "candidate", "count").distinct()
    pairs = pairs.withColumn("edits", F.levenshtein("word", "candidate", distance)).where("edits >= 0")
    return same.unionByName(pairs.select("word", "candidate", "edits", "count"))


def corrections(words: DataFrame, known: DataFrame, distance: int = 2) -> DataFrame:
    """(word, correction): the candidate of the fewest edits, then the most frequent, then the first; the word without one.

    The original leaves ranking to an external list that is not public; this order is this library's own.
    """
    found = candidate_words(words, known, distance)
    best = found.groupBy("word").agg(F.min_by("candidate", F.struct("edits", -F.col("count"), "candidate")).alias("correction"))
    return words.select("word").where("word is not null").distinct().join(best, "word", "left").select("word", F.coalesce("correction", "word").alias("correction"))


@dataclass
class Speller:
    """A dictionary in one worker: lower-case words with counts."""

    counts: dict[str, int]
    distance: int = 2
    by_length: dict[int, tuple[list[str], np.ndarray]] = field(default_factory=dict)
    longest: int = -1

    def checks(self, word: str) -> bool:
        """Whether a word can be wrong: numbers, lone punctuation marks and what is far too long for a word cannot."""
        if self.longest < 0:
            self.longest = max(map(len, self.counts), default=0)
        return not (is_number(word) or len(word) == 1 and word in string.punctuation or len(word) > self.longest + TOO_LONG)

    def knows(self, word: str) -> bool:
        return word == "" or word.lower() in self.counts or not self.checks(word)

    def candidates(self, word: str) -> list[str]:
        """The dictionary's nearest words within the distance, the most frequent first; a word that is known has itself.

        Words differ in two letters at most for each edit; those that differ in more are passed over by their letters alone.
        """
        low = word.lower()
        if self.knows(word):
            return [low]
        if not self.by_length:
            for w in self.counts:
                self.by_length.setdefault(len(w), []).append(w)
            self.by_length = {n: (ws, np.array([letter_mask(w) for w in ws], np.uint64)) for n, ws in self.by_length.items()}
        mine, near = np.uint64(letter_mask(low)), []
        for n in range(len(low) - self.distance, len(low) + self.distance + 1):
            ws, masks = self.by_length.get(n, ((), None))
            if len(ws):
                likely = np.flatnonzero(np.bitwise_count(masks ^ mine) <= 2 * self.distance)
                near += [(edits(low, ws[i], self.distance), ws[i]) for i in likely.tolist()]
        least = min((d for d, _ in near), default=self.distance + 1)
        return sorted((w for d, w in near if d == least <= self.distance), key=lambda w: (-self.counts[w], w))

    def joined(self, words: list[str]) -> tuple[set[str], list[str]]:
        """(unknown words, all words), upper-cased, after unknown ones are glued to a neighbour where that is a word.

        A word looks back if the one before it is free, else forward: so only the first, or one right after a glued pair,
        looks forward.
        """
        words = [w.upper() for w in words]
        out: list[str] = []
        free = i = 0  # out[free:] may still be glued
        while i < len(words):
            word = words[i]
            if not self.knows(word):
                if len(out) > free:
                    if self.knows(out[-1] + word):
                        out[-1] += word
                        free, i = len(out), i + 1
                        continue
                elif i + 1 < len(words) and self.knows(word + words[i + 1]):
                    out.append(word + words[i + 1])
                    free, i = len(out), i + 2
                    continue
            out.append(word)
            i += 1
        out = [w for w in out if w]
        return {w for w in out if not self.knows(w)}, out


def is_number(word: str) -> bool:
    """Whether a word reads as a number: digits with a sign, a point or an exponent."""
    try:
        float(word)
    except ValueError:
        return False
    return True


def letter_mask(word: str) -> int:
    """A bit for each letter that is in the word; letters share 64 bits."""
    return reduce(or_, (1 << (ord(c) & 63) for c in word), 0)


def edits(a: str, b: str, limit: int) -> int:
    """Levenshtein distance, limit + 1 if it is beyond the limit."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > limit:
            return limit + 1
    return min(row[-1], limit + 1)


_PHRASE = re.compile(r"(?=.)((?:[A-Za-z0-9 ]*[A-Za-z0-9])?)((?:[^A-Za-z0-9]*))", re.S)


def split_phrases(s: str) -> list[tuple[str, str]]:
    """(words, separator) pairs of a text; places are found on the folded text, spaces collapse."""
    return [tuple(re.sub(" +", " ", s[a:b]) for a, b in (m.span(1), m.span(2))) for m in _PHRASE.finditer(fold_text(s)) if m.group()]


def adjusted(s: str, speller: Speller, correct: bool = True, strip_short: bool = False, numeric_first: bool = False, titles: tuple[str, ...] = ()) -> str:
    """A text with unknown words corrected and printed titles left out; separators stay.

    Unknown words go if a candidate is a title, known ones if they are. strip_short leaves out leading words of up to two
    letters and leading separators; numeric_first leaves out what stands before the first digit, or acts as strip_short
    if there is none.
    """
    printed = {fold_text(t.lower()) for t in titles}
    phrases = split_phrases(s)
    if numeric_first and not any(ch in "0123456789" for words, _ in phrases for ch in words):
        numeric_first, strip_short = False, True
    out = ""
    for words, separator in phrases:
        if numeric_first and not out and not any(ch in "0123456789" for ch in words):
            continue
        if words:
            unknown, known = speller.joined(words.split(" "))
            for i, word in enumerate(known):
                if word in unknown:
                    found = speller.candidates(word) if printed or correct else []
                    if printed & {fold_text(c) for c in found}:
                        word = ""
                    elif correct and found:
                        word = found[0].upper()
                elif word.lower() in printed:
                    word = ""
                if strip_short and not out and len(word) <= 2:
                    word = ""
                out += (" " if i and out else "") + word
        if out or not strip_short:
            out += separator
    return out.strip()


def corrected(s: str, speller: Speller) -> str:
    """A text with unknown words corrected, every separator kept, trimmed."""
    out = []
    for words, separator in split_phrases(s):
        unknown, known = speller.joined(words.split(" ")) if words else (set(), [])
        out.append(" ".join((speller.candidates(w) or [w])[0].upper() if w in unknown else w for w in known) + separator)
    return "".join(out).strip()


def lattice(s: str, speller: Speller) -> list[list[str]]:
    """The alternatives of each word and separator: one for known words, the candidates for others."""
    out: list[list[str]] = []
    for words, separator in split_phrases(s):
        if words:
            unknown, known = speller.joined(words.split(" "))
            out += [(speller.candidates(w) or [w]) if w in unknown else [w] for w in known]
        if separator:
            out.append([separator])
    return out


def listed(rows: DataFrame) -> list:
    """The rows of a list that workers hold whole; an error above WORDS_LIMIT of them."""
    found = rows.limit(WORDS_LIMIT + 1).collect()
    if len(found) > WORDS_LIMIT:
        raise ValueError(f"a list of more than {WORDS_LIMIT} rows: join with corrections() instead")
    return found


def speller_of(words: DataFrame) -> Speller:
    """A worker's dictionary from (word, count) rows; refused above WORDS_LIMIT words."""
    return Speller({r["word"]: r["count"] for r in listed(words.groupBy("word").agg(F.max("count").alias("count")))})


def spell_adjust(df: DataFrame, column: Column, words: DataFrame, out: str = "adjusted", **how) -> DataFrame:
    """df with adjusted() of a column, in Arrow batches."""
    shipped = df.sparkSession.sparkContext.broadcast(speller_of(words))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for batch in batches:
            if len(known) > 100_000:
                known.clear()
            for s in set(batch.dropna()) - known.keys():
                known[s] = adjusted(s, shipped.value, **how)
            yield batch.map(known.get)

    return df.withColumn(out, run(column))


# --- identity numbers -------------------------------------------------------------------------------------------------

# Shapes of an identity that are right as they are. # number, O issuer, U state, . : x one, two or more
# letters, / itself, _ anything else.
SHAPES = "#", "O", "U", "#O", "O#", "U#", "#_U", "O_#", "#_O", "O/U", ".#O", "U#_O", ".#_O", ":#_O", "#_O/U", "#_O_U", "#_O/:_U", "#_O/O_U"
_TOKENS = re.compile(r"[/-]|\d+|[a-z]+|[^0-9^a-z/-]+|\^.*", re.S)


def shape_of(tokens: list[str], issuers: dict[str, int], states: set[str]) -> str:
    def code(t: str) -> str:
        if t[0].isdigit():
            return "#"
        if t == "/":
            return "/"
        if t in issuers:
            return "O"
        if t in states:
            return "U"
        return ".:x"[min(len(t), 3) - 1] if "a" <= t[0] <= "z" else "_"

    return "".join(map(code, tokens))


def _indel(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return len(a) + len(b) - 2 * row[-1]


def near_issuer(word: str, issuers: dict[str, int], most: int = 4) -> str:
    """The nearest issuer within an error, the word itself without one."""
    found = [(e, -(200.0 * (len(word) + len(c) - e) / 2 / (len(word) + len(c))), pos, c) for c, pos in issuers.items() if (e := _indel(word, c)) <= most]
    return min(found)[-1] if found else word


def identity(s: str, issuers: dict[str, int], states: set[str]) -> str:
    """An identity number with issuer and state, cut out of what was read around it, upper-cased."""
    words = ["ssp" + w[3:] if w[:3].replace("8", "s") == "ssp" else w for w in s.lower().split(" ") if w]
    tokens = _TOKENS.findall(fold_text(" ".join(words)))
    shape = shape_of(tokens, issuers, states)
    numbers = [i for i, c in enumerate(shape) if c == "#"]
    while True:
        for drop_left, drop_right, fits in ((0, 0, shape == ""), (0, 0, True), (0, 1, shape.endswith("_")), (1, 0, shape.startswith("_")), (0, 2, shape.endswith("_."))):
            part = shape[drop_left : len(shape) - drop_right]
            if fits and (part in SHAPES or shape == ""):
                return "".join(tokens[drop_left : len(tokens) - drop_right]).upper()
        if "O" in shape:
            break
        at = next((i for i in range(len(shape) - 1, -1, -1) if shape[i] == "x" and near_issuer(tokens[i], issuers) != tokens[i]), None)
        if at is None:
            break
        tokens[at] = near_issuer(tokens[at], issuers)
        shape = shape[:at] + "O" + shape[at + 1 :]
    offices = [i for i, c in enumerate(shape) if c == "O"]
    if not numbers and not offices:
        return "".join(tokens).upper()
    # spans from the first to the last number and issuer; those of the issuers beside the numbers count, right before left
    n_span = list(range(numbers[0], numbers[-1] + 1)) if numbers else []
    o_span = list(range(offices[0], offices[-1] + 1)) if offices else []
    if n_span and o_span:
        right, left = [i for i in o_span if i > n_span[-1]], [i for i in o_span if i < n_span[0]]
        if right or left:
            o_span = right or left
        else:
            n_span = [i for i in n_span if i < o_span[0]]
    first, last = min(n_span + o_span), max(n_span + o_span)
    if n_span and n_span[0] == first > 0 and shape[first - 1] in "x.:OU":
        first -= 1
        tokens[first] = tokens[first][-2:]
    after = [i for i in range(last, len(shape)) if shape[i] == "U"] or [i for i in range(last, len(shape)) if shape[i] == ":"]
    last = max(last, after[-1]) if after else last
    for i in n_span:
        if not (tokens[i][:1].isdigit() or "a" <= tokens[i][:1] <= "z"):
            tokens[i] = "".join(c for c in tokens[i] if c in "-/")
    return "".join(tokens[first : last + 1]).upper()


def identity_repair(df: DataFrame, column: Column, issuers: DataFrame, states: DataFrame, out: str = "identity") -> DataFrame:
    """df with identity() of a column. Issuers (pos, code) and states (uf) are shipped whole: lists above WORDS_LIMIT are refused."""
    codes = {r["code"]: r["pos"] for r in listed(issuers.select("code", "pos"))}
    ufs = {r["uf"] for r in listed(states.select("uf").distinct())}

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda s: None if s is None else identity(s, codes, ufs))

    return df.withColumn(out, run(column))
