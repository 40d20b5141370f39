"""Operator 1: best-fit packing of token pieces with exact complements found by hashed length sums."""

from __future__ import annotations

import os
import re
import string
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.llm.common import read, record, spread, staged

SCHEMA = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))
DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A worker keeps the ids of so many words at most, and of so many characters and bytes.
CACHE_WORDS, CACHE_CHARS = 300_000, 20_000_000
#: str.split() also parts words at these four, which the tokenizer doesn't take for white space.
SEPARATORS, BLANKS = "\x1c\x1d\x1e\x1f", re.compile("[ \\t\\n\\r]+")
#: Signs of ASCII but for the apostrophe, which may begin a contraction.
SIGNS = string.punctuation.replace("'", "")
#: How byte-level models show bytes that aren't printable in Latin-1: by the characters from 256 on, in order.
SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(dict):
    """Ids of texts under a tokenizer that never joins across white space; maps each word met to its ids' bytes.

    A word is what stands between white space. One of letters of Latin-1 alone needs neither normalising (but for
    lower case) nor parting, so it goes straight to the tokenizer's model; so do the letters before a run of
    signs at a word's end, since the tokenizer parts letters from signs. All else is encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.chars = self.tokenizer.model, 0

    def __missing__(self, word: str) -> bytes:
        lower = word.lower()
        letters = lower.rstrip(SIGNS)
        if not letters.isalpha() or not (word.isascii() or latin(word)):
            ids = coded(self.tokenizer.encode(word, add_special_tokens=False).ids)
        elif letters != word:
            ids = self[letters] + (self[lower[len(letters) :]] if len(letters) < len(word) else b"")
        else:
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(SHOWN)
            ids = coded([t.id for t in self.model.tokenize(shown)])
        if len(self) < CACHE_WORDS and self.chars < CACHE_CHARS:
            self[word] = ids
            self.chars += len(word) + len(ids)
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        words = text.split()
        if any(x in text for x in SEPARATORS):
            words = filter(None, BLANKS.split(text))
        return b"".join(map(self.__getitem__, words))


def coded(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.asarray(ids, "<u4").tobytes()


def latin(text: str) -> bool:
    try:
        return text.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


@lru_cache(1)
def encoder(path: str) -> WordEncoder:
    """Of this worker, kept from task to task."""
    return WordEncoder(path)


@dataclass(frozen=True)
class Slot:
    """Pieces of one length whose ranks are first .. first + count * each - 1 go to sequences from sequence on, each of them a sequence, from offset on."""

    length: int
    first: int
    each: int
    count: int
    sequence: int
    offset: int


def by_sum(sums: np.ndarray, *of: np.ndarray) -> dict[int, tuple[np.ndarray, ...]]:
    """Hash table from each sum to the entries of each array that have it, in their order."""
    order = np.argsort(sums, kind="stable")
    keys, at = np.unique(sums[order], return_index=True)
    return dict(zip(keys.tolist(), zip(*(np.split(x[order], at[1:]) for x in of)), strict=True)) if len(keys) else {}


class LengthSums:
    """The pieces left of each length, and hash tables of the sums of pairs and of triples of lengths.

    An entry of pairs is two lengths, the shorter one first. An entry of triples is a third length, the longest
    first, beside a sum of pairs, so that there are at most size ** 2 entries for all triples.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.left = np.zeros(size + 1, np.int64)
        for k, n in counts.items():
            self.left[k] = n
        lengths = np.flatnonzero(self.left)
        a, b = (x.ravel() for x in np.meshgrid(lengths, lengths, indexing="ij"))
        own = (a <= b) & (a + b < size)
        self.pairs = by_sum((a + b)[own], a[own], b[own])
        third, pair = (x.ravel() for x in np.meshgrid(lengths[::-1], np.asarray(sorted(self.pairs), np.int64), indexing="ij"))
        own = third + pair < size
        self.triples = by_sum((third + pair)[own], third[own])

    def pair(self, gap: int) -> tuple[int, int] | None:
        """Of the available pairs with this sum, the one with the longest length."""
        if gap not in self.pairs:
            return None
        a, b = self.pairs[gap]
        have = np.flatnonzero((self.left[a] > (a == b)) & (self.left[b] > 0))
        return (int(b[have[0]]), int(a[have[0]])) if len(have) else None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three available lengths that sum to gap."""
        if gap < 1:
            return None
        if self.left[gap] > 0:
            return (gap,)
        if found := self.pair(gap):
            return found
        (thirds,) = self.triples.get(gap, ((),))
        for third in thirds:
            if self.left[third] > 0:
                self.left[third] -= 1
                found = self.pair(gap - int(third))
                self.left[third] += 1
                if found:
                    return (int(third), *found)
        return None

    def take(self, pattern: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
        """Use the pattern until one of its lengths runs out."""
        need = Counter(pattern)
        times = min(int(self.left[k]) // n for k, n in need.items())
        for k, n in need.items():
            self.left[k] -= n * times
        return pattern, times


def plan(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with the number of sequences of each. counts: pieces of each length from 1 to size.

    First, from the longest length down, multiples of a pattern whose gap is filled exactly by a single, a pair
    or a triple, looked up in the hash tables of sums under what is left; then best fit, the longest length that
    fits. Each pattern is used until one of its lengths runs out, so the patterns number a few a length at most.
    """
    sums, out = LengthSums(counts, size), []
    if sums.left[size]:
        out.append(sums.take((size,)))
    for length in sorted(counts, reverse=True):
        while sums.left[length] > 0:
            sums.left[length] -= 1
            fill = sums.fill(size - length)
            sums.left[length] += 1
            if not fill:
                break
            out.append(sums.take((length, *fill)))
    while len(order := np.flatnonzero(sums.left)):
        pattern, gap = [], size
        for k in order[::-1].tolist():
            n = min(gap // k, int(sums.left[k]))
            pattern += [k] * n
            gap -= n * k
            if gap < order[0]:
                break
        out.append(sums.take(tuple(pattern)))
    return out


def slots(patterns: Iterable[tuple[tuple[int, ...], int]]) -> list[Slot]:
    ranks: Counter = Counter()
    out, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            out.append(Slot(length, ranks[length], each, times, sequence, offset))
            ranks[length] += each * times
            offset += each * length
        sequence += times
    return out


def pieces(docs: DataFrame, size: int, tokenizer: str | None, end_id: int) -> DataFrame:
    """A row for each piece of at most size ids of each document; path of the tokenizer as seen by the executors."""

    def scan(batches):
        encode = encoder(tokenizer or default_tokenizer()).ids
        last = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for doc, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                all_ids = encode(text or "") + last
                for i, at in enumerate(range(0, len(all_ids), 4 * size)):
                    piece = all_ids[at : at + 4 * size]
                    rows.append((doc, i, at // 4, len(piece) // 4, zlib.crc32(piece)))
            yield record(SCHEMA, list(zip(*rows)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, DDL)


def pack(docs: DataFrame, size: int = 2048, tokenizer: str | None = None, end_id: int = 0, share: int = 1_000_000) -> DataFrame:
    """Pieces of docs with sequence_id and offset in sequences of at most size ids.

    The plan is made on the counts of pieces by length, at most size rows whatever the input. A piece's rank
    among those of its length is its rank within one of the shares of that length plus the shares before; there
    are as many shares as it takes for share pieces at most in each, about, so no length is ranked in one task. A null or empty text is the end id alone. Repeated rows are packed each;
    an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, size, tokenizer, end_id), "pieces")
    cut = cut.withColumn("share", spread(["doc_id", "piece", "ids_crc32"], max(256, -(-cut.count() // share))))
    shares = staged(cut.groupBy("length", "share").agg(F.count("*").alias("n")), "shares")
    counts = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = shares.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("share")) - F.col("n"))
    ranked = cut.withColumn("own", F.row_number().over(W.partitionBy("length", "share").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    ranked = ranked.join(before.select("length", "share", "before"), ["length", "share"])
    by_length: dict[int, list[Slot]] = {}
    for slot in slots(plan(counts, size)):
        by_length.setdefault(slot.length, []).append(slot)
    sent = spark.sparkContext.broadcast({k: np.asarray([(s.first, s.each, s.sequence, s.offset) for s in v], np.int64) for k, v in by_length.items()})

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for k in np.unique(length):
                own, of = np.flatnonzero(length == k), sent.value[int(k)]
                at = of[np.searchsorted(of[:, 0], rank[own], "right") - 1]
                past = rank[own] - at[:, 0]
                sequence[own], offset[own] = at[:, 2] + past // at[:, 1], at[:, 3] + past % at[:, 1] * k
            columns = [batch.column(k) for k, _ in SCHEMA]
            yield record((*SCHEMA, ("sequence_id", pa.int64()), ("offset", pa.int64())), [*columns, sequence, offset])

    ranked = ranked.select(*(k for k, _ in SCHEMA), (F.col("own") + F.col("before")).cast("long").alias("rank"))
    return ranked.mapInArrow(place, DDL + ", sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
