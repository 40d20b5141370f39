"""Operator 6: Wu-Manber search of benchmark windows in documents, on words as symbols."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import read, record, utf8

#: Bytes of words are 0-9, a-z (A-Z in lower case) and all of 0x80 and above; the others part words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = (("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
DDL = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start: long, end: long>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class WuManber:
    """Patterns of one length in words. Blocks of two words (of one, for one-word patterns) index the tables."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.suffix: dict = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.suffix[pattern[-self.block :]].append((pattern, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Start and items of each occurrence."""
        length, block, default, shift, n = self.length, self.block, self.default, self.shift.get, len(words)
        at = length
        while at <= n:
            key = (words[at - 2], words[at - 1]) if block == 2 else (words[at - 1],)
            step = shift(key, default)
            if step:
                at += step
                continue
            window = tuple(words[at - length : at])
            for pattern, items in self.suffix[key]:
                if pattern == window:
                    yield at - length, items
            at += 1


def windows(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def tables(items: list[tuple[int, bytes]], size: int) -> list[WuManber]:
    """A search table for each pattern length: size, and those of shorter items."""
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        for window in windows(words_of(text), size):
            by_length[len(window)][window].append(item)
    return [WuManber(k, v) for k, v in sorted(by_length.items())]


def blocks(benchmark: DataFrame, block_bytes: int, unnamed: bool = False) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's items in lists of at most block_bytes of text (or one item)."""
    held, size = [], 0
    rows = benchmark.filter(F.col("text").isNotNull() & (F.col("item_id").isNotNull() | F.lit(unnamed))).select(F.col("item_id").cast("long"), F.col("text").cast("binary"))
    for item, text in rows.toLocalIterator():
        if held and size + len(text) > block_bytes:
            yield held
            held, size = [], 0
        held.append((item, bytes(text)))
        size += len(text)
    if held:
        yield held


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """The batches in lists of at least size bytes of text, but for the last."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.column("text").nbytes
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def runs_of(hits: list[tuple[int, int, list]]) -> list[list[int]]:
    """The hit words as runs (start, end)."""
    runs: list[list[int]] = []
    for start, end in sorted((s, e) for s, e, _ in hits):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return runs


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = 2_000_000, unnamed: bool = False, carry: Sequence[str] = (), chunk_bytes: int = 64_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids whose windows occur, ascending) and spans (hit word runs) for each row of docs.

    The benchmark is the stated query set: it is sent to the executors in blocks of at most block_bytes, each a
    broadcast of bounded size, and every document is searched for every block. A task holds one block's tables at
    a time; those of a single block are made once, those of several once for each chunk_bytes of texts. No shuffle.
    Null or empty texts, and texts without words, have no words and no hits; so have all documents if the
    benchmark is empty or null. Repeated items or windows count each item once; repeated documents give one row
    each. Other columns are ignored. unnamed: items with a null item_id are searched too, and those that occur are
    one null at the end of items; without it they are left out. With carry, carried is a struct of these columns.
    """
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(b) for b in blocks(benchmark, block_bytes, unnamed)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = tables(sent[0].value, window) if len(sent) == 1 else None
        for held in chunks(batches, chunk_bytes if len(sent) > 1 else 0):
            texts = [t for batch in held for t in utf8(batch)]
            found: list[list] = [[] for _ in texts]
            for part in sent:
                own = only or tables(part.value, window)
                for k, words in enumerate(map(words_of, texts)):
                    for table in own:
                        found[k].extend((start, start + table.length, items) for start, items in table.search(words))
            at = 0
            for batch in held:
                here, at = range(at, at + batch.num_rows), at + batch.num_rows
                runs = [runs_of(found[k]) for k in here]
                items = [sorted({i for h in found[k] for i in h[2]}, key=lambda i: (i is None, i or 0)) for k in here]
                spans = [[{"start": s, "end": e} for s, e in r] for r in runs]
                out = record(SCHEMA, [batch.column("doc_id"), [len(words_of(texts[k])) for k in here], [sum(e - s for s, e in r) for r in runs], items, spans])
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column("carried")], names=[*out.schema.names, "carried"])

    carried = F.struct(*carry) if carry else F.lit(None).cast("boolean")
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", carried.alias("carried"))
    out = bare.mapInArrow(scan, f"{DDL}, carried {bare.schema['carried'].dataType.simpleString()}")
    return out if carry else out.drop("carried")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), unnamed=True)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
