"""Operator 13: spelling variants by a pigeonhole join on even partitions, within one edit.

A word is parted into two segments by its length. One edit leaves one of them whole, so an indexed word and its
variant agree in the first segment at the start or in the second at the end, shifted by one place if the variant
is one longer. Each word is indexed under both segments, and probes those of words as long or one shorter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import counted_join, dropped, read, record, staged, utf8

RUN = re.compile("[a-zÀ-ÿ]+")
SCHEMA = (("word", pa.string()), ("n", pa.int64()))


@dataclass(frozen=True)
class Spelling:
    """least_chars, least_count: of a word. ratio: a form has at least so many times the word's occurrences.

    every: a run loses one letter where its hash with the doc_id is divisible by it; 0: no run does.
    crowd: words under one segment from which on the rest of the words is parted again.
    """

    least_chars: int = 6
    least_count: int = 5
    ratio: int = 5
    every: int = 199
    crowd: int = 256


def altered(doc: str, run: str, every: int) -> str:
    """The run, without one letter where the hash of doc and run says so."""
    h = crc32(f"{doc}:{run}".encode())
    if every and h % every == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def word_counts(docs: DataFrame, rules: Spelling) -> DataFrame:
    """word and n of all whole texts; counts are summed in each batch before they are shuffled."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for doc, text in zip(batch.column("doc").to_pylist(), utf8(batch), strict=True):
                for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                    if len(word := altered(doc, run, rules.every)) >= rules.least_chars:
                        total[word] += n
            yield record(SCHEMA, [list(total), list(total.values())])

    bare = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), "text")
    found = bare.mapInArrow(scan, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rules.least_count)


def under(word: Column, longer: Column, size: Column, a: Column, b: Column) -> Column:
    """The hash of what a word has outside the open part [a, b) of words of size; longer: 1 if it has one letter more."""
    return F.xxhash64(size, a, b, F.substring(word, F.lit(1), a), F.substring(word, b + longer + 1, size - b))


def segments(words: DataFrame, rules: Spelling) -> DataFrame:
    """A row for each segment that a word is indexed under (longer 0) or probes of words one shorter (longer 1)."""
    both = words.withColumn("longer", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("size", F.length("word") - F.col("longer"))
    both = both.filter(F.col("size") >= rules.least_chars).withColumns({"a": F.lit(0), "b": F.col("size")})
    return parted(both)


def parted(rows: DataFrame) -> DataFrame:
    """Two rows for each: its open part is halved, and the edit is in one half or in the other."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    halves = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
    out = rows.withColumn("half", F.explode(halves)).withColumns({"a": F.col("half.a"), "b": F.col("half.b")})
    out = out.withColumn("key", under(F.col("word"), F.col("longer"), F.col("size"), F.col("a"), F.col("b")))
    return out.select("key", "word", "n", "longer", "size", "a", "b")


def near_pairs(words: DataFrame, rules: Spelling) -> DataFrame:
    """Distinct pairs x, y (with n_x, n_y) of words that differ by exactly one edit.

    Words that share a segment are candidates. Where more than crowd do, their rest is parted again by the same
    argument, until one letter is open: then all that are left differ in that place alone. So no bucket makes
    more pairs than crowd or the alphabet allow, and none is lost.
    """
    rows, pairs = staged(segments(words, rules), "segments"), []
    while True:
        counts = rows.groupBy("key").agg(F.count("*").alias("members"), F.sum(1 - F.col("longer")).alias("indexed"))
        counts = staged(counts.filter("indexed > 0 AND members > 1").select("key", "members"), "counts")
        met = staged(counted_join(rows, counts, ["key"], rows.count(), n="members"), "met")
        dropped(rows)
        crowded = (F.col("members") > rules.crowd) & (F.col("b") - F.col("a") > 1)
        few = met.filter(~crowded)
        index = few.filter("longer = 0").select("key", F.col("word").alias("x"), F.col("n").alias("n_x"))
        probe = few.select("key", F.col("word").alias("y"), F.col("n").alias("n_y"), "longer")
        once = (F.col("longer") == 1) | (F.col("x") < F.col("y"))
        close = F.levenshtein("x", "y", 1) == 1
        pairs.append(index.join(probe, "key").filter(once & close).select("x", "n_x", "y", "n_y"))
        if met.filter(crowded).isEmpty():
            break
        rows = staged(parted(met.filter(crowded)), "segments")
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return staged(out.dropDuplicates(["x", "y"]), "near")


def roots(forms: DataFrame) -> DataFrame:
    """word and root for each word with a form: the form's form's form and so on, the steps doubled in each round.

    A form has ratio times the occurrences of its word, so chains are as long as the logarithm of the largest count.
    """
    held = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(held.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(held)
        held = after
        if held.filter("moved").isEmpty():
            return held.select("word", "root")


def spelling_variants(docs: DataFrame, rules: Spelling = Spelling()) -> DataFrame:
    """word, form, root, n, n_near and form_n for each frequent word of the whole texts of docs.

    form: the near word (one edit) with most occurrences, if these are ratio times the word's; of several the
    first in code-point order. root: where forms lead to at last. Null or empty texts, and an empty table, have no
    words. A null doc_id counts as empty. Repeated rows count as often as they are there. A word as long as a text
    is one word. Other columns are ignored.
    """
    words = staged(word_counts(docs, rules), "words")
    near = near_pairs(words, rules)
    sides = near.select(F.col("x").alias("word"), F.col("y").alias("other"), F.col("n_y").alias("m"))
    sides = sides.unionByName(near.select(F.col("y").alias("word"), F.col("x").alias("other"), F.col("n_x").alias("m")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    is_form = -F.col("best.less") >= rules.ratio * F.col("n")
    judged = words.join(best, "word", "left").select(
        "word",
        F.when(is_form, F.col("best.other")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, -F.col("best.less")).alias("form_n"),
    )
    judged = staged(judged, "judged")
    ends = roots(judged.filter("form IS NOT NULL"))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


#: crc32 of a list of bytes, bit by bit; 3988292384 is the polynomial.
CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
_BYTES = "flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c)::BIGINT - 64] END))"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP13_SQL = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY 1, 2),
h AS (SELECT run, c, {CRC32.format(bytes=_BYTES)} AS h FROM runs),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM h GROUP BY 1 HAVING sum(c) >= 5 AND length(word) >= 6),
d AS (SELECT word, n, length(word) AS size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM w, unnest(range(1, length(word) + 1)) t(i)),
near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.size = b.size AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY 1),
f AS (SELECT word, CASE WHEN m >= 5 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS last FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.last WHERE f.form IS NOT NULL)
SELECT f.word, f.form, chain.last AS root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word JOIN f e ON e.word = chain.last WHERE e.form IS NULL
"""
