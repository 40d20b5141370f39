"""Operator 7: secret scan by patterns and by sliding-window entropy per character class, all in SQL expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import read

#: Fixed patterns of the base kinds, in their order. hex and access need no more than their least lengths, since
#: a shorter run can't hold a longer match; assign must consume short values, so its length is tested after.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
LEAST_VALUE = 12


@dataclass(frozen=True)
class EntropyClass:
    """Runs of the class, of window characters at least, are candidates; hot windows have least bits a character."""

    name: str
    pattern: str
    window: int
    least: float


@dataclass(frozen=True)
class SecretRules:
    """classes: tried on each candidate in order. allowed: candidates that match one of these whole are no secrets.

    A candidate can be as long as a text, so what repeats a group must be possessive (++), which needs no stack.
    """

    classes: tuple[EntropyClass, ...] = (
        EntropyClass("entropy_hex", "[0-9a-fA-F]", 20, 2.95),
        EntropyClass("entropy_key", "[A-Za-z0-9+/=_-]", 20, 3.7),
    )
    allowed: tuple[str, ...] = (
        "[A-Z]?[a-z]+",
        "[A-Z]+",
        "[0-9]+",
        "[-=_+/]+",
        "[A-Za-z]++(?:[-_/][A-Za-z]++)++",
        "[A-Z0-9]*EXAMPLE[A-Z0-9]*",
        "(?:0123456789|abcdef|ABCDEF)++[0-9a-zA-Z]{0,10}",
    )


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def placed(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches; code points, end exclusive.

    The parts between the matches give their places: a match starts after as many parts and one match less. The
    lengths are summed over runs of about the root of the number of matches, so that no list grows by copies.
    """
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.split(text, pattern, -1).alias("part"))
    sized = F.transform(F.filter(pairs, lambda p: p["value"].isNotNull()), lambda p: F.struct(p["value"].alias("value"), F.length(p["part"]).alias("skip"), F.length(p["value"]).alias("size")))

    def one(state: Column, m: Column) -> Column:
        start = state["at"] + m["skip"]
        span = F.struct(start.alias("start"), (start + m["size"]).alias("end"), m["value"].alias("value"))
        return F.struct((start + m["size"]).alias("at"), F.array_append(state["found"], span).alias("found"))

    def within(run: Column) -> Column:
        found = F.array().cast("array<struct<start:int,end:int,value:string>>")
        return F.aggregate(run["matches"], F.struct(run["at"].alias("at"), found.alias("found")), one, lambda s: s["found"])

    def ahead(state: Column, run: Column) -> Column:
        at = state["at"] + F.aggregate(run, F.lit(0), lambda n, m: n + m["skip"] + m["size"])
        return F.struct(at.alias("at"), F.array_append(state["runs"], F.struct(state["at"].alias("at"), run.alias("matches"))).alias("runs"))

    def whole(matches: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(matches))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / size).cast("int")), lambda k: F.slice(matches, k * size + 1, size))
        none = F.array().cast("array<struct<at:int,matches:array<struct<value:string,skip:int,size:int>>>>")
        starts = F.aggregate(runs, F.struct(F.lit(0).alias("at"), none.alias("runs")), ahead, lambda s: s["runs"])
        return F.flatten(F.transform(starts, within))

    return F.when(text.rlike(pattern), bound(sized, whole))


def hot_span(run: Column, window: int, least: float) -> Column:
    """struct<first, last>: the first and last ends of windows of the run with least bits a character, or 0 and 0.

    A window's counts follow from those of the one before: one character leaves and one enters, and of the counts,
    held as the signs of a string by character, these two are replaced. With c of each character in n, the entropy
    is log2(n) - sum(c * log2(c)) / n; the sum is carried along. Runs are of ASCII.
    """
    zero, n_codes = ord("0"), 128
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)))
    term, code = (lambda c: F.get(terms, c)), F.ascii
    count = lambda held, c: F.ascii(F.substring(held, c + 1, F.lit(1))) - zero
    put = lambda held, c, n: F.overlay(held, F.chr(n + zero), c + 1, F.lit(1))
    start = F.struct(F.lit("0" * n_codes).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def over(letters: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            enters, full = code(F.get(letters, i)), i >= window
            leaves = code(F.get(letters, i - window))
            out = count(a["n"], leaves)
            s = a["s"] - F.when(full, term(out) - term(out - 1)).otherwise(F.lit(0.0))
            held = count(a["n"], enters) - F.when(full & (leaves == enters), 1).otherwise(0)
            s = s + term(held + 1) - term(held)
            n = put(F.when(full, put(a["n"], leaves, out - 1)).otherwise(a["n"]), enters, held + 1)
            hot = (i >= window - 1) & (F.lit(math.log2(window)) - s / window >= least)
            first = F.when(hot & (a["first"] == 0), i + 1).otherwise(a["first"])
            return F.struct(n.alias("n"), s.alias("s"), first.alias("first"), F.when(hot, i + 1).otherwise(a["last"]).alias("last"))

        return F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return bound(F.split(run, ""), over)


def entropy_spans(text: Column, kind: EntropyClass, allowed: tuple[str, ...]) -> Column:
    """array<struct<start, end>> from the first hot window's start to the last one's end in each candidate."""
    runs = placed(text, f"{kind.pattern}{{{kind.window},}}")
    suspect = F.filter(runs, lambda r: ~r["value"].rlike("^(" + "|".join(f"({p})" for p in allowed) + ")$"))
    scored = F.transform(suspect, lambda r: F.struct(r["start"].alias("start"), hot_span(r["value"], kind.window, kind.least).alias("hot")))
    hot = F.filter(scored, lambda r: r["hot"]["last"] > 0)
    return F.transform(hot, lambda r: F.struct((r["start"] + r["hot"]["first"] - kind.window).alias("start"), (r["start"] + r["hot"]["last"]).alias("end")))


def scan_secrets(docs: DataFrame, rules: SecretRules = SecretRules()) -> DataFrame:
    """doc_id and, for each row of docs, arrays of spans: assign, access, hex and one for each entropy class.

    Native expressions only, row by row, without a shuffle. Null text: empty, no spans. Repeated rows: one
    result each. Empty table: no rows. Other columns are ignored. Allow-lists bear on entropy spans alone.
    """
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int>>")
    bare = lambda spans: F.coalesce(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), none)
    held = F.filter(placed(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST_VALUE)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        bare(held).alias("assign"),
        bare(placed(text, ACCESS)).alias("access"),
        bare(placed(text, HEX)).alias("hex"),
        *(F.coalesce(entropy_spans(text, k, rules.allowed), none).alias(k.name) for k in rules.classes),
    )


def written(kinds: list[str]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""

    def tagged(nth: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    spans = F.array_sort(F.concat(*(tagged(i, k) for i, k in enumerate(kinds))))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = SecretRules()
    base = ["assign", "access", "hex"]
    out = scan_secrets(read(spark, sf_dir, "documents"), rules)
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(base + [k.name for k in rules.classes]).alias("spans"),
    )
