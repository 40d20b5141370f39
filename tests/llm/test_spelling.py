"""Spelling variants against all pairs of words."""

import random
import re
from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F

from quantloom.llm.spelling import Spelling, spelling_variants

SCHEMA = "doc_id long, text string, lang string, word string, n long, form int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "clash", 1, 2) for d, t in rows], SCHEMA)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least_count=5, every=199):
    counts = Counter()
    for doc, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= least_count}
    out, form = {}, {}
    for w, n in words.items():
        near = [(-words[o], o) for o in words if o != w and one_edit(w, o)]
        m, best = min(near, default=(0, None))
        form[w] = best if near and -m >= 5 * n else None
        out[w] = [form[w], None, n, len(near), -m if form[w] else None]
    for w in words:
        end = w
        while form[end]:
            end = form[end]
        out[w][1] = end
    return {w: tuple(v) for w, v in out.items()}


def result(spark, rows, **rules):
    out = spelling_variants(frame(spark, rows), Spelling(**rules)).collect()
    assert len({r["word"] for r in out}) == len(out)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out}


def variants(seed=3):
    rng = random.Random(seed)
    letters = "abcdeé÷×ÿà"
    bases = ["".join(rng.choice(letters) for _ in range(rng.choice([6, 7, 9, 14]))) for _ in range(40)]
    bases += ["prefix" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(50)]
    bag = []
    for base in bases:
        bag += [base] * rng.choice([3, 5, 40, 300])
        for _ in range(4):
            i = rng.randrange(len(base))
            kind = rng.randrange(3)
            other = base[:i] + (rng.choice(letters) if kind else "") + base[i + (kind != 2) :]
            bag += [other] * rng.choice([4, 5, 8, 50])
    rng.shuffle(bag)
    return [(k, " ".join(bag[k::60])) for k in range(60)]


def test_all_pairs(spark):
    rows = variants()
    want = brute(rows)
    assert result(spark, rows) == want
    assert sum(v[0] is not None for v in want.values()) > 20
    assert any(v[0] and v[1] != v[0] for v in want.values())


def test_crowded_segments_lose_nothing(spark):
    """With room for two words under a segment, all are parted down to single letters."""
    rows = variants(4)
    assert result(spark, rows, crowd=2) == brute(rows)


def test_edits_at_both_ends(spark):
    rows = [(1, "abcdefg " * 50 + "xabcdefg abcdefgx bcdefg abcdef Abcdefx xbcdefg abcdegf " * 6)]
    want = brute(rows, every=10**12)
    assert result(spark, rows, every=0) == want
    assert [want[w][0] for w in ("xabcdefg", "abcdefgx", "bcdefg", "abcdef", "abcdefx", "xbcdefg")] == ["abcdefg"] * 6
    assert want["abcdegf"][0] is None


def test_chains_lead_to_the_last_form(spark):
    rows = [(1, "colour " * 5 + "colours " * 25 + "coloures " * 125 + "xcoloures " * 625)]
    got = result(spark, rows, every=0)
    assert got["colour"][:2] == ("colours", "xcoloures") and got["xcoloures"][:2] == (None, "xcoloures")


def test_ties_go_to_the_first_in_code_points(spark):
    rows = [(1, "abcdez " * 30 + "abcdeÿ " * 30 + "abcdea " * 30 + "abcdef " * 5)]
    assert result(spark, rows, every=0)["abcdef"] == ("abcdea", "abcdea", 5, 3, 30)


def test_edge_cases(spark):
    assert result(spark, []) == {}
    assert result(spark, [(1, None), (2, ""), (None, None), (3, "12 ,,. 中")]) == {}
    rows = [(None, "letters " * 5), (7, "letters LETTERS")] + [(8, "repeats")] * 5 + [(9, " ".join(["z" * 200_000] * 5))]
    assert result(spark, rows) == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling_variants(docs.withColumn("key", F.lit(1))).collect()}
    assert got == brute(rows)
