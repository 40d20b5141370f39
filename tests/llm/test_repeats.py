"""Removed bytes against a dictionary of all windows."""

import hashlib
import random

import pytest

from quantloom.llm.repeats import Repeats, bucket_repeats, intervals, op4_suffix_array_dedup, remove_repeats, repeats

SCHEMA = "doc_id long, text string, doc string, spans int, source string"


def brute(rows, span=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for s in range(len(t) - span + 1):
            w = t[s : s + span]
            if w in seen:
                gone[s : s + span] = b"\1" * span
            seen.add(w)
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[doc] = (len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(spark, rows, **rules):
    docs = spark.createDataFrame([(d, t, "x", 1, None) for d, t in rows], SCHEMA)
    out = remove_repeats(docs, Repeats(**rules)).collect()
    return {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in out}


def corpus(seed):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [noise(n) for n in (90, 99, 100, 101, 140, 170, 400, 900)]
    texts = []
    for _ in range(60):
        parts = [noise(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts += [rng.choice([p, p, p[cut:], p[:cut]]), noise(rng.choice([0, 1, 7, 60]))]
        texts.append("".join(parts))
    texts += ["", None, "x" * 99, "x" * 100, "x" * 450, "ab" * 300, ("xyz" * 60 + noise(40)) * 4, texts[3], texts[5], texts[5]]
    rng.shuffle(texts)
    return [(7 * i - 30, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rules", [{}, {"bucket": 3}, {"piece": 150}])
def test_against_all_windows(spark, rules):
    rows = corpus(5)
    assert result(spark, rows, **rules) == brute(rows)


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in op4_suffix_array_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(rows)


def test_empty_null_and_repeated(spark):
    assert result(spark, []) == {}
    long = "q" + "".join(chr(97 + i * i % 23) for i in range(300))
    once = brute([(4, long)])[4]
    assert once[1] == 277 and result(spark, [(4, long), (4, long)]) == {4: once}
    assert result(spark, [(None, long), (4, long)])[None] == (301, 0, 0, hashlib.sha256(long.encode()).hexdigest())


def test_intervals_of_a_sorted_list():
    assert sorted(intervals([2, 1, 3])) == [(1, -1, 0, 3), (2, 1, 0, 1), (3, 1, 2, 3)]
    assert list(intervals([])) == []


def test_occurrences_are_whole():
    rules = Repeats(span=6, gram=2)
    rows = sorted([(b"abcd", b"xyz", 1, 5, 1), (b"abcd", b"xyw", 2, 9, 1), (b"abce", b"xyz", 3, 7, 1)])
    found = {(near, far): [m[:2] for m in occ] for near, far, occ in bucket_repeats(rows, rules)}
    assert found == {(0, 0): [(1, 5), (2, 9)], (1, 2): [(1, 5), (2, 9), (3, 7)], (3, 3): [(1, 5), (3, 7)]}
    found = {(near, far): [m[:2] for m in occ] for near, far, occ in bucket_repeats(rows, rules, 1, 1)}
    assert found == {(1, 1): [(1, 5), (2, 9), (3, 7)]}
    copied = [(b"abcd", b"xyz", 1, 5, 2)]
    assert [(near, far, len(occ)) for near, far, occ in bucket_repeats(copied, rules)] == [(0, 3, 1)]


@pytest.mark.parametrize("rules", [{}, {"bucket": 2}])
def test_groups_hold_all_occurrences(spark, rules):
    """Each window that occurs twice or more is in groups that name all its places, with one first place."""
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    passage = noise(260)
    docs = [(i, noise(40) + passage[rng.randrange(120) : rng.randrange(200, 260)] + noise(30)) for i in range(9)] + [(20, "x" * 200), (21, passage), (22, passage)]
    frame = spark.createDataFrame(docs, "doc long, text string")
    places = {}
    for doc, text in docs:
        for s in range(len(text) - 99):
            places.setdefault(text[s : s + 100], set()).add((doc, s))
    texts, groups = dict(docs), {}
    for r in repeats(frame, Repeats(**rules)).collect():
        groups.setdefault((r["anchor"], r["group"], r["end"] - r["start"]), []).append((r["doc"], r["start"], r["first"]))
    covered = set()
    for (_, _, size), found in groups.items():
        strings = {texts[d][s : s + size] for d, s, _ in found}
        assert len(strings) == 1 and len(found) > 1 and [f for *_, f in sorted(found)] == [True] + [False] * (len(found) - 1)
        string = strings.pop()
        for k in range(size - 99):
            assert places[string[k : k + 100]] == {(d, s + k) for d, s, _ in found}
            covered.add(string[k : k + 100])
    assert covered == {w for w, where in places.items() if len(where) > 1}


def test_texts_that_share_an_id(spark):
    long = "".join(chr(97 + i * i * 7 % 26) for i in range(300))
    rows = [(0, long), (1, long), (1, "a short text here"), (1, "a short text here"), (2, long[100:])]
    docs = spark.createDataFrame([(d, t) for d, t in rows], "doc_id long, text string")
    out = sorted((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"])) for r in remove_repeats(docs).collect())
    own = brute([(0, long)])[0][1]
    assert out == [(0, 300, own), (1, 17, 0), (1, 17, 0), (1, 300, 300), (2, 200, 200)]
