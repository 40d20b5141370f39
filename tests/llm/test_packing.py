"""Pieces against the tokenizer on whole texts; places against their definition."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quantloom.llm.packing import WordEncoder, default_tokenizer, pack, plan

TOKENIZER = Tokenizer.from_file(default_tokenizer())
ENCODER = WordEncoder(default_tokenizer())
ODD = ["á. b", "Don't stop, it's  \x1c x y<|endoftext|>z , a,b. 1,2.", "", " ", "İx. ΑΣ. ΑΣ,", "é,", "가.각, ", "word.\x85x,　y", "Áb. é, x́", " .a ,b ...  x.. y.", "<|ENDOFTEXT|> <|endoftext|>", "ªº, ß. ĳ Ĳ.", "a\x1fb c", "w" * 3000, "(a) [b]; c! d?! 'e' f'll"]


def whole(text):
    return np.asarray(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_encode_as_texts():
    for text in ODD:
        assert ENCODER.ids(text) == whole(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab Zé.,'!\n\t0９ñ́ßıİ<|>sS"), max_size=40))
def test_any_text(text):
    assert ENCODER.ids(text) == whole(text)


def check(rows, texts, size):
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        ids = whole(text or "") + b"\0\0\0\0"
        own = sorted(got[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids) // 4
        for r in own:
            part = ids[4 * r["start"] : 4 * (r["start"] + r["length"])]
            assert r["start"] == r["piece"] * size and r["length"] <= size and zlib.crc32(part) == r["ids_crc32"]
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by), -(-sum(r["length"] for r in rows) // size)


def best_fit(counts, size):
    """Sequences of best fit decreasing, a piece at a time."""
    gaps = []
    for k in sorted(counts.elements(), reverse=True):
        fit = min((g for g in gaps if g >= k), default=None)
        if fit is None:
            gaps.append(size - k)
        else:
            gaps.remove(fit)
            gaps.append(fit - k)
    return len(gaps)


def test_packed_documents(spark):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice(["alpha", "Beta,", "x.", "ñu", "12"]) for _ in range(rng.choice([0, 1, 3, 20, 60, 200]))) for i in range(300)}
    texts |= dict(enumerate([None, *ODD], 1000))
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in texts.items()], "doc_id long, text string, length int, share string")
    rows = pack(docs, size=64, share=5).collect()
    n, least = check(rows, texts, 64)
    assert least <= n <= best_fit(Counter(r["length"] for r in rows), 64)


def test_empty_and_repeated(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, text string"), size=4).collect()
    assert sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows) == [(0, 0, 2), (0, 2, 2), (1, 0, 2)]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=15))
def test_plan_uses_each_piece_once(counts):
    used = Counter()
    for pattern, times in plan(counts, 40):
        assert times > 0 and sum(pattern) <= 40
        for k in pattern:
            used[k] += times
    assert used == Counter(counts)


def test_exact_complements():
    assert sorted(plan({30: 2, 10: 2, 25: 1, 8: 1, 7: 1, 20: 1, 9: 1, 6: 1, 5: 1}, 40)) == [((20, 8, 7, 5), 1), ((25, 9, 6), 1), ((30, 10), 2)]


def test_a_worker_keeps_few_words():
    """What a worker keeps between tasks stays under 50 MB, whatever the number of different words."""
    import sys

    from quantloom.llm import packing

    words = packing.WordEncoder(packing.default_tokenizer())
    text = " ".join(f"w{i:x}" for i in range(450_000))
    ids = words.ids(text)
    assert sys.getsizeof(words) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in words.items()) < 50_000_000
    assert words.ids(text) == ids
