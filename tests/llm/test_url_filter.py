"""URL verdicts against models counted in plain Python, and on hosts that were never seen."""

import random
import re
from collections import Counter, defaultdict
from hashlib import md5
from math import log

import pytest

from quantloom.llm.url_filter import SYMBOLS, Rule, UrlModels, url_filter

SCHEMA = "page_id long, url string, html string, host string, score int, label string"


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = [(h + p, v) for v, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


class Markov:
    def __init__(self, texts, order):
        self.order = order
        self.next = defaultdict(Counter)
        for text in texts:
            padded = "\x02" * order + text + "\x03"
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    self.next[padded[i - k : i]][padded[i]] += 1

    def p(self, context, symbol):
        p = 1 / SYMBOLS
        for k in range(self.order + 1):
            seen = self.next.get(context[self.order - k :])
            if seen:
                p = (seen[symbol] + len(seen) * p) / (seen.total() + len(seen))
        return p

    def score(self, other, text):
        padded = "\x02" * self.order + text + "\x03"
        steps = [(padded[i - self.order : i], padded[i]) for i in range(self.order, len(padded))]
        return sum(log(self.p(c, s)) - log(other.p(c, s)) for c, s in steps) / len(steps)


def brute(rows, order=5, labels=None):
    info = [(page, url or "", *parts(url)) for page, url in rows]
    names = [rule_of(h, p) for _, _, h, p in info]
    label = labels or [v for _, v in names]
    half = [ord(md5(h.encode()).hexdigest()[0]) % 2 for _, _, h, _ in info]
    pick = lambda kind, k: Markov([u for (_, u, _, _), v, x in zip(info, label, half) if v == kind and k in (None, x)], order)
    both = {k: (pick("allow", k), pick("block", k)) for k in (None, 0, 1)}
    scores = [both[None][0].score(both[None][1], u) for _, u, _, _ in info]
    held = defaultdict(list)
    for (_, u, _, _), v, x in zip(info, label, half):
        if v:
            a, r = both[1 - x]
            held[v].append(a.score(r, u))
    slope = middle = 0.0
    if len(held) == 2:
        mean = {k: sum(v) / len(v) for k, v in held.items()}
        variance = sum((s - mean[k]) ** 2 for k, v in held.items() for s in v) / sum(map(len, held.values()))
        slope, middle = max(mean["allow"] - mean["block"], 0) / max(variance, 1e-9), (mean["allow"] + mean["block"]) / 2
    out = []
    for (page, _, h, p), (name, v), s in zip(info, names, scores):
        out.append((page, h, p, name, v or ("allow" if slope * (s - middle) >= 0 else "block"), round(s, 9)))
    return sorted(out, key=str)


def result(spark, rows, labels=None, **config):
    data = [(d, u, "<p>", "clash", 3, (labels or [None] * len(rows))[k]) for k, (d, u) in enumerate(rows)]
    out = url_filter(spark.createDataFrame(data, SCHEMA), config=UrlModels(**config), label="label" if labels else None).collect()
    return sorted(((r["page_id"], r["_host"], r["path"], r["rule"], r["verdict"], round(r["_score"], 9)) for r in out), key=str), out


def test_models_and_calibration(spark):
    rng = random.Random(2)
    tops = ["example.net", "example.com", "example.org", "other.net", "b.org", "Example.NET"]
    rows = [(k, f"http{rng.choice(['', 's'])}://{rng.choice(['a', 'blog', 'casino', 'm'])}{rng.randrange(9)}.{rng.choice(tops)}/{rng.choice(['en', 'de', 'fr'])}/{rng.choice(['x', 'é', 'page'])}{rng.randrange(50)}{rng.choice(['', '?q=1', '#t'])}") for k in range(150)]
    rows += rows[:7] + [(900, None), (901, ""), (902, "no scheme/en/"), (None, "https://x.example.com")]
    want = brute(rows)
    got, out = result(spark, rows)
    assert got == want
    assert {"allow", "block"} == {r["verdict"] for r in out if r["rule"] is None}
    assert result(spark, rows, order=2)[0] == brute(rows, 2)


@pytest.mark.parametrize(
    "url, host, path, rule",
    [
        ("https://A.Net/x?y#z", "a.net", "/x", "net/"),
        ("https://a.net", "a.net", "", None),
        ("https://a.net?u=/", "a.net", "", None),
        ("https://example.net/en/1", "example.net", "/en/1", "example.net/en/"),
        ("https://myexample.net/en/1", "myexample.net", "/en/1", "net/"),
        ("x://w.example.com/de/", "w.example.com", "/de/", "example.com/de/"),
        ("x://w.example.com/de", "w.example.com", "/de", None),
        ("org://org/fr/", "org", "/fr/", "org/fr/"),
        ("a://b://c.net/d", "b:", "//c.net/d", None),
        ("://net/", "net", "/", "net/"),
        ("a\nb://NET/\n?", "net", "/\n", "net/"),
        ("ÄÖ://É.NET/É", "É.net", "/É", "net/"),
    ],
)
def test_hosts_and_rules(spark, url, host, path, rule):
    row = result(spark, [(1, url)])[1][0]
    assert (row["_host"], row["path"], row["rule"]) == (host, path, rule)
    assert row["verdict"] == (dict(brute_rules()).get(rule) or "allow")


def brute_rules():
    return [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_hosts_never_seen(spark):
    """Given labels of some hosts, the words in them tell hosts of the same kinds that have none."""
    rng = random.Random(5)
    good, bad = ["news", "library", "garden", "science", "museum"], ["casino", "pills", "bets", "spam", "adult"]
    urls, labels, truth = [], [], []
    for k in range(400):
        kind = rng.randrange(2)
        words = bad if kind else good
        urls.append((k, f"https://{rng.choice(words)}-{rng.choice(words)}{k}.example.com/{rng.choice('abc')}/{k}"))
        labels.append(None if k % 2 else ("block" if kind else "allow"))
        truth.append("block" if kind else "allow")
    out = result(spark, urls, labels)[1]
    told = [r["verdict"] == truth[r["page_id"]] for r in out if r["page_id"] % 2]
    assert sum(told) / len(told) > 0.95


def test_longest_rule_wins_then_the_first(spark):
    rules = (Rule("block", "b.c", "/x"), Rule("allow", "c", "/xyz"), Rule("allow", "a.b.c", "/"))
    out = url_filter(spark.createDataFrame([("s://a.b.c/xyz",), ("s://b.c/xyz",)], "url string"), rules).collect()
    assert sorted((r["host"], r["rule"], r["verdict"]) for r in out) == [("a.b.c", "a.b.c/", "allow"), ("b.c", "b.c/x", "block")]


def test_edge_cases(spark):
    assert result(spark, [])[0] == []
    only = result(spark, [(1, None), (2, "https://a.com/x")])[1]
    assert [(r["verdict"], r["probability"]) for r in only] == [("allow", 0.5)] * 2
    long = [(1, "https://a.net/" + "ab" * 200_000), (2, "https://a.org/fr/x"), (3, "https://a.com/")]
    assert {r["page_id"]: r["rule"] for r in result(spark, long)[1]} == {1: "net/", 2: "org/fr/", 3: None}
