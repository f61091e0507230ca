"""URL filters, periodic runs and hard negatives against brute force."""

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from helixloom.llm import hard_negatives, periodic_runs, url_filters
from helixloom.llm.queries import SITES, planted
from pyspark.sql import functions as F

URLS = [
    (1, None), (2, ""), (3, "no scheme/en/"), (4, "http://WWW.Example.com/en/x?q=/en/"), (5, "https://example.com/en/"), (6, "https://example.com/english/"), (7, "https://notexample.com/en/a"),
    (8, "https://a.b.net/es/1"), (9, "https://net/fr/"), (10, "https://x.org/"), (11, "https://cheap-pills.example.org/en/1"), (12, "https://pillsbury.example.org/"), (13, "ftp://com#/"), (14, "https://com/"),
    (15, "://x.com/"), (16, "https://a.com?u=http://b.net/es/"), (17, "https://x.org/CASINO/"), (None, "https://x.org/a\nb/ads"), (4, "http://WWW.Example.com/en/x?q=/en/"), (18, "https://x.org/" + "a/" * 200_000 + "bets"),
]


def plain_verdict(url):
    """Every rule tried on every URL, in the words of the contract."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, a) for h, p, a in SITES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, max(fit)[1], "allow" if max(fit)[2] else "block"
    words = set(re.findall("[a-z0-9]+", (host + path).lower()))
    return host, path, None, "block" if words & set(url_filters.UNWANTED) else "allow"


def test_urls(spark):
    frame = spark.createDataFrame(URLS, "page_id bigint, url string").selectExpr("*", "'x' as host", "1 as rule", "2 as `by`")
    rules = [url_filters.site_rule(*x) for x in SITES] + url_filters.unwanted()
    got = sorted(map(tuple, url_filters.judge(frame, rules).drop("by").collect()), key=str)
    assert got == sorted([(i, *plain_verdict(u)) for i, u in URLS], key=str)
    assert url_filters.judge(frame.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge(frame, []).collect()} == {"allow"}


def test_patterns_against_trying_all():
    """The index gives what trying every rule gives, and tries fewer."""
    rng = random.Random(5)
    words = ["ab", "cd", "ad", "e", "abc", "d1"]
    texts = ["".join(rng.choice(words) + rng.choice([".", "-", "", "/"]) for _ in range(4)) + "/" + "".join(rng.choice(words) + rng.choice(["/", "_", ""]) for _ in range(5)) for _ in range(300)]
    rules = [url_filters.pattern_rule(rng.choice(["", "||", "^", "*", "/"]) + rng.choice(words) + rng.choice(["", "^", "*", ".", "-"]) + rng.choice(words) + rng.choice(["", "^", "*", "/"]), rng.random() < 0.3) for _ in range(60)]
    rules += [url_filters.site_rule(rng.choice(words) + "." + rng.choice(words), "/" + rng.choice(["", "ab", "cd/", "e/ad"]), rng.random() < 0.5) for _ in range(30)]
    counts = {t: sum(t in set(url_filters.TOKEN.findall(x)) for x in texts) for r in rules for t in r.tokens}
    said = url_filters.Judge(rules, *url_filters.indexed(rules, counts))
    every = url_filters.Judge(rules, {}, list(range(len(rules))))
    cut = [x.split("/", 1) for x in texts]
    assert [said(h, "/" + p) for h, p in cut] == [every(h, "/" + p) for h, p in cut]
    assert said.tried < every.tried
    keyed = [r for r in rules if r.tokens]
    under, _ = url_filters.indexed(keyed, counts)
    few, all_ = url_filters.Judge(keyed, under, []), url_filters.Judge(keyed, {}, list(range(len(keyed))))
    assert [few(h, "/" + p) for h, p in cut] == [all_(h, "/" + p) for h, p in cut]
    assert few.tried <= sum(len(under.get(t, ())) for x in texts for t in set(url_filters.TOKEN.findall(x))) < len(keyed) * len(texts)
    assert all(re.search(r.regex, h + "/" + p) is None or set(r.tokens) <= set(url_filters.TOKEN.findall(h + "/" + p)) for r in rules for h, p in cut)


def test_rarest_token_is_the_key():
    rule = url_filters.site_rule("rare.com", "/en/x", False)
    assert rule.tokens == ("rare", "com", "en")
    assert url_filters.indexed([rule], {"com": 9, "rare": 2, "en": 4}) == ({"rare": [0]}, [])
    assert url_filters.indexed([url_filters.pattern_rule("*ads*", False)], {}) == ({}, [0])


def plain_runs(words, least=24):
    """All stretches of all periods, by definition."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 3 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in found.items())


def test_runs_by_brute_force(monkeypatch):
    rng = random.Random(7)
    for trial in range(400):
        letters = "ab" if trial % 3 == 0 else "abcdefgh"
        words = [rng.choice(letters) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):
            unit = [rng.choice(letters) for _ in range(rng.randrange(1, 12))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 30)[: rng.randrange(10, 90)]
        want = plain_runs(words)
        for at_once in (4096, 16):  # all periods at once, and one after the other
            monkeypatch.setattr(periodic_runs, "AT_ONCE", at_once)
            if at_once == 4096:
                assert periodic_runs.runs_of(periodic_runs.numbered(words)) == want
            elif len(words) > at_once:
                assert periodic_runs.runs_of(periodic_runs.numbered(words)) == want
        gone = {i for s, length, p in want for i in range(s + p, s + length)}
        assert periodic_runs.collapsed(" ".join(words))[2].split() == [w for i, w in enumerate(words) if i not in gone]


def test_runs_of_documents(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b " * 20), (5, "a b " * 20), (None, "x\x0by\x0c" * 30), (7, "word. " * 30_000), (8, "é ü " * 24), (9, " ".join(f"w{i % 5000}" for i in range(20_000)))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as runs", "2 as n_words", "3 as start")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in periodic_runs.collapse(frame).collect()), key=str)
    want = [(1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 1, [], "one"), (5, 40, [(0, 40, 2)], "a b"), (5, 40, [(0, 40, 2)], "a b"), (None, 60, [(0, 60, 2)], "x y"), (7, 30_000, [(0, 30_000, 1)], "word."),
            (8, 24, [(0, 24, 1)], "é ü"), (9, 20_000, [(0, 20_000, 5000)], " ".join(f"w{i}" for i in range(5000)))]
    assert got == sorted(want, key=str)
    assert periodic_runs.collapse(frame.limit(0)).count() == 0
    assert {r.doc_id: r.text for r in planted(frame.where("doc_id is null")).collect()} == {None: "x\x0by\x0c" * 30}


def plain_negatives(rows, every=50, k=5, m=3):
    seen = {(i, lab, tuple(map(float, v))) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    whole = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in seen]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    out = []
    for i, lab, v in whole:
        if i % every == 0:
            scored = sorted((-dot(v, w), j, other) for j, other, w in whole if j != i)
            for s, j, other in [x for x in scored if x[2] == lab][:k]:
                fit = [(t, n) for t, n, o in scored if o != lab and 50 * -s <= 100 * -t <= 95 * -s][:m]
                out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 1000])
def test_negatives_by_brute_force(spark, block):
    rng = random.Random(11)
    vec = lambda n=6: [round(rng.uniform(-1, 1), 1) for _ in range(n)]
    rows = [(i, rng.randrange(3), vec()) for i in range(300)]
    rows += [(1000 + i, 1, [0.5, 0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(60)] + rows[:40]
    rows += [(2000, None, vec()), (2050, 1, None), (2100, 1, [0.1, None]), (2150, 1, [float("nan")] * 6), (2200, 2, [float("inf")] * 6), (None, 1, vec()), (2250, 1, []), (2300, 2, vec(9)), (2350, 0, vec(2)), (0, 0, vec())]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").selectExpr("*", "1 as id", "2 as vector", "3 as block")
    got = hard_negatives.mine(frame, F.col("id") % 50 == 0, block=block)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == plain_negatives(rows)
    for none in (frame.limit(0), frame.where("vec_id = 1")):
        assert hard_negatives.mine(none, F.col("id") % 50 == 0).count() == 0


def test_negatives_of_great_numbers(spark):
    rng = random.Random(13)
    rows = [(i, i % 2, [rng.uniform(0.2, 1) * 10.0 ** rng.choice([6, 7, 8]), rng.uniform(0, 1) * 1e7, 1.0]) for i in range(120)] + [(500, 0, [1e30, -1e25, 0.0]), (550, 1, [1e30, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = hard_negatives.mine(frame, F.col("id") % 50 == 0)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == plain_negatives(rows)


def test_exponents_are_compared_exactly(spark):
    """The query's best run is the one of greatest length over period."""
    from helixloom.llm.queries import op12_periodic

    got = {r.doc_id: r for r in op12_periodic(spark, "/root/testdata/sf0.001").collect()}
    for r in periodic_runs.collapse(planted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))).collect():
        best = min(((-Fraction(x.length, x.period), x.start, x.period, x.length) for x in r.runs), default=None)
        q = got[r.doc_id]
        assert (q.start, q.period, q.length) == ((best[1], best[2], best[3]) if best else (None, None, None))
        assert q.n_runs == len(r.runs) and q.exponent_milli == (best and 1000 * best[3] // best[2])
