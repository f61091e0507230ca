import random
import re

import pytest
from pyspark.sql import functions as F

from helixloom.functions import sequence as S
from helixloom.operators import audit, identify


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


def random_seq(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


@pytest.mark.parametrize("seq,motif", [("GAATTCGAATTC", "GAATTC"), ("AAAA", "AA"), ("", "AA"), ("TTTT", "GG"), (random_seq(400, 1), "AC")])
def test_positions_overlap(spark, seq, motif):
    assert one(spark, S.positions("s", motif), s=seq) == [m.start() for m in re.finditer(f"(?={motif})", seq)]


def test_runs_and_complexity(spark):
    assert one(spark, S.longest_run("s"), s="ACCCGTTTTA") == 4
    assert one(spark, S.longest_run("s"), s="") == 0
    assert one(spark, S.longest_run("s", any_letter=False), s="NNNNNAAC") == 2
    assert one(spark, S.low_complexity("s"), s="AAAAAAAAAC") and not one(spark, S.low_complexity("s"), s="ACGTACGT")
    assert one(spark, S.low_complexity("s"), s="")


def test_frames(spark):
    assert one(spark, S.internal_stop("s"), s="ATGTAACCC")
    assert not one(spark, S.internal_stop("s"), s="ATGCCCTAATAA")
    assert one(spark, S.best_shine_dalgarno("s"), s="CCAGGAGGCC").asDict() == {"score": 6, "start": 2}
    assert one(spark, S.best_shine_dalgarno("s"), s="CCCCCCCCCC") is None


def test_trims(spark):
    f = lambda s, t, v: one(spark, S.trimmed(F.col("s"), F.col("t"), F.col("v")), s=s, t=t, v=v)
    assert f("AACCGG", "GG", "AA") == "CC" and f("AACCGG", "TT", "") is None and f("aacc", "", "") == "AACC"


def test_origin_block(spark):
    text = one(spark, S.origin_block("s"), s=random_seq(130, 2))
    assert [x[:9].strip() for x in text.split("\n")] == ["1", "61", "121"] and len(text.split("\n")[0]) == 9 + 66


def test_best_segment_is_maximal(spark):
    for seed in range(5):
        a, b = random_seq(60, seed), random_seq(60, seed + 50)
        got = one(spark, S.best_segment(F.col("a"), F.col("b")), a=a, b=b)
        steps = [1 if x == y else -1 for x, y in zip(a, b)]
        assert got.score == max(sum(steps[i:j]) for i in range(60) for j in range(i + 1, 61))
        assert sum(steps[got.start : got.end]) == got.score and got.matches == steps.count(1)


def test_identify_finds_planted_parts(spark):
    refs = {f"p{i}": random_seq(120 + 20 * i, i) for i in range(4)}
    rc = refs["p2"][::-1].translate(str.maketrans("ACGT", "TGCA"))
    dropped = refs["p3"][:90] + refs["p3"][93:]
    construct = random_seq(30, 99) + refs["p0"] + random_seq(17, 98) + rc + dropped
    q = spark.createDataFrame([("c", construct)], "query string, qseq string")
    r = spark.createDataFrame(list(refs.items()), "ref string, seq string")
    got = {b.ref: b for b in identify.identify(q, r).collect()}
    assert set(got) == {"p0", "p2", "p3"}
    assert (got["p0"].qstart, got["p0"].qend, got["p0"].strand) == (31, 150, 1) and got["p0"].pident == 100.0
    assert got["p2"].strand == -1 and got["p2"].qstart == 168
    assert got["p3"].indel == 3 and got["p3"].indel_net in (-3, 3)


def test_short_hits_overlap(spark):
    q = spark.createDataFrame([("c", "T" + "ACACACACACACACAC" + "G")], "query string, qseq string")
    r = spark.createDataFrame([("s", "ACACACACACACAC", 1)], "ref string, rseq string, strand int")
    assert sorted(h.qstart for h in identify.short_hits(q, r).collect()) == [2, 4]


def test_identify_finds_short_parts(spark):
    """A part of 15 bases on both strands beside a long one."""
    short, long = random_seq(15, 7), random_seq(120, 8)
    rc = short[::-1].translate(str.maketrans("ACGT", "TGCA"))
    construct = random_seq(40, 1) + short + random_seq(33, 2) + long + random_seq(21, 3) + rc + random_seq(30, 4) + "A" * 20
    q = spark.createDataFrame([("c", construct)], "query string, qseq string")
    r = spark.createDataFrame([("rbs", short.lower()), ("p", long), ("plain", "A" * 12)], "ref string, seq string")
    got = sorted((b.ref, b.qstart, b.qend, b.strand, b.pident, b.cov, b.bit, b.ref_length, b.indel) for b in identify.identify(q, r).collect())
    assert got == [("p", 89, 208, 1, 100.0, 1.0, 240, 120, 0), ("rbs", 41, 55, 1, 100.0, 1.0, 30, 15, 0), ("rbs", 230, 244, -1, 100.0, 1.0, 30, 15, 0)]


def test_a_fifth_copy_is_reported(spark):
    part, other = random_seq(60, 5), random_seq(60, 6)
    q = spark.createDataFrame([("five", "".join(part + random_seq(20, 50 + i) for i in range(5)) + other), ("four", "".join(part + random_seq(20, 50 + i) for i in range(4)))], "query string, qseq string")
    r = spark.createDataFrame([("p", part), ("o", other)], "ref string, seq string")
    got = audit.partial_findings(identify.identify(q, r)).collect()
    assert [(f.record, f.category, f.status, f.ref, f.places) for f in got] == [("five", "identification-partial", "FLAG", "p", 5)]
