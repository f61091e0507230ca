"""Records of planted parts, end to end: blocks, labels and verdicts."""

import random

import pytest

from helixloom.functions import sequence as S
from helixloom.operators import decompose, identify
from pyspark.sql import functions as F
from helixloom.plans import reference_queries  # noqa: F401


def made(n, seed):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def turned(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


PARTS = {"BBa_P1": made(200, 1), "BBa_P2": made(150, 2), "P2_again": made(150, 2), "BBa_S3": made(18, 3), "BBa_P4": made(300, 4), "BBa_P5": made(120, 5)}


@pytest.fixture(scope="module")
def audit(spark):
    p1, p2, s3, p4 = (PARTS[x] for x in ("BBa_P1", "BBa_P2", "BBa_S3", "BBa_P4"))
    inside = made(40, 11) + PARTS["BBa_P5"] + made(40, 12)
    records = {
        "right": (made(20, 20) + p1 + s3 + turned(p2) + made(3, 21), [("P1", "promoter", 21, 220, 1), ("S3", "rbs", 221, 238, 1), ("P2_AGAIN", "cds", 239, 388, -1)]),
        "wrong": (p1 + p2, [("BBa_P5", "promoter", 1, 200, 1), ("P2", "cds", 151, 350, -1)]),
        "lost base": (p4[:100] + p4[101:] + p1, [("P4", "terminator", 1, 299, 1)]),
        "cut": (made(30, 22) + p4[:200] + made(30, 23), [("P4", "terminator", 31, 230, 1)]),
        "inner": (made(10, 24) + inside + made(10, 25), [("big", "origin", 11, 210, 1), ("P1", "promoter", 51, 170, 1), ("P5", "promoter", 51, 170, 1)]),
        "nothing": (made(90, 26), []),
        "short": ("ACGTA", []),
    }
    text = spark.createDataFrame([(k, v[0]) for k, v in records.items()], "record string, seq string")
    features = spark.createDataFrame([(k, *f) for k, v in records.items() for f in v[1]], "record string, claim string, kind string, start int, end int, strand int")
    refs = spark.createDataFrame([(k, v, "parts-library v1" if k == "BBa_P2" else "elsewhere") for k, v in [*PARTS.items(), ("BIG", inside)]], "ref string, seq string, provenance string")
    blocks, findings, verdicts = decompose.audited(text, refs, features)
    rows = lambda f: [r.asDict() for r in f.collect()]
    return rows(blocks), rows(findings), {r["record"]: r["verdict"] for r in rows(verdicts)}


def of(rows, record, kind=None):
    return sorted((b["start"], b["end"], b["ident"]) for b in rows if b["record"] == record and kind in (None, b["kind"]))


def test_blocks(audit):
    blocks = audit[0]
    assert of(blocks, "right", "found") == [(21, 220, "BBa_P1"), (221, 238, "BBa_S3"), (239, 388, "BBa_P2")] and of(blocks, "right", "gap") == [(1, 20, None)]
    (p2,) = [b for b in blocks if b["record"] == "right" and b["ident"] == "BBa_P2"]
    assert p2["strand"] == -1 and p2["alternatives"] == ["P2_again"] and p2["claim"] == "P2_AGAIN" and p2["role"] == "cds"
    (lost,) = [b for b in blocks if b["record"] == "lost base" and b["ident"] == "BBa_P4"]
    assert (lost["start"], lost["end"], lost["indel"], lost["indel_net"]) == (1, 299, 1, -1) and 99 < lost["pident"] < 100
    assert of(blocks, "cut", "found") == [(31, 230, "BBa_P4")]
    assert of(blocks, "inner", "found") == [(11, 210, "BIG")]
    assert of(blocks, "nothing") == [(1, 90, None)] and of(blocks, "short") == []


def test_findings(audit):
    found = lambda record: {(f["category"], f["status"]) for f in audit[1] if f["record"] == record}
    assert {(c, s) for c, s in found("right") if s not in ("NOTE", "PASS") and not c.startswith("orf")} == {("host-homology", "SKIP"), ("junction", "FLAG")} and ("identity-synonym", "NOTE") in found("right")
    assert ("decomposition", "NOTE") in found("right")
    assert {("identity-mislabel", "FLAG"), ("identity-orientation", "FLAG")} <= found("wrong")
    assert ("indel", "FLAG") in found("lost base") and ("truncation", "FLAG") in found("cut")
    assert ("identity-mislabel", "FLAG") in found("inner") and len([f for f in audit[1] if f["record"] == "inner" and f["category"] == "identity-mislabel"]) == 1
    assert ("invariant", "FLAG") in found("short")
    assert audit[2]["cut"] == "REVIEW" and audit[2]["wrong"] == "FAIL"  # a random part labelled as coding has stops


def test_gapped_pieces_are_counted_once(spark):
    """Pieces that both reach past the lost base, against an alignment by hand."""
    a = {"diag": 0, "qstart": 1, "qend": 60, "rstart": 0, "rend": 60, "span": 60, "matches": 55, "marks": "1" * 50 + "10" * 5, "indel": 0, "indel_net": 0, "indel_events": 0}
    b = {"diag": -1, "qstart": 45, "qend": 99, "rstart": 45, "rend": 100, "span": 55, "matches": 52, "marks": "101" * 3 + "1" * 46}
    fields = [x.split(":") for x in identify.PIECE[7:-1].split(",")]
    piece = lambda x: F.struct(*[F.lit(x.get(c, False if kind == "boolean" else 0 if kind == "int" else None)).cast(kind).alias(c) for c, kind in fields]).cast(identify.PIECE)
    got = spark.range(1).select(
        identify.lengthened(piece(a), piece(b)).alias("both"), identify.adjoining(piece(a), piece(b)).alias("fit"), identify.adjoining(piece(a), piece(b | {"diag": 0})).alias("same"), identify.adjoining(piece(a), piece(b | {"diag": -40})).alias("far"),
        identify.chains(F.array(piece(a), piece(b), piece(b | {"diag": -40, "qstart": 300, "qend": 354}))).alias("chains"),
    ).first()
    both = got.both
    assert (both["matches"], both["span"], both["pident"]) == (55 + 39, 60 + 39, 94.0) and (both["indel"], both["indel_net"], both["qend"]) == (1, -1, 99)
    assert (got.fit, got.same, got.far) == (True, False, False)
    assert [(c.qstart, c.qend, c.indel_events) for c in got.chains] == [(1, 99, 1), (300, 354, 0)]


def test_circles(spark):
    """A part over the origin is whole and reported once, a truncated copy
    elsewhere stays, gaps go round, and a line is not read as a circle."""
    part, other = made(160, 31), made(130, 32)
    ring = part + made(30, 33) + part[:110] + made(40, 34) + other + made(20, 35)
    n, at = len(ring), lambda r: ring[r:] + ring[:r]
    records = {**{f"r{r}": (at(r), True) for r in (0, 26, 60, 155, 185, 300, 470, 485)}, "line": (at(60), False), "small": (part[40:] + part[:40], True)}
    text = spark.createDataFrame([(k, *v) for k, v in records.items()], "record string, seq string, circular boolean")
    refs = spark.createDataFrame([("PART", part), ("OTHER", other)], "ref string, seq string")
    feats = spark.createDataFrame([("r60", "PART", "promoter", n - 60 + 1, n + 100, 1)], "record string, claim string, kind string, start int, end int, strand int")
    blocks, findings, verdicts = decompose.audited(text, refs, feats)
    rows = blocks.collect()
    for name in (k for k in records if k[0] == "r"):
        r = int(name[1:])
        got = {((b.start - 1 + r) % n, b.end - b.start + 1, b.ident, b.kind) for b in rows if b.record == name}
        assert got == {(0, 160, "PART", "found"), (160, 30, None, "gap"), (190, 110, "PART", "found"), (300, 40, None, "gap"), (340, 130, "OTHER", "found"), (470, 20, None, "gap")}, name
        assert sum(b.end - b.start + 1 for b in rows if b.record == name) == n
    assert {(b.ident, b.end - b.start + 1) for b in rows if b.record == "line" and b.ident == "PART"} == {("PART", 100), ("PART", 110)}
    assert [(b.start, b.end, b.ident) for b in rows if b.record == "small"] == [(121, 280, "PART")]
    (claimed,) = [b for b in rows if b.claim]
    assert (claimed.record, claimed.ident, claimed.end - claimed.start + 1) == ("r60", "PART", 160)
    same = {v.record: (v.verdict, v.n_fail, v.n_flag) for v in verdicts.collect()}
    assert len({same[k] for k in same if k[0] == "r" and k != "r60"}) == 1 and len(same) == len(records)
    assert ("small", "truncation") not in {(f.record, f.category) for f in findings.collect()}


def test_circular_locations(spark):
    rows = [("join(104..129,1..103)", 104, 232), ("complement(join(100..129,1..20))", 100, 149), ("join(5..20,30..40)", 5, 40), ("<7", 7, 7), ("join(90..100,110..129,1..4,9..12)", 90, 141), ("3..129", 3, 129)]
    got = spark.createDataFrame([(x,) for x, _, _ in rows], "loc string").select(S.circular_location("loc", F.lit(129)).alias("l")).collect()
    assert [(r.l.start, r.l.end) for r in got] == [(a, b) for _, a, b in rows] and [r.l.strand for r in got] == [1, -1, 1, 1, 1, 1]
    assert spark.range(1).select(S.stretch(F.lit("ABCDE"), F.lit(4), F.lit(7)), S.stretch(F.lit("ABCDE"), F.lit(2), F.lit(3))).first()[:] == ("DEAB", "BC")


def test_every_whole_copy_is_found_beyond_the_cap(spark):
    """A reference that lies whole in more than LOCI places has a block at each."""
    part, spacer = made(96, 50), made(20, 51)
    text = spark.createDataFrame([("six", (part + spacer) * 6), ("turned", (turned(part) + spacer) * 7)], "query string, qseq string")
    got = identify.identify(text, spark.createDataFrame([("P", part)], "ref string, seq string"))
    places = {k: [i * 116 + 1 for i in range(n)] for k, n in (("six", 6), ("turned", 7))}
    found = got.collect()
    assert {k: sorted(r.qstart for r in found if r.query == k) for k in places} == places
    assert all(r.n_diagonals > identify.LOCI and r.qend == r.qstart + 95 and r.pident == 100.0 for r in found)
