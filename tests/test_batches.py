"""Steps over whole batches against their definitions, one sequence at a time."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from helixloom.functions import batches
from helixloom.functions import sequence as S
from helixloom.operators import audit, gates, identify, offtarget, orfs
from helixloom.plans import gate_queries, reference_queries, rule_queries
from test_reference_queries import SF


def texts(n: int = 200, seed: int = 7) -> list[str]:
    r = random.Random(seed)
    parts = ["".join(r.choice("ACGT") for _ in range(96)) for _ in range(5)]
    plain = ["".join(r.choice("ACGT") for _ in range(r.randint(0, 400))) for _ in range(n)]
    few = ["".join(r.choice("AG") for _ in range(r.randint(0, 70))) for _ in range(n)]
    mixed = ["".join(r.choice("ACGTNacgtRé") for _ in range(r.randint(0, 90))) for _ in range(n)]
    joined = ["".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(n)]
    return ["", "A", "AA", "ATGTAA", "AGGAGG", *plain, *few, *mixed, *joined]


def rows(spark, given):
    return spark.createDataFrame(list(enumerate(given)), "record int, seq string")


def test_repeats_of_batches():
    given = texts()
    got, done = batches.short_repeats(pa.array(given))
    assert all(tuple(g) == audit.longest_repeat(x) for x, g, d in zip(given, got.tolist(), done) if d)
    assert not done[given.index(next(x for x in given if "é" in x))] and done.sum() > len(given) / 2
    for k in (2, 5, 30, 40):
        assert batches.repeated_words(pa.array(given), k).tolist() == [sum(m > 1 for m in Counter(x[i : i + k] for i in range(len(x) - k + 1)).values()) for x in given]


def test_frames_of_batches(spark):
    given = rows(spark, texts())
    for least in (1, 12):
        want = given.select("record", F.explode(orfs.frames("seq", least)).alias("f")).select("record", "f.*")
        got = orfs.open_frames(given, least)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        upper = given.select("record", F.upper("seq").alias("part"))
        ranked = F.array_min(F.transform(orfs.frames("part", least), lambda x: F.struct((-x["aa"]).alias("less"), (-x["strand"]).alias("back"), x["frame"].alias("frame"), (x["start"] * x["strand"]).alias("at"), x.alias("orf"))))
        best = {r.record: r.o and (r.o.start, r.o.end, r.o.strand, r.o.aa) for r in upper.select("record", ranked["orf"].alias("o")).collect()}
        assert {r.record: r.o and tuple(r.o) for r in orfs.longest_frames(upper, least).collect()} == best


def test_cores_and_first_sites_of_batches(spark):
    given = rows(spark, [*texts(), "AC" * 9, "GTAC", "TACTAC"])
    upper = given.select("record", F.upper("seq").alias("body"))
    want = {r.record: r.core and r.core.start for r in upper.select("record", S.best_shine_dalgarno("body").alias("core")).collect()}
    assert {r.record: r.core for r in orfs.with_core(upper).collect()} == want
    for motif in ("AC", "GAATTC", "A"):
        both = given.select(S.first_positions("seq", motif, 7).alias("a"), F.slice(S.site_positions("seq", motif), 1, 7).alias("b")).collect()
        assert all(r.a == r.b for r in both)
    assert given.select(gates.first_sites("seq", "AC").alias("x")).where("x is null").isEmpty()


def test_no_walk_letter_by_letter_in_plans(spark):
    """The lambdas of these walks took most of the queries' time."""
    plan = lambda q: q(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for q in (rule_queries.open_frames, rule_queries.gap_blocks, reference_queries.direct_repeats):
        text = plan(q)
        assert "MapInArrow" in text and "regexp_extract_all" not in text
    assert "MapInArrow" in plan(rule_queries.start_spacing) and "regexp_extract_all" not in plan(rule_queries.start_spacing)
    assert "array_union" not in plan(gate_queries.site_places)


def test_identification_where_queries_are_read(spark):
    """The same hits as by joins on k-mers, and no k-mer or query text is shuffled."""
    r = random.Random(3)
    letters = lambda n, a="ACGT": "".join(r.choice(a) for _ in range(n))
    refs = [(f"r{i}", letters(r.choice((26, 40, 96, 200)))) for i in range(30)] + [("low", letters(60, "AC")), ("n", letters(50) + "NNRN" + letters(40))]

    def bent(text: str) -> str:
        out = list(text)
        for _ in range(r.randint(0, 6)):
            out[r.randrange(len(out))] = r.choice(("", "A", "GG", "N", "é"))
        return "".join(out)

    given = ["", "ACG", *("".join(bent(r.choice(refs)[1]) if r.random() < 0.8 else letters(20) for _ in range(r.randint(1, 5))) for _ in range(150)), refs[0][1] * 7]
    queries = rows(spark, given).toDF("query", "qseq")
    both = identify.stranded(spark.createDataFrame(refs, "ref string, seq string")).cache()
    want = identify.extended(identify.diagonals(identify.seeds(queries, both), None), queries, both)
    got = identify.read_where_they_are(queries, identify.gathered(both))
    assert got.dtypes == want.dtypes and want.count() > 300
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert identify.read_where_they_are(queries, []).count() == 0
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_many_letters_or_bases_are_joined(spark, monkeypatch):
    """Words of too many letters are no numbers, and many bases go to no task."""
    wide = spark.createDataFrame([("a", 1, "".join(chr(c) for c in range(48, 100)))], "ref string, strand int, rseq string")
    assert identify.gathered(wide) is None and identify.gathered(wide.select("ref", "strand", F.lit("ACGT" * 9).alias("rseq"))) is not None
    monkeypatch.setattr(identify, "BROADCAST_BASES", 10)
    assert identify.gathered(wide.select("ref", "strand", F.lit("ACGT" * 9).alias("rseq"))) is None


def test_low_complexity_of_plain_letters(spark):
    """Plain letters are counted by taking them out; others as before."""
    given = rows(spark, [*texts(), "AAAAAAAAC", "AAAAC", "aaaAAc", "NNNNN", "NNNNNNNNNA", "ééééééA", None])
    s = F.upper("seq")
    top = F.array_max(F.transform(F.array_distinct(F.split(s, "")), lambda x: F.length(s) - F.length(F.replace(s, x, F.lit("")))))
    want = (F.length(s) == 0) | (F.size(F.array_distinct(F.split(s, ""))) == 1) | (top > 0.8 * F.length(s))
    assert given.where(~S.low_complexity("seq").eqNullSafe(want)).isEmpty() and given.where(S.low_complexity("seq")).count() > 5
    text = given.select(S.low_complexity("seq"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in text


def test_internal_stops_by_one_pattern(spark):
    """As codon by codon, which was done several times for each block; a frame
    of stops alone has none inside, which the walk took for one."""
    r = random.Random(5)
    made = ["".join(r.choice(("TAA", "TGA", "tag", "GCC", "ATA", "\n\nA")) for _ in range(r.randint(0, 6))) + "TA"[: r.randint(0, 2)] for _ in range(300)]
    given = [*texts(), *made]

    def internal(text: str) -> bool:
        codons = [text.upper()[i : i + 3] for i in range(0, len(text) // 3 * 3, 3)]
        while codons and codons[-1] in S.STOPS:
            codons.pop()
        return any(c in S.STOPS for c in codons)

    got = rows(spark, [*given, None]).select("record", S.internal_stop("seq").alias("got"))
    found = {r.record: r.got for r in got.collect()}
    assert found.pop(len(given)) is None and found == {i: internal(x) for i, x in enumerate(given)} and 50 < sum(found.values()) < 900
    assert "regexp_extract_all" not in got.select("got")._jdf.queryExecution().optimizedPlan().toString()


def test_longest_stretches_meet_what_a_genome_has_once_however_often(spark, monkeypatch):
    r = random.Random(11)
    parts = ["".join(r.choice("ACGTN"[: 4 + (i == 3)]) for _ in range(32)) for i in range(4)]
    hosts = {h: "".join(r.choice(parts) for _ in range(40)) + "ACG" for h in (1, 2)}
    pieces = offtarget.pieces(spark.createDataFrame(list(hosts.items()), "host int, gseq string"), 32, 16)
    turned = lambda x: x[::-1].translate(str.maketrans("ACGTN", "TGCAN"))
    given = ["", "ACG", None, hosts[1][-30:], turned(hosts[2][7:90]), hosts[1][3:25], hosts[1][3:26]]
    for _ in range(100):
        a = r.randint(0, 1100)
        text = hosts[r.randint(1, 2)][a : a + r.randint(10, 150)]
        b = r.randint(0, len(text) - 1)
        text = r.choice([text, text[:b] + r.choice("ACGTNRX") + text[b + 1 :], text[b:] + text[:b]])
        given.append(r.choice([text, turned(text)]))
    q = spark.createDataFrame(list(enumerate(given)), "query int, qseq string")

    def longest(x, cap):
        have = [y for y in (x or "", turned(x or ""))]
        return max([n for y in have for i in range(len(y)) for n in range(23, min(cap, len(y) - i) + 1) if any(y[i : i + n] in g for g in hosts.values())], default=0)

    for cap in (41, 100):
        got = offtarget.longest_shared(q, pieces, cap, 32)
        assert {x.query: x.longest for x in got.collect()} == {i: longest(x, cap) for i, x in enumerate(given)}
        assert "Join" not in got._jdf.queryExecution().toString()
        assert {tuple(x) for x in offtarget.met_stretches(q, pieces, cap, 32).collect()} == {tuple(x) for x in got.collect()}
    levels = [x.tolist() for x in offtarget.indexed(pieces, 60, 32, 100_000).levels]
    assert offtarget.indexed(pieces.withColumn("j", F.explode(F.array(*map(F.lit, range(5))))).withColumn("host", F.col("host") * 10 + F.col("j")), 60, 32, 100_000).levels[4].tolist() == levels[4]
    monkeypatch.setattr(offtarget, "BROADCAST_BASES", 0)  # the levels are then made by Spark
    assert [x.tolist() for x in offtarget.indexed(pieces, 60, 32, 100_000).levels] == levels
    assert offtarget.indexed(pieces, 100, 32, 1000) is None and offtarget.indexed(pieces.withColumn("bases", F.lit("ACGR")), 100, 32, 1000) is None


def test_statuses_of_homology_need_no_longer_stretch():
    # what decompose.audited looks for: up to these every length has its own say
    for reca_minus, cap in ((False, gates.SUBSTRATE + 1), (True, gates.GENE_SCALE)):
        status = lambda n: "FLAG" if n >= gates.GENE_SCALE else ("NOTE" if reca_minus else "FLAG") if n > gates.SUBSTRATE else "PASS"  # noqa: B023, E731
        assert all(status(n) == status(min(n, cap)) for n in range(1200))
