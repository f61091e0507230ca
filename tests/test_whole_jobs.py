"""Jobs that failed at size: by what the driver gathered, what lay on disk, or time."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixloom.functions import batches
from helixloom.operators import decompose, identify, lineage, offtarget
from helixloom.plans import gate_queries, record_queries, reference_queries
from helixloom.sources import writers
from test_dealt import plan_of
from test_reference_queries import SF


def test_what_is_cut_is_worked_out_once_and_packed(spark):
    ran = spark.sparkContext.accumulator(0)

    def run(found):
        for batch in found:
            ran.add(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["ACGT" * 100] * batch.num_rows)], names=["id", "seq"])

    got = lineage.cut(spark.range(5000).mapInArrow(run, "id long, seq string"))
    assert ran.value == 5000 and got.count() == 5000 and ran.value == 5000
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 500_000  # 2 MB of letters


def test_many_parts_and_references_are_not_sent_to_every_task(spark, monkeypatch):
    """From a packed file's size Spark gathered all parts with their bases in the driver, once for each step."""
    for module in (reference_queries, gate_queries):
        monkeypatch.setattr(module, "BROADCAST_NAMES", 0)
    for frame in record_queries.rotated(spark, SF)[::2]:
        assert "BroadcastHashJoin" not in plan_of(frame) and "SortMergeJoin [part" in plan_of(frame)


def test_only_names_of_parts_move_with_lines(spark):
    plan = reference_queries.spelt_lines(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    moved = plan.index("RepartitionByExpression")
    assert "md5" not in plan[moved : plan.index("Relation", moved)]
    got = reference_queries.spelt_lines(spark, SF)
    want = reference_queries.lines(spark, SF)
    assert got.exceptAll(want.select(got.columns)).isEmpty() and want.select(got.columns).exceptAll(got).isEmpty()


def test_claims_of_records_meet_their_hits_in_one_row(spark, monkeypatch):
    """Claims twice over, of no kind, of no start and of no record; one store of all blocks."""
    part = "".join("ACGT"[(i * i * 7 + i // 3) % 4] for i in range(120))
    text = spark.createDataFrame([("a", "ACGTTGCAAG" + part), ("b", "ACGTAC")], "record string, seq string")
    rows = [("a", "P", "cds", 11, 130, 1)] * 2 + [("a", "in", "cds", 20, 60, 1), ("a", "src", "source", 1, 130, 1), ("a", "none", None, 1, 9, 1), ("a", "cut", "cds", None, 9, 1), ("z", "far", "rbs", 3, 9, -1)]
    feats = spark.createDataFrame(rows, "record string, claim string, kind string, start int, end int, strand int")
    stored = []
    monkeypatch.setattr(decompose, "cut", lambda df: stored.append(df) or lineage.cut(df))
    blocks, inner = decompose.decompose(text, spark.createDataFrame([("P", part)], "ref string, seq string"), feats)
    assert len(stored) == 2
    got = {(b.record, b.start, b.end, b.ident, b.claim, b.kind) for b in blocks.collect()}
    assert got == {("a", 11, 130, "P", "P", "found"), ("a", None, 9, None, "cut", "claimed"), ("z", 3, 9, None, "far", "claimed"), ("b", 1, 6, None, None, "gap")}
    assert [(c.claim, c.start, c.end) for c in inner.collect()] == [("in", 20, 60)]


def test_many_references_are_read_block_by_block_and_no_kmer_moves(spark, monkeypatch):
    """Changed, cut, gapped, turned and repeated copies, other letters and short ones, as by the join of k-mers."""
    dice = random.Random(7)
    made = lambda n: "".join(dice.choices("ACGT", k=n))
    refs = {f"r{i}": made(96) for i in range(40)} | {f"s{i}": made(18) for i in range(6)} | {"long": made(400), "odd": made(40) + "NN" + made(50)}
    refs |= {"again": refs["r3"], "near": refs["r4"][:60] + made(36)}

    def copy(name):
        s, at = refs[name], dice.randrange(20, 70)
        kind = dice.randrange(6)
        s = [s, s[:at] + s[at + 1 :], s[:at] + "A" * dice.randrange(1, 5) + s[at:], "".join(dice.choice("ACGT") if dice.random() < 0.08 else c for c in s), s[: int(len(s) * 0.63)], s[:at] + "N" + s[at + 1 :]][kind]
        return s if dice.random() < 0.6 else s[::-1].translate(str.maketrans("ACGT", "TGCA"))

    texts = [(f"q{i}", "".join(copy(dice.choice(list(refs))) + made(dice.randrange(25)) for _ in range(5))) for i in range(60)]
    queries = spark.createDataFrame([*texts, ("none", "ACGT")], "query string, qseq string")
    given = spark.createDataFrame(list(refs.items()), "ref string, seq string")
    monkeypatch.setattr(identify, "BROADCAST_BASES", 0)
    monkeypatch.setattr(identify, "BLOCK_BASES", 2500)
    want = sorted(map(str, identify.tiled(identify.whole_hits(queries, given)).collect()))
    got = identify.identify(queries, given)
    assert sorted(map(str, got.collect())) == want and len(want) > 200
    monkeypatch.setattr(identify, "BROADCAST_BASES", 2000)  # some are short, and all others plain
    plan = plan_of(identify.identify(queries, given.where("ref <> 'odd'")))
    assert "kmer" not in plan and "posexplode" not in plan and "MapInArrow" in plan
    assert sorted(map(str, identify.identify(queries, given).collect())) == want


def test_queries_of_one_text_are_read_once_against_a_genome(spark, monkeypatch):
    """Turned, changed and cut copies over borders of pieces, at both ends of genomes, as by the join of k-mers."""
    dice = random.Random(11)
    made = lambda n, letters="ACGT": "".join(dice.choices(letters, k=n))
    genomes = [(h, made(700 + 90 * h, "ACGTN" if h == 2 else "ACGT")) for h in range(3)]
    texts = [made(60)]
    for h, g in genomes:
        for at in (0, 37, 250, len(g) - 130):
            s = g[at : at + 130]
            s = s[:50] + "A" + s[51:] + made(dice.randrange(9))
            texts += [made(20) + s, s[::-1].translate(str.maketrans("ACGTN", "TGCAN")), s[:70]]
    queries = spark.createDataFrame([(i, t.lower() if i % 5 == 0 else t) for i, t in enumerate(texts * 3)], "query long, qseq string")
    pieces = lineage.cut(offtarget.pieces(spark.createDataFrame(genomes, "host long, gseq string"), 96))
    got = offtarget.host_hits(queries, pieces, size=96)
    assert "kmer" not in plan_of(got) and "MapInArrow" in plan_of(got)
    rows = sorted(map(tuple, got.collect()))
    upper = queries.select("query", F.upper("qseq").alias("qseq"))
    assert rows == sorted(map(tuple, offtarget.joined_hits(upper, pieces, offtarget.K, 80.0, 40, 96).select(got.columns).collect())) and len(rows) > 90
    monkeypatch.setattr(identify, "BROADCAST_BASES", 900)  # several blocks of texts
    assert rows == sorted(map(tuple, offtarget.host_hits(queries, pieces, size=96).select(got.columns).collect()))
    loci = spark.createDataFrame([(1, 1, 0, 5, "b"), (1, 0, 1, 9, "a"), (2, 0, 9000, 9001, "far")], "query long, ordinal int, start long, end long, part string")
    found = offtarget.classified(got, loci, 2000)
    assert "Aggregate" not in plan_of(found.select("level")).split("MapInArrow")[0]
    assert {(x.expected, x.level == "INFO") for x in found.where("query = 1").collect()} == {("a", True)} and found.where("query = 2 and expected is not null").isEmpty()


def test_an_index_is_made_once_in_a_worker():
    made = []
    for key in ("a", "a", "b", "b", "a"):
        assert batches.held(key, lambda: made.append(key) or len(made)) == len(made)
    assert made == ["a", "b", "a"]


def test_lines_move_without_few_sequences(spark, monkeypatch):
    lines = reference_queries.lines(spark, SF)
    got = writers.moved(lines, lines, 6000)
    dealt_ = [x for x in plan_of(got).split("\n") if "REPARTITION_BY_NUM" in x]
    below = plan_of(got).split(dealt_[0])[1].strip().split("\n")[0]
    assert len(dealt_) == 1 and "xxhash64" in below and "AS seq" not in below
    assert got.schema["seq"].dataType.simpleString() == "string" and len(dict(got.dtypes)) == len(lines.columns)
    assert got.select(lines.columns).exceptAll(lines).isEmpty() and got.count() == lines.count()
    monkeypatch.setattr(writers, "BROADCAST_IDS", 3)
    assert "Broadcast" not in plan_of(writers.moved(lines, lines, 6000)).split("REPARTITION")[0]
