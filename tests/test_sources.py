from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helixloom.sources import files
from helixloom.streaming import inbox

GENBANK = """LOCUS       demo 24 bp    DNA     circular   SYN 01-JAN-2026
FEATURES             Location/Qualifiers
     promoter        1..6
                     /label="first"
     CDS             complement(join(7..12,15..20))
                     /gene="g"
ORIGIN
        1 acgtacgtac gtacgtacgt acgt
//
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.gb").write_text(GENBANK)
    (tmp_path / "b.fasta").write_text(">one\nACGT\nacgt\n>two\nTTTT\n")
    (tmp_path / "c.csv").write_text("part,sequence\nx,ACGTACGTAC\ny,GGGGCCCCTT\n")
    (tmp_path / "d.png").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    (tmp_path / "e.gb").write_text(GENBANK.replace("24 bp", "99 bp"))
    (tmp_path / "f.txt").write_text("no bases")
    return tmp_path


def test_records_and_rejects(spark, folder):
    good, bad = files.records(files.flat_files(spark, str(folder)))
    got = {Path(r.path).name: r for r in good.collect()}
    assert got["a.gb"].seq == "ACGT" * 6 and got["a.gb"].topology == "circular" and got["a.gb"].name == "demo"
    assert got["b.fasta"].seq == "ACGTACGTTTTT" and got["b.fasta"].name == "two"
    assert got["c.csv"].seq == "ACGTACGTACGGGGCCCCTT"
    assert {Path(r.path).name for r in bad.collect()} == {"d.png", "e.gb", "f.txt"}


def test_claims(spark, folder):
    got = files.claims(files.flat_files(spark, str(folder), "a.gb")).orderBy("n").collect()
    assert [(r.kind, r.start, r.end, r.strand, r.label) for r in got] == [("promoter", 1, 6, 1, "first"), ("CDS", 7, 20, -1, "g")]


def test_written_flat_file_reads_back(spark):
    row = spark.createDataFrame([("n", "ACGTTGCAAC" * 13)], "name string, seq string")
    text = row.select(files.genbank_text(F.col("name"), F.col("seq"), F.lit("linear"), F.lit("2026-01-02").cast("date")).alias("t"), "seq")
    got = text.select(files.extract_sequence("t").alias("s"), "seq").first()
    assert got.s == got.seq
    fasta = row.select(files.extract_sequence(files.fasta_text(F.col("name"), F.col("seq"))).alias("s")).first()
    assert fasta.s == got.seq


def test_inbox(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    inbox.audit_inbox(spark, str(folder), str(out / "r"), str(out / "c")).awaitTermination()
    got = spark.read.parquet(str(out / "r"))
    assert got.where("status = 'FAIL'").count() == 3 and got.where("category = 'composition'").count() == 3


@pytest.mark.parametrize("size, over, span", [(4096, 64, 1 << 20), (10, 3, 40), (7, 5, 23), (1, 1, 1)])
def test_genome_pieces(spark, tmp_path, size, over, span):
    """Whatever the ranges, pieces make each record again, once."""
    import random

    from helixloom.sources.genomes import FastaPieces

    rng = random.Random(1)
    spark.dataSource.register(FastaPieces)
    want = {}
    for f in range(2):
        text = ""
        for i in range(5):
            seq = "".join(rng.choice("ACGTN") for _ in range(rng.choice([1, 9, 10, 11, 60, 133])))
            want[f"g{f}r{i}"] = seq
            text += f">g{f}r{i} about it\n" + "\n".join(seq[j : j + 13].lower() for j in range(0, len(seq), 13)) + rng.choice(["\n", "\n\n", "\r\n"])
        (tmp_path / f"{f}.fasta").write_text(text)
    (tmp_path / "bad.fa").write_text("stray\n>empty\n>odd\nACGT12\nXYAC\n")
    (tmp_path / "note.txt").write_text("not read")
    rows = spark.read.format("fasta_pieces").option("size", size).option("over", over).option("range", span).load(str(tmp_path)).collect()
    got = {}
    for r in sorted((r for r in rows if r.bases), key=lambda r: (r.name, r.start)):
        assert r.start % size == 0 and len(r.bases) <= size + over and r.start == len(got.get(r.name, ""))
        got[r.name] = got.get(r.name, "") + r.bases[:size]
        assert want.get(r.name, "ACGTAC")[r.start : r.start + size + over] == r.bases
    assert got == want | {"odd": "ACGTAC"}
    assert sorted((r.name or "", r.problem) for r in rows if r.problem) == [("", "text before the first header"), ("empty", "no bases"), ("odd", "no bases: 12"), ("odd", "no bases: XY")]


def test_hits_in_a_genome_that_was_read_in_pieces(spark, tmp_path):
    import random

    from helixloom.operators import offtarget
    from helixloom.sources.genomes import FastaPieces

    rng = random.Random(2)
    genome = "".join(rng.choice("ACGT") for _ in range(5000))
    (tmp_path / "host.fasta").write_text(">chr\n" + "\n".join(genome[i : i + 70] for i in range(0, 5000, 70)) + "\n")
    spark.dataSource.register(FastaPieces)
    pieces = spark.read.format("fasta_pieces").option("size", 256).option("range", 900).load(str(tmp_path)).select(F.col("name").alias("host"), "start", "bases")
    turned = genome[1000:1400][::-1].translate(str.maketrans("ACGT", "TGCA"))
    other = lambda x: "ACGT".replace(x, "")[0]
    q = spark.createDataFrame([("a", "TTT" + other(genome[199]) + genome[200:820] + other(genome[820]) + "G"), ("b", turned), ("c", "".join(rng.choice("ACGT") for _ in range(300))), ("d", genome[:1500])], "query string, qseq string")
    hits = {r.query: r for r in offtarget.host_hits(q, pieces, size=256).collect() if r.length > 100}
    assert (hits["a"].gstart, hits["a"].gend, hits["a"].pident) == (201, 820, 100.0) and (hits["b"].gstart, hits["b"].gend, hits["b"].strand) == (1400, 1001, "-")
    assert {r.query: r.longest for r in offtarget.longest_shared(q, pieces, size=256).collect()} == {"a": 620, "b": 400, "c": 0, "d": 1000}


def test_projection_is_written_in_order(spark, tmp_path):
    from helixloom.operators import projection

    rows = spark.createDataFrame([(f"p{i}", "", r, "", "n", "o", "ACGT") for i, r in enumerate(["rbs", "cds", "promoter"] * 20)], ", ".join(f"{c} string" for c in projection.COLUMNS))
    projection.write(rows, str(tmp_path / "set"))
    files_ = sorted((tmp_path / "set/parts").glob("part-*"))
    keys = [tuple(x.split("\t")[i] for i in (2, 0)) for f in files_ for x in f.read_text().splitlines()[1:]]
    assert keys == sorted(keys) and len(keys) == 60


def test_inbox_audits_a_content_once(spark, tmp_path):
    """The same bytes under two names, at once and after a restart."""
    import random

    rng = random.Random(3)
    part = "".join(rng.choice("ACGT") for _ in range(120))
    (tmp_path / "in").mkdir()

    def put(name, seq):
        body = "\n".join(f"{i + 1:9d} {seq[i : i + 60].lower()}" for i in range(0, len(seq), 60))
        (tmp_path / "in" / name).write_text(f'LOCUS       x {len(seq)} bp    DNA     linear   SYN 01-JAN-2026\nFEATURES             Location/Qualifiers\n     promoter        1..120\n                     /label="PART"\nORIGIN\n{body}\n//\n')

    refs = spark.createDataFrame([("PART", part)], "ref string, seq string")
    run = lambda: inbox.audit_inbox(spark, str(tmp_path / "in"), str(tmp_path / "r"), str(tmp_path / "c"), refs, cap=500).awaitTermination()
    put("a.gb", part + "ACGTTGCA" * 4)
    put("b.gb", part + "ACGTTGCA" * 4)
    (tmp_path / "in/bad.png").write_bytes(b"\x89PNG\r\n\x1a\n0000")
    run()
    verdicts = lambda: [Path(r.record).name for r in spark.read.parquet(str(tmp_path / "r/verdicts")).collect()]
    first = verdicts()
    assert len(first) == 1 and first[0] in ("a.gb", "b.gb")
    put("c.gb", part + "ACGTTGCA" * 4)
    put("d.gb", part)
    run()
    assert sorted(verdicts()) == sorted([*first, "d.gb"])
    found = spark.read.parquet(str(tmp_path / "r/findings")).collect()
    assert {(Path(r.record).name, r.status) for r in found if r.category.startswith("no bases")} == {("bad.png", "FAIL")}
    assert {r.status for r in found if r.category == "size"} == {"PASS"} and {r.category for r in found} >= {"host-homology", "composition"}
