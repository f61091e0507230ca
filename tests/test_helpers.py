"""Small functions and writers that no query calls."""

import json

import pytest

from helixloom.functions import sequence as S
from helixloom.operators import audit, claims, gates, manifest
from helixloom.sources import files
from pyspark.sql import functions as F


def value(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()[:]


def test_functions(spark):
    assert value(spark, S.iupac_revcomp(F.lit("ACGTRYKMBVDHN")), S.registry_hint(F.lit("from BBa_B0034 (2004)")), S.registry_hint(F.lit("none"))) == ("NDHBVKMRYACGT", "BBa_B0034", None)
    assert value(spark, audit.frame_note(F.lit(-3)), audit.frame_note(F.lit(4))) == ("frame kept", "frame shifted")
    assert value(spark, *[claims.is_accession(F.lit(x)) for x in ("NC_000913.3", "J23100", "BBa_B0034", "AB12")]) == (True, True, False, False)
    assert value(spark, *[gates.as_status(F.lit(x)) for x in ("WARN", "INFO", "BLOCK", "?")]) == ("FLAG", "NOTE", "FAIL", "FAIL")


def test_wording(spark):
    said = lambda *x: tuple(value(spark, gates.wording(*[F.lit(y).cast("string") for y in x]))[0])
    assert said("FAIL", "resolve", "no such part", "") == ("FAIL", "BLOCKED", "no such part (stage: resolve)")
    assert said("FAIL", "", "", "") == ("FAIL", "BLOCKED", "The engine stopped. (stage: ?)")
    assert said("PASS", None, None, "off-target")[:2] == ("REVIEW", "NOT ALL CHECKED") and said("PASS", None, None, "") == ("PASS", "SEALED", "")


def test_manifest_rows(spark, tmp_path):
    names = [*manifest.FIELDS, "row_sha256"]
    rows = [{**{f: f"{f}{i}" for f in manifest.FIELDS}, "id": "a" if i < 3 else "b", "date": ""} for i in range(300)]
    frame = spark.createDataFrame([tuple(r[f] for f in manifest.FIELDS) for r in rows], list(manifest.FIELDS)).select("*", manifest.row_sha256().alias("h")).collect()
    hashes = {r.version: r.h for r in frame}
    order = names[::-1]
    text = "\t".join(order) + "\n" + "\n".join("\t".join({**r, "row_sha256": hashes[r["version"]]}[c] for c in order) for r in rows) + "\n\n"
    (tmp_path / "LOCK.tsv").write_text(text)
    got = files.manifest(spark, str(tmp_path / "LOCK.tsv"))
    assert [(r.ordinal, r.version) for r in got.orderBy("ordinal").collect()] == [(i + 1, f"version{i}") for i in range(300)]
    assert manifest.broken_rows(got, "ordinal").isEmpty()
    spoilt = got.withColumn("row_sha256", F.when(F.col("ordinal") == 1, "").when(F.col("ordinal") == 2, F.substring("row_sha256", 1, 9)).when(F.col("ordinal") == 3, F.reverse("row_sha256")).otherwise(F.col("row_sha256")))
    assert {(r.ordinal, r.problem) for r in manifest.broken_rows(spoilt, "ordinal").collect()} == {(1, "no row hash"), (2, "row hash cut short"), (3, "row hash differs")}
    assert {(r.id, r.ordinal) for r in manifest.first_of(got, "id", "ordinal").collect()} == {("a", 1), ("b", 4)}
    (tmp_path / "short.tsv").write_text("id\tversion\nx\t1\n")
    with pytest.raises(Exception, match="manifest lacks seq_sha256, file_sha256"):
        files.manifest(spark, str(tmp_path / "short.tsv")).collect()
    twice = spark.createDataFrame([("s", "p", "1"), ("s", "p", "2"), ("s", "q", "1"), ("t", "p", "1")], "spec_id string, id string, seq_sha256 string")
    assert [(r.spec_id, r.id, r.n) for r in manifest.contradictions(twice).collect()] == [("s", "p", 2)]


def test_references(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("id\trole\na\trbs\nb\tcds\nc\tcds\n")
    (tmp_path / "r.fasta").write_text(">a first\nacgt\nAC-GT\n>b\nTTTT\n>a again\nGGGG\n>x\nCC\n")
    assert {(r.id, r.role, r.seq) for r in files.references(spark, str(tmp_path / "t.tsv"), str(tmp_path / "r.fasta")).collect()} == {("a", "rbs", "GGGG"), ("b", "cds", "TTTT")}


def test_written_results(spark, tmp_path):
    pieces = spark.createDataFrame([("k", 'a "quoted" name', "insert", "acgt", None)], "construct string, name string, role string, sequence string, note string")
    heads = spark.createDataFrame([("k", 1, "h", None, "by hand, twice")], "construct string, version int, host string, vector string, assembly_method string")
    gates.write_order(gates.order_rows(pieces, heads), str(tmp_path / "order"))
    (file,) = (tmp_path / "order").glob("part-*")
    head, line, end = file.read_bytes().decode().split("\r\n")
    assert head == ",".join(gates.ORDER_COLUMNS) and line.startswith('"a ""quoted"" name",insert,4,ACGT,') and '"by hand, twice"' in line and end == ""
    found = spark.createDataFrame([("k", "z", "NOTE", 3), ("k", "a", "FAIL", 9), ("k", "b", "NOTE", 1)], "construct string, category string, status string, start int")
    both = heads.unionByName(heads.withColumn("construct", F.lit("m")))
    got = {r.construct: json.loads(r.json) for r in gates.result_json(both, found, "construct", ["start"]).collect()}
    assert [f["category"] for f in got["k"]["findings"]] == ["a", "b", "z"] and got["m"]["findings"] == [] and got["m"]["vector"] is None
