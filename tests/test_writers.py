"""What is written reads back: flat files, specs, fragments, statements."""

from pathlib import Path

import pytest

from helixloom.operators import library, manifest
from helixloom.sources import files, specs, writers
from pyspark.sql import functions as F


def test_flat_files_read_back(spark):
    heads = spark.createDataFrame([("c", 2, "ACGTTGCAAC" * 13, None, "v", "o", "m"), ("d", 1, "ACGT", "by hand", None, None, None)], "construct string, version int, insert string, method string, vector string, ori string, marker string")
    heads = heads.withColumn("day", F.lit("2026-01-02").cast("date"))
    placed = spark.createDataFrame([("c", 61, 130, "b", "reporter", "two\nlines", -1), ("c", 1, 60, "a", "rbs", None, 1), ("c", 1, 9, "z", "none such", "", 1)], "construct string, start int, end int, id string, role string, note string, strand int")
    text = writers.flat_files(heads, placed)
    as_file = text.select(F.col("name").alias("path"), F.encode("text", "UTF-8").alias("content"), "text")
    good, bad = files.records(as_file)
    assert bad.isEmpty() and {(r.path, r.name, r.seq) for r in good.collect()} == {("c_insert", "c_insert", "ACGTTGCAAC" * 13), ("d_insert", "d_insert", "ACGT")}
    got = files.claims(as_file).orderBy("path", "n").collect()
    assert [(r.kind, r.role, r.start, r.end, r.strand, r.label) for r in got] == [("misc_feature", "misc", 1, 9, 1, "z"), ("RBS", "rbs", 1, 60, 1, "a"), ("CDS", "cds", 61, 130, -1, "b")]
    c, d = (r.text for r in text.orderBy("construct").collect())
    assert "Backbone: v (o/m)" in c and '/note="two lines"' in c and "single-fragment" in c and "Backbone" not in d and "by hand (4 bp)" in d and "02-JAN-2026" in d


def test_notes(spark):
    a = lambda **x: F.create_map(*[F.lit(y) for kv in x.items() for y in kv])
    rows = spark.range(1).select(
        writers.part_note(F.lit("p"), F.lit("lib/p.gb"), a(registry="iGEM", part="BBa_B0034")), writers.part_note(F.lit("p"), F.lit(None).cast("string"), a(db="NCBI", accession="NC_000913.3")), writers.part_note(F.lit("p"), F.lit("l"), F.lit(None).cast("map<string,string>")),
        writers.trim_note(F.lit("TA"), F.lit("ATG")), writers.trim_note(F.lit(""), F.lit(None).cast("string")),
    ).first()
    assert rows[:] == ("p lib/p.gb; iGEM BBa_B0034", "p ; NCBI NC_000913.3:()", "p l", "; trimmed 3' 2 nt (TA); trimmed 5' 3 nt (ATG)", "")


def test_fragments(spark):
    rows = [("c", i, i, x, "cds") for i, x in enumerate(["A" * 90, "C" * 100, "G" * 50])] + [("short", 0, 1, "ACGT", "cds"), ("whole", 0, 1, "T" * 300, "cds")]
    got = {r.name: r for r in writers.fragment_files(spark.createDataFrame(rows, "construct string, position int, part int, seq string, role string"), 200, 10).collect()}
    assert set(got) == {"c_FRAG-A", "c_FRAG-B"}
    seq = "A" * 90 + "C" * 100 + "G" * 50
    for name, start, end in (("c_FRAG-A", 1, 100), ("c_FRAG-B", 81, 240)):
        head, *body = got[name].text.rstrip("\n").split("\n")
        assert (got[name].start, got[name].end) == (start, end) and head == f">{name} {end - start + 1}bp pos {start}-{end} overlap=10"
        assert "".join(body) == seq[start - 1 : end] and all(len(x) == 80 for x in body[:-1])


def test_specs_read_back(spark):
    yaml = pytest.importorskip("yaml")
    blocks = spark.createDataFrame(
        [("r:1", 5, 9, "J23100", "BBa_J23100", "promoter", "BBa_j23100", None), ("r:1", 20, 40, None, None, None, "x", "rbs"), ("r:1", 41, 60, 'odd "id": #1', "", None, "other", "cds")],
        "record string, start int, end int, ident string, registry string, ident_role string, claim string, claim_role string",
    )
    heads = spark.createDataFrame([("r:1", "circular", "E. coli", "Twist"), ("none", None, "yes", "IDT")], "record string, topology string, host string, vendor string")
    text = {r.record: r.text for r in writers.draft_specs(blocks, heads).collect()}
    got = yaml.safe_load(text["r:1"])
    assert got["id"] == "r:1-recovered" and got["host"] == "E. coli" and got["architecture"] == {"order": ["J23100", "UNRESOLVED_20_40", 'odd "id": #1'], "topology": "circular"}
    assert [(p["id"], p["role"], p["class"]) for p in got["parts"]] == [("J23100", "promoter", "reference"), ("UNRESOLVED_20_40", "rbs", "unresolved"), ('odd "id": #1', "cds", "reference")]
    assert got["parts"][0]["source"] == {"registry": "iGEM", "part": "BBa_J23100"} and text["r:1"].count("the record says") == 1
    assert yaml.safe_load(text["none"])["parts"] is None and yaml.safe_load(text["none"])["host"] == "yes"
    asked = [(r.id, r["class"], r.primary_source) for r in writers.intake_requests(blocks).orderBy("start").collect()]
    assert asked == [("J23100", "reference", "BBa_J23100"), ("UNRESOLVED_20_40", "unresolved", None), ('odd "id": #1', "reference", "")]
    plan = spark.createDataFrame([("r", 2, "b", "cds"), ("r", 1, "a", "rbs"), ("r", 3, "gone", "cds"), ("s", 1, "gone", "cds")], "record string, ordinal int, id string, role string")
    rows = spark.createDataFrame([(1, "a", 1, "0" * 64, 4, "p/a"), (9, "a", 2, "1" * 12 + "f" * 52, 5, "p/a: 2"), (2, "b", 1, "2e4" * 21 + "0", 6, "p/b")], "ordinal int, id string, version int, seq_sha256 string, length int, outfile string")
    built = {r.record: r for r in writers.rebuilt_specs(plan, rows, heads.select(F.lit("r").alias("record"), "host", "vendor").limit(1).unionByName(heads.select(F.lit("s").alias("record"), "host", "vendor").limit(1))).collect()}
    assert (built["r"].parts, built["r"].left_out, built["s"].parts, built["s"].left_out) == (2, 1, 0, 1)
    files_ = spark.createDataFrame([(r.record, r.text) for r in built.values()], "path string, text string")
    back = specs.specs(files_)
    assert back.where("problem is not null").isEmpty()
    seals = {r.id: (r.spec, r.role, r.sealed, r.pin, r.lib, r.length) for r in specs.spec_parts(back).collect()}
    assert seals == {"a": ("r-rebuilt", "rbs", True, "1" * 12, "p/a: 2", "5"), "b": ("r-rebuilt", "cds", True, "2e4" * 4, "p/b", "6")}
    assert [r.id for r in specs.spec_order(back).orderBy("position").collect()] == ["a", "b"]


def test_statements(spark):
    lines = spark.createDataFrame([("c", 1, 1, "ACGT", "rbs"), ("c", 2, 2, "TTTT", "cds"), ("c", 3, 1, "ACGT", "rbs")], "construct string, position int, part int, seq string, role string")
    parts = spark.createDataFrame([(1, "1-a", "acgt", "RBS", {"registry": "iGEM", "part": "BBa_X"}, None), (2, 'q"\\', "TTTT", "odd", None, "tool 1"), (3, "unused", "A", "cds", None, None)], "part int, id string, seq string, role string, source map<string,string>, tool string")
    got = [r.value for r in writers.design_statements(lines, parts, "urn:x").collect()]
    assert len(got) == len(set(got)) and all(x.startswith("<") and x.endswith(" .") and "\n" not in x for x in got)
    triples = {tuple(x[:-2].split(" ", 2)) for x in got}
    one = lambda s, p: [o for a, b, o in triples if a == f"<urn:x/{s}>" and b == f"<{p}>"]
    s = writers.SBOL
    assert one("_1_a", f"{writers.PROV}wasDerivedFrom") == ["<https://parts.igem.org/Part:BBa_X>"] and one("_1_a_sequence", f"{s}elements") == ['"ACGT"']
    assert one("q__", f"{writers.PROV}wasGeneratedBy") == ["<urn:x/q___design>"] and one("q__", f"{s}name") == ['"q\\"\\\\"'] and one("agent_tool_1", f"{s}name") == ['"tool 1"']
    assert sorted(one("c_insert", f"{s}hasFeature")) == [f"<urn:x/c_insert/SubComponent{i}>" for i in (1, 2, 3)] and len(one("c_insert", f"{s}hasConstraint")) == 2
    assert one("c_insert/SubComponent3/Range1", f"{s}start") == ['"9"'] and one("c_insert/Constraint2", f"{s}object") == ["<urn:x/c_insert/SubComponent3>"]
    assert not any("unused" in x for x in got) and one("_1_a", f"{s}role") == ["<https://identifiers.org/SO:0000139>"] and one("q__", f"{s}role") == ["<https://identifiers.org/SO:0000804>"]


def test_copied(spark):
    sha = lambda x: F.sha2(F.lit(x), 256)
    rows = spark.createDataFrame([(1, "a", "f1", "s", "designed"), (2, "a", "f2", None, None), (3, "b", "f3", "s", "reference"), (4, "c", "f4", "s", "reference")], "ordinal int, id string, outfile string, source string, class string").withColumn("seq_sha256", F.when(F.col("id") == "c", None).otherwise(sha("ACGT")))
    texts = spark.createDataFrame([("f1", "TTTT"), ("f2", "ac gt"), ("f4", "ACGT")], "path string, seq string")
    want = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("d",)], "id string")
    got = {r.id: (r.seq, r.source, r["class"], r.problem) for r in library.copied(rows, texts, want, "lib").collect()}
    assert got == {"a": ("ACGT", " [copied from lib]", "reference", None), "b": (None, None, None, "file missing"), "c": (None, None, None, "bases differ from their row"), "d": (None, None, None, "not in the library")}


def test_loose_texts_and_proteins(spark, tmp_path):
    (tmp_path / "bare.txt").write_text("acg tac\ngta\ncgt acg\n")
    (tmp_path / "cells.csv").write_text("name,bases\nx,ACGUACGUAC\ny,acgtac-gtacg\n")
    (tmp_path / "prose.txt").write_text("nothing that could be bases, at all")
    good, bad = files.records(files.flat_files(spark, str(tmp_path)))
    got = {Path(r.path).name: (r.seq, r.assembled_from) for r in good.collect()}
    assert got == {"bare.txt": ("ACGTACGTACGTACG", None), "cells.csv": ("ACGUACGUACACGTACGTACG", [10, 11])} and [Path(r.path).name for r in bad.collect()] == ["prose.txt"]
    rows = spark.createDataFrame([("a.faa", ">p some\nMKV*\nLL\n"), ("b.gb", "LOCUS x\nORIGIN\n 1 acgt\n//\n"), ("c.fasta", ">x\nacgt\n")], "path string, text string")
    assert {(r.path, r.seq, r.kind) for r in files.part_sequences(rows).collect()} == {("a.faa", "MKV*LL", "protein"), ("b.gb", "ACGT", "dna"), ("c.fasta", "ACGT", "dna")}


def test_specs_by_host(spark):
    rows = [("s/b.yaml", "id: x\nhost: 'E. coli'  # the usual\nhost: other\n"), ("s/a.yaml", "  host: E. coli\n- : ["), ("s/c.yaml", "id: y\nhostile: 1\n"), ("s/d.yaml", "host:   # none\n"), ("s/e.yaml", 'host: "P. putida"\n')]
    got = {r.host: r.specs for r in specs.specs_by_host(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"E. coli": ["a.yaml", "b.yaml"], "P. putida": ["e.yaml"]}


def test_selected_and_verified(spark):
    a, b = "a" * 64, "b" * 64
    rows = [("p", "1", a, "f", f"l/p__v1__{a[:12]}.gb"), ("p", "2", b, None, f"l/p__v2__{b[:12]}.gb"), ("q", "one", a, "f", "l/q.gb"), ("r", "1", a, "f", f"l/r__v1__{b[:12]}.gb"), ("s", "1", a.upper(), "f", "s.gb"), (None, "1", a, "f", "n.gb")]
    listed = spark.createDataFrame(rows, "id string, version string, seq_sha256 string, file_sha256 string, outfile string")
    asked = [
        (1, "p", None, None, None), (2, "p", "AAAA", None, None), (3, "p", "", "2", None), (4, "p", "aaaa", "2", None), (5, "p", None, "9", None), (6, "p", None, None, f"x/p__v2__{b[:12]}.gb"), (7, "p", "bb", None, "x/old.gb"),
        (8, "q", None, None, None), (9, "r", None, None, None), (10, "s", "aaa", None, None), (11, "none", None, None, "x"), (12, None, None, None, None), (13, "p", "a", None, f"p__v2__{b[:12]}.gb"),
    ]
    requests = spark.createDataFrame(asked, "request_id int, id string, pin string, version string, lib string")
    got = {r.request_id: (r.problem, r.version, r.note is not None) for r in manifest.selected(requests, listed).collect()}
    assert got == {
        1: ("ambiguous", None, False), 2: (None, "1", False), 3: (None, "2", False), 4: ("no version has the pin", None, False), 5: ("no such version", None, False), 6: (None, "2", False), 7: (None, "2", True),
        8: ("version is no number", None, False), 9: ("name differs from the hash", None, False), 10: (None, "1", False), 11: ("no such part", None, False), 12: ("no such part", None, False), 13: ("no version has the pin", None, False),
    }
    assert {r.problem for r in manifest.selected(requests, listed, need_version=True).where("request_id in (1, 2, 8)").collect()} == {"no version given"}
    sha = lambda x: F.sha2(F.lit(x), 256)
    chosen = spark.createDataFrame([(1, "f1", "h", 4), (2, "f2", "h", 4), (3, "f3", "h", 4), (4, "f4", "", 5), (5, "gone", "h", 4), (6, "f1", None, None)], "request_id int, outfile string, file_sha256 string, expect_length int").withColumn("seq_sha256", F.upper(sha("ACGT")))
    there = spark.createDataFrame([("f1", "acgt", "h"), ("f2", "TTTT", "h"), ("f3", "ACGT", "i"), ("f4", "ACGT", "i")], "path string, seq string, file_sha256 string")
    assert {r.request_id: r.problem for r in manifest.verified(chosen, there).collect()} == {1: None, 2: "bases differ from their row", 3: "bytes differ from their row", 4: "length differs from the spec", 5: "file missing", 6: None}
