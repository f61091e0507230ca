import io
import random
import zipfile

from pyspark.sql import functions as F

from helixloom.functions import sequence as S
from helixloom.operators import identify, specs
from helixloom.sources import files
from helixloom.sources import specs as readers


def brute_clean(a, b, least):
    m = [x == y for x, y in zip(a, b)]
    for size in range(len(m), least - 1, -1):
        for i in range(len(m) - size + 1):
            if 5 * sum(m[i : i + size]) >= 4 * size:
                return i, i + size, sum(m[i : i + size])
    return None


def test_longest_clean_window(spark):
    rng, rows = random.Random(3), []
    for n in (5, 25, 40, 90):
        for rate in (0.1, 0.3, 0.5):
            a = "".join(rng.choice("ACGT") for _ in range(n))
            rows.append((a, "".join(rng.choice("ACGT") if rng.random() < rate else x for x in a)))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.longest_clean(F.col("a"), F.col("b"), 10).alias("c")).collect()
    assert [tuple(r.c) if r.c else None for r in got] == [brute_clean(r.a, r.b, 10) for r in got]


def test_best_run_by_folds(spark):
    """The run that numpy finds is the one that the column functions find."""
    rng, rows = random.Random(4), []
    for _ in range(150):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 120)))
        rate = rng.choice([0.05, 0.2, 0.35, 0.6, 1.0])
        rows.append((a, "".join(rng.choice("ACGT") if rng.random() < rate else x for x in a)))
    frame = spark.createDataFrame(rows, "a string, b string").withColumn("s", S.best_segment(F.col("a"), F.col("b")))
    whole = F.col("s.end") - F.col("s.start")
    part = lambda x: F.substr(x, F.col("s.start") + 1, whole)
    for r in frame.withColumn("c", S.longest_clean(part("a"), part("b"), identify.LEAST_SPAN)).collect():
        got, size = identify.best_run(r.a, r.b), r.s.end - r.s.start
        low = size >= identify.LEAST_SPAN and 50 * (size + r.s.score) < identify.LEAST_IDENTITY * size
        if not size or low and r.c is None:
            assert got is None
        elif low:
            assert got[:4] == (r.s.start + r.c.start, r.s.start + r.c.end, r.s.matches, r.c.matches)
        else:
            assert got[:4] == (r.s.start, r.s.end, r.s.matches, (size + r.s.score) // 2)
        assert got is None or (len(got[4]), got[4].count("1")) == (got[1] - got[0], got[3])


def test_part_over_the_origin(spark):
    rng = random.Random(5)
    circle = "".join(rng.choice("ACGT") for _ in range(300))
    part = circle[260:] + circle[:30]
    q = identify.around(spark.createDataFrame([("c", circle, True)], "query string, qseq string, circular boolean"), len(part))
    refs = identify.stranded(spark.createDataFrame([("p", part)], "ref string, seq string"))
    long = identify.extended(identify.diagonals(identify.seeds(q, refs)), q.select("query", "qseq"), refs)
    got = identify.unwrapped(identify.merged(identify.best_per_locus(long)), q).collect()
    assert [(r.qstart, r.qend, r.wraps_origin) for r in got] == [(261, 330, True)]


def test_specs_are_read_and_checked(spark):
    good = "id: s\nparts:\n  - {id: a, role: rbs, seal: {seq_sha256_12: 0123456789ab, length: 9, lib: a.gb}}\n  - {id: b, role: wheel}\narchitecture: {order: [a, a, c]}\n"
    read = readers.specs(spark.createDataFrame([("g", good), ("bad", "a: [1"), ("list", "- 1"), ("none", None)], "path string, text string")).cache()
    assert {r.path: r.problem is None for r in read.collect()} == {"g": True, "bad": False, "list": False, "none": False}
    parts, order = readers.spec_parts(read), readers.spec_order(read)
    assert {(r.id, r.rule) for r in specs.part_lint(parts).collect()} == {("b", "no seal"), ("b", "unknown role")}
    assert {(r.id, r.rule) for r in specs.order_lint(parts, order).collect()} == {("c", "not listed"), ("b", "never used"), ("a", "used again")}


def test_sheets(spark):
    book, ns = io.BytesIO(), 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>ACGTACGTAC</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>GGGGCCCC</t></is></c><c><v>7</v></c></row></sheetData></worksheet>')
    got = readers.sheets(spark.createDataFrame([("a", bytearray(book.getvalue())), ("b", bytearray(b"x"))], "path string, content binary")).withColumn("seq", files.loose_sequence(F.col("text"))).collect()
    assert got[0].seq == "ACGTACGTACGGGGCCCC" and got[0].problem is None and got[1].problem
