"""Libraries that grow and results that are published whole."""

import threading

import pytest

from helixloom.operators.library import Library
from helixloom.sources import stores
from pyspark.sql import functions as F

NEW = "request long, id string, seq string, source string, class string, expect_length int"


def parts(spark, *rows):
    return spark.createDataFrame([(i, name, seq, "made up", "designed", len(seq) if n is None else n) for i, name, seq, n in rows], NEW)


def test_append_and_load(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    got = {r.request: (r.version, r.problem) for r in lib.append(parts(spark, (1, "a", "ACGT" * 10, None), (2, "a", "GGCC" * 10, None), (3, "b/c", "TTAA" * 9, None), (4, "d", "ACGX", None), (5, "e", "ACGT", 9), (6, "f", "", None)), "2026-01-02").collect()}
    assert got == {1: (1, None), 2: (2, None), 3: (1, None), 4: (None, "letters that are no bases"), 5: (None, "length differs"), 6: (None, "no bases")}
    assert {r.version for r in lib.append(parts(spark, (1, "a", "CCCC" * 10, None)), "2026-01-03").collect()} == {3}
    loaded, problems = lib.loaded()
    assert sorted((r.id, r.version, r.seq) for r in loaded.collect()) == [("a", "1", "ACGT" * 10), ("a", "2", "GGCC" * 10), ("a", "3", "CCCC" * 10), ("b/c", "1", "TTAA" * 9)] and problems.isEmpty()
    assert [r.ordinal for r in lib.rows().orderBy("ordinal").collect()] == [1, 2, 3, 4] and lib.version() == 2
    assert lib.rows(1).count() == 3 and len({r.path for r in lib.texts().collect()}) == 4
    text = next(r.content for r in lib.texts().collect() if r.seq == "CCCC" * 10)
    assert text.startswith("LOCUS       a 40 bp") and "03-JAN-2026" in text


def test_two_writers_both_land(spark, tmp_path):
    lib, done, failed = Library(spark, str(tmp_path / "lib")), [], []

    def write(i):
        try:
            done.extend(lib.append(parts(spark, (i, "a", "ACGT" * (5 + i), None)), "2026-01-02").collect())
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and sorted(r.version for r in done) == [1, 2, 3] and lib.version() == 3
    assert lib.loaded()[0].count() == 3 and not [n for n in stores.names(spark, lib.folder) if n.startswith(".")]


def test_a_spoilt_library_gives_and_takes_nothing(spark, tmp_path):
    lib = Library(spark, str(tmp_path / "lib"))
    lib.append(parts(spark, (1, "a", "ACGT" * 10, None), (2, "b", "GGCC" * 10, None)), "2026-01-02")
    (file,) = (tmp_path / "lib/v1/manifest").glob("part-*.txt")
    whole = file.read_text()
    for f in (tmp_path / "lib/v1/manifest").glob(".*.crc"):
        f.unlink()
    file.write_text(whole.splitlines()[0] + "\n")  # a lost row
    parts_, problems = lib.loaded()
    assert parts_.isEmpty() and [(r.id, r.problem) for r in problems.collect()] == [(None, "root differs")]
    assert [r.problem for r in lib.append(parts(spark, (3, "c", "ACGT", None)), "2026-01-02").collect()] == ["library does not verify"] and lib.version() == 1
    file.write_text(whole)
    assert lib.loaded("0" * 64)[1].first().problem == "pin differs" and lib.loaded(lib.root())[1].isEmpty()


@pytest.mark.parametrize("step", range(1, 7))
def test_publication_is_whole_or_not_at_all(spark, tmp_path, monkeypatch, step):
    """Whichever step fails, the old set stands; without a failure the new one."""
    folder = str(tmp_path / "out")
    rows = lambda n: spark.range(n).select(F.col("id").cast("string").alias("value"))
    writers = lambda n: {"a.fasta": rows(n).write.text, "b.csv": rows(n).write.csv, "c.json": rows(n).write.json}
    stores.publish(spark, folder, writers(2))
    calls = [0]
    real = stores.move

    def fails(*args):
        calls[0] += 1
        if calls[0] == step:
            raise OSError("lost")
        real(*args)

    monkeypatch.setattr(stores, "move", fails)
    with pytest.raises(OSError):
        stores.publish(spark, folder, writers(5))
    monkeypatch.setattr(stores, "move", real)
    count = lambda: (spark.read.text(f"{folder}/a.fasta").count(), spark.read.csv(f"{folder}/b.csv").count(), spark.read.json(f"{folder}/c.json").count())
    assert count() == (2, 2, 2) and sorted(stores.names(spark, folder)) == ["a.fasta", "b.csv", "c.json"]
    stores.publish(spark, folder, writers(5))
    assert count() == (5, 5, 5)


def test_publication_refuses_before_it_moves(spark, tmp_path):
    folder = str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    (tmp_path / "out/b").write_text("of someone else")
    with pytest.raises(FileExistsError):
        stores.publish(spark, folder, {"a": spark.range(1).write.json, "b": spark.range(1).write.json})

    def broken(path):
        raise ValueError("no")

    with pytest.raises(ValueError):
        stores.publish(spark, folder, {"a": spark.range(1).write.json, "c": broken})
    assert stores.names(spark, folder) == ["b"] and (tmp_path / "out/b").read_text() == "of someone else"
