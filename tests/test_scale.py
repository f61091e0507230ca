"""That the rows between steps follow the input, not its square."""

from pyspark.sql import functions as F

from helixloom.functions import sequence as S
from helixloom.operators import identify, manifest
from helixloom.plans import record_queries, reference_queries, rule_queries
from test_reference_queries import SF


def most_rows(frame) -> int:
    """The most rows that any operator of the plan, as it ran, put out."""
    frame.collect()
    todo, most = [frame._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def one_id(spark, n: int):
    k = F.col("id")
    sha = F.sha2(k.cast("string"), 256)
    rows = spark.range(n).select(F.lit("same").alias("id"), k.alias("version"), sha.alias("seq_sha256"), F.lit("f").alias("file_sha256"), F.concat(F.lit("lib/"), k.cast("string")).alias("outfile"))
    asked = spark.range(n).select(k.alias("request_id"), F.lit("same").alias("id"), F.when(k % 2 == 0, F.substring(sha, 1, 12)).otherwise("").alias("pin"), F.when(k % 3 == 0, k).alias("version"), F.lit(None).cast("string").alias("lib"))
    return asked, rows


def test_one_id_resolves_without_its_square(spark):
    asked, rows = one_id(spark, 400)
    got = manifest.resolve(asked, rows)
    assert most_rows(got) < 5000  # 53,466 pairs fit id, pin and version
    status = {r.request_id: r.status for r in got.collect()}
    assert all(status[i] == ("ok" if i % 2 == 0 or i % 3 == 0 else "ambiguous") for i in range(400))


def test_one_id_is_selected_from_without_its_square(spark):
    asked, rows = one_id(spark, 400)
    got = manifest.selected(asked, rows)
    assert most_rows(got) < 8000  # 160,000 pairs have the id
    problem = {r.request_id: r.problem for r in got.collect()}
    assert all(problem[i] == (None if i % 2 == 0 or i % 3 == 0 else "ambiguous") for i in range(400))


def test_sizes_read_no_sequence(spark):
    """Counting letters and runs of what is only measured was most of the work."""
    plan = record_queries.vendor_sizes(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "contains(" not in plan.lower()


def test_many_kmers_are_not_gathered_in_the_driver(spark, monkeypatch):
    """From a packed file's size Spark took all k-mers for a small table."""
    monkeypatch.setattr(identify, "BROADCAST_BASES", 0)
    hits = rule_queries.host_rows(spark, SF)._jdf.queryExecution().toString()
    part = rule_queries.parts(spark, SF).select(F.col("part").alias("ref"), "seq")
    refs = identify.stranded(part)
    queries = part.select(F.col("ref").alias("query"), F.col("seq").alias("qseq"))
    blocks = identify.extended(identify.diagonals(identify.seeds(queries, refs)), queries, refs)._jdf.queryExecution().toString()
    for plan in (hits, blocks):
        assert "SortMergeJoin [kmer" in plan and "BroadcastHashJoin [kmer" not in plan
        assert "BroadcastHashJoin [query" not in plan and "BroadcastHashJoin [ref" not in plan and "BroadcastHashJoin [host" not in plan


def test_runs_are_tested_without_taking_sequences_apart(spark):
    rows = [("",), ("ACGT",), ("AAAAAAAAA",), ("AAAAAAAA",), ("cccccccccT",), ("GNNNNNNNNNG",), (None,)]
    frame = spark.createDataFrame(rows, "seq string")
    for any_letter in (True, False):
        got = frame.select(S.has_run("seq", 9, any_letter).alias("a"), (S.longest_run("seq", any_letter) >= 9).alias("b"), S.count_of("seq", "GC").alias("n"), F.regexp_count("seq", F.lit("[GC]")).alias("m")).collect()
        assert [r.a for r in got] == [r.b for r in got] and [r.n for r in got] == [r.m for r in got]
    for name in ("record_audit", "construct_verdicts"):
        plan = reference_queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and "translate(insert" not in plan and "translate(upper" not in plan
