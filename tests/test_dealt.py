"""Queries whose tasks, shuffles or expressions grew faster than their rows."""

import re

import pytest
from pyspark.sql import functions as F

from helixloom.operators import build, gates, lineage, specs
from helixloom.plans import export_queries, gate_queries, record_queries, reference_queries, rule_queries
from test_reference_queries import SF


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [reference_queries.block_claims, reference_queries.design_lint, rule_queries.order_lint, export_queries.rebuilt_specs, export_queries.flat_file_texts, export_queries.design_statements, gate_queries.build_findings, record_queries.build_plan, record_queries.build_plan_findings])
def test_rows_are_dealt_by_their_number(spark, monkeypatch, query):
    monkeypatch.setattr(lineage, "TASK_ROWS", 500)
    assert int(max(re.findall(r", (\d+)\), REPARTITION_BY_NUM", plan_of(query(spark, SF))), key=int)) >= 12


def test_a_part_is_trimmed_once_and_a_construct_grouped_once(spark):
    found = plan_of(record_queries.build_plan(spark, SF))
    assert found.count("collect_list") <= 4 and "SortMergeJoin" in found
    order = spark.createDataFrame([(1, 1, 7), (1, 2, 7), (2, 1, 8), (3, 1, 9), (9, 1, 7)], "construct int, position int, part int")
    parts = spark.createDataFrame([(7, "ACGTAC", 6, "cds"), (8, "ACGT", 4, "cds")], "part int, seq string, length int, role string")
    trims = spark.createDataFrame([(7, "AC", "A"), (8, "GG", None)], "part int, three_prime string, five_prime string")
    heads = spark.createDataFrame([(1, [], 3), (2, [], 3), (3, [], 3), (4, [], 3)], "construct int, sites array<string>, cap int")
    got, verdicts = build.planned(order, parts, trims, heads, n=5)
    assert {tuple(x) for x in got.collect()} == {(1, "over fragment cap", "INFO", None), (1, "gc out of range", "WARN", None), (2, "trim not found", "BLOCK", "8"), (3, "part not listed", "BLOCK", "9"), (4, "no order", "BLOCK", None)}
    assert {(x.construct, x.block, x.info, x.verdict, x.insert_sha256 is not None) for x in verdicts.collect()} == {(1, 0, 1, "REVIEW", True), (2, 1, 0, "FAIL", False), (3, 1, 0, "FAIL", False), (4, 1, 0, "FAIL", False)}
    assert {(x.position, x.cut, x.expected) for x in gates.ordered_parts(order, parts, trims).where("construct = 1").collect()} == {(1, "CGT", 3), (2, "CGT", 3)}


def test_statements_of_a_construct_come_from_one_grouping(spark):
    assert "Window [" not in plan_of(export_queries.design_statements(spark, SF))


def test_orders_without_names_are_listed_nowhere(spark):
    parts = spark.createDataFrame([(1, "a", "cds"), (1, None, "cds"), (1, "b", "ori"), (1, "c", None)], "spec int, id string, role string")
    order = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, "x")], "spec int, id string")
    got = specs.order_lint(parts, order)
    assert sorted(map(str, [(x.id, x.rule) for x in got.collect()])) == sorted(map(str, [("a", "used again"), (None, "not listed"), (None, "never used"), ("x", "not listed"), ("c", "never used")]))
    assert plan_of(got.where(F.lit(True))).count("Join") == 0
