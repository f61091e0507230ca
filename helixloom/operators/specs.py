"""Checks of specs before a build, and the verdict of a build's stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.operators.lineage import dealt

BACKBONE = ("ori", "marker")
ROLES = ("promoter", "rbs", "terminator", "cds", "reporter", "gene", *BACKBONE)
# Roles that a template leaves to be filled in.
UNSET = ("set_this", "changeme", "change_me", "todo", "xxx")


def placeholder(*texts: str) -> Column:
    """Whether a template's words are left in any of the columns."""
    found = F.lit(False)
    for t in texts:
        found = found | F.coalesce(F.col(t), F.lit("")).rlike("(?i)PASTE|CHANGE|TODO")
    return found


def exploded(rows: DataFrame, keys: list[str], checks: list[tuple[str, str, Column]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"))) for rule, level, test in checks]))
    return rows.select(*keys, F.explode(found).alias("f")).select(*keys, "f.rule", "f.level")


def part_lint(parts: DataFrame) -> DataFrame:
    """(spec, id, rule, level) of listed parts (spec, id, role, sealed, pin,
    lib, length as text)."""
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    sealed, left = F.coalesce("sealed", F.lit(False)), placeholder("pin", "lib")
    filled, n = sealed & ~left, F.expr("try_cast(length AS int)")
    return exploded(parts, ["spec", "id"], [
        ("no seal", "PROBLEM", ~sealed),
        ("placeholder seal", "PROBLEM", sealed & left),
        ("pin is no fingerprint", "PROBLEM", filled & ~F.trim(F.coalesce("pin", F.lit(""))).rlike("^[0-9a-fA-F]{12}$")),
        ("no length", "PROBLEM", filled & (F.coalesce(n, F.lit(-1)) <= 0)),
        ("no file name", "LOOK", filled & (F.trim(F.coalesce("lib", F.lit(""))) == "")),
        ("no role", "LOOK", role == ""),
        ("placeholder role", "PROBLEM", role.isin(*UNSET)),
        ("unknown role", "PROBLEM", (role != "") & ~role.isin(*UNSET, *ROLES)),
    ])


def order_lint(parts: DataFrame, order: DataFrame, n: int | None = None) -> DataFrame:
    """(spec, id, rule, level) of the order (spec, position, id) against the
    list: ordered but not listed, listed but unused, used again. Both are
    grouped once; ``n`` tells how many rows there are, which else are counted.
    What has no spec or id is never the same as another."""
    own = ~F.lower(F.trim(F.coalesce("role", F.lit("")))).isin(*BACKBONE)
    rows = parts.select("spec", "id", F.lit(True).alias("listed"), own.alias("own")).unionByName(order.select("spec", "id", F.lit(False).alias("listed"), F.lit(False).alias("own")))
    per = dealt(rows, "spec", rows.count() if n is None else n).groupBy("spec", "id").agg(F.bool_or("listed").alias("listed"), F.bool_or("own").alias("own"), F.count_if(~F.col("listed")).alias("n"))
    same = F.col("spec").isNotNull() & F.col("id").isNotNull()
    return exploded(per, ["spec", "id"], [
        ("not listed", "PROBLEM", (F.col("n") > 0) & ~(F.col("listed") & same)), ("never used", "LOOK", F.col("own") & ((F.col("n") == 0) | ~same)), ("used again", "LOOK", F.col("listed") & same & (F.col("n") > 1)),
    ])


def spec_lint(specs: DataFrame, parts: DataFrame) -> DataFrame:
    """(spec, rule, level) of spec heads (spec, host, host_context, backbone);
    a spec without parts has that problem alone."""
    met = specs.join(parts.select("spec", F.lit(True).alias("any")).distinct(), "spec", "left")
    some, blank = F.col("any").isNotNull(), lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return exploded(met, ["spec"], [
        ("no parts", "PROBLEM", ~some), ("no host", "LOOK", some & blank("host")), ("no host context", "LOOK", some & blank("host_context")), ("no backbone", "LOOK", some & blank("backbone")),
    ])


def stage_verdicts(stages: DataFrame, findings: DataFrame, builds: DataFrame) -> DataFrame:
    """Per build: verdict, exit_code, blocked_stage and the checks not run.

    ``stages`` has (build, ordinal, stage, ok), ``findings`` (build, ordinal
    of the stage, category, status). Any SKIP asks for review; a build without
    stages fails.
    """
    s = stages.groupBy("build").agg(F.count("*").alias("n"), F.min(F.when(~F.col("ok"), F.struct("ordinal", "stage"))).alias("refused"))
    named = findings.join(stages.select("build", "ordinal", "stage"), ["build", "ordinal"])
    f = named.groupBy("build").agg(
        F.min(F.when(F.col("status") == "FAIL", F.struct("ordinal", "stage"))).alias("failed"), F.count_if(F.col("status").isin("FLAG", "SKIP")).alias("look"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "SKIP", F.struct("ordinal", "category")))), lambda x: x["category"]), ",").alias("not_run"),
    )
    met = builds.select("build").join(s, "build", "left").join(f, "build", "left")
    verdict = F.when(F.coalesce("n", F.lit(0)) == 0, "FAIL").when(F.col("failed").isNotNull() | F.col("refused").isNotNull(), "FAIL").when(F.col("look") > 0, "REVIEW").otherwise("PASS")
    return met.select(
        "build", verdict.alias("verdict"), F.when(verdict == "FAIL", 1).when(verdict == "REVIEW", 5).otherwise(0).alias("exit_code"), F.coalesce("refused.stage", "failed.stage").alias("blocked_stage"), F.coalesce("not_run", F.lit("")).alias("not_run")
    )
