"""Assembly of constructs from ordered parts, and validation of the result.

Frames: ``lines`` has construct, position, part and its seq and role; ties of
position are broken by part so that results don't depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixloom.functions import sequence as S

CODING = ("cds", "reporter", "gene")
ORDER = ("position", "part")
FRAGMENT_CAP = 5000


def in_construct() -> Window:
    return Window.partitionBy("construct").orderBy(*ORDER)


def features(lines: DataFrame) -> DataFrame:
    """Each line with running start and end, and its neighbours' roles.

    One shuffle by construct; a construct's parts are few.
    """
    w = in_construct()
    end = F.sum(F.length("seq")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    placed = lines.withColumn("end", end).withColumn("start", F.col("end") - F.length("seq") + 1).withColumn("ordinal", F.row_number().over(w))
    return placed.withColumn("next_role", F.lead("role").over(w)).withColumn("next_seq", F.lead("seq").over(w)).withColumn("previous_role", F.lag("role").over(w))


def inserts(lines: DataFrame) -> DataFrame:
    """One row per construct: the ordered insert, its length, the sum of part
    lengths, the junction points between parts, and whether a binding site is
    followed by coding bases without ATG."""
    parts = F.sort_array(F.collect_list(F.struct(*ORDER, "seq", "role")))
    return joined(lines.groupBy("construct").agg(parts.alias("parts")))


def joined(grouped: DataFrame) -> DataFrame:
    """:func:`inserts` of constructs whose ``parts`` are gathered in order;
    other columns stay."""
    kept = [c for c in grouped.columns if c not in ("construct", "parts")]
    lengths = F.transform("parts", lambda p: F.length(p["seq"]))
    ends = F.aggregate(lengths, F.array().cast("array<int>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + n)))
    count = F.aggregate(
        F.transform("parts", lambda p, i: F.coalesce((p["role"] == "rbs") & F.get(F.col("parts"), i + 1)["role"].isin(*CODING) & (F.substring(F.upper(F.get(F.col("parts"), i + 1)["seq"]), 1, 3) != "ATG"), F.lit(False)).cast("int")),
        F.lit(0), lambda a, x: a + x,
    )
    return grouped.select(
        "construct", F.array_join(F.transform("parts", lambda p: p["seq"]), "").alias("insert"), ends.alias("ends"), count.alias("starts_missing"), F.size("parts").alias("n_parts"), *kept,
    ).select(
        "construct", "insert", F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).alias("part_bases"), F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0))).alias("junctions"), "n_parts", "starts_missing", *kept
    )


def crossing(insert: Column, junctions: Column, sites: dict[str, str]) -> Column:
    """Whether some site lies over a junction: only the bases around each
    junction that such a site could take up are looked at."""

    def over(j: Column) -> Column:
        found = F.lit(False)
        for motif in sites.values():
            n = len(motif)
            start = F.greatest(j - n + 1, F.lit(0))
            found = found | S.has_site(F.substr(insert, start + 1, j + n - 1 - start), motif)
        return found

    # most junctions have no site: one pattern over the widest stretch tells that
    wide = max((len(m) for m in sites.values()), default=1)
    any_site = "|".join(sorted({x for m in sites.values() for x in (m, m[::-1].translate(str.maketrans(S.BASES, S.PAIRED)))}))
    around = lambda j: F.substr(insert, F.greatest(j - wide + 1, F.lit(0)) + 1, j + wide - 1 - F.greatest(j - wide + 1, F.lit(0)))

    return F.exists(junctions, lambda j: F.regexp_like(F.upper(around(j)), F.lit(any_site)) & over(j)) if sites else F.lit(False)


def validation(lines: DataFrame, cap: int = FRAGMENT_CAP, low: float = 0.25, high: float = 0.65, run: int = 10) -> DataFrame:
    """A row per finding: construct, rule, level. BLOCK, WARN or INFO."""
    return found_in(inserts(lines), cap, low, high, run).where("rule is not null").select("construct", "rule", "level")


def found_in(whole: DataFrame, cap: int | Column = FRAGMENT_CAP, low: float = 0.25, high: float = 0.65, run: int = 10, sites: dict[str, str] = S.BUILD_SITES) -> DataFrame:
    """The findings of each construct; one row without a rule where there are
    none. All rules read the one row that :func:`inserts` makes of a construct."""
    found = rules_met(cap, low, high, run, sites)
    return whole.select("construct", F.explode_outer(found).alias("f")).select("construct", "f.rule", "f.level")


def rules_met(cap: int | Column, low: float = 0.25, high: float = 0.65, run: int = 10, sites: dict[str, str] = S.BUILD_SITES) -> Column:
    """array<struct(rule, level)> of the rules that a row of :func:`inserts` meets."""
    gc = S.gc_fraction("insert")
    rules = [
        ("empty insert", "BLOCK", F.length("insert") == 0),
        ("site over junction", "BLOCK", crossing(F.col("insert"), F.col("junctions"), sites)),
        ("gc out of range", "WARN", ~gc.between(low, high)),
        ("homopolymer", "WARN", S.has_run("insert", run + 1, any_letter=False)),
        ("over fragment cap", "INFO", F.length("insert") > cap),
    ]
    one = lambda rule, level: F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"))
    found = F.array_compact(F.array(*[F.when(test, one(rule, level)) for rule, level, test in rules]))
    return F.concat(found, F.array_repeat(one("rbs before no start", "WARN"), F.col("starts_missing")))


def build_verdicts(lines: DataFrame, cap: int = FRAGMENT_CAP) -> DataFrame:
    """:func:`verdicts` of every construct by one grouping of its lines."""
    counts = found_in(inserts(lines), cap).groupBy("construct").agg(*[F.count_if(F.col("level") == x).alias(x.lower()) for x in ("BLOCK", "WARN", "INFO")])
    return judged(counts)


def judged(counts: DataFrame) -> DataFrame:
    n = {x: F.coalesce(F.col(x), F.lit(0)) for x in ("block", "warn", "info")}
    verdict = F.when(n["block"] > 0, "FAIL").when(n["warn"] > 0, "REVIEW").otherwise("PASS")
    return counts.select("construct", *[c.alias(k) for k, c in n.items()], verdict.alias("verdict"), F.when(n["block"] > 0, 1).when(n["warn"] > 0, 5).otherwise(0).alias("exit_code"))


def verdicts(constructs: DataFrame, findings: DataFrame) -> DataFrame:
    """Severity roll-up: FAIL for a block, REVIEW for a warning, else PASS."""
    counts = findings.groupBy("construct").agg(*[F.count_if(F.col("level") == x).alias(x.lower()) for x in ("BLOCK", "WARN", "INFO")])
    return judged(constructs.join(counts, "construct", "left"))


def split_points(lines: DataFrame) -> DataFrame:
    """The part boundary nearest the middle, the first of equals."""
    whole = inserts(lines).where(F.size("junctions") > 0)
    half = F.length("insert") / 2
    nearest = F.array_min(F.transform("junctions", lambda b: F.struct(F.abs(b - half).alias("far"), b.alias("at"))))
    return whole.select("construct", nearest["at"].alias("split_at"), F.length("insert").alias("length"))


def fragments(whole: DataFrame, overlap: int = 25) -> DataFrame:
    """Two fragments of (construct, insert, split_at) that share ``overlap``
    bases to each side of the cut."""
    left = F.substr(F.col("insert"), F.lit(1), F.col("split_at") + overlap)
    right = F.substr(F.col("insert"), F.greatest(F.col("split_at") - overlap, F.lit(0)) + 1, F.length("insert"))
    return whole.select("construct", left.alias("left"), right.alias("right"))


def order_table(lines: DataFrame) -> DataFrame:
    """Rows to order: name, role, length, sequence hash, first place in use."""
    return lines.groupBy("construct", "part").agg(
        F.first("role").alias("role"), F.first(F.length("seq")).alias("length_bp"), F.first(F.sha2(F.upper("seq"), 256)).alias("seq_sha256"), F.min("position").alias("first_position"), F.count("*").alias("uses")
    )


def lint(lines: DataFrame) -> DataFrame:
    """Design rules over each construct's ordered roles: construct, rule,
    level (PROBLEM or LOOK), n."""
    w = in_construct()
    coding, whole = F.col("role").isin(*CODING), Window.partitionBy("construct")
    roles = lines.withColumn("i", F.row_number().over(w)).withColumn("before", F.lag("role").over(w)).withColumn("after", F.lead("role").over(w))
    roles = roles.withColumn("copies", F.count("*").over(Window.partitionBy("construct", "part")))
    per = roles.withColumn("last_coding", F.max(F.when(coding, F.col("i"))).over(whole)).groupBy("construct").agg(
        F.count_if((F.col("i") == 1) & (F.col("role") != "promoter")).alias("first part is no promoter"),
        (1 - F.max((F.col("role") == "promoter").cast("int"))).cast("long").alias("no promoter"),
        F.count_if(coding & ~F.col("before").eqNullSafe(F.lit("rbs"))).alias("coding part without rbs"),
        F.when((F.max("last_coding").isNotNull()) & (F.count_if((F.col("role") == "terminator") & (F.col("i") > F.col("last_coding"))) == 0), 1).otherwise(0).cast("long").alias("no terminator after coding"),
        F.count_if((F.col("role") == "rbs") & ~F.coalesce(F.col("after").isin(*CODING), F.lit(False))).alias("rbs without coding part"),
        F.count_if(F.col("copies") > 1).alias("repeated part"),
        F.when((F.count_if(F.col("role") == "promoter") > 1) & (F.count_if(F.col("role") == "terminator") == 0), 1).otherwise(0).cast("long").alias("promoters without terminator"),
    )
    look = {"rbs without coding part", "repeated part", "promoters without terminator"}
    names = [c for c in per.columns if c != "construct"]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.lit("LOOK" if c in look else "PROBLEM").alias("level"), F.col(f"`{c}`").alias("n")) for c in names])).alias("f")
    return per.select("construct", rows).select("construct", "f.rule", "f.level", "f.n").where("n > 0")
