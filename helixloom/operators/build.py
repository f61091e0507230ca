"""A forward build in one plan: what was listed, cut, joined and forbidden.

Every step is a column expression or one aggregate by construct. A construct
stops at the first step that blocks it; what could not be checked is a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.functions import sequence as S
from helixloom.operators import assembly, gates
from helixloom.operators.lineage import dealt

#: All enzymes that a spec may name; callers may give more, with IUPAC letters.
ENZYMES = S.BUILD_SITES | S.TYPE_IIS_SITES | S.SIX_CUTTERS
# The bases that each letter stands for.
LETTERS = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def site_pattern(motif: str) -> str:
    """A regular expression of a recognition site."""
    return "".join(f"[{LETTERS[c]}]" if c in LETTERS else c for c in motif)


def turned(motif: str) -> str:
    return motif[::-1].translate(str.maketrans(S.IUPAC, S.IUPAC_PAIRED))


def site_hits(seq: Column | str, motif: str) -> Column:
    """array<struct(start, strand)>, 0-based, of a site on each strand; one
    that reads the same both ways is there twice."""
    place = lambda m, strand: F.transform(S.positions(seq, site_pattern(m)), lambda x: F.struct(x.alias("start"), F.lit(strand).alias("strand")))
    return F.concat(place(motif, 1), place(turned(motif), -1))


def sites_over(insert: Column, junctions: Column, names: Column, enzymes: dict[str, str]) -> tuple[Column, Column]:
    """Of a construct's own list of enzymes those with a site over a junction
    on either strand, and those that nobody knows. Only the bases around each
    junction that a site could take up are read, by one alternation of both
    strands; the table is configuration and goes with the expression."""
    rows = F.create_map(*[x for name, m in sorted(enzymes.items()) for x in (F.lit(name), F.struct(F.lit(f"{site_pattern(m)}|{site_pattern(turned(m))}").alias("re"), F.lit(len(m)).alias("n")))])
    asked = F.array_distinct(F.coalesce(names, F.array().cast("array<string>")))
    known = F.map_keys(rows)

    def crosses(site: Column, j: Column) -> Column:
        start = F.greatest(j - site["n"] + 1, F.lit(0))
        return F.regexp_like(F.substr(insert, start + 1, j + site["n"] - 1 - start), site["re"])

    over = F.filter(F.filter(asked, lambda e: F.array_contains(known, e)), lambda e: F.exists(junctions, lambda j: crosses(F.element_at(rows, e), j)))
    return over, F.filter(asked, lambda e: ~F.array_contains(known, e))


def site_findings(inserts: DataFrame, forbidden: DataFrame, enzymes: dict[str, str] | None = None) -> DataFrame:
    """(construct, rule, level, part) of inserts (construct, insert, junctions)
    against each construct's list (construct, sites): BLOCK where a site lies
    over a junction, SKIP for a name without a known site."""
    met = inserts.select("construct", "insert", "junctions").join(forbidden.select("construct", "sites"), "construct")
    return met.select("construct", F.explode(sites_met(enzymes)).alias("f")).select("construct", "f.*")


def sites_met(enzymes: dict[str, str] | None) -> Column:
    """:func:`site_findings` as an array of a row's."""
    over, unknown = sites_over(F.upper("insert"), F.col("junctions"), F.col("sites"), ENZYMES if enzymes is None else enzymes)
    said = lambda names, rule, level: F.transform(names, lambda e: F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), e.alias("part")))
    return F.concat(said(over, "site over junction", "BLOCK"), said(unknown, "site not known", "SKIP"))


def planned(order: DataFrame, parts: DataFrame, trims: DataFrame, heads: DataFrame, enzymes: dict[str, str] | None = None, n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings (construct, rule, level, part) and one verdict row for each of
    ``heads`` (construct, sites, cap). ``n`` tells how many rows ``order`` has.

    ``order`` has construct, position, part; ``parts`` part, seq, length, role;
    ``trims`` part, three_prime, five_prime. A part that isn't listed, a trim
    that isn't there, or a construct without an order blocks before anything
    is assembled; the rest are joined and checked as wholes."""
    cuts = gates.ordered_parts(order, parts, trims)
    cuts = cuts if n is None else dealt(cuts, "construct", n)
    rows = F.sort_array(F.collect_list(F.struct("position", "part", "listed", "cut", "expected", "role")))
    per = cuts.groupBy("construct").agg(rows.alias("p"), *gates.order_sums())
    # what is not listed or not cut stops a construct, and nothing of it is joined
    sound = F.transform(F.filter("p", lambda x: x["cut"].isNotNull()), lambda x: F.struct(x["position"].alias("position"), x["part"].alias("part"), x["cut"].alias("seq"), x["role"].alias("role")))
    whole = assembly.joined(per.withColumn("parts", sound)).join(heads.select("construct", "sites", "cap", F.lit(True).alias("head")), "construct", "full")
    row = "struct<rule:string,level:string,part:string>"
    none, made = F.array().cast(f"array<{row}>"), F.col("head") & F.col("all") & F.col("cuts")
    checked = F.transform(F.filter(assembly.rules_met(F.col("cap"), sites={}), lambda x: x["rule"] != "empty insert"), lambda x: F.struct(x["rule"].alias("rule"), x["level"].alias("level"), F.lit(None).cast("string").alias("part")))
    empty = F.array(F.struct(F.lit("no order").alias("rule"), F.lit("BLOCK").alias("level"), F.lit(None).cast("string").alias("part")))
    said = F.when(F.col("p").isNull(), empty).otherwise(F.concat(gates.order_findings(), F.when(made, F.concat(checked, sites_met(enzymes))).otherwise(none)))
    met = whole.withColumn("insert", F.coalesce("insert", F.lit(""))).select("construct", "head", F.when(made, F.sha2("insert", 256)).alias("insert_sha256"), said.cast(f"array<{row}>").alias("f"))
    found = met.select("construct", F.explode("f").alias("f")).select("construct", "f.*")
    levels = {x.lower(): F.size(F.filter("f", lambda y: y["level"] == x)).cast("long") for x in ("BLOCK", "WARN", "INFO", "SKIP")}  # noqa: B023
    counts = met.where("head").select("construct", "insert_sha256", *[c.alias(x) for x, c in levels.items()])
    # a check that could not be made asks for review
    verdict = F.when(F.col("block") > 0, "FAIL").when((F.col("warn") > 0) | (F.col("skip") > 0), "REVIEW").otherwise("PASS")
    return found, counts.select("construct", *levels, verdict.alias("verdict"), F.when(verdict != "FAIL", F.col("insert_sha256")).alias("insert_sha256"))
