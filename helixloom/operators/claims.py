"""What a label claims beside what was found, and beside a registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixloom.functions import sequence as S

LEAST_PART, MISSING_SHARE = 12, 0.05
#: So few references go to where the blocks are, many of which may claim the same one.
FEW_REFS = 1000


def plain(name: Column | str) -> Column:
    """A part's name in upper case without its registry prefix."""
    return F.upper(F.replace(S.col(name), F.lit("BBa_"), F.lit("")))


def wrong_name(claim: Column | str, ident: Column | str) -> Column:
    """Whether a label neither is nor contains the name that was found."""
    return (plain(claim) != plain(ident)) & ~F.contains(plain(claim), plain(ident))


def oriented(seq: Column, strand: Column) -> Column:
    return F.when(strand < 0, S.revcomp(F.upper(seq))).otherwise(F.upper(seq))


def claim_findings(blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """(record, block, category, status) for identified and labelled blocks
    (record, block, claim, claim_strand, ident, strand, alternatives, seq).

    A label among the names of the same bases is right; if the bases lie in
    the claimed reference (ref, seq) they are a piece of it, and cut short if
    over a twentieth lacks; any other label is wrong unless it contains the
    name found. Of references with one plain name the first by id counts.
    """
    named = refs.groupBy(plain("ref").alias("claim_key")).agg(F.min_by(S.normalise("seq"), "ref").alias("claim_seq"))
    named = F.broadcast(named) if refs.limit(FEW_REFS + 1).count() <= FEW_REFS else named
    b = blocks.where("claim is not null and ident is not null").withColumn("claim_key", plain("claim")).join(named, "claim_key", "left")
    ident, bases = plain("ident"), oriented(S.normalise("seq"), F.col("strand"))
    synonym = F.coalesce(F.array_contains(F.transform(F.coalesce("alternatives", F.array().cast("array<string>")), plain), F.col("claim_key")), F.lit(False))
    wrong_way = F.col("claim_strand") != F.col("strand")
    piece = F.coalesce((F.col("claim_key") != ident) & (F.length(bases) >= LEAST_PART) & F.contains(F.col("claim_seq"), bases), F.lit(False))
    short = F.length("claim_seq") - F.length(bases) > MISSING_SHARE * F.length("claim_seq")
    row = lambda test, category, status: F.when(test, F.struct(F.lit(category).alias("category"), F.lit(status).alias("status")))
    found = F.array(
        row(wrong_way, "identity-orientation", "FLAG"), row(synonym & ~wrong_way, "identity-synonym", "NOTE"), row(~synonym & piece, "identity-subpart", "NOTE"),
        row(~synonym & piece & short, "truncation", "FLAG"), row(~synonym & ~piece & wrong_name("claim", "ident"), "identity-mislabel", "FLAG"),
    )
    return b.select("record", "block", F.explode(F.array_compact(found)).alias("f")).select("record", "block", "f.*")


def registry_findings(blocks: DataFrame, registry: DataFrame) -> DataFrame:
    """(record, block, status, reason) of blocks whose label is a registry
    name, against lookups (name, state, seq) with state found, absent or
    unreachable; nothing is said after a record's first unreachable one."""
    label = F.trim("claim")
    asked = blocks.where(label.rlike(r"^BBa[_\-][A-Za-z0-9]+$")).withColumn("name", F.replace(label, F.lit("-"), F.lit("_")))
    met = asked.join(registry.select("name", "state", S.normalise("seq").alias("there")), "name", "left").withColumn("state", F.coalesce("state", F.lit("absent")))
    met = met.withColumn("first", F.min(F.when(F.col("state") == "unreachable", F.col("block"))).over(Window.partitionBy("record"))).where("first is null or block <= first")
    here, there = oriented(S.normalise("seq"), F.col("strand")), F.col("there")
    reason = F.when(F.col("state") != "found", F.col("state")).when(here == there, "confirmed").when((here != "") & F.contains(there, here), "truncated").when((there != "") & F.contains(here, there), "extended").otherwise("differs")
    return met.select("record", "block", F.when(reason == "confirmed", "PASS").otherwise("FLAG").alias("status"), reason.alias("reason"))


# Words that tell a part's role, first family first.
ROLE_WORDS = {
    "rbs": ("rbs_", "_rbs", "ribosome binding", "5'utr", "5utr"),
    "promoter": ("promoter", "p_hrpl", "pyear", "j231"),
    "terminator": ("terminator", "l3s", "eck120"),
    "origin": ("_ori", "ori_", "origin", "replicon", "p15a", "psc101", "pmb1", "cole1"),
    "reporter": ("gfp", "rfp", "cfp", "yfp", "chromoprotein", "amilcp", "lacz", "luc"),
    "cds": ("cds", "resistance", "kanr", "ampr", "cat ", "operon"),
}
# How far an origin is trusted.
TIERS = {"parts-library": 3, "your library": 3, "iGEM Registry": 2, "SynBioHub": 1}


def inferred_role(name: Column | str, source: Column | str) -> Column:
    """The first role one of whose words is in the name or source, or empty."""
    text = F.lower(F.concat_ws(" ", F.coalesce(S.col(name), F.lit("")), F.coalesce(S.col(source), F.lit(""))))
    found = F.lit("")
    for role, words in reversed(ROLE_WORDS.items()):
        has = F.lit(False)
        for word in words:
            has = has | F.contains(text, F.lit(word))
        found = F.when(has, role).otherwise(found)
    return found


def tier(provenance: Column | str) -> Column:
    """Trust in a reference's origin; a higher one wins a tie."""
    found = F.lit(0)
    for start, n in TIERS.items():
        found = F.when(F.startswith(F.coalesce(S.col(provenance), F.lit("")), F.lit(start)), n).otherwise(found)
    return found


def is_accession(name: Column | str) -> Column:
    return S.col(name).rlike(r"^[A-Za-z]{1,4}_?\d{4,9}(\.\d+)?$")
