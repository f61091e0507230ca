"""The reference set that a sealed library and earlier sets give.

Only listed parts are taken, each through the gates of its hash, its name and
its class; what is refused is a row with its reason. Everything is a join by id
or a column expression, and the counts come with the set from one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixloom.functions import sequence as S
from helixloom.operators import manifest

# Terms of entries that are several parts in one.
COMPOSITE_TERMS = ("IGEM:0000007", "IGEM:0000009", "IGEM:0000021")
COLUMNS = ("id", "registry", "role", "variant", "name", "provenance", "seq")


def is_composite(provenance: Column | str) -> Column:
    found = F.lit(False)
    for term in COMPOSITE_TERMS:
        found = found | F.contains(F.coalesce(S.col(provenance), F.lit("")), F.lit(term))
    return found


def seeded(allowed: DataFrame, library: DataFrame, published: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (COLUMNS) and refusals (id, reason) of the parts ``allowed`` (id,
    role, variant, name) by a library's newest files (id, outfile, seq,
    seq_sha256 or null if no row lists it, class, source). A designed part must
    be among ``published`` (id): both lists are joined by id."""
    w = Window.partitionBy("id").orderBy(F.desc("outfile"))
    newest = library.join(allowed.select("id"), "id", "left_semi").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    met = allowed.join(newest, "id", "left").join(published.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    got = manifest.seq_sha256("seq")
    reason = (
        F.when(F.col("outfile").isNull(), "not in the library").when(F.coalesce("seq", F.lit("")) == "", "no bases").when(F.col("seq_sha256").isNull(), "no row lists it")
        .when(F.substring(got, 1, 12) != manifest.filename_sha12("outfile"), "bases differ from their name").when(got != F.col("seq_sha256"), "bases differ from their row")
        .when((F.col("class") == "designed") & F.col("known").isNull(), "designed and not published")
    )
    judged = met.withColumn("reason", reason)
    source = F.coalesce("source", F.lit(""))
    origin = F.concat(F.lit("parts-library "), F.element_at(F.split("outfile", "/"), -1), F.when(source != "", F.concat(F.lit(" | "), F.substring(source, 1, 80))).otherwise(""))
    rows = judged.where("reason is null").select("id", S.registry_hint("source").alias("registry"), "role", F.coalesce("variant", F.lit("")).alias("variant"), "name", origin.alias("provenance"), F.upper("seq").alias("seq"))
    return rows, judged.where("reason is not null").select("id", "reason")


def projected(rows: DataFrame, earlier: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The set to be written and (id) of entries left out as composites.

    Registry rows of an ``earlier`` set stay if nothing new has their id,
    entries of several parts go wherever they come from, and hand-made
    ``seeds`` come last: only ids that nothing else has."""
    whole = manifest.carry_forward(earlier, rows, "id", F.startswith("provenance", F.lit("iGEM Registry")))
    alone = whole.where(~is_composite("provenance"))
    return alone.unionByName(seeds.join(alone.select("id"), "id", "left_anti")), whole.where(is_composite("provenance")).select("id")


def counts(rows: DataFrame) -> DataFrame:
    """(kind, value, n): how many rows have each role, and each origin."""
    origin = F.when(F.startswith("provenance", F.lit("parts-library")), "library").when(F.startswith("provenance", F.lit("iGEM Registry")), "registry").otherwise("hand")
    by = rows.select("role", origin.alias("origin")).groupingSets([["role"], ["origin"]], "role", "origin").agg(F.grouping("role").alias("g"), F.count("*").alias("n"))
    return by.select(F.when(F.col("g") == 0, "role").otherwise("origin").alias("kind"), F.when(F.col("g") == 0, F.col("role")).otherwise(F.col("origin")).alias("value"), "n")


def write(rows: DataFrame, path: str) -> None:
    """Tab-separated rows and FASTA, in order of role and id over all files."""
    ordered = rows.repartitionByRange("role", "id").sortWithinPartitions("role", "id")
    ordered.drop("seq").write.option("sep", "\t").option("header", True).option("quote", "").csv(f"{path}/parts")
    ordered.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq")).write.text(f"{path}/fasta")
