"""Codon adaptation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixloom.functions import sequence as S

FLOOR = 0.01


def weights(usage: DataFrame) -> DataFrame:
    """(codon, family, n) to each codon's share of its family's best."""
    return usage.select("codon", (F.col("n") / F.max("n").over(Window.partitionBy("family"))).alias("w"))


def adaptation(genes: DataFrame, table: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(gene, cai): the geometric mean of a gene's codon weights; codons that
    the table lacks count as ``floor``. The table has 64 rows at most."""
    each = genes.select("gene", F.explode(S.codons("seq")).alias("codon")).join(F.broadcast(table), "codon", "left")
    w = F.greatest(F.coalesce(F.nullif(F.col("w"), F.lit(0.0)), F.lit(floor)), F.lit(floor))
    return each.groupBy("gene").agg(F.exp(F.avg(F.ln(w))).alias("cai"))
