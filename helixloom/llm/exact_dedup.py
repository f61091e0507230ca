"""Exact deduplication with a heavy-hitter split.

A Misra-Gries pass finds the digests that may be frequent, an exact count
verifies them, and their winners are broadcast so that their rows are
settled map-side. All other digests go through an ordinary shuffle.

Only ``(doc_id, digest)`` is shuffled; texts are read once. The broadcast
holds fewer than ``counters`` rows whatever the input (see
:func:`heavy_winners`).

Defined results: a null text counts as empty; an empty table gives an empty
result; a null doc_id never wins against a number and is kept only if all
ids of its group are null; rows that repeat both text and winning doc_id are
indistinguishable, so :func:`groups` marks each of them kept while
:func:`dedup` returns one of them. Extra columns pass through :func:`dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

COUNTERS = 1024


def reduce_counters(counts: dict, k: int) -> dict:
    """Brings a Misra-Gries summary back to at most ``k`` counters.

    Subtracting the (k+1)-th largest count from all loses at most
    ``total / (k + 1)`` of any item, and summaries stay mergeable by sums.
    """
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {x: n - cut for x, n in counts.items() if n > cut}


def frequent_candidates(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Misra-Gries over one column ``digest``: (digest, at_least), merged."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)).to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
            held = reduce_counters(held, counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(list(held), pa.binary()), "at_least": pa.array(list(held.values()), pa.int64())}
        )

    parts = digests.select("digest").mapInArrow(summarise, "digest binary, at_least bigint")
    return parts.groupBy("digest").agg(F.sum("at_least").alias("at_least"))


def heavy_winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Exact (digest, keep_id, group_size, ties) of the frequent digests.

    With N rows, a digest of over ``2N/k`` rows keeps a merged count of over
    ``N/k``, and fewer than ``k`` digests can have that much: the result has
    a proven bound, and every digest of over ``2N/k`` rows is in it.
    """
    total = digests.count()
    likely = frequent_candidates(digests, counters).where(F.col("at_least") * counters > total).select("digest")
    return winners(digests.join(F.broadcast(likely), "digest", "left_semi"))


def winners(digests: DataFrame) -> DataFrame:
    """The row that stays, the size, and how often the winner is repeated."""
    by_id = digests.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
    return by_id.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"), F.max_by("n", F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("ties")
    )


def with_digest(docs: DataFrame, normalise=lambda text: text) -> DataFrame:
    return docs.select("doc_id", F.unhex(F.sha2(normalise(text_of()), 256)).alias("digest"))


def settled(docs: DataFrame, normalise, counters: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, digest) of all rows, the heavy winners, the other winners."""
    digests = stored(with_digest(docs, normalise), "digests")
    heavy = stored(heavy_winners(digests, counters), "heavy")
    light = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    return digests, heavy, winners(light)


def groups(docs: DataFrame, normalise=lambda text: text, counters: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    digests, heavy, light = settled(docs, normalise, counters)
    known = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light, "digest")
    return known.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def dedup(docs: DataFrame, normalise=lambda text: text, counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns.

    Copies of frequent texts are dropped before any shuffle; the rest meets
    its winners by digest.
    """
    _, heavy, light = settled(docs, normalise, counters)
    digest: Column = F.unhex(F.sha2(normalise(text_of()), 256))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), digest.alias("digest"), docs["doc_id"].alias("id"))

    def stays(rows: DataFrame, won: DataFrame) -> DataFrame:
        won = won.select(F.col("digest").alias("d"), "keep_id", "ties")
        return rows.join(won, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("keep_id")))

    known = stays(packed, F.broadcast(heavy))
    rest = stays(packed.join(F.broadcast(heavy.select("digest")), "digest", "left_anti"), light)
    kept = known.select("row", "digest", "ties").unionByName(rest.select("row", "digest", "ties"))
    once = kept.where("ties = 1").unionByName(kept.where("ties > 1").dropDuplicates(["digest"]))
    return once.select("row.*")
