"""Hard negatives by blocked dense products of anchors and candidates.

Valid rows are stored once. Anchors are dealt into blocks of ``ANCHORS`` at
most, each sent to the tasks that read candidates; a task multiplies a part of
the block with a batch of candidates in float64, whose integers are exact below
2^53 (a block that might pass that is multiplied in integers), and keeps the
best of each anchor over its batches. Lists of the best merge by anchor: a task
gives k entries for each. A first pass finds positives, a second the negatives
in each positive's window of scores.

A pass reads the candidates once for each block of anchors; what the driver
holds is one block and its positives.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; rows alike in id, label and vector count
once, and other rows with the anchor's id are never its positives or negatives;
of vectors of different length the shorter is continued by zeros; a score that
a long can't hold is held at the long's end; ties go to the smaller id, and
between rows of one id both are listed; extra columns, whatever their names,
are ignored; without anchors or candidates there are no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Anchors in a block: 16 MB of 64 numbers each.
ANCHORS = 32_768
#: Anchors multiplied with a batch at once.
ROWS = 256
EXACT, LOW, HIGH = 2**53, -(2**63), 2**63 - 1
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def valid(vectors: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """(id, label, vector) of rows that take part, each once."""
    whole = F.forall(F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(whole, F.lit(False))).dropDuplicates()


def matrix(column: pa.Array, scale: float) -> np.ndarray:
    """Whole numbers floor(scale * x) of list cells, short ones continued by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows as longs. Float64 adds integers without error
    while no partial sum can reach 2^53."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not d:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * d < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, LOW, HIGH).astype(np.int64)


class Best:
    """The k best (score, id) of each of m anchors so far."""

    def __init__(self, m: int, k: int):
        self.scores, self.ids = np.full((m, k), LOW, np.int64), np.full((m, k), HIGH, np.int64)
        self.full = np.zeros((m, k), bool)

    def add(self, rows: slice, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Takes in scores of anchors ``rows`` by candidates in order of ids."""
        m, c = scores.shape
        k = self.scores.shape[1]
        least = np.where(self.full[rows, -1], self.scores[rows, -1], LOW)
        open_ = allowed & (scores >= least[:, None])
        if c > k and np.count_nonzero(open_) > 64 * m:
            # beyond the k-th best of this batch nothing can enter
            kth = np.partition(np.where(open_, scores, LOW), c - k, axis=1)[:, c - k]
            open_ &= scores >= kth[:, None]
        r, at = np.nonzero(open_)
        if not len(r):
            return
        had, place = np.nonzero(self.full[rows])
        r = np.concatenate([had, r])
        s = np.concatenate([self.scores[rows][had, place], scores[r[len(had) :], at]])
        i = np.concatenate([self.ids[rows][had, place], ids[at]])
        order = np.lexsort((i, -1 - s, r))  # -1 - s, as -s of the least long is no long
        r, s, i = r[order], s[order], i[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        r, s, i, rank = (x[rank < k] for x in (r, s, i, rank))
        self.scores[rows][r, rank], self.ids[rows][r, rank], self.full[rows][r, rank] = s, i, True


def batches_of(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, labels and numbers of each batch, by id."""
    for batch in batches:
        if batch.num_rows:
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            yield ids[order], batch.column(1).to_numpy()[order], matrix(batch.column(2), scale)[order]


def passed(candidates: DataFrame, k: int, slots: int, work: Callable) -> DataFrame:
    """(anchor, slot, best): the k best entries of each anchor and slot over
    all candidates, as ``work(batches)`` finds them in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, best in enumerate(work(batches)):
            some = np.flatnonzero(best.full[:, 0])
            for at in range(0, len(some), 4096):
                rows = some[at : at + 4096]
                entries = [[{"less": int(-1 - s), "id": int(i)} for s, i, f in zip(best.scores[r], best.ids[r], best.full[r]) if f] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([slot] * len(rows), pa.int32()), pa.array(entries, pa.list_(pa.struct([("less", pa.int64()), ("id", pa.int64())])))], names=["anchor", "slot", "best"])

    found = candidates.mapInArrow(run, "anchor int, slot int, best array<struct<less:bigint,id:bigint>>")
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k)
    return found.groupBy("anchor", "slot").agg(merged.alias("best"))


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def mine(
    vectors: DataFrame, anchors: Column, label: Column | None = None, key: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: float = 256.0, block: int = ANCHORS,
) -> DataFrame:
    """For each anchor (a condition on ``id``) and each of its best rows of the
    same label, the best rows of other labels whose score is ``low`` to
    ``high`` hundredths of the positive's."""
    spark = vectors.sparkSession
    rows = stored(valid(vectors, key, vector, F.col("label") if label is None else label), "vectors")
    asked = rows.where(anchors)
    count = asked.count()
    blocks = -(-count // block)
    dealt = stored(asked.repartition(max(1, blocks)).withColumn("block", F.spark_partition_id()), "anchors")
    parts = []
    for b in range(blocks):
        mine_ = dealt.where(F.col("block") == b).select("id", "label", "vector").toArrow().combine_chunks()
        if not mine_.num_rows:
            continue
        ids, labels, numbers = next(batches_of(iter(mine_.to_batches()), scale))
        sent = spark.sparkContext.broadcast((ids, labels, numbers))

        def same(batches: Iterator[pa.RecordBatch], sent=sent) -> list[Best]:
            a_ids, a_labels, a = sent.value
            best = Best(len(a_ids), positives)
            order = np.argsort(a_labels, kind="stable")
            of = [g for g in np.split(order, np.flatnonzero(np.diff(a_labels[order])) + 1)]
            groups = {int(a_labels[g[0]]): Best(len(g), positives) for g in of}
            for c_ids, c_labels, c in batches_of(batches, scale):
                for g in of:
                    mark = int(a_labels[g[0]])
                    like = np.flatnonzero(c_labels == mark)
                    for at in range(0, len(g) if len(like) else 0, ROWS):
                        part = g[at : at + ROWS]
                        groups[mark].add(slice(at, at + len(part)), product(a[part], c[like]), a_ids[part][:, None] != c_ids[like], c_ids[like])
            for g in of:
                got = groups[int(a_labels[g[0]])]
                best.scores[g], best.ids[g], best.full[g] = got.scores, got.ids, got.full
            return [best]

        # at most ``block`` anchors with ``positives`` entries each
        found = passed(rows, positives, 1, same).collect()
        chosen = [(r.anchor, s, e.id, -1 - e.less) for r in found for s, e in enumerate(r.best)]
        least, most = np.full((positives, len(ids)), 1, np.int64), np.zeros((positives, len(ids)), np.int64)
        for a, s, _, score in chosen:
            least[s, a], most[s, a] = window(score, low, high)
        ranges = spark.sparkContext.broadcast((least, most))

        def other(batches: Iterator[pa.RecordBatch], sent=sent, ranges=ranges) -> list[Best]:
            a_ids, a_labels, a = sent.value
            least, most = ranges.value
            best = [Best(len(a_ids), negatives) for _ in least]
            for c_ids, c_labels, c in batches_of(batches, scale):
                for at in range(0, len(a_ids), ROWS):
                    part = slice(at, min(at + ROWS, len(a_ids)))
                    scores = product(a[part], c)
                    differ = (a_labels[part][:, None] != c_labels) & (a_ids[part][:, None] != c_ids)
                    for s, kept in enumerate(best):
                        kept.add(part, scores, differ & (scores >= least[s, part][:, None]) & (scores <= most[s, part][:, None]), c_ids)
            return best

        names = spark.createDataFrame([(int(a), s, int(ids[a]), i, score) for a, s, i, score in chosen], "anchor int, slot int, anchor_id long, positive_id long, positive_score long")
        hits = passed(rows, negatives, positives, other).join(F.broadcast(names), ["anchor", "slot"])
        each = hits.select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "e"))
        parts.append(stored(each.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("negative_id"), "positive_score", (-1 - F.col("e.less")).alias("negative_score")), "negatives"))
    if not parts:
        return spark.createDataFrame([], RESULT)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
