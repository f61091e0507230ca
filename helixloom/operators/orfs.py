"""Open reading frames, the blocks that fill gaps, and start-site spacing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.functions import batches
from helixloom.functions import sequence as S

LEAST_AA, LEAST_GAP, ORF_SHARE = 50, 6, 0.7
SPACING = (5, 9)


def closed_frames(codons: Column, least: int) -> Column:
    """array<struct(first, stop)>, codon numbers of each first ATG and the
    stop that closes it. Codons become a mark each, and the marks are split at
    stops, so that only stretches between stops are walked in order."""
    marks = F.array_join(F.transform(codons, lambda c: F.when(c == "ATG", "M").when(c.isin(*S.STOPS), "*").otherwise(".")), "")
    closed = F.split(F.regexp_replace(marks, r"[^*]*+$", ""), r"\*", -1)
    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<struct<first:int,stop:int>>").alias("out"))

    def step(s: Column, stretch: Column) -> Column:
        stop, at = s["i"] + F.length(stretch), F.instr(stretch, "M")
        found = F.when((at > 0) & (F.length(stretch) - at + 1 >= least), F.concat(s["out"], F.array(F.struct((s["i"] + at - 1).alias("first"), stop.alias("stop"))))).otherwise(s["out"])
        return F.struct((stop + 1).alias("i"), found.alias("out"))

    return F.aggregate(closed, start, step, lambda s: s["out"])


def frames(seq: Column | str, least: int = LEAST_AA) -> Column:
    """array<struct(start, end, strand, frame, aa)> over all six frames; 1-based
    forward coordinates that include the stop codon."""
    s = F.upper(S.col(seq))
    n = F.length(s)

    def placed(strand: int, frame: int, text: Column) -> Column:
        def place(x: Column) -> Column:
            low, high = x["first"] * 3 + frame, x["stop"] * 3 + frame + 3
            start, end = (low + 1, high) if strand > 0 else (n - high + 1, n - low)
            return F.struct(start.alias("start"), end.alias("end"), F.lit(strand).alias("strand"), F.lit(frame).alias("frame"), (x["stop"] - x["first"]).alias("aa"))

        return F.transform(closed_frames(S.codons(F.substr(text, F.lit(frame + 1))), least), place)

    found = [placed(strand, frame, text) for strand, text in ((1, s), (-1, S.revcomp(s))) for frame in range(3)]
    return F.concat(*found)


def open_frames(records: DataFrame, least: int = LEAST_AA) -> DataFrame:
    """(record, start, end, strand, frame, aa) of records (record, seq):
    :func:`frames` of a whole batch at a time."""
    kind, names = records.schema["record"].dataType.simpleString(), ("start", "end", "strand", "frame", "aa")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            got = batches.frames(batch.column(1), least, S.STOPS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(got["row"])), *(pa.array(got[c], pa.int32()) for c in names)], names=["record", *names])

    return records.select("record", F.upper("seq").alias("seq")).mapInArrow(run, f"record {kind}, " + ", ".join(f"{c} int" for c in names))


def longest_frames(cut: DataFrame, least: int) -> DataFrame:
    """``cut`` with the longest frame ``o`` of each upper-case ``part`` (its last
    column), null without one, in place of the part, whose length ``size`` stays. Of
    equals the forward one, then the lowest frame, then the first on its strand."""
    kept, names = cut.columns[:-1], ("start", "end", "strand", "aa")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            part = batch.column(len(kept))
            got = batches.frames(part, least, S.STOPS)
            order = np.lexsort((got["start"] * got["strand"], got["frame"], -got["strand"], -got["aa"], got["row"]))
            row, best = np.unique(got["row"][order], return_index=True)
            at = np.full(len(part), -1)
            at[row] = order[best]
            none = at < 0
            each = [pa.array(got[c][at] if len(order) else at, pa.int32(), mask=none) for c in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pc.cast(pc.utf8_length(part), pa.int32()), *each], names=[*kept, "size", *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields[:-1])
    wide = cut.mapInArrow(run, fields + ", size int, " + ", ".join(f"{c} int" for c in names))
    return wide.select(*kept, "size", F.when(F.col("aa").isNotNull(), F.struct(*names)).alias("o"))


def gap_blocks(gaps: DataFrame, records: DataFrame, least: int = LEAST_AA) -> DataFrame:
    """What lies in each gap (query, start, end): its longest frame where that
    takes up most of it, and unidentified rests of LEAST_GAP or more; else one
    unidentified block. Returns (query, start, end, strand, role, aa). A gap
    may go on past the origin of a circle; blocks start on it."""
    met = gaps.join(records.select(F.col("record").alias("query"), "seq"), "query")
    part = S.stretch(F.upper("seq"), F.col("start"), F.col("end"))
    return gap_parts(met.select("query", F.col("start").cast("int").alias("gs"), F.col("end").cast("int").alias("ge"), F.length("seq").alias("n"), part.alias("part")), least)


def gap_parts(cut: DataFrame, least: int = LEAST_AA) -> DataFrame:
    """:func:`gap_blocks` of gaps (query, gs, ge, n, part) that have their own
    bases in upper case, of records of ``n`` bases."""
    held = longest_frames(cut, least).withColumn("fits", F.coalesce(F.col("o.aa") * 3 >= ORF_SHARE * F.col("size"), F.lit(False)))
    low, high = F.col("gs") + F.col("o.start") - 1, F.col("gs") + F.col("o.end") - 1

    def block(start, end, strand=F.lit(1), role=F.lit(None), aa=F.lit(None)) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), strand.cast("int").alias("strand"), role.cast("string").alias("role"), aa.cast("int").alias("aa"))

    split = F.array(
        F.when(low - F.col("gs") >= LEAST_GAP, block(F.col("gs"), low - 1)),
        block(low, high, F.col("o.strand"), F.lit("cds"), F.col("o.aa")),
        F.when(F.col("ge") - high >= LEAST_GAP, block(high + 1, F.col("ge"))),
    )
    rows = F.array_compact(F.when(F.col("fits"), split).otherwise(F.array(block(F.col("gs"), F.col("ge")))))
    turn = F.when(F.col("b.start") > F.col("n"), F.col("n")).otherwise(0)
    placed = held.select("query", "n", F.explode(rows).alias("b"))
    return placed.select("query", (F.col("b.start") - turn).alias("start"), (F.col("b.end") - turn).alias("end"), "b.strand", "b.role", "b.aa")


def with_core(found: DataFrame, least: int = 4) -> DataFrame:
    """``found`` with the 0-based place ``core`` of :func:`sequence.best_shine_dalgarno`
    in each ``body`` (its last column), null without one, in place of the body."""
    kept = found.columns[:-1]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            score, at = batches.best_word(batch.column(len(kept)), S.SHINE_DALGARNO, least)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(at, pa.int32(), mask=score < 0)], names=[*kept, "core"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields[:-1])
    return found.mapInArrow(run, f"{fields}, core int")


def start_spacing(blocks: DataFrame) -> DataFrame:
    """(record, start, spacing, status, reason) of each rbs block (record,
    start, end, strand, seq = the whole record): the bases between its core
    and the next ATG of its own strand."""
    whole, forward = F.upper("seq"), F.col("strand") > 0
    start, end = F.col("start").cast("int"), F.col("end").cast("int")
    body = F.substr(whole, start, end - start + 1)
    from_ = F.greatest(F.lit(1), start - 40)
    before = S.revcomp(F.substr(whole, from_, start - from_))
    found = blocks.select(
        "record", start.alias("start"), forward.alias("forward"), end.alias("end"), F.when(forward, S.next_start(whole, end)).otherwise(S.next_start(before, F.lit(0))).alias("atg"),
        F.when(forward, body).otherwise(S.revcomp(body)).alias("body"),
    )
    found = with_core(found)
    after_core = F.col("end") - F.col("start") + 1 - (F.col("core") + len(S.SHINE_DALGARNO))
    spacing = after_core + F.when(F.col("forward"), F.col("atg") - F.col("end")).otherwise(F.col("atg"))
    reason = F.when(F.col("atg").isNull(), "no start").when(F.col("core").isNull(), "no core").when(~spacing.between(*SPACING), "spacing")
    return found.select("record", "start", F.when(F.col("atg").isNotNull(), spacing).alias("spacing"), F.when(reason.isNull(), "PASS").otherwise("FLAG").alias("status"), reason.alias("reason"))
