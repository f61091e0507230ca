"""Findings about identified blocks and whole records, and their verdict.

A block row has record, block, claim, claim_strand, ident, strand, cov, indel,
indel_net, ref_length, matched, role and seq. A check that could not be made
is a SKIP row, never a missing one. Nothing is collected: every check is a
column expression or one aggregate by record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.functions import batches
from helixloom.functions import sequence as S
from helixloom.operators import claims

from .identify import LOCI

RANK = {"FAIL": 0, "FLAG": 1, "SKIP": 2, "NOTE": 3, "PASS": 4}
CODING = ("cds", "reporter", "gene")
LEAST_REPEAT = 30
# The longest fragment that each vendor makes.
VENDOR_CAPS = {"Twist": 5000, "IDT": 3000, "GenScript": 10000}


def accuses() -> Column:
    """Whether a block is sure enough to speak against the design."""
    return F.col("claim").isNotNull() | ((F.col("cov") >= 0.95) & (F.coalesce("indel", F.lit(0)) == 0))


def block_findings(blocks: DataFrame) -> DataFrame:
    """(record, block, category, status, said) of all checks on single blocks.

    Labels are judged by their names alone here; :func:`claims.claim_findings`
    also has the references' bases. An indel says what it does to the frame, and
    a coding block that no rule finds fault with passes."""
    known, named = F.col("ident").isNotNull(), F.col("claim").isNotNull()
    flag = F.when(accuses(), "FLAG").otherwise("NOTE")
    lost = (F.col("ref_length") - F.col("matched") + F.greatest(F.lit(0), -F.coalesce("indel_net", F.lit(0)))) / F.col("ref_length")
    coding = F.col("role").isin(*CODING)
    read = F.when(F.col("strand") < 0, S.revcomp("seq")).otherwise(F.col("seq"))
    checks = {
        "identity-unchecked": F.when(named & ~known, "SKIP"),
        "identity-orientation": F.when(named & known & (F.col("claim_strand") != F.col("strand")), "FLAG"),
        "identity-mislabel": F.when(named & known & claims.wrong_name("claim", "ident"), "FLAG"),
        "indel": F.when(known & (F.col("indel") > 0), flag),
        "truncation": F.when(known & (F.coalesce(lost > 0.05, F.col("cov") < 0.95)), flag),
        "orf-stop": F.when(coding & S.internal_stop(read), F.when(accuses(), "FAIL").otherwise("NOTE")),
        "orf-frame": F.when(coding & (F.length("seq") % 3 != 0), flag),
        "orf-start": F.when(coding & ~S.has_start(read), "FLAG"),
    }
    faults = F.coalesce(*[s for c, s in checks.items() if c.startswith("orf-")])
    checks["orf"] = F.when(coding & faults.isNull(), "PASS")
    said = {"indel": frame_note(F.coalesce("indel_net", F.lit(0)))}
    found = F.array_compact(F.array(*[F.when(s.isNotNull(), F.struct(F.lit(c).alias("category"), s.alias("status"), said.get(c, F.lit(None).cast("string")).alias("said"))) for c, s in checks.items()]))
    return blocks.select("record", "block", F.explode(found).alias("f")).select("record", "block", "f.category", "f.status", "f.said")


def partial_findings(blocks: DataFrame, loci: int = LOCI) -> DataFrame:
    """(record, category, status, ref, places): a FLAG for each identified
    reference (query, ref, n_diagonals) that seeds more places than were
    compared, so that a further copy is not taken as checked."""
    per = blocks.groupBy(F.col("query").alias("record"), "ref").agg(F.max("n_diagonals").alias("places")).where(F.col("places") > loci)
    return per.select("record", F.lit("identification-partial").alias("category"), F.lit("FLAG").alias("status"), "ref", "places")


def frame_note(net: Column) -> Column:
    return F.when(F.abs(net) % 3 == 0, "frame kept").otherwise("frame shifted")


def vendor_cap(vendor: Column) -> Column:
    """The longest fragment that a vendor makes; null for others."""
    cap = F.lit(None).cast("int")
    for name, most in VENDOR_CAPS.items():
        cap = F.when(F.lower(F.trim(vendor)) == name.lower(), most).otherwise(cap)
    return cap


def size_finding(cap: int | Column) -> Column:
    """The size check of a sequence ``seq`` that has a ``cap``, else null."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    return F.when(cap.isNotNull(), F.struct(F.lit("size").alias("category"), F.when(F.length("seq") > cap, "FLAG").otherwise("PASS").alias("status")))


def size_findings(records: DataFrame, cap: int | Column) -> DataFrame:
    """(record, category, status) of sizes alone, which need no other check's
    walk over the sequence."""
    return records.select("record", size_finding(cap).alias("f")).where("f is not null").select("record", "f.category", "f.status")


def record_findings(records: DataFrame, type_iis: bool = False, biobrick: bool = False, cap: int | Column | None = None) -> DataFrame:
    """(record, category, status) of whole sequences (record, seq). Sizes are
    checked where there is a ``cap``, one for all or each record's own. What
    several checks read is made once, as columns before them."""
    kept = F.lit(cap) if isinstance(cap, int) else cap
    records = records.select("record", F.upper("seq").alias("seq"), *([] if cap is None else [kept.alias("cap")]))
    records = records.withColumn("gc", S.gc_percent("seq"))
    gc, n = F.col("gc"), F.length("seq")
    sites = [F.when(S.site_in(F.col("seq"), m), F.struct(F.lit(f"restriction {e}").alias("category"), F.lit("FLAG" if biobrick else "NOTE").alias("status"))) for e, m in S.SIX_CUTTERS.items() if e != "NcoI"]
    sites += [F.when(S.site_in(F.col("seq"), m), F.struct(F.lit(f"restriction {e}").alias("category"), F.lit("FLAG" if type_iis else "NOTE").alias("status"))) for e, m in S.TYPE_IIS_SITES.items()]
    row = lambda c, s: F.struct(F.lit(c).alias("category"), s.alias("status"))
    checks = [
        F.when(n == 0, row("invariant", F.lit("FAIL"))), F.when(n > 0, row("composition", F.when((gc < 25) | (gc > 65), "FLAG").otherwise("PASS"))),
        F.when(S.has_run("seq", 9), row("homopolymer", F.lit("FLAG"))), *sites,
    ]
    if cap is not None:
        checks.append(size_finding(F.col("cap")))
    return records.select("record", F.explode(F.array_compact(F.array(*checks))).alias("f")).select("record", "f.category", "f.status")


def repeats(records: DataFrame, k: int = 30) -> DataFrame:
    """Records in which some k-mer occurs twice: (record, repeated).

    A record is one row, so its k-mers are compared where it is read, as
    numbers that are sorted."""
    kind = records.schema["record"].dataType.simpleString()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            n = batches.repeated_words(batch.column(1), k)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(n[some])], names=["record", "repeated"])

    return records.select("record", "seq").mapInArrow(run, f"record {kind}, repeated long")


def longest_repeat(text: str) -> tuple[int, int, int]:
    """Length and the first two 1-based places of the longest stretch that
    occurs twice, the first of equals; 0 if no letter does.

    Stretches of 1, 2, 4 ... letters are ranked by the ranks of their halves.
    The longest power that occurs twice is then lengthened by the smaller ones,
    largest first, wherever some stretch still occurs twice."""
    n, levels = len(text), []
    ranks = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)[1]
    twice = lambda r: len(r) > 1 and int(r.max()) + 1 < len(r)
    joined = lambda a, b: np.unique(a.astype(np.int64) * n + b, return_inverse=True)[1]
    while twice(ranks):
        levels.append(ranks)
        size = 1 << len(levels) - 1
        if n - 2 * size < 1:
            break
        ranks = joined(ranks[: n - 2 * size + 1], ranks[size:])
    if not levels:
        return 0, 0, 0
    length, best = 1 << len(levels) - 1, levels[-1]
    for j in range(len(levels) - 2, -1, -1):
        places = n - length - (1 << j) + 1
        if places > 1:
            longer = joined(best[:places], levels[j][length : length + places])
            if twice(longer):
                length, best = length + (1 << j), longer
    order = np.argsort(best, kind="stable")
    pair = np.flatnonzero(best[order[1:]] == best[order[:-1]])
    first = pair[np.argmin(order[pair])]
    return length, int(order[first]) + 1, int(order[first + 1]) + 1


def longest_repeats(records: DataFrame) -> DataFrame:
    """(record, repeat_length, first, second) of every record (record, seq).
    Short stretches are found by sorting words of a whole batch, long ones and
    other letters record by record."""
    kind = records.schema["record"].dataType.simpleString()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            got, done = batches.short_repeats(batch.column(1))
            for i in np.flatnonzero(~done):
                got[i] = longest_repeat(batch.column(1)[int(i)].as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[:, i], pa.int32()) for i in range(3))], names=["record", "repeat_length", "first", "second"])

    rows = records.select("record", F.upper(F.coalesce("seq", F.lit(""))).alias("seq"))
    return rows.mapInArrow(run, f"record {kind}, repeat_length int, first int, second int")


def repeat_findings(longest: DataFrame, least: int = LEAST_REPEAT) -> DataFrame:
    """(record, category, status, said) of repeats of ``least`` bases or more."""
    said = F.concat(F.col("repeat_length").cast("string"), F.lit(" bp at "), F.col("first").cast("string"), F.lit(" and "), F.col("second").cast("string"))
    return longest.where(F.col("repeat_length") >= least).select("record", F.lit("repeats").alias("category"), F.lit("FLAG").alias("status"), said.alias("said"))


def homology(longest: Column, has_host: Column, reca_minus: Column, gene: int = 500) -> Column:
    """Status of the longest stretch shared with the host; from a ``gene``'s
    size on, a strain without recA doesn't settle it."""
    return F.when(~has_host, "SKIP").when(longest >= gene, "FLAG").when(longest > 40, F.when(reca_minus, "NOTE").otherwise("FLAG")).otherwise("PASS")


def verdict(findings: DataFrame, records: DataFrame) -> DataFrame:
    """Of each of ``records`` (record): counts by status and FAIL, REVIEW or
    PASS. An identity check that could not be made asks for review; a record
    without findings passes."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in RANK]
    per = findings.groupBy("record").agg(*counts, F.count_if((F.col("status") == "SKIP") & F.startswith("category", F.lit("identity"))).alias("unchecked"))
    whole = records.select("record").join(per, "record", "left").na.fill(0, [*(f"n_{s.lower()}" for s in RANK), "unchecked"])
    word = F.when(F.col("n_fail") > 0, "FAIL").when((F.col("n_flag") > 0) | (F.col("unchecked") > 0), "REVIEW").otherwise("PASS")
    return whole.select("record", *[f"n_{s.lower()}" for s in RANK], word.alias("verdict"), F.when(word == "FAIL", 1).when(word == "REVIEW", 5).otherwise(0).alias("exit_code"))


def severity() -> Column:
    """Sort key of a status; unknown ones last."""
    key = F.lit(9)
    for s, n in RANK.items():
        key = F.when(F.col("status") == s, n).otherwise(key)
    return key
