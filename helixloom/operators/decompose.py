"""What a record is made of, and whether its labels say so.

Identification, claims, inner claims, gaps and the findings about them: every
table is joined by record, and a record's blocks are few. What several later
steps read is checkpointed once, so that none of it is worked out again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.functions import sequence as S
from helixloom.operators import audit, claims, gates, identify, offtarget, orfs
from helixloom.operators.lineage import cut

LEAST_RECORD = 8
BLOCKS = (
    "record string, start int, end int, strand int, ident string, pident double, cov double, indel int, indel_net int, ref_length int, matched int, "
    "n_diagonals int, alternatives array<string>, claim string, claim_strand int, role string, kind string"
)


def shaped(rows: DataFrame) -> DataFrame:
    """All columns of BLOCKS, null where ``rows`` has none."""
    fields = [x.rsplit(" ", 1) if "<" not in x else x.split(" ", 1) for x in BLOCKS.split(", ")]
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields])


def texts(records: DataFrame) -> DataFrame:
    """(record, seq, circular) of records, in upper case."""
    circular = F.coalesce("circular", F.lit(False)) if "circular" in records.columns else F.lit(False)
    return records.select(F.col("record").cast("string").alias("record"), F.upper("seq").alias("seq"), circular.alias("circular"))


def decompose(records: DataFrame, refs: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of records (record, seq, and circular where some are circles)
    and the claims inside them.

    ``refs`` has ref, seq, and may have provenance; ``features`` record, claim,
    kind, start, end, strand. A block is ``found`` in the references with the
    claim that lies most over it, ``claimed`` only, or what fills a ``gap``. On
    a circle blocks start at 1 to its length and may end past it.
    """
    circles = "circular" in records.columns
    blocks, inner = decomposed(cut(texts(records)), refs, features, circles, False)
    return blocks, inner


def decomposed(text: DataFrame, refs: DataFrame, features: DataFrame, circles: bool, bases: bool) -> tuple[DataFrame, DataFrame]:
    """:func:`decompose` of :func:`texts` that are read more than once; blocks and
    inner claims have their own ``bases`` if asked.

    A record's hits and claims meet in one row, where its blocks, inner claims and
    gaps are told apart; those rows are stored once."""
    queries = text.where(F.length("seq") >= LEAST_RECORD).select(F.col("record").alias("query"), F.col("seq").alias("qseq"), *(["circular"] if circles else []))
    found = identify.covers(identify.whole_hits(queries, refs, identify.LEAST_COVER)).withColumnRenamed("query", "record")
    number = F.struct("start", "end", "claim", "strand", "kind")
    given = features.groupBy(F.col("record").cast("string").alias("record")).agg(F.collect_list(number).alias("given"))
    met = text.join(found.hint("merge"), "record", "left").join(given.hint("merge"), "record", "full")
    taken, claims_ = F.coalesce("found", F.array()), F.coalesce("given", F.array())
    asked = F.filter("given", lambda c: ~c["kind"].isin("source", "misc"))
    met = met.select("record", "seq", F.length("seq").alias("n"), F.coalesce("circular", F.lit(False)).alias("circular"), taken.alias("found"), claims_.alias("given"))
    met = met.withColumn("found", F.transform("found", lambda h: F.struct(h.alias("h"), identify.best_claim(h["qstart"], h["qend"], h["real"], asked).alias("c"))))
    used = F.transform("found", lambda x: x["c"])
    rest = F.filter(asked, lambda c: ~F.exists(used, lambda u: F.coalesce(u == c, F.lit(False))))
    met = met.withColumn("rest", rest)
    inside = lambda c: F.coalesce(F.exists("found", lambda x: within(c, x["h"])), F.lit(False))
    met = met.withColumn("inner", F.filter("rest", inside)).withColumn("alone", F.filter("rest", lambda c: ~inside(c)))
    ends = F.concat(F.transform("found", lambda x: F.struct(x["h"]["qstart"].alias("s"), x["h"]["qend"].alias("e"))), F.transform("alone", lambda c: F.struct(c["start"].cast("int").alias("s"), c["end"].cast("int").alias("e"))))
    met = identify.with_gaps(met.withColumn("b", ends))
    piece = lambda a, b: S.stretch("seq", a, b) if bases else F.lit(None).cast("string")
    blocks = F.concat(F.transform("found", lambda x: as_block({
        "start": x["h"]["qstart"], "end": x["h"]["qend"], "strand": x["h"]["strand"], "ident": x["h"]["ref"], **{c: x["h"][c] for c in ("pident", "cov", "indel", "indel_net", "ref_length", "n_diagonals", "alternatives")},
        "matched": F.round(x["h"]["cov"] * x["h"]["ref_length"]), "claim": x["c"]["claim"], "claim_strand": x["c"]["strand"], "role": x["c"]["kind"], "kind": F.lit("found"), "bases": piece(x["h"]["qstart"], x["h"]["qend"]),
    })), F.transform("alone", lambda c: as_block({
        "start": c["start"], "end": c["end"], "strand": c["strand"], "claim": c["claim"], "claim_strand": c["strand"], "role": c["kind"], "kind": F.lit("claimed"), "bases": piece(c["start"], c["end"]),
    })))
    inner = F.transform("inner", lambda c: F.struct(*[c[x].alias(x) for x in ("claim", "kind", "start", "end", "strand")], piece(c["start"], c["end"]).alias("bases")))
    gaps = F.transform("g", lambda x: F.struct(x["s"].alias("gs"), x["e"].alias("ge"), S.stretch("seq", x["s"], x["e"]).alias("part")))
    met = cut(met.select("record", "seq" if bases else F.lit(None).cast("string").alias("seq"), "n", blocks.alias("blocks"), inner.alias("inner"), gaps.alias("gaps")))
    known = met.select("record", F.explode("blocks").alias("b")).select("record", "b.*")
    names = [c for c in known.columns if bases or c != "bases"]
    filled = orfs.gap_parts(met.select(F.col("record").alias("query"), F.explode("gaps").alias("x"), "n").select("query", "x.gs", "x.ge", "n", "x.part"))
    filled = shaped(filled.select(F.col("query").alias("record"), "start", "end", "strand", "role", F.lit("gap").alias("kind")))
    if bases:  # a gap's frame is a piece of it, told again by its place
        at = met.where(F.size("gaps") > 0).select("record", "seq")
        filled = filled.join(at.hint("merge"), "record").withColumn("bases", S.stretch("seq", F.col("start"), F.col("end"))).drop("seq")
    each = met.select("record", F.explode("inner").alias("c")).select("record", "c.*")
    return known.select(*names).unionByName(filled.select(*names)), each if bases else each.drop("bases")


def within(c: Column, h: Column) -> Column:
    return identify.within(c["start"], c["end"], h["qstart"], h["qend"], h["real"])


def as_block(values: dict[str, Column]) -> Column:
    """A struct of all BLOCKS but the record, null where there is no value, and ``bases``."""
    fields = [x.rsplit(" ", 1) if "<" not in x else x.split(" ", 1) for x in BLOCKS.split(", ")][1:]
    return F.struct(*[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in fields], values["bases"].alias("bases"))


def inner_names(inner: DataFrame, records: DataFrame, refs: DataFrame) -> DataFrame:
    """The claims inside blocks with what their own bases are: each goes
    through identification once more as a query of its own."""
    if "bases" not in inner.columns:
        text = records.select(F.col("record").cast("string").alias("record"), F.upper("seq").alias("seq"))
        inner = inner.join(text, "record").withColumn("bases", S.stretch("seq", F.col("start"), F.col("end"))).drop("seq")
    inner = cut(inner)
    if inner.isEmpty():  # identification of nothing takes as many steps
        return gates.nested_idents(inner.drop("bases"), inner.select("record", "start", "end", F.lit("").alias("ref"), F.lit(0.0).alias("pident"), F.lit(0.0).alias("cov")))
    queries = inner.select("record", "start", "end", F.col("bases").alias("qseq")).where(F.length("qseq") >= LEAST_RECORD).distinct().withColumn("query", F.concat_ws(":", "record", "start", "end"))
    hits = cut(identify.whole_hits(queries.select("query", "qseq"), refs)).join(queries.drop("qseq"), "query")
    asked = inner.drop("bases").where(F.col("end") - F.col("start") + 1 >= LEAST_RECORD)
    return gates.nested_idents(asked, hits.select("record", "start", "end", "ref", "pident", "cov"))


def identity_findings(blocks: DataFrame, inner: DataFrame, records: DataFrame, refs: DataFrame) -> DataFrame:
    """(record, start, end, category, status) of labels against bases, in
    blocks and inside them, of blocks' own checks, and of unnamed claims."""
    place = F.struct("start", "end")
    if "bases" in blocks.columns:
        read = blocks.withColumnRenamed("bases", "seq").withColumn("block", place)
    else:
        text = records.select(F.col("record").cast("string").alias("record"), F.upper("seq").alias("whole"))
        read = blocks.join(text, "record").withColumn("seq", S.stretch("whole", F.col("start"), F.col("end"))).drop("whole").withColumn("block", place)
    named = claims.claim_findings(read, refs).where("category <> 'truncation'")
    own = audit.block_findings(read).where("category not in ('identity-orientation', 'identity-mislabel')").drop("said")
    both = named.unionByName(own).select("record", "block.start", "block.end", "category", "status")
    return both.unionByName(gates.nested_findings(inner).select("record", "start", "end", "category", "status"))


def junction_findings(blocks: DataFrame, text: DataFrame) -> DataFrame:
    """(record, category, status) of the start site behind each binding site;
    a circle is read on past its origin."""
    n = F.length("seq")
    sites = blocks.where("role = 'rbs'").select("record", "start", "end", F.coalesce("strand", F.lit(1)).alias("strand")).join(text, "record")
    turn = F.when(F.col("circular"), n).otherwise(0)
    laid = sites.select("record", (F.col("start") + turn).alias("start"), (F.col("end") + turn).alias("end"), "strand", F.when(F.col("circular"), F.repeat("seq", 3)).otherwise(F.col("seq")).alias("seq"))
    return orfs.start_spacing(laid).select("record", F.lit("junction").alias("category"), "status")


def audited(
    records: DataFrame, refs: DataFrame, features: DataFrame, genome: DataFrame | None = None, reca_minus: bool = False, registry: DataFrame | None = None, cap: int | None = None,
    type_iis: bool = False, biobrick: bool = False, size: int = offtarget.PIECE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, findings (record, category, status) of all checks, and a verdict
    for every record.

    Checks of blocks and labels, of start sites, of whole sequences, repeats,
    the host's ``genome`` (host, start, bases in pieces of ``size``; a SKIP row
    without one), the fragment cap (one for all, else that of each record's
    ``vendor`` where records name one), and labels against a ``registry``."""
    records = cut(records)
    text = texts(records)
    blocks, inner = decomposed(text, refs, features, "circular" in records.columns, True)
    blocks = cut(blocks)
    found = cut(identity_findings(blocks, inner_names(inner, records, refs), records, refs))
    blocks = blocks.drop("bases")
    own = records.select(F.col("record").cast("string").alias("record"), F.upper("seq").alias("seq"), "vendor") if "vendor" in records.columns else text
    cap = audit.vendor_cap(F.col("vendor")) if cap is None and "vendor" in records.columns else cap
    sizes = text.select("record", F.length("seq").alias("length"))
    ran = sizes.select("record", F.lit(True).alias("ran"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("deep_failed"))
    places = blocks.where("kind = 'found'").groupBy("record", F.col("ident").alias("ref")).agg(F.max("n_diagonals").alias("places"))
    none = F.lit(None).cast("int").alias("longest")
    far = gates.GENE_SCALE if reca_minus else gates.SUBSTRATE + 1  # longer stretches have the same status
    shared = sizes.select("record", none) if genome is None else offtarget.longest_shared(text.select(F.col("record").alias("query"), F.col("seq").alias("qseq")), genome, far, size).select(F.col("query").alias("record"), "longest")
    host = shared.select("record", F.lit(genome is not None).alias("has_host"), F.lit(reca_minus).alias("reca_minus"), "longest")
    checks = [
        found, gates.run_findings(sizes, blocks.select("record", "start", "end", "ident"), ran, places), junction_findings(blocks, text), audit.record_findings(own, type_iis, biobrick, cap),
        audit.repeat_findings(audit.longest_repeats(text)), gates.homology_findings(host),
    ]
    if registry is not None:
        read = blocks.where("claim is not null").join(text, "record").withColumn("piece", S.stretch("seq", F.col("start"), F.col("end")))
        asked = read.select("record", F.col("start").alias("block"), "claim", F.coalesce("strand", F.lit(1)).alias("strand"), F.col("piece").alias("seq"))
        checks.append(claims.registry_findings(asked, registry).select("record", F.lit("registry").alias("category"), "status"))
    findings = checks[0].select("record", "category", "status")
    for more in checks[1:]:
        findings = findings.unionByName(more.select("record", "category", "status"))
    return blocks, findings, audit.verdict(findings, sizes)
