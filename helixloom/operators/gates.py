"""Checks around a build: what was listed, trimmed, assembled and run.

Every rule is a column expression or one aggregate by construct, record or
library. A check that could not be made gives a row that says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixloom.functions import sequence as S
from helixloom.operators import audit, claims, manifest
from helixloom.operators.identify import LOCI, within

# Thresholds of the codon, homology and order checks.
CAI_BLOCK, CAI_WARN = 0.75, 0.80
GENE_SCALE, SUBSTRATE, MATCH_CAP = 500, 40, 1000
CELL_LIMIT = 32767
# The columns of an order form, in order.
ORDER_COLUMNS = ("name", "role", "length_bp", "sequence", "seq_sha256", "construct", "version", "host", "vector", "assembly_method", "note")
# How a build's levels read as statuses.
LEVEL_STATUS = {"WARN": "FLAG", "INFO": "NOTE"}


def finding(test: Column, rule: Column | str, level: str, part: Column | None = None) -> Column:
    name = F.lit(rule) if isinstance(rule, str) else rule
    return F.when(test, F.struct(name.alias("rule"), F.lit(level).alias("level"), (F.lit(None).cast("string") if part is None else part.cast("string")).alias("part")))


def ordered_parts(order: DataFrame, parts: DataFrame, trims: DataFrame) -> DataFrame:
    """The order (construct, position, part) with each part's listed ``length``
    and its bases without trims. ``parts`` has part, seq, length; ``trims``
    part, three_prime, five_prime. An ordered part that isn't listed stays,
    with ``listed`` false; ``cut`` is null where a trim is not at its end. A
    part is trimmed once, not wherever it is ordered; its other columns stay."""
    spare = F.length(F.coalesce("three_prime", F.lit(""))) + F.length(F.coalesce("five_prime", F.lit("")))
    more = [c for c in parts.columns if c not in ("part", "seq", "length")]
    known = parts.join(trims, "part", "left").select("part", F.lit(True).alias("listed"), S.trimmed("seq", F.col("three_prime"), F.col("five_prime")).alias("cut"), (F.col("length") - spare).alias("expected"), *more)
    return order.join(known, "part", "left").select("construct", "position", "part", F.coalesce("listed", F.lit(False)).alias("listed"), "cut", "expected", *more)


def build_findings(ordered: DataFrame, inserts: DataFrame) -> DataFrame:
    """(construct, rule, level, part) of an insert against its order.

    ``inserts`` (construct, insert) is what was assembled or read back. A part
    that isn't listed, or a trim that isn't there, blocks the construct before
    anything else is compared; then an empty insert, the listed lengths less
    trims, and every part's bases are."""
    rows = F.sort_array(F.collect_list(F.struct("position", "part", "listed", "cut", "expected")))
    met = ordered.groupBy("construct").agg(rows.alias("p"), *order_sums()).join(inserts, "construct", "left")
    met = met.withColumn("insert", F.upper(F.coalesce("insert", F.lit(""))))
    return met.select("construct", F.explode(order_findings()).alias("f")).select("construct", "f.rule", "f.level", "f.part")


def order_sums() -> list[Column]:
    """Aggregates of an order that :func:`order_findings` reads."""
    return [F.bool_and("listed").alias("all"), F.bool_and(F.col("cut").isNotNull()).alias("cuts"), F.sum("expected").alias("n")]


def order_findings() -> Column:
    """The findings of :func:`build_findings`, from a row for each construct."""
    each = lambda test, rule: F.transform(F.array_distinct(F.transform(F.filter("p", test), lambda x: x["part"])), lambda x: F.struct(F.lit(rule).alias("rule"), F.lit("BLOCK").alias("level"), x.cast("string").alias("part")))
    whole = F.array_compact(F.array(finding(F.length("insert") != F.col("n"), "length differs", "BLOCK")))
    lost = each(lambda x: ~F.contains(F.col("insert"), x["cut"]), "part not in insert")
    return (
        F.when(~F.col("all"), each(lambda x: ~x["listed"], "part not listed"))
        .when(~F.col("cuts"), each(lambda x: x["cut"].isNull(), "trim not found"))
        .when(F.length("insert") == 0, F.array(finding(F.lit(True), "empty insert", "BLOCK")))
        .otherwise(F.concat(whole, lost))
    )


def read_back(written: DataFrame) -> DataFrame:
    """(construct, problem) of written inserts (construct, want, seq): a hash
    expected from outside or from before writing that the bases don't have."""
    got = manifest.seq_sha256("seq")
    problem = F.when(F.coalesce("seq", F.lit("")) == "", "nothing read back").when(~got.eqNullSafe(F.col("want")), "hash differs")
    return written.select("construct", problem.alias("problem")).where("problem is not null")


def as_status(level: Column | str) -> Column:
    """A build's level as a finding's status; what is unknown fails."""
    out = F.lit("FAIL")
    for name, status in LEVEL_STATUS.items():
        out = F.when(S.col(level) == name, status).otherwise(out)
    return out


def wording(verdict: Column, blocked_stage: Column, reason: Column, not_run: Column) -> Column:
    """struct(kind, headline, detail): a build that finished but left a check
    out is to be reviewed, never passed."""
    stage = F.coalesce(F.nullif(blocked_stage, F.lit("")), F.lit("?"))
    said = F.coalesce(F.nullif(reason, F.lit("")), F.lit("The engine stopped."))
    told = F.when(F.contains(said, stage), said).otherwise(F.concat(said, F.lit(" (stage: "), stage, F.lit(")")))
    row = lambda kind, headline, detail: F.struct(F.lit(kind).alias("kind"), F.lit(headline).alias("headline"), detail.alias("detail"))
    return F.when(F.coalesce(verdict, F.lit("FAIL")) == "FAIL", row("FAIL", "BLOCKED", told)).when((verdict == "REVIEW") | (not_run != ""), row("REVIEW", "NOT ALL CHECKED", not_run)).otherwise(row("PASS", "SEALED", F.lit("")))


def accounted(blocks: DataFrame, records: DataFrame) -> DataFrame:
    """(record, accounted, unaccounted): bases in blocks (record, start, end)
    and bases of records (record, length) beyond those."""
    per = blocks.groupBy("record").agg(F.sum(F.col("end") - F.col("start") + 1).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return records.join(per, "record", "left").select("record", n.cast("long").alias("accounted"), F.greatest(F.col("length") - n, F.lit(0)).cast("long").alias("unaccounted"))


def homology_findings(longest: DataFrame) -> DataFrame:
    """(record, category, status, said) of the longest stretch shared with a
    host (record, has_host, reca_minus, longest); a length at the search's cap
    is a least length."""
    n = F.coalesce("longest", F.lit(0))
    much = F.when(n >= MATCH_CAP, F.concat(F.lit("at least "), n.cast("string"), F.lit(" bp"))).otherwise(F.concat(n.cast("string"), F.lit(" bp")))
    said = F.when(~F.col("has_host"), "not run").when(n <= SUBSTRATE, f"none over {SUBSTRATE} bp").otherwise(much)
    return longest.select("record", F.lit("host-homology").alias("category"), audit.homology(n, F.col("has_host"), F.col("reca_minus")).alias("status"), said.alias("said"))


def run_findings(records: DataFrame, blocks: DataFrame, status: DataFrame, capped: DataFrame) -> DataFrame:
    """(record, category, status, said) of how an audit ran: identification or
    a deeper search that did not, no blocks, bases in no block, and references
    found in more places than were compared.

    ``records`` has record, length; ``blocks`` record, start, end, ident;
    ``status`` record, ran, reason, deep_failed; ``capped`` record, ref, places."""
    per = blocks.groupBy("record").agg(F.count("*").alias("blocks"))
    met = records.join(status, "record", "left").join(per, "record", "left").join(accounted(blocks, records), "record")
    ran = F.coalesce("ran", F.lit(True))
    row = lambda test, category, level, said: F.when(test, F.struct(F.lit(category).alias("category"), F.lit(level).alias("status"), said.alias("said")))
    checks = F.array(
        row(~ran, "identification", "FLAG", F.coalesce("reason", F.lit("the caller reported it did not run"))),
        row(F.coalesce("deep_failed", F.lit("")) != "", "deep-search", "FLAG", F.col("deep_failed")),
        row(F.col("blocks").isNull(), "invariant", "FLAG", F.when(ran, "nothing matched").otherwise("not run")),
        row(F.col("unaccounted") > 0, "decomposition", "NOTE", F.concat(F.col("unaccounted").cast("string"), F.lit(" of "), F.col("length").cast("string"))),
    )
    alone = met.select("record", F.explode(F.array_compact(checks)).alias("f")).select("record", "f.category", "f.status", "f.said")
    used = blocks.where("ident is not null").select("record", F.col("ident").alias("ref")).distinct()
    over = capped.where(F.col("places") > LOCI).join(used, ["record", "ref"]).groupBy("record").agg(F.array_sort(F.collect_list(F.struct((-F.col("places")).alias("less"), "ref"))).alias("x"))
    names = F.array_join(F.transform(F.slice("x", 1, 4), lambda x: F.concat(x["ref"], F.lit(" ("), (-x["less"]).cast("string"), F.lit(" places)"))), ", ")
    return alone.unionByName(over.select("record", F.lit("identification-partial").alias("category"), F.lit("FLAG").alias("status"), names.alias("said")))


def inner_claims(given: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims (record, claim, kind, start, end, used) that no block took up:
    those that lie inside a block, and those that become blocks themselves.
    Claims of a record meet its blocks by the record; blocks on a circle have
    its length ``real``."""
    rest = given.where(~F.col("used") & ~F.col("kind").isin("source", "misc")).drop("used")
    real = F.col("real") if "real" in blocks.columns else F.lit(None).cast("int")
    b = blocks.select(F.col("record").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"), real.alias("n"))
    inside = (F.col("record") == F.col("r")) & within(F.col("start"), F.col("end"), F.col("s"), F.col("e"), F.col("n"))
    return rest.join(b, inside, "left_semi"), rest.join(b, inside, "left_anti")


def nested_idents(nested: DataFrame, hits: DataFrame) -> DataFrame:
    """Each inner claim (record, claim, start, end) with what its own bases
    are: of hits (record, start, end, ref, pident, cov) on it the best by cover
    and identity, the first name of equals, and all that fit as well."""
    key = ["record", "start", "end"]
    best = F.min_by(F.struct("ref", "pident", "cov"), F.struct(-F.col("cov"), -F.col("pident"), F.col("ref")))
    top = hits.groupBy(*key).agg(best.alias("b"))
    near = hits.join(top, key).where((F.abs(F.col("pident") - F.col("b.pident")) < 0.05) & (F.abs(F.col("cov") - F.col("b.cov")) < 0.02))
    alike = near.groupBy(*key).agg(F.sort_array(F.collect_set("ref")).alias("alternatives"))
    met = nested.join(top, key, "left").join(alike, key, "left")
    return met.select(*key, "claim", F.col("b.ref").alias("ident"), F.round("b.pident", 1).alias("pident"), F.round("b.cov", 2).alias("cov"), "alternatives")


def nested_findings(idents: DataFrame) -> DataFrame:
    """(record, start, end, claim, category, status) of inner claims: SKIP if
    nothing matched, FLAG if the bases have other names only."""
    named = claims.plain("claim")
    same = (named == F.upper("ident")) | F.contains(named, F.upper("ident")) | F.coalesce(F.array_contains(F.transform("alternatives", claims.plain), named), F.lit(False))
    found = F.when(F.col("ident").isNull(), F.struct(F.lit("identity-nested").alias("category"), F.lit("SKIP").alias("status"))).when(~same, F.struct(F.lit("identity-mislabel").alias("category"), F.lit("FLAG").alias("status")))
    return idents.where(F.coalesce("claim", F.lit("")) != "").select("record", "start", "end", "claim", found.alias("f")).where("f is not null").select("record", "start", "end", "claim", "f.*")


def root_checks(rows: DataFrame, roots: DataFrame, order: str) -> DataFrame:
    """(library, ok, problem): the first that fails of each row's hash from
    its fields, in order, the root over those hashes, and an outside pin.

    ``rows`` are manifest rows with library and the stored row_sha256;
    ``roots`` has library, disk_root, pin. A root is of a whole library by
    definition: one task joins its row hashes, 64 characters a row."""
    h, stored = manifest.row_sha256(), F.coalesce("row_sha256", F.lit(""))
    bad = F.when(stored == "", "row hash missing").when(F.length(stored) != 64, "row hash cut short").when(stored != h, "row differs from its hash")
    each = rows.select("library", order, h.alias("h"), bad.alias("bad"))
    first = F.min_by(F.struct(order, "bad"), F.when(F.col("bad").isNotNull(), F.col(order)))
    hashes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "h"))), lambda x: x["h"]), "\n")
    per = each.groupBy("library").agg(first.alias("first"), F.sha2(hashes, 256).alias("root"))
    pin = F.nullif(F.trim(F.coalesce("pin", F.lit(""))), F.lit(""))
    problem = (
        F.when(F.col("disk_root").isNull(), "root missing").when(F.col("first.bad").isNotNull(), F.concat("first.bad", F.lit(" at "), F.col(f"first.{order}").cast("string")))
        .when(~F.col("root").eqNullSafe(F.trim("disk_root")), "root differs").when(pin.isNotNull() & (F.trim("disk_root") != pin), "pin differs")
    )
    return roots.join(per, "library", "left").select("library", problem.isNull().alias("ok"), F.coalesce(problem, F.when(pin.isNull(), "no pin").otherwise("")).alias("problem"))


def intake(new: DataFrame, old: DataFrame, root_ok: DataFrame) -> DataFrame:
    """(request, id, version, problem) of parts to be added (request, library,
    id, seq, expect_length): the library must verify, letters be bases, the
    length be as expected. Versions go on from the newest, in order of
    requests, so that no two of one id and library are alike."""
    last = old.groupBy("library", "id").agg(F.max("version").alias("v"))
    met = new.join(root_ok.select("library", "ok"), "library", "left").join(last, ["library", "id"], "left")
    s = F.upper(F.coalesce("seq", F.lit("")))
    problem = F.when(~F.coalesce("ok", F.lit(False)), "library does not verify").when(s == "", "no bases").when(~S.valid_alphabet(s), "letters that are no bases").when(F.length(s) != F.col("expect_length"), "length differs")
    judged = met.withColumn("problem", problem)
    number = F.count_if(F.col("problem").isNull()).over(Window.partitionBy("library", "id").orderBy("request").rowsBetween(Window.unboundedPreceding, 0))
    return judged.withColumn("number", number).select("request", "id", F.when(F.col("problem").isNull(), F.coalesce("v", F.lit(0)) + F.col("number")).alias("version"), "problem")


def pending(paths: DataFrame) -> DataFrame:
    """(library, pending): part files (library, path) below a folder whose
    name begins with an underscore."""
    return paths.groupBy("library").agg(F.count_if(F.col("path").rlike(r"(^|/)_[^/]*/") & F.col("path").rlike(r"(?i)\.gb$")).alias("pending"))


def searched(library: DataFrame, terms: list[str]) -> DataFrame:
    """(term, match, id, version) of manifest rows whose id is a term or has
    it inside, in either case. Terms are the few that a user typed; rows meet
    them where they are read."""
    low = F.lower("id")
    found = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t.lower())), F.struct(F.lit(t).alias("term"), F.when(low == t.lower(), "exact").otherwise("near").alias("match"))) for t in terms]))
    return library.select(F.explode(found).alias("f"), "id", "version").select("f.term", "f.match", "id", "version")


def rebuild_plan(blocks: DataFrame, have: DataFrame) -> DataFrame:
    """(record, ordinal, id, role, registry, how): a block's part is reused if
    the library has it, fetched if it has a registry name, else it blocks."""
    met = blocks.join(have.select(F.col("id").alias("ident"), F.lit(True).alias("held")).distinct(), "ident", "left")
    some, fetch = F.col("ident").isNotNull(), F.coalesce(F.upper("registry").startswith("BBA_"), F.lit(False))
    how = F.when(some & F.col("held").isNotNull(), "reuse").when(some & fetch, "fetch").when(some, "blocked: no source").otherwise("blocked: unresolved")
    name = F.coalesce("ident", F.concat(F.lit("UNRESOLVED_"), F.col("start").cast("string"), F.lit("_"), F.col("end").cast("string")))
    return met.select("record", "ordinal", name.alias("id"), F.coalesce("ident_role", "claim_role", F.lit("misc_feature")).alias("role"), F.when(how == "fetch", F.col("registry")).alias("registry"), how.alias("how"))


def rebuild_status(plan: DataFrame, steps: DataFrame) -> DataFrame:
    """(record, status): blocked-unresolved if any part has no source, else by
    the exit codes of steps (record, seal_code, build_code); a build that asks
    for review has built."""
    per = plan.groupBy("record").agg(F.bool_or(F.startswith("how", F.lit("blocked"))).alias("blocked"))
    met = per.join(steps, "record", "left")
    status = F.when(F.col("blocked"), "blocked-unresolved").when(F.coalesce("seal_code", F.lit(1)) != 0, "seal-failed").when(~F.coalesce(F.col("build_code").isin(0, 5), F.lit(False)), "build-failed").otherwise("rebuilt")
    return met.select("record", status.alias("status"))


def codon_gate(parts: DataFrame, adapted: DataFrame, have_table: bool = True) -> DataFrame:
    """(construct, part, level, said) of the codon use of designed coding parts
    (construct, part, class, role, seq) by their adaptation (gene, cai); one
    row for a construct without any, and a warning where no table is at hand."""
    designed = (F.col("class") == "designed") & F.col("role").isin("cds", "reporter")
    none = parts.groupBy("construct").agg(F.count_if(designed).alias("n")).where("n = 0").select("construct", F.lit(None).cast("string").alias("part"), F.lit("INFO").alias("level"), F.lit("no designed coding part").alias("said"))
    asked = parts.where(designed)
    if not have_table:
        skipped = asked.select("construct", F.lit(None).cast("string").alias("part"), F.lit("WARN").alias("level"), F.lit("codon use not checked").alias("said")).distinct()
        return none.unionByName(skipped)
    met = asked.where(F.length("seq") >= 6).join(adapted.select(F.col("gene").alias("part"), "cai"), "part")
    level = F.when(F.col("cai") < CAI_BLOCK, "BLOCK").when(F.col("cai") < CAI_WARN, "WARN").otherwise("INFO")
    return none.unionByName(met.select("construct", F.col("part").cast("string").alias("part"), level.alias("level"), F.format_string("%.3f", "cai").alias("said")).distinct())


def genome_gate(builds: DataFrame, genomes: DataFrame) -> DataFrame:
    """(construct, level, said) of builds (construct, host) whose host has no
    genome among ``genomes`` (host), naming those at hand; genomes are few."""
    names = F.array_join(F.array_sort(F.collect_set("host")), ", ")
    at_hand = genomes.agg(names.alias("x")).select("x").scalar()
    missing = builds.join(genomes.select("host").distinct(), "host", "left_anti")
    return missing.select("construct", F.lit("WARN").alias("level"), F.concat(F.lit("off-target not checked; genomes: "), at_hand).alias("said"))


def order_rows(pieces: DataFrame, heads: DataFrame) -> DataFrame:
    """The order form's columns of pieces (construct, name, role, sequence,
    note) under heads (construct, version, host, vector, assembly_method), and
    ``oversize`` where a sheet's cell can't show the bases."""
    bases = F.upper(F.coalesce("sequence", F.lit("")))
    rows = pieces.join(heads, "construct", "left").withColumn("sequence", bases).withColumn("length_bp", F.length("sequence")).withColumn("seq_sha256", F.sha2("sequence", 256))
    blank = {"name", "role", "host", "vector", "assembly_method", "note"}
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in blank else F.col(c) for c in ORDER_COLUMNS], (F.col("length_bp") > CELL_LIMIT).alias("oversize"))


def write_order(rows: DataFrame, path: str) -> None:
    """Comma-separated files with headers; quotes doubled, lines ended by CRLF."""
    rows.select(*[F.col(c).cast("string") for c in ORDER_COLUMNS]).write.option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\r\n").csv(path)


def result_json(heads: DataFrame, findings: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One JSON text for each head with its findings, worst first and then in
    ``order``."""
    fields = [c for c in findings.columns if c != key]
    rows = F.array_sort(F.collect_list(F.struct(audit.severity().alias("_rank"), *order, *[c for c in fields if c not in order])))
    per = findings.groupBy(key).agg(rows.alias("findings"))
    met = heads.join(per, key, "left")
    plain = F.transform(F.coalesce("findings", F.array().cast(per.schema["findings"].dataType)), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    return met.select(key, F.to_json(F.struct(*[F.col(c) for c in heads.columns], plain.alias("findings")), {"ignoreNullFields": "false"}).alias("json"))


def report_rows(blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """Each block (record, start, end) in order with the worst status of the
    findings (record, loc, status) at its very place, and how many there are."""
    loc = F.concat(F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    worst = findings.groupBy("record", "loc").agg(F.min_by("status", audit.severity()).alias("worst"), F.count("*").alias("n"))
    met = blocks.withColumn("loc", loc).join(worst, ["record", "loc"], "left")
    return met.select("record", "start", "end", F.row_number().over(Window.partitionBy("record").orderBy("start", "end")).alias("ordinal"), F.coalesce("worst", F.lit("PASS")).alias("worst"), F.coalesce("n", F.lit(0)).cast("long").alias("findings"))


def tally(findings: DataFrame) -> DataFrame:
    """(record, line): how many findings of each status, worst first; skipped
    checks are called not checked."""
    words = {"FAIL": "fail", "FLAG": "flag", "SKIP": "NOT CHECKED", "NOTE": "note", "PASS": "pass"}
    counts = findings.groupBy("record").agg(*[F.count_if(F.col("status") == s).alias(s) for s in audit.RANK])
    parts = [F.when(F.col(s) > 0, F.concat(F.col(s).cast("string"), F.lit(f" {words[s]}"))) for s in audit.RANK]
    return counts.select("record", F.concat_ws(", ", *parts).alias("line"))


def first_sites(seq: Column | str, motif: str, shown: int = 6) -> Column:
    """The first places (1-based) of a site, and an ellipsis if there are more."""
    text = lambda at: F.array_join(F.transform(F.slice(at, 1, shown), lambda x: (x + 1).cast("string")), ", ")
    said = lambda at: F.concat(text(at), F.when(F.size(at) > shown, ", …").otherwise(""))
    return F.get(F.transform(F.array(S.first_positions(seq, motif, shown + 1)), said), F.lit(0))


def genome_checks(records: DataFrame, least: int = 1000) -> DataFrame:
    """(genome, records, bases, ok): how many sequences (genome, header, seq)
    a genome has, their bases, and whether they suffice and name the organism
    (genome, organism is a column of each)."""
    per = records.groupBy("genome").agg(F.count("*").alias("records"), F.sum(F.length(F.regexp_replace(F.upper("seq"), "[^ACGTN]", ""))).alias("bases"), F.bool_or(F.contains(F.lower("header"), F.lower("organism"))).alias("named"))
    return per.select("genome", "records", "bases", ((F.col("bases") >= least) & F.col("named")).alias("ok"))
