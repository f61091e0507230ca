"""Queries for the checks around a build, each with the same result in SQL.
Their inputs are the parts and constructs of ``reference_queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.functions import sequence as S
from helixloom.operators import assembly, audit, codon, decompose, gates, manifest
from helixloom.operators.identify import sided
from helixloom.operators.lineage import dealt
from helixloom.plans.reference_queries import BLOCKS_SQL, BROADCAST_NAMES, FOUND_SQL, INSERTS_SQL, LINES_SQL, PARTS_SQL, SEALED_SQL, blocks, lines, parts, query, read, sealed, sites_sql, spelt_lines

BUILDS_SQL = INSERTS_SQL + """, trims AS (SELECT part, CASE WHEN part % 5 = 0 THEN substr(seq, 93, 4) WHEN part % 31 = 0 THEN 'NNNN' END AS t3, CASE WHEN part % 7 = 0 THEN substr(seq, 1, 3) END AS t5 FROM parts),
  ord AS (SELECT construct, position, part, part % 41 <> 0 AS listed, CASE WHEN part % 41 = 0 OR part % 31 = 0 AND part % 5 <> 0 THEN NULL ELSE substr(seq, 1 + coalesce(length(t5), 0), 96 - coalesce(length(t5), 0) - coalesce(length(t3), 0)) END AS cut,
    CASE WHEN part % 41 <> 0 THEN 96 + (part % 43 = 0)::INT - coalesce(length(t5), 0) - coalesce(length(t3), 0) END AS expected FROM lines JOIN trims USING (part)),
  made AS (SELECT construct, CASE WHEN construct % 17 = 0 THEN '' WHEN construct % 13 = 0 THEN substr(string_agg(cut, '' ORDER BY position, part), 2) ELSE string_agg(cut, '' ORDER BY position, part) END AS insert FROM ord GROUP BY construct)"""


def ordered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, k = parts(spark, sf_dir), F.col("part")
    order = lines(spark, sf_dir).select("construct", "position", "part")
    listed = p.where(k % 41 != 0).select("part", "seq", (F.length("seq") + F.when(k % 43 == 0, 1).otherwise(0)).alias("length"))
    trims = p.select("part", F.when(k % 5 == 0, F.substr("seq", F.lit(93), F.lit(4))).when(k % 31 == 0, "NNNN").alias("three_prime"), F.when(k % 7 == 0, F.substr("seq", F.lit(1), F.lit(3))).alias("five_prime"))
    got = dealt(gates.ordered_parts(order, listed, trims), "construct", read(spark, sf_dir, "lineitem").count())
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "part", "cut"))), lambda x: F.coalesce(x["cut"], F.lit(""))), "")
    made = got.groupBy("construct").agg(whole.alias("w"))
    return got, made.select("construct", F.when(F.col("construct") % 17 == 0, "").when(F.col("construct") % 13 == 0, F.substr("w", F.lit(2))).otherwise(F.col("w")).alias("insert"))


@query(f"""WITH {BUILDS_SQL}, g AS (SELECT construct, bool_and(listed) AS everything, bool_and(cut IS NOT NULL) AS cuts, sum(expected) AS n FROM ord GROUP BY construct), m AS (SELECT * FROM g JOIN made USING (construct))
  SELECT DISTINCT construct, 'part not listed' AS rule, 'BLOCK' AS level, part::VARCHAR AS part FROM ord WHERE NOT listed
  UNION ALL SELECT DISTINCT construct, 'trim not found', 'BLOCK', part::VARCHAR FROM ord JOIN m USING (construct) WHERE everything AND cut IS NULL
  UNION ALL SELECT construct, 'empty insert', 'BLOCK', NULL FROM m WHERE everything AND cuts AND insert = ''
  UNION ALL SELECT construct, 'length differs', 'BLOCK', NULL FROM m WHERE everything AND cuts AND insert <> '' AND length(insert) <> n
  UNION ALL SELECT DISTINCT construct, 'part not in insert', 'BLOCK', part::VARCHAR FROM ord JOIN m USING (construct) WHERE everything AND cuts AND insert <> '' AND NOT contains(insert, cut)""")
def build_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.build_findings(*ordered(spark, sf_dir))


@query(f"""WITH {INSERTS_SQL}, w AS (SELECT construct, sha256(insert) AS want, CASE WHEN construct % 7 = 0 THEN NULL WHEN construct % 5 = 0 THEN reverse(insert) ELSE lower(insert) END AS seq FROM inserts)
  SELECT * FROM (SELECT construct, CASE WHEN seq IS NULL THEN 'nothing read back' WHEN sha256(upper(seq)) <> want THEN 'hash differs' END AS problem FROM w) WHERE problem IS NOT NULL""")
def read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, insert = F.col("construct"), F.col("insert")
    return gates.read_back(assembly.inserts(lines(spark, sf_dir)).select("construct", F.sha2("insert", 256).alias("want"), F.when(k % 7 == 0, None).when(k % 5 == 0, F.reverse(insert)).otherwise(F.lower(insert)).alias("seq")))


RUNS_SQL = """rec AS (SELECT o_orderkey AS record, 300 + (o_orderkey % 200)::INT AS length, o_orderkey % 9 <> 0 AS ran, CASE WHEN o_orderkey % 18 = 0 THEN 'no time' END AS reason, CASE WHEN o_orderkey % 8 = 0 THEN 'tool missing' ELSE '' END AS deep_failed FROM orders),
  b AS (SELECT l_orderkey AS record, l_linenumber * 60 + 1 AS start, l_linenumber * 60 + 40 + (l_partkey % 15)::INT AS "end", CASE WHEN l_partkey % 4 <> 0 THEN 'r' || (l_partkey % 50) END AS ident, l_partkey FROM lineitem WHERE l_orderkey % 6 <> 0),
  cap AS (SELECT record, coalesce(ident, 'none') AS ref, max(l_partkey % 11) AS places FROM b GROUP BY ALL),
  acc AS (SELECT record, length, coalesce(sum("end" - start + 1), 0) AS accounted, count(start) AS n, any_value(ran) AS ran, any_value(reason) AS reason, any_value(deep_failed) AS deep_failed FROM rec LEFT JOIN b USING (record) GROUP BY record, length)"""


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    k, p, n = F.col("o_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    o = read(spark, sf_dir, "orders")
    records = o.select(k.alias("record"), (300 + k % 200).cast("int").alias("length"))
    status = o.select(k.alias("record"), (k % 9 != 0).alias("ran"), F.when(k % 18 == 0, "no time").alias("reason"), F.when(k % 8 == 0, "tool missing").otherwise("").alias("deep_failed"))
    b = read(spark, sf_dir, "lineitem").where("l_orderkey % 6 <> 0").select(F.col("l_orderkey").alias("record"), (n * 60 + 1).alias("start"), (n * 60 + 40 + (p % 15).cast("int")).alias("end"), F.when(p % 4 != 0, F.concat(F.lit("r"), (p % 50).cast("string"))).alias("ident"), "l_partkey")
    capped = b.groupBy("record", F.coalesce("ident", F.lit("none")).alias("ref")).agg(F.max(p % 11).alias("places"))
    return records, b.drop("l_partkey"), status, capped


@query(f"""WITH {RUNS_SQL}, named AS (SELECT record, ref, places, row_number() OVER (PARTITION BY record ORDER BY places DESC, ref) AS i FROM cap WHERE places > 4 AND ref <> 'none')
  SELECT record, 'identification' AS category, 'FLAG' AS status, coalesce(reason, 'the caller reported it did not run') AS said FROM acc WHERE NOT ran
  UNION ALL SELECT record, 'deep-search', 'FLAG', deep_failed FROM acc WHERE deep_failed <> ''
  UNION ALL SELECT record, 'invariant', 'FLAG', CASE WHEN ran THEN 'nothing matched' ELSE 'not run' END FROM acc WHERE n = 0
  UNION ALL SELECT record, 'decomposition', 'NOTE', (length - accounted) || ' of ' || length FROM acc WHERE length > accounted
  UNION ALL SELECT record, 'identification-partial', 'FLAG', string_agg(ref || ' (' || places || ' places)', ', ' ORDER BY i) FROM named WHERE i <= 4 GROUP BY record""")
def run_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.run_findings(*runs(spark, sf_dir))


@query(f"""WITH {RUNS_SQL} SELECT record, accounted::BIGINT AS accounted, greatest(length - accounted, 0)::BIGINT AS unaccounted FROM acc""")
def accounted_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, b, _, _ = runs(spark, sf_dir)
    return gates.accounted(b, records)


@query("""WITH h AS (SELECT o_orderkey AS record, o_orderkey % 5 <> 0 AS has_host, o_orderkey % 3 = 0 AS reca_minus, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey * 37 % 1100)::INT END AS longest FROM orders), n AS (SELECT *, coalesce(longest, 0) AS n FROM h)
  SELECT record, 'host-homology' AS category, CASE WHEN NOT has_host THEN 'SKIP' WHEN n >= 500 THEN 'FLAG' WHEN n > 40 THEN CASE WHEN reca_minus THEN 'NOTE' ELSE 'FLAG' END ELSE 'PASS' END AS status,
    CASE WHEN NOT has_host THEN 'not run' WHEN n <= 40 THEN 'none over 40 bp' WHEN n >= 1000 THEN 'at least ' || n || ' bp' ELSE n || ' bp' END AS said FROM n""")
def host_homology(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return gates.homology_findings(read(spark, sf_dir, "orders").select(k.alias("record"), (k % 5 != 0).alias("has_host"), (k % 3 == 0).alias("reca_minus"), F.when(k % 7 != 0, (k * 37 % 1100).cast("int")).alias("longest")))


NESTED_SQL = """b AS (SELECT l_orderkey AS record, l_linenumber * 100 AS start, l_linenumber * 100 + 60 + (l_partkey % 40)::INT AS "end" FROM lineitem WHERE l_linenumber % 2 = 1),
  c AS (SELECT DISTINCT l_orderkey AS record, CASE WHEN l_partkey % 10 = 0 THEN '' ELSE 'BBa_P' || (l_partkey % 90) END AS claim, CASE WHEN l_partkey % 14 = 0 THEN 'source' ELSE 'cds' END AS kind, l_linenumber * 100 + 10 AS start, l_linenumber * 100 + 30 + (l_suppkey % 70)::INT AS "end", l_suppkey % 6 = 0 AS used FROM lineitem),
  rest AS (SELECT record, claim, kind, start, "end", EXISTS (SELECT 1 FROM b WHERE b.record = c.record AND b.start <= c.start AND b."end" >= c."end") AS inside FROM c WHERE NOT used AND kind NOT IN ('source', 'misc')),
  hits AS (SELECT DISTINCT r.record, r.start, r."end", 'p' || ((substr(claim, 6)::INT + h * 7) % 90) AS ref, 100.0 - (h * (r.start % 3)) * 0.02 AS pident, 1.0 - h * 0.015 AS cov FROM (SELECT * FROM rest WHERE inside AND claim <> '') r, (SELECT unnest([0, 1, 2]) AS h) WHERE r.start % 4 <> 2)"""


def nested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    l, p, n, supp = read(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")  # noqa: E741
    b = l.where(n % 2 == 1).select(F.col("l_orderkey").alias("record"), (n * 100).alias("start"), (n * 100 + 60 + (p % 40).cast("int")).alias("end"))
    c = l.select(F.col("l_orderkey").alias("record"), F.when(p % 10 == 0, "").otherwise(F.concat(F.lit("BBa_P"), (p % 90).cast("string"))).alias("claim"), F.when(p % 14 == 0, "source").otherwise("cds").alias("kind"), (n * 100 + 10).alias("start"), (n * 100 + 30 + (supp % 70).cast("int")).alias("end"), (supp % 6 == 0).alias("used")).distinct()
    inside, alone = gates.inner_claims(c, b)
    h = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("h")
    hits = inside.where("claim <> '' and start % 4 <> 2").select("record", "start", "end", "claim", h)
    number = F.substr("claim", F.lit(6)).cast("int")
    hits = hits.select("record", "start", "end", F.concat(F.lit("p"), ((number + F.col("h") * 7) % 90).cast("string")).alias("ref"), (100.0 - F.col("h") * (F.col("start") % 3) * 0.02).alias("pident"), (1.0 - F.col("h") * 0.015).alias("cov")).distinct()
    return inside, alone, hits


@query(f"WITH {NESTED_SQL} SELECT * FROM rest")
def inner_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside, alone, _ = nested(spark, sf_dir)
    return inside.withColumn("inside", F.lit(True)).unionByName(alone.withColumn("inside", F.lit(False)))


@query(f"""WITH {NESTED_SQL}, top AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY record, start, "end" ORDER BY cov DESC, pident DESC, ref) = 1),
  al AS (SELECT h.record, h.start, h."end", list(DISTINCT upper(h.ref)) AS names FROM hits h JOIN top t USING (record, start, "end") WHERE abs(h.pident - t.pident) < 0.05 AND abs(h.cov - t.cov) < 0.02 GROUP BY ALL),
  i AS (SELECT r.record, r.start, r."end", claim, t.ref AS ident, names, upper(replace(claim, 'BBa_', '')) AS k FROM (SELECT * FROM rest WHERE inside) r LEFT JOIN top t USING (record, start, "end") LEFT JOIN al USING (record, start, "end"))
  SELECT record, start, "end", claim, CASE WHEN ident IS NULL THEN 'identity-nested' ELSE 'identity-mislabel' END AS category, CASE WHEN ident IS NULL THEN 'SKIP' ELSE 'FLAG' END AS status FROM i
  WHERE claim <> '' AND (ident IS NULL OR NOT (contains(k, upper(ident)) OR coalesce(list_contains(names, k), false)))""")
def nested_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside, _, hits = nested(spark, sf_dir)
    return gates.nested_findings(gates.nested_idents(inside, hits))


ROOTS_SQL = SEALED_SQL + """, libs AS (SELECT part % 7 AS library, version, row_sha256 AS h, CASE WHEN part % 7 = 1 AND part % 10 = 5 THEN substr(row_sha256, 1, 26) WHEN part % 7 = 2 AND part % 10 = 5 THEN reverse(row_sha256) WHEN part % 7 = 3 AND part % 10 = 5 THEN '' ELSE row_sha256 END AS row_sha256 FROM hashed),
  per AS (SELECT library, sha256(string_agg(h, chr(10) ORDER BY version)) AS root, arg_min(CASE WHEN row_sha256 = '' THEN 'row hash missing' WHEN length(row_sha256) <> 64 THEN 'row hash cut short' ELSE 'row differs from its hash' END || ' at ' || version, version) FILTER (row_sha256 <> h) AS bad FROM libs GROUP BY library),
  roots AS (SELECT library, CASE library WHEN 4 THEN md5(root) WHEN 6 THEN NULL ELSE root END AS disk_root, CASE WHEN library = 5 THEN md5('x') WHEN library % 2 = 0 THEN root ELSE '' END AS pin FROM per),
  said AS (SELECT library, CASE WHEN disk_root IS NULL THEN 'root missing' WHEN bad IS NOT NULL THEN bad WHEN root <> disk_root THEN 'root differs' WHEN pin <> '' AND disk_root <> pin THEN 'pin differs' END AS problem, pin FROM roots JOIN per USING (library)),
  checked AS (SELECT library, problem IS NULL AS ok, coalesce(problem, CASE WHEN pin = '' THEN 'no pin' ELSE '' END) AS problem FROM said)"""


def root_inputs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seven libraries, six of them spoilt in one way each, and their roots."""
    k = F.col("part")
    rows = rows.withColumn("library", k % 7).withColumn("h", manifest.row_sha256())
    hit = k % 10 == 5
    stored = rows.withColumn("row_sha256", F.when((F.col("library") == 1) & hit, F.substring("h", 1, 26)).when((F.col("library") == 2) & hit, F.reverse("h")).when((F.col("library") == 3) & hit, "").otherwise(F.col("h")))
    per = rows.groupBy("library").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("version", "h"))), lambda x: x["h"]), "\n"), 256).alias("root"))
    n = F.col("library")
    given = per.select("library", F.when(n == 4, F.md5("root")).when(n != 6, F.col("root")).alias("disk_root"), F.when(n == 5, F.md5(F.lit("x"))).when(n % 2 == 0, F.col("root")).otherwise("").alias("pin"))
    return stored, given


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.root_checks(*root_inputs(sealed(spark, sf_dir)), "version")


@query(f"WITH {ROOTS_SQL} SELECT * FROM checked")
def root_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roots(spark, sf_dir)


@query(f"""WITH {ROOTS_SQL}, asked AS (SELECT part AS request, part % 7 AS library, id, CASE part % 8 WHEN 0 THEN '' WHEN 1 THEN 'ACGU' ELSE lower(seq) END AS seq, CASE WHEN part % 8 > 5 THEN 95 ELSE 96 END AS expect_length FROM parts),
  last AS (SELECT part % 7 AS library, id, max(version) AS v FROM sealed GROUP BY ALL),
  j AS (SELECT request, a.library, a.id, coalesce(v, 0) AS v, CASE WHEN NOT ok THEN 'library does not verify' WHEN seq = '' THEN 'no bases' WHEN seq = 'ACGU' THEN 'letters that are no bases' WHEN length(seq) <> expect_length THEN 'length differs' END AS problem
    FROM asked a JOIN checked USING (library) LEFT JOIN last l ON l.library = a.library AND l.id = a.id)
  SELECT request, id, CASE WHEN problem IS NULL THEN v + count_if(problem IS NULL) OVER (PARTITION BY library, id ORDER BY request ROWS UNBOUNDED PRECEDING) END AS version, problem FROM j""")
def part_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("part")
    new = parts(spark, sf_dir).select(k.alias("request"), (k % 7).alias("library"), "id", F.when(k % 8 == 0, "").when(k % 8 == 1, "ACGU").otherwise(F.lower("seq")).alias("seq"), F.when(k % 8 > 5, 95).otherwise(96).alias("expect_length"))
    return gates.intake(new, sealed(spark, sf_dir).withColumn("library", k % 7), roots(spark, sf_dir))


@query(f"""WITH {SEALED_SQL}, n AS (SELECT CASE WHEN part % 50 = 7 THEN 'Green' ELSE id END AS id, version FROM sealed), t AS (SELECT unnest(['GREEN', 'e']) AS term) SELECT term, CASE WHEN lower(id) = lower(term) THEN 'exact' ELSE 'near' END AS match, id, version FROM n JOIN t ON contains(lower(id), lower(term))""")
def library_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.searched(sealed(spark, sf_dir).withColumn("id", F.when(F.col("part") % 50 == 7, "Green").otherwise(F.col("id"))), ["GREEN", "e"])


@query(f"""WITH {PARTS_SQL}, f AS (SELECT part % 5 AS library, CASE WHEN part % 3 = 0 THEN 'lib/_new/' WHEN part % 3 = 1 THEN 'lib/a_b/' ELSE '_x/' END || part || CASE WHEN part % 4 = 0 THEN '.txt' ELSE '.gb' END AS path FROM parts)
  SELECT library, count_if(path LIKE '%.gb' AND NOT contains(path, 'a_b')) AS pending FROM f GROUP BY library""")
def pending_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("part")
    folder = F.when(k % 3 == 0, "lib/_new/").when(k % 3 == 1, "lib/a_b/").otherwise("_x/")
    return gates.pending(parts(spark, sf_dir).select((k % 5).alias("library"), F.concat(folder, k.cast("string"), F.when(k % 4 == 0, ".txt").otherwise(".gb")).alias("path")))


PLAN_SQL = BLOCKS_SQL + """, pl AS (SELECT record, block AS ordinal, coalesce(ident, 'UNRESOLVED_' || (block * 10) || '_' || (block * 10 + 9)) AS id, coalesce(CASE WHEN block % 3 = 0 THEN role END, CASE WHEN block % 2 = 0 THEN 'gene' END, 'misc_feature') AS role,
    CASE WHEN substr(ident, 5)::INT % 4 = 1 THEN 'reuse' WHEN ident IS NOT NULL AND length(seq) > 0 AND substr(ident, 5)::INT % 5 <> 0 THEN 'fetch' WHEN ident IS NOT NULL THEN 'blocked: no source' ELSE 'blocked: unresolved' END AS how FROM blocks)"""


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    n, k = F.col("block"), F.substr("ident", F.lit(5)).cast("int")
    given = b.select("record", n.alias("ordinal"), "ident", F.when(n % 3 == 0, F.col("role")).alias("ident_role"), F.when(n % 2 == 0, "gene").alias("claim_role"), F.when(k % 5 != 0, F.concat(F.lit("bba_"), F.col("ident"))).alias("registry"), (n * 10).alias("start"), (n * 10 + 9).alias("end"))
    have = parts(spark, sf_dir).where("part % 4 = 1").select(F.concat(F.lit("part"), F.col("part").cast("string")).alias("id"))
    return gates.rebuild_plan(given, have)


@query(f"WITH {PLAN_SQL} SELECT record, ordinal, id, role, CASE WHEN how = 'fetch' THEN 'bba_' || id END AS registry, how FROM pl")
def rebuild_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir)


@query(f"""WITH {PLAN_SQL}, p AS (SELECT record, bool_or(how LIKE 'blocked%') AS blocked FROM pl GROUP BY record)
  SELECT record, CASE WHEN blocked THEN 'blocked-unresolved' WHEN record % 5 = 0 THEN 'seal-failed' WHEN record % 4 IN (1, 3) THEN 'build-failed' ELSE 'rebuilt' END AS status FROM p""")
def rebuild_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    steps = read(spark, sf_dir, "orders").select(k.alias("record"), (k % 5 == 0).cast("int").alias("seal_code"), F.when(k % 4 == 0, 0).when(k % 4 == 2, 5).otherwise(1).alias("build_code"))
    return gates.rebuild_status(planned(spark, sf_dir), steps)


@query(f"""WITH {LINES_SQL}, cd AS (SELECT part, substr(seq, i * 3 + 1, 3) AS codon FROM (SELECT part, seq, unnest(range(0, length(seq) // 3)) AS i FROM parts)),
  u AS (SELECT codon, substr('{S.AMINO_ACIDS}', (16 * (instr('TCAG', substr(codon, 1, 1)) - 1) + 4 * (instr('TCAG', substr(codon, 2, 1)) - 1) + instr('TCAG', substr(codon, 3, 1)))::INT, 1) AS family, count(*) AS n FROM cd GROUP BY ALL),
  w AS (SELECT codon, n / max(n) OVER (PARTITION BY family) AS w FROM u), a AS (SELECT part, exp(avg(ln(greatest(w, 0.01)))) AS cai FROM cd JOIN w USING (codon) GROUP BY part),
  d AS (SELECT DISTINCT construct, part FROM lines WHERE role = 'cds' AND part % 3 <> 0)
  SELECT construct, NULL AS part, 'INFO' AS level, 'no designed coding part' AS said FROM (SELECT DISTINCT construct FROM lines) WHERE construct NOT IN (SELECT construct FROM d)
  UNION ALL SELECT construct, part::VARCHAR, CASE WHEN cai < 0.75 THEN 'BLOCK' WHEN cai < 0.80 THEN 'WARN' ELSE 'INFO' END, format('{{:.3f}}', cai) FROM d JOIN a USING (part)""")
def codon_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    usage = p.select(F.explode(S.codons("seq")).alias("codon")).groupBy("codon", S.amino_acid("codon").alias("family")).agg(F.count("*").alias("n"))
    adapted = codon.adaptation(p.select(F.col("part").alias("gene"), "seq"), codon.weights(usage))
    asked = lines(spark, sf_dir).select("construct", "part", F.when(F.col("part") % 3 != 0, "designed").otherwise("reference").alias("class"), "role", "seq")
    return gates.codon_gate(asked, adapted)


@query("""SELECT o_orderkey AS construct, 'WARN' AS level, 'off-target not checked; genomes: host0, host1, host3' AS said FROM orders WHERE o_orderkey % 5 NOT IN (0, 1, 3)""")
def genome_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    builds = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("construct"), F.concat(F.lit("host"), (F.col("o_orderkey") % 5).cast("string")).alias("host"))
    return gates.genome_gate(builds, builds.where("construct % 5 in (0, 1, 3)").select("host").distinct())


@query(f"""WITH {INSERTS_SQL} SELECT 'c' || construct AS name, 'insert' AS role, length(insert) AS length_bp, insert AS sequence, sha256(insert) AS seq_sha256, construct, CASE WHEN construct % 3 <> 0 THEN 2 END AS version, CASE WHEN construct % 3 <> 0 THEN 'h' ELSE '' END AS host, '' AS vector,
  CASE WHEN construct % 3 <> 0 THEN 'Gibson, "quick"' ELSE '' END AS assembly_method, '' AS note, length(insert) > 32767 AS oversize FROM inserts""")
def order_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = assembly.inserts(lines(spark, sf_dir))
    pieces = whole.select("construct", F.concat(F.lit("c"), F.col("construct").cast("string")).alias("name"), F.lit("insert").alias("role"), F.lower("insert").alias("sequence"), F.lit(None).cast("string").alias("note"))
    heads = read(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("construct"), F.lit(2).alias("version"), F.lit("h").alias("host"), F.lit(None).cast("string").alias("vector"), F.lit('Gibson, "quick"').alias("assembly_method"))
    return gates.order_rows(pieces, heads)


RANK_SQL = "CASE status WHEN 'FAIL' THEN 0 WHEN 'FLAG' THEN 1 WHEN 'SKIP' THEN 2 WHEN 'NOTE' THEN 3 WHEN 'PASS' THEN 4 ELSE 9 END"


@query(f"""WITH {FOUND_SQL}, w AS (SELECT record, block, arg_min(status, {RANK_SQL}) AS worst, count(*) AS n FROM found WHERE block % 2 = 0 GROUP BY record, block)
  SELECT record, block * 10 AS start, block * 10 + 9 AS "end", row_number() OVER (PARTITION BY record ORDER BY block) AS ordinal, coalesce(worst, 'PASS') AS worst, coalesce(n, 0) AS findings FROM blocks LEFT JOIN w USING (record, block)""")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, n = blocks(spark, sf_dir), F.col("block")
    place = F.concat((n * 10).cast("string"), F.lit("-"), (n * 10 + 9 + n % 2).cast("string"))
    return gates.report_rows(b.select("record", (n * 10).alias("start"), (n * 10 + 9).alias("end")), audit.block_findings(b).withColumn("loc", place))


@query(f"""WITH {FOUND_SQL}, c AS (SELECT record, status, count(*) AS n, {RANK_SQL} AS rank FROM found GROUP BY ALL)
  SELECT record, string_agg(n || ' ' || CASE status WHEN 'SKIP' THEN 'NOT CHECKED' ELSE lower(status) END, ', ' ORDER BY rank) AS line FROM c GROUP BY record""")
def tally_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.tally(audit.block_findings(blocks(spark, sf_dir)))


@query(f"""WITH {INSERTS_SQL}, p AS (SELECT construct, {sites_sql('insert', 'AC')} AS spots FROM inserts) SELECT construct, array_to_string(spots[1:6], ', ') || CASE WHEN len(spots) > 6 THEN ', …' ELSE '' END AS places FROM p""")
def site_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.inserts(lines(spark, sf_dir)).select("construct", gates.first_sites("insert", "AC").alias("places"))


@query(f"""WITH {PARTS_SQL} SELECT part % 8 AS genome, count(*) AS records, sum(length(seq)) AS bases, sum(length(seq)) >= 1000 AND bool_or(part % 100 = 3) AS ok FROM parts GROUP BY part % 8""")
def genome_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("part")
    return gates.genome_checks(parts(spark, sf_dir).select((k % 8).alias("genome"), F.when(k % 100 == 3, ">1 E. Coli strain").otherwise(">2").alias("header"), F.concat(F.lower("seq"), F.lit("\n-")).alias("seq"), F.lit("e. coli").alias("organism")))


WHOLE_SQL = INSERTS_SQL + """, refs AS (SELECT 'p' || min(part) AS ref, seq FROM parts GROUP BY seq), spots AS (SELECT construct AS record, start::INT AS start, "end"::INT AS "end", part, ref AS ident FROM places JOIN refs USING (seq))"""


def whole_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Constructs as records, one reference for each sequence of parts, and
    labels of the parts: some wrong, some the wrong way round."""
    p, l = parts(spark, sf_dir), spelt_lines(spark, sf_dir)  # noqa: E741
    refs = p.groupBy("seq").agg(F.concat(F.lit("p"), F.min("part").cast("string")).alias("ref"))
    records = assembly.inserts(l).select(F.col("construct").alias("record"), F.col("insert").alias("seq"))
    k = F.col("part")
    labels = assembly.features(l).join(sided(refs, refs.count() <= BROADCAST_NAMES), "seq").select(
        F.col("construct").alias("record"), F.when(k % 4 == 0, "other").otherwise(F.col("ref")).alias("claim"), F.lit("promoter").alias("kind"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.when(k % 9 == 0, -1).otherwise(1).alias("strand")
    )
    return records, refs.select("ref", "seq"), labels


@query(f"""WITH {WHOLE_SQL} SELECT record, start, "end", ident, 1 AS strand, 100.0 AS pident, CASE WHEN part % 4 = 0 THEN 'other' ELSE ident END AS claim FROM spots""")
def identified_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, _ = decompose.decompose(*whole_records(spark, sf_dir))
    return blocks.select(F.col("record").cast("long").alias("record"), "start", "end", "ident", "strand", "pident", "claim")


@query(f"""WITH {WHOLE_SQL} SELECT record, start, "end", 'identity-orientation' AS category, 'FLAG' AS status FROM spots WHERE part % 9 = 0 UNION ALL SELECT record, start, "end", 'identity-mislabel', 'FLAG' FROM spots WHERE part % 4 = 0""")
def identity_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, refs, labels = whole_records(spark, sf_dir)
    blocks, inner = decompose.decomposed(decompose.cut(decompose.texts(records)), refs, labels, False, True)
    found = decompose.identity_findings(blocks, decompose.inner_names(inner, records, refs), records, refs)
    return found.withColumn("record", F.col("record").cast("long"))
