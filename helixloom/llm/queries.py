"""The thin queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hard_negatives, html_text, labelled, mixing, ogg_media, packing, periodic_runs, pitman_yor, quality_gam, sharding, simhash_dedup, toxicity_fm, url_filters
from .common import shared_folder, table

#: Arrivals that a stored table is dealt into.
ARRIVALS = 16


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def judged(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = labelled.fold(3, 1)
    return judged(quality_gam.score(docs, quality_gam.train(docs, labels, held), [F.col("doc_id").cast("long"), held.alias("held_out")]))


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_media.media_features(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = labelled.fold(5, 0)
    return judged(toxicity_fm.score(docs, toxicity_fm.train(docs, labels, held), [F.col("doc_id").cast("long"), held.alias("held_out")]))


def op5_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores ``documents`` as it would arrive, compacts, and reads back."""
    store = sharding.ShardStore(spark, shared_folder(spark, "shards"))
    store.append(table(spark, sf_dir, "documents"), F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS)))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_groups(table(spark, sf_dir, "documents"))


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.language_scores(table(spark, sf_dir, "documents"), labelled.fold(7, 2))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.placements(table(spark, sf_dir, "documents"))


#: Site rules of the URL query: host, path, whether it allows.
SITES = (("com", "/", True), ("example.com", "/en/", False), ("www.example.com", "/en/", True), ("net", "/es/", False), ("net", "/fr/", False))


def op11_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filters.site_rule(*x) for x in SITES] + url_filters.unwanted()
    return url_filters.judge(table(spark, sf_dir, "pages"), rules).drop("by")


def planted(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by their ids' hashes, with periodic ends."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, at(i))), " ")).otherwise("")

    # in an array, so that a text's words are found once
    words = F.array(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    return docs.select("doc_id", F.when(h % 10 == 0, F.get(F.transform(words, periodic), F.lit(0))).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.collapse(planted(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.reduce("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality": op2_quality,
    "op3_ogg": op3_ogg,
    "op4_toxicity": op4_toxicity,
    "op5_compaction": op5_compaction,
    "op6_simhash": op6_simhash,
    "op7_exact": op7_exact,
    "op8_pitman_yor": op8_pitman_yor,
    "op9_html": op9_html,
    "op10_mixing": op10_mixing,
    "op11_url": op11_url,
    "op12_periodic": op12_periodic,
    "op13_negatives": op13_negatives,
}

ORACLES = {
    "op5_compaction": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
    "op7_exact": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op10_mixing": f"""
        WITH RECURSIVE r AS (
          SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS source_rank
          FROM documents),
        n AS (SELECT source, sqrt(count(*)) AS x, (count(*) + {mixing.BLOCK_ROWS - 1}) // {mixing.BLOCK_ROWS} AS blocks FROM documents GROUP BY source),
        t AS (SELECT source, blocks, greatest({mixing.LEAST}, round({mixing.RESOLUTION} * (x / (SELECT sum(x) FROM n))))::BIGINT AS w FROM n),
        l AS (SELECT list(w ORDER BY source NULLS FIRST) AS ws, list(blocks ORDER BY source NULLS FIRST) AS bs, list(source ORDER BY source NULLS FIRST) AS ss, sum(w)::BIGINT AS total FROM t),
        z AS (SELECT max((blocks * total + w - 1) // w)::BIGINT AS slots, greatest({mixing.CYCLE}, max((total + w - 1) // w))::BIGINT AS cycle FROM t, l),
        c AS (
          SELECT cut, i, ws[i] * cut // total AS whole, row_number() OVER (PARTITION BY cut ORDER BY ws[i] * cut % total DESC, i) AS place,
                 cut - sum(ws[i] * cut // total) OVER (PARTITION BY cut) AS ahead
          FROM (SELECT unnest(range(0, slots // cycle + 1)) * cycle + cycle AS cut FROM z), (SELECT unnest(range(1, len(ws) + 1)) AS i FROM l), l),
        b AS (SELECT cut, list(least(bs[i], whole + (place <= ahead)::BIGINT)::BIGINT ORDER BY i) AS last FROM c, l GROUP BY cut),
        e AS (
          SELECT 0::BIGINT AS slot, list_transform(ws, lambda x: 0::BIGINT) AS done, 0::BIGINT AS i FROM l
          UNION ALL
          SELECT slot + 1, list_transform(range(1, len(ws) + 1), lambda j: CASE WHEN j = g.i THEN done[j] + 1 ELSE done[j] END), g.i
          FROM e, l, z, b, LATERAL (
            SELECT list_min(list_transform(range(1, len(ws) + 1), lambda j:
              CASE WHEN done[j] < last[j] AND done[j] * total // ws[j] <= slot
                   THEN {{'due': least(cut, ((done[j] + 1) * total + ws[j] - 1) // ws[j]), 'i': j}} END)).i AS i) g
          WHERE slot < slots AND cut = slot // cycle * cycle + cycle),
        k AS (SELECT ss[i] AS source, ws[i] AS w, total, slot - 1 AS slot, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS block FROM e, l WHERE i > 0)
        SELECT r.doc_id, r.source, r.source_rank, k.block, k.block * k.total // k.w AS release, ((k.block + 1) * k.total + k.w - 1) // k.w AS due, k.slot
        FROM r JOIN k ON r.source IS NOT DISTINCT FROM k.source AND r.source_rank // {mixing.BLOCK_ROWS} = k.block""",
    "op11_url": f"""
        WITH u AS (
          SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        r(h, p, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{'allow' if a else 'block'}')" for h, p, a in SITES)}),
        f AS (SELECT *, (SELECT arg_max(struct_pack(rule := h || p, verdict := verdict), length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS x FROM u)
        SELECT page_id, host, path, x.rule AS rule,
               coalesce(x.verdict, CASE WHEN regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])({"|".join(url_filters.UNWANTED)})([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
        FROM f""",
    "op12_periodic": r"""
        WITH t0 AS (SELECT list_transform(range(256), lambda x: x::BIGINT) AS t),
        """
    + ", ".join(f"t{k + 1} AS (SELECT list_transform(t, lambda x: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS t FROM t{k})" for k in range(8))
    + r""",
        h AS (
          SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
                 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
          FROM documents, t8),
        g AS (SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS planted FROM h),
        a AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM g),
        p AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
        d AS (SELECT rid, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM p),
        words AS (SELECT rid, n, unnest(range(n)) AS i, unnest(w) AS word FROM d),
        same AS (SELECT x.rid, y.i - x.i AS p, x.i FROM words x JOIN words y ON x.rid = y.rid AND x.word = y.word AND x.i < y.i AND 3 * (y.i - x.i) <= x.n),
        islands AS (SELECT rid, p, min(i) AS start, count(*) + p AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS k FROM same) GROUP BY rid, p, k),
        runs AS (SELECT rid, start, length, min(p) AS period FROM islands WHERE length >= greatest(24, 3 * p) GROUP BY rid, start, length),
        best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length::DECIMAL(38, 18) / period DESC, start, period) = 1),
        per AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY rid),
        gone AS (SELECT DISTINCT w.rid, w.i FROM words w JOIN runs r ON r.rid = w.rid AND w.i >= r.start + r.period AND w.i < r.start + r.length),
        kept AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
        FROM d LEFT JOIN per USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)""",
    "op13_negatives": """
        WITH v AS (
          SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
          FROM embeddings
          WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.id % 50 = 0 AND c.id <> a.id),
        p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
        SELECT anchor_id, positive_id, row_number() OVER w AS rank, s.id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.id) QUALIFY row_number() OVER w <= 3""",
}
