"""Sealed parts: hashes, pins, versions and the audit of a parts library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: the fields under a row's hash, in order.
FIELDS = ("id", "version", "seq_sha256", "file_sha256", "length", "source", "date", "class", "outfile")


def seq_sha256(seq: Column | str) -> Column:
    return F.sha2(F.upper(F.col(seq) if isinstance(seq, str) else seq), 256)


def row_sha256() -> Column:
    """Of ``key=value`` lines over FIELDS; a null is an empty value."""
    return F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in FIELDS]), 256)


def root(rows: DataFrame, order: str) -> DataFrame:
    """One row ``root``: the hash over all row hashes in file order. A root
    is of the whole list by definition; a row adds 64 characters."""
    hashes = F.array_sort(F.collect_list(F.struct(order, row_sha256().alias("h"))))
    return rows.agg(F.sha2(F.array_join(F.transform(hashes, lambda x: x["h"]), "\n"), 256).alias("root"))


def filename_sha12(path: Column | str) -> Column:
    """The twelve hex digits that end a sealed file's name, or empty."""
    p = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(F.element_at(F.split(p, "/"), -1), r"(?:^|__)([0-9A-Fa-f]{12})(?:\.[^.]*)?$", 1))


def broken_rows(rows: DataFrame, order: str) -> DataFrame:
    """Rows whose stored ``row_sha256`` is missing, cut short or wrong."""
    stored = F.coalesce(F.col("row_sha256"), F.lit(""))
    problem = F.when(stored == "", "no row hash").when(F.length(stored) < 64, "row hash cut short").when(stored != row_sha256(), "row hash differs")
    return rows.withColumn("problem", problem).where("problem is not null").select(order, "id", "version", "problem")


def by_prefix(rows: DataFrame, sha: str, pins: DataFrame) -> DataFrame:
    """``rows`` once for each length of a ``pin`` in ``pins``, with that much of
    the hash as ``pin``, so that pins meet hashes by equality. Lengths are few:
    a hash has 64 digits. A null hash has the empty prefix alone."""
    sizes = F.broadcast(pins.select(F.length("pin").alias("_n")).where("_n between 0 and 64").distinct())
    each = rows.join(sizes, (F.col("_n") == 0) | (F.col("_n") <= F.length(sha)))
    return each.withColumn("pin", F.when(F.col("_n") == 0, "").otherwise(F.substr(F.col(sha), F.lit(1), F.col("_n")))).drop("_n")


def resolve(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each request (request_id, id, pin, version) with the one row it names.

    The id is an equality, the pin a prefix of the hash, the version an
    equality where given. ``status`` is ok, missing or ambiguous. Rows are
    counted by id, prefix and version before a request meets them, so that an
    id may have many rows and many requests.
    """
    asked = requests.select("request_id", F.col("id").alias("m_id"), F.lower(F.coalesce(F.col("pin").cast("string"), F.lit(""))).alias("pin"), F.col("version").alias("asked"))
    m = manifest.where("seq_sha256 is not null").select(F.col("id").alias("m_id"), F.col("version").alias("m_version"), "seq_sha256")
    rows = by_prefix(m, "seq_sha256", asked).groupBy("m_id", "pin", "m_version").agg(F.count("*").alias("n"), F.max("seq_sha256").alias("sha"))
    any_ = rows.groupBy("m_id", "pin").agg(F.sum("n").alias("n"), F.max("m_version").alias("m_version"), F.max("sha").alias("sha"))
    dated = asked.where("asked is not null").alias("a").join(rows.alias("m"), (F.col("a.m_id") == F.col("m.m_id")) & (F.col("a.pin") == F.col("m.pin")) & (F.col("asked") == F.col("m_version")), "left")
    met = dated.select("request_id", "n", "m_version", "sha").unionByName(asked.where("asked is null").join(any_, ["m_id", "pin"], "left").select("request_id", "n", "m_version", "sha"))
    found = met.groupBy("request_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("m_version").alias("resolved_version"), F.max("sha").alias("sha"))
    status = F.when(F.col("n") == 1, "ok").when(F.col("n") == 0, "missing").otherwise("ambiguous")
    one = F.col("n") == 1
    return found.select("request_id", status.alias("status"), F.when(one, F.col("resolved_version")).alias("resolved_version"), F.when(one, F.col("sha")).alias("seq_sha256"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def selected(requests: DataFrame, manifest: DataFrame, need_version: bool = False) -> DataFrame:
    """Each request (request_id, id, pin, version, lib) with the one row it
    asks for: (request_id, problem, note, version, seq_sha256, file_sha256,
    outfile), the row's fields null where there is a problem.

    The file named by ``lib`` narrows an id's rows if it is one of theirs; if
    it isn't, the note says so and the pin decides. Version and pin, a prefix of
    the hash in either case, have to fit; empty ones ask for nothing. One row
    must be left, with a number for a version and a name that agrees with its
    hash. With ``need_version`` a request without one is refused.

    An id's rows are counted by file, version and prefix before a request meets
    them; it looks up the six counts that it needs, whatever an id's size."""
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    none = F.lit(None).cast("string")
    asked = requests.select("request_id", F.col("id").alias("asked_id"), F.lower(text("pin")).alias("asked_pin"), text("version").alias("asked_version"), text("lib").alias("lib"))
    row = F.struct(F.col("version").cast("string").alias("version"), F.lower("seq_sha256").alias("seq_sha256"), "file_sha256", "outfile")
    key = lambda **by: F.struct(*[by.get(c, none).cast("string").alias(c) for c in ("file", "version")], by.get("pin", F.lit("")).alias("pin"))
    pins = asked.select(F.coalesce("asked_pin", F.lit("")).alias("pin")).unionByName(asked.sparkSession.range(1).select(F.lit("").alias("pin")))
    held = by_prefix(manifest.select(F.col("id").alias("asked_id"), row.alias("row")).withColumn("sha", F.col("row.seq_sha256")), "sha", pins)
    file, version = base_name(F.col("row.outfile")), F.col("row.version")
    wide = F.array(F.lit(True), version.isNotNull(), file.isNotNull(), file.isNotNull() & version.isNotNull())
    keys = F.array(key(pin=F.col("pin")), key(version=version, pin=F.col("pin")), key(file=file, pin=F.col("pin")), key(file=file, version=version, pin=F.col("pin")))
    keys = F.filter(F.zip_with(keys, wide, lambda k, w: F.when(w, k)), lambda k: k.isNotNull())
    counted = held.select("asked_id", "row", F.explode(keys).alias("k")).groupBy("asked_id", "k.file", "k.version", "k.pin").agg(F.count("*").alias("n"), F.max("row").alias("row"))
    file, version, pin = base_name(F.col("lib")), F.col("asked_version"), F.coalesce("asked_pin", F.lit(""))
    ask = lambda name, k, fits=F.lit(True): F.when(fits, F.struct(F.lit(name).alias("name"), k.alias("k")))
    at = file.isNotNull()
    asks = F.array(
        ask("held", key()), ask("at_lib", key(file=file), at), ask("near_versions", key(file=file, version=version), at), ask("near", key(file=file, version=version, pin=pin), at),
        ask("far_versions", key(version=version)), ask("far", key(version=version, pin=pin)),
    )
    each = asked.select("request_id", "lib", "asked_version", "asked_id", F.explode(F.array_compact(asks)).alias("a")).select("request_id", "lib", "asked_version", "asked_id", "a.name", "a.k.file", "a.k.version", "a.k.pin")
    c, e = counted.alias("c"), each.alias("e")
    same = (F.col("e.asked_id") == F.col("c.asked_id")) & (F.col("e.pin") == F.col("c.pin")) & F.col("e.file").eqNullSafe(F.col("c.file")) & F.col("e.version").eqNullSafe(F.col("c.version"))
    met = e.join(c, same, "left").select("request_id", "lib", "asked_version", "name", F.coalesce("n", F.lit(0)).alias("n"), "row")
    of = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0))
    one = lambda name: F.max(F.when(F.col("name") == name, F.col("row")))
    per = met.groupBy("request_id", "lib", "asked_version").agg(
        of("held").alias("held"), of("at_lib").alias("at_lib"), F.struct(of("near_versions").alias("versions"), of("near").alias("n"), one("near").alias("row")).alias("near"),
        F.struct(of("far_versions").alias("versions"), of("far").alias("n"), one("far").alias("row")).alias("far"),
    )
    judged = per.withColumn("c", F.when(F.col("at_lib") > 0, F.col("near")).otherwise(F.col("far")))
    named = filename_sha12("c.row.outfile")
    problem = (
        F.when(F.lit(need_version) & F.col("asked_version").isNull(), "no version given").when(F.col("held") == 0, "no such part").when(F.col("c.versions") == 0, "no such version")
        .when(F.col("c.n") == 0, "no version has the pin").when(F.col("c.n") > 1, "ambiguous").when(~F.coalesce(F.col("c.row.version"), F.lit("")).rlike("^[0-9]+$"), "version is no number")
        .when((named != "") & (named != F.substring("c.row.seq_sha256", 1, 12)), "name differs from the hash")
    )
    note = F.when(F.col("lib").isNotNull() & (F.col("held") > 0) & (F.col("at_lib") == 0), "file not held; the pin decides")
    fields = judged.withColumn("problem", problem)
    return fields.select("request_id", "problem", note.alias("note"), *[F.when(F.col("problem").isNull(), F.col(f"c.row.{c}")).alias(c) for c in ("version", "seq_sha256", "file_sha256", "outfile")])


def verified(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(request_id, problem, length) of selected ``rows`` (request_id, outfile,
    seq_sha256, file_sha256, expect_length) read again from ``files`` (path,
    seq, file_sha256), the first that fails: the file, its bases, its bytes
    where their hash is known, its length where one is expected."""
    there = files.select(F.col("path").alias("outfile"), F.col("seq").alias("seq"), F.col("file_sha256").alias("bytes"))
    met = rows.join(there, "outfile", "left")
    expected = F.nullif(F.col("expect_length").cast("int"), F.lit(0))
    problem = (
        F.when(F.coalesce("seq", F.lit("")) == "", "file missing").when(~seq_sha256("seq").eqNullSafe(F.lower("seq_sha256")), "bases differ from their row")
        .when((F.coalesce("file_sha256", F.lit("")) != "") & ~F.col("bytes").eqNullSafe(F.col("file_sha256")), "bytes differ from their row").when(F.length("seq") != expected, "length differs from the spec")
    )
    return met.select("request_id", problem.alias("problem"), F.length("seq").alias("length"))


def twins(manifest: DataFrame) -> DataFrame:
    """Hashes that more than one id shares, with the ids in order."""
    ids = manifest.groupBy("seq_sha256").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return ids.where(F.size("ids") > 1).select("seq_sha256", F.array_join("ids", ",").alias("ids"), F.size("ids").alias("n"))


def newest(manifest: DataFrame) -> DataFrame:
    """The latest version of each id, how many there are, and the next."""
    return manifest.groupBy("id").agg(F.max("version").alias("version"), F.count_distinct("version").alias("versions"), (F.max("version") + 1).alias("next_version"), F.max_by("seq_sha256", "version").alias("seq_sha256"))


def contradictions(parts: DataFrame) -> DataFrame:
    """Ids that one spec resolves to different sequences."""
    return parts.groupBy("spec_id", "id").agg(F.count_distinct("seq_sha256").alias("n")).where("n > 1")


def audit(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Problems (path, problem) between a manifest and the files present.

    ``files`` has path, seq and content hash (file_sha256). Both sides meet
    in one full join; a row may have several problems.
    """
    m = manifest.select(F.col("outfile").alias("path"), F.col("seq_sha256").alias("want_seq"), F.col("file_sha256").alias("want_file"), F.lit(True).alias("listed"))
    f = files.select("path", seq_sha256("seq").alias("seq"), F.col("file_sha256").alias("file"), F.lit(True).alias("present"))
    both = m.join(f, "path", "full")
    named = filename_sha12("path")
    problems = F.array(
        F.when(F.col("present").isNull(), "file missing"),
        F.when(F.col("listed").isNull(), "file not in manifest"),
        F.when(F.col("file") != F.col("want_file"), "bytes differ"),
        F.when(F.col("seq") != F.col("want_seq"), "sequence differs"),
        F.when((named != "") & ~F.startswith(F.col("want_seq"), named), "name differs"),
    )
    return both.select("path", F.explode(F.array_compact(problems)).alias("problem"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All of ``new`` and the rows of ``old`` that it doesn't replace."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"))


def carry_forward(old: DataFrame, new: DataFrame, key: str, kept: Column) -> DataFrame:
    """``new`` with those ``old`` rows that fit ``kept`` and aren't in it."""
    return upsert(old.where(kept), new, key)


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
