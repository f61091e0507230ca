"""Sealed libraries: what may be loaded from them, and how they grow.

A library is a folder of versions ``v1``, ``v2``, ... Each has the whole
manifest as text in order, the root over its row hashes, and the files that
came with it. A version is written aside and put in place by one rename that
refuses to replace another, so that of two writers the second starts over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from helixloom.functions import sequence as S
from helixloom.operators import claims, gates, manifest
from helixloom.operators.manifest import FIELDS
from helixloom.sources import files, stores

NOT_SEALED = "root missing"
PROBLEMS = "library string, id string, problem string"


def load(rows: DataFrame, texts: DataFrame, roots: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Parts (library, id, version, seq, role, provenance) and problems
    (library, id, problem) of libraries.

    ``rows`` are manifest rows with library, ``order`` and row_sha256; ``texts``
    has path and seq; ``roots`` library, disk_root, pin. A library whose root,
    pin or rows don't verify gives no part at all; one that was never sealed
    gives its parts and says so. Every part must have the bases and length of
    its row and the name of its bases. Both results come from one join."""
    checks = gates.root_checks(rows, roots, order).select("library", F.col("problem").alias("whole"))
    refused = ~F.coalesce("whole", F.lit("unknown library")).isin("", "no pin", NOT_SEALED)
    got = manifest.seq_sha256("seq")
    named = manifest.filename_sha12("outfile")
    problem = (
        F.when(F.col("seq").isNull(), "file missing").when(F.col("seq") == "", "no bases").when(got != F.col("seq_sha256"), "bases differ from their row")
        .when((named != "") & ~F.startswith(got, named), "bases differ from their name").when(F.length("seq") != F.col("length").try_cast("int"), "length differs")
    )
    listed = rows.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("outfile", F.lit("")) != ""))
    met = listed.join(texts.select(F.col("path").alias("outfile"), S.normalise("seq").alias("seq")), "outfile", "left").join(checks, "library", "left").where(~refused).withColumn("problem", problem)
    last = F.element_at(F.split("outfile", "/"), -1)
    origin = F.concat(F.lit("your library "), last, F.lit(" | "), F.substring(F.coalesce("source", F.lit("")), 1, 100))
    parts = met.where("problem is null").select("library", "id", "version", "seq", claims.inferred_role("id", "source").alias("role"), origin.alias("provenance"))
    whole = checks.where((F.col("whole") != "") & (F.col("whole") != "no pin")).select("library", F.lit(None).cast("string").alias("id"), F.col("whole").alias("problem"))
    return parts, met.where("problem is not null").select("library", "id", "problem").unionByName(whole)


def copied(rows: DataFrame, texts: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """(id, seq, source, class, problem) of the ids ``wanted`` (id) from
    another library ``name``: manifest ``rows`` with ordinal, the last of an id
    counting, and ``texts`` (path, seq).

    What a row says isn't trusted: the bases are hashed anew, and where they
    differ nothing but the problem is returned. The source says through which
    library a part came."""
    last = rows.groupBy("id").agg(F.max_by(F.struct("outfile", "seq_sha256", "source", "class"), "ordinal").alias("row")).select("id", "row.*")
    there = texts.select(F.col("path").alias("outfile"), S.normalise("seq").alias("seq"))
    met = wanted.select("id").distinct().join(last, "id", "left").join(there, "outfile", "left")
    problem = F.when(F.col("outfile").isNull(), "not in the library").when(F.col("seq").isNull(), "file missing").when(F.col("seq") == "", "no bases").when(~manifest.seq_sha256("seq").eqNullSafe(F.col("seq_sha256")), "bases differ from their row")
    sound = met.withColumn("problem", problem)
    kept = lambda c: F.when(F.col("problem").isNull(), c)
    source = F.concat(F.coalesce("source", F.lit("")), F.lit(f" [copied from {name}]"))
    return sound.select("id", kept(F.col("seq")).alias("seq"), kept(source).alias("source"), kept(F.coalesce("class", F.lit("reference"))).alias("class"), "problem")


class Library:
    """One library in a folder that all of a cluster can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self) -> int:
        """The newest version, 0 before the first."""
        names = stores.names(self.spark, self.folder)
        return max((int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()), default=0)

    def rows(self, version: int | None = None) -> DataFrame:
        """Manifest rows, all text, with row_sha256 and their ``ordinal``."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], ", ".join(f"{f} string" for f in (*FIELDS, "row_sha256")) + ", ordinal long")
        lines = self.spark.read.text(f"{self.folder}/v{version}/manifest").where("value <> ''")
        cells = F.split("value", "\t", -1)
        names = (*FIELDS, "row_sha256")
        return lines.select(F.get(cells, F.lit(0)).cast("long").alias("ordinal"), *[F.get(cells, F.lit(i)).alias(c) for i, c in enumerate(names, 1)])

    def root(self, version: int | None = None) -> str | None:
        version = self.version() if version is None else version
        return self.spark.read.text(f"{self.folder}/v{version}/root").first().value if version else None

    def texts(self, version: int | None = None) -> DataFrame:
        """(path, seq, content) of all files that have come with the library."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], "path string, seq string, content string")
        return self.spark.read.parquet(*[f"{self.folder}/v{i}/files" for i in range(1, version + 1)])

    def loaded(self, pin: str = "") -> tuple[DataFrame, DataFrame]:
        """:func:`load` of this library's newest version."""
        version, name = self.version(), F.lit("0").alias("library")
        roots = self.spark.createDataFrame([("0", self.root(version), pin)], "library string, disk_root string, pin string")
        return load(self.rows(version).select("*", name), self.texts(version), roots, "ordinal")

    def append(self, new: DataFrame, day: str, retries: int = 20) -> DataFrame:
        """Takes in parts (request, id, seq, source, class, expect_length) and
        returns (request, id, version, problem) of each.

        Nothing is overwritten: a file's name has its id, version and hash. All
        is worked out anew if another writer has committed meanwhile. What was
        written is read back and its root compared before this returns."""
        for _ in range(retries):
            version = self.version()
            old, name = self.rows(version), F.lit("0")
            roots = self.spark.createDataFrame([("0", self.root(version), "")], "library string, disk_root string, pin string")
            checks = gates.root_checks(old.withColumn("library", name), roots, "ordinal") if version else self.spark.createDataFrame([("0", True)], "library string, ok boolean")
            judged = gates.intake(new.withColumn("library", name), old.select(name.alias("library"), "id", F.col("version").cast("int").alias("version")), checks)
            result = self.spark.createDataFrame(judged.collect(), judged.schema)  # as many rows as were asked for
            if result.where("problem is null").isEmpty():
                return result
            kept = result.where("problem is null").drop("problem", "id").join(new, "request")
            seq, sha = F.upper("seq"), manifest.seq_sha256("seq")
            path = F.concat(F.lit("parts/"), F.regexp_replace("id", "[^A-Za-z0-9_.-]", "_"), F.lit("__v"), F.col("version").cast("string"), F.lit("__"), F.substring(sha, 1, 12), F.lit(".gb"))
            content = files.genbank_text(F.col("id"), seq, F.lit("linear"), F.lit(day).cast("date"))
            made = kept.select("request", "id", F.col("version").cast("string").alias("version"), seq.alias("seq"), sha.alias("seq_sha256"), content.alias("content"), path.alias("outfile"), "source", "class")
            made = made.withColumns({"file_sha256": F.sha2("content", 256), "length": F.length("seq").cast("string"), "date": F.lit(day)})
            # a manifest is a list in order: numbering new rows takes one task, as its root does
            added = made.withColumn("ordinal", F.row_number().over(Window.orderBy("request")) + F.lit(old.count())).select(F.col("ordinal").cast("long"), *FIELDS, manifest.row_sha256().alias("row_sha256"))
            aside = f"{self.folder}/.{uuid.uuid4().hex}"
            whole = old.select("ordinal", *FIELDS, "row_sha256").unionByName(added)
            made.select(F.col("outfile").alias("path"), "seq", "content").write.parquet(f"{aside}/files")
            # no field may break a line or a column
            cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ") for c in whole.columns]
            whole.coalesce(1).sortWithinPartitions("ordinal").select(F.concat_ws("\t", *cells)).write.text(f"{aside}/manifest")
            back = self.spark.read.text(f"{aside}/manifest").where("value <> ''")
            parts = F.split("value", "\t", -1)
            read = back.select(F.get(parts, F.lit(0)).cast("long").alias("ordinal"), *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(FIELDS, 1)])
            root = manifest.root(read, "ordinal")
            root.coalesce(1).write.text(f"{aside}/root")
            if stores.put(self.spark, aside, f"{self.folder}/v{version + 1}"):
                problems = self.loaded()[1]
                if not problems.isEmpty():
                    raise ValueError(f"{self.folder}: what was written doesn't verify: {problems.first()}")
                return result
            stores.delete(self.spark, aside)
        raise RuntimeError(f"{self.folder}: other writers committed first each time")
