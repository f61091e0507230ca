"""Readers of manifests, flat files and references, and writers of results.

Files are read by Spark's own sources, so any store works and a bad file is a
row in ``rejects``, not a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.functions import sequence as S
from helixloom.operators.manifest import FIELDS

# First bytes of files that hold no sequence.
MAGIC = {"png": "89504E47", "pdf": "25504446", "jpeg": "FFD8FF", "gif": "47494638", "gzip": "1F8B", "bmp": "424D", "riff": "52494646", "ole": "D0CF11E0", "zip": "504B0304", "font": "00010000"}

# Roles of flat-file keys.
KEY_ROLES = {"promoter": "promoter", "rbs": "rbs", "ribosome_binding_site": "rbs", "cds": "cds", "gene": "cds", "terminator": "terminator"}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated manifest, all fields text, with the ``ordinal`` of each
    row's line. A file without some column of FIELDS or row_sha256 is refused
    with their names.

    A manifest is a list in order, and its root is of that order: each file is
    read by one task, line by line."""
    names = (*FIELDS, "row_sha256")
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "\r", ""), "\n").alias("lines"))
    head = F.split(F.get("lines", F.lit(0)), "\t")
    lacking = F.filter(F.array(*map(F.lit, names)), lambda c: ~F.array_contains(F.col("head"), c))
    checked = lines.withColumn("head", head).withColumn("head", F.when(F.size(lacking) == 0, F.col("head")).otherwise(F.raise_error(F.concat(F.lit("manifest lacks "), F.array_join(lacking, ", ")))))
    each = checked.select("head", F.posexplode("lines").alias("ordinal", "line")).where("ordinal > 0 and trim(line) <> ''").withColumn("cells", F.split("line", "\t", -1))
    field = lambda c: F.coalesce(F.get("cells", (F.array_position("head", F.lit(c)) - 1).cast("int")), F.lit("")).alias(c)
    return each.select(*map(field, names), F.col("ordinal").cast("long").alias("ordinal"))


def flat_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, file_sha256, text) of whole files, any depth."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return raw.select("path", "content", F.sha2("content", 256).alias("file_sha256"), F.col("content").cast("string").alias("text"))


def extract_sequence(text: Column | str) -> Column:
    """Letters of an ORIGIN block, else of all lines that aren't FASTA
    headers, in upper case."""
    t = F.col(text) if isinstance(text, str) else text
    origin = F.regexp_extract(t, r"(?ms)^ORIGIN[^\n]*\n(.*?)(?:^//|\z)", 1)
    body = F.when(t.rlike(r"(?m)^ORIGIN"), origin).otherwise(F.regexp_replace(t, r"(?m)^>.*$", ""))
    return F.upper(F.regexp_replace(body, "[^A-Za-z]", ""))


def kind_of(content: Column, text: Column) -> Column:
    """fasta, genbank, loose, or what a file that holds no sequence is."""
    found = F.when(F.ltrim(text).startswith(">"), "fasta").when(text.rlike(r"(?m)^(LOCUS|ORIGIN)"), "genbank")
    for name, first in MAGIC.items():
        found = found.when(F.startswith(content, F.unhex(F.lit(first))), name)
    return found.when(F.contains(text, F.lit("\x00")), "binary").otherwise("loose")


def loose_pieces(text: Column) -> Column:
    """Cells of eight letters or more that are nearly all bases, in file
    order; without any, the whole text's letters if they are all but bases."""
    bases = lambda c: F.length(F.regexp_replace(c, "[^ACGTUNRYKMSWBDHV]", ""))
    sized = lambda c, share: (F.length(c) >= 8) & (bases(c) >= share * F.length(c))
    cells = F.transform(F.split(text, r'[,;\t\r\n"]+'), lambda c: F.upper(F.regexp_replace(c, r"[\s\d]", "")))
    kept = F.transform(F.filter(cells, lambda c: sized(c, 0.9)), lambda c: F.regexp_replace(c, "[^A-Z]", ""))
    whole = F.array(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")))
    return F.when(F.size(kept) > 0, kept).otherwise(F.filter(whole, lambda c: sized(c, 0.95)))


def loose_sequence(text: Column) -> Column:
    return F.array_join(loose_pieces(text), "")


def protein_sequence(text: Column) -> Column:
    """Letters of all lines that aren't FASTA headers, in upper case."""
    return F.upper(F.regexp_replace(F.regexp_replace(text, r"(?m)^>.*$", ""), "[^A-Za-z*]", ""))


def part_sequences(parts: DataFrame) -> DataFrame:
    """(path, seq, kind) of part files (path, text): the bases of a flat file;
    for protein parents (``.faa``) without bases of their own, the residues."""
    bases = extract_sequence("text")
    protein = F.col("path").rlike(r"(?i)\.faa$") & ~F.col("text").rlike(r"(?m)^ORIGIN")
    return parts.select("path", F.when(protein, protein_sequence(F.col("text"))).otherwise(bases).alias("seq"), F.when(protein, "protein").otherwise("dna").alias("kind"))


def records(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sequence records (path, name, topology, seq, assembled_from) and rejects
    (path, reason): no bases, or a declared length that differs. Where a loose
    table's cells were joined ``assembled_from`` has their lengths in order, as
    another order would be another sequence."""
    kind = kind_of(F.col("content"), F.col("text"))
    locus = F.regexp_extract("text", r"(?m)^LOCUS\s+(\S+)", 1)
    declared = F.nullif(F.regexp_extract("text", r"(?m)^LOCUS\s+\S+\s+(\d+)\s+bp", 1), F.lit("")).cast("int")
    header = F.regexp_extract_all("text", F.lit(r"(?m)^>\s*(\S+)"), F.lit(1))
    read = files.select(
        "path", kind.alias("kind"), F.when(kind == "fasta", F.element_at(header, -1)).otherwise(locus).alias("name"),
        F.when(F.col("text").rlike(r"(?m)^LOCUS.*\bcircular\b"), "circular").otherwise("linear").alias("topology"), declared.alias("declared"),
        F.when(kind.isin("fasta", "genbank"), F.array(extract_sequence("text"))).when(kind == "loose", loose_pieces(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("pieces"),
    )
    joined = read.withColumn("seq", F.array_join("pieces", "")).withColumn("assembled_from", F.when(F.size("pieces") > 1, F.transform("pieces", F.length)))
    reason = F.when(F.length("seq") == 0, F.concat(F.lit("no bases: "), F.col("kind"))).when(F.col("declared") != F.length("seq"), "length differs from LOCUS")
    judged = joined.withColumn("reason", reason)
    return judged.where("reason is null").select("path", "name", "topology", "seq", "assembled_from"), judged.where("reason is not null").select("path", "reason")


def feature_role(kind: Column) -> Column:
    """The role that a flat file's key means; misc for keys that mean none."""
    role = F.lit("misc")
    for key, means in KEY_ROLES.items():
        role = F.when(F.lower(kind) == key, means).otherwise(role)
    return role


def claims(files: DataFrame) -> DataFrame:
    """(path, n, kind, role, start, end, strand, label) of a flat file's features."""
    table = F.regexp_extract("text", r"(?ms)^FEATURES[^\n]*\n(.*?)^ORIGIN", 1)
    items = F.split(table, r"\n(?=     \S)")
    each = files.select("path", F.posexplode(items).alias("n", "item")).where(F.trim("item") != "")
    loc = F.regexp_replace(F.regexp_extract("item", r"(?s)^\s*\S+\s+(.*?)(?=\n\s+/|\z)", 1), r"\s", "")
    label = F.coalesce(*[F.nullif(F.regexp_extract("item", rf'/{q}="?([^"\n]*)"?', 1), F.lit("")) for q in ("label", "gene", "product", "standard_name", "note")])
    got = each.select("path", "n", F.regexp_extract("item", r"^\s*(\S+)", 1).alias("kind"), S.location(loc).alias("l"), label.alias("label")).where("kind <> 'source'")
    return got.select("path", "n", "kind", feature_role(F.col("kind")).alias("role"), "l.start", "l.end", "l.strand", "label")


def references(spark: SparkSession, table: str, fasta: str) -> DataFrame:
    """A tab-separated table met with FASTA records on their id; rows without
    a sequence are dropped, of equal FASTA ids the last wins."""
    rows = spark.read.csv(table, sep="\t", header=True, quote="")
    entries = spark.read.text(fasta, lineSep=">").where(F.trim("value") != "")
    # by file, range of bytes, and order within the range
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    seqs = entries.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("id"), S.normalise(F.regexp_replace("value", r"^[^\n]*\n?", "")).alias("seq"), place.alias("n"))
    return rows.join(seqs.groupBy("id").agg(F.max_by("seq", "n").alias("seq")), "id")


def fasta_text(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit(" sha256="), F.substring(F.sha2(F.upper(seq), 256), 1, 16), F.lit("\n"), S.wrapped(seq), F.lit("\n"))


def genbank_text(name: Column, seq: Column, topology: Column, day: Column, about: Column | None = None, features: Column | None = None) -> Column:
    """A flat file of one sequence; the caller gives the day it bears, and may
    give lines ``about`` it, each ended, and a text of ``features``."""
    head = F.format_string("LOCUS       %s %d bp    DNA     %s   SYN %s\n", name, F.length(seq), topology, F.upper(F.date_format(day, "dd-MMM-yyyy")))
    table = F.lit("") if features is None else F.when(features != "", F.concat(features, F.lit("\n"))).otherwise("")
    return F.concat(head, F.lit("") if about is None else about, F.lit("FEATURES             Location/Qualifiers\n"), table, F.lit("ORIGIN\n"), S.origin_block(seq), F.lit("\n//\n"))
