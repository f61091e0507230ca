"""SimHash near-duplicate classes with a pivot distance table.

Fingerprints are made per document in Arrow batches. Equal fingerprints are
one node. Each node carries its precomputed Hamming distances to
``2 * PER_WORD`` reference fingerprints, eight to a long. By the triangle
inequality two fingerprints within ``radius`` bits differ by at most
``radius`` in each of these coordinates; a pair whose maximum coordinate
difference is larger is discarded, and only survivors are verified.

Distances to a pivot of random 64-bit values all lie near 32, so pivots alone
cannot deal pairs out to machines: 57 % of all random pairs stay within four
of each other in one coordinate. Pairs are therefore met by the pigeonhole
rule - ``radius + 2`` or more blocks of bits, at most ``radius`` of which can
differ, hence a table for each set of blocks that must agree - which loses no
link, and the pivot table then discards. The number of blocks follows the
number of distinct fingerprints so that chance meetings stay linear; each
choice is exact. A pair is tested only in the first table where it meets.

Links of a dense ball are emitted one by one, but their number has a bound
that the data can't raise: at most 1 + 64 + 2016 = 2,081 different
fingerprints lie within four bits of each other (the ball of radius two), and
equal fingerprints are one node.

Defined results: a null or blank text has fingerprint zero and is linked like
any other; repeated rows share a class, and where they are its first document
:func:`dedup` keeps each of them; a null doc_id counts as larger than all
numbers, so a class is named null only if all its ids are; extra columns pass
through :func:`dedup`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

RADIUS = 4
SHINGLE = 4
PER_WORD = 8
#: Rows of a fingerprint's share from which its documents are settled map-side.
HEAVY_SHARE = 1024
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
STEP = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = 42) -> int:
    """The SimHash of one text as an unsigned 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle]))
    digest = xxhash.xxh64_intdigest
    total, ones = len(starts), np.zeros(64, np.int64)
    for at in range(0, total, STEP):
        spans = zip(starts[at : at + STEP].tolist(), (ends[shingle - 1 :][at : at + STEP] - 1).tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key (tells rows that share a doc_id apart), fp (signed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(values.view(np.int64))], names=["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text_key bigint, fp bigint")


def pivots(count: int = 2 * PER_WORD) -> list[int]:
    """Reference fingerprints: hashes of their own number, so independent."""
    return [xxhash.xxh64_intdigest(f"pivot {i}", 0) for i in range(count)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def distance_words(fp: Column, refs: list[int]) -> list[Column]:
    """The distances to ``refs``, eight to a long, a byte each."""
    words = []
    for at in range(0, len(refs), PER_WORD):
        word = F.lit(0).cast("long")
        for i, ref in enumerate(refs[at : at + PER_WORD]):
            word = word.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(signed(ref)))).cast("long"), 8 * i))
        words.append(word)
    return words


def within(a: Column, b: Column, radius: int) -> Column:
    """No coordinate of two distance words differs by more than ``radius``."""
    test = F.lit(True)
    for i in range(PER_WORD):
        x, y = (F.shiftrightunsigned(w, 8 * i).bitwiseAND(F.lit(127).cast("long")) for w in (a, b))
        test = test & (F.abs(x - y) <= radius)
    return test


def block_masks(blocks: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


def blocks_for(nodes: int, radius: int) -> int:
    """Fewest blocks for which few nodes agree in a table by chance."""
    for blocks in range(radius + 2, 2 * radius):
        if nodes <= 4 << (64 * (blocks - radius) // blocks):
            return blocks
    return 2 * radius


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """All pairs (a, b), a < b, of distinct ``fp`` within ``radius`` bits."""
    blocks = blocks or blocks_for(nodes.count(), radius)
    masks = block_masks(blocks)
    tables = [sum(masks[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    keyed = nodes.select("fp", *[w.alias(f"d{i}") for i, w in enumerate(distance_words(F.col("fp"), pivots()))])
    keyed = keyed.select("*", F.posexplode(F.array(*[F.lit(signed(m)) for m in tables])).alias("t", "mask"))
    keyed = keyed.select("fp", "d0", "d1", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
    a, b = keyed.alias("a"), keyed.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(signed(m))) == 0, F.lit(i)) for i, m in enumerate(tables)])
    pivot_test = within(F.col("a.d0"), F.col("b.d0"), radius) & within(F.col("a.d1"), F.col("b.d1"), radius)
    met = (F.col("a.t") == F.col("b.t")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") < F.col("b.fp"))
    return a.join(b, met & pivot_test & (F.bit_count(differ) <= radius) & (first == F.col("a.t"))).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge, by repeated contraction.

    Each round every node joins its least neighbour, in an order scrambled by
    a hash so that no chain is monotone, and edges move to the joined nodes;
    rounds needed grow with the logarithm of the longest chain.
    """
    edges = stored(edges.select("a", "b"), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("v", "w")
        order = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c), c)  # noqa: B023, E731
        least = both.groupBy("v").agg(F.min(order(F.col("w"))).alias("m"))
        parent = stored(least.select("v", F.when(F.col("m") < order(F.col("v")), F.col(f"m.{least.schema['m'].dataType.names[1]}")).otherwise(F.col("v")).alias("p")), "parents")
        rounds.append(parent)
        p, q = parent.toDF("a", "pa"), parent.toDF("b", "pb")
        moved = edges.join(p, "a").join(q, "b").where("pa <> pb")
        edges = stored(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.toDF("node", "root")
    roots = rounds[-1].toDF("node", "root")
    for parent in reversed(rounds[:-1]):
        up = roots.toDF("p", "root")
        roots = parent.join(up, "p", "left").select(F.col("v").alias("node"), F.coalesce("root", "p").alias("root"))
    return stored(roots, "roots")


def classes(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, text_key, fp, component_id, and the
    first_key that tells which row of the least doc_id represents the class."""
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")), "nodes")
    roots = components(links(nodes, radius))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    best = joined.groupBy("root").agg(F.min("least").alias("first"))
    named = stored(joined.join(best, "root").select("fp", "n", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("first_key")), "classes")
    # fewer than HEAVY_SHARE fingerprints can hold more than that share of rows
    floor = rows.count() / HEAVY_SHARE
    heavy = named.where(F.col("n") > floor).drop("n")
    light = named.where(F.col("n") <= floor).drop("n")
    known = rows.join(F.broadcast(heavy), "fp")
    rest = rows.join(F.broadcast(heavy.select("fp")), "fp", "left_anti").join(light, "fp")
    return known.unionByName(rest).select("doc_id", "text_key", "fp", "component_id", "first_key")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each class, that of the least doc_id, all columns."""
    stay = classes(docs, radius, shingle).where("doc_id <=> component_id and text_key = first_key").select("doc_id", "text_key").distinct()
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"))
    met = packed.join(stay, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left_semi")
    return met.select("row.*")

