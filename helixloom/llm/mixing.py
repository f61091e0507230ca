"""Mixes sources to target weights by Pfair scheduling.

A source's rows form blocks. With target weight ``w`` its k-th block is
released at slot ``floor(k / w)`` and due by ``ceil((k + 1) / w)``; each slot
goes to the released block with the earliest deadline, equal ones to the first
source. No deadline is missed, so after any number of slots each source has
had its weight times that number of blocks to within less than one block.

Slots are cut into cycles of ``CYCLE``, or more so that each source has a
block in each. After ``A`` slots each source is to have had ``w A`` blocks,
rounded up for those with the largest remainders so that the sum is ``A``.
With these numbers at both ends a cycle is scheduled by itself, from the exact
windows, and cycles spread over the cluster. (That no window is missed and
none used early under this rule is tested over random weights, not proved;
roundings by due time or by the windows' middles miss some.)

Weights are taken as multiples of ``1 / RESOLUTION``, ``LEAST`` of them at
least, which bounds a cycle. A source that runs out leaves its slots empty,
and the others keep their proportions to each other: no row is dropped or
repeated.

Rows are ranked in their source by ``md5(doc_id)``. Ranks of a large source
come from many parts: each (source, salt) is numbered by itself and starts at
the running total of the salts before it, so no task sees a whole source.

Built-in functions only. A cycle's row holds one entry for each source, which
should be thousands at most.

Defined results: a null source is a source of its own; a null doc_id ranks
first; rows that tie in every column used may swap ranks, which changes
nothing; rows equal in every column are placed by one task; a weight that is
null or not above zero counts as the least; an empty table gives an empty
result; extra columns, whatever their names, are kept by :func:`mix` and not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

CYCLE = 256
RESOLUTION, LEAST = 100_000_000, 100
BLOCK_ROWS = 16
#: Default weights: a source's share of rows to this power, evened out.
TEMPERATURE = 0.5
SALT_DIGITS = 3


def targets(sizes: DataFrame, block_rows: int = BLOCK_ROWS, weight: Column | None = None, cycle: int = CYCLE) -> DataFrame:
    """(source, rows) to one row: ``s``, a list of (source, w, blocks) in
    order, ``total``, of which each ``w`` is a part, and ``slots`` of a cycle."""
    weight = F.pow(F.col("rows"), F.lit(TEMPERATURE)) if weight is None else weight
    sums = sizes.select("source", "rows", weight.cast("double").alias("x")).withColumn("x", F.when(F.col("x") > 0, F.col("x")))
    share = F.col("x") / sums.agg(F.sum("x").alias("all")).select("all").scalar()
    w = F.greatest(F.lit(LEAST).cast("long"), F.round(RESOLUTION * share).cast("long"))
    each = sums.select(F.struct("source", w.alias("w"), F.ceil(F.col("rows") / block_rows).cast("long").alias("blocks")).alias("x"))
    lists = each.agg(F.array_sort(F.collect_list("x")).alias("s")).where(F.size("s") > 0).withColumn("total", F.expr("aggregate(s, 0L, (a, x) -> a + x.w)"))
    return lists.withColumn("slots", F.expr(f"greatest({cycle}L, array_max(transform(s, x -> (total + x.w - 1) div x.w)))"))


def shares_after(slots: str) -> str:
    """The blocks that each source is to have had after so many slots."""
    return f"""
        transform(array(named_struct(
            'order', array_sort(transform(s, (x, i) -> named_struct('less', - (x.w * ({slots}) % total), 'i', i))),
            'ahead', ({slots}) - aggregate(s, 0L, (a, x) -> a + x.w * ({slots}) div total))),
          o -> transform(s, (x, i) -> x.w * ({slots}) div total
            + if(o.ahead > 0 and named_struct('less', - (x.w * ({slots}) % total), 'i', i) <= o.order[int(o.ahead) - 1], 1L, 0L)))[0]"""


#: Blocks are listed in pieces of PIECE, so that no long list is copied for each.
PIECE = 256
EARLIEST_DEADLINE_FIRST = f"""
    flatten(aggregate(
      sequence(1L, (jobs + {PIECE - 1}) div {PIECE}),
      named_struct('t', low, 'done', first, 'out', cast(array() as array<array<struct<i: int, k: bigint, slot: bigint>>>)),
      (whole, piece) -> transform(
        array(aggregate(
          sequence(1L, least({PIECE}L, jobs - (piece - 1) * {PIECE})),
          named_struct('t', whole.t, 'done', whole.done, 'out', cast(array() as array<struct<i: int, k: bigint, slot: bigint>>)),
          (state, n) -> transform(
            transform(
              array(greatest(state.t, array_min(transform(s, (x, i) -> if(state.done[i] < last[i], state.done[i] * total div x.w, null))))),
              now -> named_struct('now', now, 'i', array_min(transform(s, (x, i) ->
                if(state.done[i] < last[i] and state.done[i] * total div x.w <= now,
                   named_struct('due', least(low + slots, ((state.done[i] + 1) * total + x.w - 1) div x.w), 'i', i), null))).i)),
            best -> named_struct(
              't', best.now + 1,
              'done', transform(state.done, (d, i) -> if(i = best.i, d + 1, d)),
              'out', concat(state.out, array(named_struct('i', best.i, 'k', state.done[best.i], 'slot', best.now)))))[0])),
        x -> named_struct('t', x.t, 'done', x.done, 'out', concat(whole.out, array(x.out))))[0],
      whole -> whole.out))"""


def timetable(target: DataFrame) -> DataFrame:
    """(source, block, release, due, slot) of every block of ``target``."""
    end = target.select("slots", F.expr("array_max(transform(s, x -> (x.blocks * total + x.w - 1) div x.w))").alias("n")).first()  # two numbers
    cycles = target.sparkSession.range(-(-end.n // end.slots) if end else 0)
    rows = cycles.select("id", *[target.select(c).scalar().alias(c) for c in ("s", "total", "slots")]).withColumn("low", F.col("id") * F.col("slots"))
    bounded = lambda slots: F.expr(f"transform({shares_after(slots)}, (c, i) -> least(c, s[i].blocks))")
    rows = rows.withColumn("first", bounded("low")).withColumn("last", bounded("low + slots"))
    rows = rows.withColumn("jobs", F.expr("aggregate(zip_with(first, last, (a, b) -> b - a), 0L, (a, x) -> a + x)")).where("jobs > 0")
    found = rows.select("s", "total", F.explode(F.expr(EARLIEST_DEADLINE_FIRST)).alias("x")).select("total", F.expr("s[x.i]").alias("y"), "x")
    return found.select(
        F.col("y.source").alias("source"), F.col("x.k").alias("block"), F.expr("x.k * total div y.w").alias("release"), F.expr("((x.k + 1) * total + y.w - 1) div y.w").alias("due"), F.col("x.slot").alias("slot")
    )


def ranked(docs: DataFrame, salt_digits: int = SALT_DIGITS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, key, source_rank from 0) and (source, rows). ``key``
    tells rows apart that share a doc_id."""
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), h.alias("h"), "key")
    salted = rows.withColumn("salt", F.substring("h", 1, salt_digits))
    parts = stored(salted.groupBy("source", "salt").agg(F.count("*").alias("n")), "sizes")
    before = Window.partitionBy("source").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(F.col("source").alias("s"), F.col("salt").alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("source", "salt").orderBy("h", "doc_id", "key"))
    numbered = salted.withColumn("inside", inside.cast("long"))
    met = numbered.join(starts, numbered["source"].eqNullSafe(starts["s"]) & (numbered["salt"] == starts["t"]))
    return met.select("doc_id", "source", "key", (F.col("first") + F.col("inside") - 1).alias("source_rank")), parts.groupBy("source").agg(F.sum("n").alias("rows"))


def schedule(docs: DataFrame, cycle: int = CYCLE, block_rows: int = BLOCK_ROWS, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, key) to source_rank, block, release, due and slot.
    ``weight`` is an expression of (source, rows). Only these narrow rows are
    shuffled; a block has ``block_rows`` of them, so no join key is hot."""
    rows, sizes = ranked(docs)
    target = stored(targets(sizes, block_rows, weight, cycle), "target")  # one row
    # the timetable grows with the data, which Spark can't tell from the cycles' number
    plan = timetable(target).withColumnsRenamed({"source": "ps", "block": "pb"}).hint("merge")
    blocks = rows.withColumn("block", F.expr(f"source_rank div {block_rows}"))
    met = blocks.join(plan, blocks["source"].eqNullSafe(plan["ps"]) & (blocks["block"] == plan["pb"]))
    return met.select("doc_id", "source", "key", "source_rank", "block", "release", "due", "slot")


def placements(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, source_rank, block, release, due, slot of every row."""
    return schedule(docs.select("doc_id", "source", F.lit(0).alias("key")), **options).drop("key")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows, all columns, in the order of the schedule: partitions are
    ranges of slots, in order, and so are the rows in each.

    Rows are scheduled by their ids and a hash; whole rows move twice, to meet
    their places and into order."""
    hashed = [docs[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(*hashed).alias("key"))
    ids = docs.select("doc_id", "source", F.xxhash64(*hashed).alias("key"))
    places = schedule(ids, **options).groupBy(F.col("doc_id").alias("pid"), F.col("key").alias("pkey")).agg(F.array_sort(F.collect_list(F.struct("slot", "source_rank"))).alias("places"))
    met = keyed.join(places, keyed["id"].eqNullSafe(places["pid"]) & (keyed["key"] == places["pkey"]))
    copy = F.row_number().over(Window.partitionBy("pid", "pkey").orderBy(F.lit(0)))
    placed = met.withColumn("copy", copy).select("row", F.expr("places[copy - 1].slot").alias("slot"), F.expr("places[copy - 1].source_rank").alias("source_rank"))
    return placed.repartitionByRange("slot", "source_rank").sortWithinPartitions("slot", "source_rank").select("row.*")
