"""Language-model scores from a hierarchical Pitman-Yor model.

A token is drawn in the restaurant of the word before it, whole words hashed
to one of ``CONTEXTS`` restaurants. Restaurants whose word ends in the same
two letters share a parent, all parents share the restaurant of single words,
and below it lies the uniform distribution over the known words and one
unknown. (A restaurant for each word of a corpus whose vocabulary keeps
growing would have totals too large for every task to hold.)

Customers are seated by the Chinese-restaurant rule. In each Gibbs sweep all
customers of a dish in a restaurant stand up and are seated again one by one,
given the tables of all other dishes and the parent's current probabilities;
each table sends a customer to the parent. Beyond ``EXACT`` customers of one
dish they are seated in small groups. Predictive probabilities are averaged
over the sweeps after the first.

Given the totals of each restaurant - ``CONTEXTS`` numbers, whatever the
corpus - dishes are independent, so the vocabulary is dealt out by word hash
and a sweep is a pass over it. Texts go through once: documents are gathered
in chunks, a chunk sends each (word, context) that it has once to the word's
bucket, with its count in training texts, and gets a probability back. Common
words therefore cost a bucket one entry per chunk and context, not per token;
counts are added up in steps of FAN chunks, and a bucket with more questions
than SPLIT_BYTES answers them in several tasks, each with its counts.

What is drawn depends on word, restaurant and sweep alone, so scores don't
change with the number of partitions, buckets or chunks.

Defined results: a null or blank text has the end token alone; repeated rows
count and are scored each; without training texts every probability is the
uniform one; a null doc_id is in training. Words are told apart by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of

PARENTS, CHILDREN = 128, 63
CONTEXTS = PARENTS * CHILDREN
CHUNK_TOKENS = 3_000_000
SWEEPS, STRENGTH, EXACT = 4, 1.0, 64
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
END = b""
CHUNK_SCHEMA = "chunk bigint, doc_ids array<bigint>, held array<boolean>, lengths array<int>, tokens binary, per_word binary, words binary, contexts binary, counts binary"
BLOCK_SCHEMA = "bucket int, chunk bigint, words binary, per_word binary, contexts binary, counts binary, size bigint"
#: Chunks whose counts of a bucket one task adds up, and bytes of a bucket's
#: questions from which they are dealt to several tasks.
FAN, SPLIT_BYTES = 128, 64 << 20
SCORE_SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def loosen(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def context_of(word: bytes) -> int:
    """The restaurant that the token after ``word`` is drawn in."""
    parent = xxhash.xxh32_intdigest(word[-2:], 1) % PARENTS
    return parent * CHILDREN + xxhash.xxh32_intdigest(word, 2) % CHILDREN


class Numbers(dict):
    """Words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's place among them: a sort
    of values and positions in one array, with little memory besides."""
    bits = max(1, len(values).bit_length())
    keys = (values.astype(np.uint64) << np.uint64(bits)) | np.arange(len(values), dtype=np.uint64)
    keys.sort()
    at = (keys & np.uint64((1 << bits) - 1)).astype(np.uint32)
    keys >>= np.uint64(bits)
    fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
    places = np.empty(len(values), np.uint32)
    places[at] = np.cumsum(fresh, dtype=np.uint32) - np.uint32(1)
    return keys[fresh].astype(np.int64), places


class Chunk:
    def __init__(self):
        self.numbers, self.ids, self.docs, self.size = Numbers(), [], [], 0
        self.end = self.numbers[END]

    def add(self, doc_id: int | None, held: bool, text: str) -> None:
        words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
        words.append(END)
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.docs.append((doc_id, held, len(words)))
        self.size += len(words)

    def row(self, number: int) -> pa.RecordBatch:
        """Words in order of their hashes; pairs by word, then context."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 0) for w in self.numbers), np.uint64, len(self.numbers))
        contexts = np.fromiter(map(context_of, self.numbers), np.int64, len(hashes))
        order = np.argsort(hashes)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        words = np.concatenate(self.ids)
        self.ids = []
        lengths = np.array([n for _, _, n in self.docs])
        before = np.concatenate(([self.end], words[:-1])).astype(words.dtype)
        before[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = self.end
        pairs, tokens = numbered(place[words] * CONTEXTS + contexts[before])
        training = np.repeat(~np.array([h for _, h, _ in self.docs]), lengths)
        counts = np.bincount(tokens[training], minlength=len(pairs))
        columns = [
            [number], [[d for d, _, _ in self.docs]], [[h for _, h, _ in self.docs]], [lengths.tolist()], [squeeze(tokens.astype(np.uint32))],
            [squeeze(np.bincount(pairs // CONTEXTS, minlength=len(hashes)).astype(np.uint16))], [squeeze(hashes[order])],
            [squeeze((pairs % CONTEXTS).astype(np.uint16))], [squeeze(counts.astype(np.uint32))],
        ]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in CHUNK_SCHEMA.split(", ")])


def chunks(docs: DataFrame, held_out: Column, chunk_tokens: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, chunk = TaskContext.get().partitionId() << 20, 0, Chunk()
        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                chunk.add(doc_id, held, text.as_py())
                if chunk.size >= chunk_tokens:
                    yield chunk.row(first + made)
                    made, chunk = made + 1, Chunk()
        if chunk.docs:
            yield chunk.row(first + made)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), text_of().alias("text"))
    return rows.mapInArrow(run, CHUNK_SCHEMA)


def spans(per_word: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(per_word, dtype=np.int64)))


def blocks(table: DataFrame, buckets: int) -> DataFrame:
    """The part of each chunk that belongs to each bucket of word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                words, per_word = loosen(row["words"], np.uint64), loosen(row["per_word"], np.uint16)
                contexts, counts, at = loosen(row["contexts"], np.uint16), loosen(row["counts"], np.uint32), spans(per_word)
                cuts = np.concatenate(([0], np.searchsorted(words, bounds), [len(words)]))
                got = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _, _ in got], pa.int32()), pa.array([row["chunk"]] * len(got), pa.int64()), pa.array([squeeze(words[a:b]) for _, a, b in got], pa.binary()),
                        pa.array([squeeze(per_word[a:b]) for _, a, b in got], pa.binary()), pa.array([squeeze(contexts[at[a] : at[b]]) for _, a, b in got], pa.binary()),
                        pa.array([squeeze(counts[at[a] : at[b]].astype(np.int64)) for _, a, b in got], pa.binary()), pa.array([8 * int(b - a) + 6 * int(at[b] - at[a]) for _, a, b in got], pa.int64()),
                    ],
                    names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")],
                )

    return table.select("chunk", "words", "per_word", "contexts", "counts").mapInArrow(run, BLOCK_SCHEMA)


def added(table: pa.Table) -> pa.Table:
    """The sums over rows of one bucket, as a row of the same kind."""
    rows = table.to_pylist()
    words = [loosen(r["words"], np.uint64) for r in rows]
    known, place = np.unique(np.concatenate(words), return_inverse=True)
    word = np.repeat(place, np.concatenate([loosen(r["per_word"], np.uint16) for r in rows]))
    pairs, where = np.unique(word * CONTEXTS + np.concatenate([loosen(r["contexts"], np.uint16) for r in rows]), return_inverse=True)
    counts = np.bincount(where, np.concatenate([loosen(r["counts"], np.int64) for r in rows]), len(pairs)).astype(np.int64)
    pairs, counts = pairs[counts > 0], counts[counts > 0]
    have, per_word = np.unique(pairs // CONTEXTS, return_counts=True)
    columns = [[rows[0]["bucket"]], [-1], [squeeze(known[have])], [squeeze(per_word.astype(np.uint16))], [squeeze((pairs % CONTEXTS).astype(np.uint16))], [squeeze(counts)], [sum(r["size"] for r in rows)]]
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.int64()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")])


def counted(parts: DataFrame, chunks: int, fan: int = FAN) -> DataFrame:
    """The counts of each bucket over all training texts, a row per bucket
    with chunk -1, and the size of what was asked about it.

    Added up in steps of ``fan`` chunks: however many chunks have a common
    word, no task reads more than ``fan`` rows of its bucket."""
    level = parts
    while chunks > fan:
        chunks = -(-chunks // fan)
        dealt = level.withColumn("group", F.pmod(F.xxhash64("bucket", "chunk", F.md5("words")), F.lit(chunks)))
        level = dealt.groupBy("bucket", "group").applyInArrow(lambda t: added(t.drop_columns(["group"])), BLOCK_SCHEMA)
    return level.groupBy("bucket").applyInArrow(added, BLOCK_SCHEMA)


@dataclass
class Totals:
    """What all buckets share about one state: customers and tables of each
    restaurant, and of the restaurant of single words."""

    customers: np.ndarray = field(default_factory=lambda: np.zeros(CONTEXTS + PARENTS + 1, np.int64))
    tables: np.ndarray = field(default_factory=lambda: np.zeros(CONTEXTS + PARENTS + 1, np.int64))


GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def scrambled(x: np.ndarray) -> np.ndarray:
    """64-bit keys mixed so that near ones have nothing in common."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: np.ndarray, draw: int) -> np.ndarray:
    """The ``draw``-th random number of each key, above 0 and below 1. What a
    dish draws depends on its word and restaurant alone, not on what it is
    kept or worked on with."""
    with np.errstate(over="ignore"):
        mixed = scrambled(keys + GOLDEN * np.uint64(draw + 1))
    return ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def binomial(keys: np.ndarray, draw: int, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Successes in ``n`` trials: by inversion where the variance is small,
    else the normal value rounded."""
    u, q = uniform(keys, draw), np.minimum(p, 1 - p)
    variance = n * q * (1 - q)
    z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * uniform(keys, draw + 1))
    got = np.clip(np.rint(n * q + z * np.sqrt(variance)), 0, n)
    small = np.flatnonzero(variance < 9)
    k, mass = np.zeros(len(small)), (1 - q[small]) ** n[small]
    odds, left = q[small] / (1 - q[small]), u[small] - mass
    rows = np.flatnonzero(left > 0)
    while len(rows):
        k[rows] += 1
        mass[rows] *= odds[rows] * (n[small][rows] - k[rows] + 1) / k[rows]
        left[rows] -= mass[rows]
        rows = rows[(left[rows] > 0) & (k[rows] < n[small][rows]) & (mass[rows] > 0)]
    got[small] = k
    return np.where(p > 0.5, n - got, got).astype(np.int64)


def reseat(keys: np.ndarray, customers: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """Tables taken when each dish's ``customers`` sit down one by one.

    ``weight`` is (strength + discount * tables of the restaurant) times the
    dish's probability in the parent: with n seated at t tables the next opens
    a table with odds ``weight`` to ``n - discount * t``. ``keys`` seed what
    each dish draws.
    """
    tables = np.minimum(customers, 1)
    rows, seated = np.flatnonzero(customers > 1), 1
    while len(rows) and seated < EXACT:
        w, t = weight[rows], tables[rows]
        tables[rows] = t + (uniform(keys[rows], seated) * (w + seated - discount * t) < w)
        seated += 1
        rows = rows[customers[rows] > seated]
    n, draw = np.full(len(rows), seated), EXACT
    while len(rows):
        step = np.minimum(customers[rows] - n, n // 16)
        w, t = weight[rows], tables[rows]
        tables[rows] = t + binomial(keys[rows], draw, step, w / (w + n + step / 2 - discount * t))
        n, draw = n + step, draw + 2
        left = customers[rows] > n
        rows, n = rows[left], n[left]
    return tables


class Seating:
    """The state of one bucket's dishes in the three levels."""

    def __init__(self, words: np.ndarray, per_word: np.ndarray, contexts: np.ndarray, counts: np.ndarray):
        self.words, self.counts = words, counts
        word = np.repeat(np.arange(len(words)), per_word)
        self.pairs, self.context = word * CONTEXTS + contexts, contexts.astype(np.int64)
        middle = self.pairs // CHILDREN
        self.starts = np.flatnonzero(np.diff(middle, prepend=-1))
        self.middle = middle[self.starts]
        self.parent = self.middle % PARENTS
        self.row1 = np.cumsum(np.diff(middle, prepend=-1) != 0) - 1
        word1 = self.middle // PARENTS
        self.starts1 = np.flatnonzero(np.diff(word1, prepend=-1))
        self.row0 = word1
        below = words[word1] if len(counts) else words
        self.keys = (scrambled(words[word] ^ scrambled(self.context.astype(np.uint64) + np.uint64(1))), scrambled(below ^ scrambled(self.parent.astype(np.uint64) + np.uint64(1 << 32))), scrambled(words[word1[self.starts1]]) if len(counts) else words)
        self.seat(np.minimum(counts, 1), None, None)

    def seat(self, t2: np.ndarray, t1: np.ndarray | None, t0: np.ndarray | None) -> None:
        """Tables of a level are the customers of the next."""
        self.t2 = t2
        self.c1 = np.add.reduceat(t2, self.starts) if len(t2) else t2
        self.t1 = np.minimum(self.c1, 1) if t1 is None else t1
        self.c0 = np.add.reduceat(self.t1, self.starts1) if len(t2) else t2
        self.t0 = np.minimum(self.c0, 1) if t0 is None else t0

    def totals(self) -> Totals:
        x = Totals()
        for level, at, c, t in ((slice(0, CONTEXTS), self.context, self.counts, self.t2), (slice(CONTEXTS, CONTEXTS + PARENTS), self.parent, self.c1, self.t1)):
            size = level.stop - level.start
            x.customers[level] = np.bincount(at, c, size)
            x.tables[level] = np.bincount(at, t, size)
        x.customers[-1], x.tables[-1] = self.c0.sum(), self.t0.sum()
        return x

    def sweep(self, number: int, all_: Totals, d: tuple[float, float, float], base: float) -> None:
        p0, p1, _ = self.probabilities(all_, d, base)
        k2, k1, k0 = (scrambled(k + np.uint64(number)) for k in self.keys)
        t2 = reseat(k2, self.counts, (STRENGTH + d[2] * all_.tables[self.context]) * p1[self.row1], d[2])
        self.seat(t2, None, None)
        t1 = reseat(k1, self.c1, (STRENGTH + d[1] * all_.tables[CONTEXTS + self.parent]) * p0[self.row0], d[1])
        self.seat(t2, t1, None)
        t0 = reseat(k0, self.c0, np.full(len(self.c0), (STRENGTH + d[0] * all_.tables[-1]) * base), d[0])
        self.seat(t2, t1, t0)

    def probabilities(self, all_: Totals, d: tuple[float, float, float], base: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own0, own1, own2 = self.own(all_, d)
        back0, back1, back2 = backing(all_, d)
        p0 = own0 + back0 * base
        p1 = own1 + back1[self.parent] * p0[self.row0]
        return p0, p1, own2 + back2[self.context] * p1[self.row1]

    def own(self, all_: Totals, d: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each dish's share by its customers, without what the parent adds."""
        n = STRENGTH + all_.customers
        return (self.c0 - d[0] * self.t0) / n[-1], (self.c1 - d[1] * self.t1) / n[CONTEXTS + self.parent], (self.counts - d[2] * self.t2) / n[self.context]


def backing(all_: Totals, d: tuple[float, float, float]) -> tuple[float, np.ndarray, np.ndarray]:
    """The weight of the parent in each restaurant of each level."""
    n, t = STRENGTH + all_.customers, all_.tables
    return (STRENGTH + d[0] * t[-1]) / n[-1], (STRENGTH + d[1] * t[CONTEXTS:-1]) / n[CONTEXTS:-1], (STRENGTH + d[2] * t[:CONTEXTS]) / n[:CONTEXTS]


@dataclass
class Fitted:
    """The totals after each sweep; with a bucket's counts they give its
    seating again, as what is drawn depends on words and sweeps alone."""

    tokens: int = 0
    words: int = 0
    discounts: tuple[float, float, float] = (0.5, 0.5, 0.5)
    sweeps: list[Totals] = field(default_factory=list)

    @property
    def base(self) -> float:
        return 1 / (self.words + 1)

    def states(self, row: dict) -> Iterator[tuple[Seating, Totals | None]]:
        """A bucket's seating at the start and after each sweep, with the
        totals of the same state if they are known yet."""
        s = Seating(loosen(row["words"], np.uint64), loosen(row["per_word"], np.uint16), loosen(row["contexts"], np.uint16), loosen(row["counts"], np.int64))
        yield s, self.sweeps[0] if self.sweeps else None
        for i, all_ in enumerate(self.sweeps):
            s.sweep(i, all_, self.discounts, self.base)
            yield s, self.sweeps[i + 1] if i + 1 < len(self.sweeps) else None


#: Where ``summed`` counts tables, dishes with one and two customers, and words.
TABLES_AT = CONTEXTS + PARENTS + 1
ONES_AT = 2 * TABLES_AT
WORDS_AT = ONES_AT + 6


def summed(counts: DataFrame, model: Fitted) -> dict[int, int]:
    """Sums over buckets of the newest state: customers, tables, dishes with
    one and two customers by level, and words, each from its place on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WORDS_AT + 1, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for s, _ in model.states(row):
                    pass
                x = s.totals()
                total[: len(x.customers)] += x.customers
                total[TABLES_AT : TABLES_AT + len(x.tables)] += x.tables
                for level, c in enumerate((s.c0, s.c1, s.counts)):
                    total[ONES_AT + 2 * level : ONES_AT + 2 * level + 2] += (c == 1).sum(), (c == 2).sum()
                total[WORDS_AT] += len(s.words)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids])], names=["id", "v"])

    rows = counts.mapInArrow(run, "id bigint, v bigint").groupBy("id").agg(F.sum("v").alias("v"))
    return {r.id: r.v for r in rows.collect()}  # at most 2 * CONTEXTS and a few more


def fit(counts: DataFrame, sweeps: int = SWEEPS) -> Fitted:
    model = Fitted()
    for i in range(sweeps + 1):
        got = summed(counts, model)
        x = Totals()
        for k, v in got.items():
            if k < TABLES_AT:
                x.customers[k] = v
            elif k < ONES_AT:
                x.tables[k - TABLES_AT] = v
        if not i:
            ones = [(got.get(ONES_AT + 2 * n, 0), got.get(ONES_AT + 2 * n + 1, 0)) for n in range(3)]
            model = Fitted(int(x.customers[:CONTEXTS].sum()), got.get(WORDS_AT, 0), tuple(min(0.95, max(0.05, a / max(1, a + 2 * b))) for a, b in ones))
        model.sweeps.append(x)
    return model


def answered(parts: DataFrame, counts: DataFrame, model: Fitted, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """For each chunk and bucket log10 probabilities of its pairs, averaged
    over sweeps, and the training counts of its words."""
    held = parts.sparkSession.sparkContext.broadcast(model)  # bounded: a few arrays of CONTEXTS numbers

    def run(table: pa.Table) -> pa.Table:
        model, rows = held.value, table.to_pylist()
        asked = [r for r in rows if r["chunk"] >= 0]
        if not asked:
            return pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "logs": pa.array([], pa.binary()), "known": pa.array([], pa.binary())})
        main = next((r for r in rows if r["chunk"] < 0 and len(loosen(r["words"], np.uint64))), None)  # a bucket may have no training words
        words = [loosen(r["words"], np.uint64) for r in asked]
        every = np.concatenate(words)
        per_word = np.concatenate([loosen(r["per_word"], np.uint16) for r in asked])
        context = np.concatenate([loosen(r["contexts"], np.uint16) for r in asked]).astype(np.int64)
        total, n, known = np.zeros(len(context)), 0, np.zeros(len(every), np.int64)
        if main is None:
            none = [Totals()] if not model.sweeps else model.sweeps[1:]
            states = ((None, x) for x in none)
        else:
            states = ((s, x) for i, (s, x) in enumerate(model.states(main)) if i and x is not None)
        hit = None
        for s, x in states:
            own0 = own1 = own2 = 0.0
            if s is not None:
                if hit is None:
                    at = np.searchsorted(s.words, every)
                    at0 = np.where((at < len(s.words)) & (s.words[np.minimum(at, len(s.words) - 1)] == every), at, -1)
                    known = np.where(at0 >= 0, np.add.reduceat(s.counts, s.starts[s.starts1])[at0], 0)
                    row0 = np.repeat(at0, per_word)
                    hit = row0, find(s.middle, np.where(row0 < 0, -1, row0 * PARENTS + context // CHILDREN)), find(s.pairs, np.where(row0 < 0, -1, row0 * CONTEXTS + context))
                own0, own1, own2 = (np.where(h >= 0, own[h], 0.0) for own, h in zip(s.own(x, model.discounts), hit))
            back0, back1, back2 = backing(x, model.discounts)
            total += own2 + back2[context] * (own1 + back1[context // CHILDREN] * (own0 + back0 * model.base))
            n += 1
        logs = np.log10(total / max(1, n)).astype(np.float32)
        ends_w, ends_p = np.cumsum([len(w) for w in words]), spans(per_word)
        starts_w = np.concatenate(([0], ends_w[:-1]))
        columns = [
            [r["chunk"] for r in asked], [r["bucket"] for r in asked], [squeeze(logs[ends_p[a] : ends_p[b]]) for a, b in zip(starts_w, ends_w)],
            [squeeze(known[a:b].astype(np.int64)) for a, b in zip(starts_w, ends_w)],
        ]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "bucket", "logs", "known"])

    # a bucket with much asked about it is answered by several tasks; there are
    # fewer such than one for each split_bytes of the whole
    hot = F.broadcast(counts.where(F.col("size") > split_bytes).select("bucket", F.expr(f"int(ceil(size / {split_bytes}))").alias("n")))
    asked = parts.withColumn("counts", F.lit(None).cast("binary")).join(hot, "bucket", "left").withColumn("part", F.coalesce(F.pmod("chunk", "n"), F.lit(0)).cast("int")).drop("n")
    known_ = counts.join(hot, "bucket", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))).drop("n")
    return asked.unionByName(known_).groupBy("bucket", "part").applyInArrow(run, "chunk bigint, bucket int, logs binary, known binary")


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The index of each key, -1 where it is missing."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def scored(table: DataFrame, answers: DataFrame, model: Fitted) -> DataFrame:
    tokens_all, words_all = model.tokens, model.words

    def run(chunk: pa.Table, found: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        for row in chunk.to_pylist():
            parts = sorted(found.to_pylist(), key=lambda r: r["bucket"])
            logs = np.concatenate([loosen(r["logs"], np.float32) for r in parts]).astype(np.float64)
            known = np.concatenate([loosen(r["known"], np.int64) for r in parts])
            word = np.repeat(np.arange(len(known)), loosen(row["per_word"], np.uint16))
            base = np.log10((known + 1) / (tokens_all + words_all + 1))
            tokens, lengths = loosen(row["tokens"], np.uint32), np.array(row["lengths"])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            add = lambda values: np.add.reduceat(values, starts)  # noqa: B023, E731
            columns = [row["doc_ids"], row["held"], lengths, add((known > 0).astype(np.int64)[word][tokens]), np.full(len(starts), tokens_all), add(base[word][tokens]), add(logs[tokens])]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            out.append(pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCORE_SCHEMA.split(", ")]))
        return pa.concat_tables(out) if out else pa.table({x.split()[0]: [] for x in SCORE_SCHEMA.split(", ")})

    rows = table.select("chunk", "doc_ids", "held", "lengths", "tokens", "per_word")
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, SCORE_SCHEMA)


def language_scores(docs: DataFrame, held_out: Column, chunk_tokens: int = CHUNK_TOKENS, sweeps: int = SWEEPS, bucket_bytes: int = 8 << 20, split_bytes: int = SPLIT_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Perplexity of a text is ``10 ** (-score / n_tokens)``.
    """
    spark = docs.sparkSession
    table = stored(chunks(docs, held_out, chunk_tokens), "chunks")
    size, made = table.agg(F.sum(F.octet_length("words") + F.octet_length("contexts") + F.octet_length("counts")), F.count("*")).first()
    size = size or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    parts = blocks(table, buckets)
    counts = stored(counted(parts, made, fan), "counts")
    model = fit(counts, sweeps)
    return scored(table, answered(parts, counts, model, split_bytes), model)
