"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms - words without their punctuation, and the
beginnings of longer words - hashed to a fixed number of slots. The model
``b + sum w_i + sum_{i<j} <v_i, v_j>`` adds to linear weights a product of
short vectors for each pair of terms, so that two terms which are harmless
alone can count together. Pairs are never listed: their sum is half of
``|sum v_i|^2 - sum |v_i|^2``.

The model is fitted by AdaGrad on a bounded labelled sample on the driver
and broadcast; its size is ``SLOTS * (1 + RANK)`` numbers whatever the data.

Defined results: a null or blank text scores as the set of no terms; without
labelled rows every score is 0.5; a document labelled both ways is taken as
0; repeated terms count once; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import text_of

SLOTS, RANK = 1 << 20, 4
EPOCHS, BATCH, RATE, SPREAD = 20, 128, 0.15, 0.02
#: Shrinkage of the linear weights of telling terms and of the others, and of
#: all vectors, so that long texts aren't sums of noise. Chosen on an inner
#: fold (crc32 mod 5 is 1) of the rows that may be learnt from, among those
#: with which a pair of terms that tell nothing alone is learnt.
DECAY, DECAY_OTHERS, DECAY_PAIRS = 1e-5, 0.03, 0.07
#: Fewest labelled documents that a term must be in to get weights.
SUPPORT = 8
#: Standard errors by which a term's share of toxic documents must differ from
#: the others' for its linear weight to be all but free.
CONTRAST = 4.5
PREFIXES = (4, 5)
REMEMBERED = 400_000
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "–—‘’“”„…«»¡¿"


class Terms:
    """Slots of a text's terms, through a memory of words."""

    def __init__(self, slots: int = SLOTS):
        self.slots, self.memory = slots, {}

    def of_word(self, word: str) -> bytes:
        bare = word.strip(EDGE)
        terms = [f"w {bare}", *(f"p {bare[:n]}" for n in PREFIXES if len(bare) >= n)] if bare else []
        return np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % self.slots for t in terms], np.int32).tobytes()

    def of(self, text: str) -> np.ndarray:
        words = set(text.lower().split())
        if len(self.memory) + len(words) > REMEMBERED:
            self.memory.clear()
        memory = self.memory
        for w in words:
            if w not in memory:
                memory[w] = self.of_word(w)
        return np.unique(np.frombuffer(b"".join(map(memory.__getitem__, words)), np.int32))


TERMS: dict[int, Terms] = {}


def rows_of(texts: list[str], slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all texts in one array, and where each text's begin."""
    terms = TERMS.setdefault(slots, Terms(slots))
    each = [terms.of(t or "") for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
    return np.concatenate([*each, np.zeros(0, np.int32)]), starts


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive ``starts``, each by itself, so
    that a text's sum doesn't depend on its batch; empty ones are 0."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        out[some] = np.add.reduceat(values.astype(np.float64), starts[some], axis=0)
    return out


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, slots: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.v[slots]
        sums = segment_sums(v, starts)
        pairs = 0.5 * ((sums**2).sum(1) - segment_sums((v.astype(np.float64) ** 2).sum(1), starts))
        return self.bias + segment_sums(self.w[slots], starts) + pairs, sums

    def score(self, slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(slots, starts)[0], -30, 30)))


def telling(has: np.ndarray, slots: np.ndarray, starts: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """The slots whose presence goes with the label."""
    toxic = np.bincount(slots, np.repeat(y, np.diff(starts)), size)
    n, n1 = len(y), max(1.0, y.sum())
    share = has / n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / max(1.0, n - n1)))
    return np.abs(toxic / n1 - (has - toxic) / max(1.0, n - n1)) >= CONTRAST * error


def fit(slots: np.ndarray, starts: np.ndarray, y: np.ndarray, size: int = SLOTS, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7, support: int = SUPPORT) -> Machine:
    """AdaGrad over shuffled batches; only slots that a batch has are touched.
    All terms with support have a weight and a vector: two that tell nothing
    alone may do so together."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(size, np.float32), np.zeros((size, rank), np.float32))
    if not len(y):
        return m
    has = np.bincount(slots, minlength=size)
    frequent = has >= support
    decay = np.where(telling(has, slots, starts, y, size), DECAY, DECAY_OTHERS).astype(np.float32)
    kept = frequent[slots]
    starts = np.concatenate(([0], np.cumsum(kept)))[starts]
    slots = slots[kept]
    seen = np.flatnonzero(frequent)
    m.v[seen] = rng.normal(0, SPREAD, (len(seen), rank))
    prior = (y.sum() + 0.5) / (len(y) + 1)
    m.bias = float(np.log(prior / (1 - prior)))
    past_w, past_v, past_b = np.full(size, 1e-2, np.float32), np.full((size, rank), 1e-2, np.float32), 1e-2
    lengths = np.diff(starts)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            rows = order[at : at + BATCH]
            n = lengths[rows]
            begin = np.concatenate(([0], np.cumsum(n)))
            here = slots[np.repeat(starts[rows] - begin[:-1], n) + np.arange(begin[-1])]
            margin, sums = m.margin(here, begin)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
            each = np.repeat(slope, n)
            used, where = np.unique(here, return_inverse=True)
            g_w = np.bincount(where, each, len(used)) + decay[used] * m.w[used]
            lean = each[:, None] * (np.repeat(sums, n, axis=0) - m.v[here])
            g_v = np.stack([np.bincount(where, lean[:, k], len(used)) for k in range(rank)], 1) + DECAY_PAIRS * m.v[used]
            past_w[used] += (g_w * len(rows)) ** 2
            past_v[used] += (g_v * len(rows)) ** 2
            m.w[used] -= RATE * len(rows) * g_w / np.sqrt(past_w[used])
            m.v[used] -= 0.4 * RATE * len(rows) * g_v / np.sqrt(past_v[used])
            g_b = slope.sum() * len(rows)
            past_b += g_b**2
            m.bias -= RATE * g_b / np.sqrt(past_b)
    return m


def train(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, label: str = "toxic", max_rows: int = labelled.MAX_ROWS, slots: int = SLOTS) -> Machine:
    """Executors hash the sample's texts; the driver gets their slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, starts = rows_of(batch.column(0).to_pylist(), slots)
            lists = [found[a:b].tobytes() for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.binary()), batch.column(1)], names=["slots", "label"])

    rows = labelled.sample(docs, labels, label, F.lit(False) if held_out is None else held_out, max_rows)
    got = rows.mapInArrow(run, "slots binary, label int").toPandas().sort_values(["slots", "label"], kind="stable")
    each = [np.frombuffer(b, np.int32) for b in got["slots"]]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
    return fit(np.concatenate([*each, np.zeros(0, np.int32)]), starts, got["label"].to_numpy(np.float64), slots)


def score(docs: DataFrame, model: Machine, keys: list[Column]) -> DataFrame:
    """The ``keys`` of each document and a column ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = held.value
            scores = m.score(*rows_of(batch.column(batch.num_columns - 1).to_pylist(), len(m.w)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], schema=pa.schema([*list(batch.schema)[:-1], pa.field("score", pa.float64())]))

    rows = docs.select(*keys, text_of().alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{schema}, score double")
