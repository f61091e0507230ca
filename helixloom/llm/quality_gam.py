"""Quality classifier: a generalised additive model with interactions.

Each text becomes a row of counts and shares. Features are cut into bins at
quantiles of a bounded labelled sample; boosting goes round the features in
turn, each time fitting a shallow tree over one feature's bins to the
gradient of the log loss and adding it to that feature's lookup table. The
pairs of features whose tables would gain most are boosted the same way. A
score is the logistic of the sum of one entry per table, so whole batches are
scored by indexing and adding.

Defined results: a null text counts as empty and is scored like any other;
without labelled rows every score is 0.5; a document labelled both ways is
taken as 0; extra columns pass through :func:`keep_good`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import text_of

BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 60, 0.15, 4.0
THRESHOLD = 0.5
FEATURES = [
    "chars", "words", "word_length", "distinct_words", "top_word", "distinct_pairs", "repeats", "upper", "digits", "marks", "exclaims", "bars",
    "other_symbols", "non_ascii", "spaces", "lines", "line_words", "distinct_lines", "short_words", "sentence_ends",
]
CLASS = np.zeros(256, np.int64)
for kind, members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()?", b"!", b"|", b"#$%&*+/<=>@[\\]^_`{}~", bytes(range(128, 256)), b" \t\n\r\v\f"), 1):
    CLASS[list(members)] = kind


def features(text: str) -> list[float]:
    """The values of FEATURES for one whole text; all finite."""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=9)
    size = max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split("\n") if x]
    letters = sum(map(len, words))
    repeats = sum(map(str.__eq__, words, words[1:]))
    short = sum(c for w, c in counts.items() if len(w) <= 3)
    ends = sum(c for w, c in counts.items() if w[-1] in ".!?")
    return [
        np.log1p(len(raw)), np.log1p(len(words)), letters / n, len(counts) / n, max(counts.values(), default=0) / n, pairs / max(1, len(words) - 1), repeats / n,
        kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / size, kinds[8] / size,
        np.log1p(len(lines)), len(words) / max(1, len(lines)), len(set(lines)) / max(1, len(lines)), short / n, ends / n,
    ]


@dataclass
class Gam:
    """Lookup tables by feature and by pair of features."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for f in {f for pair in self.pairs for f in pair}}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def tree_1d(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A regression tree over ordered bins, by its value in each bin."""
    cuts = [0, len(g)]
    G, H = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + RIDGE)
    while len(cuts) <= leaves:
        best = max(((gain(a, c) + gain(c, b) - gain(a, b), c) for a, b in zip(cuts, cuts[1:]) if b - a > 1 for c in [a + 1 + int(np.argmax(gain(a, np.arange(a + 1, b)) + gain(np.arange(a + 1, b), b)))]), default=(0, 0))
        if best[0] <= 1e-9:
            break
        cuts = sorted([*cuts, best[1]])
    return np.concatenate([np.full(b - a, (G[b] - G[a]) / (H[b] - H[a] + RIDGE)) for a, b in zip(cuts, cuts[1:])])


def tree_2d(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of a grid into four quadrants: values and gain."""
    def quadrants(x: np.ndarray) -> list[np.ndarray]:
        s = np.cumsum(np.cumsum(x, 0), 1)
        rows, columns, all_ = s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        a = s[:-1, :-1]
        return [a, rows - a, columns - a, all_ - rows - columns + a]

    if min(g.shape) < 2:
        return np.zeros_like(g), 0.0
    G, H = quadrants(g), quadrants(h)
    gains = sum(x * x / (y + RIDGE) for x, y in zip(G, H))
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    value = [x[i, j] / (y[i, j] + RIDGE) for x, y in zip(G, H)]
    grid = np.empty_like(g)
    grid[: i + 1, : j + 1], grid[: i + 1, j + 1 :], grid[i + 1 :, : j + 1], grid[i + 1 :, j + 1 :] = value
    return grid, float(gains[i, j])


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Boosts main effects, ranks pairs by what they still explain, and boosts the best."""
    n_features = x.shape[1]
    if not len(y):
        return Gam(0.0, [np.array([])] * n_features, [np.zeros(1)] * n_features, [], [], [])
    prior = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(prior / (1 - prior)))
    edges = [quantile_edges(x[:, f], BINS) for f in range(n_features)]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    margin = np.full(len(y), bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(n_features):
            g, h = slopes()
            step = RATE * tree_1d(np.bincount(bins[f], g, len(tables[f])), np.bincount(bins[f], h, len(tables[f])))
            tables[f] += step
            margin += step[bins[f]]
    pair_edges = [quantile_edges(x[:, f], PAIR_BINS) for f in range(n_features)]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(pair_edges)]
    width = [len(e) + 1 for e in pair_edges]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * width[b] + coarse[b], v, width[a] * width[b]).reshape(width[a], width[b])

    g, h = slopes()
    pairs = sorted(combinations(range(n_features), 2), key=lambda p: -tree_2d(grid(*p, g), grid(*p, h))[1])[:PAIRS]
    pair_tables = [np.zeros((width[a], width[b])) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            g, h = slopes()
            step = RATE * tree_2d(grid(a, b, g), grid(a, b, h))[0]
            pair_tables[k] += step
            margin += step[coarse[a], coarse[b]]
    return Gam(bias, edges, tables, pair_edges, pairs, pair_tables)


def matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t or "") for t in texts.to_pylist()], np.float64).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, label: str = "quality", max_rows: int = labelled.MAX_ROWS) -> Gam:
    """Features are computed by the executors; the driver gets at most
    ``max_rows`` short rows of numbers and fits the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in matrix(batch.column(0)).T), batch.column(1)], names=[*FEATURES, "label"])

    rows = labelled.sample(docs, labels, label, F.lit(False) if held_out is None else held_out, max_rows)
    got = rows.mapInArrow(run, ", ".join(f"{f} double" for f in FEATURES) + ", label int").toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    return fit(got[FEATURES].to_numpy(np.float64), got["label"].to_numpy(np.float64))


def score(docs: DataFrame, model: Gam, keys: list[Column]) -> DataFrame:
    """The ``keys`` of each document and a column ``score``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = held.value.score(matrix(batch.column(batch.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], schema=pa.schema([*list(batch.schema)[:-1], pa.field("score", pa.float64())]))

    rows = docs.select(*keys, text_of().alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{schema}, score double")


def keep_good(docs: DataFrame, model: Gam, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, all columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(held.value.score(matrix(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
