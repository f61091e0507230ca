"""Runs of repeated words found by probing harmonic grids.

A run is a stretch of words with smallest period q (words q apart are equal),
``max(LEAST, 3 * q)`` long at least, that no neighbouring word extends. The
places i of a run at which word i equals word i + q are 2q or more in a row, so
two neighbouring multiples of q are among them. For each period p the words at
jp, (j+1)p and (j+2)p are therefore compared first: over all periods that is
n ln n places. What survives is compared at a few places more, all at once, and
then extended to both sides by comparing chunks of the array, each twice as
long as the last. Periods ascend, and a survivor inside a run already found
whose period divides p would only give that run again and is skipped. A stretch
of period p that is as long as three periods and has a smaller one has a
divisor of p, so what is found otherwise has smallest period p.

A document is worked on by itself where it is read, in memory proportional to
its words; nothing is shuffled.

Defined results: a null text has no words, as an empty or blank one; repeated
rows give repeated rows; a very long text is read whole; extra columns, whatever
their names, are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The least length of a run in words.
LEAST = 24
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Up to so many words all periods of a text are probed at once.
AT_ONCE = 4096
#: Words compared in the first chunk beyond a survivor.
CHUNK = 32
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string"

_grid: list[np.ndarray] = []


def grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last word touched, place, period) of all probes of AT_ONCE words, by
    the last word: those of a shorter text come first."""
    if not _grid:
        places = [np.arange(0, AT_ONCE - 2 * p, p) for p in range(1, AT_ONCE // 3 + 1)]
        place, period = np.concatenate(places), np.repeat(np.arange(1, AT_ONCE // 3 + 1), [len(x) for x in places])
        order = np.argsort(place + 2 * period, kind="stable")
        _grid.extend(x[order].astype(np.int32) for x in (place + 2 * period, place, period))
    return _grid[0], _grid[1], _grid[2]


def survivors(words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(period, places) where the grid's words agree, periods ascending."""
    n = len(words)
    if n <= AT_ONCE:
        last, place, period = grid()
        k = np.searchsorted(last, n)
        place, period = place[:k], period[:k]
        first = words[place]
        hit = np.flatnonzero((first == words[place + period]) & (first == words[last[:k]]))
        place, period = thinned(words, place[hit], period[hit])
        order = np.lexsort((place, period))
        place, period = place[order], period[order]
        cuts = np.flatnonzero(np.diff(period)) + 1
        for part in np.split(np.arange(len(place)), cuts) if len(place) else ():
            yield int(period[part[0]]), place[part]
        return
    for p in range(1, n // 3 + 1):
        seen = words[::p]
        same = seen[1:] == seen[:-1]
        place = np.flatnonzero(same[1:] & same[:-1]) * p
        if len(place):
            place, _ = thinned(words, place, np.full(len(place), p))
            if len(place):
                yield p, place


def thinned(words: np.ndarray, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those places from which words a period apart agree at some places of the
    next period as well, as all of them do in a run."""
    for part in (0.5, 0.25, 0.75, 0.125, 0.9):
        if not len(place):
            break
        at = place + (period * part).astype(period.dtype)
        keep = words[at] == words[at + period]
        place, period = place[keep], period[keep]
    return place, period


def agreed(a: np.ndarray, b: np.ndarray) -> int:
    """How many words agree from the start, by chunks that double."""
    n, at, size = min(len(a), len(b)), 0, CHUNK
    while at < n:
        end = min(n, at + size)
        differ = a[at:end] != b[at:end]
        i = int(differ.argmax())
        if differ[i]:
            return at + i
        at, size = end, size * 2
    return n


def runs_of(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array of word numbers, by
    start and then period."""
    n = len(words)
    if n < least:
        return []
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # starts and ends of each period's runs
    for p, place in survivors(words):
        for q, (starts, ends) in found.items():
            if p % q == 0:
                of = np.searchsorted(starts, place, "right") - 1
                place = place[(of < 0) | (place + p >= ends[np.maximum(of, 0)])]
        spans, i = [], 0
        while i < len(place):
            a = int(place[i])
            right = a + agreed(words[a:], words[a + p :])  # the first place that differs
            left = a - agreed(words[a::-1][1:], words[a + p :: -1][1:])
            if right + p - left >= max(least, 3 * p):
                spans.append((left, right + p))
            i = int(np.searchsorted(place, right, "left"))
        if spans:
            found[p] = (np.array([x[0] for x in spans]), np.array([x[1] for x in spans]))
    return sorted((int(s), int(e - s), p) for p, both in found.items() for s, e in zip(*both))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def numbered(words: list[str]) -> np.ndarray:
    """Words as numbers, equal for equal words."""
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def collapsed(text: str, least: int = LEAST) -> tuple[int, list[tuple[int, int, int]], str]:
    """The number of words, the runs, and the words that stay, joined by a space."""
    words = WORD.findall(text)
    runs = runs_of(numbered(words), least)
    if runs:
        words_left = [words[i] for i in np.flatnonzero(kept(len(words), runs))]
        return len(words), runs, " ".join(words_left)
    return len(words), runs, " ".join(words)


def collapse(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, the runs of every text and the text without their
    repetitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            got = [collapsed(x.as_py(), least) for x in batch.column(1)]
            runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x[1]] for x in got], of)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.int64()), runs, pa.array([x[2] for x in got], pa.string())], names=["doc_id", "n_words", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).mapInArrow(run, SCHEMA)
