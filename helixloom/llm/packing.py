"""Packs tokenised documents into fixed windows by dynamic programming.

Documents of a partition form one stream of tokens in stored order. Windows
are cut by minimising ``f[j] = min over j - size <= i < j of f[i] +
(size - (j - i)) + penalty[j]``: padding plus a penalty that is 0 at a
document's end, small at a sentence's end and larger inside a sentence. As
the padding is linear in ``i``, the transition is a sliding minimum of
``f[i] + i`` over a monotone queue, linear in the number of cuts considered.

The stream is solved in blocks of about ``block`` tokens; what follows a
block's last full window is carried into the next, so memory is bounded and
only a partition's last window may be left short. There is no shuffle: a lost
task is redone from its own input split.

Ids are looked up by word: each new word is split by the tokenizer's own rule
and encoded by the library's model; the library itself encodes any text with
characters that would have to be folded or composed first. Results equal
encoding the whole text with the library.

Defined results: a null text counts as empty and has the end id alone;
repeated rows are packed once each; an empty table gives an empty result; a
document longer than a window is cut over several.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SIZE = 2048
END_ID = 1
BLOCK = 1 << 20
SENTENCE_PENALTY = 2
INSIDE_PENALTY = 24
#: A sentence longer than this may be cut inside, at multiples of it.
STRIDE = 64
#: Words remembered by a Python worker; the memory is emptied beyond it.
REMEMBERED = 500_000
# Fixed value: the split rule of the tokenizer's file, for lower-case text.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Characters that are composed already, lower-case to one code point, and
#: are white space to the tokenizer just where they are to Python.
SIMPLE = re.compile(r"[\x00-\x1b\x20-\x7FÀ-ÖØ-öø-ÿŒœ–—‘-„…€¡-¬®-¿]*")
SPECIAL = "<|"
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint"
ID = np.dtype("<u4")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies:
    printable Latin-1 for itself, the others counted up from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordTokenizer:
    """Encodes texts to bytes of ids through a memory of encoded words.

    The split rule never reaches over white space, so a word's ids don't
    depend on its neighbours.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.memory: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for x in (".", "!", "?", "...", '."', '!"', '?"', ".)"):
            self.ends[self.library.encode(x, add_special_tokens=False).ids[-1]] = True

    def piece(self, pre_token: str) -> bytes:
        shown = pre_token if pre_token.isascii() and pre_token.isprintable() else "".join(map(self.letters.__getitem__, pre_token.encode()))
        return array("I", [t.id for t in self.library.model.tokenize(shown)]).tobytes()

    def learn(self, words: list[str]) -> None:
        for store in (self.memory, self.pieces):
            if len(store) + len(words) > REMEMBERED:
                store.clear()
        for w in words:
            found = []
            for p in SPLIT.findall(w):
                if (b := self.pieces.get(p)) is None:
                    b = self.pieces[p] = self.piece(p)
                found.append(b)
            self.memory[w] = b"".join(found)

    def encode(self, text: str) -> bytes:
        if SPECIAL in text or not (text.isascii() and text.isprintable() or SIMPLE.fullmatch(text)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, ID).tobytes()
        words = text.lower().split()
        try:
            return b"".join(map(self.memory.__getitem__, words))
        except KeyError:
            before = len(self.memory)
            self.learn([w for w in dict.fromkeys(words) if w not in self.memory])
            if len(self.memory) < before:
                self.learn([w for w in dict.fromkeys(words) if w not in self.memory])
            return b"".join(map(self.memory.__getitem__, words))


TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, with what its earlier tasks have learnt."""
    if path not in TOKENIZERS:
        TOKENIZERS[path] = WordTokenizer(path)
    return TOKENIZERS[path]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, sentence: int, inside: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a stream may be cut, from 0 to its end, with penalties."""
    marks = np.union1d(np.flatnonzero(ends[ids]) + 1, doc_ends)
    gaps = np.diff(marks, prepend=0)
    more = (gaps - 1) // stride
    base = np.repeat(marks - gaps, more)
    step = np.arange(len(base)) - np.repeat(np.cumsum(more) - more, more) + 1
    place = np.concatenate([[0], marks, base + step * stride])
    cost = np.concatenate([[0], np.where(np.isin(marks, doc_ends, assume_unique=True), 0, sentence), np.full(len(base), inside)])
    order = np.argsort(place, kind="stable")
    return place[order], cost[order]


def best_cuts(positions: np.ndarray, penalties: np.ndarray, size: int) -> tuple[list[int], list[float]]:
    """For each cut its best predecessor's index, by a monotone queue."""
    place, cost = positions.tolist(), penalties.tolist()
    n = len(place)
    before, best = [0] * n, [0.0] * n
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (f + position, position, index)
    for j in range(1, n):
        p = place[j]
        least = p - size
        while queue[0][1] < least:
            queue.popleft()
        key, _, i = queue[0]
        f = key + size - p + cost[j]
        before[j], best[j] = i, f
        key = f + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, p, j))
    return before, best


def windows(positions: np.ndarray, cost: np.ndarray, size: int, final: bool) -> list[int]:
    """End positions of the windows of a stream with these cuts. Unless
    ``final``, the last is the best cut within half a window of the end."""
    before, best = best_cuts(positions, cost, size)
    j = len(positions) - 1
    if not final:
        first = int(np.searchsorted(positions, positions[-1] - size // 2))
        j = min(range(max(1, first), len(positions)), key=lambda i: (best[i] + positions[-1] - positions[i], -i))
    cuts = []
    while j:
        cuts.append(int(positions[j]))
        j = before[j]
    return cuts[::-1]


class Packer:
    """Turns a stream of (doc_id, bytes of ids) into rows of pieces."""

    def __init__(self, first_sequence: int, ends: np.ndarray, size: int = SIZE, block: int = BLOCK, penalties: tuple[int, int, int] = (SENTENCE_PENALTY, INSIDE_PENALTY, STRIDE)):
        self.sequence, self.ends, self.size, self.block, self.penalties = first_sequence, ends, size, block, penalties
        self.docs: list[tuple] = []  # doc_id, tokens before, tokens here, tokens of the document
        self.parts: list[bytes] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        n = len(ids) // ID.itemsize
        self.docs.append((doc_id, 0, n, n))
        self.parts.append(ids)
        self.held += n
        return self.flush(False) if self.held >= self.block else []

    def flush(self, final: bool) -> list[tuple]:
        if not self.docs:
            return []
        data = memoryview(b"".join(self.parts))
        doc_ends = np.cumsum([d[2] for d in self.docs])
        positions, cost = cut_points(np.frombuffer(data, ID), doc_ends, self.ends, *self.penalties)
        rows, at, k = [], 0, 0  # at: tokens of the stream given out; k: document
        for cut in windows(positions, cost, self.size, final):
            begin, whole = at, cut - at
            while at < cut:
                doc_id, start, left, total = self.docs[k]
                n = min(left, cut - at)
                rows.append((doc_id, start, n, zlib.crc32(data[4 * at : 4 * (at + n)]), total, self.sequence, at - begin, whole))
                at += n
                if n == left:
                    k += 1
                else:
                    self.docs[k] = (doc_id, start + n, left - n, total)
            self.sequence += 1
        self.docs, self.parts = self.docs[k:], [bytes(data[4 * at :])]
        self.held -= at
        return rows


def pack(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id (the partition's number in the high bits), offset, and
    sequence_tokens, the tokens of the sequence before padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 40, words.ends, size, block)
        last = np.array([end_id], ID).tobytes()

        def made() -> Iterator[list[tuple]]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    yield packer.add(doc_id, words.encode(text) + last)
            yield packer.flush(True)

        for rows in made():
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, SCHEMA)


def padding(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """One row: sequences, tokens, and the padding they need."""
    each = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return each.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(size - F.col("n")).alias("padding"))
