"""A batch source of FASTA files in pieces, so that no genome is one row.

``spark.dataSource.register(FastaPieces)`` and then ``spark.read.format("fasta_pieces")``
with a folder or file that executors see under one path (a shared mount; other
stores are read by ``files.flat_files``). A file is dealt to tasks by ranges of
bytes; each range reads from the first header at or after its start. Rows are
(path, record, name, start, bases, problem): a record's pieces start at
multiples of ``size`` and have ``over`` letters of the next. What is no base or
N is a problem row with its place, as is a record without bases.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SIZE, OVER, RANGE = 4096, 64, 64 << 20
# Letters of bases, those of any, and of amino acids.
ALPHABETS = {"genome": "ACGTN", "iupac": "ACGTNRYKMSWBDHV", "protein": "ABCDEFGHIKLMNPQRSTUVWXYZ*"}
SUFFIXES = (".fa", ".fasta", ".fna", ".faa")


class Piece(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


def located(path: str) -> list[str]:
    """FASTA files of a path, any depth, in order."""
    path = path.removeprefix("file://")
    if os.path.isfile(path):
        return [path]
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.lower().endswith(SUFFIXES) and not f.startswith((".", "_")))


class FastaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.size, self.over, self.range = int(options.get("size", SIZE)), int(options.get("over", OVER)), int(options.get("range", RANGE))
        self.letters = ALPHABETS[options.get("alphabet", "genome")]

    def partitions(self) -> list[Piece]:
        """Ranges of each file; a record belongs to the range of its header."""
        found = []
        for path in located(self.path):
            n = os.path.getsize(path)
            found += [Piece(path, low, min(n, low + self.range)) for low in range(0, max(n, 1), self.range)]
        return found

    def read(self, part: Piece) -> Iterator[tuple]:
        if part is None:
            return
        strange = re.compile(f"[^{re.escape(self.letters)}]+")
        with open(part.path, "rb") as file:
            if part.low:
                file.seek(part.low - 1)
                file.readline()  # the rest of a line that began before
            line, began = b"", file.tell()
            while began < part.high and not (line := file.readline()).startswith(b">"):
                if not line:
                    return
                if part.low == 0 and line.strip():
                    yield part.path, began, None, None, None, "text before the first header"
                began = file.tell()
            while began < part.high and line.startswith(b">"):
                header, at, start, held = line[1:].decode("utf-8", "replace").split(), began, 0, ""
                name, any_bases = header[0] if header else None, False
                while True:
                    line, began = file.readline(), file.tell()
                    ended = not line or line.startswith(b">")
                    text = "" if ended else "".join(line.decode("utf-8", "replace").split()).upper()
                    if (bad := strange.search(text)) is not None:
                        yield part.path, at, name, start + len(held) + bad.start(), None, f"no bases: {bad[0][:20]}"
                        text = strange.sub("", text)
                    held += text
                    any_bases = any_bases or bool(text)
                    while len(held) >= self.size + self.over:
                        yield part.path, at, name, start, held[: self.size + self.over], None
                        held, start = held[self.size :], start + self.size
                    if ended:
                        break
                while held and (start == 0 or held):
                    yield part.path, at, name, start, held[: self.size + self.over], None
                    held, start = held[self.size :], start + self.size
                if not any_bases:
                    yield part.path, at, name, None, None, "no bases"
                began -= len(line)


class FastaPieces(DataSource):
    """Registered as ``fasta_pieces``; options size, over, range, alphabet."""

    @classmethod
    def name(cls) -> str:
        return "fasta_pieces"

    def schema(self) -> str:
        return "path string, record bigint, name string, start bigint, bases string, problem string"

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)
