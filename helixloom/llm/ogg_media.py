"""Media columns: Ogg containers in binary columns.

``mux`` stores bytes losslessly as 8-bit samples in one logical stream, with
a second logical stream of notes beside it; ``demux`` verifies every page's
checksum, splits the physical stream into its logical streams by serial
number, reassembles packets from the lacing values, across pages where they
continue, and dates packets by granule position.

Defined results: a page whose checksum, capture pattern or length is wrong is
counted in ``bad_pages`` and its content left out, and a packet that loses a
part is counted in ``lost_packets``; empty or null bytes give no streams; an
empty payload gives 64 zero samples. Equal payloads give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

RATE = 8000
PACKET = 2048
ALIGN = 64
# Fixed values of the Ogg format (RFC 3533).
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
NO_GRANULE = -1
SAMPLES, NOTES = b"HLXPCM8\0", b"HLXNOTE\0"
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """Ogg's checksum: polynomial 0x04c11db7, most significant bit first,
    start and end 0. It is zlib's, which goes from the least significant bit,
    over mirrored bytes, mirrored."""
    mirrored = zlib.crc32(data.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def page(serial: int, number: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", page_crc(head + body)) + head[26:] + body


def stream_pages(serial: int, head: bytes, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """Pages of one logical stream: its header packet has the first page."""
    pages = [page(serial, 0, 0, FIRST, bytes([len(head)]), head)]
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    body = b"".join(packets)
    done, at, starts_inside = 0, 0, False
    for k in range(0, len(lacing), 255):
        part = lacing[k : k + 255]
        ended = len(part) - part.count(255)
        size = sum(part)
        done += ended
        flags = CONTINUED * starts_inside | LAST * (k + 255 >= len(lacing))
        pages.append(page(serial, len(pages), granules[done - 1] if ended else NO_GRANULE, flags, part, body[at : at + size]))
        at, starts_inside = at + size, part[-1] == 255
    return pages


def mux(payload: bytes, n_bytes: int, rate: int = RATE, packet: int = PACKET) -> bytes:
    """Two logical streams: the samples, and a note of the true length."""
    packets = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    ends = np.minimum(np.arange(1, len(packets) + 1) * packet, len(payload)).tolist()
    serial = zlib.crc32(payload)
    a = stream_pages(serial, SAMPLES + struct.pack("<IB", rate, 1), packets, ends)
    b = stream_pages(serial ^ 0xFFFFFFFF, NOTES, [b"BYTES=%d" % n_bytes], [len(payload)])
    return b"".join([a[0], b[0], *a[1:2], *b[1:], *a[2:]])


@dataclass
class Stream:
    """A logical stream: packets and, where known, each packet's end granule."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    open: list[bytes] | None = None
    next_page: int | None = None


def demux(data: bytes) -> tuple[list[Stream], int]:
    """The logical streams in order of their first pages, and bad pages."""
    streams: dict[int, Stream] = {}
    bad, at = 0, 0
    while (at := data.find(CAPTURE, at)) >= 0:
        if at + HEADER.size > len(data):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, count = HEADER.unpack_from(data, at)
        body_at = at + HEADER.size + count
        lacing = data[at + HEADER.size : body_at]
        end = body_at + sum(lacing)
        if version or len(lacing) < count or end > len(data) or page_crc(data[at : at + 22] + bytes(4) + data[at + 26 : end]) != crc:
            bad, at = bad + 1, at + 1
            continue
        s = streams.setdefault(serial, Stream(serial))
        take_page(s, flags, granule, number, lacing, data[body_at:end])
        at = end
    for s in streams.values():
        s.lost += s.open is not None
    return list(streams.values()), bad


def take_page(s: Stream, flags: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
    if s.open is not None and (not flags & CONTINUED or number != s.next_page):
        s.open, s.lost = None, s.lost + 1
    skip = bool(flags & CONTINUED) and s.open is None
    s.pages, s.next_page = s.pages + 1, number + 1
    at, begin, ended = 0, 0, 0
    for value in lacing:
        at += value
        if value == 255:
            continue
        if skip:
            skip = False
        else:
            s.packets.append(b"".join([*(s.open or []), body[begin:at]]))
            s.granules.append(None)
            ended += 1
        s.open, begin = None, at
    if ended:
        s.granules[-1] = None if granule == NO_GRANULE else granule
    if lacing and lacing[-1] == 255 and not skip:
        s.open = [*(s.open or []), body[begin:]]


def sample_stream(streams: list[Stream]) -> Stream | None:
    return next((s for s in streams if s.packets and s.packets[0].startswith(SAMPLES)), None)


def timestamps(s: Stream) -> list[float]:
    """Start second of each sample packet: a page's granule dates the end of
    its last packet, and a packet lasts as long as it has samples."""
    rate = struct.unpack_from("<I", s.packets[0], len(SAMPLES))[0]
    ends: list[int] = []
    at: int | None = None
    for packet, granule in zip(reversed(s.packets[1:]), reversed(s.granules[1:])):
        at = granule if granule is not None else at
        if at is None:
            at = sum(map(len, s.packets[1:]))
        at -= len(packet)
        ends.append(at)
    return [x / rate for x in reversed(ends)]


def describe(data: bytes) -> tuple[bytes, str]:
    """The payload read back from the container, and its features."""
    streams, bad = demux(data)
    s = sample_stream(streams)
    payload = b"".join(s.packets[1:]) if s else b""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    starts = timestamps(s) if s else []
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    levels = np.bincount(x + 128, minlength=256) / max(1, len(x))
    spread = levels[levels > 0]
    seconds = (s.granules[-1] or 0) / RATE if s and len(s.packets) > 1 else 0.0
    return payload, (
        f"streams={len(streams)};pages={sum(t.pages for t in streams)};packets={sum(len(t.packets) for t in streams)}"
        f";bad_pages={bad};lost_packets={sum(t.lost for t in streams)};seconds={seconds:.6f};last_start={starts[-1] if starts else 0:.6f}"
        f";mean={x.mean() if len(x) else 0:.6f};rms={np.sqrt((x.astype(np.float64) ** 2).mean()) if len(x) else 0:.6f}"
        f";crossings={crossings};entropy={-(spread * np.log2(spread)).sum() if len(spread) else 0:.6f}"
    )


def encode(docs: DataFrame, *keys: Column | str) -> DataFrame:
    """``keys``, n_bytes and a binary column ``media`` of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x in batch.column(batch.num_columns - 1):
                raw = x.as_buffer().to_pybytes()
                made.append((len(raw), mux(raw + bytes(-len(raw) % ALIGN or ALIGN * (not raw)), len(raw))))
            columns = [*batch.columns[:-1], pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*list(batch.schema)[:-1], pa.field("n_bytes", pa.int64()), pa.field("media", pa.binary())]))

    rows = docs.select(*keys, F.encode(text_of(), "UTF-8").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{schema}, n_bytes bigint, media binary")


def decode(media: DataFrame) -> DataFrame:
    """Reads the stored containers back: all columns but ``media``, and what
    the bytes say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in MADE}
            for x in batch.column(batch.num_columns - 1):
                data = x.as_buffer().to_pybytes() if x.is_valid else b""
                payload, feature = describe(data)
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), feature)
                for k, v in zip(MADE, row):
                    out[k].append(v)
            columns = [*batch.columns[:-1], *(pa.array(v, MADE[k]) for k, v in out.items())]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*list(batch.schema)[:-1], *(pa.field(k, t) for k, t in MADE.items())]))

    keys = [c for c in media.columns if c != "media"]
    rows = media.select(*keys, "media")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(run, f"{schema}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


MADE = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}


def packets(media: DataFrame) -> DataFrame:
    """A row per packet of each container of columns (id, media): id, serial,
    packet_no, n_bytes, start_seconds (null in streams without samples)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                streams, _ = demux(x.as_buffer().to_pybytes() if x.is_valid else b"")
                main = sample_stream(streams)
                rows = []
                for s in streams:
                    times = [None, *timestamps(s)] if s is main else [None] * len(s.packets)
                    rows += [(key, s.serial, i, len(p), times[i]) for i, p in enumerate(s.packets)]
                if rows:
                    a, b, c, d, e = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64()), pa.array(e, pa.float64())],
                        names=["id", "serial", "packet_no", "n_bytes", "start_seconds"],
                    )

    return media.select(F.col("id").cast("long"), "media").mapInArrow(run, "id bigint, serial bigint, packet_no bigint, n_bytes bigint, start_seconds double")


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id and the digest columns of each text's container."""
    return decode(encode(docs, F.col("doc_id").cast("long").alias("doc_id")))
