"""Ogg streams: writing pages, and reading them back with checks.

A page has a 27-byte header, up to 255 lacing values and the data they describe. A packet is a run of 255s and one
smaller value; it may go on over pages. Each logical stream has its serial number, its own page numbers and
a granule position, here the count of samples that end by the page (-1 where no packet ends).

The page checksum is the CRC-32 with polynomial 0x04C11DB7, highest bit first, from 0. It is computed as zlib's CRC of the
bit-reversed bytes, reversed again, so a page takes two C calls.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Fixed values of the format.
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: The header packet of a stream of unsigned 8-bit samples: magic, channels, bits, rate.
SAMPLES = struct.Struct("<8sHHI")
MAGIC, RATE = b"PCM8\0\0\0\0", 8000


def page_crc(page: bytes) -> int:
    """The checksum of a page whose checksum field is zero."""
    raw = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "big").translate(_MIRROR), "little")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, data: bytes) -> bytes:
    head = HEAD.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + data)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + data


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """The pages of one logical stream; packets come with the granule position at their end."""
    lacing, ends = bytearray(), {}
    for data, granule in packets:
        lacing += b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        ends[len(lacing) - 1] = granule
    body, at, pages, flags = b"".join(p for p, _ in packets), 0, [], FIRST
    # the first packet has a page of its own, as readers expect
    first = min(ends, default=0) + 1
    cuts = [(a, min(a + 255, hi)) for lo, hi in ((0, first), (first, len(lacing))) for a in range(lo, hi, 255)]
    for number, (a, b) in enumerate(cuts):
        part = bytes(lacing[a:b])
        size = sum(part)
        ended = [i for i in range(b - 1, a - 1, -1) if i in ends][:1]
        flags |= (CONTINUED if a and lacing[a - 1] == 255 else 0) | (LAST if b == len(lacing) else 0)
        pages.append(_page(flags, ends[ended[0]] if ended else -1, serial, number, part, body[at : at + size]))
        at, flags = at + size, 0
    return pages


def mux(payload: bytes, streams: int = 2, packet: int = 1920, rate: int = RATE) -> bytes:
    """``payload`` as 8-bit samples, dealt packet by packet to ``streams`` logical streams, their pages interleaved."""
    parts: list[list[tuple[bytes, int]]] = [[(SAMPLES.pack(MAGIC, streams, 8, rate), 0)] for _ in range(streams)]
    done = [0] * streams
    for k, at in enumerate(range(0, len(payload), packet)):
        data, s = payload[at : at + packet], k % streams
        done[s] += len(data)
        parts[s].append((data, done[s]))
    pages = [stream_pages(s + 1, p) for s, p in enumerate(parts)]
    longest = max(map(len, pages))
    return b"".join(p[i] for i in range(longest) for p in pages if i < len(p))


@dataclass
class Stream:
    """A logical stream: its packets, and for each the granule position derived for its end (-1: unknown)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    #: Places where pages are missing; packets that ran through them are lost.
    gaps: int = 0
    _open: bytes | None = None


class OggError(ValueError):
    """The bytes are no sound Ogg stream."""


def _page_at(data: bytes, at: int) -> tuple[tuple[int, int, int, int, bytes, bytes], int]:
    """The page at byte ``at``, and where it ends."""
    if len(data) < at + 27 or data[at : at + 4] != CAPTURE:
        raise OggError(f"no page at byte {at}")
    _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(data, at)
    lacing = data[at + 27 : at + 27 + n]
    end = at + 27 + n + sum(lacing)
    if version or len(lacing) < n or end > len(data):
        raise OggError(f"page at byte {at} is cut short or of another version")
    if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
        raise OggError(f"checksum of the page at byte {at}")
    return (flags, granule, serial, number, lacing, data[at + 27 + n : end]), end


def pages_of(data: bytes, resync: bool = False) -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
    """(flags, granule, serial, number, lacing, body) of each page; raises OggError at the first unsound one, or with ``resync`` goes on at the next capture pattern that begins a sound one."""
    at = 0
    while at < len(data):
        try:
            page, at = _page_at(data, at)
        except OggError:
            if not resync:
                raise
            at = data.find(CAPTURE, at + 1)
            if at < 0:
                return
            continue
        yield page


def demux(data: bytes, resync: bool = False) -> dict[int, Stream]:
    """The logical streams by serial number, in order of appearance.

    With ``resync`` unsound pages are left out: packets that lie on sound pages whole are kept, others are lost, and each stream counts its gaps.
    """
    out: dict[int, Stream] = {}
    for flags, granule, serial, number, lacing, body in pages_of(data, resync):
        s = out.setdefault(serial, Stream())
        ordered = number == s.pages and bool(flags & FIRST) == (number == 0) and not s.ended
        joined = bool(flags & CONTINUED) == (s._open is not None)
        if not resync and not ordered:
            raise OggError(f"stream {serial}: page {number} out of order")
        if not resync and not joined:
            raise OggError(f"stream {serial}: page {number} doesn't continue the packet before")
        if not ordered or not joined:
            s.gaps, s._open = s.gaps + 1, None
        tail = bool(flags & CONTINUED) and s._open is None  # the page begins with the end of a lost packet
        s.pages = number + 1
        at, have, own = 0, s._open, len(s.packets)
        values = np.frombuffer(lacing, np.uint8)
        ends = np.flatnonzero(values < 255)
        upto = np.cumsum(values, dtype=np.int64)
        for e in ends:
            stop = int(upto[e])
            if not tail:
                s.packets.append((have or b"") + body[at:stop])
            at, have, tail = stop, None, False
        if len(values) and values[-1] == 255 and not tail:
            have = (have or b"") + body[at:]
        s._open = have
        # the page's position belongs to the last packet that ends on it; those before follow from their sizes
        new = s.packets[own:]
        s.granules += [-1] * len(new)
        if new and granule >= 0:
            g = granule
            for i in range(len(new) - 1, -1, -1):
                s.granules[own + i] = g
                g -= 0 if number == 0 and i == 0 else len(new[i])  # a header has no samples
        s.ended = bool(flags & LAST)
    for serial, s in out.items():
        if s._open is not None or not s.ended:
            if not resync:
                raise OggError(f"stream {serial} is cut short")
            s.gaps, s._open = s.gaps + 1, None
    return out


def read_payload(data: bytes) -> tuple[bytes, dict[int, Stream], int]:
    """The payload that ``mux`` stored, the streams and the sample rate; timestamps are granules / rate."""
    streams = demux(data)
    rate = 0
    for s in streams.values():
        magic, n, bits, rate = SAMPLES.unpack(s.packets[0])
        if magic != MAGIC or n != len(streams) or bits != 8:
            raise OggError("not such samples")
    queues = [s.packets[1:] for s in streams.values()]
    longest = max(map(len, queues), default=0)
    return b"".join(q[i] for i in range(longest) for q in queues if i < len(q)), streams, rate


def padded(text: str | None, multiple: int = 192) -> tuple[bytes, int]:
    """UTF-8 of ``text`` (null: empty), filled with spaces to a positive multiple of ``multiple``; and its own size."""
    raw = (text or "").encode("utf-8")
    return raw.ljust(max(multiple, -(-len(raw) // multiple) * multiple), b" "), len(raw)


def features(payload: bytes, streams: dict[int, Stream], rate: int) -> str:
    """Streams, pages, packets, seconds by the granule positions, mean and deviation of the samples, as text."""
    x = np.frombuffer(payload, np.uint8)
    total, squares = int(x.sum(dtype=np.int64)), int(np.dot(x.astype(np.int64), x))
    mean = total / len(x)
    seconds = ",".join(f"{max(s.granules, default=0) / rate:.6f}" for s in streams.values())
    pages, packets = (sum(len(v) if isinstance(v, list) else v for v in (getattr(s, a) for s in streams.values())) for a in ("pages", "packets"))
    return f"streams={len(streams)};pages={pages};packets={packets};seconds={seconds};mean={mean:.6f};dev={max(0.0, squares / len(x) - mean * mean) ** 0.5:.6f}"


def store_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Add ``out``: the padded text as an Ogg file of 8-bit samples. Null counts as empty; an existing ``out`` is replaced."""
    plain = df.drop(out)
    names = plain.columns

    def run(batches):
        for batch in batches:
            media = [mux(padded(t)[0]) for t in batch.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(media, pa.binary())], names=[*names, out])

    return plain.mapInArrow(run, plain.withColumn(out, F.lit(b"")).schema)


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Add ``packets``: array of (serial, packet, bytes, timestamp in seconds), and ``media_error``.

    Files that fail a check, and null, have null packets; ``media_error`` says why (null file: null). Existing columns of
    these names are replaced.
    """
    plain = df.drop("packets", "media_error")
    names = plain.columns
    kind = "array<struct<serial:long,packet:int,data:binary,seconds:double>>"
    item = pa.struct([("serial", pa.int64()), ("packet", pa.int32()), ("data", pa.binary()), ("seconds", pa.float64())])

    def one(data: bytes | None):
        if data is None:
            return None, None
        try:
            _, streams, rate = read_payload(data)
        except (OggError, struct.error, ZeroDivisionError, IndexError) as e:
            return None, str(e) or type(e).__name__
        return [{"serial": k, "packet": i, "data": p, "seconds": g / rate} for k, s in streams.items() for i, (p, g) in enumerate(zip(s.packets, s.granules, strict=True))], None

    def run(batches):
        for batch in batches:
            got = [one(x) for x in batch.column(names.index(media)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in got], pa.list_(item)), pa.array([e for _, e in got], pa.string())], names=[*names, "packets", "media_error"])

    return plain.mapInArrow(run, plain.withColumn("packets", F.expr(f"cast(null as {kind})")).withColumn("media_error", F.expr("cast(null as string)")).schema)


def media_digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as Ogg, read the stored bytes back with all checks, and return their sizes and digests.

    Null texts count as empty; repeated rows give repeated rows; a null key stays null.
    """

    def run(batch: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {name: [] for name in arrow.names}
        for k, t in zip(batch[key], batch[text], strict=True):
            payload, n = padded(t)
            media = mux(payload)
            back, streams, rate = read_payload(media)
            row = (k, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(back, streams, rate))
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return out

    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
    arrow = pa.schema([(key, pa.int64()), *kinds.items()])
    schema = ", ".join(f"`{f.name}` {'long' if f.type == pa.int64() else 'string'}" for f in arrow)
    return map_arrow(df.select(F.col(key).cast("long").alias(key), text), run, schema, arrow)
