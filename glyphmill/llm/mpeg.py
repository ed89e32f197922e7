"""MPEG audio columns: a lossless carrier for bytes, and a parser of streams.

The writer stores a payload in the ancillary bytes of silent MPEG-1 Layer III mono frames,
behind an ID3v2 tag (which holds the payload's length) and a frame with a variable-bitrate
table. The parser takes any byte string: it reads tags, resynchronises on frame headers past
garbage, reads Xing, Info and VBRI tables, verifies the checksums of Layer III frames (those of
Layers I and II are counted as unchecked), and gives exact durations (whole samples over the
sample rate) and the byte offset of every frame. Free-format frames are not parsed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, small_slices, text_column, tidy

UNIT = 64

# Fixed values of the MPEG audio format: kbit/s by bitrate index (1 to 14) and Hz by rate index.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {"1": (44100, 48000, 32000), "2": (22050, 24000, 16000), "2.5": (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    bitrate: int
    sample_rate: int
    padding: int
    channels: int
    length: int
    samples: int

    @property
    def side_info(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.channels == 1 else 32) if self.version == "1" else (9 if self.channels == 1 else 17)


@lru_cache(4096)
def read_header(word: int) -> Header | None:
    """The header in a 32-bit word, or none (free-format frames are not taken)."""
    if word >> 21 != 0x7FF:
        return None
    version = {0: "2.5", 2: "2", 3: "1"}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    rate, hertz = word >> 12 & 15, word >> 10 & 3
    if version is None or layer == 4 or rate in (0, 15) or hertz == 3 or word & 3 == 2:
        return None
    family = (1 if version == "1" else 2, layer)
    bitrate, sample_rate, padding = BITRATES[family][rate - 1] * 1000, SAMPLE_RATES[version][hertz], word >> 9 & 1
    samples = SAMPLES[family]
    length = (12 * bitrate // sample_rate + padding) * 4 if layer == 1 else samples // 8 * bitrate // sample_rate + padding
    return Header(version, layer, not word >> 16 & 1, bitrate, sample_rate, padding, 1 if word >> 6 & 3 == 3 else 2, length, samples)


@lru_cache(65536)
def crc16(data: bytes) -> int:
    """CRC-16 of the format: polynomial 0x8005, start 0xFFFF, bits from the highest."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _unsyncsafe(b: bytes) -> int:
    return (b[0] & 0x7F) << 21 | (b[1] & 0x7F) << 14 | (b[2] & 0x7F) << 7 | b[3] & 0x7F


@dataclass
class Stream:
    """What the parser found; ``starts`` and ``headers`` leave out the frame with the table.

    ``checked`` frames had their checksum compared (``wrong`` of them in vain); ``unchecked`` ones have one that was not compared.
    """

    tags: dict[str, str] = field(default_factory=dict)
    starts: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    checked: int = 0
    wrong: int = 0
    unchecked: int = 0
    skipped: int = 0
    table: dict | None = None

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def duration(self) -> tuple[int, int]:
        """Seconds as a reduced fraction; 0/1 for no frames. All frames count at the first one's rate."""
        if not self.headers:
            return 0, 1
        n, rate = self.samples, self.headers[0].sample_rate
        g = gcd(n, rate)
        return n // g, rate // g


def read_tags(data: bytes, old_tag: bool = True) -> tuple[dict[str, str], int, int]:
    """Text frames of ID3v2.3/2.4 and (with ``old_tag``) the fields of ID3v1, with the bounds of the audio between."""
    tags, begin, end = {}, 0, len(data)
    while data[begin : begin + 3] == b"ID3" and begin + 10 <= len(data):
        major, size = data[begin + 3], _unsyncsafe(data[begin + 6 : begin + 10])
        at, stop = begin + 10, min(begin + 10 + size, len(data))
        while at + 10 <= stop and data[at] != 0:
            name = data[at : at + 4].decode("latin-1")
            length = _unsyncsafe(data[at + 4 : at + 8]) if major >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
            body = data[at + 10 : min(at + 10 + length, stop)]
            if name.startswith("T") and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
                key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
                tags[key] = value
            at += 10 + length
        begin += 10 + size + (10 if major >= 4 and data[begin + 5] & 0x10 else 0)
    if old_tag and end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        old = data[end - 128 : end]
        for key, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if value := old[a:b].rstrip(b"\0 ").decode("latin-1"):
                tags.setdefault(key, value)
        end -= 128
    return tags, min(begin, end), end


def read_table(frame: bytes, header: Header) -> dict | None:
    """The Xing, Info or VBRI table of a first frame: kind, frames, bytes and seek points."""
    at = 4 + 2 * header.protected + header.side_info
    kind = frame[at : at + 4]
    if kind in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        out: dict = {"kind": kind.decode(), "frames": None, "bytes": None, "seek": []}
        for bit, key in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[key], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4:
            out["seek"] = list(frame[at : at + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width = struct.unpack(">IIHHH", frame[46:60])
        points = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "seek": points}
    return None


def parse(data: bytes) -> Stream:
    """Parse any byte string; never raises.

    A header counts if the next one follows its frame or the audio ends there, or if it follows a
    frame itself and is of the same version, layer, rate and channels. TAG at 128 bytes before the
    end is an ID3v1 tag, unless it lies within chained frames that reach the very end.
    """
    if data[-128:-125] == b"TAG":
        out, chain, at = _walk(data, False)
        if chain <= len(data) - 128 and at == len(data):
            return out
    return _walk(data, True)[0]


def _walk(data: bytes, old_tag: bool) -> tuple[Stream, int, int]:
    """What was found, and the bounds of the last chain of frames (its begin is the end where no frame comes last)."""
    out = Stream()
    out.tags, at, end = read_tags(data, old_tag)

    def header_at(i: int) -> Header | None:
        return read_header(int.from_bytes(data[i : i + 4], "big")) if i + 4 <= end else None

    last, first, chain = None, True, end
    kind = lambda h: (h.version, h.layer, h.sample_rate, h.channels)
    while at + 4 <= end:
        header = header_at(at)
        after = at + header.length if header else 0
        if header is None or after > end or after + 4 <= end and header_at(after) is None and (last is None or kind(last) != kind(header)):
            found = data.find(b"\xff", at + 1, end)
            to = end if found < 0 else found
            out.skipped += to - at
            at, last, chain = to, None, end
            continue
        chain = at if last is None else chain
        if header.protected and header.layer != 3:
            out.unchecked += 1
        elif header.protected:
            out.checked += 1
            body = data[at + 2 : at + 4] + data[at + 6 : at + 6 + header.side_info]
            if crc16(body) != int.from_bytes(data[at + 4 : at + 6], "big"):
                out.wrong += 1
        table = read_table(data[at:after], header) if first else None
        if table:
            out.table = table
        else:
            out.starts.append(at)
            out.headers.append(header)
        at, last, first = after, header, False
    out.skipped += max(0, end - at) if at < end else 0
    return out, chain, at


def _frame(rate_index: int, body: bytes) -> bytes:
    """A protected silent mono frame at 32 kHz; the body fills its main data."""
    word = 0xFFFA0000 | rate_index << 12 | 2 << 10 | 3 << 6
    head = word.to_bytes(4, "big")
    side = bytes(17)
    return b"".join((head, crc16(head[2:] + side).to_bytes(2, "big"), side, body))


_ROOM = tuple(read_header(0xFFFA0000 | k << 12 | 2 << 10 | 3 << 6).length - 23 for k in range(1, 15))


def encode(payload: bytes) -> bytes:
    """A stream that carries the payload: full frames at the highest rate, then the smallest that holds the rest."""
    most = _ROOM[-1]
    frames = [_frame(14, payload[at : at + most]) for at in range(0, len(payload) - most + 1, most)]
    rest = payload[len(frames) * most :]
    if rest or not frames:
        index = next(k for k, room in enumerate(_ROOM) if room >= len(rest))
        frames.append(_frame(index + 1, rest.ljust(_ROOM[index], b"\0")))
    ends = np.cumsum([len(f) for f in frames])
    size = int(ends[-1])
    seek = bytes(min(255, int(ends[len(ends) * k // 100] - len(frames[len(frames) * k // 100])) * 256 // size) for k in range(100))
    index = next(k for k, room in enumerate(_ROOM) if room >= 116)
    table = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + size.to_bytes(4, "big") + seek
    name = b"\x03payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + _syncsafe(len(name)) + b"\0\0" + name
    return b"".join((b"ID3\x04\0\0", _syncsafe(len(tag)), tag, _frame(index + 1, table.ljust(_ROOM[index], b"\0")), *frames))


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The stored bytes: the main data of all frames, cut to the length that the tag holds."""
    parts = [data[a + 4 + 2 * h.protected + h.side_info : a + h.length] for a, h in zip(stream.starts, stream.headers, strict=True)]
    length = stream.tags.get("payload_bytes", "")
    whole = b"".join(parts)
    return whole[: int(length)] if length.isdigit() else whole


def padded(text: bytes) -> bytes:
    """The text with zeros up to a positive multiple of 64 bytes."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (the stream of the padded text) for each input row.

    Null and empty texts are stored as 64 zero bytes. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text", 8 << 20):
            texts = text_column(batch, "text").fill_null("").cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, media binary")


PARSED = (
    "tags map<string,string>, frames int, samples long, sample_rate int, duration_num long, duration_den long, checked int, wrong int, unchecked int, "
    "skipped long, table_kind string, table_frames long, table_bytes long, table_seek array<long>, frame_offsets array<long>, bitrates array<int>, payload binary"
)


def _parsed(data: bytes | None) -> dict:
    data = data or b""
    s = parse(data)
    table = s.table or {}
    return {
        "tags": list(s.tags.items()),
        "frames": len(s.starts),
        "samples": s.samples,
        "sample_rate": s.headers[0].sample_rate if s.headers else None,
        "duration_num": s.duration[0],
        "duration_den": s.duration[1],
        "checked": s.checked,
        "wrong": s.wrong,
        "unchecked": s.unchecked,
        "skipped": s.skipped,
        "table_kind": table.get("kind"),
        "table_frames": table.get("frames"),
        "table_bytes": table.get("bytes"),
        "table_seek": table.get("seek"),
        "frame_offsets": s.starts,
        "bitrates": [h.bitrate for h in s.headers],
        "payload": payload_of(data, s),
    }


_PARSED_ARROW = pa.struct(
    [
        pa.field("tags", pa.map_(pa.string(), pa.string())),
        *[pa.field(n, pa.int32()) for n in ("frames",)],
        pa.field("samples", pa.int64()),
        pa.field("sample_rate", pa.int32()),
        pa.field("duration_num", pa.int64()),
        pa.field("duration_den", pa.int64()),
        pa.field("checked", pa.int32()),
        pa.field("wrong", pa.int32()),
        pa.field("unchecked", pa.int32()),
        pa.field("skipped", pa.int64()),
        pa.field("table_kind", pa.string()),
        pa.field("table_frames", pa.int64()),
        pa.field("table_bytes", pa.int64()),
        pa.field("table_seek", pa.list_(pa.int64())),
        pa.field("frame_offsets", pa.list_(pa.int64())),
        pa.field("bitrates", pa.list_(pa.int32())),
        pa.field("payload", pa.binary()),
    ]
)


def parse_media(rows: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, media, and a struct ``audio`` with what the parser found.

    A null or empty stream, or one without frames, has 0 frames, duration 0/1 and no payload.
    """
    kept = [F.col(c) for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                media = part.column(part.num_columns - 1)
                audio = pa.array([_parsed(m) for m in media.to_pylist()], _PARSED_ARROW)
                yield pa.RecordBatch.from_arrays([*part.columns, audio], [*part.schema.names, "audio"])

    narrow = rows.select(F.col(id_col).alias("doc_id"), *kept, F.col(media_col).alias("media"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields)
    return narrow.mapInArrow(tidy(run), f"{fields}, audio struct<{PARSED}>")


def op7(spark, sf_dir: str) -> DataFrame:
    rows = parse_media(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), keep=("n_bytes",))
    audio = lambda name: F.col(f"audio.{name}").cast("string")
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("frames="), audio("frames")),
        F.concat(F.lit("rate="), audio("sample_rate")),
        F.concat(F.lit("seconds="), audio("duration_num"), F.lit("/"), audio("duration_den")),
        F.concat(F.lit("checked="), audio("checked")),
        F.concat(F.lit("wrong="), audio("wrong")),
        F.concat(F.lit("table="), audio("table_kind"), F.lit(":"), audio("table_frames"), F.lit(":"), audio("table_bytes")),
        F.concat(F.lit("offsets="), F.md5(F.array_join(F.col("audio.frame_offsets").cast("array<string>"), ",").cast("binary"))),
    )
    payload = F.col("audio.payload")
    tail = F.substring(payload, F.length(payload) - (UNIT - 1), F.lit(UNIT))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
