"""MPEG audio columns: write bytes as a stream of frames, and read any stream back to exact durations and offsets.

Reading resynchronises on frame headers, skips and parses tags (ID3v2, ID3v1), parses the variable-bitrate tables (Xing,
Info, VBRI), verifies the frames' CRC-16 and gives the exact duration as a fraction and each frame's byte offset.

Defined results: a null media value is read as an empty stream (no frames, duration 0/1); bytes without a sync word give
no frames and count as skipped; a truncated last frame is skipped, not guessed. Rows are independent, so repeated rows
give repeated results and an empty table an empty one; only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ridgeline.llm.common import slices

# Fixed values of the MPEG audio frame header (ISO/IEC 11172-3 and 13818-3).
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

UNIT = 192  # payload bytes of one frame of ours
BODY = 23  # header 4, CRC 2, side information of one channel 17
QUIET_SIDE = bytes(17)  # two granules without coded samples: what follows is ancillary data


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    kbps: int
    rate: int
    mode: int
    extension: int
    size: int
    samples: int
    side: int


@lru_cache(maxsize=65536)
def parse_header(word: int) -> Header | None:
    """The frame header in 32 bits, or None if it isn't one (free format counts as none)."""
    if word >> 21 != 0x7FF:
        return None
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    rate, index = word >> 10 & 3, word >> 12 & 15
    if version == 1 or layer == 4 or rate == 3 or index in (0, 15) or word & 3 == 2:
        return None
    family = 1 if version == 3 else 2
    kbps, hertz, padding, mode = BITRATES[family, layer][index], SAMPLE_RATES[version][rate], word >> 9 & 1, word >> 6 & 3
    samples = 384 if layer == 1 else 576 if layer == 3 and family == 2 else 1152
    size = (12_000 * kbps // hertz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + padding
    side = 0 if layer != 3 else ((17, 9) if mode == 3 else (32, 17))[family - 1]
    return Header(version, layer, not word >> 16 & 1, kbps, hertz, mode, word >> 4 & 3, size, samples, side)


@lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, start 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def covered(header: Header) -> int | None:
    """Bytes after the checksum that it covers; None for layer II, whose coverage hangs on its allocation tables."""
    if header.layer == 3:
        return header.side
    if header.layer == 1:
        bound = 4 * (header.extension + 1) if header.mode == 1 else 32
        return 16 if header.mode == 3 else (bound * 2 + 32 - bound) // 2
    return None


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)  # of audio frames, without the table's
    sizes: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int = -1
    table_bytes: int = -1
    toc: bytes = b""
    samples: int = 0
    rate: int = 0
    duration: tuple[int, int] = (0, 1)  # seconds as a fraction
    crc_present: int = 0
    crc_good: int = 0
    skipped: int = 0  # bytes passed over while resynchronising
    resyncs: int = 0
    bitrates: set[int] = field(default_factory=set)


def synchsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def id3v2(data: bytes, stream: Stream) -> int:
    """Parse the tag at the start; bytes to skip."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    major, end = data[3], min(len(data), 10 + synchsafe(data[6:10]))
    at = 10
    while at + 10 <= end and data[at : at + 4].isalnum():
        name = data[at : at + 4].decode("ascii", "replace")
        length = synchsafe(data[at + 4 : at + 8]) if major >= 4 else int.from_bytes(data[at + 4 : at + 8])
        body = data[at + 10 : min(end, at + 10 + length)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            key, _, value = text.rstrip("\0").partition("\0") if name == "TXXX" else (name, "", text.rstrip("\0"))
            stream.tags[key] = value
        at += 10 + length
    return end + 10 * bool(data[5] & 16)


def vbr_table(data: bytes, at: int, header: Header, stream: Stream) -> bool:
    """Parse a table in the frame at ``at``; whether it is one. A table that the frame cuts short is none (VBRI) or lacks what is cut."""
    p = at + 4 + 2 * header.protected + header.side
    if data[p : p + 4] in (b"Xing", b"Info"):
        flags, q = int.from_bytes(data[p + 4 : p + 8]), p + 8
        for bit, name in ((1, "table_frames"), (2, "table_bytes")):
            if flags & bit:
                setattr(stream, name, int.from_bytes(data[q : q + 4]))
                q += 4
        stream.toc = data[q : q + 100] if flags & 4 else b""
        stream.table = data[p : p + 4].decode()
        return True
    p, end = at + 36, at + header.size
    if data[p : p + 4] == b"VBRI" and p + 26 <= end:  # the table's head lies in the frame
        stream.table_bytes, stream.table_frames = struct.unpack(">II", data[p + 10 : p + 18])
        entries, _, width = struct.unpack(">HHH", data[p + 18 : p + 24])
        stream.table, stream.toc = "VBRI", data[p + 26 : min(end, p + 26 + entries * width)]
        return True
    return False


def read_stream(data: bytes) -> Stream:
    stream = Stream()
    end = len(data)
    if end >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        stream.tags["ID3v1.title"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    at = id3v2(data, stream)
    word, first, lost, by_rate = struct.Struct(">I").unpack_from, True, False, {}
    offsets, sizes = stream.offsets, stream.sizes
    while at + 4 <= end:
        header = parse_header(word(data, at)[0])
        good = header is not None and at + header.size <= end
        if good and lost:  # after a loss the next header must be in its place too
            after = at + header.size
            good = after + 4 > end or parse_header(word(data, after)[0]) is not None
        if not good:
            stream.resyncs += not lost
            lost = True
            found = data.find(b"\xff", at + 1, end)
            stream.skipped += (found if found >= 0 else end) - at
            at = found if found >= 0 else end
            continue
        lost = False
        if header.protected and (length := covered(header)) is not None:
            stream.crc_present += 1
            stream.crc_good += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + length]) == int.from_bytes(data[at + 4 : at + 6])
        if not (first and header.layer == 3 and vbr_table(data, at, header, stream)):
            offsets.append(at)
            sizes.append(header.size)
            stream.bitrates.add(header.kbps)
            by_rate[header.rate] = by_rate.get(header.rate, 0) + header.samples
        first = False
        at += header.size
    if at < end:
        stream.skipped += end - at
    stream.samples = sum(by_rate.values())
    stream.rate = max(by_rate, key=by_rate.get, default=0)
    over = 1
    for rate in by_rate:
        over *= rate
    top = sum(n * (over // rate) for rate, n in by_rate.items())
    shared = gcd(top, over) or 1
    stream.duration = (top // shared, over // shared)
    return stream


def _header(kbps_index: int, protected: bool) -> bytes:
    """MPEG-1 layer III, 48 kHz, one channel."""
    return struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | (not protected) << 16 | kbps_index << 12 | 1 << 10 | 3 << 6)


def _frame_parts(kbps_index: int) -> tuple[bytes, bytes]:
    head = _header(kbps_index, True)
    size = parse_header(int.from_bytes(head)).size
    return head + struct.pack(">H", crc16(head[2:] + QUIET_SIDE)) + QUIET_SIDE, bytes(size - BODY - UNIT)


PLAIN, DENSE = _frame_parts(6), _frame_parts(7)  # 80 and 96 kbit/s
PLAIN_SIZE, DENSE_SIZE = 240, 288


def write_stream(payload: bytes) -> bytes:
    """A stream that carries ``payload``, a multiple of UNIT bytes, as the ancillary bytes of silent layer III frames.

    Blocks with bytes over 127 take the next higher bitrate, so the stream has a variable bitrate and a Xing table.
    UTF-8 has no byte 0xFF, so the payload can't look like a sync word.
    """
    frames, ends, at = [], [], 0
    for k in range(0, len(payload), UNIT):
        block = payload[k : k + UNIT]
        head, tail = PLAIN if block.isascii() else DENSE
        frames += (head, block, tail)
        at += PLAIN_SIZE if head is PLAIN[0] else DENSE_SIZE
        ends.append(at)
    n, total = len(ends), at + PLAIN_SIZE
    toc = bytes(min(255, (PLAIN_SIZE + (ends[n * i // 100 - 1] if n * i // 100 else 0)) * 256 // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, n, total) + toc
    table_frame = _header(6, False) + QUIET_SIDE + table
    text = b"\x03payload_bytes\0" + str(len(payload)).encode() + b"\0"
    tag = b"TXXX" + _to_synchsafe(len(text)) + b"\0\0" + text
    v1 = b"TAG" + b"payload".ljust(30, b"\0") + bytes(94) + b"\xff"
    return b"".join([b"ID3\x04\0\0", _to_synchsafe(len(tag)), tag, table_frame.ljust(PLAIN_SIZE, b"\0"), *frames, v1])


def _to_synchsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def read_payload(data: bytes, stream: Stream) -> bytes:
    """The ancillary bytes behind each frame's side information, UNIT at most, as many in all as the tag says."""
    out = []
    word = struct.Struct(">I").unpack_from
    for at, size in zip(stream.offsets, stream.sizes, strict=True):
        header = parse_header(word(data, at)[0])
        start = at + 4 + 2 * header.protected + header.side
        out.append(data[start : min(start + UNIT, at + size)])
    said = stream.tags.get("payload_bytes", "")
    return b"".join(out)[: int(said) if said.isascii() and said.isdigit() else None]


def padded(text: str | None) -> bytes:
    """UTF-8 and spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as an MPEG audio stream: ``(id, n_bytes, media)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                media = [write_stream(padded(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


#: Offsets are stored of each so many frames; 1: of all.
SEEK_STRIDE = 1

READ_COLUMNS = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_frames long, duration_num long, duration_den long, crc_present long, crc_good long, skipped_bytes long, resyncs long, "
    "vbr_table string, table_frames long, tags map<string,string>, seek_offsets array<long>"
)


def describe(data: bytes | None, stride: int = SEEK_STRIDE) -> dict:
    """What reading one stored stream gives; ``seek_offsets`` holds the offset of each ``stride``-th frame."""
    data = data or b""
    s = read_stream(data)
    payload = read_payload(data, s)
    num, den = s.duration
    toc = zlib.crc32(s.toc)
    feature = f"frames={len(s.offsets)};seconds={num}/{den};hz={s.rate};kbps={'+'.join(map(str, sorted(s.bitrates)))};table={s.table or 'none'}:{s.table_frames};toc={toc:08x};crc={s.crc_good}/{s.crc_present};skipped={s.skipped}"
    return {
        "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature,
        "n_frames": len(s.offsets), "duration_num": num, "duration_den": den, "crc_present": s.crc_present, "crc_good": s.crc_good, "skipped_bytes": s.skipped, "resyncs": s.resyncs,
        "vbr_table": s.table, "table_frames": s.table_frames, "tags": list(s.tags.items()), "seek_offsets": s.offsets[::stride],
    }


def read_media(media: DataFrame, media_col: str = "media", stride: int = SEEK_STRIDE) -> DataFrame:
    """Read a column of streams; its other columns stay, but for those named like READ_COLUMNS, and the media goes."""
    made = StructType.fromDDL(READ_COLUMNS).fields
    keep = [c for c in media.columns if c != media_col and c.lower() not in {f.name for f in made}]
    schema = StructType([media.schema[c] for c in keep] + made)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [
            *[pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], *[pa.int64()] * 7, pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int64()),
        ]
        for batch in batches:
            for part in slices(batch):
                rows = [describe(x, stride) for x in part.column(len(keep)).to_pylist()]
                out = [pa.array([r[n] for r in rows], kind) for n, kind in zip(names[len(keep) :], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *out], names=names)

    return media.select(*keep, media_col).mapInArrow(run, schema)
