"""MPEG audio columns: payloads stored in MPEG-1 layer III streams, and a reader that resynchronises.

The writer makes a valid constant-bitrate stream: an ID3v2 tag, a frame with an Info table (frame count, byte count, seek
points), then one frame of 1152 samples for every 576 bytes of payload. A frame holds header, CRC-16, side information of silent
granules (part2_3_length 0), the payload as ancillary data, and padding; 576 one-byte units per frame, lossless.

The reader takes any bytes: it skips ID3v2 tags, parses ID3v1, searches for a frame header where the next one isn't in place, accepts a
header if another follows where it says (or the data end there), checks CRC-16 where a frame of any layer has it, reads Xing/Info and VBRI tables with
their seek points, and gives exact durations (samples over rate) and every frame's offset. Runs of equal frames are parsed by numpy at once.

Defined results: null text is an empty payload (one frame of padding bytes); equal texts give equal media; a text of any length is one stream, held in
memory by one task; bytes without any frame give no frame and duration 0; skipped bytes are counted; a table that is cut off gives the seek points
that are there; repeated rows get equal results; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches, strings

#: Payload bytes of a frame, and what fills up the last frame's.
UNIT, FILL = 576, 0xFF

# Fixed values of the format (ISO 11172-3 and 13818-3): kbit/s by index, and Hz.
_BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
# Fixed values of the format: (subbands, bits of their allocation) in layer II, by the table's name.
_ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}


@dataclass(frozen=True)
class Header:
    """A frame header's fields."""

    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padding: int
    mono: bool
    bound: int  # the first subband whose allocation both channels share (layers I and II)

    @property
    def samples(self) -> int:
        if self.layer == 1:
            return 384
        return 576 if self.layer == 3 and self.version != 3 else 1152

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12 * self.bitrate // self.rate + self.padding) * 4
        return self.samples // 8 * self.bitrate // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of side information (layer III)."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    @property
    def allocation(self) -> list[int]:
        """Bits of each subband's allocation (layers I and II)."""
        if self.layer == 1:
            return [4] * 32
        each = self.bitrate // (1 if self.mono else 2)
        if self.version != 3:
            name = "low"
        elif each <= 48_000:
            name = "d" if self.rate == 32000 else "c"
        else:
            name = "a" if self.rate == 48000 or each <= 80_000 else "b"
        return [bits for n, bits in _ALLOCATION[name] for _ in range(n)]


@functools.lru_cache(maxsize=4096)
def parse_header(four: bytes) -> Header | None:
    """The header in four bytes, or None; free-format streams aren't supported."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bitrate, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or bitrate in (0, 15) or rate == 3 or four[3] & 3 == 2:
        return None
    kbit = _BITRATES[(1 if version == 3 else 2, layer)][bitrate]
    return Header(version, layer, not four[1] & 1, kbit * 1000, _RATES[version][rate], four[2] >> 1 & 1, four[3] >> 6 == 3, 4 * (four[3] >> 4 & 3) + 4 if four[3] >> 6 == 1 else 32)


@functools.cache
def _crc_table() -> tuple[int, ...]:
    """CRC-16 with polynomial 0x8005, most significant bit first, by byte."""
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return tuple(out)


def crc16(data: bytes, start: int = 0xFFFF) -> int:
    table, c = _crc_table(), start
    for b in data:
        c = (c << 8 & 0xFFFF) ^ table[c >> 8 ^ b]
    return c


def crc16_bits(data: bytes, bits: int, start: int = 0xFFFF) -> int:
    """The same over the first so many bits."""
    c = crc16(data[: bits // 8], start)
    for i in range(bits // 8 * 8, bits):
        bit = data[i // 8] >> (7 - i % 8) & 1
        c = (c << 1 ^ 0x8005 if (c >> 15) ^ bit else c << 1) & 0xFFFF
    return c


# --------------------------------------------------------------------------- writing
#: MPEG-1, layer III, protected, 224 kbit/s, 48 kHz, mono: frames of 672 bytes.
_HEADER = bytes((0xFF, 0xFA, 0xC4, 0xC0))
_FRAME = parse_header(_HEADER).size  # type: ignore[union-attr]
_SIDE = bytes(17)
_CRC = crc16(_HEADER[2:] + _SIDE).to_bytes(2, "big")
_FRONT = _HEADER + _CRC + _SIDE
_AT = len(_FRONT)


def _tag() -> bytes:
    """An ID3v2.3 tag that names the content."""
    text = b"\x00payload"
    frame = b"TIT2" + len(text).to_bytes(4, "big") + b"\x00\x00" + text
    n = len(frame)
    return b"ID3\x03\x00\x00" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + frame


def padded(data: bytes) -> bytes:
    """The data with bytes 255 up to a positive multiple of the unit."""
    return data + bytes([FILL]) * (-len(data) % UNIT if data else UNIT)


def write_stream(payload: bytes) -> bytes:
    """A stream that holds the payload, whose length is a multiple of the unit."""
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, _FRAME), dtype=np.uint8)
    frames[:, :_AT] = np.frombuffer(_FRONT, dtype=np.uint8)
    frames[1:, _AT : _AT + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(n, UNIT)
    seek = bytes(i * 256 // 100 for i in range(100))
    info = b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + ((n + 1) * _FRAME).to_bytes(4, "big") + seek
    frames[0, _AT : _AT + len(info)] = np.frombuffer(info, dtype=np.uint8)
    return _tag() + frames.tobytes()


# --------------------------------------------------------------------------- reading
@dataclass
class Audio:
    """What a stream holds."""

    frames: int = 0
    samples: int = 0
    rate: int = 0
    duration_us: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int32))
    checked: int = 0
    bad_checks: int = 0
    skipped: int = 0
    table: str = ""
    table_frames: int = 0
    table_bytes: int = 0
    #: Byte offsets from the table's frame on: of each hundredth of the duration (Xing, Info), or of each entry (VBRI).
    seek: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    tags: dict[str, str] = field(default_factory=dict)


def _text(data: bytes) -> str:
    """An ID3v2 text frame's content."""
    if not data:
        return ""
    name = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[0], "latin-1")
    return data[1:].decode(name, "replace").split("\0")[0]


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Reads a tag at this place; where it ends, or ``at`` if none is there."""
    if data[at : at + 3] != b"ID3" or at + 10 > len(data) or any(b & 0x80 for b in data[at + 6 : at + 10]):
        return at
    size = functools.reduce(lambda n, b: n << 7 | b, data[at + 6 : at + 10], 0)
    end, major, i = min(len(data), at + 10 + size), data[at + 3], at + 10
    while major >= 3 and i + 10 <= end and data[i]:
        part = data[i + 4 : i + 8]
        n = functools.reduce(lambda x, b: x << 7 | b, part, 0) if major == 4 else int.from_bytes(part, "big")
        name = data[i : i + 4].decode("latin-1")
        if name.startswith("T"):
            tags[name] = _text(data[i + 10 : min(end, i + 10 + n)])
        i += 10 + n
    return end + (10 if data[at + 5] & 0x10 and end < len(data) else 0)


def _number(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "big")


def _table(data: bytes, at: int, header: Header, out: Audio) -> bool:
    """Reads a variable-bitrate table in a frame; whether there is one."""
    body = at + 4 + (2 if header.protected else 0) + header.side
    end = min(len(data), at + header.size)
    for place in {body, at + 4 + header.side}:
        if data[place : place + 4] in (b"Xing", b"Info"):
            out.table = data[place : place + 4].decode()
            flags, place = _number(data, place + 4, 4), place + 8
            if flags & 1:
                out.table_frames, place = _number(data, place, 4), place + 4
            if flags & 2:
                out.table_bytes, place = _number(data, place, 4), place + 4
            if flags & 4:
                points = np.frombuffer(data[place : min(end, place + 100)], dtype=np.uint8).astype(np.int64)
                out.seek = points * out.table_bytes // 256
            return True
    if data[at + 36 : at + 40] == b"VBRI":
        out.table, out.table_bytes, out.table_frames = "VBRI", _number(data, at + 46, 4), _number(data, at + 50, 4)
        entries, scale, size = (_number(data, at + i, 2) for i in (54, 56, 58))
        place = at + 62
        steps = [_number(data, i, size) for i in range(place, min(end - size, place + (entries - 1) * size) + 1, size)] if size in (1, 2, 3, 4) else []
        # An entry says how many bytes its frames take; the first frames follow the table's own.
        out.seek = header.size + np.cumsum([0, *steps[:-1]]) * scale if steps else out.seek
        return True
    return False


def _checked(data: bytes, at: int, header: Header) -> bool:
    """Whether a frame's checksum is right: it covers the header's second half and the side information, or the allocation of bits."""
    stored, first = _number(data, at + 4, 2), crc16(data[at + 2 : at + 4])
    body = data[at + 6 : at + header.size]
    if header.layer == 3:
        return crc16(body[: header.side], first) == stored
    # Layers I and II: each channel's allocation up to the bound, a common one from there on; in layer II two bits for each that isn't zero.
    bits = int.from_bytes(body[:64].ljust(64, b"\0"), "big")
    used = chosen = 0
    for band, width in enumerate(header.allocation):
        common = band >= header.bound
        for _ in range(1 if header.mono or common else 2):
            chosen += bool(bits >> (512 - used - width) & ((1 << width) - 1)) * (2 if common and not header.mono else 1)
            used += width
    used += 2 * chosen if header.layer == 2 else 0
    return used <= 8 * len(body) and crc16_bits(body, used, first) == stored


def read_stream(data: bytes) -> Audio:
    """Frames, tables and tags of a stream; lost synchronisation is searched for again."""
    out = Audio()
    end = len(data)
    if data[-128:-125] == b"TAG" and end >= 128:
        end -= 128  # a tag, unless a frame of the chain turns out to hold that place
    at = _id3v2(data, 0, out.tags)
    view = np.frombuffer(data, dtype=np.uint8)
    offsets: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    first: Header | None = None
    synced = False
    while at < end and at + 4 <= len(data):
        header = parse_header(data[at : at + 4])
        after = at + header.size if header else 0
        if header and end < after and (after == len(data) or parse_header(data[after : after + 4]) is not None) and (first is None or (header.rate == first.rate and header.layer == first.layer)):
            end = len(data)
        good = header is not None and after <= end and header.size >= 4
        if good and not synced:  # a lone header may be chance: another must follow, or the end
            good = after == end or data[after : after + 3] == b"ID3" or parse_header(data[after : after + 4]) is not None
        if good and first is not None and header is not None:
            good = header.rate == first.rate and header.layer == first.layer
        if not good or header is None:
            if (past := _id3v2(data, at, out.tags)) > at:
                at = past
                continue
            found = data.find(b"\xff", at + 1, end)
            out.skipped += (found if found >= 0 else end) - at
            at, synced = (found if found >= 0 else end), False
            continue
        synced = True
        if first is None:
            first = header
            out.rate = header.rate
            if _table(data, at, header, out):
                at = after
                continue
        # The run of frames that begin just like this one is taken at once.
        size, most = header.size, (end - at) // header.size
        head = view[at : at + most * size].reshape(most, size)
        front = 4 + ((2 + (header.side or 64)) if header.protected else 0)  # what the checksum covers is within it
        same = (head[:, :front] == head[0, :front]).all(axis=1)
        run = int(most if same.all() else np.argmin(same))
        offsets.append(at + size * np.arange(run, dtype=np.int64))
        sizes.append(np.full(run, size, dtype=np.int32))
        if header.protected:
            out.checked += run  # equal headers, side information and checksums: one check holds for all
            out.bad_checks += 0 if _checked(data, at, header) else run
        out.frames += run
        out.samples += run * header.samples
        at += run * size
    out.skipped += max(0, end - at)
    if end < len(data):
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            out.tags[name] = data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip()
    if offsets:
        out.offsets, out.sizes = np.concatenate(offsets), np.concatenate(sizes)
    out.duration_us = out.samples * 1_000_000 // out.rate if out.rate else 0
    return out


def read_payload(data: bytes, audio: Audio) -> bytes:
    """The payload of a stream that write_stream made, by the reader's frame offsets."""
    if not audio.frames:
        return b""
    view = np.frombuffer(data, dtype=np.uint8)
    if audio.offsets[-1] - audio.offsets[0] == (audio.frames - 1) * _FRAME:
        start = int(audio.offsets[0])
        return view[start : start + audio.frames * _FRAME].reshape(-1, _FRAME)[:, _AT : _AT + UNIT].tobytes()
    return b"".join(data[o + _AT : o + _AT + UNIT] for o in audio.offsets.tolist())


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media) for every row: the whole text's UTF-8 bytes as an audio stream."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            data = [t.encode() for t in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, data)), pa.int64()), pa.array([write_stream(padded(d)) for d in data], pa.binary())], schema=kind
            )

        return each

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(source, make, "doc_id bigint, n_bytes bigint, media binary")


DECODED = (
    "doc_id bigint, n_bytes bigint, media binary, payload binary, frames int, sample_rate int, samples bigint, duration_us bigint, "
    "checked int, bad_checks int, skipped_bytes bigint, seek_table string, table_frames int, tags map<string,string>, frame_offsets array<bigint>, seek_offsets array<bigint>"
)


def decode_media(media: DataFrame) -> DataFrame:
    """Reads the stored bytes: payload, exact duration, frame offsets, tables, tags and checksum results."""
    kind = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("frames", pa.int32()),
            ("sample_rate", pa.int32()), ("samples", pa.int64()), ("duration_us", pa.int64()), ("checked", pa.int32()), ("bad_checks", pa.int32()),
            ("skipped_bytes", pa.int64()), ("seek_table", pa.string()), ("table_frames", pa.int32()), ("tags", pa.map_(pa.string(), pa.string())),
            ("frame_offsets", pa.list_(pa.int64())), ("seek_offsets", pa.list_(pa.int64())),
        ]
    )

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            out: list[list] = [[] for _ in kind]
            for doc_id, n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = data or b""
                a = read_stream(data)
                row = (doc_id, n, data, read_payload(data, a), a.frames, a.rate, a.samples, a.duration_us, a.checked, a.bad_checks, a.skipped, a.table, a.table_frames)
                for c, v in zip(out, (*row, sorted(a.tags.items()), a.offsets, a.seek), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kind, strict=True)], schema=kind)

        return each

    return map_batches(media, make, DECODED)
