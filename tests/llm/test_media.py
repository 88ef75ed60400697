"""MPEG audio: payloads that look like the format's own marks, seek tables, checksums of all layers."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quire.llm import mpeg_audio as M


@pytest.mark.parametrize("units", [1, 3])
def test_payload_that_looks_like_the_format(units):
    """Tags, headers, tables at every offset of the last unit read back as payload."""
    random.seed(units)
    fill = bytes(random.choices(range(97, 123), k=576 * units))
    for mark in (b"TAG", b"ID3\x03\x00\x00\x00\x00\x00\x10", M._HEADER, b"\xff\xfb\x90\x00", b"Xing\x00\x00\x00\x01", b"VBRI"):
        for at in range(576 * (units - 1), 576 * units - len(mark) + 1):
            payload = fill[:at] + mark + fill[at + len(mark) :]
            data = M.write_stream(payload)
            audio = M.read_stream(data)
            assert M.read_payload(data, audio) == payload, (mark, at)
            assert (audio.frames, audio.skipped, audio.bad_checks) == (units, 0, 0) and "title" not in audio.tags
    data = M.write_stream(M.padded(b"a" * 521 + b"TAG"))
    tagged = M.read_stream(data + b"TAG" + b"name".ljust(125, b"\0"))
    assert (tagged.frames, tagged.skipped, tagged.tags["title"]) == (1, 0, "name")


def test_seek_tables():
    data = M.write_stream(bytes(576 * 50))
    audio = M.read_stream(data)
    assert audio.table_bytes == 51 * 672 and len(audio.seek) == 100
    assert audio.seek.tolist() == [i * 256 // 100 * audio.table_bytes // 256 for i in range(100)]
    header = b"\xff\xfb\x90\x00"
    size = M.parse_header(header).size
    table = b"VBRI" + b"\x00\x01\x00\x00\x00\x00" + (40 * size).to_bytes(4, "big") + (40).to_bytes(4, "big")
    table += b"".join(x.to_bytes(2, "big") for x in (4, 2, 2, 10)) + b"".join(x.to_bytes(2, "big") for x in (10 * size // 2,) * 4)
    first = (header + bytes(32) + table).ljust(size, b"\0")
    vbri = M.read_stream(first + (header + bytes(size - 4)) * 40)
    assert (vbri.table, vbri.table_frames, vbri.table_bytes, vbri.frames) == ("VBRI", 40, 40 * size, 40)
    assert vbri.seek.tolist() == [size + i * (10 * size // 2) * 2 for i in range(4)]
    cut = M.read_stream((first[: 60 + 36]).ljust(size, b"\0")[:70])
    assert len(cut.seek) <= 4


def _bits(values):
    text = "".join(f"{v:0{n}b}" for v, n in values)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big"), len(text)


@pytest.mark.parametrize("second,third,fourth,channels,bands", [
    (0xFE, 0x94, 0xC0, 1, [4] * 32),  # layer I, mono
    (0xFE, 0x94, 0x00, 2, [4] * 32),  # layer I, stereo
    (0xFC, 0xA4, 0x00, 2, [4] * 11 + [3] * 12 + [2] * 4),  # layer II, 192 kbit/s at 48 kHz
    (0xFC, 0x14, 0xC0, 1, [4] * 2 + [3] * 6),  # layer II, 32 kbit/s, mono
])
def test_checksums_of_layers_one_and_two(second, third, fourth, channels, bands):
    header = bytes((0xFF, second, third, fourth))
    h = M.parse_header(header)
    assert h.protected and h.allocation == bands
    random.seed(second + third)
    values = [(random.randrange(1 << n) if random.random() < 0.7 else 0, n) for n in bands for _ in range(channels)]
    if h.layer == 2:
        values += [(random.randrange(4), 2) for v, _ in list(values) if v]
    body, n = _bits(values)
    # An independent bitwise computation of the checksum.
    c = 0xFFFF
    for bit in f"{int.from_bytes(header[2:], 'big'):016b}" + "".join(f"{b:08b}" for b in body)[:n]:
        high = c >> 15 ^ int(bit)
        c = (c << 1 & 0xFFFF) ^ (0x8005 if high else 0)
    frame = (header + c.to_bytes(2, "big") + body).ljust(h.size, b"\x55")
    audio = M.read_stream(frame * 3)
    assert (audio.frames, audio.checked, audio.bad_checks) == (3, 3, 0)
    broken = bytearray(frame * 3)
    broken[h.size + 7] ^= 0x40
    assert M.read_stream(bytes(broken)).bad_checks == 1
    assert M.read_stream(frame * 3).offsets.dtype == np.int64
