"""Metadata and frame index of MP4 files without a codec: boxes of the ISO base media file format."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


@dataclass
class Track:
    codec: str
    width: int
    height: int
    timescale: int
    duration: int
    pts: np.ndarray  #: in decode order
    is_keyframe: np.ndarray
    sizes: np.ndarray

    @property
    def num_frames(self) -> int:
        return len(self.pts)

    @property
    def duration_sec(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    @property
    def fps(self) -> float:
        return self.num_frames / self.duration_sec if self.duration else 0.0


def boxes(data: bytes, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, stop) of the contents of each box."""
    while start + 8 <= stop:
        size, kind = struct.unpack(">I4s", data[start : start + 8])
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", data[start + 8 : start + 16])[0], 16
        elif size == 0:
            size = stop - start
        if size < head or start + size > stop:
            raise ValueError(f"the box at byte {start} is broken")
        yield kind, start + head, start + size
        start += size


def _find(data: bytes, start: int, stop: int, out: dict[bytes, bytes]) -> dict[bytes, bytes]:
    for kind, a, b in boxes(data, start, stop):
        if kind in CONTAINERS:
            _find(data, a, b, out)
        else:
            out.setdefault(kind, data[a:b])
    return out


def _runs(box: bytes, signed: bool = False) -> np.ndarray:
    n = struct.unpack(">I", box[4:8])[0]
    pairs = np.frombuffer(box[8 : 8 + 8 * n], ">u4").reshape(n, 2)
    return np.repeat(pairs[:, 1].astype(np.int64) if not signed else pairs[:, 1].astype(">u4").view(">i4").astype(np.int64), pairs[:, 0])


def parse(data: bytes) -> Track:
    """The first video track."""
    for kind, a, b in boxes(data, 0, len(data)):
        if kind != b"moov":
            continue
        for inner, c, d in boxes(data, a, b):
            if inner != b"trak":
                continue
            t = _find(data, c, d, {})
            if t.get(b"hdlr", b"")[8:12] == b"vide":
                return _track(t)
    raise ValueError("no video track")


def _track(t: dict[bytes, bytes]) -> Track:
    m = t[b"mdhd"]
    timescale, duration = struct.unpack(">IQ", m[20:32]) if m[0] == 1 else struct.unpack(">II", m[12:20])
    codec = t[b"stsd"][12:16].decode("latin-1")
    width, height = struct.unpack(">HH", t[b"stsd"][40:44])
    steps = _runs(t[b"stts"])
    pts = np.cumsum(steps) - steps
    if b"ctts" in t:
        pts = pts + _runs(t[b"ctts"], signed=t[b"ctts"][0] == 1)
    same, n = struct.unpack(">II", t[b"stsz"][4:12])
    sizes = np.full(n, same) if same else np.frombuffer(t[b"stsz"][12 : 12 + 4 * n], ">u4").astype(np.int64)
    key = np.ones(len(pts), bool)
    if b"stss" in t:
        key[:] = False
        key[np.frombuffer(t[b"stss"][8:], ">u4").astype(np.int64) - 1] = True
    return Track(codec, width, height, timescale, duration, pts, key, sizes)
