"""The binary layout of a stored frame index: version and length, then three arrays back to back."""

from __future__ import annotations

import struct

import numpy as np

VERSION = 1
HEAD = struct.Struct("<BI")


def dumps(pts: np.ndarray, is_keyframe: np.ndarray, keyframe_pts: np.ndarray) -> bytes:
    arrays = (np.asarray(pts, "<i8"), np.asarray(is_keyframe, bool), np.asarray(keyframe_pts, "<i8"))
    return HEAD.pack(VERSION, len(arrays[0])) + b"".join(a.tobytes() for a in arrays)


def loads(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """None for another version or a broken file, which then is built anew."""
    if len(data) < HEAD.size:
        return None
    version, n = HEAD.unpack_from(data)
    if version != VERSION or len(data) != HEAD.size + 17 * n:
        return None
    body = memoryview(data)[HEAD.size :]
    return np.frombuffer(body[: 8 * n], "<i8"), np.frombuffer(body[8 * n : 9 * n], bool), np.frombuffer(body[9 * n :], "<i8")
