"""Packed blobs: many small records that go to one bucket travel as one compressed row.

A blob is a list of numpy arrays, each stored with its type and length and the whole
compressed.  A bucket gets one row per map slice, so a shuffle handles few rows.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_LEVEL = 3


def pack(arrays: list[np.ndarray]) -> bytes:
    head = [struct.pack("<B", len(arrays))]
    for a in arrays:
        head.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), a.nbytes))
    return zstandard.ZstdCompressor(level=_LEVEL).compress(b"".join(head + [np.ascontiguousarray(a).tobytes() for a in arrays]))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = data[0]
    at, out = 1 + 10 * n, []
    for k in range(n):
        kind, size = struct.unpack_from("<2sQ", data, 1 + 10 * k)
        kind = kind.decode()
        out.append(np.frombuffer(data, dtype=kind, count=size // int(kind[1:]), offset=at))
        at += size
    return out
