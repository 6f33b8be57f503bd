"""Arrays of numbers and of strings as compressed bytes, for rows that hold blocks."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<QQQ")


def pack(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    """``n`` numbers again."""
    raw = pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, n).T).view("<u4").ravel()


def pack_strings(values: pa.Array) -> bytes:
    """A binary array without nulls."""
    values = pa.concat_arrays([values])  # offsets from 0 on
    offsets = np.frombuffer(values.buffers()[1], "<i4")[: len(values) + 1] if len(values) else np.zeros(1, "i4")
    size = int(offsets[-1])
    lengths = pack(np.diff(offsets))
    data = pa.compress(values.buffers()[2].slice(0, size), codec="zstd", asbytes=True) if size else b""
    return _HEAD.pack(len(values), size, len(lengths)) + lengths + data


def unpack_strings(data: bytes) -> pa.Array:
    n, size, lengths = _HEAD.unpack_from(data)
    at = _HEAD.size
    offsets = np.concatenate([[0], np.cumsum(unpack(data[at : at + lengths], n))]).astype("i4")
    raw = pa.decompress(data[at + lengths :], decompressed_size=size, codec="zstd") if size else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), raw])
