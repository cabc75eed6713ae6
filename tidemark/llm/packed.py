"""Compressed columns of numbers and bytes that travel between slots and buckets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def deflate(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def inflate(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def pack_numbers(values: np.ndarray, width: int = 4) -> bytes:
    """Unsigned numbers of `width` bytes, compressed byte by byte."""
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return deflate(np.ascontiguousarray(planes).tobytes())


def unpack_numbers(data: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(inflate(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def pack_parts(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit hash; buckets are ranges of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
