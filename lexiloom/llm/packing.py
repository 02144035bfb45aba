"""Compact binary columns for lists of numbers and of byte strings."""

from __future__ import annotations

import numpy as np
import zstandard

LEVEL = 3


def pack_ints(numbers) -> bytes:
    """Non-negative integers below 2**32: the count, then four byte planes, lowest first, under zstd.

    Small numbers leave the high planes zero, which cost next to nothing.
    """
    array = np.ascontiguousarray(numbers, dtype="<u4")
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=LEVEL).compress(len(array).to_bytes(8, "little") + planes.tobytes())


def unpack_ints(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, 4 * n, 8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_strings(strings: list[bytes]) -> bytes:
    """The lengths, packed, and the joined bytes under zstd."""
    lengths = pack_ints([len(s) for s in strings])
    body = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(strings))
    return len(lengths).to_bytes(8, "little") + lengths + body


def unpack_strings(data: bytes) -> list[bytes]:
    cut = 8 + int.from_bytes(data[:8], "little")
    lengths = unpack_ints(data[8:cut])
    body = zstandard.ZstdDecompressor().decompress(data[cut:])
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [body[a:b] for a, b in zip([0, *ends], ends)]


def gather(values: np.ndarray, offsets: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Piece k of ``values`` runs from ``offsets[k]`` to ``offsets[k + 1]``: the pieces ``take``, one after the other."""
    lengths = np.diff(offsets)[take]
    ends = np.cumsum(lengths)
    spots = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    spots += np.repeat(offsets[:-1][take] - (ends - lengths), lengths)
    return values[spots]
