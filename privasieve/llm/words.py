"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
# Odd 64-bit constants of public mixing functions.
BASE = U(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
CHUNK = 1 << 20  # bytes of text at a time; a longer text is a chunk of its own

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over each other."""
    x = x ^ (x >> U(33))
    x = x * MIX_1
    x = x ^ (x >> U(33))
    x = x * MIX_2
    return x ^ (x >> U(33))


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1 at least."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.concatenate([np.ones(1, U), np.cumprod(np.full(max(n, CHUNK + 1), b, U))]) for b in (BASE, INVERSE)]
    return _powers


def chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or b"") > CHUNK:
            yield first, i
            first, size = i, 0
        size += len(text or b"") + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where the words of each text begin (one more entry for the end).

    Words are runs of bytes other than white space (0x20, 0x09 to 0x0D); A to Z count as a to z if `lower`.
    """
    data = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data)
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * power[: len(data)])])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))
    lengths = np.array([len(t or b"") + 1 for t in texts], np.int64)
    borders = np.concatenate([[0], np.cumsum(lengths)])
    return hashes, np.searchsorted(starts, borders)


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` words from each word on; the last width - 1 entries are left out."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, U)
    total = np.zeros(count, U)
    for i in range(width):
        total = total * BASE + hashes[i : i + count]
    return mix(total + U(width))


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()
