"""Pieces of many texts at once, in numpy: maximal runs of a class of bytes, their places and their hashes.

Texts are UTF-8. Classes are said by bytes; every byte of a character beyond ASCII is in or out together, so runs of bytes are
runs of characters. A text longer than PORTION is cut between two pieces and goes through in several portions, so what a
worker holds does not grow with the longest text (but with its longest piece).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from .words import mix, powers

PORTION = 1 << 20
_space = re.compile(rb"[\x20\x09-\x0D]")


def bytes_but(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is True for the bytes outside the ranges."""
    inside = np.ones(256, bool)
    for first, last in ranges:
        inside[first : last + 1] = False
    return inside


class Pieces(NamedTuple):
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  # place of the text that each piece is in
    hashes: np.ndarray


def portions(texts: list[bytes | None]) -> Iterator[list[tuple[int, bytes]]]:
    """(place, text) in lists of about PORTION bytes; long texts in parts, cut at white space."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for place, text in enumerate(texts):
        rest = text or b""
        while rest:
            part = rest
            if len(rest) > PORTION:
                cut = _space.search(rest, PORTION)
                part = rest[: cut.end()] if cut else rest
            rest = rest[len(part) :]
            if size and size + len(part) > PORTION:
                yield held
                held, size = [], 0
            held.append((place, part))
            size += len(part) + 1
    if held:
        yield held


def find(portion: list[tuple[int, bytes]], inside: np.ndarray, lower: bool) -> Pieces:
    """The pieces of a portion in order. The class must leave out the space. A to Z count as a to z if `lower`."""
    joined = b" ".join(part for _, part in portion) + b" "
    if lower:
        joined = joined.lower()  # of bytes: A to Z only
    data = np.frombuffer(joined, np.uint8)
    edge = np.diff(np.concatenate([[False], inside[data]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    lengths = np.array([len(part) + 1 for _, part in portion], np.int64)
    part_of = np.searchsorted(np.cumsum(lengths), starts, side="right")
    places = np.array([place for place, _ in portion], np.int64)
    return Pieces(joined, starts, ends, places[part_of], hashes)
