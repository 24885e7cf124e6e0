"""Byte-level BPE: exact encoding in linear time, and decoding.

Bytes stand as Latin-1 characters, so one automaton over the vocabulary gives the longest token at every
position of a piece. Encoding goes through the piece from left to right with the longest token that may stand
after the one before it, takes shorter ones on failure, and steps back where none fits. Two tokens may stand
side by side if merging their joined bytes gives just the two again; the answer is kept per pair. A position
that has failed once is never tried again, so the work is linear in the length of the piece.

Null texts count as empty and give no ids. The vocabulary (a rank file, at most a few MB) is read on the driver
and broadcast.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cached_property
from weakref import WeakKeyDictionary

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

# What a worker remembers; more only costs time.
KEPT_PIECES = 120_000
KEPT_LENGTH = 48
KEPT_PAIRS = 250_000
NEVER = 1 << 40
_coders: WeakKeyDictionary[Broadcast, ByteBpe] = WeakKeyDictionary()


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Pieces(dict):
    """Packed ids by piece, filled on demand. When full, the older half goes."""

    def __init__(self, coder: ByteBpe):
        super().__init__()
        self.coder = coder
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = struct.pack(f"<{len(ids := self.coder.encode_piece(piece.encode()))}I", *ids)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.prefixes: dict[int, int] = {}
        self.made_of: dict[int, tuple[int, ...]] = {}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        automaton.make_automaton()
        return automaton

    def merge(self, data: bytes, down_to: int = 1) -> list[int]:
        """Merges by rank, as defined, until `down_to` parts are left: only for the bytes of a token or two."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [self.ranks.get(parts[i] + parts[i + 1], NEVER) for i in range(len(parts) - 1)]
        while len(parts) > down_to and (best := min(ranks, default=NEVER)) < NEVER:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.ranks.get(parts[i - 1] + parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = self.ranks.get(parts[i] + parts[i + 1], NEVER)
        return [self.ranks[part] for part in parts]

    def halves(self, token: int) -> tuple[int, ...]:
        """The two tokens whose merge makes this one: none for a byte, three of them where no merges make it."""
        known = self.made_of.get(token)
        if known is None:
            data = self.tokens[token]
            parts = self.merge(data, 2)
            known = () if len(data) == 1 else tuple(parts) if len(parts) == 2 else (token,) * 3
            self.made_of[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Do the merges of the joined bytes keep the border between the two?

        Followed backwards: the later of the two is taken apart again and again. The tokens then at the border must
        not have a merge of their own that comes before the merge just undone; on equal ranks the left one comes first.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs.clear()
            a, b, limit = left, right, NEVER
            while True:
                if self.ranks.get(self.tokens[a] + self.tokens[b], NEVER) < limit:
                    known = False
                    break
                parts_a, parts_b = self.halves(a), self.halves(b)
                if not parts_a and not parts_b:
                    known = True
                    break
                if not parts_b or parts_a and a > b:
                    limit, a = a, parts_a[1]
                else:
                    limit, b = b + 1, parts_b[0]
            self.pairs[left, right] = known
        return known

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one, or -1."""
        known = self.prefixes.get(token)
        if known is None:
            data = self.tokens[token]
            known = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
            self.prefixes[token] = known
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        if (rank := self.ranks.get(data)) is not None:
            return [rank]
        size = len(data)
        longest, reach = [-1] * size, [0] * size
        for last, (rank, length) in self.automaton.iter(data.decode("latin-1")):
            if length > reach[start := last + 1 - length]:
                longest[start], reach[start] = rank, length
        failed = bytearray(size + 1)
        path: list[int] = []
        at, token = 0, longest[0] if size else -1
        while at < size:
            while token >= 0:
                end = at + len(self.tokens[token])
                if not failed[end] and len(self.halves(token)) < 3 and (not path or self.compatible(path[-1], token)):
                    break
                token = self.shorter(token)
            if token >= 0:
                path.append(token)
                at = end
                token = longest[at] if at < size else -1
            elif path:
                failed[at] = 1
                token = path.pop()
                at -= len(self.tokens[token])
                token = self.shorter(token)
            else:
                return self.merge(data)
        return path

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def coder(vocabulary: Broadcast, pattern: str) -> ByteBpe:
    """The coder of this worker for one vocabulary. It lives as long as the worker holds the broadcast, so that a worker that goes
    on with other tasks does not keep what it has remembered."""
    if vocabulary not in _coders:
        lines = vocabulary.value.splitlines()
        _coders[vocabulary] = ByteBpe({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}, pattern)
    return _coders[vocabulary]


def _vocabulary(frame: DataFrame, path: str):
    spark = frame.sparkSession
    ship(spark)
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers). Other columns are left out. One row per row."""
    vocabulary = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                ids = [bpe.encode(text or "") for text in part.column(1).to_pylist()]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, _binary(ids)], ["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of `encode` with the bytes that their ids stand for as `decoded`."""
    vocabulary = _vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(vocabulary, pattern)
        for batch in batches:
            decoded = [bpe.decode(ids or b"") for ids in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(decoded)], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
