"""Quality classifier: a byte-level convolutional network in numpy.

Every byte has a learned vector. Learned filters of `WIDTH` bytes move over the document in steps of `STRIDE`. Their
outputs are max-pooled over overlapping chunks of two blocks each, which cover the whole document; the maximum
and the mean over the chunks go into one logistic output. Documents are scored in their partitions, as many blocks at
a time as fit a fixed buffer, so texts of any length need no more memory than their bytes and block maxima.

Labels come from a table; the network is fitted on the driver on a bounded sample: at most `sample` labelled documents
of each class, in hash order of their ids, each with at most `SLICES` evenly spread slices of `SLICE` characters. Ids,
languages and sources are no inputs. Without labels of both classes every score is the share of label 1 (or 0.5).

Null texts count as empty. Empty texts are scored like any other. Repeated rows each get their (equal) score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship

WIDTH, STRIDE, DIMENSIONS, FILTERS = 8, 2, 4, 16
BLOCK = 128  # bytes; a chunk is two neighbouring blocks
WINDOWS = BLOCK // STRIDE
BUFFER = 4096  # blocks at a time
SAMPLE, SLICES, SLICE = 700, 8, 512
EPOCHS, BATCH, RATE = 14, 32, 0.01
THRESHOLD = 0.3
DECIMALS = 5


class ConvNet:
    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.p = {
            "bytes": rng.normal(0, 0.5, (256, DIMENSIONS)).astype(np.float32),
            "filters": rng.normal(0, 0.3, (WIDTH * DIMENSIONS, FILTERS)).astype(np.float32),
            "shift": np.zeros(FILTERS, np.float32),
            "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Rows of WIDTH byte vectors, one for each step; `data` holds whole blocks and WIDTH - STRIDE bytes more."""
        vectors = self.p["bytes"][data].ravel()
        count = (len(data) - WIDTH) // STRIDE + 1
        step = vectors.strides[0]
        return np.lib.stride_tricks.as_strided(vectors, (count, WIDTH * DIMENSIONS), (step * DIMENSIONS * STRIDE, step))

    def block_maxima(self, data: np.ndarray) -> np.ndarray:
        """Largest output of every filter in every block, not below 0."""
        out = []
        for first in range(0, len(data) - (WIDTH - STRIDE), BLOCK * BUFFER):
            part = data[first : first + BLOCK * BUFFER + WIDTH - STRIDE]
            raw = np.ascontiguousarray(self.windows(part)) @ self.p["filters"]
            out.append(raw.reshape(-1, WINDOWS, FILTERS).max(1))
        return np.maximum(np.concatenate(out) + self.p["shift"], 0)

    def pooled(self, maxima: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Maximum and mean over the chunks of every document; `starts`: first block of each."""
        ends = np.append(starts[1:], len(maxima))
        following = np.minimum(np.arange(len(maxima)) + 1, np.repeat(ends - 1, ends - starts))
        chunks = np.maximum(maxima, maxima[following])
        # The last chunk of a longer document would repeat its last block alone.
        counted = np.where((np.arange(len(maxima)) == following) & (np.repeat(ends - starts, ends - starts) > 1), 0, 1)
        mean = np.add.reduceat(chunks * counted[:, None], starts) / np.add.reduceat(counted, starts)[:, None]
        return np.concatenate([np.maximum.reduceat(chunks, starts), mean], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        data, starts = padded(texts)
        z = self.pooled(self.block_maxima(data), starts) @ self.p["out"] + self.p["bias"]
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> dict[str, np.ndarray]:
        data, starts = padded(texts)
        rows = self.windows(data)
        raw = (np.ascontiguousarray(rows) @ self.p["filters"]).reshape(-1, WINDOWS, FILTERS)
        at = raw.argmax(1)
        outputs = np.take_along_axis(raw, at[:, None, :], 1)[:, 0] + self.p["shift"]
        maxima = np.maximum(outputs, 0)
        pooled = self.pooled(maxima, starts)
        z = pooled @ self.p["out"] + self.p["bias"]
        error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(texts)).astype(np.float32)
        # The maximum passes its error to the best block, the mean to the better block of every chunk.
        ends = np.append(starts[1:], len(maxima))
        owner = np.repeat(np.arange(len(starts)), ends - starts)
        following = np.minimum(np.arange(len(maxima)) + 1, ends[owner] - 1)
        better = np.where(maxima[following] > maxima, following[:, None], np.arange(len(maxima))[:, None])
        lone = (np.arange(len(maxima)) == following) & (ends[owner] - starts[owner] > 1)
        share = error[owner] / np.maximum(ends - starts - 1, 1)[owner]
        share[lone] = 0
        to_blocks = np.zeros_like(maxima)
        columns = np.broadcast_to(np.arange(FILTERS), better.shape)
        np.add.at(to_blocks, (better, columns), share[:, None] * self.p["out"][FILTERS:])
        for i, (a, b) in enumerate(zip(starts, ends)):
            to_blocks[a + maxima[a:b].argmax(0), np.arange(FILTERS)] += error[i] * self.p["out"][:FILTERS]
        to_blocks *= outputs > 0
        place = at + np.arange(len(at))[:, None] * WINDOWS
        taken = rows[place]  # blocks x filters x (WIDTH * DIMENSIONS)
        to_rows = to_blocks[:, :, None] * self.p["filters"].T[None]
        bytes_of = data[place[:, :, None] * STRIDE + np.arange(WIDTH)].ravel()
        to_bytes = to_rows.reshape(-1, DIMENSIONS)
        return {
            "bytes": np.stack([np.bincount(bytes_of, to_bytes[:, d], 256) for d in range(DIMENSIONS)], 1),
            "filters": np.einsum("bfk,bf->kf", taken, to_blocks), "shift": to_blocks.sum(0),
            "out": pooled.T @ error, "bias": error.sum(keepdims=True),
        }

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 1) -> ConvNet:
        """Adam on shuffled batches."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(texts))
            for begin in range(0, len(order), BATCH):
                some = order[begin : begin + BATCH]
                step += 1
                for k, g in self.gradients([texts[i] for i in some], labels[some]).items():
                    first[k] += 0.1 * (g.astype(np.float32) - first[k])
                    second[k] += 0.001 * (g.astype(np.float32) ** 2 - second[k])
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    self.p[k] -= np.float32(RATE * (1 - epoch / EPOCHS)) * move
        return self


class Constant:
    def __init__(self, value: float):
        self.value = value

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.value)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, each document filled up to whole blocks with room for its last window; first block of each."""
    blocks = [-(-(len(t) + WIDTH) // BLOCK) for t in texts]
    data = b"".join(t.ljust(n * BLOCK, b"\0") for t, n in zip(texts, blocks)) + b"\0" * (WIDTH - STRIDE)
    return np.frombuffer(data, np.uint8), np.cumsum([0, *blocks[:-1]])


def held_out(identifier: Column) -> Column:
    """Rows kept from training: one in five, by their id."""
    return F.coalesce(F.crc32(identifier.cast("string")) % 5 == 0, F.lit(False))


def sample_slices(text: Column) -> Column:
    n = F.length(text)
    spread = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)), lambda i: F.substring(text, (i * (n - SLICE) / (SLICES - 1) + 1).cast("int"), F.lit(SLICE)))
    return F.when(n <= SLICES * SLICE, text).otherwise(F.array_join(spread, ""))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text"):
    """A network fitted on labelled rows that are not held out. Labels other than 0 and 1 are left out."""
    label = F.col(label_column).cast("int")
    usable = labels.filter(F.col(id_column).isNotNull() & label.isin(0, 1) & ~held_out(F.col(id_column))).select(
        F.col(id_column).alias("id"), label.alias("label"), F.xxhash64(id_column).alias("order")
    )
    chosen = [usable.filter(F.col("label") == k).orderBy("order", "id").limit(sample) for k in (0, 1)]
    # At most two times `sample` rows: small enough for every executor.
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), sample_slices(text).alias("text")).join(ids, "id").collect()
    rows.sort(key=lambda r: (r["order"], r["id"], r["text"]))
    values = np.array([r["label"] for r in rows], np.float32)
    if len(set(values.tolist())) < 2:
        return Constant(float(values.mean()) if len(values) else 0.5)
    return ConvNet().fit([r["text"].encode() for r in rows], values)


def score(docs: DataFrame, network, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `keep`, and score (0 to 1). One row per row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                texts = [t or b"" for t in part.column(0).cast(pa.binary()).to_pylist()]
                scores = np.round(shared.value.score(texts), DECIMALS)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(scores, pa.float64())], [*part.schema.names[1:], "score"])

    rows = docs.select(F.col(text_column).cast("string").alias("__text"), F.col(id_column).alias("doc_id"), *keep)
    schema = rows.drop("__text").schema.add("score", "double")
    return rows.mapInArrow(run, schema)


def probability(spark: SparkSession, network):
    """A function from a text column to its score, as `score` gives it. Only texts go to the Python workers and only scores
    come back; the other columns of the rows stay where they are."""
    ship(spark)
    shared = spark.sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for first in range(0, len(texts), 64):
            parts.append(shared.value.score([t or b"" for t in texts.slice(first, 64).cast(pa.binary()).to_pylist()]))
        return pa.array(np.round(np.concatenate(parts), DECIMALS) if parts else [], pa.float64())

    return lambda text: run(text.cast("string"))


def predicted(value: Column, threshold: float = THRESHOLD) -> Column:
    return (value >= threshold).cast("int")
