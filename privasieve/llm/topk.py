"""Exact top-k search by inner product.

Queries are packed into blocks and candidates into shards; every block meets every shard once, as one matrix
product (a tile). A tile keeps the best k of each query, tiles of one task are merged as they come, and the lists of
the tasks are merged in a tree. Blocks and shards have a bounded size, so memory does not grow with the tables, and
nothing is broadcast.

Components are turned into floor(scale * x); products are exact (floating point only where every sum stays below its
exact range). Ties go to the smaller id. Vectors that are null or empty, or hold a null or non-finite component, take no
part; only vectors of equal length meet. An id names one row: a row is no candidate for a query of the same id, rows
that repeat a candidate's id and vector count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, ship

BLOCK = 2048
FAN = 32
FLOAT_EXACT, DOUBLE_EXACT = 2**24, 2**53
RESULT = "query_id long, part int, vec_id long, score long"


def whole_vectors(rows: DataFrame, scale: float, id_column: str, vector_column: str) -> DataFrame:
    vector = F.col(vector_column)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col(id_column).isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & finite).select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vector"),
    )


def _packed(rows: DataFrame, blocks: int, name: str) -> DataFrame:
    """About BLOCK rows in each block, dealt by hash."""
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")
    return rows.groupBy(block.alias(name), F.size("vector").alias("length")).agg(F.collect_set(F.struct("vec_id", "vector")).alias(f"{name}_rows"))


def _unpack(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = (x.to_numpy() if pa.types.is_integer(x.type) else x.flatten().to_numpy() for x in rows.flatten())
    matrix = vectors.reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix[order]


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    bound = float(np.abs(queries.astype(float)).max()) * float(np.abs(shard.astype(float)).max()) * queries.shape[1]
    if bound < DOUBLE_EXACT:
        kind = np.float32 if bound < FLOAT_EXACT else np.float64
        return (queries.astype(kind) @ shard.astype(kind).T).astype(np.int64)
    return queries @ shard.T


def best(query_ids: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, id, score) of the k best per query; `ids` ascend, so the first of equal scores wins."""
    own = ids[None, :] == query_ids[:, None]
    low = np.iinfo(np.int64).min
    scores = np.where(own, low, scores)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        taken = (scores >= least) & ~own
    else:
        taken = ~own
    row, column = np.nonzero(taken)
    return ranked(row, ids[column], scores[row, column], k)


def ranked(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    row, ids, scores = row[fresh], ids[fresh], scores[fresh]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return row[keep], ids[keep], scores[keep]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query. Both tables have the two named columns."""
    spark = vectors.sparkSession
    ship(spark)
    candidates = whole_vectors(vectors, scale, id_column, vector_column)
    asked = whole_vectors(queries, scale, id_column, vector_column)
    shards = -(-candidates.count() // BLOCK) or 1
    blocks = -(-asked.count() // BLOCK) or 1
    parts = min(shards, max(1, -(-2 * partitions(spark) // blocks)))
    left = _packed(asked, blocks, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = _packed(candidates, shards, "shard").withColumn("part", F.pmod("shard", F.lit(parts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiles = left.join(right, ["block", "part", "length"]).select("block", "part", "length", "block_rows", "shard_rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None

        def out():
            query_ids, (row, ids, scores) = held
            part = pa.array(np.full(len(row), key[1]), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(query_ids[row]), part, pa.array(ids), pa.array(scores)], ["query_id", "part", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                now = tuple(batch.column(j)[i].as_py() for j in range(3))
                query_ids, matrix = _unpack(batch.column(3).slice(i, 1).flatten())
                ids, shard = _unpack(batch.column(4).slice(i, 1).flatten())
                found = best(query_ids, products(matrix, shard), ids, k)
                if key == now:
                    found = ranked(*(np.concatenate(x) for x in zip(held[1], found)), k)
                elif key is not None:
                    yield out()
                key, held = now, (query_ids, found)
        if key is not None:
            yield out()

    lists = tiles.mapInArrow(run, RESULT)
    order = (F.col("score").desc(), F.col("vec_id"))
    while parts > FAN:
        parts = -(-parts // FAN)
        lists = lists.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "part").orderBy(*order))).filter(F.col("rank") <= k).drop("rank")
    lists = lists.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return lists.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
