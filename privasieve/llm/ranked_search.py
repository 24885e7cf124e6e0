"""Ranked lexical search by NRA: no random access, only sequential reads of impact-sorted lists.

The documents are read once for the terms of the items (`postings`): each row gets its number of terms and, for the terms
that some item asks for, how often it holds them. From these rows come N, L and df, and from df the weights.

The index is cut by documents: a block of rows (a batch of a task) has a list for each term, sorted by impact. For an item all
its lists are read downwards together, in rounds: a round reads from each list what is worth at least the round's level, half
of the one before. Each document has an interval: `lower` is the sum of what was read, `upper` adds, for each list in
which the document has not been met, the worth of that list's next entry. A document stays open while its upper end reaches the
k-th best score known, so that equal scores stay until their ids decide. Reading ends when every open document's interval is
a point: membership, ties and scores are then final. What the earlier blocks of a task have found is known from the start.
A task gives its best k of each item; the best k of all tasks are taken in Spark.

Items pass in groups of at most ITEM_BYTES of text (a larger item is a group of its own); one group is what a task holds, with
k results of each item. More items mean more passes over the documents, with the same results.

Nulls: a null text has no terms; null ids are ids like any other and stand last among ties. Rows that repeat a doc_id are
documents of their own. Rows that repeat an item_id are one item with the terms of all its different texts. Items without a
term that a document holds, empty tables and documents without terms give no rows. Further columns are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .pieces import bytes_but, find, portions
from .shared import settle, ship
from .words import texts_of

# What a term is not made of, and the constants of the score.
OUTSIDE = ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
UNIT, TF_FACTOR, LENGTH_FACTOR = 1_000_000_000, 1000, 12
LENGTH_SHARE = 25

ITEM_BYTES = 4 << 20
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
LEVELS = 2  # a round reads down to this part of the round before


class Items:
    """The terms of a group of items: `vocabulary` in the order of their hashes, and each item's (term, repeats)."""

    def __init__(self, texts: list[list[str | None]]) -> None:
        counts = [Counter(t for text in some for t in TERM.findall((text or "").encode().lower())) for some in texts]
        terms = sorted({t for c in counts for t in c})
        hashes = np.zeros(len(terms), np.uint64)
        at = 0
        for portion in portions(terms):
            found = find(portion, bytes_but(*OUTSIDE), lower=True).hashes
            hashes[at : at + len(found)] = found
            at += len(found)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.lengths = np.array([len(t) for t in terms], np.int64)[order]
        place = {terms[i]: n for n, i in enumerate(order)}
        self.items = [sorted((place[t], n) for t, n in c.items()) for c in counts]


def postings(docs: DataFrame, items: Items, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n (number of terms), terms (places in the vocabulary), counts: one row for each row that has a term."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((items.hashes, items.lengths))
    kind = docs.schema[id_column].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, lengths = shared.value
        inside = bytes_but(*OUTSIDE)
        for batch in batches:
            totals = np.zeros(batch.num_rows, np.int64)
            keys, counts = [], []
            for portion in portions(texts_of(batch.column(1))):
                found = find(portion, inside, lower=True)
                totals += np.bincount(found.text, minlength=batch.num_rows)
                if not len(hashes):
                    continue
                at = np.minimum(np.searchsorted(hashes, found.hashes), len(hashes) - 1)
                asked = (hashes[at] == found.hashes) & (lengths[at] == found.ends - found.starts)
                key, count = np.unique(found.text[asked] * len(hashes) + at[asked], return_counts=True)
                keys.append(key)
                counts.append(count)
            key, first = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_inverse=True)
            count = np.bincount(first, np.concatenate(counts), len(key)) if len(key) else np.zeros(0)
            row, term = np.divmod(key, max(1, len(hashes)))
            borders = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(totals),
                    pa.ListArray.from_arrays(pa.array(borders), pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(borders), pa.array(count.astype(np.int32))),
                ],
                names=["doc_id", "n", "terms", "counts"],
            )
            yield out.filter(pa.array(totals > 0))

    columns = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return columns.mapInArrow(read, f"doc_id {kind}, n long, terms array<int>, counts array<int>")


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Block:
    """The impact-sorted lists of some documents, who stand in the order of their ids."""

    def __init__(self, n: np.ndarray, owner: np.ndarray, terms: np.ndarray, counts: np.ndarray, documents: int, total: int) -> None:
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // total
        impact = (UNIT * counts) // (TF_FACTOR * counts + LENGTH_FACTOR * m[owner])
        order = np.lexsort((-impact, terms))
        self.size = len(n)
        self.docs, self.impact, self.terms = owner[order], impact[order], terms[order]

    def best(self, item: list[tuple[int, int]], weight: np.ndarray, k: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the best k with a score of `known` or more, ties by place; fewer if fewer have one."""
        lists = []
        for term, repeats in item:
            first, last = np.searchsorted(self.terms, (term, term + 1))
            if last > first and weight[term] > 0:
                lists.append((self.docs[first:last], self.impact[first:last] * (weight[term] * repeats)))
        lower, met = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        cursors, bounds = [0] * len(lists), [int(worth[0]) for _, worth in lists]
        level = max(bounds, default=0)
        while True:
            level //= LEVELS
            for i, (docs, worth) in enumerate(lists):
                if bounds[i] == 0:
                    continue
                past = cursors[i]
                now = int(np.searchsorted(-worth, -level, side="right"))
                if now == past:
                    continue
                lower[docs[past:now]] += worth[past:now]
                bound = int(worth[now]) if now < len(worth) else 0
                met[docs[:past]] += bound - bounds[i]
                met[docs[past:now]] += bound
                cursors[i], bounds[i] = now, bound
            upper = lower + (sum(bounds) - met)
            kth = int(np.partition(lower, self.size - k)[self.size - k]) if self.size > k else 0
            open_docs = np.flatnonzero(upper >= max(1, known, kth))
            if np.array_equal(lower[open_docs], upper[open_docs]):
                best = open_docs[np.argsort(-lower[open_docs], kind="stable")[:k]]
                return best, lower[best]


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, item_column: str = "item_id", item_text: str = "text",
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_column).alias("item_id"), F.col(item_text).alias("text")).distinct()
    whole = asked.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    passes = max(1, math.ceil(whole / ITEM_BYTES))
    found = None
    for group in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == group)
        part = _search(docs, some, k, id_column, text_column)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _search(docs: DataFrame, some: DataFrame, k: int, id_column: str, text_column: str) -> DataFrame:
    """The best k of each task for a group of items."""
    spark = docs.sparkSession
    texts: dict = {}
    for row in some.collect():  # bounded: ITEM_BYTES of text
        texts.setdefault(row.item_id, []).append(row.text)
    items = Items(list(texts.values()))
    read = settle(postings(docs, items, id_column, text_column))
    documents, total = read.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(items.hashes), np.int64)
    for term, count in read.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row for each term asked for
        df[term] = count
    shared = spark.sparkContext.broadcast((items.items, weights(documents, df)))
    kind_of_id = to_arrow_type(docs.schema[id_column].dataType)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = shared.value
        best: list[list] = [[] for _ in wanted]
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pc.array_sort_indices(batch.column(0)))  # nulls last
            ids, terms, counts = batch.column(0), batch.column(2), batch.column(3)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
            block = Block(
                batch.column(1).to_numpy(), owner, terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64), documents, total
            )
            for i, item in enumerate(wanted):
                known = -best[i][k - 1][0] if len(best[i]) >= k else 0
                places, scores = block.best(item, weight, k, known)
                if len(places):
                    names = ids.take(pa.array(places)).to_pylist()
                    best[i] += [(-int(s), name is None, name) for s, name in zip(scores, names)]
                    best[i] = sorted(best[i], key=lambda x: x if not x[1] else x[:2])[:k]
        rows = [(i, name, -worth) for i, some_best in enumerate(best) for worth, _, name in some_best]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind_of_id), pa.array([r[2] for r in rows], pa.int64())],
            names=["place", "doc_id", "score"],
        )

    ranked = read.mapInArrow(rank, f"place int, doc_id {docs.schema[id_column].dataType.simpleString()}, score long")
    names = spark.createDataFrame(list(enumerate(texts)), f"place int, item_id {some.schema['item_id'].dataType.simpleString()}")
    return ranked.join(names, "place").select("item_id", "doc_id", "score")
