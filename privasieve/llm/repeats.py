"""Repeated passages with sparse suffix arrays.

A passage repeats if `LEAST` or more words in a row stand in two places of the corpus. Of all suffixes only those at
minimisers are kept: of every `LEAST` words the 8-gram with the smallest hash. Equal passages have equal minimisers,
so each repeat is seen from one within its first `LEAST` words, and from more if it is longer. A match therefore need not
be extended by more than `LEAST` words to either side of a minimiser; longer ones are put together from several.

1. Minimisers are sorted by their 8-gram and a hash of the words around them. Neighbours with equal surroundings repeat
   as a whole. Where an 8-gram has several surroundings, one member of each goes on.
2. Those get their words back and are sorted as suffixes (the words to the right) and as reversed prefixes (the words to
   the left). Neighbours are compared, and the match is extended left and right.
3. Where more than two copies share an 8-gram, the best partner may be a neighbour in neither order. An exact check
   follows for these minimisers: the runs of `LEAST` words around them are sorted by hash, and equal neighbours repeat.
4. Spans that touch are merged by document.

Sorting is by range, with the document and place in the key: a passage that stands in a third of all documents is
spread over partitions like any other. The last row of a partition meets the first of the next by way of the driver, two
rows for each partition.

Words are runs without white space, compared as they are. Null and empty texts and texts of fewer than `LEAST` words have no
spans; rows without an id are left out. A passage that one document repeats counts too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import partitions, settle, ship
from .words import BASE, U, grams, mix, powers, texts_of, word_hashes

LEAST = 50
GRAM = 8
WINDOW = LEAST - GRAM + 1
LEFT, RIGHT = LEAST - GRAM, LEAST
BROADCAST_ROWS = 200_000
ROW = "gram long, around long, doc_id long, at int, left_words int, right_words int"
SPAN = "doc_id long, start_word int, end_word int, match_doc_id long"


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """Places of the smallest 8-gram of every run of LEAST words; the first of equal ones."""
    values = grams(hashes, GRAM)
    if len(values) < WINDOW:
        return np.zeros(0, np.int64)
    best, width = np.arange(len(values)), 1

    def smaller(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    while 2 * width <= WINDOW:
        best = smaller(best[:-width], best[width:])
        width *= 2
    rest = WINDOW - width
    best = smaller(best[: len(best) - rest], best[rest:]) if rest else best
    return np.unique(best)


def _minimiser_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ROW.split(", ")]
    for batch in batches:
        columns: list[list[np.ndarray]] = [[] for _ in names]
        for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
            hashes, _ = word_hashes([text], lower=False)
            at = minimisers(hashes)
            if not len(at):
                continue
            power, inverse = powers(len(hashes) + 1)
            sums = np.concatenate([np.zeros(1, U), np.cumsum(hashes * power[: len(hashes)])])
            first, last = np.maximum(at - LEFT, 0), np.minimum(at + RIGHT, len(hashes))
            left, right = at - first, last - at
            around = mix((sums[last] - sums[first]) * inverse[first] + left.astype(U) * BASE + right.astype(U))
            for column, values in zip(columns, (grams(hashes, GRAM)[at], around, np.full(len(at), doc), at, left, right)):
                column.append(values.astype(np.int64) if values.dtype == U else values)
        if columns[0]:
            kinds = [pa.int64()] * 3 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(k) for c, k in zip(columns, kinds)], names)


def neighbours(rows: DataFrame, order: list[str], compare: Callable[[pa.Table], pa.Table], result: str) -> DataFrame:
    """Sort rows by range and give `compare` tables in which every row stands beside its neighbours of the whole order.

    `compare` looks only at rows side by side; it gets each pair of neighbours once. The result may repeat rows.
    """
    spark = rows.sparkSession
    columns = rows.columns
    edge_fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    result_fields = [x.split()[0] for x in result.split(", ")]
    schema = pa.schema([(f"e_{c}", t) for c, t in zip(columns, _types(rows))])
    out_types = _arrow_types(result)

    def widened(table: pa.Table | None, edge: pa.Table | None, place: int) -> Iterator[pa.RecordBatch]:
        n = len(table) if table is not None else len(edge)
        if not n:
            return
        own = [table.column(c).combine_chunks() for c in result_fields] if table is not None else [pa.nulls(n, t) for t in out_types]
        edges = [edge.column(c).combine_chunks() for c in columns] if edge is not None else [pa.nulls(n, t) for t in schema.types]
        where = pa.array([place if edge is not None else None] * n, pa.int32())
        full = pa.Table.from_arrays([*own, *edges, where], [*result_fields, *schema.names, "e_place"])
        yield from full.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = TaskContext.get().partitionId() * 2, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held is None:
                yield from widened(None, table.slice(0, 1), place)
            table = table if held is None else pa.concat_tables([held, table])
            yield from widened(compare(table), None, 0)
            held = table.slice(len(table) - 1)
        if held is not None:
            yield from widened(None, held, place + 1)

    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    wide = ", ".join([result, *(f"e_{f}" for f in edge_fields.split(", ")), "e_place int"])
    found = settle(dealt.mapInArrow(run, wide))
    edges = [list(r)[:-1] for r in found.filter("e_place IS NOT NULL").select(*schema.names, "e_place").orderBy("e_place").collect()]
    spans = found.filter("e_place IS NULL").select(*result_fields)
    # Places alternate: first row, last row. The last of each meets the first of the next.
    pairs = [edges[i : i + 2] for i in range(1, len(edges) - 1, 2)]
    tables = [compare(pa.Table.from_arrays([pa.array(v, t) for v, t in zip(zip(*pair), schema.types)], columns)) for pair in pairs]
    more = [tuple(r.values()) for t in tables for r in t.to_pylist()]
    return spans.unionByName(spark.createDataFrame(more, result)) if more else spans


_ARROW = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}


def _types(rows: DataFrame) -> list[pa.DataType]:
    return [_ARROW[f.dataType.simpleString()] for f in rows.schema.fields]


def _arrow_types(schema: str) -> list[pa.DataType]:
    return [_ARROW[x.split()[1]] for x in schema.split(", ")]


def _same_around(table: pa.Table) -> pa.Table:
    """Neighbouring minimisers: spans where the surroundings are equal, else requests (no end) where the 8-grams are."""
    gram, around, doc, at, left, right = (table.column(i).to_numpy() for i in range(6))
    same = gram[1:] == gram[:-1]
    whole = same & (around[1:] == around[:-1])
    long = left + right >= LEAST
    out = []
    for mine, other in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
        spans, asked = whole & long[mine], same & ~whole
        out.append((doc[mine][spans], (at - left)[mine][spans], (at + right)[mine][spans], doc[other][spans]))
        out.append((doc[mine][asked], at[mine][asked], np.full(asked.sum(), -1), doc[other][asked]))
    return _spans(out)


def _extended(table: pa.Table) -> pa.Table:
    """Neighbouring suffixes of one 8-gram: how far they agree to the left and to the right."""
    gram, doc, at = (table.column(c).to_numpy() for c in ("gram", "doc_id", "at"))
    left, right = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<u4").reshape(len(gram), -1) for c in ("lefts", "rights"))

    def common(words: np.ndarray) -> np.ndarray:
        equal = (words[1:] == words[:-1]) & (words[1:] != 0)
        return np.where(equal.all(1), words.shape[1], equal.argmin(1))

    before, after = common(left), common(right)
    match = (gram[1:] == gram[:-1]) & (before + after >= LEAST)
    out = []
    for mine, other in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
        out.append((doc[mine][match], (at[mine] - before)[match], (at[mine] + after)[match], doc[other][match]))
    return _spans(out)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, doc_id, at) of every run of LEAST words around the minimiser; `at` is where the run begins."""
    power, inverse = powers(LEFT + RIGHT)
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(batch.num_rows, -1) for i in (3, 4))
        words = np.concatenate([left[:, ::-1], right], axis=1).astype(U)
        sums = np.concatenate([np.zeros((len(words), 1), U), np.cumsum(words * power[: LEFT + RIGHT], axis=1)], axis=1)
        first = np.arange(WINDOW)
        hashes = mix((sums[:, LEAST:] - sums[:, :WINDOW]) * inverse[:WINDOW])
        inside = (words[:, :WINDOW] != 0) & (words[:, LEAST - 1 :] != 0)
        docs, at = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        starts = at[:, None] - LEFT + first
        doc_of = np.broadcast_to(docs[:, None], starts.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(hashes[inside].astype(np.int64)), pa.array(doc_of[inside]), pa.array(starts[inside]).cast(pa.int32())], ["hash", "doc_id", "at"]
        )


def _same_window(table: pa.Table) -> pa.Table:
    """Neighbouring runs of LEAST words that are equal and not the same run of the same document."""
    value, doc, at = (table.column(c).to_numpy() for c in ("hash", "doc_id", "at"))
    match = (value[1:] == value[:-1]) & ((doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))
    out = []
    for mine, other in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
        out.append((doc[mine][match], at[mine][match], at[mine][match] + LEAST, doc[other][match]))
    return _spans(out)


def _spans(parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    kinds = _arrow_types(SPAN)
    return pa.Table.from_arrays([pa.array(np.concatenate(c)).cast(k) for c, k in zip(zip(*parts), kinds)], [x.split()[0] for x in SPAN.split(", ")])


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, doc_id, at, lefts, rights) for the asked places of each text; word hashes, 0 beyond its ends."""
    for batch in batches:
        grams_of, docs, places, lefts, rights = [], [], [], [], []
        for doc, text, asked in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist()):
            hashes, _ = word_hashes([text], lower=False)
            values = grams(hashes, GRAM)
            at = np.array(sorted(set(a for a in asked if a < len(values))), np.int64)
            words = np.concatenate([np.zeros(LEFT, np.uint32), (hashes >> U(32)).astype(np.uint32) | np.uint32(1), np.zeros(RIGHT, np.uint32)])
            left = words[at[:, None] + LEFT - 1 - np.arange(LEFT)]
            right = words[at[:, None] + LEFT + np.arange(RIGHT)]
            grams_of.append(values[at].astype(np.int64))
            docs.append(np.full(len(at), doc))
            places.append(at)
            lefts += [x.tobytes() for x in left]
            rights += [x.tobytes() for x in right]
        if lefts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(grams_of)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(places)).cast(pa.int32()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())],
                ["gram", "doc_id", "at", "lefts", "rights"],
            )


def merged(spans: DataFrame) -> DataFrame:
    """Spans of a document that overlap or touch, as one."""
    by_start = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    reach = F.max("end_word").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.distinct().withColumn("fresh", F.when(F.col("start_word") <= reach, 0).otherwise(1))
    numbered = fresh.withColumn("island", F.sum("fresh").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "island").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("match_doc_id").alias("match_doc_id")
    ).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "match_doc_id")


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words, match_doc_id: every stretch of a document made of repeated
    passages, with one document that has some of it as well."""
    ship(docs.sparkSession)
    rows = docs.filter(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    first = neighbours(rows.mapInArrow(_minimiser_rows, ROW), ["gram", "around", "doc_id", "at"], _same_around, SPAN)
    whole = first.filter("end_word >= 0")
    asked = settle(first.filter("end_word < 0").groupBy("doc_id").agg(F.collect_set("start_word").alias("asked")))
    # A short list of places saves sending all texts; a longer one is joined like any table.
    side = F.broadcast(asked) if (asked.agg(F.sum(F.size("asked"))).first()[0] or 0) <= BROADCAST_ROWS else asked
    words = settle(rows.join(side, "doc_id").select("doc_id", "text", "asked").mapInArrow(_with_words, "gram long, doc_id long, at int, lefts binary, rights binary"))
    spans = whole
    for side in ("rights", "lefts"):
        spans = spans.unionByName(neighbours(words, ["gram", side, "doc_id", "at"], _extended, SPAN))
    runs = words.mapInArrow(_windows, "hash long, doc_id long, at int")
    return merged(spans.unionByName(neighbours(runs, ["hash", "doc_id", "at"], _same_window, SPAN)))
