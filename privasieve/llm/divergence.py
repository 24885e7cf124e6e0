"""How far the sources of a language diverge in their terms, by chunk factorization.

A term never crosses white space, so the terms of a text are those of its white-space chunks.

* `chunk_documents` counts chunks: for each batch of rows, each language and chunk, the documents that hold it.
* `dictionary` cuts each globally distinct chunk into terms once. The documents of all chunks with a term are no fewer than the
  documents with the term, so terms whose sum is below the bound can never be kept, and their chunks leave here: a long tail of
  chunks that few documents hold is not looked at again.
* `term_counts` joins the terms back to the chunks of the documents and sums up, in each batch, a term's occurrences by source
  and its distinct documents: forms of a term ("one", "One,", "(one)") meet in the document. Batches are summed in Spark.

The join goes through the dictionary in slices of at most SLICE chunk and term pairs, dealt by term: a slice is what a worker
holds, and a term is in one slice with all its forms. A larger vocabulary takes more passes over the documents, with the same
results. Chunks are looked up by 64-bit hashes.

`audit` compares the sources of each language by smoothed shares of the kept terms. Shares are exact (decimal) and whole numbers.
For each kept term the shares of all sources of the language stand in one array, as long as the language has sources; the
pairs of its entries are summed.

Nulls: a null text, language or source is ''. Repeated rows are documents of their own; ids are not read. Texts without
terms belong to their group. A language without kept terms has value 0 for each pair. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import bytes_but, find, portions
from .shared import held, partitions, settle, ship
from .words import BASE, mix, texts_of

# What a term is made of, letters to lower, smoothing and scale.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = ((0x09, 0x0D), (0x20, 0x20))
PRIOR, SCALE = 5, 1_000_000_000

SLICE = 2_000_000


def changes(*keys: np.ndarray) -> np.ndarray:
    """True where any of the keys differs from the one before, and at the first."""
    differs = np.ones(len(keys[0]), bool)
    differs[1:] = np.any([key[1:] != key[:-1] for key in keys], axis=0)
    return differs


def texts_by_group(docs: DataFrame, text_column: str, lang_column: str, source_column: str) -> DataFrame:
    return docs.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang"), F.col(source_column).cast("string").alias("source"))


def codes(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct values of a column, null as '', and the place of each row's value."""
    coded = column.fill_null("").dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def chunk_documents(texts: DataFrame) -> DataFrame:
    """chunk, lang, n: how many documents of a batch hold a chunk. Each (chunk, lang) once for a batch."""
    ship(texts.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = bytes_but(*SPACE)
        for batch in batches:
            names, lang = codes(batch.column(1))
            seen: list[np.ndarray] = []  # places of (hash, document) of each portion
            held_hashes, chunks = [], {}
            for portion in portions(texts_of(batch.column(0))):
                found = find(portion, inside, lower=False)
                distinct, first, which = np.unique(found.hashes, return_index=True, return_inverse=True)
                for h, at in zip(distinct.tolist(), first.tolist()):
                    if h not in chunks:
                        chunks[h] = found.data[found.starts[at] : found.ends[at]]
                word, doc = np.divmod(np.unique(which * batch.num_rows + found.text), batch.num_rows)
                held_hashes.append(distinct[word])
                seen.append(doc)
            if not seen:
                continue
            word, doc = np.concatenate(held_hashes), np.concatenate(seen)
            order = np.lexsort((doc, word, lang[doc]))
            word, doc = word[order], doc[order]
            # A text of several portions may hold a chunk in more than one of them.
            own = changes(word, doc)
            word, doc = word[own], doc[own]
            row = np.flatnonzero(changes(word, lang[doc]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunks[h] for h in word[row].tolist()], pa.binary()).cast(pa.string()),
                    pa.array(names, pa.string()).take(pa.array(lang[doc[row]])), pa.array(np.diff(np.append(row, len(doc)))),
                ],
                names=["chunk", "lang", "n"],
            )

    return texts.select("text", "lang").mapInArrow(read, "chunk string, lang string, n long")


def dictionary(counted: DataFrame, least_documents: int) -> DataFrame:
    """lang, chunk, term, repeats: each distinct chunk cut once, for the terms that may be in enough documents of a language."""
    dealt = counted.repartition(partitions(counted.sparkSession), "chunk")
    chunks = dealt.groupBy("chunk", "lang").agg(F.sum("n").alias("n")).groupBy("chunk").agg(F.collect_list(F.struct("lang", "n")).alias("langs"))
    cut = held(chunks, "chunk", "langs", F.regexp_extract_all(F.translate("chunk", UPPER, LOWER), F.lit(TERM), 0).alias("terms"))
    each = cut.select("chunk", "langs", "terms", F.explode(F.array_distinct("terms")).alias("term"))
    each = each.select("chunk", "langs", "term", F.size(F.filter("terms", lambda t: t == F.col("term"))).alias("repeats"))
    forms = settle(each.select("chunk", "term", "repeats", F.inline("langs")))
    enough = forms.groupBy("lang", "term").agg(F.sum("n").alias("most")).filter(F.col("most") >= least_documents)
    return forms.join(enough.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "chunk", "term", "repeats")


class Slice:
    """A part of the dictionary for look-ups by language and chunk hash."""

    def __init__(self, table: pa.Table) -> None:
        self.langs, lang = codes(table.column("lang").combine_chunks())
        coded = table.column("term").combine_chunks().dictionary_encode()
        self.terms, term = coded.dictionary, coded.indices.to_numpy().astype(np.int32)
        chunks = texts_of(table.column("chunk").combine_chunks())
        hashes = np.zeros(len(chunks), np.uint64)
        at = 0
        for portion in portions(chunks):
            found = find(portion, bytes_but(*SPACE), lower=False).hashes
            hashes[at : at + len(found)] = found
            at += len(found)
        key = mix(hashes + lang.astype(np.uint64) * BASE)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(changes(key))
        self.first = np.append(first, len(key)).astype(np.int32)
        self.key, self.term, self.repeats = key[first], term[order], table.column("repeats").to_numpy()[order].astype(np.int32)

    def occurrences(self, hashes: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of chunks in languages (numbers in `langs`, -1 for others): places, terms and repeats of all their terms."""
        key = mix(hashes + lang.astype(np.uint64) * BASE)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = np.flatnonzero((self.key[at] == key) & (lang >= 0))
        first = self.first[at[hit]].astype(np.int64)
        n = self.first[at[hit] + 1] - first
        entry = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.repeat(hit, n), self.term[entry], self.repeats[entry]


def _counts(texts: DataFrame, part: Slice) -> DataFrame:
    """lang, source, term, count, documents of each batch for the terms of a slice."""
    shared = texts.sparkSession.sparkContext.broadcast(part)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, inside = shared.value, bytes_but(*SPACE)
        place = {name: i for i, name in enumerate(own.langs)}
        for batch in batches:
            (names, lang), (sources, source) = codes(batch.column(1)), codes(batch.column(2))
            known = np.array([place.get(name, -1) for name in names] or [-1], np.int64)
            keys, counts = [], []
            for portion in portions(texts_of(batch.column(0))):
                found = find(portion, inside, lower=False)
                at, term, repeats = own.occurrences(found.hashes, known[lang[found.text]])
                key, which = np.unique(found.text[at] * len(own.terms) + term.astype(np.int64), return_inverse=True)
                keys.append(key)
                counts.append(np.bincount(which, repeats, len(key)).astype(np.int64))
            if not keys or not sum(map(len, keys)):
                continue
            key, which = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(which, np.concatenate(counts), len(key)).astype(np.int64)
            doc, term = np.divmod(key, len(own.terms))
            order = np.lexsort((term, source[doc], lang[doc]))
            doc, term, count = doc[order], term[order], count[order]
            row = np.flatnonzero(changes(term, source[doc], lang[doc]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()).take(pa.array(lang[doc[row]])), pa.array(sources, pa.string()).take(pa.array(source[doc[row]])),
                    own.terms.take(pa.array(term[row])), pa.array(np.add.reduceat(count, row)), pa.array(np.diff(np.append(row, len(doc)))),
                ],
                names=["lang", "source", "term", "count", "documents"],
            )

    return texts.mapInArrow(read, "lang string, source string, term string, count long, documents long")


def term_counts(texts: DataFrame, known: DataFrame) -> DataFrame | None:
    """lang, source, term, count, documents; None without terms. `known`: the dictionary, in the shared folder."""
    passes = -(-known.count() // SLICE)
    found = None
    for n in range(passes):
        table = known.filter(F.pmod(F.xxhash64("term"), F.lit(passes)) == n).toArrow()  # about SLICE rows
        if table.num_rows:
            part = _counts(texts, Slice(table))
            found = part if found is None else found.unionByName(part)
    return found and found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def share(count, total, terms):
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)")
    return F.call_function("div", above, (total + PRIOR * terms).cast("decimal(20,0)")) + 1


def audit(
    docs: DataFrame, least_documents: int = 30, top: int = 50, text_column: str = "text", lang_column: str = "lang", source_column: str = "source",
) -> DataFrame:
    """lang, source, part (`pair`, `term`), item, value, rank."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_column, "lang"), (source_column, "source")))).distinct()
    texts = texts_by_group(docs, text_column, lang_column, source_column)
    known = settle(dictionary(chunk_documents(texts), least_documents))
    found = term_counts(texts, known)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "lang string, source string, term string, count long, documents long")
    found = settle(found)
    kept = found.groupBy("lang", "term").agg(F.sum("documents").alias("documents")).filter(F.col("documents") >= least_documents)
    counts = settle(found.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", "count"))

    totals = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    by_source = groups.join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    one = F.sort_array(F.collect_list(F.struct("source", "total")))
    terms_of = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    langs = by_source.groupBy("lang").agg(one.alias("groups"), F.sum("total").alias("whole")).join(terms_of, "lang", "left")
    langs = settle(langs.withColumn("terms", F.coalesce("terms", F.lit(0))))

    # Dealt by language and term, as one language may have most terms; the small table of languages is repeated for each salt.
    salts = partitions(docs.sparkSession)
    per_term = counts.groupBy("lang", "term").agg(F.map_from_entries(F.collect_list(F.struct("source", "count"))).alias("by_source"), F.sum("count").alias("count"))
    dealt = per_term.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    wide = dealt.join(langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["lang", "salt"])
    counted = F.transform("groups", lambda g: F.struct(g["source"].alias("source"), F.coalesce(F.col("by_source")[g["source"]], F.lit(0)).alias("count"), g["total"].alias("total")))
    shared = held(
        wide, "lang", "term", share(F.col("count"), F.col("whole"), F.col("terms")).alias("q"),
        F.transform(counted, lambda g: F.struct(g["source"].alias("source"), g["count"].alias("count"), share(g["count"], g["total"], F.col("terms")).alias("p"))).alias("shares"),
    )

    left = shared.select("lang", "shares", F.posexplode("shares").alias("i", "own"))
    right = left.select("lang", "i", "own", F.posexplode("shares").alias("j", "other")).filter("j > i")
    sums = right.groupBy("lang", "i", "j").agg(F.sum(F.abs(F.col("own.p") - F.col("other.p"))).alias("value"))
    every = langs.select("lang", "groups", F.posexplode("groups").alias("i", "own")).select("lang", "i", "own", F.posexplode("groups").alias("j", "other")).filter("i <> j")
    every = every.select("lang", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("own.source").alias("source"), F.col("other.source").alias("item"))
    pairs = every.join(sums, ["lang", "i", "j"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value")
    )
    above = shared.select("lang", "q", "term", F.explode("shares").alias("own")).filter((F.col("own.count") > 0) & (F.col("own.p") > F.col("q")))
    telling = above.select("lang", F.col("own.source").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("own.p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [frame.withColumn("rank", F.row_number().over(order)) for frame in (pairs, telling)]
    return ranked[0].unionByName(ranked[1].filter(F.col("rank") <= top))
