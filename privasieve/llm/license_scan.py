"""License scan by diagonal voting.

Templates (phrases and license texts) are rolled into word k-grams: 2 words for phrases, 5 for texts. All k-grams of all documents
are joined with them by hash in Spark; a hit of a template's place t at a document's place d votes for the diagonal d - t. Votes are
summed by document, template and diagonal, which gives runs that need no alignment. Neighbouring diagonals (SHIFT words apart at
most, as where words were put in or left out) whose runs follow each other within GAP words are merged. A span is verified by
words: each vote compares its words with the template's, and the words of the template that the votes cover, all different
places, must be its whole length for a phrase, and COVER of it for a text. The coverage is the span's score.

The templates are a constant of the library (or the caller's own list), so their table of at most MOST_GRAMS rows is broadcast;
a longer list is joined like any other table. A document is a row throughout: a place in it is a row of a generator that feeds the join
inside one stage, so only hits leave the task. A row for the document itself goes along and keeps documents without hits.

Nulls: a null text is empty, has no words and no spans. Null ids and rows that repeat an id are documents of their own, as rows
have names of their own inside. Equal spans of two templates stand in the order of label and template. An empty table gives no
rows. Further columns are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_texts import PHRASES, TEMPLATES
from .shared import held

# What a word is not made of, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASE_GRAM, TEXT_GRAM = 2, 5
SHIFT, GAP, COVER = 8, 12, 0.6
MOST_GRAMS = 200_000

SPANS = "array<struct<start:int,end:int,label:string,template:int,base:boolean,coverage:double>>"


def words(text):
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def gram(all_words, place, width: int):
    """The hash of `width` words from `place` on; null where they do not fit."""
    parts = [F.get(all_words, place + i) for i in range(width)]
    return F.when(place + width <= F.size(all_words), F.xxhash64(F.lit(width), *parts))


def gram_words(all_words, place, width):
    return F.array_join(F.slice(all_words, place + 1, width), " ")


def template_grams(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """template, label, base, length (in words), width, place, hash, gram."""
    rows = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in templates]
    own_word = re.compile(WORD)
    cut = [own_word.findall(text.translate(str.maketrans(UPPER, LOWER))) for _, text, _ in rows]
    data = [
        (i, label, base, len(w), PHRASE_GRAM if base else min(TEXT_GRAM, len(w)), w) for i, ((label, _, base), w) in enumerate(zip(rows, cut)) if len(w) >= PHRASE_GRAM
    ]
    if any(not base and len(w) < TEXT_GRAM for (_, _, base), w in zip(rows, cut)):
        raise ValueError(f"a text has {TEXT_GRAM} words or more; give shorter ones as phrases")
    table = spark.createDataFrame(data, "template int, label string, base boolean, length int, width int, words array<string>")
    placed = table.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("width"))))
    hashed = F.when(F.col("base"), gram(F.col("words"), F.col("place"), PHRASE_GRAM)).otherwise(gram(F.col("words"), F.col("place"), TEXT_GRAM))
    placed = placed.select("template", "label", "base", "length", "width", "place", hashed.alias("hash"), gram_words(F.col("words"), F.col("place"), F.col("width")).alias("gram"))
    size = sum(len(w) for w in cut)
    return F.broadcast(placed) if size <= MOST_GRAMS else placed


def votes(docs: DataFrame, grams: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """row, doc_id, n_words, and a vote's template, place and at; one row without a vote for each document."""
    own = held(docs, F.col(id_column).alias("doc_id"), F.monotonically_increasing_id().alias("row"), words(F.col(text_column)).alias("words"))
    placed = own.select("row", "doc_id", "words", F.posexplode_outer("words").alias("at", "word"))
    both = F.array(gram(F.col("words"), F.col("at"), PHRASE_GRAM), gram(F.col("words"), F.col("at"), TEXT_GRAM))
    rolled = placed.select("row", "doc_id", "words", "at", F.posexplode(both).alias("kind", "hash"))
    itself = (F.col("kind") == 0) & (F.coalesce("at", F.lit(0)) == 0)
    rolled = rolled.filter(F.col("hash").isNotNull() | itself)
    joined = rolled.join(grams, "hash", "left").filter(F.col("template").isNotNull() | itself)
    same = gram_words(F.col("words"), F.col("at"), F.col("width")) == F.col("gram")
    return joined.select(
        "row", "doc_id", F.size("words").alias("n_words"), F.when(same, F.col("template")).alias("template"), "label", "base", "length", "width", "place", "at"
    )


def scan(
    docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, cover: float = COVER, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """doc_id, n_words, spans: for each row its verified spans in order, with label, template, base and coverage."""
    cast = votes(docs, template_grams(docs.sparkSession, phrases, templates), id_column, text_column)
    of_template = ["row", "template", "label", "base", "length", "width"]
    diagonals = cast.groupBy(*of_template, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.min("at").alias("start"), (F.max("at") + F.max("width")).alias("end"), F.sort_array(F.collect_set("place")).alias("places"),
        F.max("n_words").alias("n_words"), F.max("doc_id").alias("doc_id"),
    )
    order = Window.partitionBy("row", "template").orderBy("start", "diagonal")
    far = (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > SHIFT) | (
        F.col("start") - F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) > GAP
    )
    cluster = F.sum(F.coalesce((F.col("base") | far).cast("int"), F.lit(1))).over(order)
    merged = diagonals.withColumn("cluster", cluster).groupBy(*of_template, "cluster").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.flatten(F.collect_list("places")).alias("places"),
        F.max("n_words").alias("n_words"), F.max("doc_id").alias("doc_id"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("width") - 1)))))
    measured = merged.withColumn("coverage", covered / F.col("length"))
    right = F.col("template").isNotNull() & (F.col("coverage") >= F.when(F.col("base"), F.lit(1.0)).otherwise(F.lit(cover)))
    span = F.when(right, F.struct("start", "end", "label", "template", "base", "coverage"))
    found = measured.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sort_array(F.collect_list(span)).cast(SPANS).alias("spans")
    )
    return found.select("doc_id", "n_words", "spans")


def report(scanned: DataFrame) -> DataFrame:
    """The counts, places, labels and score of each document."""
    base = F.filter("spans", lambda s: s["base"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    starts = F.transform(base, lambda s: s["start"].cast("long"))
    return scanned.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
