"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the documents stand in the order of their keys, and a
running sum of their sizes says where the budget of the source ends. The sums are distributed: the high bits of
the key are ranges of equal expected depth, so each (source, range) is summed by itself and starts at the sum of
the ranges before it. A source of any size is spread over all ranges. Budgets above the size of a source take
whole epochs first; the document at the cut gives only the words that are left, so a source's words come to the
whole part of its target exactly.

Targets share `share` times all sizes by weight and stop at `most` times the size of the source; what is over
goes to the others by weight until none is above. That is a water level, found with running sums over the
summary of sources (one row per source).

Nulls: a null text has size 0, a null source is a source of its own and stands last, a null id is a key like any
other. Repeated rows each count. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, partitions, settle

KEY_BITS = 60


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(identifier, seed: int):
    """60 hash-random bits of an identifier."""
    text = F.concat(F.coalesce(identifier.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from rows of (source, size)."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sources.withColumn("weight", F.get(cycle, place % len(weights))).withColumn("most", F.col("source_size") * F.lit(most))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(share)
    levels = weighed.withColumn("level", (total - before) / weight_left)
    level = F.max("level").over(everything)
    return levels.select("source", "source_size", F.least(F.col("weight") * level, F.col("most")).alias("target"))


def mix(
    docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7,
    id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes, repeats counted."""
    spark = docs.sparkSession
    sized = settle(docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), word_count(F.col(text_column)).alias("size")
    ))
    bits = max(6, (8 * partitions(spark)).bit_length())
    keyed = sized.withColumn("key", random_key(F.col("doc_id"), seed)).withColumn("range", F.shiftright("key", KEY_BITS - bits).cast("int"))
    by_range = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
        .withColumn("start", F.coalesce(F.sum("range_size").over(by_range), F.lit(0))).drop("range_size")
    )
    budgets = targets(sized, weights, share, most)
    plan = starts.alias("s").join(budgets.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source"))).select(
        F.col("s.source").alias("plan_source"), F.col("s.range").alias("plan_range"), "start", "source_size", "target"
    )
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        plan, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("range") == F.col("plan_range"))
    )
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("start") - F.col("before")
    return placed.withColumn("epochs", epochs).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(rest, F.lit(0)))).cast("long").alias("taken"),
    )


def draw(docs: DataFrame, mixed: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The mix itself: each document as often as it is taken, the last time only its first words where the cut falls
    inside it. Documents that are not taken go; so do documents without words. `id_column` is a key of `docs`."""
    columns = docs.columns
    shares = mixed.filter((F.col("taken") > 0) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("taken").alias("__taken")
    )
    joined = docs.join(shares, F.col(id_column) == F.col("__id"))
    whole = F.floor(F.col("__taken") / F.col("__size"))
    left = (F.col("__taken") - whole * F.col("__size")).cast("int")
    copies = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), (whole + (left > 0).cast("int")).cast("int"))))
    words = F.regexp_extract_all(text_column, F.lit(WORD), 0)
    text = F.when(F.col("__copy") <= whole, F.col(text_column)).otherwise(F.array_join(F.slice(words, F.lit(1), left), " "))
    return copies.withColumn(text_column, text).select(*columns)
