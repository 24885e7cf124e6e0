"""Minimax contiguous partition of documents into shards.

Equal texts form one atomic group. Groups stand in the order of their digest. The smallest capacity for which a
greedy pass needs no more shards than allowed is found by binary search, and the order is cut there.

The groups never come to the driver. It sees sums over ranges of digests: first by three hex digits, then three
more for the ranges in which a cut may fall, until the capacity is certain. A greedy pass over ranges gives two
bounds: cutting only at known borders never does better than the true pass, cutting anywhere inside an unsettled
range never worse. The borders between ranges that are settled are cut exactly.

Within the capacity, cuts go to the border nearest to an even share of what is left, as long as the rest still
fits. Null texts count as empty. Repeated rows each take a slot. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, settle

DIGITS = 3  # hex digits per refinement: 4096 ranges
ALL_DIGITS = 32


class Ranges:
    """Sums over ranges of group keys, in order."""

    def __init__(self, found: dict[str, tuple[int, int]]):
        self.keys = sorted(found)
        self.settled = [found[k][1] == 1 or len(k) >= ALL_DIGITS for k in self.keys]
        self.ends = [0, *accumulate(found[k][0] for k in self.keys)]
        self.total = self.ends[-1]

    def step(self, start: int, capacity: int, hopeful: bool) -> int:
        """Where a shard that starts at `start` ends: at a known border, or (hopeful) anywhere in an unsettled range."""
        aim = start + capacity
        i = bisect_right(self.ends, aim) - 1
        if hopeful and i < len(self.keys) and not self.settled[i]:
            return min(aim, self.ends[i + 1])
        return max(start, self.ends[i])

    def fits(self, capacity: int, shards: int, hopeful: bool, start: int = 0) -> bool:
        for _ in range(shards):
            if start >= self.total:
                break
            end = self.step(start, capacity, hopeful)
            if end <= start:
                return False
            start = end
        return start >= self.total

    def least(self, shards: int, hopeful: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.fits(middle, shards, hopeful):
                high = middle
            else:
                low = middle + 1
        return low

    def doubtful(self, low: int, high: int, shards: int) -> list[str]:
        """Unsettled ranges in which a cut may fall for a capacity from `low` to `high`."""
        first = last = 0
        keys: dict[str, None] = {}
        for _ in range(shards):
            a = max(0, bisect_right(self.ends, first + low) - 1)
            b = min(len(self.keys), bisect_right(self.ends, last + high))
            keys.update((self.keys[i], None) for i in range(a, b) if not self.settled[i])
            first, last = self.step(first, low, False), min(self.total, self.step(last, high, True))
        return list(keys)

    def cuts(self, capacity: int, shards: int) -> list[str]:
        """The key at which each shard but the first begins."""
        found, start = [], 0
        for left in range(shards, 1, -1):
            if start >= self.total:
                break
            even = start + (self.total - start) / left
            i = bisect_left(self.ends, even)
            near = sorted({j for j in (i - 1, i) if 0 <= j < len(self.ends)}, key=lambda j: abs(self.ends[j] - even))
            end = next(
                (e for j in near if start < (e := self.ends[j]) <= start + capacity and self.fits(capacity, left - 1, False, e)),
                self.step(start, capacity, False),
            )
            if end >= self.total:
                break
            found.append(self.keys[self.ends.index(end)])
            start = end
        return found


def capacity_and_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """`groups`: key (32 hex digits), bytes. The smallest capacity, and the first key of every shard after the first."""

    def sums(rows: DataFrame, digits: int) -> dict[str, tuple[int, int]]:
        return {
            r["range"]: (int(r["bytes"]), int(r["n"]))
            for r in rows.groupBy(F.substring("key", 1, digits).alias("range")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()
        }

    found = sums(groups, DIGITS)
    while True:
        ranges = Ranges(found)
        if not ranges.total:
            return 0, []
        low, high = ranges.least(shards, True), ranges.least(shards, False)
        doubtful = ranges.doubtful(low, high, shards) if low < high else []
        if not doubtful:
            return high, ranges.cuts(high, shards)
        for digits in sorted({len(k) for k in doubtful}):
            some = [k for k in doubtful if len(k) == digits]
            found.update(sums(groups.filter(F.substring("key", 1, digits).isin(some)), min(ALL_DIGITS, digits + DIGITS)))
        for key in doubtful:
            del found[key]


def shard(docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. Size: UTF-8 bytes of the text plus 1."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = settle(docs.select(
        F.col(id_column).alias("doc_id"), F.md5(text).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    ))
    groups = settle(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    _, cuts = capacity_and_cuts(groups, shards)
    number = sum(((F.col("key") >= cut).cast("int") for cut in cuts), F.lit(0))
    # Slots: the rows of a shard are dealt over many parts by a hash, numbered in each, and the parts follow one another.
    parts = 8 * partitions(docs.sparkSession)
    dealt = rows.withColumn("shard", number).withColumn("part", F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "key")) - 1
    return dealt.withColumn("place", place).join(starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).alias("slot")
    )
