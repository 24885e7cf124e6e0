"""Exact similarity join of word shingle sets with token-combination prefixes, and its connected components.

A document's set holds the hashes of its 5-word shingles. All sets order their tokens alike: rare tokens first, then
frequent ones, by hash within each. With similarity 0.75 or more, the first p = n - ceil(0.75 n) + 1 tokens of two sets
share one, and the first p + g share g + 1. So each set is indexed

* under each single rare token among its first p, and
* if these do not fill the prefix, under pairs of frequent tokens: the prefix is extended by g, its frequent tokens are
  dealt into g groups by hash, and the pairs within a group are taken. Of g + 1 shared frequent tokens two fall into
  one group. g is fixed per band of set sizes; a set is indexed for its own band and the next, which covers all sets
  of similar size. As g grows with p, a set has a number of pairs in proportion to its prefix.

Frequent tokens are found by counting the tokens of all documents, where those met once in a task's share are left out of
the sum; which tokens count as frequent decides the cost, never the result. Their number is bounded by (all tokens) / (least
frequency), so they can be broadcast.

Where two sets meet first, each has passed some tokens that the other lacks. Under a rare token these are all tokens before
it (`passed`: its place in the order); under pairs they are all rare tokens, as a set that is indexed under pairs is indexed
under all its rare tokens. So they share at most the fewer of their other tokens (r = n - passed), and a bucket can be
where similar sets meet first only if 7 r >= 3 (n + n'). Of the buckets with the same sets the one of the first token is kept.

Sets with equal content are one entity from the start (named by a 64-bit hash of the set), so copies cost nothing. Sets
under one key (a bucket) are tied to its head, the member of fewest rare tokens. Each set is compared with the head it shares
most buckets with; verified links make components. Then the other heads in different components are compared, then all pairs
of a bucket that lie in different components and are not compared yet are verified too. No link between different
components is lost, and no pairs are made within a group of near copies. Buckets are read as sorted streams, those of
pairs are split by salt, and no task holds a bucket in memory. Before texts are read for a comparison, counts of tokens by
hash range (256 bytes for a set) rule out pairs that cannot be similar.

Null and empty texts, and texts without words, have an empty set and are linked with nothing; with one to four words the
whole sequence is the only shingle. Rows without an id get no component. Rows that repeat an id belong together.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, settle, ship
from .words import U, chunks, grams, mix, texts_of, word_hashes

SHINGLE = 5
NUMERATOR, DENOMINATOR = 3, 4  # similarity 0.75
LEAST_FREQUENCY = 24
MOST_FREQUENT = 1_000_000  # bound of the broadcast set of frequent tokens
FLUSH = 6_000_000
SALTS = 16
LOOK_BACK = 8  # buckets of a set in which a pair is looked for before it is made once more
EDGES_OF_PARTITION = 50_000
FIRST_ROUNDS = 2  # of components that only save comparisons
BROADCAST_ROWS = 500_000  # ids of 16 bytes
BUCKET_NAMES = ["signature", "paired", "key", "n", "rare", "passed", "head", "head_n", "head_passed"]


def shingle_set(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingles of one text in ascending order."""
    if len(hashes) >= SHINGLE:
        return np.unique(grams(hashes, SHINGLE))
    return grams(hashes, len(hashes)) if len(hashes) else np.zeros(0, U)


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    for first, last in chunks(texts):
        hashes, borders = word_hashes(texts[first:last])
        for a, b in zip(borders[:-1], borders[1:]):
            yield shingle_set(hashes[a:b])


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit name of a set."""
    spread = mix(tokens)
    both = np.array([np.add.reduce(spread), np.bitwise_xor.reduce(spread * U(3)), len(tokens)], U)
    return int(grams(both, 3).astype(np.int64)[0])


def sketch(tokens: np.ndarray) -> bytes:
    """How many tokens fall into each of some equal ranges of hashes, up to 255: 256 ranges, or more for larger sets, a power
    of two between a quarter and half of their tokens. So a sketch tells unlike sets apart at any size."""
    bits = max(8, len(tokens).bit_length() - 2)
    return np.minimum(np.bincount((tokens >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def band(n: int) -> int:
    return floor(log(n) / log(DENOMINATOR / NUMERATOR) + 1e-9)


def groups(of_band: int) -> int:
    """How many tokens the prefix is extended by in a band of set sizes."""
    return max(1, ceil((1 - NUMERATOR / DENOMINATOR) * (DENOMINATOR / NUMERATOR) ** of_band) // 2)


def pair_keys(frequent: np.ndarray, room: int, n: int) -> np.ndarray:
    """Keys of pairs of frequent tokens within groups. `room`: how many of the first p tokens are frequent."""
    keys = []
    for b in (band(n), band(n) + 1):
        g = groups(b)
        taken = frequent[: room + g]
        group = (taken % U(g)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        taken, group = taken[order], group[order]
        for distance in range(1, len(taken)):
            same = group[distance:] == group[:-distance]
            if not same.any():
                break
            keys.append(mix(taken[:-distance][same] * U(31) + mix(taken[distance:][same]) + U(b)))
    return np.concatenate(keys) if keys else np.zeros(0, U)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, key, sketch, digest) of every row."""
    for batch in batches:
        sizes, keys, sketches = [], [], []
        for tokens in shingle_sets(texts_of(batch.column(1))):
            sizes.append(len(tokens))
            keys.append(set_key(tokens) if len(tokens) else None)
            sketches.append(sketch(tokens))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary()), batch.column(2)],
            ["doc_id", "n", "key", "sketch", "digest"],
        )


def repeated(tokens: np.ndarray) -> np.ndarray:
    """The tokens that are there more than once, each as often as before. Sorts in place, as a task's share is large and most
    of it is met once: a copy of it and the places of all its tokens would take several times its memory."""
    tokens.sort()
    same = np.zeros(len(tokens) + 1, bool)
    np.equal(tokens[1:], tokens[:-1], out=same[1:-1])
    return tokens[same[1:] | same[:-1]]


def _shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, seen): how many sets of this task hold a token, summed up in portions; tokens met once in a portion are left out."""
    pool: list[np.ndarray] = []
    known: set[int] = set()
    size = 0

    def counts() -> pa.RecordBatch:
        tokens = np.concatenate(pool)
        pool.clear()
        known.clear()
        tokens, seen = np.unique(repeated(tokens), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens.astype(np.int64)), pa.array(seen.astype(np.int64))], ["token", "seen"])

    for batch in batches:
        for tokens in shingle_sets(texts_of(batch.column(1))):
            if len(tokens) >= NUMERATOR and (key := set_key(tokens)) not in known:
                known.add(key)
                pool.append(tokens)
                size += len(tokens)
            if size >= FLUSH:
                yield counts()
                size = 0
    if pool:
        yield counts()


def frequent_tokens(known: DataFrame, total: int) -> np.ndarray:
    """Tokens of at least so many sets that there can be no more than MOST_FREQUENT of them. `total`: tokens of all sets."""
    least = max(LEAST_FREQUENCY, -(-total // MOST_FREQUENT))
    often = known.mapInArrow(_shared_counts, "token long, seen long").groupBy("token").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= least)
    return np.sort(np.array([r["token"] for r in often.select("token").collect()], np.int64).astype(U))


def signatures(rows: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(signature, paired, key, n, rare, passed) of all sets: each set once in a task. `rare`: how many of its tokens are rare;
    `passed`: how many tokens a set that is first met here does not share."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, known = shared.value, set()
        for batch in batches:
            found, kinds, keys, sizes, rares, passed = [], [], [], [], [], []
            for tokens in shingle_sets(texts_of(batch.column(1))):
                n = len(tokens)
                if n < NUMERATOR or (key := set_key(tokens)) in known:
                    continue
                known.add(key)
                at = np.searchsorted(often, tokens)
                is_often = often[np.minimum(at, len(often) - 1)] == tokens if len(often) else np.zeros(n, bool)
                p = prefix_length(n)
                singles = tokens[~is_often][:p]
                pairs = pair_keys(tokens[is_often], p - len(singles), n) if len(singles) < p else np.zeros(0, U)
                found += [singles, pairs]
                kinds += [np.zeros(len(singles), bool), np.ones(len(pairs), bool)]
                keys.append(np.full(len(singles) + len(pairs), key, np.int64))
                sizes.append(np.full(len(singles) + len(pairs), n, np.int32))
                rares.append(np.full(len(singles) + len(pairs), n - is_often.sum(), np.int32))
                passed += [np.arange(len(singles), dtype=np.int32), np.full(len(pairs), n - is_often.sum(), np.int32)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).astype(np.int64)), pa.array(np.concatenate(kinds)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes)),
                     pa.array(np.concatenate(rares)), pa.array(np.concatenate(passed))],
                    BUCKET_NAMES[:6],
                )

    return rows.mapInArrow(run, "signature long, paired boolean, key long, n int, rare int, passed int")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (signature, paired, key, n, rare, passed): those of buckets of two sets or more, or of pairs, with the first
    set of the bucket. Runs go on from batch to batch; only the last row and the head of its bucket are held."""
    held = None  # signature, paired, key, n, rare, passed, head, head's n, head's passed, given out
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held is not None:
            columns = [np.concatenate([[h], c]).astype(c.dtype) for h, c in zip(held[:6], columns)]
        signature, key = columns[0], columns[2]
        fresh = np.append(True, signature[1:] != signature[:-1])
        distinct = fresh | np.append(True, key[1:] != key[:-1])
        signature, paired, key, n, rare, passed, fresh = (x[distinct] for x in (*columns, fresh))
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        head, head_n, head_passed = key[start], n[start], passed[start]
        if held is not None:
            first = start == 0
            head[first], head_n[first], head_passed[first] = held[6:9]
        more = np.append(~fresh[1:], False)
        give = ~fresh | more | paired
        give[-1] = False  # goes out with the next row
        if held is not None:
            give[0] = give[0] or held[9] and not give[0] and len(give) > 1
        columns = (signature, paired, key, n, rare, passed, head, head_n, head_passed)
        yield pa.RecordBatch.from_arrays([pa.array(x[give]) for x in columns], BUCKET_NAMES)
        again = bool(~fresh[-1]) or (len(key) == 1 and held is not None and held[9]) or bool(paired[-1])
        held = (*(x[-1] for x in columns), again)
    if held is not None and held[9]:
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held[:9], types)], BUCKET_NAMES)


def buckets(signed: DataFrame) -> DataFrame:
    salt = F.when(F.col("paired"), F.pmod("key", F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    dealt = signed.repartition(partitions(signed.sparkSession), "signature", salt).sortWithinPartitions("signature", "rare", "key")
    return dealt.mapInArrow(
        _buckets, "signature long, paired boolean, key long, n int, rare int, passed int, head long, head_n int, head_passed int"
    )


def unlike_buckets(found: DataFrame) -> DataFrame:
    """Of the buckets that hold the same sets, the one of the first token (tokens are ordered as unsigned numbers); none of one set."""
    held = [F.count("*").alias("sets"), *(F.bit_xor(F.xxhash64(F.lit(seed), "key")).alias(f"digest_{seed}") for seed in (1, 2))]
    contents = found.groupBy("signature", "paired").agg(*held).filter("sets > 1")
    first = F.min(F.struct(F.col("signature") < 0, "signature"))["signature"].alias("signature")
    return found.join(contents.groupBy("paired", "sets", "digest_1", "digest_2").agg(first).select("signature", "paired"), ["signature", "paired"], "left_semi")


def close_sizes(a: str, b: str):
    """Sets of these sizes can be similar enough."""
    return (F.col(a) * DENOMINATOR >= F.col(b) * NUMERATOR) & (F.col(b) * DENOMINATOR >= F.col(a) * NUMERATOR)


def close_rest(n: str, passed: str, other_n: str, other_passed: str):
    """Sets that meet here first can be similar enough: see the head of this module."""
    least = F.least(F.col(n) - F.col(passed), F.col(other_n) - F.col(other_passed))
    return least * (NUMERATOR + DENOMINATOR) >= (F.col(n) + F.col(other_n)) * NUMERATOR


def star_pairs(found: DataFrame) -> DataFrame:
    """Each set with the head of its bucket, and the heads of a split bucket with its least head: (key, head, buckets)."""
    heads = found.filter("paired AND key = head").select("signature", "key", "n", "rare", "passed")
    least = heads.groupBy("signature").agg(F.min(F.struct("rare", "key", "n", "passed")).alias("least"), F.count("*").alias("count")).filter("count > 1")
    between = heads.join(least, "signature").select(
        "key", "n", "passed", F.col("least.key").alias("head"), F.col("least.n").alias("head_n"), F.col("least.passed").alias("head_passed")
    )
    pairs = found.select(between.columns).unionByName(between).filter((F.col("key") != F.col("head")) & close_sizes("n", "head_n"))
    return pairs.filter(close_rest("n", "passed", "head_n", "head_passed")).groupBy("key", "head").agg(F.count("*").alias("buckets"))


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b of pairs (key, head)."""
    return pairs.select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct()


def nearest_heads(stars: DataFrame) -> DataFrame:
    """Each set with the head it shares most buckets with: distinct (a, b)."""
    return ordered(stars.groupBy("key").agg(F.max(F.struct("buckets", "head")).alias("best")).select("key", "best.head"))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components."""
    left, right = (labels.select(F.col("key").alias(c), F.col("label").alias(f"{c}_label")) for c in ("a", "b"))
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    return both.filter(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")


def crossing_pairs(found: DataFrame, labels: DataFrame, compared: DataFrame) -> DataFrame:
    """Pairs of a bucket that lie in different components and were not compared: distinct (a, b). Sets that are too far
    from the smallest of a bucket to be similar to any leave it first. A pair that shares one of the last few buckets before
    this one, in the order that all sets have, is made there and not again here."""
    smallest = found.groupBy("signature", "paired").agg(F.min("n").alias("least_n"))
    rest = (F.col("n") - F.col("passed")) * (NUMERATOR + DENOMINATOR) >= (F.col("n") + F.col("least_n")) * NUMERATOR
    near = found.join(smallest, ["signature", "paired"]).filter(rest)
    rows = near.select("signature", "paired", "key", "n", "passed").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    last = Window.partitionBy("key", "paired").orderBy(F.col("signature") < 0, "signature").rowsBetween(-LOOK_BACK, -1)
    rows = rows.withColumn("before", F.collect_list("signature").over(last))
    mixed = rows.groupBy("signature", "paired").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    rows = settle(rows.join(mixed.select("signature", "paired"), ["signature", "paired"], "left_semi"))
    left, right = (rows.select("signature", "paired", *(F.col(c).alias(f"{side}_{c}") for c in ("key", "n", "passed", "label", "before"))) for side in "xy")
    possible_rest = close_rest("x_n", "x_passed", "y_n", "y_passed")
    first = ~F.arrays_overlap("x_before", "y_before")
    pairs = left.join(right, ["signature", "paired"]).filter((F.col("x_label") < F.col("y_label")) & close_sizes("x_n", "y_n") & possible_rest & first)
    distinct = pairs.select(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b")).distinct()
    return distinct.join(compared, ["a", "b"], "left_anti")


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops pairs whose range counts prove them unlike: no more tokens can be shared than the smaller count of each range."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (left, right) in enumerate(zip(batch.column(2), batch.column(3))):
            x, y = (np.frombuffer(side.as_buffer(), np.uint8) for side in (left, right))
            if (x == 255).any() or (y == 255).any():
                keep[i] = True  # a count may be more than 255
                continue
            ranges = min(len(x), len(y))
            x, y = (z if len(z) == ranges else z.reshape(ranges, -1).sum(1) for z in (x, y))
            common = int(np.minimum(x, y).sum(dtype=np.int64))
            keep[i] = DENOMINATOR * common >= NUMERATOR * (int(x.sum(dtype=np.int64)) + int(y.sum(dtype=np.int64)) - common)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], ["a", "b"])


def chosen(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """The names of the sets in the pairs. A list of keys of known, small size saves sending all sketches."""
    left, right = (pairs.select(F.col(c).alias("key")).distinct() for c in "ab")
    keys = settle(left.unionByName(right).distinct())
    return settle(names.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "key"))


def possible(pairs: DataFrame, names: DataFrame) -> DataFrame:
    both = pairs.join(names.select(F.col("key").alias("a"), F.col("sketch").alias("left")), "a").join(
        names.select(F.col("key").alias("b"), F.col("sketch").alias("right")), "b"
    )
    return both.select("a", "b", "left", "right").mapInArrow(_possible, "a long, b long")


def _own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) of the rows whose set has the wanted name: a row that repeats an id may have another text."""
    last = None
    for batch in batches:
        same = []
        for tokens, key in zip(shingle_sets(texts_of(batch.column(1))), batch.column(0).to_pylist()):
            same.append(key != last and len(tokens) > 0 and set_key(tokens) == key)
            last = key if same[-1] else last
        yield batch.filter(pa.array(same, pa.bool_()))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets are similar: intersection and union are counted on whole sets."""
    held: tuple[int | None, np.ndarray] = (None, np.zeros(0, U))
    for batch in batches:
        a, b = (batch.column(i).to_numpy() for i in range(2))
        alike = np.zeros(len(a), bool)
        left = batch.column(2)
        for i, right in enumerate(shingle_sets(texts_of(batch.column(3)))):
            if held[0] != a[i]:
                held = (a[i], next(shingle_sets(texts_of(left.slice(i, 1)))))
            common = len(np.intersect1d(held[1], right, assume_unique=True))
            alike[i] = DENOMINATOR * common >= NUMERATOR * (len(held[1]) + len(right) - common)
        yield pa.RecordBatch.from_arrays([pa.array(a[alike]), pa.array(b[alike])], ["a", "b"])


def verified(pairs: DataFrame, names: DataFrame, known: DataFrame) -> DataFrame:
    """The similar ones of the pairs (a, b). Texts are read again for the sets that are still possible."""
    pairs = settle(pairs)
    names = chosen(names, pairs)
    near = settle(possible(pairs, names))
    keys = near.select(F.col("a").alias("key")).unionByName(near.select(F.col("b").alias("key"))).distinct()
    wanted = settle(keys.join(names.select("key", "doc_id"), "key"))
    # A list of ids of known, small size saves sending all texts; a longer one is joined like any table.
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = settle(known.join(side, "doc_id").select("key", "text").mapInArrow(_own_text, "key long, text string"))
    second = near.join(texts.select(F.col("key").alias("b"), F.col("text").alias("b_text")), "b")
    both = second.join(texts.select(F.col("key").alias("a"), F.col("text").alias("a_text")), "a")
    return settle(both.select("a", "b", "a_text", "b_text").mapInArrow(_alike, "a long, b long"))


def components(edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(key, label) of all nodes of edges (a, b): label is the smallest node of the component.

    Rounds of large and small stars: each node ties its larger neighbours, then its smaller ones, to the smallest it
    knows. Only minima are aggregated, so a node may have any number of neighbours. Few edges are held in few partitions.
    After `most_rounds` rounds the label is the smallest node known by then, and nodes of a component may differ in it.
    """

    def state(rows: DataFrame):
        return rows.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = settle(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before, rounds = state(edges), 0
    while most_rounds is None or rounds < most_rounds:
        rounds += 1
        parts = min(partitions(edges.sparkSession), before[0] // EDGES_OF_PARTITION + 1)
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = settle(large.coalesce(parts).distinct().coalesce(parts))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = settle(small.unionByName(low.select("a", F.col("low").alias("b"))).coalesce(parts).distinct().coalesce(parts))
        now = state(edges)
        if now == before:
            break
        before = now
    label = F.min("b").alias("label")
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), "b"))
    return ends.groupBy(F.col("a").alias("key")).agg(label)


def join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach). One row per row.

    Two columns follow, which name rows and components where ids repeat: digest (xxhash64 of the text) and component_key (the
    name of one set of the component; null for empty sets and rows without an id).
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    digested = rows.withColumn("digest", F.xxhash64("text"))
    counted = settle(digested.mapInArrow(_members, "doc_id long, n long, key long, sketch binary, digest long"))
    members = counted.select("doc_id", F.col("n").alias("n_shingles"), "key", "digest")
    known = rows.filter("doc_id IS NOT NULL")
    total = counted.agg(F.sum("n")).first()[0] or 0
    frequent = frequent_tokens(known, total)
    found = settle(unlike_buckets(settle(buckets(signatures(known, frequent)))))
    names = settle(
        counted.filter("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"))
    )
    stars = settle(star_pairs(found))
    compared = settle(nearest_heads(stars))
    links = verified(compared, names, known)
    others = settle(apart(ordered(stars), settle(components(links, FIRST_ROUNDS))).join(compared, ["a", "b"], "left_anti"))
    tied = settle(components(links.unionByName(verified(others, names, known))))
    crossing = crossing_pairs(found, tied, compared.unionByName(others))
    stars = tied.select(F.col("key").alias("a"), F.col("label").alias("b"))
    labels = settle(components(stars.unionByName(verified(crossing, names, known))))
    tied = names.join(labels, "key").select("key", "label", "doc_id")
    least = tied.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_label = tied.select("key", "label").join(least, "label").select("key", "component_id", F.col("label").alias("component_key"))
    by_key = names.join(of_label, "key", "left").select(
        "key", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component_key", "key").alias("component_key")
    )
    identified = F.col("doc_id").isNotNull()
    return members.join(by_key, "key", "left").select(
        "doc_id", "n_shingles", F.when(identified, F.coalesce("component_id", "doc_id")).alias("component_id"), "digest",
        F.when(identified, F.col("component_key")).alias("component_key"),
    )
