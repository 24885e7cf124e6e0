"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, with built-in functions only.

A paragraph is a line with something in it; the set of its digests stands for the text. A sketch has three
sections of cells; a digest is put into one cell of each: the cell counts it and takes it, and a check value of it, into
running exclusive ors. Two sketches of equal size are subtracted cell by cell, which leaves the digests of only one
side; cells with a single digest are peeled until nothing is left. What was peeled are the digests that differ, and
from their number follows the likeness of the two texts, the Jaccard similarity of their paragraph sets. Where peeling
stops early, the sets are cut into as many groups as they need, each with a sketch of its own. A group that does not peel
is tried again with other hashes, and after the last attempt its two sets of digests are compared as they are.

A fingerprint is a sketch of `CELLS` cells, as text. Equal texts have equal fingerprints. Paragraphs that a document
repeats count once. Null texts count as empty; two empty sets have likeness 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .shared import held, partitions

SECTIONS = 3
WIDTH = 12  # cells of a section
CELLS = SECTIONS * WIDTH
ROUNDS = 24
RETRIES = 4
GROUP = 14  # expected digests in a group
FOUND = "array<struct<n:int,digest:bigint>>"


def paragraphs(text: Column) -> Column:
    """Distinct digests of the lines of a text, in ascending order."""
    lines = F.filter(F.split(text, "\n", -1), lambda p: F.length(p) > 0)
    return F.sort_array(F.array_distinct(F.transform(lines, lambda p: F.xxhash64(p))))


def check_of(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def placed(digest: Column, seed: Column, n: Column) -> Column:
    """A digest with its check value and its three cells."""
    places = F.array(*[(F.pmod(F.xxhash64(digest, seed, F.lit(i)), F.lit(WIDTH)) + i * WIDTH).cast("int") for i in range(SECTIONS)])
    return F.struct(n.alias("n"), digest.alias("digest"), check_of(digest).alias("check"), places.alias("at"))


def cell(count: Column, digest: Column, check: Column) -> Column:
    return F.struct(count.alias("n"), digest.alias("digest"), check.alias("check"))


def into(cells: Column, rows: Column, sign: int) -> Column:
    """Placed digests put into cells (sign 1) or taken out of them (sign -1)."""
    return F.transform(cells, lambda c, i: F.aggregate(
        F.filter(rows, lambda r: F.array_contains(r["at"], i)), c,
        lambda x, r: cell(x["n"] + r["n"] * sign, x["digest"].bitwiseXOR(r["digest"]), x["check"].bitwiseXOR(r["check"])),
    ))


def sketch(digests: Column, seed: Column) -> Column:
    """CELLS structs (n, digest, check)."""
    zero = cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    rows = F.transform(digests, lambda d: placed(d, seed, F.lit(1)))
    return let(rows, lambda keyed: into(F.array_repeat(zero, CELLS), keyed, 1))


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: cell(a["n"] - b["n"], a["digest"].bitwiseXOR(b["digest"]), a["check"].bitwiseXOR(b["check"])))


def pure(cells: Column, seed: Column) -> Column:
    """The single digests of cells that hold just one, with their sign and places."""
    alone = F.filter(cells, lambda c: (F.abs(c["n"]) == 1) & (c["check"] == check_of(c["digest"])))
    return F.array_distinct(F.transform(alone, lambda c: placed(c["digest"], seed, c["n"])))


def peel(difference: Column, seed: Column) -> Column:
    """Digests of only one side as array<struct<n,digest>> (n is 1 for the left one, -1 for the right one); null on failure."""
    state = F.struct(difference.alias("cells"), F.array().cast(FOUND).alias("found"), F.lit(True).alias("going"))

    def step(s: Column, _: Column) -> Column:
        def go(new: Column) -> Column:
            return F.struct(
                into(s["cells"], new, -1).alias("cells"),
                F.concat(s["found"], F.transform(new, lambda r: F.struct(r["n"].alias("n"), r["digest"].alias("digest")))).alias("found"),
                (F.size(new) > 0).alias("going"),
            )

        return F.when(s["going"], let(pure(s["cells"], seed), go)).otherwise(s)

    def end(s: Column) -> Column:
        clean = F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["digest"] == 0) & (c["check"] == 0))
        return F.when(clean, s["found"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, step, end)


def grouped(left: Column, right: Column) -> Column:
    """Both sets cut into groups by digest, as many as the sets need: an array of array<struct<place,side,digest>> with
    side 1 for the left set and -1 for the right one. Groups with nothing in them are left out."""
    count = F.floor((F.size(left) + F.size(right)) / GROUP) + 1

    def keyed(digests: Column, side: int) -> Column:
        place = lambda d: F.pmod(F.xxhash64(d, F.lit("group")), count)
        return F.transform(digests, lambda d: F.struct(place(d).alias("place"), F.lit(side).alias("side"), d.alias("digest")))

    def cut(rows: Column) -> Column:
        first = lambda i: (i == 0) | (F.get(rows, i)["place"] != F.get(rows, i - 1)["place"])
        starts = F.filter(F.transform(rows, lambda _, i: i), first)
        return let(starts, lambda at: F.transform(at, lambda start, k: F.slice(rows, start + 1, F.coalesce(F.get(at, k + 1), F.size(rows)) - start)))

    return let(F.sort_array(F.concat(keyed(left, 1), keyed(right, -1))), cut)


def settled(group: Column) -> Column:
    """Differing digests of a group: peeled from sketches with other hashes each time, and where no attempt peels, as
    when two digests share all their cells, taken from the two sides themselves."""
    side = lambda n: F.transform(F.filter(group, lambda r: r["side"] == n), lambda r: r["digest"])
    alone = lambda a, b, n: F.transform(F.array_except(a, b), lambda d: F.struct(F.lit(n).alias("n"), d.alias("digest")))
    sides = F.struct(side(1).alias("left"), side(-1).alias("right"))

    def tried(s: Column) -> Column:
        attempts = F.aggregate(
            F.sequence(F.lit(1), F.lit(RETRIES)), F.lit(None).cast(FOUND),
            lambda found, seed: F.coalesce(found, peel(subtract(sketch(s["left"], seed), sketch(s["right"], seed)), seed)),
        )
        return F.coalesce(attempts, F.concat(alone(s["left"], s["right"], 1), alone(s["right"], s["left"], -1)).cast(FOUND))

    return let(sides, tried)


def differing(left: Column, right: Column, left_cells: Column, right_cells: Column) -> Column:
    """Differing digests of two sets from their standard sketches; where those do not peel, group by group."""
    return F.coalesce(peel(subtract(left_cells, right_cells), F.lit(0)), F.flatten(F.transform(grouped(left, right), settled)))


def likeness(left: Column, right: Column, left_cells: Column, right_cells: Column) -> Column:
    total = F.size(left) + F.size(right)
    unlike = let(F.size(differing(left, right, left_cells, right_cells)), lambda d: (total - d) / (total + d))
    return F.when(left_cells == right_cells, F.lit(1.0)).otherwise(unlike).cast("double")


def written(cells: Column) -> Column:
    """A sketch as text."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["n"].cast("string"), F.lower(F.hex(c["digest"])), F.lower(F.hex(c["check"])))), " ")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) with the text of the next document in descending order of doc_id as `next_text`; after
    the last comes the first. Null ids stand last, equal ids in the order of their texts.

    Ids are cut into ranges at ids that occur. The head of each range is also dealt to the range before it, so each range
    is a window of its own. Only the borders, three for each shuffle partition, are known to the driver.
    """
    shares = 3 * partitions(docs.sparkSession)
    steps = [i / shares for i in range(1, shares)] + [1.0]
    found = docs.agg(F.percentile_approx("doc_id", F.lit(steps), 100 * shares)).first()[0]
    heads = sorted(set(found or []), reverse=True)
    count = max(1, len(heads))
    highest = F.lit(sorted(heads)).cast("array<bigint>") if heads else F.array().cast("array<bigint>")
    # Range 0 has the highest ids: those above the second border, and so on.
    above = F.size(F.filter(highest, lambda h: h >= F.col("doc_id")))
    number = F.when(F.col("doc_id").isNull(), count - 1).otherwise(F.greatest(above - 1, F.lit(0)))
    is_head = F.array_contains(highest, F.col("doc_id"))
    dealt = docs.withColumn("range", number).withColumn("extra", F.explode(F.when(is_head, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    dealt = dealt.withColumn("range", F.when(F.col("extra"), F.pmod(F.col("range") - 1, F.lit(count))).otherwise(F.col("range")))
    order = Window.partitionBy("range").orderBy("extra", F.col("doc_id").desc_nulls_last(), F.col("text"))
    following = dealt.withColumn("next_text", F.lead("text").over(order))
    return following.filter(~F.col("extra")).select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as much of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. One row per row."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    paired = with_next(rows)
    texts = paired.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    sets = held(
        texts, "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        paragraphs(F.col("text")).alias("own"), paragraphs(F.col("edited")).alias("other"), paragraphs(F.col("next_text")).alias("following"),
    )
    cells = held(sets, *sets.columns, *[sketch(F.col(c), F.lit(0)).alias(f"{c}_cells") for c in ("own", "other", "following")])
    return cells.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("own_cells")).alias("fingerprint"), written(F.col("other_cells")).alias("edited_fingerprint"),
        *[likeness(F.col("own"), F.col(c), F.col("own_cells"), F.col(f"{c}_cells")).alias(name) for c, name in (("other", "near_edited"), ("following", "near_next"))],
    )
