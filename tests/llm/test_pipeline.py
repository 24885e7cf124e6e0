"""Every stage of the pipeline on a small corpus, by itself, against what it should do row by row."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from privasieve.llm import bpe, pii, quality
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    rng = random.Random(4)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n)]
    base = words(60)
    near = [*base[:30], "edit", *base[31:]]
    rows: list[tuple] = [(i, " ".join(words(40))) for i in range(30)]
    rows += [(100, " ".join(base)), (90, " ".join(near)), (101, " ".join(base)), (None, " ".join(base)), (None, " ".join(words(40)))]
    other = " ".join(words(40))
    rows += [(101, other), (101, other), (7, " ".join(words(30))), (200, None), (201, ""), (None, ""), (202, "short one"), (203, "short one")]
    rows += [(300, " ".join([*words(20), "mail", "a.b@c.de", "and", "10.0.0.1", *words(20)]))]
    return [(i, t, "en", ("a", "b", None)[n % 3], len(t or "")) for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels that tell nothing: every score is the share of label 1, so that no stage has an empty input."""
    out = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (5, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def rows_of(frame) -> list[tuple]:
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").withColumns({"score": F.lit(1), "own_id": F.lit("x"), "digest": F.lit(0)})


def test_quality_keeps_every_row_that_scores(spark, docs, folder):
    assert rows_of(corpus_pipeline.good_quality(spark, docs, folder)) == sorted(corpus(), key=str)


def test_probability_is_the_score(spark, docs):
    texts = docs.select("doc_id", "text").filter("doc_id < 30")
    network = quality.ConvNet(3)
    by_udf = {r.doc_id: r.p for r in texts.select("doc_id", quality.probability(spark, network)(F.col("text")).alias("p")).collect()}
    assert by_udf == {r.doc_id: r.score for r in quality.score(texts, network).collect()}


def test_one_of_each_group(spark, docs, folder):
    def shingles(text):
        w = [x.lower() for x in WORD.findall(text or "")]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    def order(row):
        return (row[0] is None, row[0] or 0)

    left = []
    for row in sorted(corpus(), key=order):
        own = shingles(row[1])
        if not own or not any(100 * len(own & s) >= 75 * len(own | s) for s in map(lambda r: shingles(r[1]), left) if s):
            left.append(row)
    got = rows_of(corpus_pipeline.one_of_each_group(spark, docs, folder))
    assert sorted((r[:2] for r in got), key=str) == sorted((r[:2] for r in left), key=str)
    empty = docs.filter("false")
    assert corpus_pipeline.one_of_each_group(spark, empty, folder).count() == 0


def test_personal_data_is_masked(spark, docs, folder):
    got = rows_of(corpus_pipeline.without_personal_data(spark, docs.filter("doc_id = 300 OR doc_id < 30"), folder))
    masked = [(i, t.replace("a.b@c.de", "[EMAIL]").replace("10.0.0.1", "[IP]"), *rest) for i, t, *rest in corpus() if i is not None and (i == 300 or i < 30)]
    assert got == sorted(((i, t, *rest[:-1], len(t)) for i, t, *rest in masked), key=str)


def test_redacted_plan_is_small(docs):
    plan = pii.redact(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 200


def test_mix_gives_each_source_its_words(spark, docs, folder):
    size = lambda t: len(WORD.findall(t or ""))
    whole: dict = {}
    for row in corpus():
        whole[row[3]] = whole.get(row[3], 0) + size(row[1])
    taken: dict = {}
    for _, text, _, source, n in rows_of(corpus_pipeline.mixed_sources(spark, docs, folder)):
        taken[source] = taken.get(source, 0) + size(text)
        assert n == len(text)
    weights = dict(zip(("a", "b", None), (5, 2, 1)))
    target, free, rest = {}, set(weights), 1.5 * sum(whole.values())
    while over := {s for s in free if rest * weights[s] / sum(weights[f] for f in free) > 2 * whole[s]}:
        target |= {s: 2 * whole[s] for s in over}
        rest, free = rest - sum(2 * whole[s] for s in over), free - over
    target |= {s: rest * weights[s] / sum(weights[f] for f in free) for s in free}
    assert taken == {s: int(t) for s, t in target.items()}


def test_run(spark, folder):
    coder = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    )
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        text = coder.decode(ids)
        assert coder.encode_ordinary(text) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert "@" not in text
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mix", "tokens"]


def _kept_after(batches):
    """(mb): what a worker still has of 120 MB of large arrays that it freed while small ones between them stay."""
    import pyarrow as pa

    def held() -> int:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) // 1024

    for batch in batches:
        np.ones(2_000_000).sum()  # by default the first large array that is freed lets later ones of its size stay
        before, large, small = held(), [], []
        for _ in range(80):
            large.append(np.ones(190_000))
            small.append(np.ones(8_000))
        del large
        yield pa.RecordBatch.from_arrays([pa.array([held() - before + 0 * len(small)] * batch.num_rows, pa.int64())], ["mb"])


def test_workers_give_memory_back(spark):
    corpus_pipeline.bound_batches(spark)
    assert spark.range(1).mapInArrow(_kept_after, "mb long").first().mb < 20
