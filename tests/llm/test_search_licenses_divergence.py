"""Ranked search, license scan and divergence audit against brute force, with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from privasieve.llm import divergence, license_scan, pieces, ranked_search
from privasieve.llm.license_texts import PHRASES, TEMPLATES

SCHEMA = "doc_id long, text string, lang string, source string, term string, row long, docs int, place string, item_id int"


def lower(text: str | None) -> str:
    return (text or "").encode().lower().decode()


def texts(seed: int) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("do", "re", "Mi", "fa", "É", "中") for b in ("x", "Y", "z9", "-w", "_v")]
    out: list[str | None] = [None, "", " \n", "?!", "dox"]
    for _ in range(60):
        out.append(" ".join(rng.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=rng.randint(1, 60))))
    out += [out[9]] * 5 + [" ".join(rng.choices(vocabulary, k=4000))]
    rows: list[tuple[int | None, str | None]] = [(i * 7 % 101, t) for i, t in enumerate(out)]
    return rows + [(None, out[9]), (None, out[9]), (3, out[12]), (3, out[12])]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, ("en", "de", None)[n % 3], ("a", "b", "c", None)[n % 4]) for n, (i, t) in enumerate(texts(5))]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, "p", 3) for r in rows], SCHEMA).repartition(3, F.xxhash64("text", "doc_id"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ranked(rows, items, k):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counts = [(i, Counter(word.findall(lower(t)))) for i, t, *_ in rows]
    n = sum(1 for _, c in counts if c)
    total = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in items.items():
        scores = []
        for i, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in Counter(word.findall(lower(text))).items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out[item] = [(r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("item_bytes", [ranked_search.ITEM_BYTES, 400])
def test_ranked_search(spark, docs, rows, empty, monkeypatch, item_bytes):
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", item_bytes)
    items = {1: "Dox REz9 faY faY 中x", 2: rows[9][1], 3: "dox", 4: "nothing here", 5: None, 6: "É-w mi_v " * 30, 7: "fax " * 40 + "dox"}
    table = spark.createDataFrame([(i, t, 7) for i, t in items.items()] + [(3, "dox", 8)], "item_id long, text string, doc_id int")
    got = defaultdict(list)
    for r in ranked_search.search(docs, table, k=6).orderBy("item_id", "rank").collect():
        got[r.item_id].append((r.rank, r.doc_id, r.score))
    assert got == ranked(rows, items, 6)
    assert ranked_search.search(empty, table).count() == 0
    assert ranked_search.search(docs, table.limit(0)).count() == 0


def test_nra_reads_stop_early():
    """A list that cannot change the result any more is not read to its end."""
    n = 4000
    counts = np.array([400, 300, *[1] * (n - 2)])
    block = ranked_search.Block(np.full(n, 500), np.arange(n), np.zeros(n, np.int64), counts, n, 500 * n)
    reads: list[int] = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(len(range(*key.indices(len(self)))))
            return super().__getitem__(key)

    block.docs = block.docs.view(Watched)
    best, scores = block.best([(0, 1)], np.array([9]), 2, 0)
    assert best.tolist() == [0, 1] and scores[0] > scores[1]
    assert sum(reads[1:]) < n


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(pieces, "PORTION", 50)
    texts = [b"one two " * 30, None, b"", b"x" * 200, b"\xc3\xa9t\xc3\xa9 Two"]
    found = [(p.text[k], p.data[s:e]) for portion in pieces.portions(texts) for p in [pieces.find(portion, pieces.bytes_but((0x20, 0x20)), True)] for k, (s, e) in enumerate(zip(p.starts, p.ends))]
    assert found == [(i, w) for i, t in enumerate(texts) for w in (t or b"").lower().split()]
    hashes = {p.data[s:e]: h for portion in pieces.portions(texts) for p in [pieces.find(portion, pieces.bytes_but((0x20, 0x20)), True)] for s, e, h in zip(p.starts, p.ends, p.hashes)}
    assert len(set(hashes.values())) == len(hashes) == 4


def license_rows() -> list[tuple[int | None, str | None]]:
    rng = random.Random(8)
    filler = ["alpha", "License", "the", "General", "Public", "MIT", "software", "É", "2.0", "of"]
    out: list[str | None] = [None, "", "...", "MIT", "mit license", "MIT-License, mit  LICENSE; general public general public license"]
    for label, text in TEMPLATES:
        w = text.split()
        out.append(" ".join(rng.choices(filler, k=20) + w + rng.choices(filler, k=20)))
        cut = list(w)
        for _ in range(max(1, len(w) // 25)):
            at = rng.randrange(len(cut))
            cut[at : at + 1] = rng.choice(([], ["changed"], [cut[at], "put", "in"]))
        out.append(" ".join(rng.choices(filler, k=5) + cut + rng.choices(filler, k=900) + w[: len(w) // 2]))
        out.append(" ".join(w[: len(w) // 3]))
    out += [" ".join(rng.choices(filler, k=300)) for _ in range(5)]
    return [(i % 40 if i % 9 else None, t) for i, t in enumerate(out)]


def scanned(text: str | None) -> tuple:
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall(lower(text))
    spans = []
    for number, (label, own) in enumerate([*PHRASES, *TEMPLATES]):
        t = word.findall(lower(own))
        base = number < len(PHRASES)
        k = 2 if base else 5
        hits = defaultdict(list)
        for d in range(len(words) - k + 1):
            for p in range(len(t) - k + 1):
                if words[d : d + k] == t[p : p + k]:
                    hits[d - p].append(d)
        runs = sorted((min(ds), diagonal, max(ds) + k, [d - diagonal for d in ds]) for diagonal, ds in hits.items())
        clusters: list[list] = []
        furthest = before = 0
        for start, diagonal, end, places in runs:
            if base or not clusters or abs(diagonal - before) > 8 or start - furthest > 12:
                clusters.append([start, end, set()])
            clusters[-1][1] = max(clusters[-1][1], end)
            clusters[-1][2] |= {p + i for p in places for i in range(k)}
            furthest, before = max(furthest, end), diagonal
        spans += [(s, e, label, number, base, len(c) / len(t)) for s, e, c in clusters if len(c) / len(t) >= (1 if base else 0.6)]
    return len(words), sorted(spans)


def test_license_scan(spark, empty):
    rows = license_rows()
    frame = spark.createDataFrame([(i, t, "l", "s", "t", 1, 2, "p", 3) for i, t in rows], SCHEMA).repartition(3)
    got = license_scan.scan(frame).collect()
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1:]))
    want = sorted(((i, *scanned(t)) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans]) for r in got), key=key) == want
    reported = {r.doc_id: r for r in license_scan.report(license_scan.scan(spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string"))).collect()}
    assert len(reported) == len(rows)
    for i, (_, text) in enumerate(rows):
        base = [(m.start(), label) for label, phrase in (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
                for m in re.finditer(f"(?<= ){phrase}(?= )", " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))) + " ")]
        places = [(" " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))))[:at].count(" ") - 1 for at, _ in base]
        r = reported[i]
        assert (r.n_base, r.first_word, r.last_word) == (len(base), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in base})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")
    whole = [r for r in (reported[6 + 3 * n] for n in range(len(TEMPLATES)))]
    assert all(label in r.labels.split(",") and r.score == 1 for (label, _), r in zip(TEMPLATES, whole))
    assert license_scan.scan(empty).count() == 0


def audited(rows, least: int, top: int) -> set:
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    data = [(lang or "", source or "", Counter(word.findall(lower(t)))) for _, t, lang, source in rows]
    out = set()
    for lang in {r[0] for r in data}:
        df = Counter(t for g, _, c in data if g == lang for t in c)
        kept = {t for t, n in df.items() if n >= least}
        counts: dict = defaultdict(Counter)
        for g, s, c in data:
            if g == lang:
                counts[s].update({t: n for t, n in c.items() if t in kept})

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in p:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s)
            terms = sorted((q[t] - p[s][t], t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, i, -v, r + 1) for part, found in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(found)}
    return out


@pytest.mark.parametrize(("least", "portion", "rows_of_slice"), [(2, 1 << 20, 1_000_000), (5, 40, 30), (1000, 1 << 20, 1_000_000)])
def test_divergence(docs, rows, empty, monkeypatch, least, portion, rows_of_slice):
    monkeypatch.setattr(divergence, "SLICE", rows_of_slice)
    monkeypatch.setattr(pieces, "PORTION", portion)
    got = [(r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in divergence.audit(docs, least, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == audited(rows, least, 4)
    assert divergence.audit(empty).count() == 0
