"""Ranked search against plain scoring of every document."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from texts import docs, empty, rows
from threadmill.llm import ranked as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id long, text string, score string, number string"


def split(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(data, items, k):
    """(item, rank, doc, score), by scoring everything."""
    bags = [(i, split(t)) for i, t in data]
    held = [(i, w) for i, w in bags if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for i, w in held:
            tf, m = Counter(w), 25 + 75 * len(w) * n // total
            s = sum(R.weight(n, df[t]) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in split(text) if tf[t])
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, data, items, k=10, **how):
    frame = spark.createDataFrame([(i, t, "s", "n") for i, t in items], ITEMS)
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in R.search(data, frame, k, **how).collect()), key=str)


def test_terms():
    text = "Über-ALLES 3x! ÉCOLE\x7f日本,a_b\x00c"
    assert [t.decode() for t in R.terms(text.encode())] == split(text) == ["Über", "alles", "3x", "École", "日本", "a", "b", "c"]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_awkward_rows(spark, k):
    data = [r[:2] for r in rows()] + [(3, "one two three"), (None, "ada be cot"), (500, "ada " * 3)]
    items = [(1, "ada be cot dun egg"), (2, None), (3, ""), (4, "ONE one two zebra"), (5, "unknown words only"),
             (None, "kit log"), (7, rows()[7][1]), (8, "日本語 Ünïcode"), (9, rows()[12][1])]
    frame = docs(spark, [(i, t, None, None, *[""] * 8) for i, t in data])
    assert found(spark, frame, items, k) == brute(data, items, k)
    # the same by several passes
    assert found(spark, frame, items, k, query_bytes=40_000) == brute(data, items, k)


def test_ties_are_ordered_by_id(spark):
    data = [(i, "same words here" if i % 3 else "other words") for i in range(60, 0, -1)]
    items = [(1, "same"), (2, "words"), (3, "same other")]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    assert found(spark, frame, items, 5) == brute(data, items, 5)


def test_empty_tables(spark):
    assert found(spark, empty(spark), [(1, "ada")]) == []
    none = T._parse_datatype_string(ITEMS)
    assert R.search(docs(spark), spark.createDataFrame([], none)).collect() == []


def test_many_blocks_and_early_stops(spark, monkeypatch):
    """Small blocks give the same rows; the search stops long before the lists end."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    p = 1 / np.arange(1, 301)
    data = [(i, " ".join(rng.choice(words, rng.integers(1, 80), p=p / p.sum()))) for i in range(1500)]
    items = [(i, " ".join(rng.choice(words, 12, p=p / p.sum()))) for i in range(10)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    want = brute(data, items, 10)
    assert found(spark, frame, items) == want
    counts = R.Counter(t for _, text in data for t in set(split(text)))
    total = sum(len(split(t)) for _, t in data)
    wanted = {w.encode(): i for i, w in enumerate(words)}
    weights = np.array([R.weight(len(data), counts[w]) for w in words], np.int64)

    class Batch:
        num_rows = len(data)

        def column(self, k):
            import pyarrow as pa
            return pa.array([d[0] for d in data]) if k == 0 else pa.array([d[1].encode() for d in data], pa.binary())

    for size in (400, 10 ** 9):
        monkeypatch.setattr(R, "BLOCK_POSTINGS", size)
        best = {}
        for block in R._blocks(iter([Batch()]), wanted, weights, len(data), total):
            for item, text in items:
                query = [(wanted[w.encode()], q) for w, q in Counter(split(text)).items()]
                at, score = block.search(query, 10, 1)
                best[item] = sorted(best.get(item, []) + [(-int(s), int(i)) for i, s in zip(block.ids[at], score)])[:10]
        assert sorted(((i, n, d, -s) for i, b in best.items() for n, (s, d) in enumerate(b, 1)), key=str) == want
