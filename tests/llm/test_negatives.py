"""Hard negatives against plain products of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, id string, vec string"


def brute(data, positives=5, negatives=3):
    rows = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in data
            if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, label, v in rows:
        if i % 50 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a and len(w) == len(v)]
        best = sorted((s, i) for s, i, other in scored if other == label)[:positives]
        for s, p in best:
            hard = sorted((t, i) for t, i, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(hard[:negatives], 1)]
    return sorted(out)


def frame(spark, data):
    return spark.createDataFrame([(i, v, label, "r", "i", "v") for i, v, label in data], SCHEMA)


def found(spark, data, **how):
    out = N.mine(frame(spark, data), F.col("id") % 50 == 0, **how)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)
                  for r in out.collect())


def cloud(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((labels, dim))
    label = rng.integers(0, labels, n)
    v = (0.2 * (middle[label] + rng.standard_normal((n, dim)))).astype(np.float32)
    return [(i, v[i].tolist(), int(label[i])) for i in range(n)]


@pytest.mark.parametrize("dim,seed", [(3, 1), (16, 2), (64, 3)])
def test_equals_all_pairs(spark, dim, seed):
    data = cloud(700, dim, seed)
    want = brute(data)
    assert want and found(spark, data) == want


def test_awkward_rows(spark):
    data = cloud(300, 4, 7)
    same = [0.5, -0.25, 0.125, 0.75]
    data += [(1000 + i, same, i % 3) for i in range(400)]               # a vector that most rows share
    data += [(2000, None, 1), (2001, [], 1), (2002, [1.0, None, 0.0, 1.0], 1), (2003, [float("nan")] * 4, 1),
             (2004, [float("inf"), 0.0, 0.0, 0.0], 2), (2005, same, None), (None, same, 1),
             (2050, [0.0] * 4, 1), (2100, [1.0, 2.0], 1), (2101, [1.0, 1.0], 1), (2102, [0.5, 1.0], 0),
             (2150, [-v for v in same], 2),                             # negative scores only
             (2200, same, 1), (2200, [0.1, 0.2, 0.3, 0.4], 0), (2201, [0.1] * 4, 0), (2201, [0.1] * 4, 0)]
    assert found(spark, data) == brute(data)
    assert found(spark, data, positives=2, negatives=1) == brute(data, 2, 1)


def test_huge_parts_take_no_part(spark):
    data = cloud(200, 3, 9)
    assert found(spark, data + [(901, [1e30, 0.0, 0.0], 1), (950, [3e38, 1.0, 1.0], 2)]) == brute(data)


def test_empty_and_no_anchor(spark):
    assert found(spark, []) == [] and found(spark, [(1, [1.0], 1)]) == []


def test_label_expression(spark):
    data = cloud(300, 5, 11)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 4).otherwise(F.col("label"))
    out = N.mine(frame(spark, data), F.col("id") % 50 == 0, label).collect()
    moved = [(i, v, (c + 1) % 4 if i % 7 == 0 else c) for i, v, c in data]
    assert sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)
                  for r in out) == brute(moved)


def test_str_packing_and_boxes():
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((1000, 2)) * 50)
    labels = np.arange(1000) % 5 // 4  # 800 rows of label 0, 200 of label 1
    forest = N.Forest(np.arange(1000), x, labels, leaf=10, fan=4)
    assert sorted(forest.ids.tolist()) == list(range(1000)) and len(forest.roots) == 2
    assert sum(level == 0 for level in forest.level) == 100
    anchors = np.floor(rng.standard_normal((20, 2)) * 50)
    smallest, largest = forest.bounds(anchors)
    scores = anchors @ forest.x.T

    def rows(box):
        if forest.level[box] == 0:
            return list(range(forest.first[box], forest.last[box]))
        return [r for child in range(forest.first[box], forest.last[box]) for r in rows(child)]

    for box in range(len(forest.level)):
        inside = scores[:, rows(box)]
        assert (smallest[:, box] <= inside.min(1)).all() and (largest[:, box] >= inside.max(1)).all()
        assert forest.least[box] == forest.ids[rows(box)].min()
    for label, root in forest.roots.items():
        assert {int(labels[i]) for i in forest.ids[rows(root)]} == {label}
    # in the plane the tiles are small: searches open few leaves
    opened = []
    for i, a in enumerate(anchors):
        spans = [(-np.inf, np.inf), (100, 2000), (-300, 50)]
        windows = N.Windows(3, spans)
        opened.append(N.search(forest, list(forest.roots.values()), smallest[i], largest[i], a, -1, windows))
        for (low, high), best in zip(spans, windows.rows):
            want = [(int(s), int(k)) for s, k in zip(scores[i], forest.ids) if low <= s <= high]
            assert best == sorted(want, key=lambda r: (-r[0], r[1]))[:3]
    assert np.mean(opened) < 40
