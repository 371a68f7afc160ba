from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.llm import ann, components, metric_join


def vectors(n=700, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[50:90] = x[10] + 0.12 * rng.standard_normal((40, dim))      # near copies
    x[100:180] = x[20]                                            # exact copies
    x[180:185] = x[20] * 3                                        # the same direction
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)]
    rows[7] = (7, None, 0)
    rows[8] = (8, [0.0] * dim, 0)
    rows[9] = (9, [float("nan")] * dim, 0)
    rows[11] = (11, [float("inf")] + [0.0] * (dim - 1), 0)
    rows[12] = (12, [None] + [1.0] * (dim - 1), 0)
    rows[13] = (13, [], 0)
    rows[14] = (14, [1.0, 2.0], 0)
    rows[15] = (15, [2.0, 4.0], 0)
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(rows):
    return {i: np.array(v, float) for i, v, _ in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}


def cosine(a, b):
    return (a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()) if len(a) == len(b) else -9


@pytest.mark.parametrize("block,pivot", [(4096, 4000), (64, 40)])
def test_links_match_brute_force(spark, monkeypatch, block, pivot):
    monkeypatch.setattr(metric_join, "BLOCK", block)
    monkeypatch.setattr(metric_join, "PER_PIVOT", pivot)
    rows = vectors()
    good = usable(rows)
    links = defaultdict(set)
    for i in good:
        for j in good:
            if i < j and cosine(good[i], good[j]) >= 0.9:
                links[i].add(j)
                links[j].add(i)
    comp = {}
    for i in sorted(r[0] for r in rows):
        if i not in comp:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in comp:
                    comp[k] = i
                    todo += links[k]
    df = spark.createDataFrame(rows, SCHEMA)
    df = df.unionByName(df.where("vec_id < 30"))
    out = {r.vec_id: r for r in metric_join.near_links(df, 0.9).collect()}
    assert len(out) == len(rows)
    for i, r in out.items():
        assert (r.n_links, r.component_id, r.kept) == (len(links[i]), comp[i], comp[i] == i), i


def brute(rows, threshold, measure=cosine):
    """Per id: links and component, pair by pair."""
    good = usable(rows)
    links = {i: {j for j in good if i != j and measure(good[i], good[j]) >= threshold} for i in good}
    out = {}
    for i in sorted(good):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in out:
                out[k] = (len(links[k]), out[i][1] if i in out else i)
                todo += links[k]
    return out


def test_no_table_grows_with_the_visits(spark, monkeypatch):
    # vectors without structure visit most of the 50 cells
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(rng.standard_normal((1000, 32)).astype(np.float32))]
    monkeypatch.setattr(metric_join, "PER_PIVOT", 20)
    monkeypatch.setattr(metric_join, "BLOCK", 256)
    seen, kept = [], metric_join.stored

    def stored(df):
        seen.append(kept(df))
        return seen[-1]

    monkeypatch.setattr(metric_join, "stored", stored)
    out = metric_join.near_links(spark.createDataFrame(rows, SCHEMA), 0.9)
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == brute(rows, 0.9)
    assert max(df.count() for df in seen) <= len(rows)


def test_links_in_small_strips_and_many_partitions(spark, monkeypatch):
    for name, value in (("PER_PIVOT", 30), ("BLOCK", 16), ("STRIP", 64), ("VISIT_ROWS", 7), ("PARTITIONS", 3),
                        ("PER_PARTITION", 9), ("KEPT_BYTES", 4000)):
        monkeypatch.setattr(metric_join, name, value, raising=False)
    rng = np.random.default_rng(6)
    rows = [(3 * i, [float(v) for v in r], 0) for i, r in enumerate(rng.standard_normal((240, 5)))]  # not exact as floats
    rows += [(1000 + i, [1e300 * v for v in r[1]], 0) for i, r in enumerate(rows[:20])]
    rows += [(2000 + i, [v + 1e-3 for v in r[1]] + [0.5], 0) for i, r in enumerate(rows[:60])]
    out = metric_join.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.9).collect()
    big = [(i, [v / 1e300 for v in x] if 1000 <= i < 2000 else x, c) for i, x, c in rows]  # the same directions
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == brute(big, 0.9)


@pytest.mark.parametrize("threshold", [0.6, 0.6 + 1e-12, 0.6 - 1e-12, 1.0])
def test_cosines_at_the_threshold(spark, threshold):
    # cosines of exactly 0.6 and 1, and others as close as doubles get
    rows = [(0, [1.0, 0.0], 0), (1, [3.0, 4.0], 0), (2, [5.0, 0.0], 0), (3, [0.0, 2.0], 0), (4, [-3.0, 4.0], 0),
            (5, [3.0, 4.0 + 1e-15], 0), (6, [3.0, 4.0000001], 0), (7, [6.0, 8.0], 0)]
    out = metric_join.near_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold)
    exact = brute(rows, threshold, lambda a, b: metric_join.V.cosine_pairs(a[None, :], b[None, :])[0])
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == exact


def test_near_copies_of_whole_blocks_take_bounded_memory(spark):
    import tracemalloc
    rng = np.random.default_rng(8)
    x = (rng.standard_normal(16) + 0.01 * rng.standard_normal((4000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], SCHEMA)
    a, b = metric_join._Block.__new__(metric_join._Block), metric_join._Block.__new__(metric_join._Block)
    for k, (block, part) in enumerate(((a, x[:2000]), (b, x[2000:]))):
        block.cell, block.dim, block.x, block.ids = k, 16, part, np.arange(2000) + 2000 * k
        block.copies, block.bits = np.ones(2000, np.int64), np.full((2000, 1), 255, np.uint8)
        block.unit = metric_join.V.scaled(part.astype(np.float64)).astype(np.float32)
    tracemalloc.start()
    ids, links, heads = metric_join._join_blocks(a, b, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (ids == np.arange(4000)).all() and (links == 2000).all() and (heads == 0).all()
    assert peak < 48 << 20  # of 4,000,000 links
    out = metric_join.near_links(df, 0.9).selectExpr("min(n_links)", "max(n_links)", "max(component_id)", "count(*)")
    assert tuple(out.first()) == (3999, 3999, 0, 4000)


def test_no_usable_vector_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 0), (2, [0.0], 0)], SCHEMA)
    assert [tuple(r) for r in metric_join.near_links(df, 0.9).orderBy("vec_id").collect()] == [
        (1, 0, 1, True), (2, 0, 2, True)]
    assert metric_join.near_links(df.limit(0), 0.9).count() == 0
    assert ann.nearest(df, F.col("id") >= 0, 5).count() == 0
    assert ann.nearest(df.limit(0), F.col("id") >= 0, 5).count() == 0


def test_search_recall_order_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "MIN_ROWS", 100)
    monkeypatch.setattr(ann, "MAX_QUERIES", 6)
    rows = vectors()
    good = usable(rows)
    out = defaultdict(list)
    df = spark.createDataFrame(rows, SCHEMA)
    for r in ann.nearest(df.unionByName(df.where("vec_id < 40")), F.col("id") % 50 == 0, 5).collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in [i for i in good if i % 50 == 0]:
        best = sorted(((-cosine(good[q], v), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:5]
        got = sorted(out[q])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        hits += len({i for _, i in best} & {g[1] for g in got})
        total += 5
        for _, i, s in got:
            assert abs(s - cosine(good[q], good[i])) < 1e-12
    assert hits / total >= 0.95
    # 100..179 are one vector: equal scores, smaller ids first
    assert [g[1] for g in sorted(out[100])][:4] in ([20, 101, 102, 103], [101, 102, 103, 104])
    assert 14 not in out


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)], SCHEMA)
    got = ann.nearest(df, F.col("id") == 0, 5).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 2), (2, 1)]


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((400, 64)), rng.standard_normal((50, 64))
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    codes, factor = ann.encode(x, turn)
    est, error = ann.estimates(codes, factor, ann.V.scaled(q) @ turn, 3.0)
    true = ann.V.scaled(q) @ ann.V.scaled(x).T
    assert (np.abs(est - true) <= error[None, :]).mean() > 0.99
    assert abs((est - true).mean()) < 0.01


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(0, 64)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 299), (299, 300)]
    out = {r.node: r.component for r in components.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(65)) and all(out[200 + i] == 100 for i in range(50))
    assert out[300] == out[299] == 299 and len(out) == 65 + 51 + 2
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
