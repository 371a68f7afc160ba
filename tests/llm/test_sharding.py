import math
from collections import Counter

import xxhash
from texts import docs, empty

from threadmill.llm import sharding


def brute(key, weights):
    best = None
    for s, w in sorted(weights.items()):
        if w > 0:
            h = xxhash.xxh64(f"{key}|{s}".encode(), seed=42).intdigest()
            score = w / -math.log(((h >> 11) + 0.5) * 2 ** -53)
            if best is None or score > best[0]:
                best = (score, s)
    return best[1]


def test_matches_brute_force_with_weights(spark):
    weights = {0: 1.0, 1: 3.0, 2: 0.0, 5: 0.5}
    out = sharding.assign(spark.range(2000).selectExpr("id", "id as shard"), "id", weights).collect()
    assert all(r.shard == brute(f"k{r.id}", weights) for r in out)
    n = Counter(r.shard for r in out)
    assert 2 not in n and abs(n[1] / 2000 - 3 / 4.5) < 0.05


def test_one_more_shard_takes_rows_only_into_itself(spark):
    even = {s: 1.0 for s in range(16)}
    df = sharding.assign(spark.range(3000), "id", even)
    both = sharding.assign(df, "id", even | {16: 1.0}, "grown").collect()
    moved = [r for r in both if r.shard != r.grown]
    assert all(r.grown == 16 for r in moved) and 0 < len(moved) < 3000 * 2 / 17


def test_slots_are_gapless_with_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 7)
    df = docs(spark).unionByName(docs(spark)).selectExpr("nullif(doc_id, 3) as doc_id", "text", "shard")
    placed = sharding.with_slots(sharding.assign(df, "doc_id", {0: 1.0, 1: 1.0, 2: 1.0}), "doc_id",
                                 tie=("text",), n_shards=3).collect()
    assert len(placed) == 120
    for s in {r.shard for r in placed}:
        slots = sorted(r.slot for r in placed if r.shard == s)
        assert slots == list(range(len(slots)))
    homes = {}
    for r in placed:
        assert homes.setdefault(r.doc_id, r.shard) == r.shard


def test_empty_table(spark):
    out = sharding.with_slots(sharding.assign(empty(spark), "doc_id", {0: 1.0}), "doc_id", n_shards=1)
    assert out.count() == 0


def test_written_shards(spark, scratch):
    sharding.write_shards(sharding.assign(docs(spark), "doc_id", {0: 1.0, 1: 1.0}), scratch + "/shards")
    assert spark.read.parquet(scratch + "/shards").groupBy("shard").count().count() == 2
