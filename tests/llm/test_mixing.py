import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from texts import docs, empty, rows

from threadmill.llm import mixing


def fill(children, budget):
    """children: name -> (capacity, weight); shares by repeated levelling."""
    open_, share = {k: v for k, v in children.items() if v[1] > 0}, {k: 0.0 for k in children}
    while open_:
        weight = sum(w for _, w in open_.values())
        full = {k: c for k, (c, w) in open_.items() if c <= budget / weight * w}
        if not full:
            return share | {k: budget / weight * w for k, (c, w) in open_.items()}
        for k, c in full.items():
            share[k] = c
            budget -= c
            del open_[k]
    return share


def brute(data, weights, budget_share, max_epochs, seed):
    leaves = defaultdict(list)
    for r in data:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        leaves["crawl" if r[3] == "src0" else "curated", r[2] or "unknown", r[3] or "unknown"].append((r[0], n))
    cap = {k: sum(n for _, n in v) * max_epochs for k, v in leaves.items()}

    def level(prefix, budget, out):
        if len(prefix) == 3:
            out[prefix] = budget
            return
        kids = defaultdict(float)
        for k, c in cap.items():
            if k[:len(prefix)] == prefix:
                kids[k[:len(prefix) + 1]] += c
        weight = lambda k: next((w for p, w in weights.items() if len(p) == len(k)
                                 and all(a in ("*", b) for a, b in zip(p, k))), 1.0)
        for k, b in fill({k: (c, weight(k)) for k, c in kids.items()}, budget).items():
            level(k, b, out)

    shares = {}
    level((), float(int(sum(cap.values()) / max_epochs * budget_share)), shares)
    chosen = []
    for leaf, found in leaves.items():
        supply, left = sum(n for _, n in found), int(shares[leaf] + 1e-6)
        if not supply:
            continue
        whole, left = divmod(left, supply)
        chosen += [(d, e) for d, _ in found for e in range(1, whole + 1)]
        by_hash = defaultdict(list)
        for d, n in found:
            by_hash[hashlib.md5(f"{seed}:{whole + 1}:{'null' if d is None else d}".encode()).hexdigest()].append((d, n))
        used = 0
        for h in sorted(by_hash):
            used += sum(n for _, n in by_hash[h])
            if not left or used > left:
                break
            chosen += [(d, whole + 1) for d, _ in by_hash[h]]
    return sorted(chosen, key=str)


def domain():
    return F.when(F.col("source") == "src0", "crawl").otherwise("curated")


@pytest.mark.parametrize("share,epochs,weights", [
    (1.0, 2, {("crawl",): 1.0, ("curated",): 3.0, ("*", "en"): 2.0}), (0.3, 1, {}),
    (5.0, 2, {}), (0.8, 3, {("crawl",): 0.0, ("curated", "de"): 9.0}), (0.5, 1, {("*", "*", "src1"): 4.0})])
def test_matches_brute_force(spark, share, epochs, weights):
    data = rows() + [(None, "no id at all", "en", "src1", *"shpetc"[:6])] + rows()[20:25]
    out = mixing.mix(docs(spark, data), domain(), weights, share, epochs, seed=5).collect()
    assert sorted([(r.doc_id, r.epoch) for r in out], key=str) == brute(data, weights, share, epochs, 5)


def test_shortage_goes_to_siblings_before_ancestors(spark):
    text = lambda n: " ".join(["w"] * n)
    data = [(i, text(10), "en", s) for i, s in enumerate(["a"] + ["b"] * 40)] + \
           [(100 + i, text(10), "de", "c") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    plan = {r[mixing.SOURCE]: r["share"] for r in mixing.plan(df, F.lit("d"), {}, 0.5, 1, 1).collect()}
    # en and de get 202 each; a holds 10, so b gets all the rest of en's share
    assert plan == {"a": 10, "b": 192, "c": 202}


def test_empty_table_and_columns_kept(spark):
    assert mixing.mix(empty(spark), domain(), {}).count() == 0
    out = mixing.mix(docs(spark), domain(), {}, 5.0, 1)
    assert {"score", "shard", "component_id"} <= set(out.columns) and dict(out.dtypes)["epoch"] == "int"
    assert out.count() == sum(1 for r in rows() if (r[1] or "").strip()) + sum(
        1 for r in rows() if not (r[1] or "").strip())
