import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import docs, empty, rows

from threadmill.llm import lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data, order, least):
    texts = [(r[0], re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(LOWER))) for r in data]
    count = Counter()
    for _, w in texts:
        for n in range(1, order + 1):
            count.update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in texts)
    out = {}
    for i, w in texts:
        s = 0.0
        for p in range(len(w)):
            longest = min(order, p + 1)
            for n in range(longest, 0, -1):
                gram = tuple(w[p - n + 1:p + 1])
                if n == 1:
                    s += (longest - 1) * math.log(0.4) + math.log(count[gram] / total)
                elif count[gram] >= least:
                    s += (longest - n) * math.log(0.4) + math.log(count[gram] / count[gram[:-1]])
                    break
        old = out.get(i, (0, 0.0))
        out[i] = (old[0] + len(w), old[1] + s)
    return {i: v for i, v in out.items() if i is not None}


@pytest.mark.parametrize("order,least,frequent,flush", [(3, 2, 10 ** 6, 10 ** 6), (2, 1, 30, 300), (4, 3, 3, 2000)])
def test_matches_brute_force(spark, monkeypatch, order, least, frequent, flush):
    monkeypatch.setattr(lm, "MAX_FREQUENT", frequent)
    monkeypatch.setattr(lm._runs, "__defaults__", (flush,))
    data = rows() + [(None, "words without an id", *[None] * 8), (5, "one two three again", *[None] * 8)]
    out = {r.doc_id: r for r in lm.score(docs(spark, data), order, least).collect()}
    want = brute(data, order, least)
    assert out.keys() == want.keys()
    for i, (n, s) in want.items():
        assert out[i].n_words == n and abs(out[i].log_score - s) < 1e-6 * max(1, abs(s)), i
        assert (out[i].mean_log_score is None) == (n == 0)


def test_a_common_pair_is_summed_where_it_is_found(spark, monkeypatch):
    """A pair that makes a third of all pairs is not sent to the bucket of its hash, whatever the run."""
    monkeypatch.setattr(lm, "MAX_FREQUENT", 100)
    monkeypatch.setattr(lm._runs, "__defaults__", (500,))
    sent = []
    sums = lm._sums
    monkeypatch.setattr(lm, "_sums", lambda grams, gains, buckets: (sent.append(grams), sums(grams, gains, buckets))[1])
    data = [(i, " ".join(f"of the w{i % 7}x{j}" for j in range(40)), *[None] * 8) for i in range(60)]
    out = {r.doc_id: r for r in lm.score(docs(spark, data), 3, 2).collect()}
    for i, (n, s) in brute(data, 3, 2).items():
        assert out[i].n_words == n and abs(out[i].log_score - s) < 1e-6 * abs(s), i
    pair = int(lm.gram_hash([lm.W.word_hashes([w], {})[0] | lm.RARE for w in (b"of", b"the")])[0])
    asked = [lm.unpacked(r.data, "<u8", "<i8")[0] for g in sent for r in g.where("side = 0").collect()]
    assert sum(map(len, asked)) > 0 and all(pair not in keys for keys in asked)


def test_empty_table(spark):
    assert lm.score(empty(spark)).count() == 0


def test_texts_are_read_once(spark):
    """Words are counted and coded from the stored runs, not from the texts again."""
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    table = docs(spark, [(i, f"some words of text {i % 3}", *[None] * 8) for i in range(40)])
    once = F.udf(read, "string").asNondeterministic()
    assert lm.score(table.select("doc_id", once("text").alias("text"))).count() == 40
    assert seen.value == 40


@pytest.mark.parametrize("keys", [[], [7], [5, 4, 3, 3, 2 ** 63, 5], [(i * 7919) % 40 for i in range(500)],
                                  [(i % 3 << 60) + (i * 37) % 11 for i in range(500)]])
def test_sorted_order_is_the_stable_order(keys):
    """Also where keys differ only in the bits that give way to places while they are sorted."""
    keys = np.array(keys, np.uint64)
    order, out = lm.W.sorted_order(keys)
    assert order.tolist() == np.argsort(keys, kind="stable").tolist() and out.tolist() == sorted(keys.tolist())
    assert out[lm.W.firsts(out)].tolist() == sorted(set(keys.tolist()))
    assert sorted(lm.W.rough_order(keys).tolist()) == list(range(len(keys)))


def test_ngrams_stay_inside_documents():
    sizes = [0, 3, 1, 0, 2, 5, 0]
    doc, at = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([[0], np.cumsum(sizes)])
    for n in (2, 3, 4):
        assert lm._inside(at, n).tolist() == (doc[:len(doc) - n + 1] == doc[n - 1:]).tolist()
    assert not lm._inside(np.array([0, 1]), 3).size and not lm._inside(np.array([0]), 2).size
