import random

import numpy as np
from texts import SCHEMA, WORDS, docs, empty

from threadmill.llm import quality


def labelled(spark, n=400):
    rng = random.Random(5)
    data, marks = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ing", ","]) for _ in range(rng.randrange(20, 90))]
        text = " ".join(words) if good else "!! ".join(w.upper() for w in words)
        data.append((i, text, *[None] * 10))
        marks.append((i, int(good)))
    return spark.createDataFrame(data, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int")


def test_held_out_accuracy_and_calibration(spark):
    df, labels = labelled(spark)
    model = quality.train(df, labels.where("doc_id % 5 != 0"))
    out = quality.score(df, model).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    assert dict(quality.score(df, model).dtypes)["score"] == "double"
    right = sum((r.score >= 0.3) == (r.quality == 1) for r in out)
    assert right / len(out) > 0.97
    assert abs(np.mean([r.score for r in out]) - np.mean([r.quality for r in out])) < 0.05


def test_odd_rows_and_repeats_score_alike(spark):
    df, labels = labelled(spark, 200)
    model = quality.train(df, labels)
    out = quality.score(docs(spark).unionByName(docs(spark)), model).collect()
    assert len(out) == 120 and all(0 <= r.score <= 1 for r in out)
    by_text = {}
    for r in out:
        assert by_text.setdefault(r.text or "", r.score) == r.score
    assert quality.score(empty(spark), model).count() == 0


def test_without_both_classes(spark):
    df, labels = labelled(spark, 60)
    none = quality.train(df, labels.where("quality = 9"))
    only = quality.train(df, labels.where("quality = 1"))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}
    assert {r.score for r in quality.score(df, only).collect()} == {1.0}
    assert quality.train(empty(spark), labels).weights == []


def test_contradicting_and_null_labels_are_not_used(spark):
    df, labels = labelled(spark, 90)
    noisy = labels.unionByName(labels.selectExpr("doc_id", "1 - quality as quality").where("doc_id < 10"))
    noisy = noisy.unionByName(labels.selectExpr("doc_id", "cast(null as int) as quality"))
    a, b = quality.train(df, noisy), quality.train(df, labels.where("doc_id >= 10"))
    assert a == b


def test_fit_is_bounded_and_deterministic(spark):
    df, labels = labelled(spark, 300)
    a = quality.train(df, labels, per_class=20)
    assert a == quality.train(df.repartition(7), labels.repartition(3), per_class=20) and a.weights


def test_scores_equal_a_plain_recomputation(spark):
    """Sizes, terms and the logistic curve, text by text, from the fitted model's numbers."""
    import math

    import zstandard
    df, labels = labelled(spark)
    model = quality.train(df, labels.where("doc_id % 5 != 0"))
    plain = {}
    for r in df.collect():
        data = r.text.encode()
        sizes = []
        for d in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False,
                                         write_dict_id=False, write_checksum=False)
            sizes.append(len(c.compress(data)))
        g, b = sizes
        n = len(data)
        diff, share, length = (b - g) / n, math.log(g / n), math.log(n)
        x = [diff, diff * share, diff * length, diff ** 2, b / n, share, length, share ** 2, share * length, length ** 2]
        m = model.weights[0] + sum(w * (v - a) / s for w, v, a, s in zip(model.weights[1:], x, model.mean, model.scale))
        plain[r.doc_id] = 1 / (1 + math.exp(-max(-35, min(35, m))))
    for r in quality.score(df, model).collect():
        assert abs(r.score - plain[r.doc_id]) < 1e-6


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    df, labels = labelled(spark, 90)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 2000)
    taken = []
    monkeypatch.setattr(quality, "fit", lambda good, bad, share: taken.append((good, bad)))
    quality.train(df, labels)
    for texts in taken[0]:
        assert 0 < sum(len(t.encode()) for t in texts) <= 2000
