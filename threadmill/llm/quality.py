"""Quality classifier by compression against zstandard dictionaries of good and bad text.

One dictionary is trained on labelled good texts, one on labelled bad texts.
A text is compressed with either; its main feature is the difference of the
two compressed sizes over its own size: text that the good dictionary
explains better compresses smaller with it.  A logistic curve maps the
difference to a probability.  As one difference means different things for a
short text than for a long one, and for a text that repeats itself than for
one that does not, the curve's terms include the compressed share and the
length (and the products of these), fitted by ridge regression on labelled
texts that no dictionary was made of; its intercept is corrected to the share
of good rows among all training labels.

Fitting uses a bounded sample on the driver: at most ``per_class`` whole texts
of each class, those with the smallest hashes of their id, none above
``max_text_bytes``, and of these the first that make SAMPLE_BYTES.  Scoring is one pass over all rows without a shuffle.

Defined results: a null or empty text is scored as the empty text; labels that
are null, or that contradict each other for one id, are not used; repeated
rows get equal scores; without labels of both classes every score is the share
of good labels (0.5 without any); an empty table gives no rows.  Texts are
always compressed whole.  All input columns are kept; one named like the
output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import forget, trim

DICT_BYTES = 112_640
LEVEL = 3
PER_CLASS = 3000
MAX_TEXT_BYTES = 65_536
#: Bytes of text of each class that reach the driver.
SAMPLE_BYTES = 48 << 20
#: Texts of a class from which dictionaries are trained; below, they are the texts themselves.
MIN_TRAINED = 50


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    weights: list = field(default_factory=list)
    mean: list = field(default_factory=list)
    scale: list = field(default_factory=list)
    share: float = 0.5


def compressors(model: Model):
    import zstandard
    out = []
    for data in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                            write_dict_id=False, write_checksum=False))
    return out


def sizes(texts, pair) -> np.ndarray:
    """Per text: size with the good dictionary, with the bad one, own size."""
    good, bad = pair
    rows = [(len(good.compress(b)), len(bad.compress(b)), max(1, len(b)))
            for b in ((t or "").encode("utf-8", "replace") for t in texts)]
    return np.array(rows, float).reshape(-1, 3)


def terms(size: np.ndarray) -> np.ndarray:
    """The normalised difference, and the terms that say how much it means."""
    g, b, n = size.T
    diff, share, length = (b - g) / n, np.log(g / n), np.log(n)
    return np.c_[diff, diff * share, diff * length, diff * diff, b / n, share, length,
                 share * share, share * length, length * length]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 100):
    """Ridge logistic regression by damped Newton steps; (weights with intercept first, mean, scale)."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    keep = np.full(z.shape[1], ridge)
    keep[0] = 1e-6

    def loss(w):
        m = z @ w
        return np.logaddexp(0, np.where(y > 0, -m, m)).sum() + (keep * w * w).sum() / 2

    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        slope = z.T @ (p - y) + keep * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep) + 1e-9 * np.eye(len(w)), slope)
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w, mean, scale


def dictionary(texts: list[str], trained: bool) -> bytes:
    import zstandard
    samples = [t.encode("utf-8", "replace") for t in texts if t]
    if trained:
        try:
            return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    # too little to train on: the texts themselves are the dictionary
    return (b"\n".join(samples))[-DICT_BYTES:] or b"\n"


def fit(good: list[str], bad: list[str], share: float) -> Model:
    """A model from sample texts of both classes; ``share`` of good rows among all labels."""
    if not good or not bad:
        return Model(share=share)
    half = [(len(c) + 1) // 2 for c in (good, bad)]
    # both dictionaries are of one kind, else the difference tells the kinds apart
    trained = min(half) >= MIN_TRAINED
    model = Model(dictionary(good[:half[0]], trained), dictionary(bad[:half[1]], trained), share=share)
    rest = [c[h:] or c for c, h in zip((good, bad), half)]
    pair = compressors(model)
    x = terms(np.concatenate([sizes(c, pair) for c in rest]))
    y = np.repeat([1.0, 0.0], [len(c) for c in rest])
    w, mean, scale = fit_logistic(x, y)
    clipped = min(max(share, 1e-3), 1 - 1e-3)
    w[0] += np.log(clipped / (1 - clipped)) - np.log(len(rest[0]) / len(rest[1]))
    model.weights, model.mean, model.scale = w.tolist(), mean.tolist(), scale.tolist()
    return model


def score_texts(texts, model: Model, pair) -> np.ndarray:
    if not model.weights:
        return np.full(len(texts), model.share)
    x = (terms(sizes(texts, pair)) - np.array(model.mean)) / np.array(model.scale)
    return 1 / (1 + np.exp(-np.clip(np.c_[np.ones(len(x)), x] @ np.array(model.weights), -35, 35)))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", key_col: str = "doc_id",
          text_col: str = "text", per_class: int = PER_CLASS, max_text_bytes: int = MAX_TEXT_BYTES) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs``."""
    agreed = (labels.where(F.col(label_col).isin(0, 1) & F.col(key_col).isNotNull())
              .groupBy(F.col(key_col).alias("__key"))
              .agg(F.min(label_col).alias("__y"), F.max(label_col).alias("__max"))
              .where("__y = __max").select("__key", "__y"))
    counts = {r["__y"]: r["n"] for r in agreed.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return Model()
    order = F.xxhash64(F.col("__key").cast("string"))
    chosen = [r["__key"] for y in (0, 1) for r in
              agreed.where(F.col("__y") == y).orderBy(order, "__key").limit(per_class).collect()]
    spark = docs.sparkSession
    ids = spark.createDataFrame([(k,) for k in chosen], agreed.select("__key").schema)
    sample = (docs.select(F.col(key_col).alias("__key"), F.col(text_col).alias("__text"))
              .where(F.octet_length("__text") <= max_text_bytes)
              .join(F.broadcast(ids), "__key"))  # at most 2 * per_class ids
    # lengths first, then the texts of the first SAMPLE_BYTES of each class
    y_of = {r["__key"]: r["__y"] for r in agreed.join(F.broadcast(ids), "__key").collect()}
    size_of = {r["__key"]: r["n"] for r in sample.groupBy("__key").agg(F.sum(F.octet_length("__text")).alias("n")).collect()}
    held, within = {0: 0, 1: 0}, []
    for k in chosen:
        held[y_of[k]] += size_of.get(k, 0)
        if k in size_of and held[y_of[k]] <= SAMPLE_BYTES:
            within.append(k)
    sample = sample.join(F.broadcast(spark.createDataFrame([(k,) for k in within], ids.schema)), "__key", "left_semi")
    texts: dict = {}
    for r in sample.collect():
        texts[r["__key"]] = min(r["__text"], texts.get(r["__key"], r["__text"]))
    found = {0: [], 1: []}
    for k in chosen:
        if k in texts:
            found[y_of[k]].append(texts[k])
    return fit(found[1], found[0], counts.get(1, 0) / total)


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the probability that a row's text is good."""

    @F.pandas_udf("double")
    def good(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        pair = compressors(model) if model.weights else None
        for texts in batches:
            yield pd.Series(score_texts(texts.tolist(), model, pair))
        del pair
        trim()

    return df.withColumn(score_col, good(F.col(text_col)))
