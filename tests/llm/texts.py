"""Small tables with every awkward case, for all operators."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    # names that operators use for their own outputs
    T.StructField("score", T.StringType()), T.StructField("shard", T.StringType()),
    T.StructField("spans", T.StringType()), T.StructField("epoch", T.StringType()),
    T.StructField("token_ids", T.StringType()), T.StructField("component_id", T.StringType()),
    T.StructField("cut", T.StringType()), T.StructField("epochs", T.StringType())])

WORDS = "ada be cot dun egg fig gnu hat ink jam kit log map net oak pea que rug sun tin".split()


def rows(seed=3, n=60):
    """Documents with nulls, empty and very long texts, copies, near copies and few words."""
    rng = random.Random(seed)
    texts = [None, "", "  \t\n ", "one", "one two three", "ONE two three", "x" * 5000,
             " ".join(rng.choice(WORDS) for _ in range(20_000)),
             "mail jo@post.example.org or +1 (212) 555-0143, card 4539578763621486 from 10.0.0.255",
             "Ünïcode ΣΑΣ 日本語 don't <|endoftext|> ½"]
    base = [rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(120)]
    for _ in range(15):
        near = list(base)
        for _ in range(rng.randrange(4)):
            near[rng.randrange(len(near))] = "changed" + str(rng.randrange(9))
        texts.append(" ".join(near))
    while len(texts) < n - 8:
        texts.append(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))))
    texts += [texts[-1]] * 8
    return [(i, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", None]),
             "s", "h", "p", "e", "t", "c", "u", "v") for i, t in enumerate(texts)]


def docs(spark, data=None):
    wide = [(*r, *[None] * (len(SCHEMA) - len(r))) for r in (rows() if data is None else data)]
    return spark.createDataFrame(wide, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
