"""A training corpus from ``documents``: five stages, each an operator of ``threadmill.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared checkpoint folder and gives what it reads back to
the next stage.  All but the last stage return the columns of ``docs``.

1. quality classifier: documents scored below QUALITY_CUT go;
2. n-gram Jaccard join: of each component the document with the smallest id
   stays (documents without an id cannot be grouped and stay; of rows that
   share an id one stays);
3. PII: every span is replaced by its kind, ``n_chars`` follows the text;
4. mixing: the token budget MIX over the domain / language / source tree;
5. BPE: token ids, their number, and the text decoded from them.

SQL cannot express the compression classifier, the random field or the
encoder, so there is no oracle; the tests hold ``run`` against a brute-force
version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm import bpe, jaccard, mixing, pii, quality
from threadmill.llm.base import shared_path, stored, table
from threadmill.llm.queries import QUALITY_CUT, TOKENIZER, held_out, mix_domain
from threadmill.operators.joins import broadcast_if

#: Nine tenths of the tokens, each document at most once.
MIX = {"weights": {("crawl",): 1.0, ("curated",): 3.0, ("*", "en"): 2.0},
       "budget_share": 0.9, "max_epochs": 1, "seed": 7}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return quality.score(docs, model, score_col="__score").where(F.col("__score") >= QUALITY_CUT).drop("__score")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = stored(jaccard.near_duplicates(docs, 80, 5).where("doc_id is not null"))
    gone = stored(found.where("doc_id != component_id").select("doc_id").distinct())
    kept = docs.join(broadcast_if(gone, gone.count(), jaccard.MAX_BROADCAST_IDS), "doc_id", "left_anti")
    twice = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if twice:
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))
    return kept.select(*docs.columns)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mix_domain(), **MIX, epoch_col="__epoch").select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), TOKENIZER)
    return done.select("doc_id", "lang", "source", "token_ids",
                       F.size("token_ids").cast("bigint").alias("n_tokens"), "decoded")


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("PII", personal_data_stage),
    ("mixing sources", mixing_stage),
    ("BPE encoding", bpe_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        path = shared_path(spark, f"corpus-stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
