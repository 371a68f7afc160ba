"""Clean -> extract questions -> score -> model-ready rows (the batch job).

The reference runs this once per product and collects counts with eight
separate actions; here one lazy plan covers all products, the ranking is a
window per product, and counts come from a single aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .rank import top_n, top_n_per_group

# --- fixed values -----------------------------------------------------------
# Rows kept per product for generation, and the relevance weight of a post.
FAQ_READY_CAP = 500
POST_WEIGHT = 2
# ---------------------------------------------------------------------------

FAQ_READY_COLUMNS = ["id", "product", "content", "extracted_questions", "relevance_score",
                     "data_type", "source_url", "engagement_score"]


def clean(df: DataFrame, content_col: str = "content") -> DataFrame:
    """Add ``content_cleaned`` and drop rows whose cleaned text is too short.

    The cleaned text is produced by exploding a one-element array: the
    length filter then sits above the generator and cannot be pushed below
    it, so the regex chain runs once per row instead of once in the filter
    and again in the projection.
    """
    cols = [F.col(c) for c in df.columns]
    return (df.select(*cols, F.explode(F.array(T.clean_text(content_col)))
                      .alias("content_cleaned"))
              .where(T.keep_cleaned("content_cleaned")))


def with_questions(df: DataFrame, word_boundary: bool = False) -> DataFrame:
    return df.withColumn("extracted_questions",
                         T.extract_questions("content_cleaned", word_boundary))


def relevance(score_col="score", type_col="data_type"):
    """(score + 1) * 2 for posts, * 1 otherwise; NULL score gives NULL."""
    weight = F.when(F.col(type_col) == "post", F.lit(POST_WEIGHT)).otherwise(F.lit(1))
    return ((F.col(score_col).cast("long") + 1) * weight).cast("long")


def with_metrics(df: DataFrame) -> DataFrame:
    return (df.withColumn("relevance_score", relevance())
              .withColumn("content_length", F.length("content_cleaned"))
              .withColumn("has_question", F.size("extracted_questions") > 0))


def process(raw: DataFrame, word_boundary: bool = False) -> DataFrame:
    """Raw records (with ``id``) -> cleaned, questioned and scored rows.

    Stateless, so it also runs on a streaming DataFrame.
    """
    return with_metrics(with_questions(clean(raw), word_boundary))


def model_ready(scored: DataFrame) -> DataFrame:
    """Projection + the keep predicate, before any ranking."""
    return (scored
            .select("id", "product",
                    F.col("content_cleaned").alias("content"),
                    "extracted_questions", "relevance_score", "data_type",
                    F.col("url").alias("source_url"),
                    F.col("score").alias("engagement_score"))
            .where((F.col("relevance_score") > 1) | (F.size("extracted_questions") > 0)))


def rank_order():
    """Relevance descending (NULL last), ties by record id."""
    return [F.col("relevance_score").desc_nulls_last(), F.col("id").asc()]


def faq_ready(scored: DataFrame, cap: int = FAQ_READY_CAP, tasks: int | None = None,
              rank_col: str | None = None, word_boundary: bool = False) -> DataFrame:
    """Top ``cap`` model-ready rows of every product (ties broken by id).

    The question list is not carried through the ranking: rows are filtered
    (questions are looked for only where the relevance alone does not decide),
    ranked, and the survivors' questions extracted again from their text.
    """
    kept = model_ready(scored).drop("extracted_questions")
    best = top_n_per_group(kept, ["product"], rank_order(), cap, rank_col=rank_col, tasks=tasks)
    return (best.withColumn("extracted_questions", T.extract_questions("content", word_boundary))
                .select(*FAQ_READY_COLUMNS, *([rank_col] if rank_col else [])))


def faq_ready_single(scored: DataFrame, product: str, cap: int = FAQ_READY_CAP) -> DataFrame:
    """One product's rows: the product first, then its ordered top ``cap``."""
    return top_n(model_ready(scored.where(F.col("product") == product)), rank_order(), cap)


def run_summary(raw: DataFrame, cap: int = FAQ_READY_CAP) -> DataFrame:
    """Per product: total, cleaned, with-question and model-ready row counts.

    The cleaned text is computed once per row (one-element explode), the
    flags are plain booleans, and one aggregation with map-side partial
    combine counts them; the model-ready count is ``least(cap, ready rows)``
    so no per-product sort is needed.
    """
    rows = raw.select("product", "score", "data_type",
                      F.explode(F.array(T.clean_text("content"))).alias("cc"))
    flags = rows.select(
        "product",
        T.keep_cleaned("cc").alias("kept"),
        (F.size(T.extract_questions("cc")) > 0).alias("has_q"),
        (relevance() > 1).alias("rel_ok"))
    kept = F.coalesce(F.col("kept"), F.lit(False))
    return (flags.groupBy("product")
                 .agg(F.count(F.lit(1)).alias("total_records"),
                      F.count_if(kept).alias("cleaned_records"),
                      F.count_if(kept & F.col("has_q")).alias("question_records"),
                      F.least(F.count_if(kept & (F.col("rel_ok") | F.col("has_q"))),
                              F.lit(cap).cast("long")).alias("processed_records")))
