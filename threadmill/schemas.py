"""Explicit schemas for every table the engine reads or writes.

The reference declares a raw schema but lets the JSON reader infer one; we
always pass schemas so reads never scan twice and types never drift.
"""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

S = StringType()

RAW_SCHEMA = StructType([
    StructField("source", S),
    StructField("product", S),
    StructField("data_type", S),
    StructField("content", S),
    StructField("title", S),
    StructField("author", S),
    StructField("score", IntegerType()),
    StructField("url", S),
    StructField("subreddit", S),
    StructField("created_at", S),
    StructField("scraped_at", S),
    StructField("metadata", MapType(S, S)),
])

# raw record plus a stable record id (the adapters carry one for tie-breaks)
RAW_WITH_ID_SCHEMA = StructType([StructField("id", LongType())] + RAW_SCHEMA.fields)

POST_SCHEMA = StructType([
    StructField("id", S),
    StructField("title", S),
    StructField("selftext", S),
    StructField("author", S),
    StructField("subreddit", S),
    StructField("score", IntegerType()),
    StructField("num_comments", IntegerType()),
    StructField("created_utc", DoubleType()),
    StructField("url", S),
    StructField("permalink", S),
])

POST_LISTING_SCHEMA = StructType([
    StructField("data", StructType([
        StructField("children", ArrayType(StructType([
            StructField("kind", S),
            StructField("data", POST_SCHEMA),
        ]))),
    ])),
])

COMMENT_SCHEMA = StructType([
    StructField("id", S),
    StructField("body", S),
    StructField("author", S),
    StructField("score", IntegerType()),
    StructField("created_utc", DoubleType()),
    StructField("parent_id", S),
])

COMMENT_LISTING_SCHEMA = StructType([
    StructField("data", StructType([
        StructField("children", ArrayType(StructType([
            StructField("kind", S),
            StructField("data", COMMENT_SCHEMA),
        ]))),
    ])),
])

FAQ_READY_SCHEMA = StructType([
    StructField("id", LongType()),
    StructField("product", S),
    StructField("content", S),
    StructField("extracted_questions", ArrayType(S)),
    StructField("relevance_score", LongType()),
    StructField("data_type", S),
    StructField("source_url", S),
    StructField("engagement_score", IntegerType()),
])

# A model answer entry. confidence is read as text and cast afterwards: a
# quoted number would otherwise read as NULL under a double field.
FAQ_ENTRY_JSON_SCHEMA = ArrayType(StructType([
    StructField("question", S),
    StructField("answer", S),
    StructField("category", S),
    StructField("confidence", S),
    StructField("keywords", ArrayType(S)),
]))

FAQ_ENTRY_SCHEMA = StructType([
    StructField("question", S),
    StructField("answer", S),
    StructField("category", S),
    StructField("confidence", DoubleType()),
    StructField("sources", ArrayType(S)),
    StructField("keywords", ArrayType(S)),
])

FAQ_DOCUMENT_SCHEMA = StructType([
    StructField("product", S),
    StructField("faqs", ArrayType(FAQ_ENTRY_SCHEMA)),
    StructField("generated_at", TimestampType()),
    StructField("model_used", S),
    StructField("source_count", LongType()),
    StructField("updated_at", TimestampType()),
])

PRODUCT_SCHEMA = StructType([
    StructField("id", LongType()),
    StructField("name", S),
    StructField("description", S),
    StructField("subreddits", ArrayType(S)),
    StructField("keywords", ArrayType(S)),
    StructField("category", S),
    StructField("created_at", TimestampType()),
    StructField("last_scraped", TimestampType()),
    StructField("last_processed", TimestampType()),
    StructField("faq_count", IntegerType()),
    StructField("status", S),
])
