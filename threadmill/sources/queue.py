"""Queue messages: records <-> (key, value JSON) with a quarantine for bad ones.

Encoding is ``to_json(struct(...))`` keyed by product (what a Kafka sink
expects).  Decoding is ``from_json`` in PERMISSIVE mode with a corrupt-record
column, so an undecodable message never stops the job: it is split off into
the quarantine output instead.  The same functions run on a streaming
DataFrame read from Kafka (``value`` cast to string) or from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..schemas import RAW_WITH_ID_SCHEMA

CORRUPT = "_corrupt_record"
UNKNOWN = "unknown"


def encode(records: DataFrame, key_col: str = "product") -> DataFrame:
    """(key, value) messages; the value holds every record column as JSON."""
    return records.select(F.col(key_col).alias("key"),
                          F.to_json(F.struct(*[F.col(c) for c in records.columns])).alias("value"))


def decode(messages: DataFrame, schema: StructType = RAW_WITH_ID_SCHEMA,
           value_col: str = "value") -> DataFrame:
    """Add the parsed record struct ``r`` and the raw text of bad messages."""
    with_corrupt = StructType(schema.fields + [StructField(CORRUPT, StringType())])
    parsed = F.from_json(F.col(value_col).cast("string"), with_corrupt,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return messages.withColumn("r", parsed)


def _is_bad() -> F.Column:
    return F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()


def good_records(decoded: DataFrame, schema: StructType = RAW_WITH_ID_SCHEMA) -> DataFrame:
    """Decoded records; missing source/product become ``unknown``."""
    cols = []
    for f in schema.fields:
        c = F.col(f"r.{f.name}")
        if f.name in ("source", "product"):
            c = F.coalesce(c, F.lit(UNKNOWN))
        cols.append(c.alias(f.name))
    return decoded.where(~_is_bad()).select(*cols)


def quarantine(decoded: DataFrame, value_col: str = "value") -> DataFrame:
    """Messages that could not be decoded, with their raw text."""
    return decoded.where(_is_bad()).select(F.col(value_col).cast("string").alias("value"))


def landing_groups(records: DataFrame) -> DataFrame:
    """Record count per (source, product) landing group."""
    return (records.groupBy(F.coalesce("source", F.lit(UNKNOWN)).alias("source"),
                            F.coalesce("product", F.lit(UNKNOWN)).alias("product"))
                   .agg(F.count(F.lit(1)).alias("n_records")))


def write_queue(messages: DataFrame, servers: str, topic: str = "raw_social_data") -> None:
    """Queue sink: (key, value) rows to a Kafka topic (needs the connector jar)."""
    (messages.select(F.col("key").cast("string"), F.col("value").cast("string"))
             .write.format("kafka")
             .option("kafka.bootstrap.servers", servers)
             .option("topic", topic)
             .save())
