"""Structured Streaming: queue -> landing table (+ quarantine) -> scored rows.

The reference's consumer polls a queue, buffers 50 messages or 30 seconds,
groups them by (source, product) and writes one file per group, committing
offsets on a timer.  Here:

* ``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger`` bound a micro-batch;
* ``start_land`` reads the queue once and writes each micro-batch's records and
  its undecodable messages into folders of the batch's number, overwritten on a replay;
* ``flush.start_flush`` keeps the reference's rule - groups of at most 50
  records, the rest after 30 seconds or at the end - as keyed state;
* the cleaning/scoring operators are stateless, so the same functions that
  run in batch run on the stream; ``topn.start_topn`` goes on to the best rows
  of every product.

A Kafka source needs the Kafka connector jar on the classpath (not present
in this environment); ``kafka_source`` shows the options and the tests use
the file source with a ``value`` column.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import product_slug
from ..operators import scoring
from ..schemas import RAW_WITH_ID_SCHEMA
from ..sources import queue as Q

# --- fixed values -----------------------------------------------------------
BATCH_RECORDS = 50          # messages per micro-batch
FLUSH_INTERVAL = "30 seconds"
TOPIC = "raw_social_data"
# ---------------------------------------------------------------------------


def kafka_source(spark: SparkSession, servers: str, topic: str = TOPIC,
                 max_offsets: int = BATCH_RECORDS) -> DataFrame:
    """Queue source (requires the Kafka connector on the classpath)."""
    return (spark.readStream.format("kafka")
                 .option("kafka.bootstrap.servers", servers)
                 .option("subscribe", topic)
                 .option("startingOffsets", "earliest")
                 .option("maxOffsetsPerTrigger", max_offsets)
                 .load()
                 .select(F.col("key").cast("string"), F.col("value").cast("string")))


def file_queue_source(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Queue stand-in: text files, one message JSON per line (``value``)."""
    return (spark.readStream.format("text")
                 .option("maxFilesPerTrigger", files_per_batch)
                 .load(path))


def stage_messages(messages: DataFrame, path: str, n_files: int | None = None) -> None:
    """Write queue messages as text files for the file source, as many as the
    messages have partitions, or ``n_files``."""
    messages = messages.select("value")
    (messages.repartition(n_files) if n_files else messages).write.mode("append").text(path)


def _trigger(writer, available_now: bool):
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=FLUSH_INTERVAL)


def start_land(messages: DataFrame, landing_dir: str, quarantine_dir: str, checkpoint_dir: str,
               available_now: bool = True) -> StreamingQuery:
    """One read of the queue, two outputs: decoded records and messages that cannot be decoded.

    Each micro-batch is decoded once and kept while both outputs are written,
    into folders that carry its number: ``source=/product_slug=/batch=`` of the
    landing table and ``batch=`` of the quarantine (raw text kept).  A batch that is
    replayed after a failure overwrites its own folders, so no row comes
    twice.  Writers are dealt by folder, and AQE splits a hot folder over
    several of them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = Q.decode(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            number = F.lit(batch_id).cast("long").alias("batch")
            good = Q.good_records(decoded).withColumn("product_slug", product_slug("product")).select("*", number)
            (good.hint("rebalance", "source", "product_slug").write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy("source", "product_slug", "batch")
                 .json(landing_dir))
            (Q.quarantine(decoded).select("*", number).write.mode("overwrite")
              .option("partitionOverwriteMode", "dynamic").partitionBy("batch").json(quarantine_dir))
        finally:
            decoded.unpersist()

    w = messages.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(write)
    return _trigger(w, available_now).start()


def dedup_stream(records: DataFrame, delay: str, key: str = "id", time_col: str = "scraped_at") -> DataFrame:
    """The first of all copies of a record that come within ``delay`` of each other (by ``time_col``).

    A post that several searches find is sent once for each of them.  Spark
    keeps one key per record until the watermark - the newest time seen less
    ``delay`` - has passed it by ``delay``; older state goes, so it is bounded by the
    records of that span.  Records that come later than ``delay`` behind the
    newest are dropped as late.
    """
    at = "__tm_scraped"
    return (records.withColumn(at, F.to_timestamp(F.col(time_col)))
                   .withWatermark(at, delay).dropDuplicatesWithinWatermark([key]).drop(at))


def start_dedup(records: DataFrame, out_dir: str, checkpoint_dir: str, delay: str,
                available_now: bool = True) -> StreamingQuery:
    w = (dedup_stream(records, delay).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint_dir))
    return _trigger(w, available_now).start(out_dir)


def landing_stream(spark: SparkSession, landing_dir: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of landed records (explicit schema, partition columns included)."""
    schema = StructType(RAW_WITH_ID_SCHEMA.fields + [StructField("product_slug", StringType()),
                                                     StructField("batch", LongType())])
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
                 .json(landing_dir).drop("batch"))


def start_clean(landed: DataFrame, out_dir: str, checkpoint_dir: str,
                available_now: bool = True) -> StreamingQuery:
    """Incremental clean + extract + score of landed records (stateless)."""
    scored = scoring.process(landed).select(
        "id", "product", "product_slug", "data_type", "content_cleaned", "extracted_questions",
        "relevance_score", "content_length", "has_question", "url", "score")
    w = (scored.writeStream.format("parquet").outputMode("append")
               .option("checkpointLocation", checkpoint_dir))
    return _trigger(w, available_now).start(out_dir)


def run_to_end(*queries: StreamingQuery) -> None:
    """Wait for available-now queries; surface a failure instead of hanging."""
    for q in queries:
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
