"""Groups of queue records flushed by count or by time, as keyed state.

Records of one (source, product) are held back until there are 50 of them,
or until 30 seconds have passed since the oldest one came; each flush is one
JSON-array file, in a folder named by its number.  What a stopped query still holds is
in its checkpoint: ``flush_rest`` writes it under the number that the group is
going to have, so a query that is started again and fills the group
overwrites the folder, and nothing comes twice.

A hot product can be dealt over several lanes, each with groups of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import product_slug
from .landing import BATCH_RECORDS

# --- fixed values -----------------------------------------------------------
FLUSH_MS = 30_000           # oldest record's wait before an incomplete group is flushed
# ---------------------------------------------------------------------------
LANES = 16                  # a product's records are dealt over so many groups
KEYS = ["source", "product", "lane"]
OUT = ("source string, product string, lane int, flush long, reason string, records array<string>")
STATE = "records array<string>, flush long, since long"


def flushes(records: DataFrame, size: int = BATCH_RECORDS, wait_ms: int | None = FLUSH_MS,
            lanes: int = LANES) -> DataFrame:
    """(source, product, lane, flush, reason, records): the groups of a stream of decoded records.

    Without ``wait_ms`` there is no timer, and an incomplete group waits for more records or for ``flush_rest``.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number, since = state.get if state.exists else ([], 0, 0)
        held, out = list(held), []

        def flush(n: int, reason: str) -> None:
            nonlocal held, number
            out.append((*key, number, reason, held[:n]))
            held, number = held[n:], number + 1

        if state.hasTimedOut:
            flush(len(held), "time")
        else:
            if not held:
                since = state.getCurrentProcessingTimeMs()
            for f in frames:
                held += f["value"].tolist()
                while len(held) >= size:
                    flush(size, "size")
                    since = state.getCurrentProcessingTimeMs()
        state.update((held, number, since))
        if held and wait_ms is not None:
            state.setTimeoutDuration(max(1, since + wait_ms - state.getCurrentProcessingTimeMs()))
        yield pd.DataFrame(out, columns=["source", "product", "lane", "flush", "reason", "records"])

    value = F.to_json(F.struct(*[F.col(c) for c in records.columns]))
    lane = F.pmod(F.xxhash64("value"), F.lit(lanes)).cast("int")
    rows = records.withColumn("value", value).select("source", "product", lane.alias("lane"), "value")
    timer = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy(*KEYS).applyInPandasWithState(run, OUT, STATE, "append", timer)


def write_groups(groups: DataFrame, root: str) -> None:
    """One JSON-array file per group, in ``source=/product_slug=/flush=``; a group written again replaces itself."""
    name = F.format_string("l%04d-%012d", "lane", "flush")
    (groups.where(F.size("records") > 0)
     .select("source", product_slug("product").alias("product_slug"), name.alias("flush"),
             F.concat(F.lit("["), F.array_join("records", ","), F.lit("]")).alias("value"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("source", "product_slug", "flush").text(root))


def start_flush(records: DataFrame, root: str, checkpoint_dir: str, size: int = BATCH_RECORDS,
                wait_ms: int = FLUSH_MS, lanes: int = LANES, available_now: bool = True,
                every: str = "1 second") -> StreamingQuery:
    """Write the groups of decoded records as files.

    A query that runs to the end of what there is has nothing to wait for: it
    flushes by count, and ``flush_rest`` the rest.  A continuous one looks for
    groups that have waited long enough ``every`` so often, new records or not.
    """
    groups = flushes(records, size, None if available_now else wait_ms, lanes)
    w = (groups.writeStream.outputMode("append").option("checkpointLocation", checkpoint_dir)
         .foreachBatch(lambda batch, _: write_groups(batch, root)))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()


def rest(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    """The groups that a stopped query still holds, read from its state."""
    state = spark.read.format("statestore").load(checkpoint_dir)
    held = F.col("value.groupState")
    return state.select("key.source", "key.product", "key.lane", held["flush"].alias("flush"),
                        F.lit("stop").alias("reason"), held["records"].alias("records")).where(F.size("records") > 0)


def flush_rest(spark: SparkSession, root: str, checkpoint_dir: str) -> None:
    """Write what a stopped query still holds (see the module's text for a restart)."""
    write_groups(rest(spark, checkpoint_dir), root)
