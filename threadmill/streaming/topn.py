"""The best rows of every product, kept up to date by a stream.

Each micro-batch's own top rows (a partial cut in every task) are merged with
the stored ones of the products they belong to.  Products are dealt into
buckets by a hash; a micro-batch reads and rewrites only the buckets it
touches, as ``bucket=/batch=`` folders of its own number.  What it merges with
is always the newest folder of a *smaller* number, so a replay finds the same
rows again and overwrites its own folders: the merge is idempotent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators import scoring
from ..operators.rank import top_n_per_group
from ..schemas import FAQ_READY_SCHEMA
from ..session import materialize
from .landing import _trigger

#: Folders that products are dealt into; a stored table keeps the number it was made with.
BUCKETS = 64
SCHEMA = StructType(FAQ_READY_SCHEMA.fields + [StructField("bucket", IntegerType()), StructField("batch", LongType())])


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("product"), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, root: str) -> dict[int, list[int]]:
    """The batch numbers stored for each bucket: at most ``buckets`` times the few that are kept."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/bucket=*/batch=*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    out: dict[int, list[int]] = {}
    for st in found or []:
        folder = st.getPath()
        out.setdefault(int(folder.getParent().getName().split("=")[1]), []).append(int(folder.getName().split("=")[1]))
    return out


def read_topn(spark: SparkSession, root: str, buckets: list[int] | None = None, below: int | None = None) -> DataFrame:
    """The stored rows: of each bucket (of ``buckets``) its newest folder, or the newest with a number below ``below``."""
    newest = {b: max(kept) for b, all_ in _folders(spark, root).items()
              if (buckets is None or b in buckets) and (kept := [n for n in all_ if below is None or n < below])}
    if not newest:
        return spark.createDataFrame([], SCHEMA).drop("bucket", "batch")
    paths = [f"{root.rstrip('/')}/bucket={b}/batch={n}" for b, n in sorted(newest.items())]
    return spark.read.schema(FAQ_READY_SCHEMA).parquet(*paths)


def merge_batch(batch: DataFrame, batch_id: int, root: str, cap: int = scoring.FAQ_READY_CAP,
                buckets: int = BUCKETS) -> None:
    """Merge model-ready rows into the stored best ``cap`` of their products."""
    spark = batch.sparkSession
    best = materialize(top_n_per_group(batch.select(*scoring.FAQ_READY_COLUMNS), ["product"], scoring.rank_order(), cap)
                       .withColumn("bucket", _bucket(buckets)))
    touched = [r["bucket"] for r in best.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    old = read_topn(spark, root, touched, batch_id).withColumn("bucket", _bucket(buckets))
    merged = top_n_per_group(old.unionByName(best), ["product"], scoring.rank_order(), cap)
    (merged.withColumn("batch", F.lit(batch_id).cast("long")).hint("rebalance", "bucket")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(root))
    _drop_older(spark, root, touched, batch_id)


def _drop_older(spark: SparkSession, root: str, touched: list[int], batch_id: int) -> None:
    """Remove the folders that neither a reader nor a replay of ``batch_id`` needs."""
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for b, all_ in _folders(spark, root).items():
        before = sorted(n for n in all_ if n < batch_id)
        if b in touched:
            for n in before[:-1]:
                path = path_of(f"{root.rstrip('/')}/bucket={b}/batch={n}")
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def start_topn(landed: DataFrame, root: str, checkpoint_dir: str, cap: int = scoring.FAQ_READY_CAP,
               buckets: int = BUCKETS, available_now: bool = True) -> StreamingQuery:
    """Landed records -> clean, extract, score -> the best ``cap`` rows of every product, batch by batch."""
    ready = scoring.model_ready(scoring.process(landed))
    w = ready.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(
        lambda batch, batch_id: merge_batch(batch, batch_id, root, cap, buckets))
    return _trigger(w, available_now).start()
