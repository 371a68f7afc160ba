"""Per-group top-N, the workhorse behind every "best K per product" cut.

``row_number() <= n`` over a window is planned by Spark as a WindowGroupLimit:
a partial limit runs in every map task *before* the shuffle, so at most ``n``
rows per group per input partition cross the network.

For a hot group (one product holding a third of all rows) even that can put
``n * map_tasks`` rows into one reducer.  So where the input has more than
RADIX tasks, levels of cuts go before the last one: the first ranks inside
(group, run of RADIX map tasks), the next inside (group, run of RADIX such
runs), and so on, until RADIX runs are left.  No reducer of any level sees more
than ``n * RADIX`` rows of a group, whatever the number of tasks: a group spread
over 400,000 map tasks takes three cuts more and never fills a task.  The result
is exact - a row in the global top N of its group is in the top N of its run -
and ties are broken by the caller's unique key.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tasks, or runs of tasks, whose best rows meet in one reducer.
RADIX = 64


def map_tasks(df: DataFrame) -> int:
    """An upper estimate, without running anything, of the tasks that ``df`` has before its next shuffle.

    The splits of its files and the partitions of its stored tables; where the
    plan shuffles, at least the number of shuffle partitions.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    split = max(1, as_bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")))
    each = as_bytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    leaves, tasks = plan.collectLeaves(), 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRDD":
            tasks += leaf.rdd().getNumPartitions()
        elif kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            files = leaf.relation().location()
            tasks += -(-(files.sizeInBytes() + each * len(files.inputFiles())) // split)
    if re.search(r"\b(Join|Aggregate|Window|RepartitionByExpression|Repartition|Sort)\b", plan.toString()):
        tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(tasks, spark.sparkContext.defaultParallelism)


def levels(tasks: int, radix: int | None = None) -> int:
    """Cuts before the last one that leave at most ``radix`` runs of ``tasks`` tasks."""
    radix = radix or RADIX
    n = 0
    while tasks > radix:
        tasks = -(-tasks // radix)
        n += 1
    return n


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column],
                    n: int, rank_col: str | None = None, tasks: int | None = None) -> DataFrame:
    """Keep the first ``n`` rows of every group under ``order_cols``.

    ``order_cols`` must end with a unique key so the cut is deterministic.
    ``rank_col`` (optional) receives the 1-based rank.  ``tasks``: the tasks of
    ``df``, where the caller knows them better than ``map_tasks``.
    """
    if n < 1:
        raise ValueError("n must be >= 1")
    depth = levels(map_tasks(df) if tasks is None else tasks)
    run = "__tm_run"
    if depth:
        df = df.withColumn(run, F.spark_partition_id())
    for _ in range(depth):
        df = df.withColumn(run, F.floor(F.col(run) / RADIX).cast("int"))
        w = Window.partitionBy(*group_cols, run).orderBy(*order_cols)
        df = df.withColumn("__tm_rn", F.row_number().over(w)).where(F.col("__tm_rn") <= n).drop("__tm_rn")
    if depth:
        df = df.drop(run)
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    name = rank_col or "__tm_rank"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def top_n(df: DataFrame, order_cols: list[Column], n: int) -> DataFrame:
    """Global ordered top-N (TakeOrderedAndProject: per-task top-N, then merge)."""
    return df.orderBy(*order_cols).limit(n)
