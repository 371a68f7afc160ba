"""File sources and sinks for raw and processed records.

Layouts (all below a folder on shared storage):
* landing table: JSON lines, ``partitionBy(source, product_slug)``;
* batch files: one JSON array per flush and (source, product) - the layout
  the reference's consumer produces - read with ``multiLine``;
* snapshots: Parquet partitioned by product_slug under a run folder, plus a
  "latest" JSON copy.

Reads always pass an explicit schema (no inference pass), and the selection
of a source or product is a partition filter, so only its folders are read.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import product_slug
from ..operators.joins import small_side
from ..operators.rank import top_n_per_group
from ..schemas import FAQ_READY_SCHEMA, RAW_WITH_ID_SCHEMA
from ..session import materialize

#: Folders of the landing table; ``batch`` is the micro-batch, or BATCH_LOAD for rows written by a batch job.
PARTITIONS = [StructField("source", StringType()), StructField("product_slug", StringType()),
              StructField("batch", LongType())]
BATCH_LOAD = -1


def _landing_schema(schema: StructType) -> StructType:
    fields = [f for f in schema.fields if f.name != "source"]
    return StructType(fields + PARTITIONS)


def write_landing(records: DataFrame, root: str, mode: str = "append") -> None:
    """Append records to the landing table (one folder per source/product).

    Rebalanced on the folder keys like the snapshot: few files per folder,
    a hot product split by AQE over several writers."""
    (records.withColumn("product_slug", product_slug("product")).withColumn("batch", F.lit(BATCH_LOAD).cast("long"))
            .hint("rebalance", "source", "product_slug")
            .write.mode(mode).partitionBy("source", "product_slug", "batch").json(root))


def folder_glob(spark: SparkSession, root: str, slugs: list[str] | None, source: str | None) -> str:
    """A path pattern of the wanted folders only: nothing else is listed."""
    def named(value: str) -> str:
        escaped = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
        return re.sub(r"([\\{}\[\]*?,])", r"\\\1", escaped)

    if not slugs and not source:
        return root
    path = root.rstrip("/") + "/source=" + (named(source) if source else "*")
    if slugs:
        path += "/product_slug={" + ",".join(named(v) for s in sorted(set(slugs)) for v in (s, s + "_")) + "}"
    return path


def _loaded(load, spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``load`` reads from ``path``; no rows where there is no such folder."""
    try:
        return load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


FILE_SCHEMA = StructType([StructField("path", StringType()), StructField("length", LongType())])


def data_files(spark: SparkSession, root: str, glob: str | None = None, slugs: list[str] | None = None,
               source: str | None = None) -> DataFrame:
    """(source, product_slug, path, name) of the non-empty data files of a landing table, or of some of its folders.

    The listing is Spark's own (hidden files such as ``_SUCCESS`` are left out)
    and stays a DataFrame; no file content is read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    folder = r"/source=([^/]*)/product_slug=([^/]*)/"
    files = _loaded(lambda path: reader.load(path).select("path", "length"), spark,
                    folder_glob(spark, root, slugs, source), FILE_SCHEMA)
    return (files.where("length > 0")
            .select(F.regexp_extract("path", folder, 1).alias("source"),
                    F.regexp_extract("path", folder, 2).alias("product_slug"), "path",
                    F.regexp_extract("path", r"/product_slug=[^/]*/(.*)$", 1).alias("name")))


def _losing_folders(files: DataFrame) -> DataFrame:
    """(source, product_slug) of ``slug_`` folders whose exact folder in the same source holds data."""
    folders = files.select("source", "product_slug").distinct()
    exact = folders.select("source", F.concat("product_slug", F.lit("_")).alias("product_slug"))
    return folders.join(exact, ["source", "product_slug"], "left_semi")


def _wanted(df: DataFrame, slugs: list[str] | None, source: str | None) -> DataFrame:
    if slugs:
        df = df.where(F.col("product_slug").isin(*sorted({v for s in slugs for v in (s, s + "_")})))
    return df.where(F.col("source") == source) if source else df


def raw_scan(spark: SparkSession, root: str, schema: StructType = RAW_WITH_ID_SCHEMA,
             slugs: list[str] | None = None, multi_line: bool = False,
             glob: str | None = None, source: str | None = None) -> DataFrame:
    """Landing rows with the folder-variant rule of the reference.

    A product is stored under ``slug`` or, when its name had a trailing
    space, under ``slug_``.  Per source and product the exact folder wins when
    it holds data; otherwise the underscore folder is used.  Of ``source`` and
    ``slugs`` only the folders are listed and read.
    ``multi_line`` reads files that each hold one JSON array or object (the
    batch-file layout) instead of JSON lines; ``glob`` filters file names.
    """
    losing = small_side(_losing_folders(_wanted(data_files(spark, root, glob, slugs, source), slugs, source)))
    kept = StructType(_landing_schema(schema).fields[:-1])
    reader = (spark.read.schema(_landing_schema(schema)).option("multiLine", multi_line)
                   .option("basePath", root))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = _loaded(lambda path: reader.json(path).select(*kept.names), spark, folder_glob(spark, root, slugs, source),
                   kept)
    return _wanted(rows, slugs, source).join(losing, ["source", "product_slug"], "left_anti")


#: Flushes whose files share a folder; a file's number in it has three digits.
FLUSH_RUN = 500


def write_batch_files(records: DataFrame, root: str, flush_size: int = 50,
                      offset_col: str = "id") -> None:
    """Write records as JSON-array files, one per (flush, source, product).

    A flush is ``flush_size`` consecutive offsets (the consumer's batch);
    each group holds at most ``flush_size`` records, so collecting it is
    bounded.  Runs of FLUSH_RUN flushes share a folder, which one task writes
    in the order of the flushes, so the order of the names is that of the
    flushes and there are few folders to make, commit and list.
    """
    number = F.floor(F.col(offset_col) / flush_size).cast("long")
    named = lambda n: F.format_string("f%010d", n)
    rec = F.struct(*[F.col(c) for c in records.columns])
    folder = ["source", "product_slug", "flush"]
    (records.withColumn("product_slug", product_slug("product"))
            .withColumn("__tm_flush", named(number))
            .withColumn("flush", named((F.floor(number / FLUSH_RUN) * FLUSH_RUN).cast("long")))
            .select(*folder, "__tm_flush", F.struct(F.col(offset_col).alias("o"), F.to_json(rec).alias("r")).alias("pair"))
            # (not by source: where it is one value, Spark drops it from the groups and would shuffle again)
            .repartition("product_slug", "flush")
            .groupBy(*folder, "__tm_flush")
            .agg(F.sort_array(F.collect_list("pair")).alias("pairs"))
            # the file body is the offset-ordered JSON array of the records
            .select(*folder, "__tm_flush",
                    F.concat(F.lit("["), F.array_join(F.transform("pairs", lambda x: x["r"]), ","),
                             F.lit("]")).alias("value"))
            .sortWithinPartitions(*folder, "__tm_flush").drop("__tm_flush")
            .write.mode("append").option("maxRecordsPerFile", 1).partitionBy(*folder).text(root))


def first_n_files(spark: SparkSession, root: str, n: int = 20, glob: str = "*.{json,txt}",
                  schema: StructType = RAW_WITH_ID_SCHEMA, slugs: list[str] | None = None,
                  source: str | None = None) -> DataFrame:
    """Records of the first ``n`` files (by name) of every product folder of every source.

    The folder variants follow the rule of ``raw_scan``.  Files are ranked on
    the executors; only the paths of the chosen ones (``n`` per folder) reach
    the driver, and only these files are read.  Each file is a JSON array or
    object (``multiLine``); a file that does not parse is skipped but still
    takes its place among the first ``n``.
    """
    listed = _wanted(data_files(spark, root, glob, slugs, source), slugs, source)
    # one row per file: read by as many tasks as a shuffle has, not by one for every few files
    files = materialize(listed.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    files = files.join(small_side(_losing_folders(files)), ["source", "product_slug"], "left_anti")
    best = top_n_per_group(files, ["source", "product_slug"], [F.col("name").asc()], n)
    chosen = [r.path for r in best.select("path").collect()]
    fields = [f for f in schema.fields if f.name != "product_slug"]
    if not chosen:
        return spark.createDataFrame([], StructType(fields + [StructField("product_slug", StringType())]))
    # multiLine parses each file as one record, so a file that does not parse
    # is one malformed record and DROPMALFORMED skips exactly that file
    df = (spark.read.schema(schema).option("multiLine", True)
               .option("mode", "DROPMALFORMED").json(chosen))
    return df.withColumn("product_slug",
                         F.regexp_extract(F.col("_metadata.file_path"), "product_slug=([^/]*)/", 1))


def write_snapshot(ready: DataFrame, run_dir: str) -> None:
    """Parquet snapshot of model-ready rows, one folder per product.

    The rebalance shuffle packs each product into few files of the advisory
    size (without it every task writes one file per product it holds); AQE
    splits a hot product over several writers."""
    (ready.withColumn("product_slug", product_slug("product"))
          .hint("rebalance", "product_slug")
          .write.mode("overwrite").partitionBy("product_slug").parquet(run_dir))


def write_latest_json(ready: DataFrame, path: str) -> None:
    """The "latest" JSON copy.  Partitioned like the snapshot instead of the
    reference's single ``coalesce(1)`` file, which would funnel the whole
    table through one task; rebalanced by product like the snapshot, so a
    hot product is spread over several writers and a small one is one file.
    Only the products in ``ready`` are replaced: a run for one product leaves
    the others' latest copy as it is."""
    (ready.withColumn("product_slug", product_slug("product"))
          .hint("rebalance", "product_slug")
          .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
          .partitionBy("product_slug").json(path))


def read_snapshot(spark: SparkSession, run_dir: str, product: str | None = None) -> DataFrame:
    df = spark.read.parquet(run_dir)
    if product is not None:
        df = df.where(F.col("product_slug") == product.replace(" ", "_").lower())
    return df


def read_latest(spark: SparkSession, path: str, product: str | None = None) -> DataFrame:
    """Latest model-ready rows (explicit schema); empty when the folder does not exist.

    Any other failure (an unknown file system, no permission) is raised."""
    schema = StructType(FAQ_READY_SCHEMA.fields + [StructField("product_slug", StringType())])
    try:
        df = spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if product is not None:
        df = df.where(F.col("product_slug") == product.replace(" ", "_").lower())
    return df
