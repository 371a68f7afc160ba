"""Stored tables of the serving side, laid out so that a change or a request touches a small part of them.

* Documents lie in hash buckets of their product: an upsert rewrites the
  buckets it touches, a lookup reads one.
* The text index holds, for every run of three characters of an entry, a
  posting (trigram, product, entry_pos), in hash buckets of the trigram: a
  search reads the buckets of its trigrams, intersects the postings and tests
  the few entries that hold them all.
* The page table holds products in ranges of the listing's order, with a
  directory of how many rows each range has: a page reads the ranges it lies in.

All are plain Parquet folders written by Spark; a change replaces whole
buckets (dynamic partition overwrite), so repeating it changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ingest import trigrams
from .responses import faq_search
from .tables import PAGE_LIMIT_MAX, PAGE_LIMIT_MIN, newest_documents

#: Buckets of the document table and of the text index.  A stored table keeps the number it was made with.
BUCKETS, GRAM_BUCKETS = 64, 256
#: Rows of a range of the page table.
RANGE_ROWS = 100_000
BUCKET = "__tm_bucket"


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def _replace(df: DataFrame, root: str) -> None:
    """Write whole buckets; those that ``df`` has no rows for stay as they are."""
    (df.hint("rebalance", BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(BUCKET).parquet(root))


def _stored(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


# --- documents ---------------------------------------------------------------

def upsert_documents(incoming: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """Merge documents into the table at ``root``: per product the newest one stays.

    Only the buckets of the incoming products are read and rewritten; they
    are stored before the old folders are replaced.  Applying the same
    documents again changes nothing.
    """
    new = materialize(incoming.withColumn(BUCKET, _bucket(F.col("product"), buckets)))
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return
    old = _stored(incoming.sparkSession, root)
    merged = new if old is None else old.where(F.col(BUCKET).isin(touched)).unionByName(new)
    _replace(materialize(newest_documents(merged)), root)


def read_documents(spark: SparkSession, root: str, product: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """All documents, or those of one product: its bucket's folder alone."""
    docs = spark.read.parquet(root)
    if product is not None:
        # folded to a number by the optimizer, so the other folders are not read
        docs = docs.where((F.col(BUCKET) == _bucket(F.lit(product), buckets)) & (F.col("product") == product))
    return docs.drop(BUCKET)


# --- text index --------------------------------------------------------------

SEARCHED = ("question", "answer", "category")


def write_entry_index(entries: DataFrame, root: str, buckets: int = GRAM_BUCKETS) -> None:
    """Entries (product, entry_pos, ...) by product bucket, and the postings of their trigrams by trigram bucket."""
    by_product = materialize(entries.withColumn(BUCKET, _bucket(F.col("product"), BUCKETS)))
    _replace(by_product, f"{root}/entries")
    grams = F.array_distinct(F.concat(*[trigrams(F.lower(F.coalesce(c, F.lit("")))) for c in SEARCHED]))
    postings = by_product.select("product", "entry_pos", F.explode(grams).alias("gram"))
    _replace(postings.withColumn(BUCKET, _bucket(F.col("gram"), buckets)), f"{root}/postings")


def search_index(spark: SparkSession, root: str, term: str, buckets: int = GRAM_BUCKETS) -> DataFrame:
    """The entries whose question, answer or category contains ``term``, whatever its case.

    The postings of the term's trigrams are counted per entry - an entry that
    contains the term has them all - and only such entries are read and
    tested.  A term of fewer than three characters has none: all entries are.
    """
    entries = spark.read.parquet(f"{root}/entries")
    lowered = F.lower(F.lit(term))
    asked = [(r["gram"], r["b"]) for r in spark.range(1).select(F.explode(trigrams(lowered)).alias("gram"))
             .select("gram", _bucket(F.col("gram"), buckets).alias("b")).collect()]
    if asked:
        postings = spark.read.parquet(f"{root}/postings").where(
            F.col(BUCKET).isin([b for _, b in asked]) & F.col("gram").isin([g for g, _ in asked]))
        # an entry has one posting per trigram
        holding = (postings.groupBy("product", "entry_pos").agg(F.count(F.lit(1)).alias("n"))
                   .where(F.col("n") == len(asked)).select("product", "entry_pos"))
        entries = entries.join(holding, ["product", "entry_pos"], "left_semi")
    return faq_search(entries.drop(BUCKET), term)


# --- pages -------------------------------------------------------------------

RANGE, BLOCK = "__tm_range", "__tm_block"
#: Rows of a folder of the page table, where ranges are smaller.
BLOCK_ROWS = 100_000


def write_pages(products: DataFrame, root: str, range_rows: int = RANGE_ROWS) -> None:
    """Products in ranges of the listing's order (newest first, then id), and the directory of the ranges.

    Tasks and folders are made by blocks of rows, however small the ranges
    are; inside a block's file the ranges follow each other.
    """
    stored = materialize(products)
    n = max(1, -(-stored.count() // max(range_rows, BLOCK_ROWS)))
    order = [F.col("created_at").desc(), F.col("id").asc()]
    # the id's upper bits are the task's number, the lower ones the row's place in it
    ordered = materialize(stored.repartitionByRange(n, *order).sortWithinPartitions(*order)
                          .withColumn("__tm_at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn(BLOCK, F.shiftright("__tm_at", 33).cast("int"))
    upto = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = materialize(ordered.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("n")))  # one row per block
    first = sizes.select(BLOCK, F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__tm_first"))
    place = F.col("__tm_first") + F.col("__tm_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = (ordered.join(F.broadcast(first), BLOCK).withColumn("__tm_place", place)
              .withColumn(RANGE, F.floor(F.col("__tm_place") / range_rows).cast("long")))
    (placed.drop("__tm_at", "__tm_first", "__tm_place").write.mode("overwrite").partitionBy(BLOCK)
     .parquet(f"{root}/rows"))
    # one row per range (two or more where it lies in several blocks): how many rows it has, and how many stand before it
    (placed.groupBy(RANGE, BLOCK).agg(F.count(F.lit(1)).alias("n"), F.min("__tm_place").alias("before"))
     .write.mode("overwrite").parquet(f"{root}/directory"))


def read_page(spark: SparkSession, root: str, skip: int = 0, limit: int = 50) -> DataFrame:
    """The page of ``limit`` products after the first ``skip``, newest first; ``id`` rendered as text.

    The directory names the ranges that the page lies in (two or three); only
    their rows are read and ordered, however deep the page is.
    """
    if not PAGE_LIMIT_MIN <= limit <= PAGE_LIMIT_MAX or skip < 0:
        raise ValueError("skip must be >= 0 and limit within 1..100")
    here = (spark.read.parquet(f"{root}/directory")
            .where((F.col("before") < skip + limit) & (F.col("before") + F.col("n") > skip))
            .orderBy("before").collect())  # each of them holds a row of the page, so at most ``limit``
    if not here:
        return spark.read.parquet(f"{root}/rows").drop(RANGE, BLOCK).where(F.lit(False)).withColumn("id", F.col("id").cast("string"))
    first = here[0]["before"]
    rows = spark.read.parquet(f"{root}/rows").where(F.col(BLOCK).isin(sorted({r[BLOCK] for r in here}))
                                                    & F.col(RANGE).isin(sorted({r[RANGE] for r in here})))
    ordered = rows.drop(RANGE, BLOCK).orderBy(F.col("created_at").desc(), F.col("id").asc())
    return ordered.offset(skip - first).limit(limit).withColumn("id", F.col("id").cast("string"))
