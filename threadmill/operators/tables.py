"""Table maintenance and reports over the product and document tables.

The reference mutates a document store one record at a time.  Here every
change is a set operation producing the new table version: anti-joins for
inserts and deletes, a left join for updates, and "latest version wins"
top-1 cuts (one row per key and task before the shuffle) for upserts and status changes.
No MERGE-capable table format is assumed; callers write the returned version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ingest import DEFAULT_COMMUNITIES
from .rank import top_n_per_group

# --- fixed values -----------------------------------------------------------
REPORTED_STATUSES = ("pending", "scraping", "processing", "generating", "completed", "error")
IN_PROGRESS_STATUSES = ("scraping", "processing", "generating")
NAME_MIN, NAME_MAX = 1, 200
PAGE_LIMIT_MIN, PAGE_LIMIT_MAX = 1, 100
# keywords of a product created without any
DEFAULT_PRODUCT_KEYWORDS = ("review", "problem", "help", "question")
# status after the latest run of a stage, by (stage, outcome)
# Status set by a run's (stage:outcome).  A failed scrape trigger is only
# logged, so it has no entry and the product keeps its status.
RUN_STATUS = {
    "scrape:ok": "scraping", "scrape:running": "scraping",
    "process:ok": "processed", "process:running": "processing",
    "process:failed": "processing_failed", "process:timeout": "processing_timeout",
    "generate:ok": "completed", "generate:running": "generating", "generate:failed": "error",
    "full_run:ok": "pipeline_completed", "full_run:running": "pipeline_scraping",
    "full_run:failed": "pipeline_error",
}
# ---------------------------------------------------------------------------


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def status_counts(products: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: totals, a count per reported status (zero filled), the
    statuses outside that list as ``other``, and ``in_progress``.

    Both tables go through one aggregation (union, then conditional counts)
    rather than two aggregates joined together.
    """
    rows = (products.select(F.col("status"), F.lit(True).alias("is_product"))
            .unionByName(documents.select(F.lit(None).cast("string").alias("status"),
                                          F.lit(False).alias("is_product"))))
    aggs = [F.count_if(F.col("is_product")).alias("total_products"),
            F.count_if(~F.col("is_product")).alias("total_faq_documents")]
    aggs += [F.count_if(F.col("status") == s).alias(s) for s in REPORTED_STATUSES]
    aggs += [F.count_if(F.col("is_product") & ~F.coalesce(
                 F.col("status").isin(*REPORTED_STATUSES), F.lit(False))).alias("other"),
             F.count_if(F.col("status").isin(*IN_PROGRESS_STATUSES)).alias("in_progress")]
    return rows.agg(*aggs)


def product_faq_counts(products: DataFrame, documents: DataFrame) -> DataFrame:
    """Write entry count and generation time back onto products (left join)."""
    d = documents.select(F.col("product").alias("name"),
                         F.size("faqs").alias("doc_faq_count"),
                         F.col("generated_at").alias("doc_generated_at"))
    return (products.join(d, "name", "left")
            .withColumn("faq_count", F.coalesce("doc_faq_count", "faq_count"))
            .withColumn("last_processed", F.coalesce("doc_generated_at", "last_processed"))
            .drop("doc_faq_count", "doc_generated_at"))


def product_page(products: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    """Newest first, skip then limit; ``id`` rendered as text."""
    if not PAGE_LIMIT_MIN <= limit <= PAGE_LIMIT_MAX or skip < 0:
        raise ValueError("skip must be >= 0 and limit within 1..100")
    ordered = products.orderBy(F.col("created_at").desc(), F.col("id").asc())
    return ordered.offset(skip).limit(limit).withColumn("id", F.col("id").cast("string"))


def validate_products(requests: DataFrame, name_col: str = "name") -> DataFrame:
    """Flag requests whose name length is outside 1..200 (with a reason)."""
    n = F.coalesce(F.length(name_col), F.lit(0))
    reason = (F.when(n < NAME_MIN, F.lit("name empty"))
               .when(n > NAME_MAX, F.lit("name too long")))
    return requests.withColumn("name_length", n).withColumn("reason", reason) \
                   .withColumn("valid", reason.isNull())


def insert_new_products(products: DataFrame, requests: DataFrame, created_at: Column,
                        order_col: str = "request_pos",
                        discovered: DataFrame | None = None) -> DataFrame:
    """New product rows for requests whose name does not exist yet.

    Duplicate names inside the batch keep their first request.  Omitted
    keywords take the default list (an explicit empty list stays empty).  A
    request without subreddits takes its discovered communities
    (``discovered`` = topic, rank, display_name, joined on the normalised
    name), else the default communities; a request whose ``auto_discover`` is
    false takes the defaults without looking (a missing column or null: true).
    Counters and times start empty.
    """
    first = top_n_per_group(requests, ["name"], [F.col(order_col).asc()], 1)
    new = first.join(products.select("name"), "name", "left_anti")
    found = F.lit(None).cast("array<string>")
    if discovered is not None:
        lists = (discovered.groupBy("topic")
                 .agg(F.array_sort(F.collect_list(F.struct("rank", "display_name"))).alias("d"))
                 .select("topic", F.transform("d", lambda x: x["display_name"]).alias("found")))
        new = new.join(lists, F.lower(F.trim(new["name"])) == lists["topic"], "left").drop("topic")
        found = F.col("found")
        if "auto_discover" in requests.columns:
            found = F.when(F.coalesce(F.col("auto_discover"), F.lit(True)), found)
    subs = (F.when(F.coalesce(F.size("subreddits"), F.lit(-1)) > 0, F.col("subreddits"))
             .when(found.isNotNull(), found)
             .otherwise(_lit_array(DEFAULT_COMMUNITIES)))
    return new.select(
        F.xxhash64("name").alias("id"), "name", "description", subs.alias("subreddits"),
        F.coalesce(F.col("keywords"), _lit_array(DEFAULT_PRODUCT_KEYWORDS)).alias("keywords"),
        "category", created_at.alias("created_at"),
        F.lit(None).cast(products.schema["last_scraped"].dataType).alias("last_scraped"),
        F.lit(None).cast(products.schema["last_processed"].dataType).alias("last_processed"),
        F.lit(0).alias("faq_count"), F.lit("pending").alias("status"))


def form_requests(forms: DataFrame) -> DataFrame:
    """Product form rows (name, description, keywords_text, category, ...) ->
    insert requests: keywords split on commas and trimmed (empty entries
    kept), empty description and category become NULL, subreddits are left to
    discovery.  Other columns pass through."""
    from ..functions.text import keyword_list
    form_cols = ("description", "keywords_text", "category")
    rest = [c for c in forms.columns if c not in form_cols]
    return forms.select(
        *rest,
        F.nullif(F.col("description"), F.lit("")).alias("description"),
        F.when(F.col("keywords_text").isNotNull(), keyword_list("keywords_text")).alias("keywords"),
        F.nullif(F.col("category"), F.lit("")).alias("category"),
        F.lit(None).cast("array<string>").alias("subreddits"))


UPDATABLE = ("name", "description", "subreddits", "keywords", "category")


def update_products(products: DataFrame, changes: DataFrame,
                    order_col: str | None = None) -> DataFrame:
    """Overwrite the five editable fields of products named in ``changes``.

    A change is a full product request: all five fields are set, and a
    change without keywords takes the request default (as on insert).
    Several changes of one product collapse to one first (a grouped top-1,
    partial per task): the greatest ``order_col`` wins, as with edits applied
    in sequence; without it the pick is still deterministic.  So the join never
    multiplies a product row.
    """
    changes = changes.withColumn(
        "keywords", F.coalesce(F.col("keywords"), _lit_array(DEFAULT_PRODUCT_KEYWORDS)))
    order = [F.col(c).desc() for c in ([order_col] if order_col else []) + list(UPDATABLE)]
    ch = (top_n_per_group(changes, ["id"], order, 1)
          .select(F.col("id"), F.lit(True).alias("__hit"),
                  *[F.col(c).alias(f"__new_{c}") for c in UPDATABLE]))
    j = products.join(ch, "id", "left")
    for c in UPDATABLE:
        j = j.withColumn(c, F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)))
    return j.select(*products.columns)


def delete_cascade(products: DataFrame, documents: DataFrame,
                   deletions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove products by id and their documents by product name."""
    gone = products.join(deletions.select("id"), "id", "left_semi").select("name")
    kept_products = products.join(deletions.select("id"), "id", "left_anti")
    kept_docs = documents.join(gone.withColumnRenamed("name", "product"), "product", "left_anti")
    return kept_products, kept_docs


def product_status(products: DataFrame, runs: DataFrame) -> DataFrame:
    """Status from the latest run of each product (stage + outcome mapping).

    ``runs`` = (product_id, stage, outcome, ts, run_id).  The latest run is a
    grouped top-1 whose partial limit leaves one row per product and task
    before the shuffle.  Products without runs, or whose latest run maps to
    nothing, keep their status.
    """
    mapping = F.create_map(*[F.lit(x) for kv in RUN_STATUS.items() for x in kv])
    latest = (top_n_per_group(runs, ["product_id"], [F.col("ts").desc(), F.col("run_id").desc()], 1)
              .select(F.col("product_id").alias("id"),
                      mapping[F.concat_ws(":", "stage", "outcome")].alias("run_status"),
                      F.col("ts").alias("last_run_at")))
    return (products.join(latest, "id", "left")
                    .withColumn("status", F.coalesce("run_status", "status"))
                    .drop("run_status"))


def newest_documents(documents: DataFrame) -> DataFrame:
    """Per product the document with the greatest ``updated_at`` (the whole document breaks ties)."""
    order = ["updated_at"] + [c for c in documents.columns if c not in ("product", "updated_at")]
    return top_n_per_group(documents, ["product"], [F.col(c).desc() for c in order], 1)


def faq_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert documents by product: the greatest ``updated_at`` wins.

    Re-applying the same incoming batch changes nothing.  ``store.upsert_documents``
    does the same on a stored table, bucket by bucket.
    """
    return newest_documents(existing.unionByName(incoming))
