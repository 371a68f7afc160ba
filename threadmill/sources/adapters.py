"""Adapters: derive the engine's input tables from the driver's parquet tables.

The reference scrapes its inputs; here they are derived, row for row, from
``/root/testdata/sf*/``.  Every adapter is a plain projection/aggregation so
the DuckDB oracle (plans/oracle.py) can build the same rows in SQL, and every
adapter scales with its source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values of the adapters (FIXTURES.md) -----------------------------
EPOCH_2024 = 1704067200          # 2024-01-01T00:00:00Z
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
PRODUCT_STATUSES = ("pending", "scraping", "processing", "generating", "completed",
                    "error", "processed", "processing_failed", "pipeline_completed")
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _iso_from_epoch(seconds) -> F.Column:
    """Epoch seconds -> RFC 3339 text, independent of the session time zone."""
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    ts = F.timestamp_add("SECOND", seconds.cast("long"), base)
    return F.date_format(ts, ISO_FORMAT)


def social(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw community records (the reference's ``raw`` shape plus ``id``).

    One record per document: product = source, subreddit = lang, every third
    document is a post (with a title), the rest comments.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    is_post = F.col("doc_id") % 3 == 0
    created = F.lit(EPOCH_2024) + F.col("doc_id") * 60
    return d.select(
        F.col("doc_id").alias("id"),
        F.lit("reddit").alias("source"),
        F.col("source").alias("product"),
        F.when(is_post, "post").otherwise("comment").alias("data_type"),
        F.col("text").alias("content"),
        F.when(is_post, F.col("text")).alias("title"),
        F.concat(F.lit("u"), (F.col("doc_id") % 97).cast("string")).alias("author"),
        (F.col("doc_id") * 37 % 101 - 10).cast("int").alias("score"),
        F.concat(F.lit("https://example.org/"), F.col("source"), F.lit("/"),
                 F.col("doc_id").cast("string")).alias("url"),
        F.col("lang").alias("subreddit"),
        _iso_from_epoch(created).alias("created_at"),
        _iso_from_epoch(created + 3600).alias("scraped_at"),
        F.create_map(F.lit("doc_id"), F.col("doc_id").cast("string")).alias("metadata"),
    )


# ---------------------------------------------------------------------------
# Threads: conversations -> post listings and comment listings
# ---------------------------------------------------------------------------

LISTING_PAGE = 25   # posts per search page (the reference asks for 25)
COMMENT_PAGE = 100  # children per comment listing page (bounds every collected array)


def thread_posts_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post per conversation (turn 0); num_comments = later turns."""
    c = table(spark, sf_dir, "conversations")
    counts = (c.where(F.col("turn") > 0).groupBy("conv_id")
               .agg(F.count(F.lit(1)).cast("int").alias("num_comments")))
    p = c.where(F.col("turn") == 0).join(counts, "conv_id", "left")
    cid = F.col("conv_id")
    sub = F.concat(F.lit("sub"), (cid % 4).cast("string"))
    pid = F.concat(F.lit("p"), cid.cast("string"))
    return p.select(
        cid.alias("conv_id"),
        F.concat(F.lit("prod"), (cid % 5).cast("string")).alias("product"),
        F.concat(F.lit("kw"), (cid % 3).cast("string")).alias("keyword"),
        F.floor(cid / LISTING_PAGE).alias("page"),
        F.struct(
            pid.alias("id"),
            F.when(cid % 10 == 7, F.lit("")).otherwise(F.col("text")).alias("title"),
            F.when(cid % 5 == 2, F.lit("")).otherwise(F.col("text")).alias("selftext"),
            F.concat(F.lit("a"), (cid % 31).cast("string")).alias("author"),
            sub.alias("subreddit"),
            (cid * 7 % 50).cast("int").alias("score"),
            F.coalesce(F.col("num_comments"), F.lit(0)).alias("num_comments"),
            (F.lit(EPOCH_2024) + cid * 3600 + F.lit(0.75)).cast("double").alias("created_utc"),
            F.concat(F.lit("https://example.org/t/"), cid.cast("string")).alias("url"),
            F.concat(F.lit("/r/"), sub, F.lit("/comments/"), pid, F.lit("/")).alias("permalink"),
        ).alias("post"),
    )


def post_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-result pages: ``data.children[].data`` envelopes of 25 posts.

    Columns: product, keyword, page, listing (POST_LISTING_SCHEMA shape).
    Pages are bounded (25 children), so collect_list stays small.
    """
    posts = thread_posts_flat(spark, sf_dir)
    child = F.struct(F.lit("t3").alias("kind"), F.col("post").alias("data"))
    return (posts.groupBy("product", "keyword", "page")
                 .agg(F.sort_array(F.collect_list(F.struct(F.col("conv_id"), child.alias("c"))))
                      .alias("items"))
                 .select("product", "keyword", "page",
                         F.struct(F.struct(F.transform("items", lambda x: x["c"]).alias("children"))
                                  .alias("data")).alias("listing")))


def comment_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment pages per post: later turns as ``t1`` children.

    Every (conv_id + turn) % 11 == 0 child is a ``more`` stub, % 13 == 0 is
    ``[deleted]`` and % 17 == 0 is ``[removed]``.  A post's comments come in
    pages of COMMENT_PAGE children, so a post holding a large share of all
    comments still yields only bounded arrays (and many rows to spread).
    Columns: post_id, page, subreddit, listing (COMMENT_LISTING_SCHEMA shape).
    """
    c = table(spark, sf_dir, "conversations").where(F.col("turn") > 0)
    key = F.col("conv_id") + F.col("turn")
    body = (F.when(key % 13 == 0, F.lit("[deleted]"))
             .when(key % 17 == 0, F.lit("[removed]"))
             .otherwise(F.col("text")))
    data = F.struct(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"),
                 F.col("turn").cast("string")).alias("id"),
        body.alias("body"),
        F.concat(F.col("role"), F.lit("_"), (F.col("conv_id") % 23).cast("string")).alias("author"),
        ((F.col("conv_id") * 31 + F.col("turn") * 7) % 40 - 5).cast("int").alias("score"),
        (F.lit(EPOCH_2024) + F.col("conv_id") * 3600 + F.col("turn") * 60 + F.lit(0.5))
        .cast("double").alias("created_utc"),
        F.concat(F.lit("t3_p"), F.col("conv_id").cast("string")).alias("parent_id"),
    )
    child = F.struct(F.when(key % 11 == 0, F.lit("more")).otherwise(F.lit("t1")).alias("kind"),
                     data.alias("data"))
    page = F.floor((F.col("turn") - 1) / COMMENT_PAGE).alias("page")
    return (c.groupBy("conv_id", page)
             .agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), child.alias("c")))).alias("items"))
             .select(F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("post_id"),
                     "page",
                     F.concat(F.lit("sub"), (F.col("conv_id") % 4).cast("string")).alias("subreddit"),
                     F.struct(F.struct(F.transform("items", lambda x: x["c"]).alias("children"))
                              .alias("data")).alias("listing")))


# ---------------------------------------------------------------------------
# Products and communities
# ---------------------------------------------------------------------------

def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked products from ``customer`` (PRODUCT_SCHEMA)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    seg = F.lower("c_mktsegment")
    subs = (F.when(k % 13 == 0, F.lit(None).cast("array<string>"))
             .when(k % 7 == 0, F.array().cast("array<string>"))
             .otherwise(F.array(F.concat(F.lit("sub"), (k % 4).cast("string")), seg)))
    kws = (F.when(k % 5 == 0, F.array().cast("array<string>"))
            .when(k % 11 == 0, F.array(seg, F.lit('price & "deal"')))
            .otherwise(F.array(seg, F.lit("review"))))
    statuses = F.array(*[F.lit(s) for s in PRODUCT_STATUSES])
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return c.select(
        k.alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("description"),
        subs.alias("subreddits"),
        kws.alias("keywords"),
        F.col("c_mktsegment").alias("category"),
        F.timestamp_add("HOUR", k, base).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_scraped"),
        F.lit(None).cast("timestamp_ntz").alias("last_processed"),
        F.lit(0).alias("faq_count"),
        F.get(statuses, (k % len(PRODUCT_STATUSES)).cast("int")).alias("status"),
    )


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Community search results: suppliers under their nation's topic."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    return (s.join(n, s.s_nationkey == n.n_nationkey)
             .select(F.col("n_name").alias("topic"),
                     F.col("s_name").alias("display_name"),
                     F.col("s_acctbal").cast("long").alias("subscribers"),
                     F.col("s_suppkey").alias("search_rank")))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics searched for: every nation name."""
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("topic"))


# ---------------------------------------------------------------------------
# Model responses (stand-in for the remote model; derived from ranked rows)
# ---------------------------------------------------------------------------

RESPONSE_CATEGORIES = ("Features", "Setup", "Performance")
RESPONSE_CONFIDENCES = ("0.9", "0.85", "0.8")


def product_number(c: str = "product") -> F.Column:
    """Trailing digits of a product name as int (0 when none)."""
    return F.coalesce(F.expr(f"try_cast(regexp_extract({c}, '([0-9]+)$', 1) AS INT)"), F.lit(0))


def model_responses(ranked: DataFrame) -> DataFrame:
    """Two responses per product (providers ``large`` and ``small``).

    Built from all ranked rows of the product, one entry per row: the question
    is the row's questions (or its text), the answer its whole text.  Form by
    product number: 0 a JSON array with text around it, 1 JSON with missing /
    quoted / non-number fields, 2 broken JSON, 3 "Q:/A:" lines.  ``large``
    uses form n % 4; ``small`` uses (n + 1) % 4, except n % 8 == 6 where it is
    also broken.
    """
    r = ranked
    turn = (F.col("rank") - 1) % 3
    q = F.when(F.size("extracted_questions") > 0, F.array_join("extracted_questions", " ")) \
         .otherwise(F.concat("content", F.lit("?")))
    a = F.col("content")
    cat = F.get(F.array(*[F.lit(x) for x in RESPONSE_CATEGORIES]), turn)
    conf = F.get(F.array(*[F.lit(x) for x in RESPONSE_CONFIDENCES]), turn)
    kw1, kw2 = F.col("data_type"), F.col("product")
    entry_a = F.to_json(F.struct(
        q.alias("question"), a.alias("answer"), cat.alias("category"),
        conf.cast("double").alias("confidence"), F.array(kw1, kw2).alias("keywords")))
    entry_b = (F.when(turn == 0, F.to_json(F.struct(q.alias("question"), a.alias("answer"),
                                                    F.lit("0.75").alias("confidence"))))
                .when(turn == 1, F.to_json(F.struct(a.alias("answer"), F.lit(None).cast("string").alias("confidence")),
                                           {"ignoreNullFields": "false"}))
                .otherwise(F.to_json(F.struct(
                    q.alias("question"), a.alias("answer"), F.lit("Setup").alias("category"),
                    F.lit("high").alias("confidence"), F.array().cast("array<string>").alias("keywords")))))
    broken = F.when(F.col("rank") == 1,
                    F.concat(F.lit('Here you go: [{"question": "'), q, F.lit('", "answer": ]')))
    lines_d = (F.when(turn == 0,
                      F.concat(F.lit("Q: "), q, F.lit("\nA: "), a, F.lit("\nsee also "), kw1))
                .when(turn == 1,
                      F.concat(F.lit("Question: "), q, F.lit("\nAnswer: "), a))
                .otherwise(F.concat(F.lit("Q: "), q, F.lit("\nnote first\nA: "), a)))
    from ..operators.prompts import ordered_join
    forms = (r.groupBy("product")
              .agg(F.concat(F.lit("Sure! Here are the FAQs:\n["),
                            ordered_join("product", "rank", entry_a, ", "),
                            F.lit("]\nHope this helps.")).alias("f0"),
                   F.concat(F.lit("["), ordered_join("product", "rank", entry_b, ", "),
                            F.lit("]")).alias("f1"),
                   F.max(broken).alias("f2"),
                   F.concat(F.lit("A: stray answer before any question\n"),
                            ordered_join("product", "rank", lines_d, "\n\n")).alias("f3")))
    n = product_number()
    large_form = n % 4
    small_form = F.when(n % 8 == 6, F.lit(2)).otherwise((n + 1) % 4)
    all_forms = F.array("f0", "f1", "f2", "f3")
    large = forms.select("product", F.lit("large").alias("provider"), F.lit(1).alias("priority"),
                         F.get(all_forms, large_form).alias("response"))
    small = forms.select("product", F.lit("small").alias("provider"), F.lit(2).alias("priority"),
                         F.get(all_forms, small_form).alias("response"))
    return large.unionByName(small)


def searched_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products to search for (id, name, subreddits, keywords): one per document source.

    Its name is the word at place n + 1 among the source's words by count (n
    the source's number), its keywords are the next two, and its subreddits
    the languages of the source's documents.
    """
    from ..operators.rank import top_n_per_group
    s = social(spark, sf_dir).select("product", "subreddit", "content")
    words = (s.select("product", F.explode(F.split(F.lower("content"), r"\s+")).alias("word"))
              .where("word <> ''").groupBy("product", "word").agg(F.count(F.lit(1)).alias("n")))
    first = product_number() + 1
    # the last place that any source's name or keywords stand at
    last = (s.select("product").distinct().agg(F.max(first)).first()[0] or 1) + 2
    top = (top_n_per_group(words.withColumn("first", first), ["product"],
                           [F.col("n").desc(), F.col("word").asc()], last, rank_col="rank")
           .where(F.col("rank").between(F.col("first"), F.col("first") + 2)))
    named = (top.groupBy("product", "first")
             .agg(F.max(F.when(F.col("rank") == F.col("first"), F.col("word"))).alias("name"),
                  F.array_sort(F.collect_list(F.when(F.col("rank") > F.col("first"),
                                                     F.struct("rank", "word")))).alias("kws")))
    subs = s.groupBy("product").agg(F.array_sort(F.collect_set("subreddit")).alias("subreddits"))
    return named.join(subs, "product").select(
        (F.col("first") - 1).cast("long").alias("id"), "name", "subreddits",
        F.transform("kws", lambda k: k["word"]).alias("keywords"))


def thread_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as a flat raw record (turn 0 a post).

    Products ``prod0..prod4`` - none of them among the ``social`` products.
    """
    c = table(spark, sf_dir, "conversations")
    cid, turn = F.col("conv_id"), F.col("turn")
    created = F.lit(EPOCH_2024) + cid * 3600 + turn * 60
    return c.select(
        (cid * 1000 + turn).alias("id"),
        F.lit("reddit").alias("source"),
        F.concat(F.lit("prod"), (cid % 5).cast("string")).alias("product"),
        F.when(turn == 0, "post").otherwise("comment").alias("data_type"),
        F.col("text").alias("content"),
        F.when(turn == 0, F.col("text")).alias("title"),
        F.col("role").alias("author"),
        ((cid * 31 + turn * 7) % 40 - 5).cast("int").alias("score"),
        F.concat(F.lit("https://example.org/t/"), cid.cast("string")).alias("url"),
        F.concat(F.lit("sub"), (cid % 4).cast("string")).alias("subreddit"),
        _iso_from_epoch(created).alias("created_at"),
        _iso_from_epoch(created + 3600).alias("scraped_at"),
        F.create_map(F.lit("conv_id"), cid.cast("string")).alias("metadata"),
    )


def queue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as the scraper would send them: some lack source or product."""
    s = social(spark, sf_dir)
    return (s.withColumn("source", F.when(F.col("id") % 23 == 0, F.lit(None).cast("string"))
                                    .otherwise(F.col("source")))
             .withColumn("product", F.when(F.col("id") % 29 == 0, F.lit(None).cast("string"))
                                     .otherwise(F.col("product"))))


def queue_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(offset, key, value) queue messages; every id % 50 == 0 is truncated JSON."""
    from .queue import encode
    r = queue_records(spark, sf_dir)
    m = encode(r).withColumn("offset", F.get_json_object("value", "$.id").cast("long"))
    broken = F.concat(F.lit('{"id": '), F.col("offset").cast("string"),
                      F.lit(', "source": "reddit", "content": "'))
    return m.withColumn("value", F.when(F.col("offset") % 50 == 0, broken)
                                  .otherwise(F.col("value")))


def social_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product row per document source (PRODUCT_SCHEMA)."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))
    n = product_number("source")
    statuses = F.array(*[F.lit(s) for s in PRODUCT_STATUSES])
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return d.select(
        n.cast("long").alias("id"), F.col("source").alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.array().cast("array<string>").alias("subreddits"),
        F.array().cast("array<string>").alias("keywords"),
        F.lit(None).cast("string").alias("category"),
        F.timestamp_add("MINUTE", F.col("first"), base).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_scraped"),
        F.lit(None).cast("timestamp_ntz").alias("last_processed"),
        F.lit(0).alias("faq_count"),
        F.get(statuses, (n % len(PRODUCT_STATUSES)).cast("int")).alias("status"))


RUN_STAGES = ("scrape", "process", "generate", "full_run", "process")
RUN_OUTCOMES = {"F": "ok", "O": "running", "P": "failed"}


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job runs from ``orders``: stage by priority digit, outcome by status."""
    o = table(spark, sf_dir, "orders")
    stage = F.get(F.array(*[F.lit(s) for s in RUN_STAGES]),
                  F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    outcome = F.create_map(*[F.lit(x) for kv in RUN_OUTCOMES.items() for x in kv])[F.col("o_orderstatus")]
    return o.select(F.col("o_custkey").alias("product_id"), stage.alias("stage"),
                    outcome.alias("outcome"), F.col("o_orderdate").alias("ts"),
                    F.col("o_orderkey").alias("run_id"))
