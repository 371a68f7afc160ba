"""Ingest: nested listings -> raw records, search grids, matches, dedup.

The reference does these with per-request loops in a scraper; here each is a
set operation over all products: ``inline`` flattens the nested envelopes,
joins replace requests, and windows replace "first N of the response".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.adapters import ISO_FORMAT
from ..session import materialize
from .joins import small_side
from .rank import top_n_per_group

# --- fixed values -----------------------------------------------------------
PERMALINK_HOST = "https://reddit.com"
# Scraper defaults when a request has no subreddits / keywords.
DEFAULT_SUBREDDITS = ("technology", "gadgets", "samsung", "Android", "samsunggalaxy")
DEFAULT_KEYWORDS = ("review", "problem", "issue", "help", "question", "experience", "opinion")
# Product-creation default when community discovery finds nothing.
DEFAULT_COMMUNITIES = ("technology", "gadgets")
SEARCH_PAGE = 25          # newest posts per (subreddit, keyword) search
COMMENTS_PER_POST = 20    # comments fetched per post
MIN_COMMENTS = 5          # comments are fetched only above this count
MIN_SUBSCRIBERS = 1000    # communities at or below are ignored
SEARCH_RESULTS = 10       # community search results returned per topic
TOP_COMMUNITIES = 3
# ---------------------------------------------------------------------------


def epoch_to_iso(c) -> Column:
    """Float epoch -> whole seconds (truncated) -> RFC 3339 text (UTC)."""
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(F.timestamp_add("SECOND", c.cast("long"), base), ISO_FORMAT)


def normalize_posts(listings: DataFrame, listing_col: str = "listing") -> DataFrame:
    """Post listings -> raw post records.

    ``listings`` carries the request context (``product``, ``keyword``) next to
    the envelope.  Posts with neither title nor body are skipped; the content
    is the body, else the title.
    """
    posts = (listings
             .select("product", "keyword", F.inline(F.col(f"{listing_col}.data.children")))
             .select("product", "keyword", "data.*"))
    title = F.coalesce(F.col("title"), F.lit(""))
    body = F.coalesce(F.col("selftext"), F.lit(""))
    return (posts.where((title != "") | (body != ""))
            .select(F.col("id").alias("post_id"),
                    F.lit("reddit").alias("source"),
                    "product",
                    F.lit("post").alias("data_type"),
                    F.when(body != "", body).otherwise(title).alias("content"),
                    "title", "author", "score",
                    F.concat(F.lit(PERMALINK_HOST), F.col("permalink")).alias("url"),
                    "subreddit",
                    epoch_to_iso("created_utc").alias("created_at"),
                    F.create_map(F.lit("post_id"), F.col("id"),
                                 F.lit("num_comments"), F.col("num_comments").cast("string"),
                                 F.lit("keyword"), F.col("keyword")).alias("metadata")))


def normalize_comments(comment_listings: DataFrame, posts: DataFrame,
                       listing_col: str = "listing") -> DataFrame:
    """Comment listings -> raw comment records.

    Keeps children of kind ``t1`` whose body is non-empty and not
    ``[deleted]`` (``[removed]`` stays).  Each comment takes the product and
    URL of its post (an equi-join on post id).
    """
    kids = (comment_listings
            .select("post_id", F.inline(F.col(f"{listing_col}.data.children")))
            .where((F.col("kind") == "t1") & (F.col("data.body") != "")
                   & (F.col("data.body") != "[deleted]"))
            .select("post_id", "data.*"))
    p = posts.select("post_id", "product", "url", "subreddit")
    return (kids.join(p, "post_id")
            .select(F.col("id").alias("comment_id"),
                    "post_id",
                    F.lit("reddit").alias("source"),
                    "product",
                    F.lit("comment").alias("data_type"),
                    F.col("body").alias("content"),
                    "author", "score", "url", "subreddit",
                    epoch_to_iso("created_utc").alias("created_at"),
                    F.create_map(F.lit("comment_id"), F.col("id"),
                                 F.lit("post_id"), F.col("post_id"),
                                 F.lit("parent_id"), F.col("parent_id")).alias("metadata")))


def post_comments(posts: DataFrame, comments: DataFrame, min_comments: int = MIN_COMMENTS,
                  per_post: int = COMMENTS_PER_POST) -> DataFrame:
    """Comments of posts with more than ``min_comments``, best ``per_post`` each.

    The semi join keeps or drops whole posts, so ranking first gives the same
    rows - and lets the partial top-N run in every map task before anything
    is shuffled: a post holding a third of all comments sends at most
    ``per_post`` rows per task instead of all its comments into one join task.
    """
    busy = (posts.where(F.col("metadata")["num_comments"].cast("int") > min_comments)
                 .select("post_id"))
    best = top_n_per_group(comments, ["post_id"],
                           [F.col("score").desc_nulls_last(), F.col("comment_id").asc()],
                           per_post, rank_col="comment_rank")
    return best.join(busy, "post_id", "left_semi")


def _list_or_default(c: str, default: tuple[str, ...]) -> Column:
    lit = F.array(*[F.lit(x) for x in default])
    return F.when(F.coalesce(F.size(c), F.lit(-1)) > 0, F.col(c)).otherwise(lit)


def query_escape(c: Column) -> Column:
    """URL query escaping with space as '+' and only ``A-Za-z0-9-_.~`` kept.

    ``url_encode`` (java.net.URLEncoder) differs on two characters: it keeps
    ``*`` and escapes ``~``; both are corrected here.
    """
    e = F.url_encode(c)
    return F.replace(F.replace(e, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def search_grid(products: DataFrame) -> DataFrame:
    """Scrape tasks: every (subreddit x keyword) pair of every product.

    Empty or NULL lists take the scraper defaults.  The grid of one product
    is the product of two short lists, built inside the row (two
    ``posexplode``), so no join and no shuffle.
    """
    g = (products
         .select(F.col("id").alias("product_id"), F.col("name").alias("product"),
                 _list_or_default("subreddits", DEFAULT_SUBREDDITS).alias("subs"),
                 _list_or_default("keywords", DEFAULT_KEYWORDS).alias("kws"))
         .select("product_id", "product", "kws",
                 F.posexplode("subs").alias("sub_pos", "subreddit"))
         .select("product_id", "product", "sub_pos", "subreddit",
                 F.posexplode("kws").alias("kw_pos", "keyword")))
    q = F.format_string('"%s" AND %s', F.col("product"), F.col("keyword"))
    return g.withColumn("search_query", q).withColumn("query_escaped", query_escape(q))


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text; none for a shorter one.

    One linear pass of the regular expression: a look-ahead matches at every place.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))"), F.lit(1)))


def _keyed(wanted: DataFrame, posts: DataFrame) -> DataFrame:
    """Searches (subreddit, product, keyword, p, k) with ``key``: of their trigrams the one the fewest posts hold.

    Document frequencies are counted in the search's own subreddit, for the
    searches' trigrams alone.  A search without any trigram has a null key.
    """
    search = ["subreddit", "product", "keyword"]
    grams = materialize(wanted.select(*search, F.explode(F.array_distinct(F.concat(trigrams(F.col("p")),
                                                                                   trigrams(F.col("k"))))).alias("key")))
    asked = small_side(grams.select("subreddit", "key").distinct())
    df = (posts.select("subreddit", F.explode(trigrams(F.col("__tm_text"))).alias("key"))
          .join(asked, ["subreddit", "key"]).groupBy("subreddit", "key").agg(F.count(F.lit(1)).alias("df")))
    rarest = top_n_per_group(grams.join(df, ["subreddit", "key"], "left").withColumn("df", F.coalesce("df", F.lit(0))),
                             search, [F.col("df").asc(), F.col("key").asc()], 1)
    return wanted.join(rarest.select(*search, "key"), search, "left")


def candidates(docs: DataFrame, tasks: DataFrame, kinds: tuple[str, ...] | None = ("post",)) -> DataFrame:
    """(id, subreddit, created_at, __tm_text, product, keyword, p, k): the posts that hold a search's rarest trigram.

    Every post that a search finds is among them, since it holds all of the
    search's trigrams.  A post takes part with its distinct trigrams; only
    those that are some search's key meet it, so a post is held against the
    searches whose rarest trigram it has, not against all of its subreddit.
    Searches too short for a trigram meet every post of their subreddit.
    ``kinds``: the data types that are searched, or None for every record.
    """
    posts = docs if kinds is None else docs.where(F.col("data_type").isin(*kinds))
    posts = posts.select("id", "subreddit", "created_at", F.lower("content").alias("__tm_text"))
    wanted = materialize(tasks.select("subreddit", "product", "keyword").distinct()
                         .withColumn("p", F.lower("product")).withColumn("k", F.lower("keyword")))
    keyed = materialize(_keyed(wanted, posts))
    # broadcast within a byte bound: posts are then not shuffled, and a hot subreddit stays spread over tasks;
    # above it the joins shuffle and a hot key is split by AQE
    found = (posts.withColumn("key", F.explode(trigrams(F.col("__tm_text"))))
             .join(small_side(keyed.where("key is not null")), ["subreddit", "key"]).drop("key"))
    short = posts.join(small_side(keyed.where("key is null").drop("key")), "subreddit")
    return found.unionByName(short)


def keyword_match(docs: DataFrame, tasks: DataFrame, per_search: int = SEARCH_PAGE,
                  kinds: tuple[str, ...] | None = ("post",)) -> DataFrame:
    """The searches of a task grid: which posts every ("product" AND keyword) finds in its subreddit.

    ``tasks`` = (product, subreddit, keyword), as ``search_grid`` gives them.  A
    search returns records of ``kinds`` (``data_type``): posts alone, as the
    scraper's search does, or with None all records, comments too.  A record is found
    when its text contains the product's name and the keyword, whatever their
    case; the newest ``per_search`` of each task are kept.  Returns (product,
    subreddit, keyword, id, created_at, search_rank), product being the one
    searched for; other columns join back on ``id``.

    Each search is keyed by its rarest trigram (``candidates``), and only the
    posts with that trigram are tested for the whole product and keyword.
    """
    text = F.col("__tm_text")
    found = (candidates(docs, tasks, kinds).where(text.contains(F.col("p")) & text.contains(F.col("k")))
             .select("product", "subreddit", "keyword", "id", "created_at"))
    return top_n_per_group(found, ["product", "subreddit", "keyword"],
                           [F.col("created_at").desc(), F.col("id").asc()], per_search,
                           rank_col="search_rank")


def dedup_raw(records: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """One record per key: the one with the greatest ``order`` tuple.

    A grouped top-1: the partial limit keeps one row per key and task before
    the shuffle.  Records with equal ``order`` are told apart by their other
    columns (maps as text).
    """
    rest = [F.to_json(c).desc() if kind.startswith("map") else F.col(c).desc()
            for c, kind in records.dtypes if c not in order]
    return top_n_per_group(records.withColumn("__tm_key", key), ["__tm_key"],
                           [F.col(c).desc() for c in order] + rest, 1).drop("__tm_key")


def discover_communities(communities: DataFrame, topics: DataFrame,
                         top: int = TOP_COMMUNITIES,
                         min_subscribers: int = MIN_SUBSCRIBERS,
                         search_results: int = SEARCH_RESULTS) -> DataFrame:
    """Top communities per topic by subscribers (ties keep search rank).

    ``communities`` are search results (topic, display_name, subscribers,
    search_rank); a search returns only the first ``search_results`` by
    rank, and only those are filtered and ranked.  Topics without any
    community above the threshold get the defaults.
    """
    norm = F.lower(F.trim(F.col("topic")))
    returned = top_n_per_group(communities.withColumn("topic", norm), ["topic"],
                               [F.col("search_rank").asc()], search_results)
    c = returned.where((F.coalesce(F.col("display_name"), F.lit("")) != "")
                       & (F.col("subscribers") > min_subscribers))
    hits = (top_n_per_group(c, ["topic"],
                            [F.col("subscribers").desc(), F.col("search_rank").asc()],
                            top, rank_col="rank")
            .select("topic", "rank", "display_name", "subscribers",
                    F.lit(False).alias("is_default")))
    t = topics.select(norm.alias("topic")).distinct()
    missing = t.join(hits.select("topic").distinct(), "topic", "left_anti")
    defaults = (missing.select("topic", F.posexplode(F.array(*[F.lit(x) for x in DEFAULT_COMMUNITIES]))
                               .alias("pos", "display_name"))
                .select("topic", (F.col("pos") + 1).alias("rank"), "display_name",
                        F.lit(None).cast("long").alias("subscribers"),
                        F.lit(True).alias("is_default")))
    return hits.unionByName(defaults)
