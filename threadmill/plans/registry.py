"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame`` plus oracles.

Each query reads the driver's whole tables through the adapters and runs one
operator (or a short chain) of the engine.  Array results are rendered as
joined text and maps as scalar columns so the oracle comparison is exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scoring
from ..operators.rank import map_tasks
from ..sources import adapters as A
from . import oracle as O
from ..session import materialize, scratch_path, stored_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Every capped operator is registered with its default cap.  At sf0.01 a product
# has about 46 model-ready rows, so a second entry (``..._cut``) with this
# smaller cap lets the oracle check the cut itself.
READY_CUT = 20


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------------------
# text, questions, metrics
# ---------------------------------------------------------------------------

@register("product_slug", O.with_("""
parts AS (SELECT p_partkey AS id, p_name AS name FROM part)""") + """
SELECT id, name, lower(replace(name, ' ', '_')) AS slug,
       lower(replace(regexp_replace(name, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'),
                     ' ', '_')) AS slug_stripped
FROM parts""")
def q_product_slug(spark, d):
    p = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return p.select("id", "name", T.product_slug("name").alias("slug"),
                    T.product_slug("name", strip=True).alias("slug_stripped"))


@register("clean_text", O.with_(O.SOCIAL, O.CLEANED) + """
SELECT id, product, content_cleaned, CAST(length(content_cleaned) AS INTEGER) AS content_length
FROM cleaned""")
def q_clean_text(spark, d):
    c = scoring.clean(A.social(spark, d))
    return c.select("id", "product", "content_cleaned",
                    F.length("content_cleaned").alias("content_length"))


@register("sentences", O.with_(O.SOCIAL, O.CLEANED) + f"""
SELECT id, pos, sentence FROM (
  SELECT id, unnest(generate_series(0, len(l) - 1)) AS pos, unnest(l) AS sentence
  FROM (SELECT id, {O.sentences_sql('content_cleaned')} AS l FROM cleaned))
WHERE sentence <> ''""")
def q_sentences(spark, d):
    c = scoring.clean(A.social(spark, d))
    return (c.select("id", F.posexplode(T.sentences("content_cleaned")).alias("pos", "sentence"))
             .where(F.col("sentence") != "")
             .select("id", F.col("pos").cast("long").alias("pos"), "sentence"))


@register("extract_questions", O.BASE + """
SELECT id, CAST(len(extracted_questions) AS INTEGER) AS n_questions,
       array_to_string(extracted_questions, '|') AS questions
FROM scored""")
def q_extract_questions(spark, d):
    s = scoring.with_questions(scoring.clean(A.social(spark, d)))
    return s.select("id", F.size("extracted_questions").alias("n_questions"),
                    T.join_list("extracted_questions").alias("questions"))


@register("question_rows", O.BASE + """
SELECT id, pos, question FROM (
  SELECT id, unnest(generate_series(0, len(extracted_questions) - 1)) AS pos,
         unnest(extracted_questions) AS question
  FROM scored)""")
def q_question_rows(spark, d):
    s = scoring.with_questions(scoring.clean(A.social(spark, d)))
    return s.select("id", F.posexplode("extracted_questions").alias("pos", "question")) \
            .select("id", F.col("pos").cast("long").alias("pos"), "question")


@register("content_metrics", O.BASE + """
SELECT id, product, data_type, score, relevance_score, content_length, has_question FROM scored""")
def q_content_metrics(spark, d):
    s = scoring.process(A.social(spark, d))
    return s.select("id", "product", "data_type", "score", "relevance_score",
                    "content_length", "has_question")


READY_OUT = """id, product, content, array_to_string(extracted_questions, '|') AS questions,
       relevance_score, data_type, source_url, engagement_score"""


def _ready_out(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("id", "product", "content",
                     T.join_list("extracted_questions").alias("questions"),
                     "relevance_score", "data_type", "source_url", "engagement_score", *extra)


def _faq_ready_sql(cap: int) -> str:
    return O.BASE[:-1] + "," + O.ranked_ready(cap) + f"""
SELECT {READY_OUT}, CAST(rank AS INTEGER) AS rank FROM ranked"""


@register("faq_ready", _faq_ready_sql(scoring.FAQ_READY_CAP))
def q_faq_ready(spark, d):
    s = scoring.process(A.social(spark, d))
    return _ready_out(scoring.faq_ready(s, rank_col="rank"), "rank")


@register("faq_ready_cut", _faq_ready_sql(READY_CUT))
def q_faq_ready_cut(spark, d):
    s = scoring.process(A.social(spark, d))
    return _ready_out(scoring.faq_ready(s, cap=READY_CUT, rank_col="rank"), "rank")


LOOKUP_PRODUCT = "src3"


@register("faq_ready_single", O.BASE + f"""
SELECT {READY_OUT} FROM ready WHERE product = '{LOOKUP_PRODUCT}'
ORDER BY relevance_score DESC NULLS LAST, id LIMIT 500""")
def q_faq_ready_single(spark, d):
    s = scoring.process(A.social(spark, d))
    return _ready_out(scoring.faq_ready_single(s, LOOKUP_PRODUCT))


@register("run_summary", O.with_(O.SOCIAL) + f"""
, flags AS (
  SELECT product, length(cc) > 20 AS kept,
         len({O.questions_sql('cc')}) > 0 AS has_q,
         (CAST(score AS BIGINT) + 1) * CASE WHEN data_type = 'post' THEN 2 ELSE 1 END AS rel
  FROM (SELECT *, {O.clean_sql('content')} AS cc FROM social))
SELECT product, count(*) AS total_records,
       count(*) FILTER (WHERE kept) AS cleaned_records,
       count(*) FILTER (WHERE kept AND has_q) AS question_records,
       least(count(*) FILTER (WHERE kept AND (rel > 1 OR has_q)), 500) AS processed_records
FROM flags GROUP BY product""")
def q_run_summary(spark, d):
    return scoring.run_summary(A.social(spark, d))


# ---------------------------------------------------------------------------
# ingest: listings, grid, matches, dedup, communities
# ---------------------------------------------------------------------------

from ..operators import ingest as I  # noqa: E402

POSTS_OUT = ["post_id", "source", "product", "data_type", "content", "title", "author", "score",
             "url", "subreddit", "created_at"]


def _posts(spark, d):
    return I.normalize_posts(A.post_listings(spark, d))


def _comments(spark, d):
    return I.normalize_comments(A.comment_listings(spark, d), _posts(spark, d))


@register("normalize_posts", O.with_(O.THREAD_POSTS, O.NPOSTS) + """
SELECT * FROM nposts""")
def q_normalize_posts(spark, d):
    p = _posts(spark, d)
    return p.select(*POSTS_OUT, F.col("metadata")["num_comments"].alias("num_comments"),
                    F.col("metadata")["keyword"].alias("keyword"))


@register("normalize_comments", O.with_(O.THREAD_POSTS, O.NPOSTS, O.THREAD_COMMENTS, O.NCOMMENTS) + """
SELECT * FROM ncomments""")
def q_normalize_comments(spark, d):
    c = _comments(spark, d)
    return c.select("comment_id", "post_id", "source", "product", "data_type", "content", "author",
                    "score", "url", "subreddit", "created_at",
                    F.col("metadata")["parent_id"].alias("parent_id"))


def _post_comments_sql(least: int, per_post: int) -> str:
    return O.with_(O.THREAD_POSTS, O.NPOSTS, O.THREAD_COMMENTS, O.NCOMMENTS) + f"""
SELECT post_id, comment_id, score,
       CAST(row_number() OVER (PARTITION BY post_id ORDER BY score DESC NULLS LAST, comment_id)
            AS INTEGER) AS comment_rank
FROM ncomments WHERE post_id IN (SELECT post_id FROM nposts WHERE CAST(num_comments AS INTEGER) > {least})
QUALIFY comment_rank <= {per_post}"""


def _post_comments(spark, d, **caps):
    posts = materialize(_posts(spark, d))      # two branches read the posts
    pc = I.post_comments(posts, I.normalize_comments(A.comment_listings(spark, d), posts), **caps)
    return pc.select("post_id", "comment_id", "score", "comment_rank")


@register("post_comments", _post_comments_sql(I.MIN_COMMENTS, I.COMMENTS_PER_POST))
def q_post_comments(spark, d):
    return _post_comments(spark, d)


@register("post_comments_cut", _post_comments_sql(2, 3))
def q_post_comments_cut(spark, d):
    return _post_comments(spark, d, min_comments=2, per_post=3)


@register("search_grid", O.with_(O.PRODUCTS) + """
, g AS (
  SELECT id AS product_id, name AS product,
         CASE WHEN coalesce(len(subreddits), -1) > 0 THEN subreddits
              ELSE ['technology', 'gadgets', 'samsung', 'Android', 'samsunggalaxy'] END AS subs,
         CASE WHEN coalesce(len(keywords), -1) > 0 THEN keywords
              ELSE ['review', 'problem', 'issue', 'help', 'question', 'experience', 'opinion'] END AS kws
  FROM products),
s1 AS (SELECT product_id, product, kws, unnest(generate_series(0, len(subs) - 1)) AS sub_pos,
              unnest(subs) AS subreddit FROM g),
s2 AS (SELECT product_id, product, sub_pos, subreddit,
              unnest(generate_series(0, len(kws) - 1)) AS kw_pos, unnest(kws) AS keyword FROM s1)
SELECT *, '"' || product || '" AND ' || keyword AS search_query,
       replace(url_encode('"' || product || '" AND ' || keyword), '%20', '+') AS query_escaped
FROM s2""")
def q_search_grid(spark, d):
    g = I.search_grid(A.products(spark, d))
    return g.select("product_id", "product", F.col("sub_pos").cast("long").alias("sub_pos"),
                    "subreddit", F.col("kw_pos").cast("long").alias("kw_pos"), "keyword",
                    "search_query", "query_escaped")


def _keyword_match(spark, d, **caps):
    tasks = I.search_grid(A.searched_products(spark, d))
    m = I.keyword_match(A.social(spark, d), tasks, kinds=None, **caps)  # posts and comments
    return m.select("product", "subreddit", "keyword", "id", "created_at", "search_rank")


def _keyword_match_sql(cap: int) -> str:
    return O.with_(O.SOCIAL, O.TASKS, O.matches(cap)) + """
SELECT product, subreddit, keyword, id, created_at, search_rank FROM matches"""


@register("keyword_match", _keyword_match_sql(I.SEARCH_PAGE))
def q_keyword_match(spark, d):
    return _keyword_match(spark, d)


@register("keyword_match_cut", _keyword_match_sql(5))
def q_keyword_match_cut(spark, d):
    return _keyword_match(spark, d, per_search=5)


@register("dedup_raw", O.with_(O.THREAD_POSTS, O.NPOSTS, O.THREAD_COMMENTS, O.NCOMMENTS) + """
, recs AS (SELECT post_id, CAST(NULL AS VARCHAR) AS comment_id, product, content, created_at FROM nposts
           UNION ALL SELECT post_id, comment_id, product, content, created_at FROM ncomments),
scraped AS (SELECT *, created_at AS scraped_at FROM recs
            UNION ALL SELECT post_id, comment_id, product, content || ' (edited)', created_at,
                             '2031' || substr(created_at, 5) FROM recs WHERE product <> 'prod1')
SELECT post_id, comment_id, product, content, scraped_at FROM scraped
QUALIFY row_number() OVER (PARTITION BY coalesce(comment_id, post_id) ORDER BY scraped_at DESC) = 1""")
def q_dedup_raw(spark, d):
    """Posts and comments as two scrapes found them: the newest copy of each."""
    posts = materialize(_posts(spark, d))
    comments = I.normalize_comments(A.comment_listings(spark, d), posts)
    cols = ["post_id", "comment_id", "product", "content", "created_at"]
    recs = (posts.withColumn("comment_id", F.lit(None).cast("string")).select(*cols)
                 .unionByName(comments.select(*cols)))
    again = (recs.where("product <> 'prod1'")
                 .withColumn("content", F.concat("content", F.lit(" (edited)")))
                 .withColumn("scraped_at", F.concat(F.lit("2031"), F.substring("created_at", 5, 99))))
    scraped = recs.withColumn("scraped_at", F.col("created_at")).unionByName(again)
    return I.dedup_raw(scraped, F.coalesce("comment_id", "post_id"), ["scraped_at"]) \
            .select("post_id", "comment_id", "product", "content", "scraped_at")


@register("discover_communities", O.with_(O.COMMUNITIES) + """
, hits AS (
  SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY subscribers DESC, search_rank)
                     AS INTEGER) AS rank,
         display_name, subscribers, false AS is_default
  FROM (SELECT * FROM comm QUALIFY row_number() OVER (PARTITION BY topic ORDER BY search_rank) <= 10)
  WHERE coalesce(display_name, '') <> '' AND subscribers > 1000 QUALIFY rank <= 3),
t AS (SELECT DISTINCT lower(trim(n_name)) AS topic FROM nation)
SELECT * FROM hits
UNION ALL
SELECT t.topic, d.rank, d.display_name, CAST(NULL AS BIGINT), true
FROM t, (VALUES (1, 'technology'), (2, 'gadgets')) d(rank, display_name)
WHERE t.topic NOT IN (SELECT topic FROM hits)""")
def q_discover_communities(spark, d):
    return I.discover_communities(A.communities(spark, d), A.topics(spark, d))


# ---------------------------------------------------------------------------
# contexts, prompts, responses, documents
# ---------------------------------------------------------------------------

from ..operators import inference as INF  # noqa: E402
from ..operators import prompts as P  # noqa: E402
from ..operators import responses as R  # noqa: E402
from ..operators import store as SO  # noqa: E402

CONTEXT_CUT = 10
CUT_ITEMS = {"large": 10, "small": 5}
SEARCH_TERM = "what"


def _ranked(spark, d, cap=P.CONTEXT_CAP):
    return scoring.faq_ready(scoring.process(A.social(spark, d)), cap=cap, rank_col="rank")


def _responses(spark, d, ranked=None):
    """Stand-in for the model's output table: like real model output it is
    stored once (checkpoint) and every parsing branch reads that copy."""
    ranked = ranked if ranked is not None else _ranked(spark, d)
    return materialize(A.model_responses(ranked))


def _entries(spark, d):
    return R.parse_responses(_responses(spark, d))


def _documents(spark, d, at: str = "2024-06-01 00:00:00", flip: bool = False,
               ranked=None, responses=None):
    """Contexts -> responses -> entries -> chosen provider -> documents.

    One ranked-context DataFrame feeds every branch, cut once with a
    checkpoint so the scan and the cleaning run once; callers producing
    several document versions pass the same ``ranked`` and ``responses``.
    """
    ranked = ranked if ranked is not None else materialize(_ranked(spark, d))
    responses = responses if responses is not None else _responses(spark, d, ranked)
    if flip:   # a second run that prefers the other provider
        responses = responses.withColumn("priority", 3 - F.col("priority"))
    entries = materialize(R.parse_responses(responses))     # used by two branches
    chosen = R.provider_fallback(entries, responses)
    counts = ranked.groupBy("product").agg(F.count(F.lit(1)).alias("source_count"))
    return R.faq_documents(entries, chosen, P.context_sources(ranked), counts,
                           generated_at=F.lit(at).cast("timestamp_ntz"))


@register("context_top200", O.BASE[:-1] + "," + O.ctx(P.CONTEXT_CAP) + """
SELECT product, rank, id, relevance_score FROM ctx""")
def q_context_top200(spark, d):
    ready = scoring.model_ready(scoring.process(A.social(spark, d)))
    return P.ranked_context(ready).select("product", "rank", "id", "relevance_score")


@register("context_cut", O.BASE[:-1] + "," + O.ctx(CONTEXT_CUT) + """
SELECT product, rank, id, relevance_score FROM ctx""")
def q_context_cut(spark, d):
    ready = scoring.model_ready(scoring.process(A.social(spark, d)))
    return P.ranked_context(ready, CONTEXT_CUT).select("product", "rank", "id", "relevance_score")


@register("context_with_fallback", O.BASE[:-1] + "," + O.ctx(500, "r500") + """,
traw AS (
  SELECT conv_id * 1000 + turn AS id, 'prod' || CAST(conv_id % 5 AS VARCHAR) AS product,
         text AS content, CASE WHEN turn = 0 THEN text END AS title,
         CAST((conv_id * 31 + turn * 7) % 40 - 5 AS INTEGER) AS score,
         'https://example.org/t/' || CAST(conv_id AS VARCHAR) AS url
  FROM conversations),
rawall AS (SELECT id, product, content, title, score, url FROM social
           UNION ALL SELECT * FROM traw)
SELECT product, id, 'processed' AS origin, content, relevance_score, source_url,
       array_to_string(extracted_questions, '|') AS questions
FROM r500
UNION ALL
SELECT product, id, 'raw', coalesce(content, title, ''), CAST(score AS BIGINT), coalesce(url, ''), ''
FROM rawall WHERE product NOT IN (SELECT product FROM r500)""")
def q_context_with_fallback(spark, d):
    s = scoring.process(A.social(spark, d))
    processed = scoring.faq_ready(s, cap=500)
    raw = A.social(spark, d).unionByName(A.thread_records(spark, d))
    ctx = P.raw_fallback(processed, raw)
    return ctx.select("product", "id", "origin", "content", "relevance_score", "source_url",
                      T.join_list("extracted_questions").alias("questions"))


@register("prompt_context_large", O.BASE[:-1] + "," + O.ctx(200) + "\n"
          + O.context_agg(O.item_large(), P.LARGE.max_items))
def q_prompt_context_large(spark, d):
    return P.prompt_context(_ranked(spark, d), P.LARGE)


@register("prompt_context_small", O.BASE[:-1] + "," + O.ctx(200) + "\n"
          + O.context_agg(O.item_small(), P.SMALL.max_items))
def q_prompt_context_small(spark, d):
    return P.prompt_context(_ranked(spark, d), P.SMALL)


def _prompts_sql(large: int, small: int) -> str:
    return (O.BASE[:-1] + "," + O.ctx(200)
            + ",\npl AS (" + O.context_agg(O.item_large(), large) + ")"
            + ",\nps AS (" + O.context_agg(O.item_small(), small) + ")"
            + ",\nprompts AS (SELECT product, 'large' AS provider, 1 AS priority, n_items, "
            + O.template_sql(P.LARGE_TEMPLATE, "product", "context") + " AS prompt FROM pl"
            + "\nUNION ALL SELECT product, 'small', 2, n_items, "
            + O.template_sql(P.SMALL_TEMPLATE, "product", "context") + " FROM ps)\n")


PROMPTS_SQL = _prompts_sql(P.LARGE.max_items, P.SMALL.max_items)


@register("prompts", PROMPTS_SQL + "SELECT * FROM prompts")
def q_prompts(spark, d):
    return P.prompts(_ranked(spark, d))


@register("prompts_cut", _prompts_sql(CUT_ITEMS["large"], CUT_ITEMS["small"]) + "SELECT * FROM prompts")
def q_prompts_cut(spark, d):
    return P.prompts(_ranked(spark, d), max_items=CUT_ITEMS)


@register("context_sources", O.BASE[:-1] + "," + O.ctx(200) + "," + O.sources_sql() + """
SELECT product, provider, coalesce(sources, '') AS sources FROM srcs""")
def q_context_sources(spark, d):
    s = P.context_sources(_ranked(spark, d))
    return s.select("product", "provider", T.join_list("sources").alias("sources"))


@register("batch_inference", PROMPTS_SQL + """
SELECT product, provider, priority,
       'Q: What do users ask about ' || product || '?' || chr(10) || 'A: '
       || CAST(length(prompt) AS VARCHAR) || ' characters of context were reviewed.' AS response
FROM prompts""")
def q_batch_inference(spark, d):
    pr = P.prompts(_ranked(spark, d))
    return INF.batch_inference(pr, INF.echo_model())


@register("staged_inference", PROMPTS_SQL + """
, answered AS (
  SELECT *, CASE WHEN provider = 'large' THEN length(prompt) % 2 = 0 ELSE length(prompt) % 3 > 0 END AS usable
  FROM prompts),
large AS (SELECT * FROM answered WHERE provider = 'large'),
asked AS (SELECT * FROM large UNION ALL
          SELECT * FROM answered WHERE provider = 'small' AND product NOT IN (SELECT product FROM large WHERE usable))
SELECT product, provider, priority, false AS was_kept, true AS kept_again,
       CASE WHEN usable THEN 1 ELSE 0 END::BIGINT AS n_entries,
       CASE WHEN usable AND provider = 'large' THEN 'How about ' || product || '?'
            WHEN usable THEN 'What of ' || product || '?' END AS question
FROM asked""")
def q_staged_inference(spark, d):
    """Whom each product was asked of in a first run, and whether a second run finds the answer kept."""
    pr = materialize(P.prompts(_ranked(spark, d)))
    path = scratch_path(spark, "responses")
    responses, entries = INF.staged_inference(pr, INF.length_models(), R.parse_responses, path)
    again, _ = INF.staged_inference(pr, INF.length_models(), R.parse_responses, path)
    counts = entries.groupBy("product", "provider").agg(F.count(F.lit(1)).alias("n"),
                                                        F.min("question").alias("question"))
    keys = ["product", "provider"]
    return (responses.join(again.select(*keys, F.col("was_kept").alias("kept_again")), keys)
            .join(counts, keys, "left")
            .select(*keys, "priority", "was_kept", "kept_again",
                    F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"), "question"))


ENTRY_COLS = ["product", "provider", "priority", "entry_pos", "question", "answer", "category",
              "confidence"]

RESP_BASE = O.BASE[:-1] + "," + O.ctx(200, "ctx200") + "," + O.RESPONSES + ","


@register("parse_responses", RESP_BASE + O.parse_sql() + """
SELECT * FROM entries""")
def q_parse_responses(spark, d):
    e = _entries(spark, d)
    return e.select(*ENTRY_COLS, T.join_list("keywords").alias("keywords"), "method")


@register("parse_qa_lines", RESP_BASE + O.qa_lines_sql("resp", "lall")[:-1] + """
SELECT product, provider, priority, entry_pos, question, answer FROM lall""")
def q_parse_qa_lines(spark, d):
    e = R.parse_qa_lines(_responses(spark, d))
    return e.select("product", "provider", "priority", "entry_pos", "question", "answer")


@register("provider_fallback", RESP_BASE + O.parse_sql() + "," + O.CHOSEN + """
SELECT * FROM chosen""")
def q_provider_fallback(spark, d):
    responses = _responses(spark, d)
    return R.provider_fallback(R.parse_responses(responses), responses)


DOCS_SQL = (RESP_BASE + O.parse_sql() + "," + O.CHOSEN + "," + O.ctx(200) + "," + O.sources_sql()
            + "," + O.DOC_ENTRIES + """,
docs AS (
  SELECT d.product, d.provider AS model_used, n.source_count, count(*) AS faq_count,
         string_agg(d.question, chr(10) ORDER BY d.entry_pos) AS questions,
         arg_min(d.sources, d.entry_pos) AS first_sources
  FROM dentries d JOIN (SELECT product, count(*) AS source_count FROM ctx GROUP BY product) n
       USING (product)
  GROUP BY d.product, d.provider, n.source_count),
fentries AS (
  SELECT product, CAST(row_number() OVER (PARTITION BY product ORDER BY entry_pos) - 1 AS INTEGER)
           AS entry_pos, question, answer, category, confidence, sources
  FROM dentries)
""")


@register("faq_documents", DOCS_SQL + "SELECT * FROM docs")
def q_faq_documents(spark, d):
    docs = _documents(spark, d)
    return docs.select("product", "model_used", "source_count",
                       F.size("faqs").cast("long").alias("faq_count"),
                       F.array_join(F.transform("faqs", lambda x: x["question"]), "\n")
                       .alias("questions"),
                       F.coalesce(F.array_join(F.get("faqs", 0)["sources"], "|"), F.lit(""))
                       .alias("first_sources"))


@register("faq_report", DOCS_SQL + """
SELECT product, entry_pos, question, category, CAST(round(confidence * 100) AS INTEGER)
       AS confidence_pct, substr(answer, 1, 200) AS answer_preview,
       array_to_string((string_split(sources, '|'))[1:2], '|') AS shown_sources
FROM fentries""")
def q_faq_report(spark, d):
    r = R.faq_report(R.faq_entries(_documents(spark, d)))
    return r.select("product", "entry_pos", "question", "category", "confidence_pct",
                    "answer_preview", T.join_list("shown_sources").alias("shown_sources"))


@register("faq_search", DOCS_SQL + f"""
SELECT product, entry_pos, question FROM fentries
WHERE contains(lower(question), '{SEARCH_TERM}') OR contains(lower(answer), '{SEARCH_TERM}')
   OR contains(lower(category), '{SEARCH_TERM}')""")
def q_faq_search(spark, d):
    """A search through the text index."""
    root = scratch_path(spark, "entry_index")
    SO.write_entry_index(R.faq_entries(_documents(spark, d)), root)
    return SO.search_index(spark, root, SEARCH_TERM).select("product", "entry_pos", "question")


@register("faq_lookup", DOCS_SQL + f"""
SELECT product, entry_pos, question, answer, category, confidence FROM fentries
WHERE product = '{LOOKUP_PRODUCT}'""")
def q_faq_lookup(spark, d):
    """One product's entries, read from its bucket of the stored documents."""
    root = scratch_path(spark, "documents")
    SO.upsert_documents(_documents(spark, d), root)
    e = R.faq_entries(SO.read_documents(spark, root, LOOKUP_PRODUCT))
    return e.select("product", "entry_pos", "question", "answer", "category", "confidence")


@register("faq_list", DOCS_SQL + "SELECT product, model_used, source_count, faq_count FROM docs")
def q_faq_list(spark, d):
    return R.faq_list(_documents(spark, d)).select(
        "product", "model_used", "source_count", F.col("faq_count").cast("long").alias("faq_count"))


# ---------------------------------------------------------------------------
# queue and table maintenance
# ---------------------------------------------------------------------------

from ..operators import tables as TB  # noqa: E402
from ..sources import queue as QU  # noqa: E402

GEN_AT = "2024-06-01 00:00:00"
REGEN_AT = "2024-07-01 00:00:00"


def _ntz(s: str):
    return F.lit(s).cast("timestamp_ntz")


def _docs_at(spark, d, at: str, flip: bool = False):
    return _documents(spark, d, at, flip)


@register("queue_encode", O.with_(O.SOCIAL, O.QUEUE_RECORDS) + """
SELECT product AS key, id, source, product, data_type, score, url, title, content,
       CAST(id AS VARCHAR) AS json_id, content AS json_content, product AS json_product FROM qrec""")
def q_queue_encode(spark, d):
    """The record read back from each message, and fields looked up in its JSON text itself."""
    m = QU.decode(QU.encode(A.queue_records(spark, d)))
    return m.select("key", *[F.col(f"r.{c}").alias(c) for c in
                             ("id", "source", "product", "data_type", "score", "url", "title",
                              "content")],
                    *[F.get_json_object("value", f"$.{c}").alias(f"json_{c}")
                      for c in ("id", "content", "product")])


@register("queue_decode", O.with_(O.SOCIAL, O.QUEUE_RECORDS) + """
SELECT id, coalesce(source, 'unknown') AS source, coalesce(product, 'unknown') AS product,
       data_type, score, url, content
FROM qrec WHERE id % 50 <> 0""")
def q_queue_decode(spark, d):
    g = QU.good_records(QU.decode(A.queue_messages(spark, d)))
    return g.select("id", "source", "product", "data_type", "score", "url", "content")


@register("landing_groups", O.with_(O.SOCIAL, O.QUEUE_RECORDS) + """
SELECT coalesce(source, 'unknown') AS source, coalesce(product, 'unknown') AS product,
       count(*) AS n_records
FROM qrec WHERE id % 50 <> 0 GROUP BY ALL""")
def q_landing_groups(spark, d):
    return QU.landing_groups(QU.good_records(QU.decode(A.queue_messages(spark, d))))


@register("status_counts", DOCS_SQL.replace("WITH ", "WITH " + O.PRODUCTS.strip() + ",\n", 1) + """
SELECT (SELECT count(*) FROM products) AS total_products,
       (SELECT count(*) FROM docs) AS total_faq_documents,
       count(*) FILTER (WHERE status = 'pending') AS pending,
       count(*) FILTER (WHERE status = 'scraping') AS scraping,
       count(*) FILTER (WHERE status = 'processing') AS processing,
       count(*) FILTER (WHERE status = 'generating') AS generating,
       count(*) FILTER (WHERE status = 'completed') AS completed,
       count(*) FILTER (WHERE status = 'error') AS error,
       count(*) FILTER (WHERE status NOT IN ('pending', 'scraping', 'processing', 'generating',
                                             'completed', 'error')) AS other,
       count(*) FILTER (WHERE status IN ('scraping', 'processing', 'generating')) AS in_progress
FROM products""")
def q_status_counts(spark, d):
    return TB.status_counts(A.products(spark, d), _documents(spark, d))


@register("product_faq_counts", DOCS_SQL.replace("WITH ", "WITH " + O.SOCIAL_PRODUCTS.strip() + ",\n", 1)
          + f"""
SELECT p.id, p.name, CAST(coalesce(d.faq_count, 0) AS INTEGER) AS faq_count,
       CASE WHEN d.product IS NOT NULL THEN '{GEN_AT}' END AS last_processed
FROM sprod p LEFT JOIN docs d ON d.product = p.name""")
def q_product_faq_counts(spark, d):
    docs = _docs_at(spark, d, GEN_AT)
    p = TB.product_faq_counts(A.social_products(spark, d), docs)
    return p.select("id", "name", F.col("faq_count").cast("int").alias("faq_count"),
                    F.date_format("last_processed", "yyyy-MM-dd HH:mm:ss").alias("last_processed"))


@register("product_page", O.with_(O.PRODUCTS) + """
SELECT CAST(id AS VARCHAR) AS id, name, status,
       strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM products ORDER BY created_at DESC, products.id LIMIT 50 OFFSET 10""")
def q_product_page(spark, d):
    pg = TB.product_page(A.products(spark, d), skip=10, limit=50)
    return pg.select("id", "name", "status",
                     F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@register("product_pages", O.with_(O.PRODUCTS) + """
SELECT CAST(id AS VARCHAR) AS id, name, status,
       strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM products ORDER BY created_at DESC, products.id LIMIT 60 OFFSET 75""")
def q_product_pages(spark, d):
    """A deep page, read from the ranges it lies in."""
    root = scratch_path(spark, "pages")
    SO.write_pages(A.products(spark, d), root, range_rows=20)
    return SO.read_page(spark, root, skip=75, limit=60).select(
        "id", "name", "status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@register("insert_new_products", O.with_(O.PRODUCTS, O.COMMUNITIES) + """
, req AS (
  SELECT c_name AS name, c_custkey AS request_pos,
         ['sub' || CAST(c_nationkey AS VARCHAR)] AS subreddits, CAST(NULL AS VARCHAR[]) AS keywords,
         true AS auto_discover
  FROM customer
  UNION ALL
  SELECT s_name, 100000 + s_suppkey,
         CASE WHEN s_suppkey % 3 = 0 THEN []::VARCHAR[]
              ELSE ['sub' || CAST(s_nationkey AS VARCHAR)] END,
         CASE WHEN s_suppkey % 4 = 0 THEN []::VARCHAR[] END, NULL
  FROM supplier
  UNION ALL
  SELECT n_name, 200000 + n_nationkey, CAST(NULL AS VARCHAR[]), CAST(NULL AS VARCHAR[]),
         n_nationkey % 2 = 0
  FROM nation),
firsts AS (SELECT * FROM req QUALIFY row_number() OVER (PARTITION BY name ORDER BY request_pos) = 1),
fresh AS (SELECT * FROM firsts WHERE name NOT IN (SELECT name FROM products)),
topics AS (SELECT DISTINCT lower(trim(name)) AS topic FROM fresh
           WHERE coalesce(len(subreddits), -1) <= 0),
hits AS (
  SELECT topic, display_name,
         row_number() OVER (PARTITION BY topic ORDER BY subscribers DESC, search_rank) AS rank
  FROM (SELECT * FROM comm QUALIFY row_number() OVER (PARTITION BY topic ORDER BY search_rank) <= 10)
  WHERE coalesce(display_name, '') <> '' AND subscribers > 1000 QUALIFY rank <= 3),
found AS (
  SELECT t.topic, coalesce(list(h.display_name ORDER BY h.rank) FILTER (WHERE h.topic IS NOT NULL),
                           ['technology', 'gadgets']) AS subs
  FROM topics t LEFT JOIN hits h USING (topic) GROUP BY t.topic)
SELECT f.name,
       array_to_string(CASE WHEN coalesce(len(f.subreddits), -1) > 0 THEN f.subreddits
                            WHEN d.subs IS NOT NULL AND coalesce(f.auto_discover, true) THEN d.subs
                            ELSE ['technology', 'gadgets'] END, '|') AS subreddits,
       array_to_string(coalesce(f.keywords, ['review', 'problem', 'help', 'question']), '|')
         AS keywords,
       'pending' AS status, 0 AS faq_count
FROM fresh f LEFT JOIN found d ON d.topic = lower(trim(f.name))""")
def q_insert_new_products(spark, d):
    c = A.table(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.col("c_custkey").alias("request_pos"),
        F.array(F.concat(F.lit("sub"), F.col("c_nationkey").cast("string"))).alias("subreddits"),
        F.lit(None).cast("array<string>").alias("keywords"), F.lit(True).alias("auto_discover"))
    s = A.table(spark, d, "supplier").select(
        F.col("s_name").alias("name"), (F.lit(100000) + F.col("s_suppkey")).alias("request_pos"),
        F.when(F.col("s_suppkey") % 3 == 0, F.array().cast("array<string>"))
         .otherwise(F.array(F.concat(F.lit("sub"), F.col("s_nationkey").cast("string"))))
         .alias("subreddits"),
        F.when(F.col("s_suppkey") % 4 == 0, F.array().cast("array<string>")).alias("keywords"),
        F.lit(None).cast("boolean").alias("auto_discover"))
    n = A.table(spark, d, "nation").select(
        F.col("n_name").alias("name"), (F.lit(200000) + F.col("n_nationkey")).alias("request_pos"),
        F.lit(None).cast("array<string>").alias("subreddits"),
        F.lit(None).cast("array<string>").alias("keywords"),
        (F.col("n_nationkey") % 2 == 0).alias("auto_discover"))
    req = (c.unionByName(s).unionByName(n)
            .withColumn("description", F.lit(None).cast("string"))
            .withColumn("category", F.lit(None).cast("string")))
    existing = A.products(spark, d)
    # communities are discovered for the new names that came without subreddits
    wanting = (req.join(existing.select("name"), "name", "left_anti")
                  .where((F.coalesce(F.size("subreddits"), F.lit(-1)) <= 0)
                         & F.coalesce("auto_discover", F.lit(True)))
                  .select(F.col("name").alias("topic")))
    discovered = I.discover_communities(A.communities(spark, d), wanting)
    new = TB.insert_new_products(existing, req, _ntz(GEN_AT), discovered=discovered)
    return new.select("name", T.join_list("subreddits").alias("subreddits"),
                      T.join_list("keywords").alias("keywords"), "status", "faq_count")


@register("update_products", O.with_(O.PRODUCTS) + """
, ch AS (SELECT s_suppkey AS id, s_name AS name, 'updated' AS description,
                ['sub' || CAST(s_nationkey AS VARCHAR)] AS subreddits, []::VARCHAR[] AS keywords,
                'SUPPLIER' AS category FROM supplier)
SELECT p.id, CASE WHEN c.id IS NULL THEN p.name ELSE c.name END AS name,
       CASE WHEN c.id IS NULL THEN p.description ELSE c.description END AS description,
       array_to_string(CASE WHEN c.id IS NULL THEN p.subreddits ELSE c.subreddits END, '|')
         AS subreddits,
       array_to_string(CASE WHEN c.id IS NULL THEN p.keywords ELSE c.keywords END, '|') AS keywords,
       CASE WHEN c.id IS NULL THEN p.category ELSE c.category END AS category, p.status
FROM products p LEFT JOIN ch c ON c.id = p.id""")
def q_update_products(spark, d):
    s = A.table(spark, d, "supplier")
    ch = s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                  F.lit("updated").alias("description"),
                  F.array(F.concat(F.lit("sub"), F.col("s_nationkey").cast("string")))
                  .alias("subreddits"),
                  F.array().cast("array<string>").alias("keywords"),
                  F.lit("SUPPLIER").alias("category"))
    u = TB.update_products(A.products(spark, d), ch)
    return u.select("id", "name", "description", T.join_list("subreddits").alias("subreddits"),
                    T.join_list("keywords").alias("keywords"), "category", "status")


@register("delete_cascade", DOCS_SQL.replace("WITH ", "WITH " + O.SOCIAL_PRODUCTS.strip() + ",\n", 1)
          + """
SELECT 'product' AS tbl, name AS key FROM sprod WHERE status <> 'error'
UNION ALL
SELECT 'document', product FROM docs
WHERE product NOT IN (SELECT name FROM sprod WHERE status = 'error')""")
def q_delete_cascade(spark, d):
    prods = A.social_products(spark, d)
    deletions = prods.where(F.col("status") == "error").select("id")
    kp, kd = TB.delete_cascade(prods, _documents(spark, d), deletions)
    return (kp.select(F.lit("product").alias("tbl"), F.col("name").alias("key"))
              .unionByName(kd.select(F.lit("document").alias("tbl"), F.col("product").alias("key"))))


@register("product_status", O.with_(O.PRODUCTS, O.RUNS) + """
, latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY product_id
                                                          ORDER BY ts DESC, run_id DESC) = 1),
mapped AS (
  SELECT product_id, ts,
         CASE stage || ':' || outcome
           WHEN 'scrape:ok' THEN 'scraping' WHEN 'scrape:running' THEN 'scraping'
           WHEN 'process:ok' THEN 'processed' WHEN 'process:running' THEN 'processing'
           WHEN 'process:failed' THEN 'processing_failed'
           WHEN 'process:timeout' THEN 'processing_timeout'
           WHEN 'generate:ok' THEN 'completed' WHEN 'generate:running' THEN 'generating'
           WHEN 'generate:failed' THEN 'error'
           WHEN 'full_run:ok' THEN 'pipeline_completed'
           WHEN 'full_run:running' THEN 'pipeline_scraping'
           WHEN 'full_run:failed' THEN 'pipeline_error' END AS run_status
  FROM latest)
SELECT p.id, coalesce(m.run_status, p.status) AS status,
       strftime(m.ts, '%Y-%m-%d %H:%M:%S') AS last_run_at
FROM products p LEFT JOIN mapped m ON m.product_id = p.id""")
def q_product_status(spark, d):
    s = TB.product_status(A.products(spark, d), A.run_log(spark, d))
    return s.select("id", "status",
                    F.date_format("last_run_at", "yyyy-MM-dd HH:mm:ss").alias("last_run_at"))


UPSERT_SQL = (DOCS_SQL + """,
best2 AS (SELECT product, arg_max(provider, priority) AS provider FROM ecounts GROUP BY product),
docs2 AS (
  SELECT e.product, e.provider AS model_used, count(*) AS faq_count
  FROM entries e JOIN best2 b ON b.product = e.product AND b.provider = e.provider
  GROUP BY e.product, e.provider)
SELECT product, model_used, '""" + REGEN_AT + """' AS updated_at, faq_count FROM docs2
UNION ALL
SELECT product, model_used, '""" + GEN_AT + """', faq_count FROM docs
WHERE product NOT IN (SELECT product FROM docs2)""")


@register("faq_upsert", UPSERT_SQL)
def q_faq_upsert(spark, d):
    ranked = materialize(_ranked(spark, d))
    responses = _responses(spark, d, ranked)
    existing = _documents(spark, d, GEN_AT, ranked=ranked, responses=responses)
    incoming = _documents(spark, d, REGEN_AT, flip=True, ranked=ranked, responses=responses)
    root = scratch_path(spark, "documents")
    SO.upsert_documents(existing, root)
    incoming = materialize(incoming)
    for _ in range(2):                          # the same run applied again: no change
        SO.upsert_documents(incoming, root)
    return SO.read_documents(spark, root).select("product", "model_used",
                        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"),
                        F.size("faqs").cast("long").alias("faq_count"))


@register("validate_products", """
SELECT doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS name_length,
       CASE WHEN coalesce(length(text), 0) < 1 THEN 'name empty'
            WHEN length(text) > 200 THEN 'name too long' END AS reason,
       coalesce(length(text), 0) BETWEEN 1 AND 200 AS valid
FROM documents""")
def q_validate_products(spark, d):
    req = A.table(spark, d, "documents").select("doc_id", F.col("text").alias("name"))
    return TB.validate_products(req).select("doc_id", "name_length", "reason", "valid")


# ---------------------------------------------------------------------------
# file sources / sinks and streams (write to a fresh folder, read back)
# ---------------------------------------------------------------------------

from pyspark.sql.types import StringType, StructField, StructType  # noqa: E402

from ..sources import files as FS  # noqa: E402
from ..streaming import landing as ST  # noqa: E402

SLUG_SQL = "lower(replace(product, ' ', '_'))"


RAW_ROWS = O.with_(O.SOCIAL) + f"""
, rows AS (
  SELECT id, CASE WHEN id % 2 = 0 THEN 'forum' ELSE 'reddit' END AS source,
         CASE WHEN n % 5 = 4 OR (id % 7 = 0 AND id % 2 = 1) THEN product || ' ' ELSE product END AS product,
         content
  FROM (SELECT *, coalesce(TRY_CAST(regexp_extract(product, '([0-9]+)$', 1) AS INTEGER), 0) AS n FROM social)),
slugged AS (SELECT *, {SLUG_SQL} AS product_slug,
                   regexp_replace({SLUG_SQL}, '_$', '') AS base FROM rows),
pick AS (SELECT source, base, min(CASE WHEN product_slug = base THEN 0 ELSE 1 END) AS v
         FROM slugged GROUP BY source, base)
SELECT id, source, product, product_slug, content FROM slugged JOIN pick USING (source, base)
WHERE CASE WHEN product_slug = base THEN 0 ELSE 1 END = v"""


def _raw_landing(spark, d) -> str:
    """Two sources; trailing spaces on some products of one and on all rows of others."""
    n, odd = A.product_number("product"), F.col("id") % 2 == 1
    rows = (A.social(spark, d)
            .withColumn("source", F.when(odd, "reddit").otherwise("forum"))
            .withColumn("product", F.when((n % 5 == 4) | ((F.col("id") % 7 == 0) & odd),
                                          F.concat("product", F.lit(" "))).otherwise(F.col("product"))))
    root = scratch_path(spark, "landing")
    FS.write_landing(rows, root)
    return root


@register("raw_scan", RAW_ROWS)
def q_raw_scan(spark, d):
    return FS.raw_scan(spark, _raw_landing(spark, d)).select("id", "source", "product", "product_slug", "content")


@register("raw_scan_source", RAW_ROWS + f" AND source = 'reddit' AND base = '{LOOKUP_PRODUCT}'")
def q_raw_scan_source(spark, d):
    """One product of one source, which has both folder variants."""
    scan = FS.raw_scan(spark, _raw_landing(spark, d), source="reddit", slugs=[LOOKUP_PRODUCT])
    return scan.select("id", "source", "product", "product_slug", "content")


def _first_files_sql(n: int) -> str:
    return O.with_(O.SOCIAL) + f"""
, b AS (SELECT *, {SLUG_SQL} AS product_slug, floor(id / 100) AS flush FROM social),
f AS (SELECT product_slug, flush,
             dense_rank() OVER (PARTITION BY product_slug ORDER BY flush) AS fr
      FROM (SELECT DISTINCT product_slug, flush FROM b))
SELECT b.id, b.product, b.product_slug, b.content FROM b JOIN f USING (product_slug, flush)
WHERE fr <= {n}"""


def _first_files(spark, d, **caps):
    root = scratch_path(spark, "batches")
    FS.write_batch_files(A.social(spark, d), root, flush_size=100)
    return FS.first_n_files(spark, root, **caps).select("id", "product", "product_slug", "content")


@register("first_n_files", _first_files_sql(20))
def q_first_n_files(spark, d):
    return _first_files(spark, d)


@register("first_n_files_cut", _first_files_sql(2))
def q_first_n_files_cut(spark, d):
    return _first_files(spark, d, n=2)


@register("snapshot_roundtrip", O.BASE[:-1] + "," + O.ranked_ready(scoring.FAQ_READY_CAP) + f"""
SELECT {READY_OUT}, CAST(rank AS INTEGER) AS rank, {SLUG_SQL} AS product_slug FROM ranked""")
def q_snapshot_roundtrip(spark, d):
    s = scoring.process(A.social(spark, d))
    run_dir = scratch_path(spark, "processed") + "/20240601_000000"
    FS.write_snapshot(scoring.faq_ready(s, rank_col="rank"), run_dir)
    return _ready_out(FS.read_snapshot(spark, run_dir), "rank", "product_slug")


@register("latest_read", O.BASE[:-1] + "," + O.ranked_ready(scoring.FAQ_READY_CAP) + f"""
SELECT {READY_OUT}, {SLUG_SQL} AS product_slug FROM ranked""")
def q_latest_read(spark, d):
    s = scoring.process(A.social(spark, d))
    path = scratch_path(spark, "processed") + "/latest.json"
    FS.write_latest_json(scoring.faq_ready(s), path)
    return _ready_out(FS.read_latest(spark, path), "product_slug")


def _run_streams(spark, d, clean: bool = False) -> str:
    base = scratch_path(spark, "stream")
    ST.stage_messages(A.queue_messages(spark, d), base + "/inbox")
    msgs = ST.file_queue_source(spark, base + "/inbox")
    ST.run_to_end(ST.start_land(msgs, base + "/landing", base + "/quarantine", base + "/ck_land"))
    if clean:
        landed = ST.landing_stream(spark, base + "/landing")
        ST.run_to_end(ST.start_clean(landed, base + "/clean", base + "/ck_clean"))
    return base


QUEUE_GOOD = O.with_(O.SOCIAL, O.QUEUE_RECORDS) + """
, good AS (SELECT id, coalesce(source, 'unknown') AS source, coalesce(product, 'unknown') AS product,
                  data_type, score, content FROM qrec WHERE id % 50 <> 0)
"""


@register("stream_landing", QUEUE_GOOD + f"""
SELECT id, source, product, {SLUG_SQL} AS product_slug, data_type, score, content FROM good""")
def q_stream_landing(spark, d):
    base = _run_streams(spark, d)
    schema = StructType(FS._landing_schema(FS.RAW_WITH_ID_SCHEMA).fields)
    landed = spark.read.schema(schema).json(base + "/landing")
    return landed.select("id", "source", "product", "product_slug", "data_type", "score", "content")


@register("stream_quarantine", O.with_(O.SOCIAL) + """
SELECT '{"id": ' || CAST(id AS VARCHAR) || ', "source": "reddit", "content": "' AS value
FROM social WHERE id % 50 = 0""")
def q_stream_quarantine(spark, d):
    base = _run_streams(spark, d)
    return spark.read.schema(StructType([StructField("value", StringType())])) \
                .json(base + "/quarantine").select("value")


@register("stream_clean", QUEUE_GOOD + f"""
, c AS (SELECT *, {O.clean_sql('content')} AS cc FROM good)
SELECT id, product,
       CAST((CAST(score AS BIGINT) + 1) * CASE WHEN data_type = 'post' THEN 2 ELSE 1 END AS BIGINT)
         AS relevance_score,
       CAST(length(cc) AS INTEGER) AS content_length,
       len({O.questions_sql('cc')}) > 0 AS has_question
FROM c WHERE length(cc) > 20""")
def q_stream_clean(spark, d):
    base = _run_streams(spark, d, clean=True)
    out = spark.read.parquet(base + "/clean")
    return out.select("id", "product", "relevance_score", "content_length", "has_question")


from ..streaming import flush as FL  # noqa: E402
from ..streaming import topn as TN  # noqa: E402

# the good queue records in place of ``social``: the landed records that streams go on from
LANDED = O.with_(O.SOCIAL.replace("social AS", "social0 AS"), O.QUEUE_RECORDS.replace("FROM social", "FROM social0"), """
social AS (SELECT * REPLACE (coalesce(source, 'unknown') AS source, coalesce(product, 'unknown') AS product)
           FROM qrec WHERE id % 50 <> 0)""")


def _staged_stream(spark, d, base: str):
    """The queue as a stream of at least two micro-batches.

    There are as many files as the input has splits, so that no task writes more of them when the input
    grows, and at most 16 a batch, so that no batch does.
    """
    messages = A.queue_messages(spark, d)
    n_files = max(4, map_tasks(messages))
    ST.stage_messages(messages, base + "/inbox", n_files=n_files)
    return ST.file_queue_source(spark, base + "/inbox", files_per_batch=min(n_files // 2, 16))


@register("stream_topn", LANDED[:-1] + "," + O.CLEANED + "," + O.SCORED + "," + O.READY + ","
          + O.ranked_ready(scoring.FAQ_READY_CAP) + f"""
SELECT {READY_OUT} FROM ranked""")
def q_stream_topn(spark, d):
    """The best rows of every product after all micro-batches, one file a batch at least."""
    base = scratch_path(spark, "stream")
    msgs = _staged_stream(spark, d, base)
    ST.run_to_end(TN.start_topn(QU.good_records(QU.decode(msgs)), base + "/best", base + "/ck"))
    return _ready_out(TN.read_topn(spark, base + "/best"))


@register("stream_dedup", LANDED + """
SELECT id, source, product, data_type, score, content FROM social""")
def q_stream_dedup(spark, d):
    """Every record once, of a queue that two scrapes have filled.

    The staged files come in no order of time, so the delay spans all of them.
    """
    base = scratch_path(spark, "stream")
    for _ in range(2):
        ST.stage_messages(A.queue_messages(spark, d), base + "/inbox")
    msgs = ST.file_queue_source(spark, base + "/inbox")
    ST.run_to_end(ST.start_dedup(QU.good_records(QU.decode(msgs)), base + "/once", base + "/ck", "3650 days"))
    return spark.read.parquet(base + "/once").select("id", "source", "product", "data_type", "score", "content")


@register("stream_flush", LANDED + f"""
, groups AS (SELECT source, {SLUG_SQL} AS product_slug, count(*) AS n_records, sum(id)::BIGINT AS sum_ids
             FROM social GROUP BY source, product)
SELECT source, product_slug, n_records, sum_ids, ceil(n_records / 50)::BIGINT AS n_flushes,
       least(n_records, 50)::BIGINT AS largest FROM groups""")
def q_stream_flush(spark, d):
    """Files of at most 50 records of one (source, product), and the rest when the query has ended."""
    base = scratch_path(spark, "stream")
    msgs = _staged_stream(spark, d, base)
    # with one lane the number of files follows from the counts
    ST.run_to_end(FL.start_flush(QU.good_records(QU.decode(msgs)), base + "/files", base + "/ck", lanes=1))
    FL.flush_rest(spark, base + "/files", base + "/ck")
    rows = FS.raw_scan(spark, base + "/files", multi_line=True, glob="*.txt")
    files = rows.groupBy("source", "product_slug", F.input_file_name().alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))
    return files.groupBy("source", "product_slug").agg(
        F.sum("n").alias("n_records"), F.sum("ids").alias("sum_ids"), F.count(F.lit(1)).alias("n_flushes"),
        F.max("n").alias("largest"))


# ---------------------------------------------------------------------------
# topics
# ---------------------------------------------------------------------------

from ..operators import topics as TP  # noqa: E402
from ..operators.joins import common_first_join  # noqa: E402

STOP_SQL = "[" + ", ".join(O.q(w) for w in TP.ENGLISH_STOP_WORDS) + "]"
TOKENS_SQL = O.with_(O.SOCIAL, O.CLEANED) + f"""
, tk AS (SELECT id, string_split(lower(content_cleaned), ' ') AS words FROM cleaned),
tf AS (SELECT id, words, list_filter(words, lambda w: NOT list_contains({STOP_SQL}, w)) AS filtered
       FROM tk)
"""


@register("tokens", TOKENS_SQL + """
SELECT id, CAST(len(words) AS INTEGER) AS n_tokens, CAST(len(filtered) AS INTEGER) AS n_filtered,
       array_to_string(filtered, ' ') AS filtered
FROM tf""")
def q_tokens(spark, d):
    t = TP.tokens(scoring.clean(A.social(spark, d)))
    return t.select("id", F.size("words").alias("n_tokens"), F.size("filtered").alias("n_filtered"),
                    F.array_join("filtered", " ").alias("filtered"))


@register("tfidf_terms", TOKENS_SQL + """
, terms AS (SELECT DISTINCT id, unnest(filtered) AS term FROM tf)
SELECT term, count(*) AS doc_freq,
       round(ln(((SELECT count(*) FROM tf) + 1) / (count(*) + 1)), 6) AS idf
FROM terms GROUP BY term""")
def q_tfidf_terms(spark, d):
    t = TP.tfidf_terms(TP.tokens(scoring.clean(A.social(spark, d))))
    return t.select("term", "doc_freq", F.round("idf", 6).alias("idf"))


@register("topic_clusters")
def q_topic_clusters(spark, d):
    members = TP.topic_members(scoring.process(A.social(spark, d)))
    return TP.topic_clusters(members)


@register("topic_members")
def q_topic_members(spark, d):
    """Each cluster's members with their text, questions and URL, one row per member."""
    scored = scoring.process(A.social(spark, d))
    members = TP.topic_members(scored).select("id", "cluster")
    return members.join(scored.select("id", F.col("content_cleaned").alias("content"),
                                      T.join_list("extracted_questions").alias("questions"), "url", "score"), "id")


@register("topic_totals", O.BASE + """
SELECT count(*) AS members, CAST(sum(score) AS BIGINT) AS total_score,
       CAST(sum(len(extracted_questions)) AS BIGINT) AS questions FROM scored""")
def q_topic_totals(spark, d):
    """What the clusters add up to: every cleaned row once."""
    m = TP.topic_members(scoring.process(A.social(spark, d)))
    return m.agg(F.count(F.lit(1)).alias("members"), F.sum("score").cast("long").alias("total_score"),
                 F.sum("n_questions").cast("long").alias("questions"))


# the weighted terms of every record (count x idf), and as centres the mean vector of every product
TOPIC_SQL = TOKENS_SQL[:-1] + """
, counts AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(filtered) AS term FROM tf) GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM tf) + 1) / (count(*) + 1)) AS idf FROM counts GROUP BY term),
vec AS (SELECT id, term, n * idf AS w FROM counts JOIN idf USING (term)),
sizes AS (SELECT product, count(*) AS members, CAST(row_number() OVER (ORDER BY product) - 1 AS INTEGER) AS cluster
          FROM cleaned GROUP BY product),
centre AS (SELECT cluster, term, sum(w) / any_value(members) AS w
           FROM vec JOIN cleaned USING (id) JOIN sizes USING (product) GROUP BY cluster, term),
norm AS (SELECT cluster, sum(w * w) AS nn FROM centre GROUP BY cluster),
own AS (SELECT id, sum(w * w) AS xx FROM vec GROUP BY id),
dot AS (SELECT id, cluster, sum(v.w * c.w) AS xc FROM vec v JOIN centre c USING (term) GROUP BY ALL),
dist AS (SELECT id, cluster, sqrt(greatest(xx - 2 * coalesce(xc, 0) + nn, 0)) AS distance
         FROM own CROSS JOIN norm LEFT JOIN dot USING (id, cluster)),
best AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1)
"""


def _topic_tables(spark, d):
    """(weighted term vectors, centres): one centre per product, the mean of its records' vectors."""
    t = stored_rows(TP.tokens(scoring.clean(A.social(spark, d))).select("id", "product", "filtered"), "tokens")
    idf = stored_rows(TP.tfidf_terms(t).select(F.col("term").alias("feature"), "idf", F.col("doc_freq").alias("n")), "idf")
    counts = TP.term_rows(t, "id", "product").withColumnRenamed("n", "count")
    if t.groupBy("id", "product").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        counts = counts.groupBy("id", "product", "feature").agg(F.sum("count").alias("count"))
    counts = stored_rows(counts, "counts")
    vectors = stored_rows(common_first_join(counts, idf, "feature").select(
        "id", "product", "feature", (F.col("count") * F.col("idf")).alias("weight")), "vectors")
    names = sorted(r["product"] for r in t.select("product").distinct().collect())     # one per source
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("product")).cast("int") - 1
    sizes = t.groupBy("product").agg(F.count(F.lit(1)).alias("members"))
    centres = stored_rows(vectors.groupBy("product", "feature").agg(F.sum("weight").alias("w")).join(sizes, "product")
                          .select(number.alias("cluster"), "feature", (F.col("w") / F.col("members")).alias("weight")),
                          "centre")
    return vectors.drop("product"), centres


@register("topic_assign", TOPIC_SQL + """
SELECT id, cluster, round(distance, 6) AS distance FROM best""")
def q_topic_assign(spark, d):
    """Every record's nearest of a table of given centres, and how far it is."""
    return TP.assign_topics(*_topic_tables(spark, d)).select("id", "cluster", F.round("distance", 6).alias("distance"))


@register("topic_nearest", TOPIC_SQL + """
SELECT cluster, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(distance, 6), id) AS INTEGER) AS rank, id,
       round(distance, 6) AS distance
FROM best QUALIFY rank <= 5""")
def q_topic_nearest(spark, d):
    """The 5 members nearest to each centre."""
    assigned = TP.assign_topics(*_topic_tables(spark, d)).withColumn("distance", F.round("distance", 6))
    return TP.nearest_members(assigned, 5)


# ---------------------------------------------------------------------------
# product form input
# ---------------------------------------------------------------------------

WS_STRIP = "'^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$'"


@register("keyword_list", f"""
WITH forms AS (
  SELECT p_partkey AS id, p_name AS name,
         p_name || ' , ' || lower(p_type) || ',' || p_brand || ', ' AS keywords_text,
         CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END AS category
  FROM part)
SELECT id, name,
       array_to_string(list_transform(string_split(keywords_text, ','),
                       lambda k: regexp_replace(k, {WS_STRIP}, '', 'g')), '|') AS keywords,
       CAST(len(string_split(keywords_text, ',')) AS INTEGER) AS n_keywords,
       nullif(category, '') AS category
FROM forms""")
def q_keyword_list(spark, d):
    p = A.table(spark, d, "part")
    forms = p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.concat(F.col("p_name"), F.lit(" , "), F.lower("p_type"), F.lit(","), F.col("p_brand"),
                 F.lit(", ")).alias("keywords_text"),
        F.when(F.col("p_size") % 2 == 0, F.lit("")).otherwise(F.col("p_type")).alias("category"))
    req = TB.form_requests(forms)
    return req.select("id", "name", T.join_list("keywords").alias("keywords"),
                      F.size("keywords").alias("n_keywords"), "category")
