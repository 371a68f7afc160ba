"""DuckDB oracle SQL for every registered query.

Each oracle rebuilds the adapter rows from the same parquet tables with SQL
and computes the expected result independently of Spark.  Dialect traps
handled here: RE2's ``\\s`` lacks the vertical tab (Java's has it), so the
whitespace class is spelled out; ``regexp_replace`` needs the ``'g'`` flag;
NULL ordering is always explicit; arrays are rendered as joined text.
"""

from __future__ import annotations

# Fixed values, stated once more so that a change in the engine shows: words that start a question.
QUESTION_STARTERS = (
    "how", "what", "why", "when", "where", "which", "who", "is", "are",
    "can", "could", "would", "should", "does", "do", "will", "has", "have",
    "any",
)

WS = r"[ \t\n\x0B\f\r]"
NWS = r"[^ \t\n\x0B\f\r]"
STARTER_RE = "^(" + "|".join(QUESTION_STARTERS) + ")"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def clean_sql(c: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), "
            f"'http{NWS}+|www\\.{NWS}+', '', 'g'), "
            f"'[^a-zA-Z0-9 \\t\\n\\x0B\\f\\r?.!]', ' ', 'g'), '{WS}+', ' ', 'g'))")


def sentences_sql(c: str) -> str:
    return (f"list_transform(string_split(replace(replace({c}, '!', '.'), '?', '?.'), '.'), "
            f"lambda s: trim(s))")


def questions_sql(c: str) -> str:
    return (f"coalesce(list_filter({sentences_sql(c)}, lambda s: s <> '' AND "
            f"(suffix(s, '?') OR regexp_matches(lower(s), '{STARTER_RE}')) AND length(s) > 15), "
            f"[]::VARCHAR[])")


SOCIAL = """
social AS (
  SELECT doc_id AS id, 'reddit' AS source, source AS product,
         CASE WHEN doc_id % 3 = 0 THEN 'post' ELSE 'comment' END AS data_type,
         text AS content,
         CASE WHEN doc_id % 3 = 0 THEN text END AS title,
         'u' || CAST(doc_id % 97 AS VARCHAR) AS author,
         CAST(doc_id * 37 % 101 - 10 AS INTEGER) AS score,
         'https://example.org/' || source || '/' || CAST(doc_id AS VARCHAR) AS url,
         lang AS subreddit,
         strftime(TIMESTAMP '1970-01-01' + to_seconds(CAST(1704067200 + doc_id * 60 AS BIGINT)),
                  '%Y-%m-%dT%H:%M:%SZ') AS created_at
  FROM documents)"""

CLEANED = f"""
cleaned AS (
  SELECT * FROM (SELECT *, {clean_sql('content')} AS content_cleaned FROM social)
  WHERE length(content_cleaned) > 20)"""

SCORED = f"""
scored AS (
  SELECT *, CAST((CAST(score AS BIGINT) + 1) * CASE WHEN data_type = 'post' THEN 2 ELSE 1 END
                 AS BIGINT) AS relevance_score,
         CAST(length(content_cleaned) AS INTEGER) AS content_length,
         len(extracted_questions) > 0 AS has_question
  FROM (SELECT *, {questions_sql('content_cleaned')} AS extracted_questions FROM cleaned))"""

READY = """
ready AS (
  SELECT id, product, content_cleaned AS content, extracted_questions, relevance_score,
         data_type, url AS source_url, score AS engagement_score
  FROM scored WHERE relevance_score > 1 OR len(extracted_questions) > 0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


BASE = with_(SOCIAL, CLEANED, SCORED, READY)


def ranked_ready(cap: int) -> str:
    return f"""
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product
                               ORDER BY relevance_score DESC NULLS LAST, id) AS rank
  FROM ready QUALIFY rank <= {cap})"""


def iso_sql(epoch_expr: str) -> str:
    return (f"strftime(TIMESTAMP '1970-01-01' + to_seconds(CAST({epoch_expr} AS BIGINT)), "
            f"'%Y-%m-%dT%H:%M:%SZ')")


THREAD_POSTS = """
conv_counts AS (SELECT conv_id, CAST(count(*) AS INTEGER) AS num_comments
                FROM conversations WHERE turn > 0 GROUP BY conv_id),
tposts AS (
  SELECT c.conv_id,
         'prod' || CAST(c.conv_id % 5 AS VARCHAR) AS product,
         'kw' || CAST(c.conv_id % 3 AS VARCHAR) AS keyword,
         'p' || CAST(c.conv_id AS VARCHAR) AS id,
         CASE WHEN c.conv_id % 10 = 7 THEN '' ELSE c.text END AS title,
         CASE WHEN c.conv_id % 5 = 2 THEN '' ELSE c.text END AS selftext,
         'a' || CAST(c.conv_id % 31 AS VARCHAR) AS author,
         'sub' || CAST(c.conv_id % 4 AS VARCHAR) AS subreddit,
         CAST(c.conv_id * 7 % 50 AS INTEGER) AS score,
         coalesce(n.num_comments, 0) AS num_comments,
         CAST(1704067200 + c.conv_id * 3600 + 0.75 AS DOUBLE) AS created_utc,
         '/r/sub' || CAST(c.conv_id % 4 AS VARCHAR) || '/comments/p' || CAST(c.conv_id AS VARCHAR)
           || '/' AS permalink
  FROM conversations c LEFT JOIN conv_counts n USING (conv_id) WHERE c.turn = 0)"""

NPOSTS = f"""
nposts AS (
  SELECT id AS post_id, 'reddit' AS source, product, 'post' AS data_type,
         CASE WHEN selftext <> '' THEN selftext ELSE title END AS content,
         title, author, score, 'https://reddit.com' || permalink AS url, subreddit,
         {iso_sql('trunc(created_utc)')} AS created_at,
         CAST(num_comments AS VARCHAR) AS num_comments, keyword
  FROM tposts WHERE title <> '' OR selftext <> '')"""

THREAD_COMMENTS = """
tcomments AS (
  SELECT 'c' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS comment_id,
         'p' || CAST(conv_id AS VARCHAR) AS post_id,
         CASE WHEN (conv_id + turn) % 11 = 0 THEN 'more' ELSE 't1' END AS kind,
         CASE WHEN (conv_id + turn) % 13 = 0 THEN '[deleted]'
              WHEN (conv_id + turn) % 17 = 0 THEN '[removed]' ELSE text END AS body,
         role || '_' || CAST(conv_id % 23 AS VARCHAR) AS author,
         CAST((conv_id * 31 + turn * 7) % 40 - 5 AS INTEGER) AS score,
         CAST(1704067200 + conv_id * 3600 + turn * 60 + 0.5 AS DOUBLE) AS created_utc,
         't3_p' || CAST(conv_id AS VARCHAR) AS parent_id
  FROM conversations WHERE turn > 0)"""

NCOMMENTS = f"""
ncomments AS (
  SELECT c.comment_id, c.post_id, 'reddit' AS source, p.product, 'comment' AS data_type,
         c.body AS content, c.author, c.score, p.url, p.subreddit,
         {iso_sql('trunc(c.created_utc)')} AS created_at, c.parent_id
  FROM tcomments c JOIN nposts p USING (post_id)
  WHERE c.kind = 't1' AND c.body <> '' AND c.body <> '[deleted]')"""

STATUSES_SQL = ("['pending', 'scraping', 'processing', 'generating', 'completed', 'error', "
                "'processed', 'processing_failed', 'pipeline_completed']")

PRODUCTS = f"""
products AS (
  SELECT c_custkey AS id, c_name AS name, c_mktsegment AS description,
         CASE WHEN c_custkey % 13 = 0 THEN NULL
              WHEN c_custkey % 7 = 0 THEN []::VARCHAR[]
              ELSE ['sub' || CAST(c_custkey % 4 AS VARCHAR), lower(c_mktsegment)] END AS subreddits,
         CASE WHEN c_custkey % 5 = 0 THEN []::VARCHAR[]
              WHEN c_custkey % 11 = 0 THEN [lower(c_mktsegment), 'price & "deal"']
              ELSE [lower(c_mktsegment), 'review'] END AS keywords,
         c_mktsegment AS category,
         TIMESTAMP '2024-01-01' + to_hours(CAST(c_custkey AS BIGINT)) AS created_at,
         CAST(NULL AS TIMESTAMP) AS last_scraped, CAST(NULL AS TIMESTAMP) AS last_processed,
         0 AS faq_count,
         ({STATUSES_SQL})[c_custkey % 9 + 1] AS status
  FROM customer)"""

COMMUNITIES = """
comm AS (
  SELECT lower(trim(n_name)) AS topic, s_name AS display_name,
         CAST(trunc(s_acctbal) AS BIGINT) AS subscribers, s_suppkey AS search_rank
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

TASKS = """
words AS (
  SELECT product, word, count(*) AS n FROM (
    SELECT product, unnest(string_split_regex(lower(content), '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM social)
  WHERE word <> '' GROUP BY ALL),
places AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY n DESC, word) AS place,
                  coalesce(TRY_CAST(regexp_extract(product, '([0-9]+)$', 1) AS INTEGER), 0) + 1 AS first
           FROM words),
searched AS (SELECT product AS src, max(word) FILTER (place = first) AS name,
                    list(word ORDER BY place) FILTER (place IN (first + 1, first + 2)) AS kws
             FROM places GROUP BY product),
tasks AS (SELECT DISTINCT name AS product, subreddit, keyword FROM (
            SELECT name, src, unnest(coalesce(kws, ['review', 'problem', 'issue', 'help', 'question',
                                                     'experience', 'opinion'])) AS keyword FROM searched) k
          JOIN (SELECT DISTINCT product AS src, subreddit FROM social) USING (src)
          WHERE name IS NOT NULL)"""


def matches(per_search: int) -> str:
    return f"""
matches AS (
  SELECT s.id, t.product, s.subreddit, t.keyword, s.created_at,
         CAST(row_number() OVER (PARTITION BY t.product, s.subreddit, t.keyword
                                 ORDER BY s.created_at DESC, s.id) AS INTEGER) AS search_rank
  FROM social s JOIN tasks t USING (subreddit)
  WHERE contains(lower(s.content), t.keyword) AND contains(lower(s.content), t.product)
  QUALIFY search_rank <= {per_search})"""


# --- contexts, prompts, responses --------------------------------------------

NL = "chr(10)"


def ctx(cap: int, name: str = "ctx") -> str:
    return f"""
{name} AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY product
                                    ORDER BY relevance_score DESC NULLS LAST, id) AS INTEGER) AS rank
  FROM ready QUALIFY rank <= {cap})"""


def item_large(src: str = "") -> str:
    return (f"substr(coalesce({src}content, '') || CASE WHEN len(coalesce({src}extracted_questions, []))"
            f" > 0 THEN {NL} || 'Questions found: ' || "
            f"array_to_string({src}extracted_questions[1:3], '; ') ELSE '' END, 1, 500)")


def item_small(src: str = "") -> str:
    return (f"substr(coalesce({src}content, ''), 1, 300) || CASE WHEN "
            f"len(coalesce({src}extracted_questions, [])) > 0 THEN ' Questions: ' || "
            f"array_to_string({src}extracted_questions[1:2], '; ') ELSE '' END")


def context_agg(item: str, n: int, src: str = "ctx") -> str:
    return (f"SELECT product, count(*) AS n_items, "
            f"string_agg({item}, {NL} || '---' || {NL} ORDER BY rank) AS context "
            f"FROM {src} WHERE rank <= {n} GROUP BY product")


def template_sql(template: str, product: str, content: str) -> str:
    parts = []
    rest = template
    while rest:
        i_p, i_c = rest.find("{product}"), rest.find("{content}")
        hits = [(i, k) for i, k in ((i_p, "product"), (i_c, "content")) if i >= 0]
        if not hits:
            parts.append(q(rest))
            break
        i, k = min(hits)
        if i:
            parts.append(q(rest[:i]))
        parts.append(product if k == "product" else content)
        rest = rest[i + len(k) + 2:]
    return " || ".join(parts)


RESPONSES = """
rparts AS (
  SELECT product, rank, (rank - 1) % 3 AS turn,
         CASE WHEN len(extracted_questions) > 0 THEN array_to_string(extracted_questions, ' ')
              ELSE content || '?' END AS qt,
         content AS atx,
         (['Features', 'Setup', 'Performance'])[(rank - 1) % 3 + 1] AS cat,
         (['0.9', '0.85', '0.8'])[(rank - 1) % 3 + 1] AS conf,
         data_type AS kw1, product AS kw2
  FROM ctx200),
rforms AS (
  SELECT product,
    'Sure! Here are the FAQs:' || chr(10) || '[' || string_agg('{"question": "' || qt
      || '", "answer": "' || atx || '", "category": "' || cat || '", "confidence": ' || conf
      || ', "keywords": ["' || kw1 || '", "' || kw2 || '"]}', ', ' ORDER BY rank)
      || ']' || chr(10) || 'Hope this helps.' AS f0,
    '[' || string_agg(CASE WHEN turn = 0 THEN '{"question": "' || qt || '", "answer": "' || atx
                             || '", "confidence": "0.75"}'
                           WHEN turn = 1 THEN '{"answer": "' || atx || '", "confidence": null}'
                           ELSE '{"question": "' || qt || '", "answer": "' || atx
                             || '", "category": "Setup", "confidence": "high", "keywords": []}'
                      END, ', ' ORDER BY rank) || ']' AS f1,
    max(CASE WHEN rank = 1 THEN 'Here you go: [{"question": "' || qt || '", "answer": ]' END) AS f2,
    'A: stray answer before any question' || chr(10) ||
      string_agg(CASE WHEN turn = 0 THEN 'Q: ' || qt || chr(10) || 'A: ' || atx || chr(10)
                                         || 'see also ' || kw1
                      WHEN turn = 1 THEN 'Question: ' || qt || chr(10) || 'Answer: ' || atx
                      ELSE 'Q: ' || qt || chr(10) || 'note first' || chr(10) || 'A: ' || atx END,
                 chr(10) || chr(10) ORDER BY rank) AS f3,
    coalesce(TRY_CAST(regexp_extract(product, '([0-9]+)$', 1) AS INTEGER), 0) AS n
  FROM rparts GROUP BY product),
resp AS (
  SELECT product, 'large' AS provider, 1 AS priority, ([f0, f1, f2, f3])[n % 4 + 1] AS response
  FROM rforms
  UNION ALL
  SELECT product, 'small', 2,
         ([f0, f1, f2, f3])[CASE WHEN n % 8 = 6 THEN 2 ELSE (n + 1) % 4 END + 1]
  FROM rforms)"""

STRIP_RE = "'^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$'"

def parse_sql() -> str:
    return f"""
loc AS (SELECT *, TRY_CAST(nullif(regexp_extract(response, '(?s)\\[.*\\]', 0), '') AS JSON) AS arr
        FROM resp),
usable AS (
  SELECT product, provider, priority, response,
         coalesce(json_type(arr) = 'ARRAY', false) AS is_array,
         CASE WHEN json_type(arr) = 'ARRAY'
               AND coalesce(list_bool_and(list_transform(json_extract(arr, '$[*]'),
                                                         lambda e: json_type(e) = 'OBJECT')), true)
              THEN json_extract(arr, '$[*]') END AS elems
  FROM loc),
jexp AS (
  SELECT product, provider, priority, unnest(generate_series(0, len(elems) - 1)) AS pos,
         unnest(elems) AS e
  FROM usable WHERE elems IS NOT NULL),
jentries AS (
  SELECT product, provider, priority, CAST(pos AS INTEGER) AS entry_pos,
         coalesce(json_extract_string(e, '$.question'), '') AS question,
         coalesce(json_extract_string(e, '$.answer'), '') AS answer,
         coalesce(json_extract_string(e, '$.category'), 'General') AS category,
         coalesce(TRY_CAST(json_extract_string(e, '$.confidence') AS DOUBLE),
                  CASE json_extract_string(e, '$.confidence') WHEN 'true' THEN 1.0
                                                            WHEN 'false' THEN 0.0 END,
                  CASE WHEN provider = 'large' THEN 0.8 WHEN provider = 'small' THEN 0.7 END)
           AS confidence,
         coalesce(array_to_string(json_extract_string(e, '$.keywords[*]'), '|'), '') AS keywords,
         'json' AS method
  FROM jexp),
need AS (SELECT product, provider, priority, response FROM usable
         WHERE provider = 'small' AND NOT is_array),
{qa_lines_sql('need', 'lentries')}
entries AS (SELECT * FROM jentries UNION ALL SELECT * FROM lentries)"""


def qa_lines_sql(src: str, out: str) -> str:
    return f"""
lx AS (
  SELECT product, provider, priority, unnest(generate_series(0, len(ls) - 1)) AS pos,
         unnest(ls) AS raw
  FROM (SELECT *, string_split(response, chr(10)) AS ls FROM {src})),
lc AS (
  SELECT *, (starts_with(line, 'Q:') OR starts_with(line, 'Question:')) AS is_q,
         NOT (starts_with(line, 'Q:') OR starts_with(line, 'Question:'))
           AND (starts_with(line, 'A:') OR starts_with(line, 'Answer:')) AS is_a,
         regexp_replace(regexp_extract(line, '(?s)^[^:]*:(.*)$', 1), {STRIP_RE}, '', 'g') AS after
  FROM (SELECT *, regexp_replace(raw, {STRIP_RE}, '', 'g') AS line FROM lx)),
lb AS (
  SELECT *, sum(CASE WHEN is_q THEN 1 ELSE 0 END) OVER (
              PARTITION BY product, provider, priority ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block
  FROM lc QUALIFY block > 0),
bk AS (
  SELECT product, provider, priority, block, arg_min(after, pos) AS question,
         max(pos) FILTER (WHERE is_a) AS last_a
  FROM lb GROUP BY product, provider, priority, block),
bka AS (
  SELECT k.product, k.provider, k.block, x.after AS a_text
  FROM bk k JOIN lb x ON x.product = k.product AND x.provider = k.provider
                      AND x.block = k.block AND x.pos = k.last_a),
bkc AS (
  SELECT k.product, k.provider, k.block, string_agg(x.line, ' ' ORDER BY x.pos) AS ctext
  FROM bk k JOIN lb x ON x.product = k.product AND x.provider = k.provider AND x.block = k.block
                      AND NOT x.is_q AND NOT x.is_a AND x.line <> ''
                      AND x.pos > coalesce(k.last_a, -1)
  GROUP BY k.product, k.provider, k.block),
{out} AS (
  SELECT * FROM (
    SELECT k.product, k.provider, k.priority, CAST(k.block - 1 AS INTEGER) AS entry_pos,
           k.question,
           regexp_replace(concat_ws(' ', a.a_text, c.ctext), {STRIP_RE}, '', 'g') AS answer,
           'General' AS category, 0.6 AS confidence, '' AS keywords, 'lines' AS method
    FROM bk k LEFT JOIN bka a ON a.product = k.product AND a.provider = k.provider
                             AND a.block = k.block
              LEFT JOIN bkc c ON c.product = k.product AND c.provider = k.provider
                             AND c.block = k.block)
  WHERE question <> '' AND answer <> ''),"""


def sources_sql(n_large: int = 10, n_small: int = 5) -> str:
    return f"""
srcs AS (
  SELECT product, 'large' AS provider,
         array_to_string((list(source_url ORDER BY rank)
           FILTER (WHERE rank <= {n_large}
                   AND source_url IS NOT NULL AND source_url <> ''))[1:3], '|') AS sources
  FROM ctx GROUP BY product
  UNION ALL
  SELECT product, 'small' AS provider,
         array_to_string((list(source_url ORDER BY rank)
           FILTER (WHERE rank <= {n_small}
                   AND source_url IS NOT NULL AND source_url <> ''))[1:3], '|') AS sources
  FROM ctx GROUP BY product)"""


CHOSEN = """
ecounts AS (SELECT product, provider, priority, count(*) AS n_entries FROM entries
            GROUP BY product, provider, priority),
best AS (SELECT product, arg_min(provider, priority) AS provider,
                arg_min(n_entries, priority) AS n_entries FROM ecounts GROUP BY product),
chosen AS (SELECT r.product, b.provider, b.n_entries
           FROM (SELECT DISTINCT product FROM resp) r LEFT JOIN best b USING (product))"""

DOC_ENTRIES = """
dentries AS (
  SELECT e.*, CASE WHEN e.method = 'json' THEN coalesce(s.sources, '') ELSE '' END AS sources
  FROM entries e JOIN chosen c ON c.product = e.product AND c.provider = e.provider
  LEFT JOIN srcs s ON s.product = e.product AND s.provider = e.provider)"""


# --- products, queue ---------------------------------------------------------

PNUM = "coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER), 0)"

SOCIAL_PRODUCTS = f"""
sprod AS (
  SELECT CAST({PNUM} AS BIGINT) AS id, source AS name,
         ({STATUSES_SQL})[{PNUM} % 9 + 1] AS status
  FROM documents GROUP BY source)"""

QUEUE_RECORDS = """
qrec AS (
  SELECT id, CASE WHEN id % 23 = 0 THEN NULL ELSE source END AS source,
         CASE WHEN id % 29 = 0 THEN NULL ELSE product END AS product,
         data_type, content, title, author, score, url, subreddit, created_at
  FROM social)"""

RUNS = """
runs AS (
  SELECT o_custkey AS product_id,
         (['scrape', 'process', 'generate', 'full_run', 'process'])[
            CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS stage,
         CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'running' WHEN 'P' THEN 'failed' END
           AS outcome,
         o_orderdate AS ts, o_orderkey AS run_id
  FROM orders)"""
