"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bestfit, bpe, jaccard, lm, metric_join, mixing, negatives, packing, pii, quality, ranked, sharding
from .base import WORD_PATTERN, shared_path, table

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


# --- 1: language-model scores ------------------------------------------------

OP1_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '{WORD_PATTERN}') AS w FROM documents),
p AS (SELECT doc_id, w[i - 2] AS w0, w[i - 1] AS w1, w[i] AS w2, i
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
q AS (SELECT doc_id, i, count(*) OVER (PARTITION BY w2) AS c1,
             CASE WHEN i >= 2 THEN count(*) FILTER (i >= 2) OVER (PARTITION BY w1, w2) ELSE 0 END AS c2,
             CASE WHEN i >= 3 THEN count(*) FILTER (i >= 3) OVER (PARTITION BY w0, w1, w2) ELSE 0 END AS c3,
             count(*) OVER () AS total FROM p),
r AS (SELECT *, lag(c1) OVER b AS before1, lag(c2) OVER b AS before2 FROM q
      WINDOW b AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN c3 >= 2 THEN ln(c3 / before2)
             WHEN c2 >= 2 THEN ln(c2 / before1) + least(i - 2, 1) * ln(0.4)
             ELSE ln(c1 / total) + least(i - 1, 2) * ln(0.4) END) AS score FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(score, 0), 4) AS log_score,
       round(score / n, 6) AS mean_log_score
FROM d LEFT JOIN s USING (doc_id)
"""


@register("op1_stupid_backoff", OP1_SQL)
def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's trigram score under the counts of all documents."""
    scored = lm.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"),
                         F.round("mean_log_score", 6).alias("mean_log_score"))


# --- 2: nearest vectors ------------------------------------------------------

@register("op2_onebit_neighbours")
def op2_onebit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every vector whose id is divisible by 50."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


# --- 3: quality --------------------------------------------------------------

#: A document with a score below is taken as bad.
QUALITY_CUT = 0.3


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.train(docs, labels.where(~held_out()))


@register("op3_compression_quality")
def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, sf_dir))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


#: The public tokenizer of the encoding queries, and the end id of op4.
TOKENIZER = "word_bpe_49k.json"
END_ID = 2


# --- 4: packed token files ---------------------------------------------------

@register("op4_packed_token_files")
def op4_packed_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the packed files just written."""
    path = shared_path(spark, "packed-tokens")
    packing.write(table(spark, sf_dir, "documents"), path, TOKENIZER, END_ID)
    return packing.read_checksums(spark, path).withColumnRenamed("key", "doc_id")


# --- 5: personal data --------------------------------------------------------

def _listed(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


@register("op5_crf_personal_data")
def op5_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts by kind and digest of the rule spans, all spans."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", _of_kind(kind))).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"),
                        _listed("spans").alias("spans"))


# --- 6: sharding -------------------------------------------------------------

N_SHARDS = 16


@register("op6_rendezvous_sharding")
def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16, its slot there, and its shard were there 17."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    even = {s: 1.0 for s in range(N_SHARDS)}
    placed = sharding.assign(docs, "doc_id", even)
    placed = sharding.assign(placed, "doc_id", even | {N_SHARDS: 1.0}, "grown_shard")
    placed = sharding.with_slots(placed, "doc_id", tie=("text_crc32", "size"), n_shards=N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         F.col("slot").cast("bigint").alias("slot"), "grown_shard")


# --- 7: near vectors ---------------------------------------------------------

@register("op7_pivot_range_join")
def op7_pivot_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at cosine 0.9 and its component."""
    return metric_join.near_links(table(spark, sf_dir, "embeddings"), 0.9)


# --- 8: mixing ---------------------------------------------------------------

MIX = {"weights": {("crawl",): 1.0, ("curated",): 3.0, ("*", "en"): 2.0},
       "budget_share": 1.0, "max_epochs": 2, "seed": 7}


def mix_domain(source: str = "source"):
    """The first level of the source tree: the one large crawl, or a curated source."""
    return F.when(F.col(source) == "src0", "crawl").otherwise("curated")


def _fill_sql(nodes: str, parent: str, name: str) -> str:
    return f"""
    SELECT * EXCLUDE (f, used, op), CASE WHEN f THEN capacity ELSE (budget - used) / op * weight END AS share FROM (
      SELECT *, sum(CASE WHEN f THEN capacity ELSE 0.0::DOUBLE END) OVER (PARTITION BY {parent}) AS used,
             sum(CASE WHEN f THEN 0.0::DOUBLE ELSE weight END) OVER (PARTITION BY {parent}) AS op FROM (
        SELECT *, capacity / weight * (sum(weight) OVER (PARTITION BY {parent})
                    - coalesce(sum(weight) OVER b, 0)) + coalesce(sum(capacity) OVER b, 0) <= budget AS f
        FROM {nodes}
        WINDOW b AS (PARTITION BY {parent} ORDER BY capacity / weight, {name}
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


OP8_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN source = 'src0' THEN 'crawl' ELSE 'curated' END AS domain,
                  coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
                  coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0)::BIGINT AS n_tokens
           FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply, sum(n_tokens)::DOUBLE * 2 AS capacity,
                  1.0::DOUBLE AS weight FROM d GROUP BY ALL),
langs AS (SELECT domain, lang, sum(capacity) AS capacity,
                 CASE WHEN lang = 'en' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM leaves GROUP BY ALL),
domains AS (SELECT domain, sum(capacity) AS capacity, 0 AS root,
                   CASE WHEN domain = 'crawl' THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END AS weight,
                   floor(sum(sum(capacity)) OVER () / 2)::DOUBLE AS budget FROM langs GROUP BY domain),
top AS ({_fill_sql('domains', 'root', 'domain')}),
m0 AS (SELECT l.*, top.share AS budget FROM langs l JOIN top USING (domain)),
mid AS ({_fill_sql('m0', 'domain', 'lang')}),
l0 AS (SELECT l.*, mid.share AS budget FROM leaves l JOIN mid USING (domain, lang)),
low AS ({_fill_sql('l0', 'domain, lang', 'source')}),
plan AS (SELECT *, CASE WHEN supply > 0 THEN share // supply ELSE 0 END AS epochs,
                share - supply * CASE WHEN supply > 0 THEN share // supply ELSE 0 END AS rest
         FROM (SELECT domain, lang, source, supply, floor(share + 1e-6)::BIGINT AS share FROM low)),
whole AS (SELECT d.*, unnest(generate_series(1, epochs))::INTEGER AS epoch FROM d JOIN plan USING (domain, lang, source)),
part AS (SELECT d.*, (epochs + 1)::INTEGER AS epoch, rest,
                sum(n_tokens) OVER (PARTITION BY domain, lang, source
                  ORDER BY md5('7:' || (epochs + 1) || ':' || doc_id)) AS upto
         FROM d JOIN plan USING (domain, lang, source) WHERE rest > 0)
SELECT doc_id, epoch, domain, lang, source, n_tokens FROM whole
UNION ALL SELECT doc_id, epoch, domain, lang, source, n_tokens FROM part WHERE upto <= rest
"""


@register("op8_source_mixing", OP8_SQL)
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents chosen for the mix, once per epoch, with their tree path and token count."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, mix_domain(), **MIX)
    return mixed.select("doc_id", "epoch", F.col(mixing.DOMAIN).alias("domain"), F.col(mixing.LANG).alias("lang"),
                        F.col(mixing.SOURCE).alias("source"), mixing.n_words(F.col("text")).alias("n_tokens"))


# --- 9: BPE ------------------------------------------------------------------

@register("op9_backtracking_bpe")
def op9_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids, and of the text decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = bpe.decode(bpe.encode(docs, TOKENIZER).drop("text"), TOKENIZER)
    ids = F.concat_ws(" ", F.col("token_ids").cast("array<string>"))
    return both.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
                       F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


# --- 10: near-duplicate documents --------------------------------------------

@register("op10_ngram_jaccard_join")
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of 5-word shingles and its component at a similarity of 0.8."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), 80, 5)


# --- 11: best-fit packing ----------------------------------------------------

#: The tokenizer of the packed sequences, and the id after every document.
PACK_TOKENIZER, PACK_END_ID = "byte_bpe_50k.json", 0


@register("op11_best_fit_packing")
def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 2048 tokens."""
    packed = bestfit.pack(table(spark, sf_dir, "documents"), PACK_TOKENIZER, PACK_END_ID)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# --- 12: ranked search -------------------------------------------------------

TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12_SQL = f"""
WITH split AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM_PATTERN}') AS w FROM documents),
d AS (SELECT * FROM split WHERE len(w) > 0),
total AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight
       FROM tf, total GROUP BY term, n_docs),
norm AS (SELECT row, doc_id, 100 - 75 + ((75 * len(w) * n_docs) // n_terms) AS m FROM d, total),
asked AS (SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '{TERM_PATTERN}')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, row, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN norm USING (row) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


@register("op12_best_position_search", OP12_SQL)
def op12_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of all for every benchmark item."""
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


# --- 13: hard negatives ------------------------------------------------------

OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                 list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
          FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@register("op13_packed_tree_negatives", OP13_SQL)
def op13_packed_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 hardest negatives for each of the 5 positives of every anchor (ids divisible by 50)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)
