"""Topics: tokens, TF-IDF term weights and k-means clusters (MLlib).

``topic_members`` runs tokenizer -> stop words -> hashed term frequencies
(1000 buckets) -> IDF -> k-means (k=10, seed 42) with only the weighted
vectors persisted for the passes of k-means.  Instead of collecting every member's text, questions and
URL into per-cluster lists (one list per cluster grows with the data), the
cluster summary holds counts and averages and ``topic_members`` holds the
(id, cluster) assignment, which joins back to any column.  ``assign_topics``
and ``nearest_members`` use a model kept as a table of centres: new rows are
assigned without fitting again, and each cluster's nearest members are what a
reader looks at.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, StopWordsRemover, Tokenizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
NUM_FEATURES = 1000
NUM_CLUSTERS = 10
SEED = 42
#: Spark's default English stop words (what StopWordsRemover uses when none are given).
ENGLISH_STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
""".split())
# ---------------------------------------------------------------------------


def tokens(df: DataFrame, text_col: str = "content_cleaned") -> DataFrame:
    """Add ``words`` (lower-case, split on whitespace) and ``filtered``
    (default English stop words removed, duplicates kept)."""
    tok = Tokenizer(inputCol=text_col, outputCol="words")
    rem = StopWordsRemover(inputCol="words", outputCol="filtered",
                           stopWords=list(ENGLISH_STOP_WORDS))
    return rem.transform(tok.transform(df))


def tfidf_terms(tokenized: DataFrame, terms_col: str = "filtered") -> DataFrame:
    """Per term: document frequency and IDF = ln((n + 1) / (df + 1)).

    One pass over the documents: every document contributes its distinct
    terms plus one NULL sentinel, so a single groupBy (map-side combined)
    yields both the document frequencies and the document count ``n``.  The
    term table (vocabulary-sized) is checkpointed and ``n`` - one number -
    is read from its sentinel row.
    """
    from ..session import materialize
    terms = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(terms_col))
    counts = materialize(tokenized.select(F.explode(terms).alias("term"))
                         .groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq")))
    n_row = counts.where(F.col("term").isNull()).first()
    n = n_row.doc_freq if n_row else 0
    return (counts.where(F.col("term").isNotNull())
                  .withColumn("idf", F.log((F.lit(n) + 1.0) / (F.col("doc_freq") + 1.0))))


def term_counts(scored: DataFrame, num_features: int = NUM_FEATURES) -> DataFrame:
    """(id, product, score, n_questions, raw_features): hashed term counts, tokenized once and stored as sparse vectors."""
    from ..session import materialize
    tok = tokens(scored.select("id", "product", "content_cleaned", "score",
                               F.size("extracted_questions").alias("n_questions")))
    return materialize(HashingTF(inputCol="filtered", outputCol="raw_features", numFeatures=num_features)
                       .transform(tok).select("id", "product", "score", "n_questions", "raw_features"))


def fit_topics(counts: DataFrame, k: int = NUM_CLUSTERS, seed: int = SEED):
    """(weighted rows with ``features``, the fitted model) of ``term_counts`` rows; the rows are persisted.

    Raises when there are fewer than two rows (k-means cannot run) rather
    than silently returning another schema.
    """
    from pyspark import StorageLevel
    if counts.limit(2).count() < 2:
        raise ValueError("topic clustering needs at least two rows")
    # the weighted vectors are what k-means passes over again and again
    weighted = (IDF(inputCol="raw_features", outputCol="features").fit(counts).transform(counts)
                .drop("raw_features").persist(StorageLevel.MEMORY_AND_DISK))
    try:
        return weighted, KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(weighted)
    except Exception:
        weighted.unpersist()
        raise


def topic_members(scored: DataFrame, k: int = NUM_CLUSTERS, seed: int = SEED,
                  num_features: int = NUM_FEATURES) -> DataFrame:
    """(id, product, cluster, score, n_questions) for every scored row.

    Text is tokenized and hashed once; the stored sparse counts feed the IDF
    pass and the weighted vectors that k-means passes over (never the text).
    The assignments are cut from that lineage with a reliable checkpoint and the
    vectors are released.
    """
    from ..session import materialize
    weighted, model = fit_topics(term_counts(scored, num_features), k, seed)
    try:
        return materialize(model.transform(weighted).select("id", "product", "cluster", "score", "n_questions"))
    finally:
        weighted.unpersist()


# --- the model as tables -------------------------------------------------------
#
# Vectors as rows of (.., feature, weight): hashed buckets, or terms themselves.

def long_vectors(rows: DataFrame, key: str, vector: str = "features") -> DataFrame:
    """(key, feature, weight) of the entries of sparse vectors that are not 0."""
    from pyspark.ml.functions import vector_to_array
    cells = F.posexplode(vector_to_array(F.col(vector))).alias("feature", "weight")
    return rows.select(key, cells).where(F.col("weight") != 0)


def centre_rows(model, spark) -> DataFrame:
    """(cluster, feature, weight) of a fitted model's centres: at most clusters x features rows."""
    return spark.createDataFrame(
        [(c, f, float(w)) for c, centre in enumerate(model.clusterCenters()) for f, w in enumerate(centre) if w != 0],
        "cluster int, feature int, weight double")


def term_rows(tokenized: DataFrame, *keys: str, terms_col: str = "filtered") -> DataFrame:
    """(keys, feature, n): how often each row has each of its terms, counted inside the row, without a shuffle.

    The row's terms are sorted, and a term's count is the length of its run.
    Rows of equal keys stay apart.
    """
    col = "__tm_sorted"
    at = lambda i: F.get(F.col(col), i)
    rows = tokenized.where(F.size(terms_col) > 0).select(*keys, F.sort_array(terms_col).alias(col))
    runs = rows.withColumn("__tm_from", F.filter(F.sequence(F.lit(0), F.size(col) - 1),
                                                 lambda i: (i == 0) | (at(i) != at(i - 1))))
    end = lambda k: F.coalesce(F.get(F.col("__tm_from"), k + 1), F.size(col))
    return runs.select(*keys, F.inline(F.transform("__tm_from", lambda i, k: F.struct(
        at(i).alias("feature"), (end(k) - i).cast("long").alias("n")))))


def assign_topics(vectors: DataFrame, centres: DataFrame, key: str = "id") -> DataFrame:
    """(key, cluster, distance): the nearest centre of every vector, without fitting anything.

    |x - c|^2 = |x|^2 - 2 x.c + |c|^2: the products come from one join of the
    vectors' entries with the centres' by feature, in which the most common
    features are broadcast (``common_first_join``).  Where the entries of a
    vector lie together, as ``term_rows`` gives them, they are summed before anything is
    shuffled: what is shuffled are the entries of rare features and one number
    per vector and centre.  A vector that shares no feature with a centre is
    held against it too; ties go to the smaller cluster.  Vectors without entries are not in ``vectors``.
    """
    from ..session import stored_rows
    from .joins import common_first_join
    norms = centres.groupBy("cluster").agg(F.sum(F.col("weight") * F.col("weight")).alias("norm"))
    # the norms, one number per cluster, go along in the plan
    known = sorted((r["cluster"], r["norm"]) for r in norms.collect())
    clusters, lengths = F.lit([c for c, _ in known]), F.lit([n for _, n in known])
    # per feature one list of its centres' weights
    often = vectors.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    by_feature = stored_rows(centres.groupBy("feature").agg(F.collect_list(F.struct("cluster", F.col("weight").alias("w"))).alias("cs"))
                             .join(often, "feature"), "centres")
    # an entry's own square stands beside its products with the centres, without a cluster
    own = F.array(F.struct(F.lit(None).cast("int").alias("cluster"), F.col("weight").alias("w")))
    parts = (common_first_join(vectors, by_feature, "feature", "left")
             .select(key, "weight", F.explode(F.when(F.col("cs").isNull(), own).otherwise(F.concat(own, "cs"))).alias("c")))
    sums = parts.groupBy(key, F.col("c.cluster").alias("cluster")).agg(F.sum(F.col("weight") * F.col("c.w")).alias("dot"))
    of_centre = F.col("cluster").isNotNull() & F.col(key).isNotNull()
    per_vector = sums.groupBy(key).agg(
        F.max(F.when(F.col("cluster").isNull(), F.col("dot"))).alias("own"),
        F.map_from_entries(F.collect_list(F.when(of_centre, F.struct("cluster", "dot")))).alias("dots"))
    distance = F.transform(clusters, lambda c, i: F.struct(
        F.greatest(F.col("own") - 2 * F.coalesce(F.try_element_at(F.col("dots"), c), F.lit(0.0)) + F.get(lengths, i),
                   F.lit(0.0)).alias("d"), c.alias("cluster")))
    best = per_vector.select(key, F.array_min(distance).alias("best"))
    return best.select(key, F.col("best.cluster").alias("cluster"), F.sqrt("best.d").alias("distance"))


def nearest_members(assigned: DataFrame, n: int, key: str = "id") -> DataFrame:
    """(cluster, rank, key, distance): the ``n`` members nearest to each centre, as a reader would look at them."""
    from .rank import top_n_per_group
    return (top_n_per_group(assigned, ["cluster"], [F.col("distance").asc(), F.col(key).asc()], n, rank_col="rank")
            .select("cluster", "rank", key, "distance"))


def topic_clusters(members: DataFrame) -> DataFrame:
    """Per cluster: member count, mean score, number of questions."""
    return (members.groupBy("cluster")
                   .agg(F.count(F.lit(1)).alias("post_count"),
                        F.avg("score").alias("avg_score"),
                        F.sum("n_questions").alias("question_count"),
                        F.count_distinct("product").alias("product_count")))
