import math
import random
from collections import Counter

from threadmill.operators import topics as TP
from threadmill.operators.joins import common_first_join
from threadmill.plans import registry as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_inside_the_row(spark):
    docs = [(1, ["b", "a", "b"]), (1, ["b"]), (2, []), (3, None), (4, ["", "x", ""])]
    rows = TP.term_rows(spark.createDataFrame(docs, "id long, filtered array<string>"), "id")
    assert "Exchange" not in plan(rows)
    want = [(i, w, n) for i, words in docs for w, n in Counter(words or []).items()]
    assert sorted(map(tuple, rows.collect())) == sorted(want)


def test_common_keys_are_broadcast_and_rare_ones_shuffled(spark):
    rng = random.Random(3)
    left = [(i, f"k{int(rng.paretovariate(0.5)) % 300}") for i in range(3000)]
    often = Counter(k for _, k in left)
    side = [(k, n, k.upper()) for k, n in often.items() if int(k[1:]) % 7]
    a = spark.createDataFrame(left, "id long, feature string")
    b = spark.createDataFrame(side, "feature string, n long, big string")
    meets = {k: v for k, _, v in side}
    for bound in (0, 1500, 1 << 20):
        for how in ("inner", "left"):
            out = common_first_join(a, b, "feature", how, max_bytes=bound)
            want = [(i, k, meets.get(k)) for i, k in left if how == "left" or k in meets]
            assert sorted(out.columns) == ["big", "feature", "id"]
            key = lambda r: (r[0], r[1], r[2] or "")
            assert sorted(map(tuple, out.select("id", "feature", "big").collect()), key=key) == sorted(want, key=key)


def test_assign_shuffles_one_number_per_vector_and_centre(spark):
    """The products of a vector's entries are summed in the task they lie in."""
    n_terms, n_vectors = 200, 300
    docs = spark.range(n_vectors).repartition(4).selectExpr(
        "id", f"transform(sequence(1, {n_terms}), i -> concat('t', i)) AS filtered").checkpoint()
    vectors = TP.term_rows(docs, "id").selectExpr("id", "feature", "CAST(n AS DOUBLE) AS weight")
    centres = spark.range(4).selectExpr("CAST(id AS INT) AS cluster", f"explode(sequence(1, {n_terms})) AS i").selectExpr(
        "cluster", "concat('t', i) AS feature", "1.0D + cluster AS weight").checkpoint()
    out = TP.assign_topics(vectors, centres)
    rows = out.collect()
    assert len(rows) == n_vectors and {(r.cluster, r.distance) for r in rows} == {(0, 0.0)}
    written = []

    def walk(node):
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(out._jdf.queryExecution().executedPlan())
    assert written and max(written) <= n_vectors * 5


def test_topic_queries_merge_rows_of_one_record(spark, scratch):
    """Rows that come twice are one vector of twice the counts."""
    texts = ["alpha beta gamma delta epsilon", "alpha alpha beta zeta eta theta words", "gamma delta iota kappa lambda"]
    rows = [(i, texts[i % 3] + f" only{i} words here", "en", f"src{i % 2}") for i in range(9)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(
        f"{scratch}/documents.parquet")
    words = {i: [w for w in t.split() if w not in TP.ENGLISH_STOP_WORDS] for i, t, _, _ in rows}
    df = Counter(w for ws in words.values() for w in set(ws) for _ in range(2))
    vec = {i: {w: 2 * n * math.log((len(rows) + 1) / (df[w] + 1)) for w, n in Counter(ws).items()} for i, ws in words.items()}
    centres = []
    for p in range(2):
        c = Counter()
        for i in range(9):
            if i % 2 == p:
                c.update(vec[i])
        members = 2 * sum(i % 2 == p for i in range(9))
        centres.append({w: v / members for w, v in c.items()})
    got = {r.id: r for r in R.QUERIES["topic_assign"](spark, scratch).collect()}
    assert sorted(got) == list(range(9))
    for i in range(9):
        far = [math.sqrt(max(0, sum((vec[i].get(w, 0) - c.get(w, 0)) ** 2 for w in {*vec[i], *c}))) for c in centres]
        assert abs(got[i].distance - min(far)) < 2e-6 and abs(far[got[i].cluster] - min(far)) < 1e-9


def test_the_terms_of_a_record_lie_together(spark, scratch):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(60)), "en", f"src{i % 3}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).write.parquet(
        f"{scratch}/documents.parquet")
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        vectors, _ = R._topic_tables(spark, scratch)
        places = vectors.selectExpr("id", "spark_partition_id() AS p").distinct().groupBy("id").count().collect()
    finally:
        spark.conf.set(key, old)
    assert len(places) == 40 and {r["count"] for r in places} == {1}
