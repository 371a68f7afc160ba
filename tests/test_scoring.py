from pyspark.sql import functions as F

from threadmill.operators import rank, scoring

RAW_DDL = ("id long, product string, data_type string, content string, score int, url string")


def _raw(spark, rows):
    return spark.createDataFrame(rows, RAW_DDL)


def test_metrics_edge_rows(spark):
    long = "this is a fairly long text about it"
    df = _raw(spark, [
        (1, "p", "post", long, -1, "u1"), (2, "p", "post", long, 0, "u2"),
        (3, "p", "post", long, None, "u3"), (4, "p", None, long, 5, "u4"),
        (5, "p", "other", long, 5, "u5"), (6, "p", "comment", long, 5, "u6")])
    got = {r.id: r.relevance_score for r in scoring.process(df).collect()}
    assert got == {1: 0, 2: 2, 3: None, 4: 6, 5: 6, 6: 6}


def test_faq_ready_ties_and_cut(spark):
    q = "how do i reset the device quickly"
    rows = [(i, "p", "comment", q, 3, f"u{i}") for i in range(10)]          # all tie
    rows += [(100, "p", "comment", "plain statement without question", 0, "u100")]  # rel 1, no q
    rows += [(200, "p", "comment", "plain statement without question", 1, "u200")]  # rel 2
    rows += [(300, "s", "post", q, 0, "u300")]                              # fewer than cut
    df = scoring.process(_raw(spark, rows))
    ready = scoring.faq_ready(df, cap=4, rank_col="rank").collect()
    by = {}
    for r in ready:
        by.setdefault(r.product, []).append((r.rank, r.id))
    assert sorted(by["p"]) == [(1, 0), (2, 1), (3, 2), (4, 3)]   # ties broken by id
    assert by["s"] == [(1, 300)]
    allowed = {r.id for r in scoring.model_ready(df).collect()}
    assert 100 not in allowed and 200 in allowed


def test_fanout_top_n_equals_plain(spark):
    df = spark.range(0, 5000).select(
        (F.col("id") % 3).alias("g"), F.col("id"), ((F.col("id") * 7919) % 101).alias("v"))
    df = df.repartition(16)
    order = [F.col("v").desc(), F.col("id").asc()]
    a = rank.top_n_per_group(df, ["g"], order, 25, rank_col="r").collect()
    b = rank.top_n_per_group(df, ["g"], order, 25, rank_col="r", tasks=1000).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert len(a) == 75


def test_run_summary_counts(spark):
    long = "how does this thing work with the other one"
    df = _raw(spark, [(1, "p", "post", long, 0, "u"), (2, "p", "comment", "tiny", 9, "u"),
                      (3, "p", "comment", "nothing to ask about in this text", 0, "u")])
    r = scoring.run_summary(df, cap=500).first()
    assert (r.total_records, r.cleaned_records, r.question_records, r.processed_records) == \
           (3, 2, 1, 1)


def test_flagship_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"product", "content", "relevance_score", "rank"} <= set(df.columns)
