from pyspark.sql import functions as F

from threadmill.operators import tables as TB
from threadmill.schemas import FAQ_DOCUMENT_SCHEMA, PRODUCT_SCHEMA

DOC_DDL = ("product string, model_used string, updated_at timestamp_ntz, n int")


def _docs(spark, rows):
    return spark.createDataFrame(rows, DOC_DDL)


def test_faq_upsert_new_newer_older_twice(spark):
    from datetime import datetime as dt
    existing = _docs(spark, [("a", "large", dt(2024, 1, 1), 1), ("b", "large", dt(2024, 3, 1), 2)])
    incoming = _docs(spark, [("a", "small", dt(2024, 2, 1), 3),      # newer -> replaces
                             ("b", "small", dt(2024, 2, 1), 4),      # older -> ignored
                             ("c", "large", dt(2024, 2, 1), 5)])     # new product
    once = TB.faq_upsert(existing, incoming)
    twice = TB.faq_upsert(once, incoming)
    got = sorted((r.product, r.n) for r in twice.collect())
    assert got == [("a", 3), ("b", 2), ("c", 5)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def _products(spark, rows):
    full = [(i, n, None, [], [], None, None, None, None, 0, s) for i, n, s in rows]
    return spark.createDataFrame(full, PRODUCT_SCHEMA)


def test_delete_cascade(spark):
    prods = _products(spark, [(1, "has docs", "pending"), (2, "no docs", "pending"),
                              (3, "kept", "pending")])
    docs = spark.createDataFrame([("has docs", [], None, "large", 1, None),
                                  ("kept", [], None, "large", 1, None)], FAQ_DOCUMENT_SCHEMA)
    dels = spark.createDataFrame([(1,), (2,), (99,)], "id long")   # 99: unknown id
    kp, kd = TB.delete_cascade(prods, docs, dels)
    assert [r.id for r in kp.collect()] == [3]
    assert [r.product for r in kd.collect()] == ["kept"]


def test_insert_new_products(spark):
    prods = _products(spark, [(1, "exists", "completed")])
    req = spark.createDataFrame(
        [("exists", 0, None, None, None, None), ("new", 1, None, ["r/x"], None, None),
         ("new", 2, None, ["r/y"], None, None), ("bare", 3, None, None, None, None)],
        "name string, request_pos int, description string, subreddits array<string>, "
        "keywords array<string>, category string")
    out = TB.insert_new_products(prods, req, F.lit("2024-01-01").cast("timestamp_ntz"))
    got = sorted((r.name, r.subreddits, r.status, r.faq_count) for r in out.collect())
    assert got == [("bare", ["technology", "gadgets"], "pending", 0),
                   ("new", ["r/x"], "pending", 0)]


def test_product_status_latest_run(spark):
    prods = _products(spark, [(1, "a", "pending"), (2, "b", "pending")])
    runs = spark.createDataFrame(
        [(1, "scrape", "ok", 1, 10), (1, "generate", "failed", 5, 11),
         (1, "process", "ok", 5, 9)],    # same time: higher run id wins
        "product_id long, stage string, outcome string, ts int, run_id long")
    got = {r.id: r.status for r in TB.product_status(prods, runs).collect()}
    assert got == {1: "error", 2: "pending"}


def test_product_status_transitions(spark):
    prods = _products(spark, [(1, "a", "pending"), (2, "b", "completed"), (3, "c", "pending"),
                              (4, "d", "pending")])
    runs = spark.createDataFrame(
        [(1, "full_run", "failed", 1, 1), (2, "scrape", "failed", 2, 2),
         (3, "process", "timeout", 3, 3), (4, "full_run", "running", 4, 4)],
        "product_id long, stage string, outcome string, ts int, run_id long")
    got = {r.id: r.status for r in TB.product_status(prods, runs).collect()}
    # a failed scrape trigger leaves the status as it was
    assert got == {1: "pipeline_error", 2: "completed", 3: "processing_timeout",
                   4: "pipeline_scraping"}


def test_validate_and_page(spark):
    req = spark.createDataFrame([("",), ("x",), ("y" * 200,), ("z" * 201,), (None,)], "name string")
    got = [(r.valid, r.reason) for r in TB.validate_products(req).collect()]
    assert got == [(False, "name empty"), (True, None), (True, None),
                   (False, "name too long"), (False, "name empty")]
    import pytest
    with pytest.raises(ValueError):
        TB.product_page(req, limit=101)


def test_status_counts_zero_filled(spark):
    prods = _products(spark, [(1, "a", "scraping"), (2, "b", "processed")])
    docs = spark.createDataFrame([], FAQ_DOCUMENT_SCHEMA)
    r = TB.status_counts(prods, docs).first()
    assert (r.total_products, r.total_faq_documents, r.pending, r.scraping, r.other,
            r.in_progress) == (2, 0, 0, 1, 1, 1)


def test_form_requests_keywords(spark):
    forms = spark.createDataFrame([("p", "", " a , ,b\t,", ""), ("q", "d", None, "c")],
                                  "name string, description string, keywords_text string, "
                                  "category string")
    got = {r.name: r for r in TB.form_requests(forms).collect()}
    assert got["p"].keywords == ["a", "", "b", ""]
    assert got["p"].description is None and got["p"].category is None
    assert got["q"].keywords is None and got["q"].category == "c"


def test_update_products_latest_change_wins(spark):
    prods = spark.createDataFrame(
        [(1, "a", "d1", ["s"], ["k"], "c", "pending"), (2, "b", "d2", ["s"], ["k"], "c", "done")],
        "id long, name string, description string, subreddits array<string>, "
        "keywords array<string>, category string, status string")
    ch = spark.createDataFrame(
        [(1, "a1", "x", ["t"], [], "c1", 1), (1, "a2", "y", ["u"], ["z"], "c2", 3),
         (1, "a0", "w", [], [], "c0", 2)],
        "id long, name string, description string, subreddits array<string>, "
        "keywords array<string>, category string, seq int")
    out = {r.id: r for r in TB.update_products(prods, ch, order_col="seq").collect()}
    assert len(out) == 2
    assert (out[1].name, out[1].description, out[1].subreddits, out[1].keywords,
            out[1].category, out[1].status) == ("a2", "y", ["u"], ["z"], "c2", "pending")
    assert out[2].name == "b" and out[2].description == "d2"
    assert TB.update_products(prods, ch).count() == 2          # no order: still one row each
    # a change without keywords takes the request default
    ch2 = ch.where("seq = 1").withColumn("keywords", F.lit(None).cast("array<string>"))
    r = [r for r in TB.update_products(prods, ch2).collect() if r.id == 1][0]
    assert r.keywords == list(TB.DEFAULT_PRODUCT_KEYWORDS) and r.name == "a1"
