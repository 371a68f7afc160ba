"""Stored tables: buckets that a change does not touch, index searches, pages, topic tables."""

import glob
import os

from pyspark.sql import functions as F

from threadmill.operators import responses as R
from threadmill.operators import store as SO
from threadmill.operators import tables as TB
from threadmill.operators import topics as TP

DOCS = "product string, model_used string, updated_at string"
SF = "/root/testdata/sf0.001"


def files(root):
    return {f: os.path.getmtime(f) for f in glob.glob(os.path.join(root, "*", "*.parquet"))}


def test_upsert_rewrites_only_the_buckets_it_touches(spark, scratch):
    root = os.path.join(scratch, "docs")
    first = spark.createDataFrame([(f"p{i}", "large", "2024-01-01") for i in range(200)], DOCS)
    SO.upsert_documents(first, root, buckets=16)
    before = files(root)
    change = spark.createDataFrame([("p7", "small", "2024-02-01"), ("p7", "older", "2023-01-01"), ("new", "large", "2024-02-01"),
                                    ("p9", "older", "2023-01-01")], DOCS)
    for _ in range(2):
        SO.upsert_documents(change, root, buckets=16)
        docs = {r["product"]: (r.model_used, r.updated_at) for r in SO.read_documents(spark, root).collect()}
        assert len(docs) == 201 == SO.read_documents(spark, root).count()
        assert docs["p7"] == ("small", "2024-02-01") and docs["p9"] == ("large", "2024-01-01") and "new" in docs
    touched = {r[0] for r in change.select(F.pmod(F.xxhash64("product"), F.lit(16))).distinct().collect()}
    after = files(root)
    kept = {f for f in before if int(f.split(SO.BUCKET + "=")[1].split("/")[0]) not in touched}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert len(kept) < len(before)
    SO.upsert_documents(change.limit(0), root, buckets=16)
    assert files(root) == after


def test_lookup_reads_one_bucket(spark, scratch):
    root = os.path.join(scratch, "docs")
    SO.upsert_documents(spark.createDataFrame([(f"p{i}", "large", "2024") for i in range(200)], DOCS), root, buckets=16)
    one = SO.read_documents(spark, root, "p42", buckets=16)
    assert [r["product"] for r in one.collect()] == ["p42"]
    assert SO.read_documents(spark, root, "absent", buckets=16).count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and plan.count(SO.BUCKET) > 0
    scan = spark.read.parquet(root).where(F.col(SO.BUCKET) == F.pmod(F.xxhash64(F.lit("p42")), F.lit(16)).cast("int"))
    assert scan.select(F.input_file_name()).distinct().count() == 1


def test_search_through_the_index_equals_the_scan(spark, scratch):
    root = os.path.join(scratch, "index")
    rows = [("a", 0, "What is THE battery life?", "Ten hours", "Battery"), ("a", 1, "Größe?", "GRÖSSE xl", None),
            ("b", 0, "abcd xbcda", "none", "Setup"), ("b", 1, "abxcd", None, "bcd"), ("c", 0, "", "", ""),
            ("c", 1, "100% [sic] a.b", "x\\y", "(?i)"), ("d", 0, "😀 smile 😀😀😀", "lineone\nlinetwo", "General")]
    rows += [("z", i, f"question number {i}", f"answer {i * 7}", "General") for i in range(200)]
    entries = spark.createDataFrame(rows, "product string, entry_pos int, question string, answer string, category string")
    SO.write_entry_index(entries, root)
    for term in ("battery", "BATTERY l", "größe", "bcd", "abcd", "abcda", "zzz", "ab", "", "a", "100%", "[sic]", "a.b", "\\y",
                 "(?i)", "😀😀", "😀😀😀", "one\nline", "number 19", "general", "answer 7"):
        want = sorted((r["product"], r.entry_pos) for r in R.faq_search(entries, term).collect())
        assert sorted((r["product"], r.entry_pos) for r in SO.search_index(spark, root, term).collect()) == want, term


def test_pages_equal_the_sorted_table(spark, scratch):
    root = os.path.join(scratch, "pages")
    products = spark.range(0, 500).select(
        "id", F.concat(F.lit("n"), "id").alias("name"), F.lit("pending").alias("status"),
        (F.col("id") * 37 % 41).cast("timestamp").alias("created_at")).repartition(7)
    SO.write_pages(products, root, range_rows=60)
    for skip, limit in ((0, 10), (55, 100), (60, 60), (333, 50), (480, 100), (500, 5), (9999, 5)):
        want = [tuple(r) for r in TB.product_page(products, skip, limit).collect()]
        page = SO.read_page(spark, root, skip, limit)
        assert [tuple(r) for r in page.collect()] == want
        assert page.select(F.input_file_name()).distinct().count() <= 3
    SO.write_pages(products.limit(0), os.path.join(scratch, "none"))


def test_small_ranges_make_few_folders(spark, scratch, monkeypatch):
    """Folders and tasks follow the rows, not the ranges; a range may lie in two blocks."""
    products = spark.range(5000).select(
        "id", F.concat(F.lit("n"), "id").alias("name"), F.lit("pending").alias("status"),
        (F.col("id") * 37 % 41).cast("timestamp").alias("created_at")).repartition(3)
    for block in (SO.BLOCK_ROWS, 700):
        monkeypatch.setattr(SO, "BLOCK_ROWS", block)
        root = os.path.join(scratch, f"pages{block}")
        SO.write_pages(products, root, range_rows=20)
        assert len([f for f in os.listdir(f"{root}/rows") if "=" in f]) <= -(-5000 // block)
        for skip, limit in ((0, 10), (75, 60), (3333, 100), (4990, 50)):
            want = [tuple(r) for r in TB.product_page(products, skip, limit).collect()]
            assert [tuple(r) for r in SO.read_page(spark, root, skip, limit).collect()] == want


def test_assigned_topics_equal_the_fitted_model(spark):
    """Centres as rows and one join give the clusters and distances that the model gives."""
    import numpy as np

    from threadmill.operators import scoring
    from threadmill.sources import adapters as A
    weighted, model = TP.fit_topics(TP.term_counts(scoring.process(A.social(spark, SF))), k=4)
    centres = TP.centre_rows(model, spark)
    assigned = {r.id: r for r in TP.assign_topics(TP.long_vectors(weighted, "id"), centres).collect()}
    points = np.array(model.clusterCenters())
    rows = weighted.collect()
    assert len(assigned) == sum(r.features.numNonzeros() > 0 for r in rows)
    for r in rows:
        if r.features.numNonzeros():
            d = np.sqrt(((points - r.features.toArray()) ** 2).sum(1))
            assert abs(assigned[r.id].distance - d.min()) < 1e-6 and d[assigned[r.id].cluster] - d.min() < 1e-6
    near = TP.nearest_members(TP.assign_topics(TP.long_vectors(weighted, "id"), centres), 3).collect()
    for c in {r.cluster for r in assigned.values()}:
        best = sorted((r.distance, r.id) for r in assigned.values() if r.cluster == c)[:3]
        assert [r.id for r in sorted((n for n in near if n.cluster == c), key=lambda n: n["rank"])] == [i for _, i in best]
    weighted.unpersist()
