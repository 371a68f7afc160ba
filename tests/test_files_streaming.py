import os

import pytest
from pyspark.sql import functions as F

from threadmill.sources import adapters as A
from threadmill.sources import files as FS
from threadmill.sources import queue as Q
from threadmill.streaming import landing as ST

SF = "/root/testdata/sf0.001"


def test_first_n_files_skips_corrupt_file(spark, scratch):
    root = os.path.join(scratch, "batches")
    FS.write_batch_files(A.social(spark, SF), root, flush_size=100)
    # a broken file placed first in one product folder takes a slot and is skipped
    pdir = os.path.join(root, "source=reddit", "product_slug=src1", "flush=f0000000000")
    with open(os.path.join(pdir, "a-broken.txt"), "w") as f:
        f.write('[{"id": 1, "content": ')
    rows = FS.first_n_files(spark, root, n=1).collect()
    assert all(r.product_slug != "src1" for r in rows)
    assert len({r.product_slug for r in rows}) >= 2
    # counting reads no record field; the broken file must still be skipped
    assert FS.first_n_files(spark, root, n=1).count() == len(rows)
    two = FS.first_n_files(spark, root, n=2)
    assert two.count() == len(two.collect()) == len(rows) + 100
    # restricted to products: only their folders are listed and read
    some = FS.first_n_files(spark, root, n=2, slugs=["src1", "src3", "absent"]).collect()
    assert {r.product_slug for r in some} == {"src1", "src3"}
    assert sorted(r.id for r in some) == sorted(
        r.id for r in two.collect() if r.product_slug in ("src1", "src3"))
    assert FS.first_n_files(spark, root, slugs=["absent"]).count() == 0


def test_raw_scan_folder_variants(spark, scratch):
    root = os.path.join(scratch, "landing")
    base = A.social(spark, SF).limit(30)
    from pyspark.sql import functions as F
    rows = base.withColumn("product", F.when(F.col("id") % 2 == 0, F.concat("product", F.lit(" ")))
                           .otherwise(F.col("product")))
    FS.write_landing(rows, root)
    got = FS.raw_scan(spark, root).collect()
    slugs = {}
    for r in got:
        slugs.setdefault(r.product_slug.rstrip("_"), set()).add(r.product_slug)
    assert all(len(v) == 1 for v in slugs.values())     # one folder variant per product
    only = FS.raw_scan(spark, root, slugs=["src1"]).collect()
    assert {r.product_slug.rstrip("_") for r in only} <= {"src1"}


def _landed(spark, scratch, rows):
    root = os.path.join(scratch, "landing")
    df = spark.createDataFrame(rows, "id long, source string, product string, content string")
    FS.write_landing(df, root)
    return root


def test_raw_scan_decides_per_source_and_by_data(spark, scratch):
    rows = [(i, "reddit", "src3", "a") for i in range(5)] + [(10 + i, "other", "src3 ", "b") for i in range(7)]
    rows += [(30 + i, "other", "src4 ", "c") for i in range(3)]
    root = _landed(spark, scratch, rows)
    # an exact folder that holds only a marker does not hide the filled one
    empty = os.path.join(root, "source=other", "product_slug=src4")
    os.makedirs(empty)
    open(os.path.join(empty, "_SUCCESS"), "w").close()
    ids = lambda **k: sorted(r.id for r in FS.raw_scan(spark, root, **k).collect())
    assert ids() == sorted(r[0] for r in rows)
    assert ids(source="reddit") == list(range(5))
    assert ids(source="other", slugs=["src3"]) == list(range(10, 17))
    assert ids(slugs=["src4"]) == [30, 31, 32]


def test_first_n_files_variants_and_json_names(spark, scratch):
    root = os.path.join(scratch, "batches")
    for slug, names in (("a", ["2.json", "1.json", "3.json"]), ("b_", ["1.json"]), ("c", ["1.json"]), ("c_", ["1.json"])):
        folder = os.path.join(root, "source=reddit", f"product_slug={slug}")
        os.makedirs(folder)
        for n in names:
            with open(os.path.join(folder, n), "w") as f:
                f.write('[{"id": %d, "content": "%s"}]' % (int(n[0]), slug))
    got = sorted((r.product_slug, r.id) for r in FS.first_n_files(spark, root, n=2).collect())
    assert got == [("a", 1), ("a", 2), ("b_", 1), ("c", 1)]
    assert [r.id for r in FS.first_n_files(spark, root, slugs=["b"]).collect()] == [1]
    assert FS.first_n_files(spark, root, source="forum").count() == 0


def test_latest_copy_keeps_other_products_and_raises_other_errors(spark, scratch):
    from threadmill.plans import jobs
    landing, out = os.path.join(scratch, "landing"), os.path.join(scratch, "out")
    FS.write_landing(A.social(spark, SF), landing)
    jobs.process(spark, landing, out, run_id="r1")
    latest = os.path.join(out, "processed", "latest.json")
    before = FS.read_latest(spark, latest).groupBy("product_slug").count().collect()
    jobs.process(spark, landing, out, product="src3", run_id="r2", cap=1)
    after = {r.product_slug: r["count"] for r in FS.read_latest(spark, latest).groupBy("product_slug").count().collect()}
    assert after == {r.product_slug: r["count"] for r in before} | {"src3": 1}
    assert FS.read_latest(spark, os.path.join(scratch, "nothing")).count() == 0
    with pytest.raises(Exception):
        FS.read_latest(spark, "nosuchfs://host/latest.json").count()


def test_versions_are_committed_ones_in_order(spark, scratch):
    from threadmill.plans import jobs
    landing, out = os.path.join(scratch, "landing"), os.path.join(scratch, "out")
    FS.write_landing(A.social(spark, SF), landing)
    snap = jobs.process(spark, landing, out, run_id="r1", cap=3)["output_path"]
    model = jobs.load_model("threadmill.operators.inference:echo_model")()
    os.makedirs(os.path.join(out, "faqs", "version=r99", "_temporary"))
    for run in ("r9", "r10"):
        jobs.generate(spark, snap, out, model, run_id=run)
        os.utime(os.path.join(out, "faqs", f"version={run}", "_SUCCESS"), (100, 100 if run == "r9" else 200))
    assert [v.rsplit("=")[-1] for v in jobs._versions(spark, os.path.join(out, "faqs"))] == ["r9", "r10"]
    with pytest.raises(ValueError):
        jobs.generate(spark, snap, out, model, run_id="r9")


def test_cluster_needs_a_shared_checkpoint_folder():
    from threadmill import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.checkpoint_root(Session())


def test_stream_landing_writes_one_file_per_folder_and_batch(spark, scratch):
    inbox, out = os.path.join(scratch, "inbox"), os.path.join(scratch, "landing")
    ST.stage_messages(A.queue_messages(spark, SF).repartition(6), inbox)
    ST.run_to_end(ST.start_land(ST.file_queue_source(spark, inbox, files_per_batch=100), out,
                                os.path.join(scratch, "bad"), os.path.join(scratch, "ck")))
    files = FS.data_files(spark, out, glob="*.json").groupBy("source", "product_slug").count().collect()
    assert files and all(r["count"] == 1 for r in files)


def test_stream_restart_adds_nothing(spark, scratch):
    inbox, out, ck = (os.path.join(scratch, x) for x in ("inbox", "landing", "ck"))
    ST.stage_messages(A.queue_messages(spark, SF), inbox, n_files=3)
    for _ in range(2):                       # second run resumes from the checkpoint
        q = ST.start_land(ST.file_queue_source(spark, inbox, files_per_batch=1), out, out + "-bad", ck)
        ST.run_to_end(q)
    landed = spark.read.schema(FS._landing_schema(FS.RAW_WITH_ID_SCHEMA)).json(out)
    expected = Q.good_records(Q.decode(A.queue_messages(spark, SF)))
    assert landed.count() == expected.count()
    assert landed.select("id").distinct().count() == landed.count()


def test_quarantine_split(spark):
    m = A.queue_messages(spark, SF)
    d = Q.decode(m)
    assert Q.good_records(d).count() + Q.quarantine(d).count() == m.count()
    assert all('"content": "' in r.value for r in Q.quarantine(d).collect())


def test_process_job_summary(spark, scratch):
    from threadmill.plans import jobs
    landing = os.path.join(scratch, "landing")
    FS.write_landing(A.social(spark, SF), landing)
    summary = jobs.process(spark, landing, os.path.join(scratch, "out"), run_id="r1", cap=5)
    assert summary["total_records"] == A.social(spark, SF).count()
    snap = spark.read.parquet(summary["output_path"])
    assert snap.count() == summary["processed_records"]
    assert snap.groupBy("product").count().where("count > 5").count() == 0
    latest = FS.read_latest(spark, os.path.join(scratch, "out", "processed", "latest.json"))
    assert latest.count() == summary["processed_records"]
    one = jobs.process(spark, landing, os.path.join(scratch, "out1"), product="src3", run_id="r2")
    assert one["products"] == 1


def test_stream_clean_equals_batch(spark, scratch):
    """The stateless scoring gives the same rows on the stream and in batch."""
    from threadmill.operators import scoring
    inbox, land_dir = os.path.join(scratch, "in"), os.path.join(scratch, "landed")
    ST.stage_messages(A.queue_messages(spark, SF), inbox, n_files=2)
    ST.run_to_end(ST.start_land(ST.file_queue_source(spark, inbox), land_dir, os.path.join(scratch, "bad"),
                                os.path.join(scratch, "ck1")))
    out = os.path.join(scratch, "clean")
    ST.run_to_end(ST.start_clean(ST.landing_stream(spark, land_dir), out,
                                 os.path.join(scratch, "ck2")))
    cols = ["id", "product", "relevance_score", "content_length", "has_question"]
    streamed = sorted(map(tuple, spark.read.parquet(out).select(*cols).collect()))
    batch = scoring.process(Q.good_records(Q.decode(A.queue_messages(spark, SF))))
    assert streamed == sorted(map(tuple, batch.select(*cols).collect()))


def test_small_side_is_broadcast(spark):
    from threadmill.operators.joins import small_side
    big = spark.range(0, 100000).withColumnRenamed("id", "k")
    small = spark.range(0, 10).withColumnRenamed("id", "k")
    plan = big.join(small_side(small), "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan2 = big.join(small_side(small, max_bytes=50), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Broadcast" not in plan2 and "SortMergeJoin" in plan2
    # the bound is on bytes: few rows with long text are not small
    from threadmill.operators.joins import measured_bytes
    long = spark.range(3).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    assert measured_bytes(long) >= 300_000


def test_raw_scan_reads_array_files(spark, scratch):
    root = os.path.join(scratch, "arrays")
    recs = A.social(spark, SF)
    FS.write_batch_files(recs, root, flush_size=50)
    got = FS.raw_scan(spark, root, multi_line=True, glob="*.txt")
    assert sorted(r.id for r in got.select("id").collect()) == \
           sorted(r.id for r in recs.select("id").collect())


def test_processing_time_trigger_then_stop_and_resume(spark, scratch):
    """Continuous mode (30 s trigger): all available data is processed, the
    query is stopped, and a restart on the same checkpoint adds nothing."""
    inbox, out, ck = (os.path.join(scratch, x) for x in ("inbox", "landing", "ck"))
    ST.stage_messages(A.queue_messages(spark, SF), inbox, n_files=2)
    q = ST.start_land(ST.file_queue_source(spark, inbox), out, out + "-bad", ck, available_now=False)
    q.processAllAvailable()
    q.stop()
    schema = FS._landing_schema(FS.RAW_WITH_ID_SCHEMA)
    n1 = spark.read.schema(schema).json(out).count()
    ST.run_to_end(ST.start_land(ST.file_queue_source(spark, inbox), out, out + "-bad", ck))
    assert spark.read.schema(schema).json(out).count() == n1 > 0


def test_land_job_splits_and_reruns_exactly_once(spark, scratch):
    from threadmill.plans import jobs
    inbox, landing, bad, ck = (os.path.join(scratch, x)
                               for x in ("inbox", "landing", "quarantine", "ck"))
    msgs = A.queue_messages(spark, SF)
    ST.stage_messages(msgs, inbox, n_files=3)
    for _ in range(2):                       # the rerun resumes: nothing twice
        jobs.land(spark, inbox, landing, bad, ck)
    landed = spark.read.schema(FS._landing_schema(FS.RAW_WITH_ID_SCHEMA)).json(landing)
    d = Q.decode(msgs)
    assert landed.count() == Q.good_records(d).count()
    assert landed.select("id").distinct().count() == landed.count()
    assert spark.read.json(bad).count() == Q.quarantine(d).count() > 0


def test_generate_job_versions_upsert(spark, scratch):
    from threadmill.plans import jobs
    landing, out = os.path.join(scratch, "landing"), os.path.join(scratch, "out")
    FS.write_landing(A.social(spark, SF), landing)
    snap = jobs.process(spark, landing, out, run_id="r1", cap=5)["output_path"]
    model = jobs.load_model("threadmill.operators.inference:echo_model")()
    first = jobs.generate(spark, snap, out, model, run_id="g1")
    products = spark.read.parquet(snap).select("product").distinct().count()
    assert first["documents"] == products > 0 and first["entries"] == products
    second = jobs.generate(spark, snap, out, model, run_id="g2")
    docs = spark.read.parquet(second["output_path"])
    assert second["documents"] == products == docs.select("product").distinct().count()
    assert [os.path.basename(v) for v in jobs._versions(spark, os.path.join(out, "faqs"))] == \
        ["version=g1", "version=g2"]
    # the stand-in answers in Q:/A: lines, which only the small provider may parse,
    # so the first usable provider is the small one
    row = docs.first()
    assert row.model_used == "small" and row.faqs[0].question.startswith("What do users ask")


def test_a_scan_lists_and_reads_its_own_folders_only(spark, scratch):
    root = os.path.join(scratch, "landing")
    rows = [(i, "reddit" if i % 2 else "other", f"odd {{name}}, {i % 5}" if i % 5 < 2 else f"src{i % 5}", "c") for i in range(50)]
    FS.write_landing(spark.createDataFrame(rows, "id long, source string, product string, content string"), root)
    everything = FS.data_files(spark, root).count()
    for source, slug in (("reddit", "src3"), (None, "src4"), ("other", "odd_{name},_1")):
        want = sorted(i for i, s, p, _ in rows if source in (None, s) and p.lower().replace(" ", "_") == slug)
        scan = FS.raw_scan(spark, root, slugs=[slug], source=source)
        assert want and sorted(r.id for r in scan.collect()) == want
        listed = FS.data_files(spark, root, slugs=[slug], source=source)
        assert 0 < listed.count() < everything
        assert listed.count() == len(scan.inputFiles()) == (1 if source else 2)
    assert FS.raw_scan(spark, root, slugs=["absent"]).count() == 0
    assert FS.raw_scan(spark, root, source="absent").columns == FS.raw_scan(spark, root).columns


def _land_batch(spark, scratch, inbox, ck):
    return ST.start_land(ST.file_queue_source(spark, inbox, files_per_batch=1), os.path.join(scratch, "landing"),
                         os.path.join(scratch, "bad"), ck)


def test_a_replayed_batch_overwrites_its_own_folders(spark, scratch):
    """The last batch is written, its commit is lost (as when the driver dies in between), and it runs again."""
    inbox, ck = os.path.join(scratch, "inbox"), os.path.join(scratch, "ck")
    msgs = A.queue_messages(spark, SF)
    ST.stage_messages(msgs, inbox, n_files=3)
    ST.run_to_end(_land_batch(spark, scratch, inbox, ck))
    commits = sorted(int(n) for n in os.listdir(os.path.join(ck, "commits")) if n.isdigit())
    assert len(commits) >= 3
    again = os.path.join(scratch, "ck2")
    import shutil
    shutil.copytree(ck, again, ignore=lambda folder, names: [
        n for n in names if folder.endswith("commits") and n.strip(".").startswith(str(commits[-1]))])
    ST.run_to_end(_land_batch(spark, scratch, inbox, again))
    landed = FS.raw_scan(spark, os.path.join(scratch, "landing"))
    d = Q.decode(msgs)
    assert sorted(r.id for r in landed.select("id").collect()) == sorted(r.id for r in Q.good_records(d).select("id").collect())
    assert spark.read.json(os.path.join(scratch, "bad")).count() == Q.quarantine(d).count()


def test_topn_batches_and_replay(spark, scratch):
    from threadmill.operators import scoring
    from threadmill.streaming import topn as TN
    root = os.path.join(scratch, "best")
    ready = scoring.model_ready(scoring.process(A.social(spark, SF))).cache()
    parts = [ready.where(F.col("id") % 3 == k) for k in range(3)]
    want = sorted(r.id for r in scoring.faq_ready(scoring.process(A.social(spark, SF)), cap=4).collect())
    got = lambda: sorted(r.id for r in TN.read_topn(spark, root).collect())
    TN.merge_batch(parts[0], 0, root, cap=4, buckets=5)
    TN.merge_batch(parts[1], 1, root, cap=4, buckets=5)
    before = got()
    TN.merge_batch(parts[1], 1, root, cap=4, buckets=5)          # a replay
    assert got() == before
    TN.merge_batch(parts[2].where("false"), 2, root, cap=4, buckets=5)  # nothing new
    TN.merge_batch(parts[2], 3, root, cap=4, buckets=5)
    assert got() == want
    TN.merge_batch(parts[2], 3, root, cap=4, buckets=5)
    assert got() == want
    # each bucket keeps its newest folder and the one that a replay merges with
    assert all(len(n) <= 2 for n in TN._folders(spark, root).values())
    # a batch touches only the buckets of its products
    one = ready.where("product = 'src3'")
    kept = TN._folders(spark, root)
    TN.merge_batch(one, 4, root, cap=4, buckets=5)
    assert sum(4 in n for n in TN._folders(spark, root).values()) == 1 < len(kept)


def test_flush_by_count_then_rest_then_resume(spark, scratch):
    from threadmill.streaming import flush as FL
    inbox, root, ck = (os.path.join(scratch, x) for x in ("inbox", "files", "ck"))
    msgs = A.queue_messages(spark, SF)
    half = msgs.where("offset % 2 = 0")
    sizes = lambda: sorted(r["count"] for r in FS.raw_scan(spark, root, multi_line=True, glob="*.txt")
                           .groupBy("source", "product_slug", F.input_file_name()).count().collect())
    ids = lambda: sorted(r.id for r in FS.raw_scan(spark, root, multi_line=True, glob="*.txt").collect())
    expected = lambda m: sorted(r.id for r in Q.good_records(Q.decode(m)).collect())
    run = lambda: ST.run_to_end(FL.start_flush(
        Q.good_records(Q.decode(ST.file_queue_source(spark, inbox))), root, ck, size=7, lanes=2))
    ST.stage_messages(half, inbox, n_files=2)
    run()
    assert set(sizes()) <= {7}
    FL.flush_rest(spark, root, ck)
    assert ids() == expected(half) and max(sizes()) <= 7 and min(sizes()) < 7
    ST.stage_messages(msgs.where("offset % 2 = 1"), inbox, n_files=2)   # started again after the stop
    run()
    FL.flush_rest(spark, root, ck)
    assert ids() == expected(msgs) and max(sizes()) <= 7


def test_flush_by_time(spark, scratch):
    import time

    from threadmill.streaming import flush as FL
    inbox, root, ck = (os.path.join(scratch, x) for x in ("inbox", "files", "ck"))
    msgs = A.queue_messages(spark, SF).where("offset < 20")
    ST.stage_messages(msgs, inbox, n_files=1)
    q = FL.start_flush(Q.good_records(Q.decode(ST.file_queue_source(spark, inbox))), root, ck, wait_ms=1500, lanes=1,
                       available_now=False)
    want = Q.good_records(Q.decode(msgs)).count()
    found, end = 0, time.time() + 60
    try:
        while found < want and time.time() < end:     # fewer than 50 of each: only the timer can flush them
            time.sleep(1)
            found = FS.raw_scan(spark, root, multi_line=True, glob="*.txt").count() if os.path.isdir(root) else 0
    finally:
        q.stop()
    assert found == want


def test_dedup_state_is_bounded(spark, scratch):
    inbox = os.path.join(scratch, "in")
    rows = [(i, f"2024-01-01T{i // 60:02d}:{i % 60:02d}:00Z") for i in range(600)]
    for k in range(6):          # each file again holds the last minutes of the one before it
        part = spark.createDataFrame(rows[max(0, 100 * k - 20):100 * (k + 1)], "id long, scraped_at string")
        part.coalesce(1).write.mode("append").json(inbox)
    stream = spark.readStream.schema("id long, scraped_at string").option("maxFilesPerTrigger", 1).json(inbox)
    q = ST.start_dedup(stream, os.path.join(scratch, "out"), os.path.join(scratch, "ck"), "30 minutes")
    ST.run_to_end(q)
    out = spark.read.parquet(os.path.join(scratch, "out"))
    assert sorted(r.id for r in out.collect()) == list(range(600))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held and held[-1] < 300      # 30 minutes of records behind the watermark, not all 600


def test_staged_files_grow_in_number_with_the_input(spark, scratch):
    """Many input splits make many queue files, and a micro-batch takes a bounded number of them."""
    from threadmill.plans import registry as R
    spark.range(2000).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 20) AS text", "'en' AS lang",
                                 "concat('src', id % 3) AS source").repartition(6).write.parquet(f"{scratch}/documents.parquet")
    size = sum(os.path.getsize(f"{scratch}/documents.parquet/{f}") for f in os.listdir(f"{scratch}/documents.parquet"))
    conf = {"spark.sql.files.maxPartitionBytes": str(size // 40), "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        R._staged_stream(spark, scratch, f"{scratch}/s")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = [f for f in os.listdir(f"{scratch}/s/inbox") if f.endswith(".txt")]
    lines = [sum(1 for _ in open(f"{scratch}/s/inbox/{f}")) for f in files]
    assert len(files) >= 40 and sum(lines) == 2000 and max(lines) <= 2 * 2000 / len(files)


def test_files_of_many_flushes_share_few_folders(spark, scratch):
    root = os.path.join(scratch, "batches")
    recs = spark.range(3000).selectExpr("id", "'reddit' AS source", "concat('P ', id % 2) AS product", "concat('t', id) AS content")
    FS.write_batch_files(recs, root, flush_size=2)
    folders = [p for p, _, files in os.walk(root) if any(f.endswith(".txt") for f in files)]
    assert len(folders) == 6        # 3 runs of 500 flushes for each product
    assert sum(f.endswith(".txt") for p in folders for f in os.listdir(p)) == 3000
    got = FS.first_n_files(spark, root, n=700).select("id", "product_slug").collect()
    assert sorted(map(tuple, got)) == [(i, f"p_{i % 2}") for i in range(1400)]
