"""Batch and stream jobs (``spark-submit threadmill/plans/jobs.py ...``).

    process --landing DIR --out DIR [--product NAME] [--run-id ID]
        landing table -> clean, extract, score -> top rows per product ->
        Parquet snapshot + latest JSON copy; prints a JSON run summary.
    generate --processed DIR --out DIR --model MODULE:FUNCTION [--run-id ID]
        processed snapshot -> best 200 rows per product -> prompts -> the
        caller's model (Arrow batches; the second provider only for products
        that the first gave no entries; answers kept in ``OUT/responses``, so
        a rerun asks new prompts only) -> entries -> first usable provider ->
        documents, upserted into ``OUT/faqs``; prints a JSON summary.  A
        function ``is_available(provider)`` of the module, if there is one,
        says whether a provider can be asked.
    land --inbox DIR --landing DIR --quarantine DIR --checkpoints DIR [--continuous]
         [--kafka SERVERS --max-offsets N]
        queue messages (text files, or Kafka with --kafka SERVERS) -> landing
        table and quarantine in one query, exactly once by batch folders.  A micro-batch
        takes at most N offsets (default CLUSTER_MAX_OFFSETS; the reference's
        50-message flush would make every batch's fixed cost dominate).

All products are processed in one plan (the reference runs one process per
product).  Counts come from ``DataFrame.observe`` on the write itself, so the
summary costs no extra pass over the data.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

if __package__ in (None, ""):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from threadmill.functions.text import product_slug  # noqa: E402
from threadmill.operators import inference as INF  # noqa: E402
from threadmill.operators import prompts as P  # noqa: E402
from threadmill.operators import responses as R  # noqa: E402
from threadmill.operators import scoring  # noqa: E402
from threadmill.operators import tables as TB  # noqa: E402
from threadmill.session import build_session  # noqa: E402
from threadmill.sources import files as FS  # noqa: E402
from threadmill.streaming import landing as ST  # noqa: E402


def process(spark: SparkSession, landing: str, out: str, product: str | None = None,
            run_id: str | None = None, cap: int = scoring.FAQ_READY_CAP,
            source: str | None = None) -> dict:
    """One processing run over all sources or one; returns the run summary."""
    run_id = run_id or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    slugs = [product.replace(" ", "_").lower()] if product else None
    raw = FS.raw_scan(spark, landing, slugs=slugs, source=source)
    seen = Observation("raw")
    raw = raw.observe(seen, F.count(F.lit(1)).alias("total_records"))
    ready = scoring.faq_ready(scoring.process(raw), cap=cap, rank_col="rank")
    kept = Observation("ready")
    ready = ready.observe(kept, F.count(F.lit(1)).alias("processed_records"),
                          F.count_if(F.col("rank") == 1).alias("products"))
    run_dir = f"{out.rstrip('/')}/processed/{run_id}"
    FS.write_snapshot(ready, run_dir)
    # the latest copy is written from the snapshot just stored, not recomputed
    latest = f"{out.rstrip('/')}/processed/latest.json"
    FS.write_latest_json(spark.read.parquet(run_dir).drop("product_slug"), latest)
    return {"product": product or "*", "source": source or "*", **seen.get, **kept.get, "output_path": run_dir}


def _versions(spark: SparkSession, root: str) -> list[str]:
    """Committed version folders (``version=<run id>``) of a table, in the order of their commits.

    A folder without ``_SUCCESS`` is the rest of a run that failed; it does not count."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/version=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    marks = sorted((st.getModificationTime(), st.getPath().getParent().toString()) for st in (found or []))
    return [folder for _, folder in marks]


def load_model(spec: str):
    """``module:function`` -> the model function for ``batch_inference``.

    The module is pickled by value, so the Python workers of a cluster need
    not have it on their path.
    """
    import importlib

    from pyspark import cloudpickle
    name, _, function = spec.partition(":")
    module = importlib.import_module(name)
    cloudpickle.register_pickle_by_value(module)
    return getattr(module, function)


def load_availability(spec: str):
    """The ``is_available(provider)`` of the model's module, or None."""
    import importlib
    return getattr(importlib.import_module(spec.partition(":")[0]), "is_available", None)


def generate(spark: SparkSession, processed: str, out: str, model_fn, run_id: str | None = None,
             cap: int = P.CONTEXT_CAP, is_available=None) -> dict:
    """One generation run over every product of a processed snapshot.

    A run id that is already committed is refused: its version may be the one
    that this run reads."""
    from threadmill.session import materialize
    run_id = run_id or datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    root = f"{out.rstrip('/')}/faqs"
    previous = _versions(spark, root)
    if any(v.rsplit("=", 1)[1] == run_id for v in previous):
        raise ValueError(f"version {run_id} exists already")
    ready = spark.read.parquet(processed).drop("product_slug")
    ranked = materialize(P.ranked_context(ready, cap))                   # read by three branches
    models = [INF.Model(p.name, model_fn, (lambda name=p.name: is_available(name)) if is_available else lambda: True)
              for p in P.PROVIDERS]
    responses, entries = INF.staged_inference(P.prompts(ranked), models, R.parse_responses,
                                              f"{out.rstrip('/')}/responses")
    chosen = R.provider_fallback(entries, responses)
    counts = ranked.groupBy("product").agg(F.count(F.lit(1)).alias("source_count"))
    docs = R.faq_documents(entries, chosen, P.context_sources(ranked), counts)
    merged = TB.faq_upsert(spark.read.parquet(previous[-1]), docs) if previous else docs
    seen = Observation("documents")
    merged = merged.observe(seen, F.count(F.lit(1)).alias("documents"),
                            F.sum(F.size("faqs")).alias("entries"))
    target = f"{root}/version={run_id}"
    merged.write.mode("overwrite").parquet(target)
    return {"run_id": run_id, **seen.get, "output_path": target}


CLUSTER_MAX_OFFSETS = 5_000_000


def land(spark: SparkSession, inbox: str, landing: str, quarantine: str, checkpoints: str,
         continuous: bool = False, kafka: str | None = None,
         max_offsets: int = CLUSTER_MAX_OFFSETS) -> None:
    msgs = (ST.kafka_source(spark, kafka, max_offsets=max_offsets) if kafka
            else ST.file_queue_source(spark, inbox))
    ST.run_to_end(ST.start_land(msgs, landing, quarantine, f"{checkpoints}/land", available_now=not continuous))


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="threadmill")
    sub = ap.add_subparsers(dest="cmd", required=True)
    p = sub.add_parser("process")
    p.add_argument("--landing", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--product")
    p.add_argument("--run-id")
    p.add_argument("--source")
    g = sub.add_parser("generate")
    g.add_argument("--processed", required=True)
    g.add_argument("--out", required=True)
    g.add_argument("--model", required=True)
    g.add_argument("--run-id")
    s = sub.add_parser("land")
    s.add_argument("--inbox")
    s.add_argument("--kafka")
    s.add_argument("--landing", required=True)
    s.add_argument("--quarantine", required=True)
    s.add_argument("--checkpoints", required=True)
    s.add_argument("--continuous", action="store_true")
    s.add_argument("--max-offsets", type=int, default=CLUSTER_MAX_OFFSETS)
    a = ap.parse_args(argv)
    spark = build_session(app=f"threadmill-{a.cmd}", profile="cluster")
    try:
        if a.cmd == "process":
            print(json.dumps(process(spark, a.landing, a.out, a.product, a.run_id,
                                     source=a.source), indent=2))
        elif a.cmd == "generate":
            print(json.dumps(generate(spark, a.processed, a.out, load_model(a.model), a.run_id,
                                      is_available=load_availability(a.model)), indent=2))
        else:
            land(spark, a.inbox, a.landing, a.quarantine, a.checkpoints, a.continuous, a.kafka,
                 a.max_offsets)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

__all__ = ["process", "generate", "land", "main", "product_slug"]
