"""Pluggable model calls over the prompt table (Arrow-batched ``mapInPandas``).

The engine makes no network call itself: the caller passes ``model_fn``,
a function ``pandas.DataFrame(product, provider, priority, prompt) ->
pandas.DataFrame(product, provider, priority, response)``.  Spark ships
prompts to executors in Arrow batches, so the model runs next to the data and
in parallel over partitions; repartitioning by (product, provider) spreads
the calls evenly.

Model output is not reproducible, so by default the responses are stored
once with a reliable checkpoint (``spark.checkpoint.dir``): a lost executor
or a second consumer of the table then reads the stored answers instead of
calling the model again and possibly getting different ones.

``staged_inference`` asks the providers one after the other: a product's
prompt goes to the next provider only if no earlier one gave it an entry.
Its answers are kept in a response table, keyed by a hash of provider and
prompt, so a rerun asks only what no run has asked before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .rank import top_n_per_group

RESPONSE_DDL = "product string, provider string, priority int, response string"
KEPT_DDL = "prompt_hash string, provider string, response string"


def batch_inference(prompts: DataFrame, model_fn: Callable[[pd.DataFrame], pd.DataFrame],
                    partitions: int | None = None, store: bool = True) -> DataFrame:
    src = prompts.select("product", "provider", "priority", "prompt")
    # an explicit count: AQE would coalesce the few prompt rows into one task,
    # and with them every model call
    partitions = partitions or int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = src.repartition(partitions, "product", "provider")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = model_fn(pdf)
            yield out[["product", "provider", "priority", "response"]]

    out = src.mapInPandas(run, RESPONSE_DDL)
    if store:
        out = materialize(out)
    return out


def echo_model() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Deterministic stand-in model for tests: one Q/A about the prompt.

    The function is made here, so it is shipped to the Python workers by
    value and they need not be able to import this package.
    """
    def echo(pdf):
        resp = ("Q: What do users ask about " + pdf["product"] + "?\nA: "
                + pdf["prompt"].str.len().astype(str) + " characters of context were reviewed.")
        return pdf.assign(response=resp, priority=pdf["priority"].astype("int32"))

    return echo


@dataclass(frozen=True)
class Model:
    """A provider's model: the function of ``batch_inference`` and whether it can be asked now.

    ``is_available`` is asked once, on the driver, when the provider's turn comes.
    """
    provider: str
    call: Callable[[pd.DataFrame], pd.DataFrame]
    is_available: Callable[[], bool] = lambda: True


def prompt_hash():
    return F.sha2(F.concat_ws("\n", "provider", "prompt"), 256)


def kept_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response table (prompt_hash, provider, response); empty when it does not exist yet."""
    try:
        return spark.read.schema(KEPT_DDL).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], KEPT_DDL)


def _asked(prompts: DataFrame, call: Callable[[pd.DataFrame], pd.DataFrame], partitions: int | None) -> DataFrame:
    """(prompt_hash, provider, response) of ``prompts``; a prompt whose call fails gets no row."""
    partitions = partitions or int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def answers(pdf: pd.DataFrame) -> pd.DataFrame:
        out = call(pdf.drop(columns="prompt_hash"))
        both = pdf[["prompt_hash", "product", "provider"]].merge(out[["product", "provider", "response"]],
                                                                 on=["product", "provider"])
        return both[["prompt_hash", "provider", "response"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                yield answers(pdf)
            except Exception:  # noqa: BLE001 - one prompt that fails must not take its batch along
                for k in range(len(pdf)):
                    try:
                        yield answers(pdf.iloc[k:k + 1])
                    except Exception:  # noqa: BLE001
                        continue

    return (prompts.select("product", "provider", "priority", "prompt", "prompt_hash")
            .repartition(partitions, "prompt_hash").mapInPandas(run, KEPT_DDL).where("response is not null"))


def staged_inference(prompts: DataFrame, models: list[Model], parse: Callable[[DataFrame], DataFrame],
                     responses_path: str, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(responses, entries) of every product's providers, asked in the order of ``priority``.

    ``prompts`` = (product, provider, priority, prompt); a provider without a
    model, or whose model is not available, is passed over; ``parse`` turns
    responses into entries.  Stage k holds the prompts of the k-th priority
    whose products have no entries yet; of these only the prompts that the table at
    ``responses_path`` does not hold are asked, equal ones once, and their
    answers are added to it.  Calls that fail leave no answer: their products
    go on to the next provider, and a rerun asks again.

    ``responses`` has a row for each (product, provider) of a stage, with a
    null response where the call failed, and ``was_kept``: answered by an earlier run.
    """
    spark = prompts.sparkSession
    by_name = {m.provider: m for m in models}
    prompts = materialize(prompts.select("product", "provider", "priority", "prompt")
                          .withColumn("prompt_hash", prompt_hash()))
    stages = [r["priority"] for r in prompts.select("priority").distinct().orderBy("priority").collect()]
    responses, entries = [], []
    for stage in stages:
        turn = prompts.where(F.col("priority") == stage)
        names = [r["provider"] for r in turn.select("provider").distinct().collect()]
        ready = [n for n in names if n in by_name and by_name[n].is_available()]
        turn = turn.where(F.col("provider").isin(ready))
        for done in entries:
            turn = turn.join(done.select("product").distinct(), "product", "left_anti")
        known = kept_responses(spark, responses_path).select("prompt_hash", F.lit(True).alias("was_kept")).distinct()
        turn = materialize(turn.join(known, "prompt_hash", "left")
                           .withColumn("was_kept", F.coalesce("was_kept", F.lit(False))))
        for name in ready:
            new = top_n_per_group(turn.where((F.col("provider") == name) & ~F.col("was_kept")), ["prompt_hash"],
                                  [F.col("product").asc()], 1)
            _asked(new, by_name[name].call, partitions).write.mode("append").parquet(responses_path)
        # a run that was cut off after writing may have left an answer twice: one of them counts
        answers = (kept_responses(spark, responses_path).groupBy("prompt_hash")
                   .agg(F.min("response").alias("response")))
        got = materialize(turn.join(answers, "prompt_hash", "left")
                          .select("product", "provider", "priority", "response", "was_kept"))
        responses.append(got)
        entries.append(materialize(parse(got.where("response is not null").drop("was_kept"))))
    if not stages:
        none = spark.createDataFrame([], RESPONSE_DDL)
        return none.withColumn("was_kept", F.lit(False)), parse(none)
    all_responses, all_entries = responses[0], entries[0]
    for r, e in zip(responses[1:], entries[1:]):
        all_responses, all_entries = all_responses.unionByName(r), all_entries.unionByName(e)
    return all_responses, all_entries


def length_models() -> list[Model]:
    """Stand-in models whose answers follow from the prompt's length, as a query can tell.

    ``large`` gives a JSON array for prompts of even length and an apology
    otherwise; ``small`` gives question lines unless the length is divisible by 3.
    """
    def large(pdf):
        n = pdf["prompt"].str.len()
        text = '[{"question": "How about ' + pdf["product"] + '?", "answer": "' + n.astype(str) + ' characters."}]'
        return pdf.assign(response=text.where(n % 2 == 0, "Sorry, no questions found."))

    def small(pdf):
        n = pdf["prompt"].str.len()
        text = "Q: What of " + pdf["product"] + "?\nA: " + n.astype(str) + " characters."
        return pdf.assign(response=text.where(n % 3 > 0, "Nothing to ask."))

    return [Model("large", large), Model("small", small)]
