"""Providers asked one after the other, answers kept between runs."""

import glob
import os
import sys
import uuid

from pyspark import cloudpickle


from threadmill.operators import inference as INF
from threadmill.operators import responses as R

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file
PROMPTS = "product string, provider string, priority int, prompt string"


def prompts(spark, products, text="about {}"):
    rows = [(p, n, k, text.format(p)) for p in products for n, k in (("large", 1), ("small", 2))]
    return spark.createDataFrame(rows, PROMPTS)


def logged(folder, answer):
    """A model that leaves a file for every prompt it is asked."""
    def call(pdf):
        for r in pdf.itertuples():
            with open(os.path.join(folder, f"{r.provider}-{r.product}-{uuid.uuid4().hex}"), "w"):
                pass
        return pdf.assign(response=[answer(r) for r in pdf.itertuples()])
    return call


def calls(folder):
    return sorted("-".join(os.path.basename(f).split("-")[:2]) for f in glob.glob(os.path.join(folder, "*")))


def entry(r):
    return '[{"question": "q ' + r.product + '", "answer": "a"}]'


def test_second_provider_only_where_the_first_gave_nothing(spark, scratch):
    seen = os.path.join(scratch, "seen")
    os.makedirs(seen)
    large = INF.Model("large", logged(seen, lambda r: entry(r) if r.product < "c" else "sorry"))
    small = INF.Model("small", logged(seen, lambda r: "Q: q?\nA: a" if r.product < "d" else "sorry"))
    pr = prompts(spark, "abcd")
    path = os.path.join(scratch, "responses")
    responses, entries = INF.staged_inference(pr, [large, small], R.parse_responses, path)
    assert calls(seen) == ["large-a", "large-b", "large-c", "large-d", "small-c", "small-d"]
    assert sorted((r.product, r.provider) for r in entries.collect()) == [("a", "large"), ("b", "large"), ("c", "small")]
    chosen = {r.product: r.provider for r in R.provider_fallback(entries, responses).collect()}
    assert chosen == {"a": "large", "b": "large", "c": "small", "d": None}
    # the same run again asks nothing; one more product, or another wording, only what is new
    again, _ = INF.staged_inference(pr, [large, small], R.parse_responses, path)
    assert len(calls(seen)) == 6 and all(r.was_kept for r in again.collect())
    INF.staged_inference(prompts(spark, "abcde"), [large, small], R.parse_responses, path)
    assert len(calls(seen)) == 8 and calls(seen).count("large-e") == calls(seen).count("small-e") == 1
    INF.staged_inference(prompts(spark, "a", "new words about {}"), [large, small], R.parse_responses, path)
    assert len(calls(seen)) == 9


def test_unavailable_and_failing_providers(spark, scratch):
    def fails(pdf):
        if (pdf["product"] == "b").any():
            raise RuntimeError("no answer")
        return pdf.assign(response=[entry(r) for r in pdf.itertuples()])

    asked = []

    def down():
        asked.append(1)
        return False

    small = INF.Model("small", lambda pdf: pdf.assign(response="Q: q?\nA: a"))
    path = os.path.join(scratch, "one")
    responses, entries = INF.staged_inference(prompts(spark, "abc").coalesce(1), [INF.Model("large", fails), small],
                                              R.parse_responses, path, partitions=1)
    assert sorted((r.product, r.provider) for r in entries.collect()) == [("a", "large"), ("b", "small"), ("c", "large")]
    assert {(r.product, r.provider): r.response is None for r in responses.collect()}["b", "large"]
    # what failed was not kept: a rerun asks it again
    _, entries = INF.staged_inference(prompts(spark, "b"), [INF.Model("large", lambda pdf: pdf.assign(
        response=[entry(r) for r in pdf.itertuples()])), small], R.parse_responses, path)
    assert [(r.product, r.provider) for r in entries.collect()] == [("b", "large")]
    _, entries = INF.staged_inference(prompts(spark, "ab"), [INF.Model("large", fails, down), small], R.parse_responses,
                                      os.path.join(scratch, "two"))
    assert asked == [1] and {r.provider for r in entries.collect()} == {"small"}
    none, entries = INF.staged_inference(prompts(spark, "ab"), [], R.parse_responses, os.path.join(scratch, "three"))
    assert none.count() == entries.count() == 0


def test_equal_prompts_are_asked_once(spark, scratch):
    seen = os.path.join(scratch, "seen")
    os.makedirs(seen)
    model = INF.Model("large", logged(seen, entry))
    pr = spark.createDataFrame([(p, "large", 1, "the same words") for p in "abc"], PROMPTS)
    responses, entries = INF.staged_inference(pr, [model], R.parse_responses, os.path.join(scratch, "r"))
    assert calls(seen) == ["large-a"]
    assert sorted(r.product for r in entries.collect()) == ["a", "b", "c"]
    assert responses.where("response is null").count() == 0


def test_no_prompts(spark, scratch):
    responses, entries = INF.staged_inference(prompts(spark, ""), INF.length_models(), R.parse_responses, scratch + "/r")
    assert responses.count() == 0 and entries.count() == 0
