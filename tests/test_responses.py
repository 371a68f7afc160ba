from threadmill.operators import prompts as P
from threadmill.operators import responses as R

import brute

RESP_DDL = "product string, provider string, priority int, response string"


def _resp(spark, rows):
    return spark.createDataFrame(rows, RESP_DDL)


def test_json_edges(spark):
    rows = [
        ("a", "large", 1, "no bracket at all"),
        ("b", "large", 1, "oops ] then [ here"),
        ("c", "large", 1, "[]"),
        ("d", "large", 1, '["x", "y"]'),
        ("e", "large", 1, 'pre [{"question": "q1", "answer": "a1", "confidence": "0.75"},'
                          ' {"question": "q2", "answer": "a2", "confidence": null},'
                          ' {"answer": "a3", "confidence": "high", "keywords": ["k"]}] post'),
        ("f", "small", 2, '[{"question": "q", "answer": "x", "category": "Setup",'
                          ' "confidence": 0.9, "keywords": ["k1", "k2"]}]'),
    ]
    got = {}
    for r in R.parse_json_entries(_resp(spark, rows)).collect():
        got.setdefault(r.product, []).append(r)
    assert set(got) == {"e", "f"}
    e = sorted(got["e"], key=lambda r: r.entry_pos)
    assert [(r.question, r.answer, r.category, r.confidence, r.keywords) for r in e] == [
        ("q1", "a1", "General", 0.75, []), ("q2", "a2", "General", 0.8, []),
        ("", "a3", "General", 0.8, ["k"])]
    f = got["f"][0]
    assert (f.category, f.confidence, f.keywords) == ("Setup", 0.9, ["k1", "k2"])


def test_json_boolean_and_spaced_confidence(spark):
    rows = [("g", "large", 1, '[{"question": "q", "answer": "a", "confidence": true},'
                              ' {"question": "q", "answer": "b", "confidence": false},'
                              ' {"question": "q", "answer": "c", "confidence": " 0.5 "}]')]
    got = sorted((r.answer, r.confidence) for r in R.parse_json_entries(_resp(spark, rows)).collect())
    assert got == [("a", 1.0), ("b", 0.0), ("c", 0.5)]


QA_CASES = [
    "A: before any\nQ: first?\nA: one\nQ: second?\nAnswer: two\nmore text",
    "Q: x?\nA: one\nA: two",                      # later A replaces earlier
    "Q: x?\ncontinued before\nA: ans",            # continuation before A dropped
    "Q:\nA: answer for empty question",           # empty question dropped
    "Q: no answer here",                          # question without answer
    "Question: colon: inside?\nAnswer: yes: really",
    "Q: only continuation\nline one\nline two",
    "Q: empty a\nA:\n\nQ: next\nA: fine",
]


def test_qa_lines_against_state_machine(spark):
    rows = [(f"p{i}", "small", 2, t) for i, t in enumerate(QA_CASES)]
    out = {}
    for r in R.parse_qa_lines(_resp(spark, rows)).collect():
        out.setdefault(r.product, []).append((r.entry_pos, r.question, r.answer))
    for i, t in enumerate(QA_CASES):
        got = [(q, a) for _, q, a in sorted(out.get(f"p{i}", []))]
        assert got == brute.qa_lines(t), (t, got)


def test_parse_responses_fallback_only_for_small(spark):
    rows = [("a", "large", 1, "Q: q?\nA: a"), ("a", "small", 2, "Q: q?\nA: a")]
    got = sorted((r.provider, r.method) for r in R.parse_responses(_resp(spark, rows)).collect())
    assert got == [("small", "lines")]


def test_provider_fallback_cases(spark):
    ok = '[{"question": "q", "answer": "a"}]'
    rows = [("first_good", "large", 1, ok), ("first_good", "small", 2, ok),
            ("second_good", "large", 1, ""), ("second_good", "small", 2, ok),
            ("both_bad", "large", 1, "[broken"), ("both_bad", "small", 2, "nothing")]
    resp = _resp(spark, rows)
    chosen = {r.product: r.provider for r in
              R.provider_fallback(R.parse_responses(resp), resp).collect()}
    assert chosen == {"first_good": "large", "second_good": "small", "both_bad": None}


def test_item_text_cut_order(spark):
    df = spark.createDataFrame(
        [("x" * 499, ["q1", "q2", "q3", "q4"]), ("y" * 301, ["a", "b", "c"]), ("z" * 10, [])],
        "content string, extracted_questions array<string>")
    got = df.select(P.item_text(P.LARGE).alias("l"), P.item_text(P.SMALL).alias("s")).collect()
    assert got[0].l == ("x" * 499 + "\nQuestions found: q1; q2; q3")[:500]
    assert got[1].s == "y" * 300 + " Questions: a; b"
    assert got[2].l == "z" * 10 and got[2].s == "z" * 10


def test_fill_template():
    from pyspark.sql import functions as F  # noqa: F401
    assert "{product}" in P.LARGE_TEMPLATE and "{content}" in P.SMALL_TEMPLATE


def test_qa_lines_random_responses(spark):
    import random
    rnd = random.Random(11)
    kinds = ["Q: what is it?", "Question: how: now", "Q:", "Q:   ", "A: yes", "Answer: fine",
             "A:", "  A: padded  ", "plain words", "", "   ", "more: text", "\tQ: tabbed"]
    texts = ["\n".join(rnd.choice(kinds) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    rows = [(f"p{i}", "small", 2, t) for i, t in enumerate(texts)]
    out = {}
    for r in R.parse_qa_lines(_resp(spark, rows)).collect():
        out.setdefault(r.product, []).append((r.entry_pos, r.question, r.answer))
    for i, t in enumerate(texts):
        got = [(q, a) for _, q, a in sorted(out.get(f"p{i}", []))]
        assert got == brute.qa_lines(t), repr(t)


def test_non_object_array_is_unusable_without_fallback(spark):
    rows = [("a", "small", 2, '["x", "y"]\nQ: q?\nA: a'),          # valid array, not objects
            ("b", "small", 2, '[{"question": ]\nQ: q?\nA: a'),     # invalid JSON -> lines
            ("c", "small", 2, "[null]\nQ: q?\nA: a")]
    got = sorted((r.product, r.method) for r in R.parse_responses(_resp(spark, rows)).collect())
    assert got == [("b", "lines")]


def test_inference_stores_nonreproducible_answers(spark):
    import uuid

    import pandas as pd

    from threadmill.operators import inference as INF

    def random_model(pdf):
        return pd.DataFrame({"product": pdf["product"], "provider": pdf["provider"],
                             "priority": pdf["priority"].astype("int32"),
                             "response": [uuid.uuid4().hex for _ in range(len(pdf))]})

    prompts = (spark.range(0, 200, numPartitions=4)
               .selectExpr("concat('p', CAST(id AS STRING)) AS product", "'large' AS provider",
                           "CAST(1 AS INT) AS priority", "'prompt' AS prompt"))
    stored = INF.batch_inference(prompts, random_model)
    first = sorted(map(tuple, stored.collect()))
    assert len(first) == 200
    assert first == sorted(map(tuple, stored.collect()))       # read twice, same answers
    lazy = INF.batch_inference(prompts, random_model, store=False)
    assert sorted(map(tuple, lazy.collect())) != sorted(map(tuple, lazy.collect()))
    # the echo stand-in: one response per prompt, deterministic
    echo = INF.batch_inference(prompts, INF.echo_model()).collect()
    assert {r.response for r in echo} == {"Q: What do users ask about p%d?\nA: 6 characters of "
                                          "context were reviewed." % i for i in range(200)}
