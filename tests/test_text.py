import random

from pyspark.sql import functions as F

from threadmill.functions import text as T

import brute


def stepwise(c):
    """The three steps of the cleaning, one after another."""
    c = F.regexp_replace(F.lower(F.col(c)), r"http\S+|www\.\S+", "")
    c = F.regexp_replace(c, r"[^a-zA-Z0-9\s\?\.\!]", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


EDGE_TEXTS = [
    None, "", "a" * 20, "a" * 21, "x" * 19 + " " + "y",
    "see http://a.b/c d and more words here", "visit www.x.y now please ok then",
    "Ça été très bien, naïve café résumé!!", "tabs\tand\nnewlines\x0bvertical\fform",
    "Keep !?. these marks here ok", "What?? island is near. how do I fix it?",
    "?", "short q? is this one long enough?", "Which one wins! Does it work?",
    "     leading and trailing spaces everywhere     ",
]


def test_clean_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(EDGE_TEXTS)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {r.id: (r.c, r.s) for r in df.select(
        "id", T.clean_text("t").alias("c"), stepwise("t").alias("s")).collect()}
    for i, t in rows:
        assert got[i][0] == brute.clean(t), (t, got[i][0])
        assert got[i][1] == got[i][0]


def test_clean_fused_equals_stepwise_random_unicode(spark):
    """Random texts over ASCII, Java and non-Java whitespace, accents,
    combining marks, symbols and URLs: fused pass == three steps == brute force."""
    rnd = random.Random(11)
    alphabet = (list("abcXYZ019?.!,;:'-_/") + [" ", "\t", "\n", "\x0b", "\f", "\r",
                "\u00a0", "\u2028", "\x1c", "\u3000", "é", "ß", "İ", "\u0307", "K",
                "ø", "Ω", "中", "😀", "\\", "$", "["])
    pieces = ["http://x.y/z?q=1", "www.a.b", "HTTPS://Q", " www.", "http"]
    texts = []
    for _ in range(1500):
        parts = [rnd.choice(pieces) if rnd.random() < 0.08 else rnd.choice(alphabet)
                 for _ in range(rnd.randint(0, 60))]
        texts.append("".join(parts))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: (r.c, r.s) for r in df.select(
        "id", T.clean_text("t").alias("c"), stepwise("t").alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == got[i][1] == brute.clean(t), repr(t)


def test_keep_cleaned_threshold(spark):
    df = spark.createDataFrame([("a" * 20,), ("a" * 21,), (None,)], "t string")
    kept = df.where(T.keep_cleaned(T.clean_text("t"))).collect()
    assert [r.t for r in kept] == ["a" * 21]


def test_questions_edge_rows(spark):
    texts = ["what?? is it", "?", "a" * 15 + "?", "a" * 14 + "?", "island of the big lake here",
             "first sentence here! how are things going", None, "",
             "why. when is the next one coming out"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.q for r in df.select(T.extract_questions("t").alias("q")).collect()]
    want = [brute.questions(t) for t in texts]
    assert got == want
    # prefix test without word boundary: "island" counts (starter "is")
    assert got[4] == ["island of the big lake here"]
    assert got[6] == [] and got[7] == []


def test_questions_property_random_texts(spark):
    """Random sentences over a small alphabet: engine == brute force."""
    rnd = random.Random(7)
    words = ["how", "what", "is", "island", "do", "dog", "any", "x", "the", "long", "a" * 9]
    marks = [".", "?", "!", "??", " ", "?.", "!?"]
    texts = []
    for _ in range(400):
        parts = [rnd.choice(words) + rnd.choice([" ", " ", rnd.choice(marks)])
                 for _ in range(rnd.randint(0, 14))]
        texts.append("".join(parts))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: r.q for r in df.select("id", T.extract_questions(T.clean_text("t")).alias("q"))
           .collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute.questions(brute.clean(t)), t


def test_questions_on_all_cleaned_documents(spark):
    """Whole sf0.01 corpus: native extraction == brute force, text by text."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = d.select("doc_id", "text", T.clean_text("text").alias("c"),
                    T.extract_questions(T.clean_text("text")).alias("q")).collect()
    for r in rows:
        assert r.c == brute.clean(r.text)
        assert r.q == brute.questions(r.c)


def test_product_slug(spark):
    df = spark.createDataFrame([("Galaxy S24 ",), (" Pixel 8",), ("ABC",)], "n string")
    got = df.select(T.product_slug("n").alias("a"), T.product_slug("n", strip=True).alias("b")) \
            .collect()
    assert [(r.a, r.b) for r in got] == [("galaxy_s24_", "galaxy_s24"), ("_pixel_8", "pixel_8"),
                                         ("abc", "abc")]


def test_sentences_keep_question_mark(spark):
    df = spark.createDataFrame([("a?b!c.d",)], "t string")
    assert df.select(T.sentences("t").alias("s")).first().s == ["a?", "b", "c", "d"]


def test_word_boundary_option(spark):
    df = spark.createDataFrame([("island of the big lake here",)], "t string")
    r = df.select(T.extract_questions("t", word_boundary=True).alias("q")).first()
    assert r.q == []
    assert F is not None
