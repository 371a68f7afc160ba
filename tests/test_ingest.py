from pyspark.sql import functions as F

from threadmill.operators import ingest as I
from threadmill.schemas import COMMENT_LISTING_SCHEMA, POST_LISTING_SCHEMA


def _post(pid, title, body, ncom=0, created=1704067200.9):
    return {"kind": "t3", "data": {"id": pid, "title": title, "selftext": body, "author": "a",
                                   "subreddit": "s", "score": 1, "num_comments": ncom,
                                   "created_utc": created, "url": "u", "permalink": f"/r/s/{pid}/"}}


def test_normalize_posts_edges(spark):
    listing = {"data": {"children": [_post("1", "", ""), _post("2", "only title", ""),
                                     _post("3", "t", "body text", 7)]}}
    df = spark.createDataFrame([("prod", "kw", listing)],
                               f"product string, keyword string, listing {POST_LISTING_SCHEMA.simpleString()}")
    rows = {r.post_id: r for r in I.normalize_posts(df).collect()}
    assert set(rows) == {"2", "3"}                       # empty title and body skipped
    assert rows["2"].content == "only title" and rows["3"].content == "body text"
    assert rows["3"].url == "https://reddit.com/r/s/3/"
    assert rows["3"].created_at == "2024-01-01T00:00:00Z"  # fractional epoch truncated
    assert rows["3"].metadata == {"post_id": "3", "num_comments": "7", "keyword": "kw"}


def test_normalize_comments_filter(spark):
    def c(cid, kind, body):
        return {"kind": kind, "data": {"id": cid, "body": body, "author": "x", "score": 2,
                                       "created_utc": 1.5, "parent_id": "t3_9"}}
    listing = {"data": {"children": [c("a", "t1", "fine"), c("b", "more", "x"),
                                     c("c", "t1", "[deleted]"), c("d", "t1", "[removed]"),
                                     c("e", "t1", "")]}}
    cl = spark.createDataFrame([("9", "s", listing)],
                               f"post_id string, subreddit string, listing {COMMENT_LISTING_SCHEMA.simpleString()}")
    posts = spark.createDataFrame([("9", "prod", "https://reddit.com/r/s/9/", "s")],
                                  "post_id string, product string, url string, subreddit string")
    got = sorted(r.comment_id for r in I.normalize_comments(cl, posts).collect())
    assert got == ["a", "d"]


def test_search_grid_defaults_and_escape(spark):
    df = spark.createDataFrame(
        [(1, "Pixel 8", None, ["price & \"deal\"", "a*b~c"]), (2, "X", [], [])],
        "id long, name string, subreddits array<string>, keywords array<string>")
    g = I.search_grid(df).collect()
    p1 = [r for r in g if r.product_id == 1]
    p2 = [r for r in g if r.product_id == 2]
    assert len(p1) == 5 * 2 and len(p2) == 5 * 7
    esc = {r.keyword: r.query_escaped for r in p1 if r.sub_pos == 0}
    assert esc['price & "deal"'] == "%22Pixel+8%22+AND+price+%26+%22deal%22"
    assert esc["a*b~c"] == "%22Pixel+8%22+AND+a%2Ab~c"


def test_discover_communities_edges(spark):
    comm = spark.createDataFrame(
        [(" Phones ", "a", 1000, 1), ("phones", "b", 1001, 2), ("phones", "c", 5000, 3),
         ("phones", "d", 5000, 4), ("phones", "e", 4000, 5), ("phones", "", 9999, 6)],
        "topic string, display_name string, subscribers long, search_rank long")
    topics = spark.createDataFrame([("Phones",), ("nothing",)], "topic string")
    rows = I.discover_communities(comm, topics).collect()
    got = sorted((r.topic, r.rank, r.display_name) for r in rows)
    assert got == [("nothing", 1, "technology"), ("nothing", 2, "gadgets"),
                   ("phones", 1, "c"), ("phones", 2, "d"), ("phones", 3, "e")]


def test_discover_communities_only_first_search_results(spark):
    # twelve results: the 11th and 12th by search rank are never returned by the search,
    # and an empty name still takes one of the ten places
    rows = [("t", f"s{i}", 2000 + i, i) for i in range(1, 11)]
    rows[3] = ("t", "", 99999, 4)
    rows += [("t", "late1", 90000, 11), ("t", "late2", 80000, 12)]
    comm = spark.createDataFrame(rows, "topic string, display_name string, subscribers long, "
                                 "search_rank long")
    got = sorted((r.rank, r.display_name) for r in
                 I.discover_communities(comm, spark.createDataFrame([("t",)], "topic string"))
                 .collect())
    assert got == [(1, "s10"), (2, "s9"), (3, "s8")]


def test_dedup_keeps_latest(spark):
    df = spark.createDataFrame([(1, "k1", 1), (1, "k2", 3), (2, "k1", 2)],
                               "id long, keyword string, keyword_rank int")
    got = sorted(tuple(r) for r in I.dedup_raw(df, F.col("id"), ["keyword_rank", "keyword"])
                 .collect())
    assert got == [(1, "k2", 3), (2, "k1", 2)]


def test_query_escape_matches_quote_plus(spark):
    import random
    from urllib.parse import quote_plus
    rnd = random.Random(3)
    alphabet = "abcXYZ019 -_.~*!'()&=+/?#%\"<>é漢\t"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 20))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.e for r in df.select("i", I.query_escape(F.col("t")).alias("e")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == quote_plus(t, safe=""), t
