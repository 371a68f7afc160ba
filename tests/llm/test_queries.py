"""The registered queries: SQL where there is some, contracts and the pipeline elsewhere."""

import re

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from threadmill.llm import queries as Q
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_registered():
    names = E.queries()
    assert [sum(bool(re.match(rf"op{n}_", q)) for q in names) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(E.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF)
    res = con.execute(Q.ORACLES[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


@pytest.mark.parametrize("name,key,columns", [
    ("op3_compression_quality", "doc_id", "doc_id held_out score predicted"),
    ("op4_packed_token_files", "doc_id", "doc_id start n_tokens ids_crc32"),
    ("op5_crf_personal_data", "doc_id", "doc_id n_email n_ip n_card n_phone base_sha256 spans"),
    ("op6_rendezvous_sharding", "doc_id", "doc_id size text_crc32 law shard slot grown_shard"),
    ("op7_pivot_range_join", "vec_id", "vec_id n_links component_id kept"),
    ("op9_backtracking_bpe", "doc_id", "doc_id n_tokens ids_sha256 decoded_sha256"),
    ("op10_ngram_jaccard_join", "doc_id", "doc_id n_shingles component_id")])
def test_one_row_for_each_of_the_whole_table(spark, name, key, columns):
    table = "embeddings" if key == "vec_id" else "documents"
    out = Q.QUERIES[name](spark, SF)
    assert sorted(out.columns) == sorted(columns.split())
    want = sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in out.select(key).collect()) == want


def test_pipeline_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from test_jaccard import brute
    from test_mixing import brute as mixed
    from tokenizers import Tokenizer

    import public_tokenizers
    stages = [f for _, f in corpus_pipeline.STAGES]
    scores = {r.doc_id: r.predicted for r in Q.QUERIES["op3_compression_quality"](spark, SF).collect()}
    one = stages[0](spark, docs, SF).cache()
    assert {r.doc_id for r in one.collect()} == {i for i, p in scores.items() if p == 1}
    two = stages[1](spark, one, SF).cache()
    components = brute([(r.doc_id, r.text) for r in one.collect()])
    assert sorted(r.doc_id for r in two.collect()) == sorted(set(components.values()))
    three = stages[2](spark, two, SF).cache()
    plain, hidden = {r.doc_id: r.text for r in two.collect()}, three.collect()
    assert {r.doc_id for r in hidden} == set(plain)
    for r in hidden:
        assert r.n_chars == len(r.text)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.", r.text)
        assert r.text == plain[r.doc_id] or "<" in r.text
    four = stages[3](spark, three, SF).cache()
    data = [(r.doc_id, r.text, r.lang, r.source) for r in hidden]
    m = corpus_pipeline.MIX
    want = mixed(data, m["weights"], m["budget_share"], m["max_epochs"], m["seed"])
    assert sorted((r.doc_id, 1) for r in four.collect()) == sorted(want)
    five = stages[4](spark, four, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path(Q.TOKENIZER))
    texts = {r.doc_id: r.text for r in four.collect()}
    for r in five:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.token_ids) == ids and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert all(x.columns == docs.columns for x in (one, two, three, four))


def test_pipeline_runs_the_stages_in_a_row(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda rows: sorted((r.doc_id, r.decoded) for r in rows)
    assert key(out.collect()) == key(docs.collect())
