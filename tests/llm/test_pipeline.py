import re

import pytest

import corpus_pipeline as pipe
from understory.llm import pii, queries, simhash

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(100_000, "123 456 !!", "en", "x", 10), (100_001, docs.orderBy("doc_id").first().text, "en", "x", 1), (100_002, None, None, None, None), (100_003, "Write to jane.roe@mail.example.org, the address of that office is there.", "en", "x", 1)], docs.schema)
    docs = docs.union(extra)
    seen = []
    for k, (name, stage) in enumerate(pipe.STAGES):
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        seen.append((name, docs))
    (_, lang), (_, single), (_, clean), (_, packed) = seen
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert not {100_000, 100_002} & ids(lang) and {100_001, 100_003} <= ids(lang)
    assert len(ids(lang)) == 202
    found = simhash.near_duplicates(lang).collect()
    assert ids(single) == {r.component_id for r in found} and 100_001 not in ids(single)
    assert ids(clean) == ids(single) == ids(packed)
    for r in clean.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
    assert "[EMAIL]" in clean.where("doc_id = 100003").first().text
    assert all(df.columns == pipe.COLUMNS for _, df in seen[:3])


def test_run_gives_the_packed_rows(spark):
    got = pipe.run(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 150


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipe.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_the_tables(spark, name):
    df = queries.QUERIES[name](spark, SF)
    table = {"1": "conversations", "2": "embeddings", "5": "pages"}.get(re.match(r"op(\d+)", name)[1], "documents")
    rows = spark.read.parquet(f"{SF}/{table}.parquet")
    want = rows.select("conv_id").distinct().count() + 1 if table == "conversations" else rows.count()
    got = df.count()
    assert got == want or name.startswith("op3") and got >= want


def test_chat_query_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = queries.QUERIES["op1_chat_format"](spark, SF)
    want = con.execute(queries.ORACLES["op1_chat_format"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())
