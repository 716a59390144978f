"""The pipeline's stages, each against its own input, and the SQL of the queries."""

import duckdb
import pytest

import corpus_pipeline
from vaporline.llm import queries

from .helpers import awkward, empty

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    rows = want.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = queries.queries()[name](spark, SMALL)
    assert sorted(got.columns) == columns
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, rows))


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "mixing", "bpe encoding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SMALL).persist()
        assert 0 < after.count()
        if n < 4:
            assert after.columns == docs.columns
        if n < 3:
            assert after.count() <= before.count()
        before = after
    assert {"n_tokens", "ids"} <= set(before.columns)


def test_run_and_awkward_documents(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    docs = awkward(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    docs.count()


def test_empty_table(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0 and {"n_tokens", "ids"} <= set(docs.columns)
