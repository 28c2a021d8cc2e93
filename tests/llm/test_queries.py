"""The registered queries: columns and, where there is one, the SQL twin; the pipeline stage by stage."""

import os

import pytest

import corpus_pipeline
from matchloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, cursor.fetchall()))


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        rows = {(r.doc_id, r.text) for r in out.collect()}
        assert rows <= {(r.doc_id, r.text) for r in docs.collect()} and 0 < len(rows) <= n, name
        n, docs = len(rows), out
    assert corpus_pipeline.run(spark, FOLDER).count() == n
