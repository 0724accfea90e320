"""The registered queries on the smallest driver tables, and the pipeline's stages against their operators."""

import pathlib

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tallywork.llm import queries
from tallywork.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="driver tables are absent")


def test_each_operator_has_one_query():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n in queries.QUERIES) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", list(queries.CHECKS))
def test_query_equals_check(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(queries.CHECKS[name])
    columns = [c[0] for c in want.description]
    key = lambda r: [(x is None, x or 0) for x in r]
    assert sorted(map(tuple, queries.QUERIES[name](spark, FOLDER).select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_stages_keep_the_columns_and_narrow_the_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before, rows = docs.columns, docs.count()
    final = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(final.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, FOLDER))
        assert docs.columns == before
        assert 0.8 * rows <= (kept := docs.count()) <= rows
        rows = kept
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in final.select("doc_id").distinct().collect()} <= ids
