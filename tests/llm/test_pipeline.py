import duckdb
import pytest

import corpus_pipeline
from strainframe.llm import queries
from strainframe.llm.mixing import mixing_sql

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    path = corpus_pipeline.shared_dir(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.mode("overwrite").parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
        assert 0 < docs.count() <= before, name
        before = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert docs.where("NOT round_trip").count() == 0
    assert corpus_pipeline.run(spark, DATA).count() == before


def test_empty_table(spark):
    docs = spark.createDataFrame([], spark.read.parquet(f"{DATA}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


def test_mixing_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert sorted(con.execute(mixing_sql()).fetchall()) == sorted(tuple(r) for r in queries.QUERIES["op2_mixing"](spark, DATA).collect())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op12_collocations", "op13_filter_audit"}))
def test_queries_return_a_row_for_each_input(spark, name):
    out = queries.QUERIES[name](spark, DATA)
    n = out.count()
    rows = spark.read.parquet(f"{DATA}/{'pages' if name.startswith('op6') else 'documents'}.parquet").count()
    assert n == rows if not name.startswith("op2_") else 0 < n < rows
