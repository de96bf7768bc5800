"""The registered queries on the given tables, and the pipeline."""

from pathlib import Path

import oracle
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from loadcast.llm.queries import QUERIES, SQL

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tiny():
    if not Path(TINY).exists():
        pytest.skip("test tables are not available")
    return TINY


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tiny, name):
    result = QUERIES[name](spark, tiny).toArrow()
    assert result.num_rows > 0
    if name in SQL:
        assert oracle.compare(result, oracle.connect(tiny).execute(SQL[name]).to_arrow_table()) is None


def test_every_query_is_registered():
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_pipeline(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    packed = corpus_pipeline.run(spark, tiny).toPandas()
    assert packed.length.max() <= 2048 and set(packed.doc_id) <= {r.doc_id for r in docs.select("doc_id").collect()}
    fill = packed.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and len(fill) <= -(-packed.length.sum() // 2048) + 2


def test_stages_take_null_rows_and_empty_tables(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", None, None, 0), (-2, "x y z", None, None, 5)], docs.schema)
    for table in (docs.limit(20).unionByName(odd), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, tiny)
            out.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
