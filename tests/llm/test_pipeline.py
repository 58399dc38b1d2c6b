import os

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from gapgrid.llm.queries import ORACLES

from tests.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = contract.queries()[name](spark, SF_DIR)
    cols = sorted(df.columns)
    c.execute(contract.oracle_sql()[name])
    names = [d[0] for d in c.description]
    want = sorted((tuple(r[names.index(x)] for x in cols) for r in c.fetchall()), key=repr)
    assert sorted(names) == cols and sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr) == want


def test_stages(spark):
    docs = spark.read.parquet(os.path.join(SF_DIR, "documents.parquet"))
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert 0 < out.count() == docs.count() < 4 * before
    labels = spark.read.parquet(os.path.join(SF_DIR, "labels.parquet"))
    first = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(os.path.join(SF_DIR, "documents.parquet")), SF_DIR)
    good = labels.where("quality = 1 AND toxic = 0")
    assert first.join(good, "doc_id").count() > 0.97 * good.join(spark.read.parquet(os.path.join(SF_DIR, "documents.parquet")), "doc_id").count()


def test_nothing_in(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF_DIR}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
