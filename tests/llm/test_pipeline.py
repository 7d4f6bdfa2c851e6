"""The pipeline's stages on planted rows, and all registered queries against their SQL."""

import re

import duckdb
import pytest

import corpus_pipeline
from auditlake.llm import queries  # noqa: F401
from auditlake.llm import language, secrets
from auditlake.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    monkeypatch.setattr(language, "STEPS", 120)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == before.columns, name
        sizes.append(docs.count())
        if name == "near_duplicates":
            assert docs.select("doc_id").distinct().count() == docs.count()
        if name == "secret_scan":
            assert docs.count() == before.count()
            assert all(r.n_assign + r.n_access + r.n_hex == 0 for r in secrets.secret_spans(docs).collect())
    assert n >= sizes[0] > 0.95 * n and sizes[1] < sizes[0] and sizes[2] == sizes[1]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(out) == sizes[3] and all(r.n_pieces == len(r.ids) for r in out)


def test_run_is_the_stages(spark):
    got = QUERIES["pipeline"](spark, SF)
    assert got.count() > 0 and "ids" in got.columns


def test_thirteen_queries_and_the_pipeline():
    numbers = sorted(int(m[1]) for q in QUERIES if (m := re.match(r"op(\d+)_", q)))
    assert numbers == list(range(1, 14)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    cols = [d[0] for d in result.description]
    want = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, SF).select(*cols).collect()) == want
