"""Every registered query against its oracle SQL on the smallest data set."""

import os

import duckdb
import pytest

from auditlake.plans import all_queries  # noqa: F401
from auditlake.plans.registry import ORACLES, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
#: Queries that SQL can't express, held against the standard library in tests of their own.
WITHOUT_SQL = {"U12_ascii_hosts"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return value.isoformat() if hasattr(value, "isoformat") else repr(float(value)) if isinstance(value, float) else repr(value)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL))
def test_query_matches_oracle(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    result = db.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    pos = [names.index(c) for c in cols]
    assert sorted(tuple(plain(r[i]) for i in pos) for r in result.fetchall()) == rows
    if name not in {"V13_missing_artifacts"}:
        assert rows
