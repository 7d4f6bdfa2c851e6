"""Scores join rows of runs without sending any side through the driver, whatever size the planner sees."""

import pytest

from auditlake import dims
from auditlake.operators import scoring as s
from auditlake.plans import all_queries  # noqa: F401
from auditlake.plans.registry import QUERIES
from auditlake.session import materialise

COUNTED = "catalog_rules", "applicable_rules", "measured_rules", "percent_measured"


@pytest.fixture
def lines(spark, tmp_path):
    row = lambda site, order, part, status, discount=0.0: (order, part, site, 5, 30.0, 100.0, discount, 0.02, "A", status)
    rows = [row(1, 1, 0, "O"), row(1, 2, 0, "O"), row(1, 3, 5, "F"), row(2, 4, 9, "F", 0.1), row(2, 5, 3, "O"), row(None, 6, 1, "O"), row(3, 7, None, "O")]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def ran(df):
    """Rows, and the plan as it was run in the end."""
    return df.collect(), df._jdf.queryExecution().executedPlan().toString()


def test_profiles_of_written_tables(spark):
    category = dims.PROFILES["core_seo"][0]
    ledger = spark.createDataFrame(
        [("a", "r", "R1", category, "stable", "failed", True, True), ("a", "r", "R2", category, "stable", "not_measured", True, False), (None, "r", "R1", category, "stable", "passed", True, True)],
        "site_id string, run_id string, rule_id string, category string, maturity string, status string, applicable boolean, measured boolean",
    )
    groups = [("a", "r", "R1", category, 7.0), ("a", "r", "R1", category, 2.0), ("a", "r", "R2", category, 50.0), (None, "r", "R1", category, 30.0)]
    penalties = spark.createDataFrame(groups, "site_id string, run_id string, rule_id string, category string, penalty double")
    runs = spark.createDataFrame([("a", "r"), ("b", "r"), ("b", "r"), (None, "r")], "site_id string, run_id string")
    rows, plan = ran(s.profiles_of(runs, materialise(penalties, "penalties"), materialise(ledger, "ledger")))
    core = [(r.site_id, r.score, r.level, *(r[c] for c in COUNTED)) for r in rows if r.profile == "core_seo"]
    assert sorted(core, key=str) == sorted(
        [("a", 91, "excellent", 2, 2, 1, 50), ("b", 100, "excellent", None, None, None, None), ("b", 100, "excellent", None, None, None, None), (None, 100, "excellent", None, None, None, None)], key=str
    )
    assert len(rows) == 4 * len(dims.PROFILES) and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["C6_score_profiles", "V2_score_contract"])
def test_no_side_is_broadcast(spark, lines, name):
    rows, plan = ran(QUERIES[name](spark, lines))
    assert rows and "SortMergeJoin" in plan and "Broadcast" not in plan
