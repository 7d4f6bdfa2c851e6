"""Documents of few bytes and long work are read by many tasks."""

from auditlake.plans import all_queries  # noqa: F401
from auditlake.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_documents_of_contracts_are_dealt_out(spark):
    for name in ("V3_dashboard_documents_violations", "V3_dashboard_documents_counts"):
        df = QUERIES[name](spark, SF)
        assert "RepartitionByExpression [k#" in df._jdf.queryExecution().optimizedPlan().toString()
