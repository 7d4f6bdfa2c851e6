"""Totals of search metrics."""

from auditlake.operators import fielddata as fd
from auditlake.plans import all_queries  # noqa: F401
from auditlake.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_search_totals_meet_before_the_metrics_part(spark):
    rows = spark.createDataFrame(
        [("s", "p", "q", "", None, 1, 10, 0.5, 3), ("s", "p", "q", None, "", 2, 20, 0.25, 4), ("s", "p", "q", "m", None, 5, 50, None, 1)],
        "site_id string, page string, query string, device string, country string, clicks long, impressions long, ctr double, position long",
    )
    out = fd.search_totals(rows, ["site_id"])
    assert {(r.url, tuple(sorted(r.dimensions.items())), r.metric, r.n, r.total) for r in out.collect()} == {
        ("p", d, m, n, v)
        for d, n, values in (((("query", "q"),), 2, (3.0, 30.0, 0.75, 7.0)), ((("device", "m"), ("query", "q")), 1, (5.0, 50.0, None, 1.0)))
        for m, v in zip(("clicks", "impressions", "ctr", "position"), values)
    }
    plan = QUERIES["S8_search_metrics"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Generate")] and "Aggregate" in plan
