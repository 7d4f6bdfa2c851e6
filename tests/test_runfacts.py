"""As-of assignment of log rows to runs, metrics of a run, and the rules they fire."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.operators import runfacts as rf
from auditlake.plans import inputs
from auditlake.plans.audit import audit_facts, audit_inputs

RUN, ROW = "site_id string, run_id string, started_at long", "site_id string, seen_at long, n int"
SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("bucket", [1, 10, 3600])
def test_as_of_against_brute_force(spark, bucket):
    rng = random.Random(bucket)
    runs = [(f"s{rng.randrange(4)}", f"r{i}", rng.randrange(200)) for i in range(40)] + [("s0", "tie-a", 50), ("s0", "tie-b", 50), ("lonely", "r", 5)]
    rows = [(f"s{rng.randrange(5)}", rng.randrange(-20, 260), i) for i in range(400)]
    want = {}
    for site, at, n in rows:
        before = [(start, run) for s, run, start in runs if s == site and start <= at]
        if before:
            want[n] = max(before)[1]
    got = rf.as_of_runs(spark.createDataFrame(rows, ROW), spark.createDataFrame(runs, RUN), bucket=bucket)
    assert got.columns == ["site_id", "seen_at", "n", "run_id"]
    assert {r.n: r.run_id for r in got.collect()} == want and got.count() == len(want)


def test_as_of_odd_rows(spark):
    runs = spark.createDataFrame([("s", "a", 10), (None, "b", 0), ("s", "c", None)], RUN)
    rows = spark.createDataFrame([("s", 10, 1), ("s", 9, 2), ("s", None, 3), (None, 5, 4), ("s", 10, 1)], ROW)
    assert sorted((r.n, r.run_id) for r in rf.as_of_runs(rows, runs).collect()) == [(1, "a"), (1, "a")]
    assert rf.as_of_runs(rows.limit(0), runs).count() == 0 and rf.as_of_runs(rows, runs.limit(0)).count() == 0


def test_metrics_by_hand(spark):
    fetches = spark.createDataFrame([("s", "r", "text/html", t) for t in (100.0, 1300.0, 1500.0)] + [("s", "r", "image/png", 9999.0)], "site_id string, run_id string, content_type string, total_ms double")
    asset = "site_id string, run_id string, url string, type string, third_party boolean, same_origin boolean, render_blocking boolean, bytes long"
    assets = [("s", "r", "x.js", "script", True, False, False, 200 * 1024)] * 3 + [("s", "r", "y.js", "script", False, True, True, 100 * 1024), ("t", "r", "z.css", "stylesheet", False, True, True, None)]
    samples = spark.createDataFrame([("s", "r", float(v)) for v in (1, 2, 2600, 9000)], "site_id string, run_id string, value double")
    got = {(r.site_id, r.metric_id): (r.value, r.status) for r in rf.run_metrics(fetches, spark.createDataFrame(assets, asset), samples).collect()}
    assert got["s", "document-fetch-ms"] == (1300.0, "warning") and got["s", "lcp-ms"] == (2600.0, "warning")
    assert got["s", "total-js-kb"] == (300.0, "failed") and got["s", "third-party-js-kb"] == (200.0, "failed")
    assert got["s", "total-requests"] == (5.0, "passed") and got["s", "render-blocking-requests"] == (1.0, "passed")
    assert got["t", "document-fetch-ms"] == (None, "not_measured") and got["t", "total-requests"] == (1.0, "passed")


def test_every_rule_about_runs_fires_on_a_fact(spark):
    given, options = audit_inputs(spark, SF)
    _, facts = audit_facts(*given, **options)
    fired = {r.rule_id for r in facts.select("rule_id").distinct().collect()}
    assert {"SEO-PERF-001", "SEO-PERF-020", "SEO-PERF-021", "SEO-PERF-022", "SEO-PERF-023", "SEO-PERF-024", "SEO-SEARCH-001", "SEO-SEARCH-002", "SEO-SITEMAP-008", "SEO-SITEMAP-011"} <= fired
    # Each on some runs only.
    n_runs = given[0].select("site_id").distinct().count()
    per_rule = {r.rule_id: r.n for r in facts.filter("kind = 'f'").groupBy("rule_id").agg(F.count_distinct("site_id").alias("n")).collect()}
    assert all(0 < per_rule[x] < n_runs for x in per_rule if x.startswith(("SEO-PERF-02", "SEO-SEARCH", "SEO-SITEMAP")))


def test_only_the_fetches_of_its_time_count_for_a_run(spark):
    log, runs = inputs.fetch_log(spark, SF), inputs.audit_runs(spark, SF)
    by_run = {r.run_id: r.n for r in rf.as_of_runs(log, runs).groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    pages = log.count() // 3
    assert by_run == {"r-1": pages, "r0": pages}
