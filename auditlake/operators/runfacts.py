"""Facts of one audit run out of logs that know only when something was seen: as-of assignment and run metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.operators.performance import document_timings, failed_metrics, metric_table, resource_totals
from auditlake.operators.ranking import nearest_ranks
from auditlake.session import materialise

SITE = ["site_id", "run_id"]
#: Seconds in a bucket of the as-of join.
BUCKET = 3600


def as_of_runs(rows: DataFrame, runs: DataFrame, at: str = "seen_at", bucket: int = BUCKET) -> DataFrame:
    """``rows`` (site_id, ``at`` in seconds) with the run_id of the site's latest run that started at or before them, rows
    before any run left out. ``runs``: site_id, run_id, started_at.

    An as-of join without a window over the rows: time is cut into buckets, and per (site, bucket) that holds a row
    the runs in question are the one in force when the bucket begins and those that start inside it. So a site with a
    third of all rows is spread over its buckets, and no row meets runs of other times. Runs that start together
    are told apart by run_id, the last one counts."""
    of_time = lambda c: F.floor(F.col(c) / bucket)
    told = rows.withColumn("_bucket", of_time(at))
    start = F.struct(F.col("started_at").alias("at"), "run_id")
    starts = runs.select("site_id", of_time("started_at").alias("_bucket"), start.alias("start"))
    # Marks stand before the runs of their bucket, so the last run before a mark is that in force when it begins.
    marks = told.select("site_id", "_bucket").distinct().withColumn("start", F.lit(None).cast(starts.schema["start"].dataType))
    earlier = W.partitionBy("site_id").orderBy("_bucket", F.col("start").isNotNull(), "start").rowsBetween(W.unboundedPreceding, 0)
    in_force = marks.unionByName(starts).withColumn("held", F.last("start", ignorenulls=True).over(earlier)).filter("start IS NULL").select("site_id", "_bucket", "held")
    # By bucket, from when to when each of its runs is the latest; of runs that start together only the last has a time.
    inside = in_force.filter("held IS NOT NULL").select("site_id", "_bucket", F.col("held").alias("start")).unionByName(starts)
    next_start = F.lead("start.at").over(W.partitionBy("site_id", "_bucket").orderBy("start"))
    spans = inside.select("site_id", "_bucket", F.col("start.run_id").alias("run_id"), F.col("start.at").alias("_from"), next_start.alias("_to"))
    # Written, so that its size tells how to join it.
    spans = materialise(spans, "run-spans")
    latest = (F.col(at) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
    return told.join(spans, ["site_id", "_bucket"]).filter(latest).drop("_bucket", "_from", "_to")


def run_metrics(fetches: DataFrame, assets: DataFrame, samples: DataFrame, budgets: dict[str, float] | None = None) -> DataFrame:
    """Metrics of every run that has any fact: site_id, run_id, metric_id, value, budget, status.

    ``fetches``: (site, run, content_type, total_ms) of document fetches, ``assets``: (site, run, url, type, third_party,
    same_origin, render_blocking, bytes), a row per fetch of an asset, ``samples``: (site, run, value) of the largest
    contentful paint. Every asset URL of a run counts once, with its largest size. Medians and p75 are nearest ranks."""
    per_asset = assets.groupBy(*SITE, "url").agg(
        F.min("type").alias("type"), *[F.max(c).alias(c) for c in ("third_party", "same_origin", "render_blocking", "bytes")]
    )
    documents = document_timings(fetches)
    wide = (
        fetches.select(*SITE).union(assets.select(*SITE)).union(samples.select(*SITE)).distinct()
        .join(documents.groupBy(*SITE).agg(F.count("*").alias("n_documents")), SITE, "left")
        .join(nearest_ranks(documents, SITE, "total_ms", {"median_ms": 0.5}), SITE, "left")
        .join(resource_totals(per_asset, SITE), SITE, "left")
        .join(nearest_ranks(samples, SITE, "value", {"lcp_ms": 0.75}), SITE, "left")
        .withColumn("requests", F.coalesce("n_documents", F.lit(0)) + F.coalesce("resources", F.lit(0)))
    )
    columns = {
        "document-fetch-ms": "median_ms", "lcp-ms": "lcp_ms", "total-requests": "requests", "render-blocking-requests": "render_blocking",
        "total-js-kb": "total_js_kb", "third-party-js-kb": "third_party_js_kb", "total-css-kb": "total_css_kb", "image-bytes-kb": "image_bytes_kb",
    }
    return metric_table(wide, SITE, columns, budgets if budgets is not None else dims.BUDGETS)


def failed_by_run(fetches: DataFrame, assets: DataFrame, samples: DataFrame, runs: DataFrame, budgets: dict[str, float] | None = None) -> DataFrame:
    """site_id, run_id, failed_metrics: the metrics over budget of every run, from logs that know only times (``seen_at``).

    The three logs are given their runs as one table, which is written and read by each part of the metrics."""
    logs = {"fetch": fetches, "asset": assets, "sample": samples}
    told = [log.withColumn("_log", F.lit(name)) for name, log in logs.items()]
    of_run = materialise(as_of_runs(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), told), runs), "run-logs")
    part = lambda name: of_run.filter(F.col("_log") == name).select("run_id", *logs[name].columns)
    return failed_metrics(run_metrics(part("fetch"), part("asset"), part("sample"), budgets), SITE)
