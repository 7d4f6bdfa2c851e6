"""Lab and field performance: timings, resource weights, source precedence and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions import urls as u
from auditlake.functions.numeric import lookup, round_half_up
from auditlake.operators.ranking import nearest_ranks, ranked, top_k

HTML_TYPE = "(?i)html|xhtml"


def document_timings(fetch_log: DataFrame) -> DataFrame:
    return fetch_log.filter(F.coalesce(F.col("content_type").rlike(HTML_TYPE), F.lit(False)))


def timing_summary(fetch_log: DataFrame, keys: list[str]) -> DataFrame:
    """Count, min, median, p95 and max of document fetch times; no key's values meet in one task."""
    docs = document_timings(fetch_log)
    base = docs.groupBy(*keys).agg(
        F.count("*").alias("n_documents"), F.min("total_ms").alias("min_ms"), F.max("total_ms").alias("max_ms")
    )
    ranks = nearest_ranks(docs, keys, "total_ms", {"median_ms": 0.5, "p95_ms": 0.95})
    return base.join(ranks, keys, "left")


def resource_totals(resources: DataFrame, keys: list[str]) -> DataFrame:
    """Requests by origin and kilobytes by type, one decimal; plain conditional sums, combined map-side."""
    c = F.col
    kb = lambda cond: round_half_up(F.sum(F.when(cond, F.coalesce("bytes", F.lit(0))).otherwise(0)) / 1024, 1)
    return resources.groupBy(*keys).agg(
        F.count("*").alias("resources"),
        F.count_if("same_origin").alias("same_origin"),
        F.count_if("third_party").alias("third_party"),
        F.count_if("render_blocking").alias("render_blocking"),
        kb(c("type") == "script").alias("total_js_kb"),
        kb((c("type") == "script") & c("third_party")).alias("third_party_js_kb"),
        kb(c("type") == "stylesheet").alias("total_css_kb"),
        kb(c("type") == "image").alias("image_bytes_kb"),
    )


def browser_summary(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Lower medians of page timings and the worst layout shift."""
    out = pages.groupBy(*keys).agg(F.max("cls").alias("cls"))
    for metric in ("ttfb_ms", "fcp_ms", "lcp_ms"):
        out = out.join(nearest_ranks(pages, keys, metric, {metric: 0.5}), keys, "left")
    return out


def choose_source(rum: Column, crux: Column, browser: Column) -> Column:
    """Field beats lab: real users, then the public field report, then the browser."""
    return F.struct(
        F.coalesce(rum, crux, browser).alias("value"),
        F.when(rum.isNotNull(), "rum").when(crux.isNotNull(), "crux").when(browser.isNotNull(), "browser").alias("source"),
        F.when(F.coalesce(rum, crux).isNotNull(), "field")
        .when(browser.isNotNull(), "browser_lab")
        .otherwise("not_measured")
        .alias("reliability"),
    )


def budget_status(value: Column, budget: Column) -> Column:
    return (
        F.when(value.isNull(), "not_measured")
        .when(budget.isNull(), "passed")
        .when(value <= budget, "passed")
        .when(value <= budget * 1.15, "warning")
        .otherwise("failed")
    )


def metric_table(summary: DataFrame, keys: list[str], metrics: dict[str, str], budgets: dict[str, float] | None = None) -> DataFrame:
    """Wide summary to long metrics with budget and status. ``metrics``: metric id -> column."""
    limit = lookup(F.col("metric_id"), budgets if budgets is not None else dims.BUDGETS)
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric_id"), F.col(c).cast("double").alias("value")) for m, c in metrics.items()]
    )
    rows = summary.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.metric_id", "m.value")
    return rows.withColumn("budget", limit).withColumn("status", budget_status(F.col("value"), F.col("budget")))


STATUSES = ["passed", "warning", "failed", "not_measured"]


def status_counts(metrics: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def failed_metrics(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Failed metric ids of a run; at most one per metric of the fixed list."""
    failed = metrics.filter(F.col("status") == "failed")
    return failed.groupBy(*keys).agg(F.array_sort(F.collect_set("metric_id")).alias("failed_metrics"))


def third_party_cost(resources: DataFrame, keys: list[str], n_hosts: int = 12) -> DataFrame:
    """Requests, bytes and the first hosts by name; hosts are made distinct before any list is built."""
    rows = resources.filter("third_party")
    base = rows.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.sum(F.coalesce("bytes", F.lit(0))).alias("known_bytes")
    )
    hosts = rows.select(*keys, u.hostname(F.col("url")).alias("host")).filter("host <> ''").distinct()
    total = hosts.groupBy(*keys).agg(F.count("*").alias("n_hosts"))
    names = top_k(hosts, keys, [F.col("host")], n_hosts).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list("host")), ",").alias("hosts")
    )
    return base.join(total, keys, "left").join(names, keys, "left")


def largest_assets(resources: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    known = resources.filter(F.col("bytes").isNotNull())
    return top_k(known, keys, [F.col("bytes").desc(), F.col("url")], k)


def blocking_requests(resources: DataFrame, keys: list[str], k: int = 12) -> DataFrame:
    rows = resources.filter("render_blocking")
    return top_k(rows, keys, [F.coalesce("bytes", F.lit(0)).desc(), F.col("url")], k)


def metric_deltas(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of metrics present on both sides."""
    b = baseline.filter(F.col("value").isNotNull()).select(*keys, "metric_id", F.col("value").alias("before"))
    c = current.filter(F.col("value").isNotNull()).select(*keys, "metric_id", F.col("value").alias("after"))
    return c.join(b, [*keys, "metric_id"]).withColumn("delta", F.col("after") - F.col("before"))


def label_runs(fetch_log: DataFrame, keys: list[str], max_runs: int | None = None) -> DataFrame:
    """Run number of each fetch of a URL and its profile: crawl, cold, warm. All fetches are
    labelled; ``max_runs`` leaves out later ones. Fetches are sorted inside hours, whose sizes are counted first, so no
    task sorts a whole URL."""
    # Structs, so that a null URL or time meets its like in the join of the hours' sizes.
    keyed = fetch_log.withColumn("_url", F.struct(*keys, "url"))
    hour = F.struct(F.floor(F.unix_timestamp("started_at") / 3600).alias("hour"))
    placed = ranked(keyed, ["_url"], hour, [F.col("started_at"), F.col("event_id")], "run").drop("_url")
    if max_runs is not None:
        placed = placed.filter(F.col("run") <= max_runs)
    return placed.withColumn(
        "profile", F.when(F.col("run") == 1, "crawl").when(F.col("run") == 2, "cold").otherwise("warm")
    )


def browser_rollup(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Error counts, metric coverage and distinct runtime frameworks of rendered pages."""
    base = pages.groupBy(*keys).agg(
        F.count("*").alias("pages_visited"),
        F.sum("console_errors").alias("console_errors"),
        F.sum("failed_requests").alias("failed_requests"),
        F.count("lcp_ms").alias("lcp_coverage"),
        F.count("cls").alias("cls_coverage"),
        F.count_if("hydration_risk").alias("hydration_risk_pages"),
    )
    named = pages.select(*keys, F.explode("frameworks").alias("framework")).distinct()
    # At most the few names of the marker table per key.
    lists = named.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("framework")), ",").alias("frameworks"))
    return base.join(lists, keys, "left")


# Runtime markers of a rendered page and what they reveal.
FRAMEWORK_MARKERS = {
    "svelteKitAssets": "sveltekit",
    "svelteKitPreload": "sveltekit",
    "nextData": "nextjs",
    "nextRoot": "nextjs",
    "astroIsland": "astro",
    "nuxtData": "nuxt",
}
BUNDLER_MARKERS = {"viteModuleGraph": "vite", "svelteKitAssets": "vite"}


def runtime_names(markers: Column, table: dict[str, str]) -> Column:
    """Distinct names behind the true markers of a map<string,boolean>."""
    hits = [F.when(F.coalesce(F.try_element_at(markers, F.lit(m)), F.lit(False)), F.lit(n)) for m, n in table.items()]
    return F.array_distinct(F.array_compact(F.array(*hits)))
