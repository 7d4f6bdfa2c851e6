"""Search, field and real-user metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.numeric import round_half_up
from auditlake.functions.text import ascii_edges
from auditlake.operators.ranking import nearest_ranks, top_k

VITALS = ["LCP", "INP", "CLS", "TTFB", "FCP"]
# Metric names of the public field report.
CRUX_METRICS = [
    "largest_contentful_paint",
    "interaction_to_next_paint",
    "cumulative_layout_shift",
    "first_contentful_paint",
    "experimental_time_to_first_byte",
]
RUM_ROW = (
    "array<struct<metric:string,name:string,p75:string,value:string,samples:string,sampleCount:string,"
    "goodRate:string,url:string,route:string,device:string>>"
)


def numeric(text: Column) -> Column:
    """Finite number or NULL."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def rum_raw_rows(texts: DataFrame, column: str = "raw") -> DataFrame:
    """Rows of RUM files of any accepted shape: a bare array, or an object with metrics, rows or vitals.

    Whether a row carries a p75 key at all decides its kind, so key presence is kept beside the values."""
    raw = F.trim(column)
    shapes = F.from_json(raw, "struct<metrics:string,rows:string,vitals:string>")
    is_array = lambda t: F.when(F.ltrim(t).startswith("["), t)
    chosen = F.when(raw.startswith("["), raw).otherwise(
        F.coalesce(is_array(shapes["metrics"]), is_array(shapes["rows"]), is_array(shapes["vitals"]))
    )
    keep = [c for c in texts.columns if c != column]
    objects = texts.select(*keep, F.explode(F.from_json(chosen, "array<string>")).alias("obj"))
    item = F.from_json("obj", RUM_ROW[len("array<") : -1])
    return objects.select(
        *keep, item.alias("r"), F.array_contains(F.json_object_keys("obj"), "p75").alias("has_p75")
    ).select(*keep, "r.*", "has_p75")


def rum_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Ready p75 rows are kept; raw event values become one p75 row per metric with their count."""
    metric = F.upper(F.coalesce("metric", "name"))
    typed = rows.select(
        *keys,
        metric.alias("metric"),
        F.when(F.col("has_p75"), numeric(F.coalesce("p75", "value"))).otherwise(numeric(F.col("value"))).alias("v"),
        "has_p75",
        numeric(F.coalesce("samples", "sampleCount")).alias("samples"),
        numeric(F.col("goodRate")).alias("good_rate"),
    ).filter(F.col("metric").isin(VITALS) & F.col("v").isNotNull())
    ready = typed.filter("has_p75").select(*keys, "metric", F.col("v").alias("p75"), "samples", "good_rate")
    events = typed.filter("NOT has_p75")
    group = [*keys, "metric"]
    counted = events.groupBy(*group).agg(F.count("*").cast("double").alias("samples"))
    summed = nearest_ranks(events, group, "v", {"p75": 0.75}).join(counted, group)
    return ready.unionByName(summed.select(*group, "p75", "samples", F.lit(None).cast("double").alias("good_rate")))


def rum_summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted p75 over the metric rows and the sample sum (NULL when no row has one)."""
    group = [*keys, "metric"]
    base = metrics.groupBy(*group).agg(F.count("*").alias("n_rows"), F.sum("samples").alias("samples"))
    return base.join(nearest_ranks(metrics, group, "p75", {"p75": 0.75}), group)


def rum_worst(metrics: DataFrame, keys: list[str], k: int = 8) -> DataFrame:
    weight = F.when(F.col("metric") == "CLS", F.col("p75") * 10000).otherwise(F.col("p75"))
    ties = [c for c in ("metric", "p75", "samples", "row_id") if c in metrics.columns]
    return top_k(metrics.withColumn("badness", weight), keys, [F.col("badness").desc(), *[F.col(t) for t in ties]], k)


def _weighted_position(digits: int) -> Column:
    return round_half_up(F.sum(F.col("position") * F.col("impressions")) / F.nullif(F.sum("impressions"), F.lit(0)), digits)


def search_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Clicks, impressions, click rate and mean position weighted by impressions."""
    ctr = round_half_up(F.sum("clicks") / F.nullif(F.sum("impressions"), F.lit(0)), 4)
    return rows.groupBy(*keys).agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        ctr.alias("average_ctr"),
        _weighted_position(2).alias("average_position"),
    )


def search_top(rows: DataFrame, keys: list[str], by: str, k: int = 10) -> DataFrame:
    """Top pages or queries by clicks, impressions, key; empty keys are dropped."""
    named = rows.filter(F.col(by).isNotNull() & (F.col(by) != ""))
    agg = named.groupBy(*keys, by).agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), _weighted_position(2).alias("position")
    )
    return top_k(agg, keys, [F.col("clicks").desc(), F.col("impressions").desc(), F.col(by)], k)


def search_row(raw: DataFrame) -> DataFrame:
    """Positional keys to page, query and device; missing numbers are zero."""
    key = lambda i: F.nullif(F.try_element_at("keys", F.lit(i)), F.lit(""))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    keep = [c for c in raw.columns if c not in ("keys", "clicks", "impressions", "ctr", "position")]
    return raw.select(
        *keep, key(1).alias("page"), key(2).alias("query"), key(3).alias("device"),
        zero("clicks"), zero("impressions"), zero("ctr"), zero("position"),
    )


def search_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One search row to four (metric, value) rows with compact dimensions."""
    dims_map = F.map_filter(
        F.create_map(F.lit("query"), F.col("query"), F.lit("device"), F.col("device"), F.lit("country"), F.col("country")),
        lambda k, v: v.isNotNull() & (v != ""),
    )
    value = lambda c: F.col(c).cast("double").alias(c)
    wide = rows.select(*keys, F.col("page").alias("url"), dims_map.alias("dimensions"), *[value(c) for c in ("clicks", "impressions", "ctr", "position")])
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("clicks", "impressions", "ctr", "position")])
    return wide.select(*keys, "url", "dimensions", F.explode(pairs).alias("p")).select(*keys, "url", "dimensions", "p.*")


def search_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count and sum per metric, page and dimensions. Rows of the same page and dimensions are summed before their four metrics
    become rows, so a quarter of the rows is exchanged."""
    c, metrics = F.col, ("clicks", "impressions", "ctr", "position")
    kept = {d: F.nullif(c(d), F.lit("")) for d in ("query", "device", "country")}
    sums = rows.withColumns(kept).groupBy(*keys, "page", *kept).agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in metrics])
    return search_metrics(sums, [*keys, "n"]).withColumnRenamed("value", "total")


def metric_rows(raw: DataFrame) -> DataFrame:
    """Generic metric file: rows without a text metric or a numeric value are dropped."""
    keep = [c for c in raw.columns if c not in ("metric", "value")]
    return raw.select(*keep, "metric", numeric(F.col("value")).alias("value")).filter(
        F.col("metric").isNotNull() & F.col("value").isNotNull()
    )


INDEXED = r"(?i)^(indexed|submitted and indexed)\b"


def inspections(raw: DataFrame) -> DataFrame:
    """URL inspection results flattened; without an index part only the failure is known."""
    idx = F.col("result.index_status")
    return raw.select(
        "site_id",
        "url",
        F.when(F.col("result").isNotNull(), "ok").otherwise("failed").alias("status"),
        idx["verdict"].alias("verdict"),
        idx["coverage_state"].alias("coverage_state"),
        F.coalesce(idx["referring_urls"], F.array().cast("array<string>")).alias("referring_urls"),
        idx.isNotNull().alias("raw_available"),
    )


def indexed_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    ok = F.col("status") == "ok"
    indexed = ok & F.coalesce((F.col("verdict") == "PASS") | F.coalesce("coverage_state", F.lit("")).rlike(ascii_edges(INDEXED)), F.lit(False))
    out = rows.groupBy(*keys).agg(F.count_if(indexed).alias("indexed"), F.count_if(ok).alias("n_ok"))
    return out.select(*keys, "indexed", (F.col("n_ok") - F.col("indexed")).alias("not_indexed"))


def crux_metrics(records: DataFrame, keys: list[str]) -> DataFrame:
    """Per metric p75 and the three densities of a field record. ``metrics``: map<string,struct<p75,histogram>>."""
    rows = records.select(*keys, F.explode("metrics").alias("metric", "m")).filter(F.col("metric").isin(CRUX_METRICS))
    density = lambda i: F.try_element_at("m.histogram", F.lit(i))["density"]
    return rows.select(
        *keys,
        "metric",
        numeric(F.col("m.p75")).alias("p75"),
        F.when(F.col("metric") == "cumulative_layout_shift", "score").otherwise("ms").alias("unit"),
        density(1).alias("good"),
        density(2).alias("needs_improvement"),
        density(3).alias("poor"),
    )


def crux_eav(records: DataFrame, keys: list[str]) -> DataFrame:
    rows = records.select(*keys, F.explode("metrics").alias("metric", "m"))
    return rows.select(*keys, "metric", numeric(F.col("m.p75")).alias("value")).filter(F.col("value").isNotNull())


def crux_history(records: DataFrame, keys: list[str]) -> DataFrame:
    """Parallel arrays to dated points; a period without a date is named by its position."""
    rows = records.select(*keys, "metric", "periods", F.posexplode("p75s").alias("pos", "p"))
    d = F.try_element_at("periods", F.col("pos") + 1)
    dated = F.when(
        d.isNotNull() & (d["year"] > 0) & (d["month"] > 0) & (d["day"] > 0),
        F.format_string("%d-%02d-%02d", d["year"], d["month"], d["day"]),
    ).otherwise(F.concat(F.lit("period-"), (F.col("pos") + 1).cast("string")))
    return rows.select(*keys, "metric", dated.alias("date"), numeric(F.col("p")).alias("p75"))


def crux_summary(records: DataFrame, metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Record status counts, and p75 per metric of the origin record over all devices."""
    status = records.groupBy(*keys).agg(
        F.count_if(F.col("status") == "ok").alias("records_ok"),
        F.count_if(F.col("status") == "not_found").alias("records_not_found"),
        F.count_if(F.col("status") == "failed").alias("records_failed"),
    )
    origin = metrics.filter((F.col("scope") == "origin") & (F.col("form_factor") == "ALL"))
    # The first record of that scope speaks for the site.
    first = lambda m: F.min(F.when((F.col("metric") == m) & F.col("p75").isNotNull(), F.struct("ord", "p75")))["p75"]
    p75 = origin.groupBy(*keys).agg(*[first(m).alias(m) for m in CRUX_METRICS])
    return status.join(p75, keys, "left")


def record_status(records: DataFrame, keys: list[str]) -> DataFrame:
    """One status per provider from its record statuses."""
    n, ok, nf = F.count("*"), F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") == "not_found")
    out = F.when(ok == n, "ok").when(ok > 0, "partial").when(nf == n, "unavailable").otherwise("failed")
    return records.groupBy(*keys).agg(out.alias("provider_status"))


def merged_status(providers: DataFrame, keys: list[str], column: str = "provider_status") -> DataFrame:
    """One status over all providers of a run."""
    n = F.count("*")
    is_ = lambda *s: F.count_if(F.col(column).isin(*s))
    out = (
        F.when(is_("disabled") == n, "disabled")
        .when(is_("ok") == n, "ok")
        .when(is_("ok", "partial") > 0, "partial")
        .when(is_("unavailable", "disabled") == n, "unavailable")
        .otherwise("failed")
    )
    return providers.groupBy(*keys).agg(out.alias("status"))


def coverage_flags(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Wide flags: which vitals a run has, and its p75 values."""
    return metrics.groupBy(*keys).agg(
        *[F.bool_or(F.col("metric") == v).alias(f"has_{v.lower()}") for v in VITALS],
        *[F.max(F.when(F.col("metric") == v, F.col("p75"))).alias(f"{v.lower()}_p75") for v in VITALS[:3]],
        F.sum("samples").alias("samples"),
    )


def sample_urls(pages: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The operator's own sample: the first n distinct final URLs of a run in crawl order."""
    firsts = pages.groupBy(*keys, "final_url").agg(F.min("ord").alias("ord"))
    return top_k(firsts, keys, [F.col("ord"), F.col("final_url")], n)


def date_window(today: Column) -> tuple[Column, Column]:
    """Default search window: it ends three days ago and is 28 days long."""
    end = F.date_sub(today, 3)
    return F.date_sub(end, 27), end
