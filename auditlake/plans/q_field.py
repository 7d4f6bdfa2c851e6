"""Queries over timings, resources, real-user, field and search metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake import dims
from auditlake.operators import fielddata as fd
from auditlake.operators import performance as pf
from auditlake.operators import ranking as rk
from auditlake.plans import inputs
from auditlake.plans import oracle as o
from auditlake.plans.q_scores import SEARCH_SQL, SR, search_rows
from auditlake.plans.registry import query

KEY = ["site_id"]
_SITE = "'https://u' || CAST(user_id % 50 AS STRING) || '.example'"
# Every event is one fetch of a page or document.
FETCH_SQL = f"""{_SITE} AS site_id, 'r0' AS run_id, event_id, {_SITE} || '/p/' || CAST(event_id % 40 AS STRING) AS url, ts AS started_at,
 CASE event_type WHEN 'error' THEN 'application/json' WHEN 'purchase' THEN NULL WHEN 'click' THEN 'application/XHTML+xml' ELSE 'text/html' END AS content_type, CAST(round(value * 10) AS BIGINT) AS total_ms"""
FETCH = f"fetched AS (SELECT {FETCH_SQL} FROM events)"
# Every line item is one resource of a site.
RES_SQL = """'https://s' || CAST(l_suppkey AS STRING) || '.example' AS site_id, 'r0' AS run_id, 'https://' || CASE WHEN l_returnflag = 'R' THEN 'cdn' || CAST(l_partkey % 30 AS STRING) || '.example.net' ELSE 's' || CAST(l_suppkey AS STRING) || '.example' END || '/f/' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS url,
 CASE l_linenumber % 4 WHEN 0 THEN 'script' WHEN 1 THEN 'stylesheet' WHEN 2 THEN 'image' ELSE 'font' END AS type, l_returnflag <> 'R' AS same_origin, l_returnflag = 'R' AS third_party, l_linenumber <= 2 AS render_blocking, CASE WHEN l_tax > 0 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS bytes"""
RES = f"res AS (SELECT {RES_SQL} FROM lineitem)"
# Every event is one real-user sample.
RUM_SQL = f"{_SITE} AS site_id, event_id, ts, CASE event_type WHEN 'view' THEN 'LCP' WHEN 'click' THEN 'INP' WHEN 'purchase' THEN 'CLS' WHEN 'signup' THEN 'TTFB' ELSE 'FCP' END AS metric, value"
RUM = f"rum AS (SELECT {RUM_SQL} FROM events)"


def fetch_log(spark, sf):
    return inputs.table(spark, sf, "events").selectExpr(*inputs._split(FETCH_SQL))


def resources(spark, sf):
    return inputs.table(spark, sf, "lineitem").selectExpr(*inputs._split(RES_SQL))


def rum(spark, sf):
    return inputs.table(spark, sf, "events").selectExpr(*inputs._split(RUM_SQL))


@query("F1_nearest_rank_percentile", "SELECT l_suppkey, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.75) AS p75, quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY 1")
def f1(spark, sf):
    rows = inputs.table(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice")
    return rk.nearest_ranks(rows, ["l_suppkey"], "l_extendedprice", {"p50": 0.5, "p75": 0.75, "p95": 0.95})


@query("F2_document_timings", o.with_([FETCH], "SELECT site_id, count(*) AS n_documents, min(total_ms) AS min_ms, max(total_ms) AS max_ms, quantile_disc(total_ms, 0.5)::DOUBLE AS median_ms, quantile_disc(total_ms, 0.95)::DOUBLE AS p95_ms FROM fetched WHERE regexp_matches(content_type, '(?i)html|xhtml') GROUP BY 1"))
def f2(spark, sf):
    return pf.timing_summary(fetch_log(spark, sf), KEY)


def kb(cond):
    return f"floor(sum(CASE WHEN {cond} THEN coalesce(bytes, 0) ELSE 0 END)::DOUBLE / 1024 * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE"


TOTALS = f"tot AS (SELECT site_id, count(*) AS resources, count(*) FILTER (same_origin) AS same_origin, count(*) FILTER (third_party) AS third_party, count(*) FILTER (render_blocking) AS render_blocking, {kb(chr(116) + 'ype = ' + o.q('script'))} AS total_js_kb, {kb('type = ' + o.q('script') + ' AND third_party')} AS third_party_js_kb, {kb('type = ' + o.q('stylesheet'))} AS total_css_kb, {kb('type = ' + o.q('image'))} AS image_bytes_kb FROM res GROUP BY 1)"


@query("F3_request_totals", o.with_([RES, TOTALS], "SELECT * FROM tot"))
def f3(spark, sf):
    return pf.resource_totals(resources(spark, sf), KEY)


# Rendered pages: per event the timing its type stands for.
LAB_SQL = f"{_SITE} AS site_id, event_id, CASE WHEN event_type = 'view' THEN value END AS ttfb_ms, CASE WHEN event_type = 'click' THEN value END AS fcp_ms, CASE WHEN event_type IN ('purchase', 'signup') THEN value END AS lcp_ms, CASE WHEN event_type = 'error' THEN value / 1000 END AS cls"


@query("F4_browser_lab", f"SELECT site_id, max(cls) AS cls, quantile_disc(ttfb_ms, 0.5) AS ttfb_ms, quantile_disc(fcp_ms, 0.5) AS fcp_ms, quantile_disc(lcp_ms, 0.5) AS lcp_ms FROM (SELECT {LAB_SQL} FROM events) GROUP BY 1")
def f4(spark, sf):
    return pf.browser_summary(inputs.table(spark, sf, "events").selectExpr(*inputs._split(LAB_SQL)), KEY)


CHOICE = "CASE WHEN event_id % 3 = 0 THEN value END AS rum, CASE WHEN event_id % 4 = 0 THEN value + 1 END AS crux, CASE WHEN event_id % 5 = 0 THEN value + 2 END AS browser"


@query("F5_source_precedence", f"SELECT event_id, coalesce(rum, crux, browser) AS value, CASE WHEN rum IS NOT NULL THEN 'rum' WHEN crux IS NOT NULL THEN 'crux' WHEN browser IS NOT NULL THEN 'browser' END AS source, CASE WHEN coalesce(rum, crux) IS NOT NULL THEN 'field' WHEN browser IS NOT NULL THEN 'browser_lab' ELSE 'not_measured' END AS reliability FROM (SELECT event_id, {CHOICE} FROM events)")
def f5(spark, sf):
    rows = inputs.table(spark, sf, "events").selectExpr("event_id", *inputs._split(CHOICE))
    return rows.select("event_id", pf.choose_source(F.col("rum"), F.col("crux"), F.col("browser")).alias("c")).select("event_id", "c.*")


METRIC_COLS = {"total-js-kb": "total_js_kb", "third-party-js-kb": "third_party_js_kb", "total-css-kb": "total_css_kb", "image-bytes-kb": "image_bytes_kb", "render-blocking-requests": "render_blocking", "total-requests": "resources", "fcp-ms": "no_value"}
# Supplier sites carry many resources, so the budgets are scaled to sit among the values.
SCALED = {k: v * 40 for k, v in dims.BUDGETS.items()}
METRICS = "met AS (SELECT site_id, metric_id, value, budget, CASE WHEN value IS NULL THEN 'not_measured' WHEN budget IS NULL OR value <= budget THEN 'passed' WHEN value <= budget * 1.15::DOUBLE THEN 'warning' ELSE 'failed' END AS status FROM (" + " UNION ALL ".join(
    f"SELECT site_id, '{m}' AS metric_id, {'NULL' if c == 'no_value' else c}::DOUBLE AS value, {SCALED.get(m, 'NULL')}::DOUBLE AS budget FROM tot" for m, c in METRIC_COLS.items()) + "))"


def metrics(spark, sf):
    totals = pf.resource_totals(resources(spark, sf), KEY).withColumn("no_value", F.lit(None).cast("double"))
    return pf.metric_table(totals, KEY, METRIC_COLS, SCALED)


@query("F6_budget_status", o.with_([RES, TOTALS, METRICS], "SELECT * FROM met"))
def f6(spark, sf):
    return metrics(spark, sf)


@query("F7_status_counts", o.with_([RES, TOTALS, METRICS], "SELECT site_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in pf.STATUSES) + " FROM met GROUP BY 1"))
def f7(spark, sf):
    return pf.status_counts(metrics(spark, sf), KEY)


@query("R4_failed_metrics", o.with_([RES, TOTALS, METRICS], "SELECT site_id, string_agg(metric_id, ',' ORDER BY metric_id) AS failed_metrics FROM met WHERE status = 'failed' GROUP BY 1"))
def r4(spark, sf):
    return pf.failed_metrics(metrics(spark, sf), KEY).select("site_id", F.array_join("failed_metrics", ",").alias("failed_metrics"))


@query("F8_third_party_cost", o.with_([RES], "SELECT site_id, count(*) AS requests, CAST(sum(coalesce(bytes, 0)) AS BIGINT) AS known_bytes, count(DISTINCT host) AS n_hosts, array_to_string(list_sort(list(DISTINCT host))[1:12], ',') AS hosts FROM (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM res WHERE third_party) GROUP BY 1"))
def f8(spark, sf):
    return pf.third_party_cost(resources(spark, sf), KEY)


@query("F9_largest_assets", o.with_([RES], "SELECT site_id, url, type, bytes, third_party, rank FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY bytes DESC, url) AS rank FROM res WHERE bytes IS NOT NULL) WHERE rank <= 10"))
def f9(spark, sf):
    return pf.largest_assets(resources(spark, sf), KEY).select("site_id", "url", "type", "bytes", "third_party", F.col("rank").cast("long").alias("rank"))


@query("F10_render_blocking", o.with_([RES], "SELECT site_id, url, bytes, rank FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY coalesce(bytes, 0) DESC, url) AS rank FROM res WHERE render_blocking) WHERE rank <= 12"))
def f10(spark, sf):
    return pf.blocking_requests(resources(spark, sf), KEY).select("site_id", "url", "bytes", F.col("rank").cast("long").alias("rank"))


# RUM files of every accepted shape, one per event.
RAW_SQL = f"""{_SITE} AS site_id, event_id, CASE event_id % 6 WHEN 0 THEN '[{{"metric":"LCP","p75":' || CAST(event_id AS STRING) || ',"samples":10}}]' WHEN 1 THEN '{{"metrics":[{{"name":"cls","value":' || CAST(event_id AS STRING) || '}}]}}'
 WHEN 2 THEN '{{"rows":[{{"metric":"inp","p75":null,"value":' || CAST(event_id AS STRING) || '}}]}}' WHEN 3 THEN '{{"vitals":[{{"metric":"TTFB","value":"' || CAST(event_id AS STRING) || '"}},{{"metric":"bogus","value":1}}]}}' WHEN 4 THEN '{{"other":1}}' ELSE '{{"rows":[{{"name":"LCP","value":' || CAST(event_id AS STRING) || '}}],"vitals":[]}}' END AS raw"""


@query("S5_rum_import", f"""SELECT site_id, event_id, CASE event_id % 6 WHEN 0 THEN 'LCP' WHEN 1 THEN 'cls' WHEN 2 THEN 'inp' WHEN 3 THEN 'TTFB' ELSE 'LCP' END AS metric, event_id % 6 IN (0, 2) AS has_p75 FROM (SELECT {_SITE} AS site_id, event_id FROM events) WHERE event_id % 6 <> 4
 UNION ALL SELECT {_SITE}, event_id, 'bogus', false FROM events WHERE event_id % 6 = 3""")
def s5(spark, sf):
    raw = inputs.table(spark, sf, "events").selectExpr(*inputs._split(RAW_SQL))
    return fd.rum_raw_rows(raw).select("site_id", "event_id", F.coalesce("metric", "name").alias("metric"), "has_p75")


@query("F11_rum_normalisation", f"""WITH e AS (SELECT {_SITE} AS site_id, event_id, event_id % 6 AS k, event_id::DOUBLE AS v FROM events)
SELECT site_id, 'LCP' AS metric, v AS p75, 10.0::DOUBLE AS samples FROM e WHERE k = 0 UNION ALL SELECT site_id, 'INP', v, NULL FROM e WHERE k = 2
 UNION ALL SELECT site_id, CASE k WHEN 1 THEN 'CLS' WHEN 3 THEN 'TTFB' ELSE 'LCP' END, quantile_disc(v, 0.75), count(*)::DOUBLE FROM e WHERE k IN (1, 3, 5) GROUP BY 1, 2""")
def f11(spark, sf):
    raw = inputs.table(spark, sf, "events").selectExpr(*inputs._split(RAW_SQL))
    return fd.rum_metrics(fd.rum_raw_rows(raw), KEY).select("site_id", "metric", "p75", "samples")


RUMROWS = f"{_SITE} AS site_id, event_id AS row_id, CASE event_type WHEN 'view' THEN 'LCP' WHEN 'click' THEN 'INP' WHEN 'purchase' THEN 'CLS' WHEN 'signup' THEN 'TTFB' ELSE 'FCP' END AS metric, value AS p75, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 7 AS DOUBLE) END AS samples"


def rum_rows(spark, sf):
    return inputs.table(spark, sf, "events").selectExpr(*inputs._split(RUMROWS))


@query("F12_rum_summary", f"SELECT site_id, metric, count(*) AS n_rows, sum(samples) AS samples, quantile_disc(p75, 0.75) AS p75 FROM (SELECT {RUMROWS} FROM events) GROUP BY 1, 2")
def f12(spark, sf):
    return fd.rum_summary(rum_rows(spark, sf), KEY)


@query("F12_rum_worst", f"SELECT site_id, metric, p75, rank FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY CASE WHEN metric = 'CLS' THEN p75 * 10000 ELSE p75 END DESC, metric, p75, samples NULLS FIRST, row_id) AS rank FROM (SELECT {RUMROWS} FROM events)) WHERE rank <= 8")
def f12b(spark, sf):
    return fd.rum_worst(rum_rows(spark, sf), KEY).select("site_id", "metric", "p75", F.col("rank").cast("long").alias("rank"))


POS = "floor(sum(position * impressions)::DOUBLE / nullif(sum(impressions), 0) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE"


@query("F13_search_totals", o.with_([SR], f"SELECT site_id, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, floor(sum(clicks)::DOUBLE / nullif(sum(impressions), 0) * 10000.0::DOUBLE + 0.5) / 10000.0::DOUBLE AS average_ctr, {POS} AS average_position FROM sr GROUP BY 1"))
def f13(spark, sf):
    return fd.search_summary(search_rows(spark, sf), KEY)


def top(by):
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY clicks DESC, impressions DESC, {by}) AS rank FROM (SELECT site_id, {by}, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, {POS} AS position FROM sr GROUP BY 1, 2)) WHERE rank <= 10"


@query("F14_search_top_pages", o.with_([SR], top("page")))
def f14(spark, sf):
    return fd.search_top(search_rows(spark, sf), KEY, "page").withColumn("rank", F.col("rank").cast("long"))


@query("F14_search_top_queries", o.with_([SR], top("query")))
def f14b(spark, sf):
    return fd.search_top(search_rows(spark, sf), KEY, "query").withColumn("rank", F.col("rank").cast("long"))


# URL inspections and field records: one per order.
INSP_SQL = "'https://c' || CAST(o_custkey % 80 AS STRING) || '.example' AS site_id, 'https://c' || CAST(o_custkey % 80 AS STRING) || '.example/o/' || CAST(o_orderkey AS STRING) AS url, o_orderkey, o_orderstatus, o_orderpriority"


def inspection_raw(spark, sf):
    rows = inputs.table(spark, sf, "orders").selectExpr(*inputs._split(INSP_SQL))
    c = F.col
    verdict = F.when(c("o_orderpriority") == "1-URGENT", "PASS").otherwise("NEUTRAL")
    state = F.when(c("o_orderpriority") == "2-HIGH", "Submitted and indexed").when(c("o_orderpriority") == "3-MEDIUM", "Indexedness unknown").otherwise("Crawled - currently not indexed")
    refs = F.when(c("o_orderkey") % 2 == 0, F.array(c("site_id")))
    index = F.when(c("o_orderkey") % 7 != 0, F.struct(verdict.alias("verdict"), state.alias("coverage_state"), refs.alias("referring_urls")))
    return rows.select("site_id", "url", F.when(c("o_orderstatus") != "P", F.struct(index.alias("index_status"))).alias("result"))


INSP = f"""insp AS (SELECT site_id, url, CASE WHEN o_orderstatus <> 'P' THEN 'ok' ELSE 'failed' END AS status, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 7 <> 0 THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'PASS' ELSE 'NEUTRAL' END END AS verdict,
 CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 7 <> 0 THEN CASE o_orderpriority WHEN '2-HIGH' THEN 'Submitted and indexed' WHEN '3-MEDIUM' THEN 'Indexedness unknown' ELSE 'Crawled - currently not indexed' END END AS coverage_state, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 7 <> 0 AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n_refs, o_orderstatus <> 'P' AND o_orderkey % 7 <> 0 AS raw_available FROM (SELECT {INSP_SQL} FROM orders))"""


@query("S9_url_inspections", o.with_([INSP], "SELECT * FROM insp"))
def s9(spark, sf):
    rows = fd.inspections(inspection_raw(spark, sf))
    return rows.select("site_id", "url", "status", "verdict", "coverage_state", F.size("referring_urls").alias("n_refs"), "raw_available")


@query("F15_indexed_counts", o.with_([INSP], "SELECT site_id, count(*) FILTER (status = 'ok' AND (verdict = 'PASS' OR coverage_state = 'Submitted and indexed')) AS indexed, count(*) FILTER (status = 'ok') - count(*) FILTER (status = 'ok' AND (verdict = 'PASS' OR coverage_state = 'Submitted and indexed')) AS not_indexed FROM insp GROUP BY 1"))
def f15(spark, sf):
    return fd.indexed_counts(fd.inspections(inspection_raw(spark, sf)), KEY)


CRUX_SQL = "'https://c' || CAST(o_custkey % 80 AS STRING) || '.example' AS site_id, o_orderkey AS ord, CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'not_found' ELSE 'failed' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'url' ELSE 'origin' END AS scope, CASE o_orderkey % 4 WHEN 0 THEN 'PHONE' WHEN 1 THEN 'DESKTOP' ELSE 'ALL' END AS form_factor, floor(o_totalprice / 100) AS p, o_orderkey"


def crux_records(spark, sf):
    rows = inputs.table(spark, sf, "orders").selectExpr(*inputs._split(CRUX_SQL))
    c = F.col
    bin_ = lambda d: F.struct(F.lit(d).alias("density"))
    hist = F.when(c("o_orderkey") % 5 != 0, F.array(bin_(0.75), bin_(0.15), bin_(0.1))).otherwise(F.array(bin_(0.5)))
    entry = lambda v: F.struct(v.cast("string").alias("p75"), hist.alias("histogram"))
    metrics_ = F.create_map(
        F.lit("largest_contentful_paint"), entry(c("p").cast("long")),
        F.lit("cumulative_layout_shift"), entry(F.when(c("o_orderkey") % 2 == 0, F.lit("0.25")).otherwise("NaN")),
        F.lit("unknown_metric"), entry(F.lit("1")),
    )
    return rows.select("site_id", "ord", "status", "scope", "form_factor", metrics_.alias("metrics"))


CRUX = f"""cr AS (SELECT {CRUX_SQL} FROM orders),
cm AS (SELECT site_id, ord, status, scope, form_factor, o_orderkey, 'largest_contentful_paint' AS metric, p::DOUBLE AS p75, 'ms' AS unit FROM cr UNION ALL SELECT site_id, ord, status, scope, form_factor, o_orderkey, 'cumulative_layout_shift', CASE WHEN o_orderkey % 2 = 0 THEN 0.25::DOUBLE END, 'score' FROM cr)"""
CK = ["site_id", "ord", "scope", "form_factor"]


@query("S10_field_metrics", o.with_([CRUX], "SELECT site_id, ord, scope, form_factor, metric, p75, unit, CASE WHEN o_orderkey % 5 <> 0 THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END AS good, CASE WHEN o_orderkey % 5 <> 0 THEN 0.15::DOUBLE END AS needs_improvement, CASE WHEN o_orderkey % 5 <> 0 THEN 0.1::DOUBLE END AS poor FROM cm"))
def s10(spark, sf):
    return fd.crux_metrics(crux_records(spark, sf), CK)


@query("S11_field_eav", o.with_([CRUX], "SELECT site_id, ord, metric, p75 AS value FROM cm WHERE p75 IS NOT NULL UNION ALL SELECT site_id, ord, 'unknown_metric', 1.0::DOUBLE FROM cr"))
def s11(spark, sf):
    return fd.crux_eav(crux_records(spark, sf), ["site_id", "ord"])


HIST_SQL = "o_custkey, o_orderkey AS ord, o_totalprice, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofmonth(o_orderdate) AS d"


@query("S12_field_history", """SELECT o_orderkey AS ord, CASE i WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN CAST(year(o_orderdate) + 1 AS VARCHAR) || strftime(o_orderdate, '-%m-%d') ELSE 'period-2' END ELSE 'period-3' END AS date, 'largest_contentful_paint' AS metric, CASE i WHEN 1 THEN floor(o_totalprice) WHEN 2 THEN floor(o_totalprice) + 1 END AS p75 FROM orders, unnest([1, 2, 3]) t(i)""")
def s12(spark, sf):
    rows = inputs.table(spark, sf, "orders").selectExpr(*inputs._split(HIST_SQL))
    c = F.col
    day = lambda y: F.struct(y.cast("int").alias("year"), c("m").cast("int").alias("month"), c("d").cast("int").alias("day"))
    none = F.lit(None).cast("struct<year:int,month:int,day:int>")
    rec = rows.select(
        "ord",
        F.lit("largest_contentful_paint").alias("metric"),
        F.array(day(c("y")), F.when(c("ord") % 2 == 0, day(c("y") + 1)).otherwise(none)).alias("periods"),
        F.array(F.floor("o_totalprice").cast("string"), (F.floor("o_totalprice") + 1).cast("string"), F.lit("n/a")).alias("p75s"),
    )
    return fd.crux_history(rec, ["ord"])


@query("F16_field_summary", o.with_([CRUX], """SELECT * FROM (SELECT site_id, count(*) FILTER (status = 'ok') AS records_ok, count(*) FILTER (status = 'not_found') AS records_not_found, count(*) FILTER (status = 'failed') AS records_failed FROM cr GROUP BY 1) LEFT JOIN (SELECT site_id, arg_min(p75, ord) FILTER (metric = 'largest_contentful_paint') AS largest_contentful_paint, arg_min(p75, ord) FILTER (metric = 'cumulative_layout_shift' AND p75 IS NOT NULL) AS cumulative_layout_shift
 FROM cm WHERE scope = 'origin' AND form_factor = 'ALL' GROUP BY 1) USING (site_id)"""))
def f16(spark, sf):
    recs = crux_records(spark, sf)
    out = fd.crux_summary(recs, fd.crux_metrics(recs, CK), KEY)
    return out.select("site_id", "records_ok", "records_not_found", "records_failed", "largest_contentful_paint", "cumulative_layout_shift")


PROV = "prov AS (SELECT site_id, form_factor, CASE WHEN count(*) FILTER (status = 'ok') = count(*) THEN 'ok' WHEN count(*) FILTER (status = 'ok') > 0 THEN 'partial' WHEN count(*) FILTER (status = 'not_found') = count(*) THEN 'unavailable' ELSE 'failed' END AS provider_status FROM cr GROUP BY 1, 2)"


@query("F17_provider_status", o.with_([CRUX, PROV], "SELECT site_id, CASE WHEN count(*) FILTER (provider_status = 'ok') = count(*) THEN 'ok' WHEN count(*) FILTER (provider_status IN ('ok', 'partial')) > 0 THEN 'partial' WHEN count(*) FILTER (provider_status = 'unavailable') = count(*) THEN 'unavailable' ELSE 'failed' END AS status FROM prov GROUP BY 1"))
def f17(spark, sf):
    return fd.merged_status(fd.record_status(crux_records(spark, sf), ["site_id", "form_factor"]), KEY)


@query("F18_coverage_flags", f"SELECT site_id, " + ", ".join(f"bool_or(metric = '{v}') AS has_{v.lower()}" for v in fd.VITALS) + ", " + ", ".join(f"max(CASE WHEN metric = '{v}' THEN p75 END) AS {v.lower()}_p75" for v in fd.VITALS[:3]) + f", sum(samples) AS samples FROM (SELECT {RUMROWS} FROM events) GROUP BY 1")
def f18(spark, sf):
    return fd.coverage_flags(rum_rows(spark, sf), KEY)


@query("F19_url_sample", o.with_([FETCH], "SELECT site_id, url FROM (SELECT site_id, url, row_number() OVER (PARTITION BY site_id ORDER BY min(event_id), url) AS rank FROM fetched GROUP BY 1, 2) WHERE rank <= 3"))
def f19(spark, sf):
    pages = fetch_log(spark, sf).select("site_id", F.col("url").alias("final_url"), F.col("event_id").alias("ord"))
    return fd.sample_urls(pages, KEY, 3).select("site_id", F.col("final_url").alias("url"))


@query("F20_date_window", "SELECT event_id, strftime(CAST(ts AS DATE) - 30, '%Y-%m-%d') AS start_date, strftime(CAST(ts AS DATE) - 3, '%Y-%m-%d') AS end_date FROM events")
def f20(spark, sf):
    start, end = fd.date_window(F.to_date("ts"))
    iso = lambda d: F.date_format(d, "yyyy-MM-dd")
    return inputs.table(spark, sf, "events").select("event_id", iso(start).alias("start_date"), iso(end).alias("end_date"))


@query("F21_metric_deltas", o.with_([RES, TOTALS, METRICS, "b AS (SELECT * FROM met WHERE length(site_id) % 2 = 0 OR metric_id <> 'total-css-kb')"], "SELECT m.site_id, m.metric_id, m.value + 1 - b.value AS delta FROM met m JOIN b USING (site_id, metric_id) WHERE m.value IS NOT NULL AND b.value IS NOT NULL"))
def f21(spark, sf):
    m = metrics(spark, sf)
    before = m.filter((F.length("site_id") % 2 == 0) | (F.col("metric_id") != "total-css-kb"))
    return pf.metric_deltas(before, m.withColumn("value", F.col("value") + 1), KEY).select("site_id", "metric_id", "delta")


REND_SQL = f"{_SITE} AS site_id, event_id, event_type, value"
MARKS = {"view": "nextData", "click": "svelteKitAssets", "purchase": "astroIsland", "signup": "viteModuleGraph"}


def rendered(spark, sf):
    rows = inputs.table(spark, sf, "events").selectExpr(*inputs._split(REND_SQL))
    c = F.col
    marks = F.create_map(*[x for e, k in MARKS.items() for x in (F.lit(k), c("event_type") == e)])
    return rows.select(
        "site_id", "event_id", "event_type", marks.alias("markers"), (c("event_id") % 3).alias("console_errors"), (c("event_id") % 2).alias("failed_requests"),
        F.when(c("event_id") % 4 == 0, c("value")).alias("lcp_ms"), F.when(c("event_id") % 5 == 0, c("value")).alias("cls"), (c("event_id") % 7 == 0).alias("hydration_risk"),
        pf.runtime_names(marks, pf.FRAMEWORK_MARKERS).alias("frameworks"), pf.runtime_names(marks, pf.BUNDLER_MARKERS).alias("bundlers"),
    )


FW = "CASE event_type WHEN 'view' THEN 'nextjs' WHEN 'click' THEN 'sveltekit' WHEN 'purchase' THEN 'astro' END"


@query("F22_browser_rollup", f"SELECT site_id, count(*) AS pages_visited, CAST(sum(event_id % 3) AS BIGINT) AS console_errors, CAST(sum(event_id % 2) AS BIGINT) AS failed_requests, count(*) FILTER (event_id % 4 = 0) AS lcp_coverage, count(*) FILTER (event_id % 5 = 0) AS cls_coverage, count(*) FILTER (event_id % 7 = 0) AS hydration_risk_pages, string_agg(DISTINCT {FW}, ',' ORDER BY {FW}) AS frameworks FROM (SELECT {REND_SQL} FROM events) GROUP BY 1")
def f22(spark, sf):
    return pf.browser_rollup(rendered(spark, sf), KEY)


@query("I14_runtime_frameworks", f"SELECT event_id, coalesce({FW}, '') AS frameworks, CASE WHEN event_type IN ('click', 'signup') THEN 'vite' ELSE '' END AS bundlers FROM events")
def i14(spark, sf):
    return rendered(spark, sf).select("event_id", F.array_join("frameworks", ",").alias("frameworks"), F.array_join("bundlers", ",").alias("bundlers"))


@query("F23_run_labels", o.with_([FETCH], "SELECT event_id, run, CASE run WHEN 1 THEN 'crawl' WHEN 2 THEN 'cold' ELSE 'warm' END AS profile FROM (SELECT event_id, row_number() OVER (PARTITION BY site_id, url ORDER BY started_at, event_id) AS run FROM fetched)"))
def f23(spark, sf):
    return pf.label_runs(fetch_log(spark, sf), KEY).select("event_id", F.col("run").cast("long").alias("run"), "profile")


@query("S6_metric_file", "SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN event_type END AS metric, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN event_id::DOUBLE WHEN 2 THEN NULL ELSE NULL END AS value FROM events WHERE event_id % 9 <> 0 AND event_id % 4 < 2")
def s6(spark, sf):
    c = F.col
    raw = inputs.table(spark, sf, "events").select(
        "event_id", F.when(c("event_id") % 9 != 0, c("event_type")).alias("metric"),
        F.when(c("event_id") % 4 == 0, c("value").cast("string")).when(c("event_id") % 4 == 1, c("event_id").cast("string")).when(c("event_id") % 4 == 2, "n/a").otherwise("NaN").alias("value"),
    )
    return fd.metric_rows(raw)


S7_SQL = "o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'https://x.example/' || CAST(o_custkey AS STRING) ELSE '' END AS k1, 'q' || o_orderpriority AS k2"


@query("S7_search_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'https://x.example/' || CAST(o_custkey AS VARCHAR) END AS page, CASE WHEN o_orderkey % 3 < 2 THEN 'q' || o_orderpriority END AS query, NULL::VARCHAR AS device, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey ELSE 0 END AS clicks, o_custkey AS impressions FROM orders")
def s7(spark, sf):
    rows = inputs.table(spark, sf, "orders").selectExpr(*inputs._split(S7_SQL), "o_custkey")
    c = F.col
    raw = rows.select(
        "o_orderkey", F.when(c("o_orderkey") % 3 < 2, F.array("k1", "k2")).otherwise(F.array("k1")).alias("keys"),
        F.when(c("o_orderkey") % 5 > 0, c("o_orderkey")).alias("clicks"), c("o_custkey").alias("impressions"),
        F.lit(None).cast("double").alias("ctr"), F.lit(1.5).alias("position"),
    )
    return fd.search_row(raw).select("o_orderkey", "page", "query", "device", "clicks", "impressions")


@query("S8_search_metrics", o.with_([SR], "SELECT site_id, url, metric, dims, count(*) AS n, sum(value) AS total FROM (SELECT site_id, page AS url, unnest(['clicks', 'impressions', 'ctr', 'position']) AS metric, unnest([clicks, impressions, 0, position])::DOUBLE AS value, 'query=' || query AS dims FROM sr) GROUP BY 1, 2, 3, 4"))
def s8(spark, sf):
    rows = search_rows(spark, sf).withColumns({"ctr": F.lit(0.0), "device": F.lit(""), "country": F.lit(None).cast("string")})
    long = fd.search_totals(rows, KEY)
    dims_ = F.array_join(F.transform(F.map_entries("dimensions"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return long.select("site_id", "url", "metric", dims_.alias("dims"), "n", "total")
