"""Evidence rows and their ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions.numeric import lookup
from auditlake.operators import rules

SITE = ["site_id", "run_id"]


def id_part(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]+", "-")


def page_evidence(findings: DataFrame) -> DataFrame:
    """One evidence row per page finding; the id names the page (48 characters and a hash of the whole URL) and the rule."""
    key = F.concat_ws("-", F.substring(id_part(F.col("affected_url")), 1, 48), F.substring(F.md5("affected_url"), 1, 16), F.lower("rule_id"))
    return findings.select(
        *SITE, "page_id", "rule_id", key.alias("evidence_id"), F.lit("html_selector").alias("type"),
        F.col("affected_url").alias("url"),
    )


def endpoint_evidence(endpoints: DataFrame, excerpt: int = 500) -> DataFrame:
    """One evidence row per probe; ids are numbered by the probe's place in the fixed path list."""
    return endpoints.select(
        *SITE,
        F.concat(F.lit("endpoint"), id_part(F.col("path"))).alias("evidence_id"),
        F.lit("http_status").alias("type"),
        "url",
        "status",
        F.substring("body", 1, excerpt).alias("excerpt"),
    )


def cross_page_evidence(groups: DataFrame) -> DataFrame:
    """One evidence row per duplicate group, from groups with their representative."""
    return groups.select(
        *SITE,
        F.concat(F.lit("cross-page-"), F.lower("rule_id"), F.lit("-"), F.substring("key_hash", 1, 12)).alias("evidence_id"),
        F.lit("html_selector").alias("type"),
        F.col("first_url").alias("url"),
        F.col("n_pages").cast("string").alias("value"),
    )


# --- content-addressed evidence ---------------------------------------------------------------------------------
# Columns of an evidence row. ``subject`` is what a finding looks its evidence up by: a path, a rule or a metric.
EVIDENCE = [*SITE, "evidence_id", "kind", "type", "url", "subject", "status", "value", "excerpt"]

# Probed path that each site rule reads; fixed values. Sitemap rules read the first sitemap that answered.
RULE_PATHS = {
    "SEO-CRAWL-001": "/robots.txt", "SEO-CRAWL-003": "/robots.txt", "SEO-CRAWL-004": "/robots.txt",
    "AR-ROBOTS-004": "/robots.txt", "AR-ROBOTS-006": "/robots.txt",
    "SEO-SITEMAP-001": "/sitemap.xml", "SEO-SITEMAP-011": "/sitemap.xml",
    "AR-LLMS-001": "/llms.txt", "AR-LLMS-003": "/llms.txt", "AR-LLMS-008": "/llms.txt", "AR-MD-001": "/",
    "AR-SKILL-001": "/.well-known/agent-skills/index.json", "AR-SKILL-002": "/.well-known/agent-skills/index.json",
    "AR-MCP-001": "/.well-known/mcp.json", "AR-MCP-002": "/.well-known/mcp.json", "AR-MCP-005": "/.well-known/mcp.json",
    "AR-API-001": "/.well-known/api-catalog", "AR-API-002": "/.well-known/api-catalog", "AR-API-003": "/openapi.json",
    "AR-AUTH-001": "/auth.md", "AR-AUTH-002": "/.well-known/oauth-authorization-server",
    "AR-AUTH-003": "/.well-known/oauth-protected-resource", "SEO-SEARCH-001": "/", "SEO-SEARCH-002": "/",
}
RULE_METRICS = {
    "SEO-PERF-001": "lcp-ms", "SEO-PERF-024": "document-fetch-ms", "SEO-PERF-020": "total-js-kb",
    "SEO-PERF-021": "third-party-js-kb", "SEO-PERF-022": "render-blocking-requests", "SEO-PERF-023": "total-requests",
}
OPEN_SITEMAP_RULES = ["SEO-SITEMAP-002", "SEO-SITEMAP-008"]
GRAPH_RULES = {"SEO-INTL-001": "hreflang-coverage", "SEO-LINK-009": "crawl-graph"}


def content_id(kind: Column, *content: Column) -> Column:
    """Kind and 24 hex digits of a digest of the row's content, each part with its length, ``-`` for null. Equal content has
    equal ids in every run, layout and order, and no counter has to run over the rows."""
    parts = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in content]
    return F.concat(kind, F.lit("-"), F.substring(F.sha2(F.encode(F.concat(*parts), "UTF-8"), 256), 1, 24))


def _row(kind: str, type_: str, url: Column, *, subject: Column | None = None, status: Column | None = None, value: Column | None = None, excerpt: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(kind).alias("kind"), F.lit(type_).alias("type"), url.alias("url"), (none if subject is None else subject).alias("subject"),
        (F.lit(None) if status is None else status).cast("int").alias("status"), (none if value is None else value).alias("value"),
        (none if excerpt is None else excerpt).alias("excerpt"),
    )


def _id() -> Column:
    """Id of the struct ``e`` with its run and, where one exists, its place (``at``)."""
    e = lambda name: F.col("e")[name]
    content = [F.col("site_id"), F.col("run_id"), F.col("at"), *[e(c).cast("string") for c in EVIDENCE[4:]]]
    return content_id(e("kind"), *content)


def _with_ids(rows: DataFrame) -> DataFrame:
    """Evidence rows from frames with SITE, ``at`` and ``e``."""
    return rows.select(*SITE, _id().alias("evidence_id"), *[F.col("e")[c].alias(c) for c in EVIDENCE[3:]])


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def page_rows(prepared: DataFrame) -> DataFrame:
    """Status, title, description and body of every page and one row per distinct finding of it: one narrow stage.

    ``prepared`` is what the page rules read (``rules.prepare_pages``). A rule that fires on many blocks of a page with
    one title gives one row."""
    c = F.col
    found = F.array_distinct(
        F.transform(F.flatten(F.array(*rules.page_rule_structs())), lambda f: _row("finding", "html_selector", c("final_url"), subject=f["rule_id"], value=f["title"]))
    )
    fixed = F.array(
        _row("page-status", "http_status", c("final_url"), status=c("status"), value=_json(contentType=c("content_type"))),
        _row("page-title", "html_selector", c("final_url"), subject=F.lit("title"), value=c("title")),
        _row("page-meta", "html_selector", c("final_url"), subject=F.lit("meta[name=description]"), value=c("meta_description")),
        _row("page-body", "body_excerpt", c("final_url"), value=_json(wordCount=c("word_count")), excerpt=c("body_excerpt")),
    )
    return _with_ids(prepared.select(*SITE, c("page_id").cast("string").alias("at"), F.explode(F.concat(fixed, found)).alias("e")))


def endpoint_rows(runs: DataFrame, endpoints: DataFrame, excerpt: int = 500) -> DataFrame:
    """One row per probe, and one with status 0 for each expected path that a run never probed. A path probed twice in a
    run is kept once per distinct answer."""
    c, none = F.col, F.lit(None).cast("string")
    probed = _row(
        "endpoint", "http_status", c("url"), subject=c("path"), status=c("status"),
        value=_json(path=c("path"), ok=c("ok"), contentType=c("content_type")), excerpt=F.substring("body", 1, excerpt),
    )
    expected = runs.select(*SITE, F.explode(F.array(*[F.lit(p) for p in (dims.MARKDOWN_PROBE, *dims.ENDPOINT_PATHS)])).alias("path"))
    absent = expected.join(endpoints.select(*SITE, "path").distinct(), [*SITE, "path"], "left_anti").select(
        *SITE, none.alias("at"),
        _row("missing", "http_status", F.concat("site_id", "path"), subject=c("path"), status=F.lit(0), value=_json(path=c("path"), ok=F.lit(False))).alias("e"),
    )
    return _with_ids(endpoints.select(*SITE, none.alias("at"), probed.alias("e")).distinct()).unionByName(_with_ids(absent))


def cross_page_rows(groups: DataFrame, rollup: DataFrame) -> DataFrame:
    """One row per duplicate group (from groups with their first URL) and the two counts over the pages of a run."""
    c, none = F.col, F.lit(None).cast("string")
    dup = _row("cross-page", "html_selector", c("first_url"), subject=F.concat_ws(":", "rule_id", "key_hash"), value=c("n_pages").cast("string"))
    spread = F.array(
        _row("cross-page", "html_selector", none, subject=F.lit("hreflang-coverage"), value=_json(withAlternates=c("n_hreflang"), without=c("n_no_hreflang"))),
        _row("cross-page", "crawl_graph", none, subject=F.lit("crawl-graph"), value=_json(pages=c("n_pages"), hubs=c("n_hubs"))),
    )
    of_groups = _with_ids(groups.select(*SITE, none.alias("at"), dup.alias("e")))
    return of_groups.unionByName(_with_ids(rollup.select(*SITE, none.alias("at"), F.explode(spread).alias("e"))))


def metric_rows(failed_metrics: DataFrame) -> DataFrame:
    """One row per metric over budget of a run."""
    rows = failed_metrics.select(*SITE, F.explode(F.array_distinct("failed_metrics")).alias("metric"))
    none = F.lit(None).cast("string")
    return _with_ids(rows.select(*SITE, none.alias("at"), _row("performance", "performance_metric", none, subject=F.col("metric")).alias("e")))


def site_subject(sitemap_path: Column) -> Column:
    """What a site rule's evidence is filed under; ``sitemap_path`` is the first sitemap that answered."""
    fixed = {**RULE_PATHS, **RULE_METRICS, **GRAPH_RULES}
    return F.when(F.col("rule_id").isin(OPEN_SITEMAP_RULES), sitemap_path).otherwise(lookup(F.col("rule_id"), fixed))


def citations(evidence: DataFrame, page_findings: DataFrame, groups: DataFrame, site_findings: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(site_id, run_id, rule_id, place, evidence_id): what every finding cites.

    A page finding's id follows from its own row, without a join. Group and site findings are few per run and look their
    evidence up by subject; one whose evidence is gone cites the subject itself, which then dangles."""
    c = F.col
    row = _row("finding", "html_selector", c("affected_url"), subject=c("rule_id"), value=c("title"))
    own = page_findings.select(*SITE, "rule_id", c("page_id").cast("string").alias("at"), row.alias("e")).select(
        *SITE, "rule_id", c("at").alias("place"), _id().alias("evidence_id")
    )
    grouped = groups.select(*SITE, "rule_id", c("key_hash").alias("place"), F.concat_ws(":", "rule_id", "key_hash").alias("subject"))
    answered = endpoints.filter("ok AND path IN ('/sitemap.xml', '/sitemap_index.xml')").groupBy(*SITE).agg(F.min("path").alias("first_map"))
    first_map = F.coalesce("first_map", F.lit("/sitemap.xml"))
    sites = site_findings.join(answered, SITE, "left").select(*SITE, "rule_id", F.lit("").alias("place"), site_subject(first_map).alias("subject"))
    filed = evidence.filter(c("kind").isin("endpoint", "missing", "cross-page", "performance")).select(*SITE, "subject", "evidence_id")
    looked = grouped.unionByName(sites).join(filed, [*SITE, "subject"], "left")
    rest = looked.select(*SITE, "rule_id", "place", F.coalesce("evidence_id", F.concat(F.lit("none-"), "subject")).alias("evidence_id"))
    return own.unionByName(rest)


def evidence_references(cited: DataFrame, evidence: DataFrame) -> DataFrame:
    """Both directions of the reference graph in one aggregation: each id of either side with its number of citations and
    whether it is used, unused or dangling. Counts are combined before the shuffle, so an id that a third of all findings
    cites is one row per task."""
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    sides = cited.select(*SITE, "evidence_id", one.alias("c"), zero.alias("k")).unionByName(evidence.select(*SITE, "evidence_id", zero.alias("c"), one.alias("k")))
    ids = sides.groupBy(*SITE, "evidence_id").agg(F.sum("c").alias("n_citations"), F.max("k").alias("known"))
    state = F.when(F.col("known") == 0, "dangling").when(F.col("n_citations") == 0, "unused").otherwise("used")
    return ids.select(*SITE, "evidence_id", "n_citations", state.alias("state"))
