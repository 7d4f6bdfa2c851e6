"""Queries over the rule evaluation of whole page tables and site intelligence."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions import privacy_patterns as pat
from auditlake.operators import discovery as d
from auditlake.operators import intel as it
from auditlake.operators import pages as p
from auditlake.operators import rules as r
from auditlake.operators import runfacts as rf
from auditlake.plans import inputs
from auditlake.plans import oracle as o
from auditlake.plans.q_pages import RES, snapshots
from auditlake.plans.q_sites import LABEL, VAR, variants
from auditlake.plans.registry import query
from auditlake.session import materialise

KINDS = " ".join(f"WHEN bool_or(regexp_matches(t, {o.q(pattern)})) THEN '{name}'" for name, pattern in it.SITE_TYPES)
STYPE = f"stype AS (SELECT site_id, CASE {KINDS} ELSE 'content' END AS site_type FROM (SELECT site_id, lower(final_url || chr(10) || body_text || chr(10) || array_to_string(types, ' ')) AS t FROM snap) GROUP BY site_id)"
HAS = lambda t: f"list_contains(types, '{t}')"
BODY_KEY = "lower(trim(body_text))"
LDKEY = "EXISTS (SELECT 1 FROM ld WHERE ld.page_id = s.page_id AND NOT bad AND contains(raw, '\"openingHours\"'))"
_ADDRESS = "regexp_matches(lower(body_text), 'street|st\\.|road|avenue|suite|address')"
_DIGITS = "length(regexp_replace(body_text, '[^0-9]', '', 'g')) >= 7"
PAGE_RULES = {
    "SEO-TECH-002": "n_hops > 2",
    "SEO-TECH-001": "status < 200 OR status >= 400",
    "SEO-PERF-010": "cache_control = ''",
    "SEO-PERF-011": "content_encoding = '' AND length(body_text) > 500",
    "SEO-INDEX-001": "coalesce(regexp_matches(robots_meta, '(?i)noindex'), false)",
    "SEO-INDEX-003": "canonical IS NULL",
    "SEO-INDEX-004": f"canonical IS NOT NULL AND {o.canon('canonical')} <> {o.canon('final_url')}",
    "SEO-ONPAGE-001": "title IS NULL",
    "SEO-ONPAGE-003": "length(title) < 15",
    "SEO-ONPAGE-004": "length(title) > 70",
    "SEO-ONPAGE-005": "meta_description IS NULL",
    "SEO-ONPAGE-007": "n_h1 = 0",
    "SEO-ONPAGE-008": "n_h1 > 1",
    "SEO-ONPAGE-009": "EXISTS (SELECT 1 FROM (SELECT page_id, level, lag(level) OVER (PARTITION BY page_id ORDER BY ord) AS prev FROM heads WHERE text <> '') j WHERE j.page_id = s.page_id AND level > prev + 1)",
    "SEO-ONPAGE-010": "lang IS NULL",
    "SEO-ONPAGE-011": "viewport IS NULL",
    "SEO-ONPAGE-014": "n_og = 0",
    "SEO-ONPAGE-015": "n_tw = 0",
    "SEO-CONTENT-001": "word_count > 0 AND word_count < 150",
    "SEO-SCHEMA-001": "n_bad > 0",
    "SEO-SCHEMA-003": f"NOT {HAS('Organization')}",
    "SEO-SCHEMA-004": f"NOT {HAS('WebSite')}",
    "SEO-SCHEMA-006": f"n_int > 2 AND NOT {HAS('BreadcrumbList')}",
    "SEO-JS-001": "word_count < 30 AND n_int = 0",
    "SEO-LINK-003": "word_count >= 30 AND n_int = 0",
    "SEO-MEDIA-001": "n_noalt > 0",
    "SEO-MEDIA-005": "n_nodim > 0",
    "SEO-A11Y-010": "NOT skip AND n_heads > 2",
    "SEO-INTL-005": "n_hre > 0 AND NOT xdef",
    "SEO-LOCAL-001": f"site_type = 'local-business' AND NOT ({_ADDRESS} AND {_DIGITS})",
    "SEO-LOCAL-003": f"site_type = 'local-business' AND NOT {HAS('LocalBusiness')}",
    "SEO-LOCAL-004": f"site_type = 'local-business' AND NOT {LDKEY} AND NOT regexp_matches(body_text, '(?i)\\b(?:open|hours|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\\b')",
    "SEO-ECOM-001": f"site_type = 'commerce' AND NOT {HAS('Product')}",
    "SEO-ECOM-002": f"site_type = 'commerce' AND NOT {HAS('Offer')}",
    "SEO-ECOM-013": "site_type = 'commerce' AND NOT regexp_matches(body_text, '(?i)\\breturn(?:s| policy)?\\b')",
}
_LIST = ", ".join(f"CASE WHEN {cond} THEN '{rule}' END" for rule, cond in PAGE_RULES.items())
_TITLES = "ttl(rule_id, title, severity) AS (VALUES " + dims.values_sql([(x["rule_id"], x["title"], x["severity"]) for x in dims.EMITTED]) + ")"
PF = f"""{_TITLES},
pf AS (SELECT page_id, site_id, final_url AS affected_url, rule_id, CASE WHEN rule_id = 'SEO-TECH-001' THEN title || ' ' || CAST(status AS VARCHAR) ELSE title END AS title,
 CASE WHEN rule_id = 'SEO-TECH-001' AND status < 500 THEN 'high' ELSE severity END AS severity FROM (SELECT page_id, site_id, final_url, status, unnest([{_LIST}]) AS rule_id FROM snap s JOIN stype USING (site_id)) JOIN ttl USING (rule_id) WHERE rule_id IS NOT NULL)"""


def silver(spark, sf):
    """Snapshots written once; page, group and site rules all read the written table."""
    return materialise(p.with_json_ld_types(snapshots(spark, sf)), "snapshots")


def prepared(spark, sf):
    s = silver(spark, sf)
    return r.prepare_pages(s, materialise(it.site_types(s), "site-types"))


@query("R_page_rule_findings", o.with_([*o.PAGE_CTES, STYPE, PF], "SELECT * FROM pf"))
def page_rules(spark, sf):
    return r.page_rule_findings(prepared(spark, sf)).select("page_id", "site_id", "affected_url", "rule_id", "title", "severity")


@query("R_page_rule_counts", o.with_([*o.PAGE_CTES, STYPE, PF], "SELECT site_id, rule_id, count(*) AS n_findings FROM pf GROUP BY 1, 2"))
def page_rule_counts(spark, sf):
    return r.page_rule_counts(prepared(spark, sf)).select("site_id", "rule_id", "n_findings")


DUP = f"""dk AS (SELECT site_id, page_id, final_url, 'SEO-ONPAGE-002' AS rule_id, lower(trim(title)) AS k FROM snap UNION ALL SELECT site_id, page_id, final_url, 'SEO-ONPAGE-006', lower(trim(meta_description)) FROM snap
 UNION ALL SELECT site_id, page_id, final_url, 'SEO-CONTENT-002', {BODY_KEY} FROM snap WHERE word_count >= 80)"""


def whole_table(df):
    """One site for the whole table, so that groups reach across hosts."""
    return df.withColumn("site_id", F.lit("all"))


@query("R1_duplicate_groups", o.with_([*o.PAGE_CTES, DUP], "SELECT rule_id, sha256(k) AS key_hash, count(*) AS n_pages, arg_min(final_url, page_id) AS first_url FROM dk WHERE k IS NOT NULL AND k <> '' GROUP BY 1, 2 HAVING count(*) > 1"))
def r1(spark, sf):
    keys = materialise(r.duplicate_keys(whole_table(snapshots(spark, sf))), "duplicate-keys")
    groups = r.group_representatives(keys, r.duplicate_groups(keys))
    return groups.select("rule_id", "key_hash", "n_pages", "first_url")


@query("R_group_rule_findings", o.with_([*o.PAGE_CTES, DUP, _TITLES], "SELECT site_id, rule_id, title, severity, n_urls FROM (SELECT site_id, rule_id, k, count(*) AS n_urls FROM dk WHERE k <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1) JOIN ttl USING (rule_id)"))
def group_rules(spark, sf):
    return r.group_rule_findings(r.duplicate_groups(r.duplicate_keys(snapshots(spark, sf)))).select("site_id", "rule_id", "title", "severity", "n_urls")


@query("R_duplicate_members", o.with_([*o.PAGE_CTES, DUP], "SELECT rule_id, final_url AS affected_url, n FROM (SELECT *, count(*) OVER (PARTITION BY rule_id, k) AS n FROM dk WHERE k <> '') WHERE n > 1"))
def duplicate_members(spark, sf):
    keys = materialise(r.duplicate_keys(whole_table(snapshots(spark, sf))), "duplicate-keys")
    groups = r.duplicate_groups(keys)
    members = r.duplicate_members(keys, groups)
    sizes = groups.select("rule_id", "key_hash", F.col("n_pages").alias("n"))
    return members.join(sizes, ["rule_id", "key_hash"]).select("rule_id", "affected_url", "n")


_LOCS = lambda body: f"trim(replace(unnest(regexp_extract_all({body}, '<loc>(.*?)</loc>', 1)), '&amp;', '&'))"
# Sitemaps that count: the first probed one that answered, those that robots.txt names, and the children of indexes.
SMAP = f"""maps AS (SELECT site_id, url, body, row_number() OVER (PARTITION BY site_id ORDER BY path = '/sitemap_index.xml') AS nth FROM ep WHERE path IN ('/sitemap.xml', '/sitemap_index.xml') AND ok),
named AS (SELECT DISTINCT site_id, unnest(regexp_extract_all(body, '(?m)^Sitemap: (.*)$', 1)) AS url FROM ep WHERE path = '/robots.txt' AND ok),
probed AS (SELECT * FROM maps WHERE nth = 1 OR (site_id, url) IN (SELECT (site_id, url) FROM named)),
child AS (SELECT {inputs.CHILD_SQL} FROM pages),
entry AS (SELECT site_id, contains(body, '<sitemapindex>') AS is_index, {_LOCS("body")} AS loc FROM probed
  UNION ALL SELECT c.site_id, false, {_LOCS("c.body")} FROM child c JOIN named USING (site_id, url)),
listed AS (SELECT site_id, loc FROM entry WHERE NOT is_index UNION ALL SELECT e.site_id, {_LOCS("c.body")} FROM (SELECT DISTINCT site_id, loc FROM entry WHERE is_index) e JOIN child c ON c.site_id = e.site_id AND c.url = e.loc),
smap AS (SELECT DISTINCT site_id, loc FROM listed WHERE starts_with(loc, site_id || '/'))"""
MISS = f"miss AS (SELECT s.site_id, s.page_id, s.final_url AS affected_url FROM snap s WHERE s.status >= 200 AND s.status < 300 AND s.site_id IN (SELECT site_id FROM smap) AND NOT EXISTS (SELECT 1 FROM smap m WHERE m.site_id = s.site_id AND {o.canon('m.loc')} = {o.canon('s.final_url')}))"


def sitemap_urls(spark, sf):
    return d.sitemap_universe(inputs.endpoint_raw(spark, sf), inputs.sitemap_documents(spark, sf))


@query("R_SEO_SITEMAP_011", o.with_([*o.PAGE_CTES, o.ENDPOINTS, SMAP, MISS], "SELECT * FROM miss"))
def sitemap_011(spark, sf):
    return r.missing_from_sitemap(silver(spark, sf), sitemap_urls(spark, sf)).select("site_id", "page_id", "affected_url")


@query("R_SEO_INTL_001", o.with_(o.PAGE_CTES, "SELECT site_id, page_id, final_url AS affected_url FROM snap WHERE n_hre = 0 AND site_id IN (SELECT site_id FROM snap WHERE n_hre > 0)"))
def intl_001(spark, sf):
    return r.missing_hreflang(silver(spark, sf)).select("site_id", "page_id", "affected_url")


def _ep(path, what="ok"):
    return f"coalesce(bool_or({what}) FILTER (path = '{path}'), false)"


def _body(path):
    return f"coalesce(max(body) FILTER (path = '{path}' AND ok), '')"


WIDE = f"""wide AS (SELECT site_id, {_ep('/robots.txt')} AS robots_ok, {_body('/robots.txt')} AS robots, {_ep('/sitemap.xml')} OR {_ep('/sitemap_index.xml')} AS map_ok, CASE WHEN {_ep('/sitemap.xml')} THEN {_body('/sitemap.xml')} ELSE {_body('/sitemap_index.xml')} END AS map, {_ep('/llms.txt')} AS llms_ok, {_body('/llms.txt')} AS llms, max(content_type) FILTER (path = '/llms.txt') AS llms_type, max(content_type) FILTER (path = '/') AS md_type,
 {_ep('/.well-known/agent-skills/index.json')} AS skill_ok, {_body('/.well-known/agent-skills/index.json')} AS skill, {_ep('/.well-known/mcp.json')} AS mcp_ok, {_body('/.well-known/mcp.json')} AS mcp, {_ep('/.well-known/api-catalog')} AS cat_ok, {_body('/.well-known/api-catalog')} AS cat,
 {_ep('/openapi.json')} OR {_ep('/swagger.json')} AS openapi_ok, {_ep('/auth.md')} AS auth_ok, {_ep('/.well-known/oauth-authorization-server')} AS as_ok, {_ep('/.well-known/oauth-protected-resource')} AS pr_ok FROM ep GROUP BY site_id),
pfacts AS (SELECT site_id, count(*) AS n_pages, count(*) FILTER (n_int >= 4) AS n_hubs, count(*) FILTER (n_hre > 0) AS n_hre, count(*) FILTER (n_hre = 0) AS n_nohre FROM snap GROUP BY 1),
nmap AS (SELECT site_id, count(*) AS n_map, count(*) FILTER (contains(loc, '/checkout/')) AS n_private_map FROM smap GROUP BY 1), nmiss AS (SELECT site_id, count(*) AS n_miss FROM miss GROUP BY 1),
sj AS (SELECT *, coalesce(n_map, 0) AS nm, coalesce(n_miss, 0) AS nx, coalesce(failed_metrics, []) AS failed, coalesce(search_integrations, false) AS search FROM wide JOIN pfacts USING (site_id) JOIN stype USING (site_id) LEFT JOIN nmap USING (site_id) LEFT JOIN nmiss USING (site_id) LEFT JOIN fmet USING (site_id) LEFT JOIN search USING (site_id))"""
_MUT = "regexp_matches(mcp, '(?i)delete')"
SITE_RULES = {
    "SEO-CRAWL-001": "NOT robots_ok",
    "SEO-CRAWL-003": "robots_ok AND regexp_matches(robots, '(?im)disallow:\\s*/\\s*$')",
    "SEO-SITEMAP-001": "NOT map_ok",
    "SEO-SITEMAP-002": "map_ok AND nm = 0",
    "SEO-SITEMAP-008": f"map_ok AND (len({o.private_refs('map')}) > 0 OR n_private_map > 0)",
    "SEO-CRAWL-004": "robots_ok AND NOT regexp_matches(robots, '(?im)^\\s*sitemap:')",
    "AR-ROBOTS-004": f"robots_ok AND NOT regexp_matches(robots, {o.q(r.AI_SIGNAL)})",
    "AR-ROBOTS-006": f"robots_ok AND NOT regexp_matches(robots, {o.rx(r.PRIVATE_DISALLOW)})",
    "SEO-INTL-001": "n_hre > 0 AND n_nohre > 0",
    "SEO-SITEMAP-011": "nm > 0 AND nx > 0",
    "SEO-LINK-009": "n_pages >= 4 AND n_hubs = 0",
    "AR-LLMS-001": "NOT llms_ok",
    "AR-LLMS-003": "llms_ok AND NOT regexp_matches(llms_type, '(?i)text/plain|text/markdown|text/x-markdown')",
    "AR-LLMS-008": f"llms_ok AND len({o.private_refs('llms')}) > 0",
    "AR-MD-001": "NOT regexp_matches(md_type, '(?i)markdown|text/plain')",
    "AR-SKILL-001": "NOT skill_ok",
    "AR-SKILL-002": "skill_ok AND NOT json_valid(skill)",
    "AR-MCP-001": "NOT mcp_ok",
    "AR-MCP-002": "mcp_ok AND NOT json_valid(mcp)",
    "AR-API-001": "NOT cat_ok",
    "AR-API-002": "cat_ok AND NOT json_valid(cat)",
    "AR-MCP-005": f"mcp_ok AND json_valid(mcp) AND {_MUT}",
    "AR-API-003": "site_type IN ('api', 'app') AND NOT openapi_ok",
    "AR-AUTH-001": "site_type IN ('api', 'app') AND NOT auth_ok",
    "AR-AUTH-002": "site_type IN ('api', 'app') AND NOT as_ok",
    "AR-AUTH-003": "site_type IN ('api', 'app') AND NOT pr_ok",
    "SEO-PERF-001": "list_contains(failed, 'lcp-ms')",
    "SEO-PERF-020": "list_contains(failed, 'total-js-kb')",
    "SEO-PERF-021": "list_contains(failed, 'third-party-js-kb')",
    "SEO-PERF-022": "list_contains(failed, 'render-blocking-requests')",
    "SEO-PERF-023": "list_contains(failed, 'total-requests')",
    "SEO-PERF-024": "list_contains(failed, 'document-fetch-ms')",
    "SEO-SEARCH-001": "search",
    "SEO-SEARCH-002": "search",
}
_SLIST = ", ".join(f"CASE WHEN {cond} THEN '{rule}' END" for rule, cond in SITE_RULES.items())
SF = f"sf AS (SELECT site_id, rule_id, title, CASE WHEN rule_id = 'AR-LLMS-001' AND site_type NOT IN ('docs', 'api') THEN 'medium' ELSE severity END AS severity FROM (SELECT site_id, site_type, unnest([{_SLIST}]) AS rule_id FROM sj) JOIN ttl USING (rule_id))"
# Logs know times only; ASOF finds the run of each row.
_KB = lambda cond: f"floor(sum(CASE WHEN {cond} THEN bytes ELSE 0 END)::DOUBLE / 1024 * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE"
_AS_OF = lambda rows: f"SELECT l.*, run_id FROM ({rows}) l ASOF JOIN runs r ON l.site_id = r.site_id AND l.seen_at >= r.started_at"
RUN_METRICS = f"""runs AS (SELECT {inputs.RUNS_SQL}),
visit AS (SELECT {inputs._VISITS} FROM (SELECT *, unnest([0, 1, 2]) AS k FROM pages)),
fetched_in AS ({_AS_OF(f"SELECT {inputs.FETCH_SQL} FROM visit")}), painted_in AS ({_AS_OF(f"SELECT {inputs.SAMPLE_SQL} FROM visit")}),
asset_in AS (SELECT site_id, run_id, url, any_value(type) AS type, any_value(third_party) AS third_party, any_value(render_blocking) AS render_blocking, max(bytes) AS bytes FROM ({_AS_OF(f"SELECT {inputs.ASSET_SQL} FROM (SELECT *, unnest(range(8)) AS a FROM visit)")}) GROUP BY 1, 2, 3),
rdoc AS (SELECT site_id, run_id, count(*) AS n, quantile_disc(total_ms, 0.5) AS v FROM fetched_in WHERE content_type = 'text/html' GROUP BY 1, 2), rlcp AS (SELECT site_id, run_id, quantile_disc(value, 0.75) AS v FROM painted_in GROUP BY 1, 2),
rres AS (SELECT site_id, run_id, count(*) AS n, count(*) FILTER (render_blocking) AS blocking, {_KB("type = 'script'")} AS js, {_KB("type = 'script' AND third_party")} AS tjs, {_KB("type = 'stylesheet'")} AS css, {_KB("type = 'image'")} AS img FROM asset_in GROUP BY 1, 2),
rall AS (SELECT rres.site_id, rres.run_id, rdoc.v AS doc, rlcp.v AS lcp, coalesce(rdoc.n, 0) + rres.n AS requests, blocking, js, tjs, css, img FROM rres LEFT JOIN rdoc USING (site_id, run_id) LEFT JOIN rlcp USING (site_id, run_id)),
rmet AS (SELECT site_id, run_id, metric_id, value, budget, CASE WHEN value IS NULL THEN 'not_measured' WHEN budget IS NULL OR value <= budget THEN 'passed' WHEN value <= budget * 1.15::DOUBLE THEN 'warning' ELSE 'failed' END AS status FROM (""" + " UNION ALL ".join(
    f"SELECT site_id, run_id, '{m}' AS metric_id, {c}::DOUBLE AS value, {dims.BUDGETS[m]}::DOUBLE AS budget FROM rall"
    for m, c in {"document-fetch-ms": "doc", "lcp-ms": "lcp", "total-requests": "requests", "render-blocking-requests": "blocking", "total-js-kb": "js", "third-party-js-kb": "tjs", "total-css-kb": "css", "image-bytes-kb": "img"}.items()
) + f""")),
fmet AS (SELECT site_id, list(metric_id) AS failed_metrics FROM rmet WHERE status = 'failed' AND run_id = 'r0' GROUP BY 1),
search AS (SELECT {inputs.SEARCH_SQL} FROM fp)"""
SITE_CTES = [*o.PAGE_CTES, STYPE, o.ENDPOINTS, SMAP, MISS, RUN_METRICS, WIDE, _TITLES, SF]


@query("R4_run_metrics", o.with_([RUN_METRICS.rsplit(",\nfmet", 1)[0]], "SELECT * FROM rmet"))
def run_metrics(spark, sf):
    logs = [of(spark, sf) for of in (inputs.fetch_log, inputs.asset_log, inputs.paint_samples)]
    runs = inputs.audit_runs(spark, sf)
    return rf.run_metrics(*[rf.as_of_runs(log, runs) for log in logs])


@query("D7_sitemap_universe", o.with_([o.ENDPOINTS, SMAP], "SELECT * FROM smap"))
def sitemap_universe(spark, sf):
    return sitemap_urls(spark, sf).select("site_id", "loc")


def site_findings(spark, sf):
    return site_findings_of(spark, sf, silver(spark, sf))


def site_findings_of(spark, sf, snap):
    from auditlake.plans.audit import audit_inputs

    (_, ep, documents, failed), options = audit_inputs(spark, sf)
    universe = materialise(d.sitemap_universe(ep, documents), "sitemap-urls")
    missing = r.missing_from_sitemap(snap, universe).groupBy("site_id", "run_id").agg(F.count("*").alias("n_missing_from_sitemap"))
    sites = snap.select("site_id", "run_id").distinct()
    return r.site_rule_findings(sites, ep, d.sitemap_url_counts(ep, documents, universe), r.page_rollup(snap), it.site_types(snap), missing, failed, **options)


@query("R_site_rule_findings", o.with_(SITE_CTES, "SELECT * FROM sf"))
def site_rules(spark, sf):
    return site_findings(spark, sf).select("site_id", "rule_id", "title", "severity")


_CAT = "cat2(rule_id, category, confidence, fix, needs) AS (VALUES " + dims.values_sql([(x["rule_id"], x["category"], x["confidence"], x["fix"], "yes" if any(t in (x["title"] + "\n" + x["recommendation"]).lower() for t in pat.APPROVAL_TERMS) else "no") for x in dims.EMITTED]) + ")"


@query("R_catalogue_findings", o.with_([*o.PAGE_CTES, STYPE, PF, _CAT], "SELECT page_id, rule_id, category, confidence, CASE WHEN needs = 'yes' THEN 'approval_required' ELSE CASE fix WHEN 'A' THEN 'approval_required' WHEN 'S' THEN 'safe_auto_fix' ELSE 'manual_strategy' END END AS fix_class, CASE fix WHEN 'S' THEN 'small' ELSE 'medium' END AS effort FROM pf JOIN cat2 USING (rule_id)"))
def catalogue_findings(spark, sf):
    out = r.with_catalogue(r.page_rule_findings(prepared(spark, sf)))
    return out.select("page_id", "rule_id", "category", "confidence", "fix_class", "effort")


@query("R2_endpoint_evidence", o.with_([o.ENDPOINTS], "SELECT site_id, 'endpoint' || regexp_replace(path, '[^A-Za-z0-9]+', '-', 'g') AS evidence_id, url, status, substr(body, 1, 500) AS excerpt FROM ep"))
def r2_endpoints(spark, sf):
    from auditlake.operators.evidence import endpoint_evidence

    return endpoint_evidence(inputs.endpoint_raw(spark, sf)).select("site_id", "evidence_id", "url", "status", "excerpt")


@query("R2_cross_page_evidence", o.with_([*o.PAGE_CTES, DUP], "SELECT site_id, 'cross-page-' || lower(rule_id) || '-' || substr(sha256(k), 1, 12) AS evidence_id, arg_min(final_url, page_id) AS url, CAST(count(*) AS VARCHAR) AS value FROM dk WHERE k IS NOT NULL AND k <> '' GROUP BY site_id, rule_id, k HAVING count(*) > 1"))
def r2_cross_page(spark, sf):
    from auditlake.operators.evidence import cross_page_evidence

    keys = materialise(r.duplicate_keys(snapshots(spark, sf)), "duplicate-keys")
    groups = r.group_representatives(keys, r.duplicate_groups(keys))
    return cross_page_evidence(groups).select("site_id", "evidence_id", "url", "value")


@query("R2_evidence_rows", o.with_([*o.PAGE_CTES, STYPE, PF], "SELECT page_id, rule_id, substr(regexp_replace(affected_url, '[^A-Za-z0-9]+', '-', 'g'), 1, 48) || '-' || substr(md5(affected_url), 1, 16) || '-' || lower(rule_id) AS evidence_id FROM pf"))
def r2(spark, sf):
    from auditlake.operators.evidence import page_evidence

    return page_evidence(r.page_rule_findings(prepared(spark, sf))).select("page_id", "rule_id", "evidence_id")


@query("R3_rule_applicability", o.with_([*o.PAGE_CTES, STYPE, "c(rule_id, category) AS (VALUES " + dims.values_sql([(x["rule_id"], x["category"]) for x in dims.RULES]) + ")"], "SELECT site_id, count(*) FILTER (CASE WHEN category = 'local_seo' THEN site_type = 'local-business' WHEN category = 'ecommerce_seo' THEN site_type = 'commerce' WHEN starts_with(rule_id, 'SEO-SEARCH-') OR rule_id = 'SEO-PERF-001' THEN false ELSE true END) AS n_applicable FROM stype CROSS JOIN c GROUP BY 1"))
def r3(spark, sf):
    types = it.site_types(p.with_json_ld_types(snapshots(spark, sf)))
    yes, no = F.lit(True), F.lit(False)
    runs = types.select(
        "site_id", "run_id", "site_type", yes.alias("include_agent"), no.alias("include_search"), yes.alias("include_accessibility"),
        yes.alias("include_international"), yes.alias("include_local"), yes.alias("include_commerce"), no.alias("include_vitals"), no.alias("lcp_measured"),
    )
    none = runs.select("site_id", "run_id", F.lit("x").alias("rule_id"), F.lit(0).cast("long").alias("n_findings"))
    return r.coverage_ledger(runs, none).groupBy("site_id").agg(F.count_if("applicable").alias("n_applicable"))


# --- site intelligence --------------------------------------------------------------------------------------
@query("I1_site_type", o.with_([*o.PAGE_CTES, STYPE], "SELECT * FROM stype"))
def i1(spark, sf):
    return it.site_types(p.with_json_ld_types(snapshots(spark, sf))).select("site_id", "site_type")


FRAMES = "CASE " + " ".join(f"WHEN regexp_matches(t, {o.q(pattern)}) THEN '{name}'" for name, pattern in it.FRAMEWORK_TEXT) + " ELSE 'unknown' END"
# Documents stand for page texts; some carry a framework marker.
MARK_SQL = "'https://' || source || '.example' AS site_id, 'r0' AS run_id, doc_id AS ord, text || CASE doc_id % 11 WHEN 0 THEN ' /_next/static' WHEN 1 THEN ' data-sveltekit x' WHEN 2 THEN ' served by WP-Content/ dir' WHEN 3 THEN ' cdn.shopify.com/a' WHEN 4 THEN ' server: cloudflare' WHEN 5 THEN ' https://plausible.io/js and gtag(' WHEN 6 THEN ' built with Next.js now' ELSE '' END AS text, CASE doc_id % 4 WHEN 0 THEN 'headers' WHEN 1 THEN 'html' WHEN 2 THEN 'endpoint' ELSE 'asset_path' END AS source"
MARKED = f"marked AS (SELECT {MARK_SQL} FROM documents)"


def marked(spark, sf):
    return inputs.texts(spark, sf).selectExpr(*inputs._split(MARK_SQL))


@query("I2_first_page_framework", o.with_([MARKED], f"SELECT site_id, arg_min({FRAMES}, ord) AS framework FROM (SELECT *, lower('server:x' || chr(10) || text) AS t FROM marked) GROUP BY 1"))
def i2(spark, sf):
    pages = marked(spark, sf).withColumn("headers", F.create_map(F.lit("server"), F.lit("x")))
    return it.site_framework(pages).select("site_id", "framework")


def _sig(i, row):
    pattern, cat, name, conf = row
    b = f"length(regexp_extract(t, {o.q('(?s)^(.*?)(?:' + pattern + ')')}, 1))"
    ev = f"regexp_replace(substr(t, greatest(1, {b} - 23), least(24, {b}) + 96), '\\s+', ' ', 'g')"
    return f"SELECT site_id, ord, {i} AS no, source, '{cat}' AS category, '{name}' AS name, {conf} AS confidence, {ev} AS evidence FROM low WHERE regexp_matches(t, {o.q(pattern)})"


SIG = "low AS (SELECT site_id, ord, source, lower(text) AS t FROM marked),\nsig0 AS (" + " UNION ALL ".join(_sig(i, row) for i, row in enumerate(it.TECH_PATTERNS)) + """),
sig AS (SELECT site_id, category, name, evidence, arg_min(source, k) AS source, arg_min(confidence, k) AS confidence FROM (SELECT *, ord * 100 + no AS k FROM sig0) GROUP BY 1, 2, 3, 4)"""


@query("I3_tech_signals", o.with_([MARKED, SIG], "SELECT site_id, category, name, evidence, source, confidence FROM sig"))
def i3(spark, sf):
    return it.text_signals(marked(spark, sf)).select("site_id", "category", "name", "evidence", "source", "confidence")


@query("I4_evidence_excerpt", o.with_([MARKED], "SELECT ord, regexp_replace(substr(t, greatest(1, b - 23), least(24, b) + 96), '\\s+', ' ', 'g') AS excerpt FROM (SELECT ord, lower(text) AS t, length(regexp_extract(lower(text), '(?s)^(.*?)(?:the|der|que)', 1)) AS b FROM marked)"))
def i4(spark, sf):
    return marked(spark, sf).select("ord", it.evidence_excerpt(F.lower("text"), "the|der|que").alias("excerpt"))


DEP_SQL = "'https://s' || CAST(l_suppkey % 60 AS STRING) || '.example' AS site_id, 'r0' AS run_id, CASE l_partkey % 14 WHEN 0 THEN 'next' WHEN 1 THEN 'astro' WHEN 2 THEN 'nuxt' WHEN 3 THEN '@sveltejs/kit' WHEN 4 THEN '@remix-run/react' WHEN 5 THEN 'vite' WHEN 6 THEN 'sharp' WHEN 7 THEN 'react' WHEN 8 THEN '@vercel/analytics' ELSE 'lodash' || CAST(l_partkey % 5 AS STRING) END AS dependency"
DEPS = f"deps AS (SELECT {DEP_SQL} FROM lineitem)"
_DEPV = "dv(dependency, category, name, confidence) AS (VALUES " + dims.values_sql([(k, *v) for k, v in it.DEPENDENCIES.items()]) + ")"


def deps(spark, sf):
    return inputs.table(spark, sf, "lineitem").selectExpr(*inputs._split(DEP_SQL))


@query("I5_dependency_signals", o.with_([DEPS, _DEPV], "SELECT DISTINCT site_id, category, name, 'Dependency: ' || dependency AS evidence, confidence FROM deps JOIN dv USING (dependency)"))
def i5(spark, sf):
    return it.dependency_signals(deps(spark, sf)).select("site_id", "category", "name", "evidence", "confidence")


_SW = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in it.SOURCE_WEIGHT.items()) + " ELSE 0 END"
SCORES = f"scr AS (SELECT site_id, name, max(confidence) AS max_confidence, count(*) AS n_signals, max(confidence) + max({_SW}) + least(24, count(*) FILTER (source IN ('repo', 'asset_path', 'headers', 'endpoint')) * 4) + least(8, count(DISTINCT source) * 2) AS score FROM sig WHERE category = 'framework' GROUP BY 1, 2)"


@query("I6_winning_framework", o.with_([MARKED, SIG, SCORES], "SELECT site_id, name, score FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY score DESC, max_confidence DESC, n_signals DESC, name) AS rn FROM scr) WHERE rn = 1"))
def i6(spark, sf):
    return it.winner(it.text_signals(marked(spark, sf))).select("site_id", "name", F.col("score").cast("long").alias("score"))


@query("I7_stack_names", o.with_([MARKED, SIG], "SELECT s.site_id, s.category, string_agg(DISTINCT s.name, ',' ORDER BY s.name) AS names, any_value(c.confidence) AS confidence FROM sig s JOIN (SELECT site_id, CAST(floor(round(avg(confidence), 6) + 0.5) AS INT) AS confidence FROM sig GROUP BY 1) c USING (site_id) GROUP BY 1, 2"))
def i7(spark, sf):
    return it.stack_names(it.text_signals(marked(spark, sf))).select("site_id", "category", "names", "confidence")


_PAT = "'/' || array_to_string(list_transform(list_filter(string_split(lower(regexp_extract(final_url, '^https?://[^/?#]+([^?#]*)', 1)), '/'), lambda s: s <> ''), lambda s, i: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN ':number' WHEN regexp_matches(s, '^[0-9a-f]{8,}$') THEN ':id' WHEN i > 1 THEN ':slug' WHEN length(s) > 32 OR contains(s, '-') THEN ':slug' ELSE s END), '/')"
_SHAPE = lambda c: f"CASE WHEN coalesce({o.trim(c)}, '') = '' THEN 'empty' ELSE substr({o.sub(o.sub(o.sub(o.trim(c), '[A-Z][a-z]+', 'Word'), '[0-9]+', '0'), '[' + __import__('auditlake.functions.urls', fromlist=['x']).JS_SPACE + ']+', ' ')}, 1, 80) END"
TPL = f"""h1 AS (SELECT page_id, arg_min(text, ord) AS h1 FROM heads WHERE level = 1 AND text <> '' GROUP BY 1),
tpl AS (SELECT site_id, t AS url_pattern, count(*) AS page_count, arg_min(final_url, page_id) AS representative_url, count(DISTINCT ts) AS title_shapes, count(DISTINCT hs) AS h1_shapes FROM (SELECT site_id, page_id, final_url, {_PAT} AS t, {_SHAPE('title')} AS ts, {_SHAPE('h1')} AS hs FROM snap LEFT JOIN h1 USING (page_id)) GROUP BY 1, 2)"""


@query("I8_route_templates", o.with_([*o.PAGE_CTES, TPL], f"SELECT site_id, url_pattern, page_count, representative_url, {LABEL.replace('t = ', 'url_pattern = ').replace('extract(t,', 'extract(url_pattern,')} AS label FROM tpl"))
def i8(spark, sf):
    return it.route_templates(snapshots(spark, sf)).select("site_id", "url_pattern", "page_count", "representative_url", "label")


@query("I9_template_signals", o.with_([*o.PAGE_CTES, TPL], "SELECT site_id, url_pattern, title_shapes, h1_shapes FROM tpl"))
def i9(spark, sf):
    return it.route_templates(snapshots(spark, sf)).select("site_id", "url_pattern", "title_shapes", "h1_shapes")


ROUTE_SQL = "'https://s' || CAST(p_partkey % 40 AS STRING) || '.example' AS site_id, p_partkey AS ord, CASE p_partkey % 6 WHEN 0 THEN 'src/pages/blog/post' || CAST(p_partkey AS STRING) || '.tsx' WHEN 1 THEN 'src/pages/index.tsx' WHEN 2 THEN 'app/docs/page.tsx' ELSE 'src/routes/r' || CAST(p_size AS STRING) || '.tsx' END AS path, p_size AS confidence"
PATTERN_SQL = "'https://s' || CAST(l_suppkey % 40 AS STRING) || '.example' AS site_id, CASE l_partkey % 5 WHEN 0 THEN '/' WHEN 1 THEN '/blog/:slug' WHEN 2 THEN '/docs' WHEN 3 THEN '/:number/x' ELSE '/shop/:id' END AS url_pattern"


@query("I10_template_sources", f"""WITH t AS (SELECT DISTINCT *, regexp_replace(regexp_extract(url_pattern, '^/([^/]*)', 1), '^:', '') AS seg FROM (SELECT {PATTERN_SQL} FROM lineitem)), f AS (SELECT {ROUTE_SQL} FROM part),
m AS (SELECT t.site_id, url_pattern, path, row_number() OVER (PARTITION BY t.site_id, url_pattern ORDER BY confidence DESC, ord) AS rank FROM t JOIN f USING (site_id) WHERE CASE WHEN url_pattern = '/' THEN regexp_matches(lower(path), {o.q(it.INDEX_FILE)}) ELSE seg <> '' AND contains(lower(path), seg) END),
d AS (SELECT t.site_id, t.url_pattern, path, row_number() OVER (PARTITION BY t.site_id, t.url_pattern ORDER BY ord) AS rank FROM t JOIN f USING (site_id) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.site_id = t.site_id AND m.url_pattern = t.url_pattern))
SELECT site_id, url_pattern, path, rank FROM m WHERE rank <= 5 UNION ALL SELECT * FROM d WHERE rank <= 5""")
def i10(spark, sf):
    t = inputs.table(spark, sf, "lineitem").selectExpr(*inputs._split(PATTERN_SQL))
    files = inputs.table(spark, sf, "part").selectExpr(*inputs._split(ROUTE_SQL))
    return it.template_sources(t, files).select("site_id", "url_pattern", "path", F.col("rank").cast("long").alias("rank"))


PATH_SQL = """p_partkey, CASE p_partkey % 16 WHEN 0 THEN 'package.json' WHEN 1 THEN 'web/next.config.mjs' WHEN 2 THEN 'netlify.toml' WHEN 3 THEN 'public/Img/A.PNG' WHEN 4 THEN 'app/robots.ts' WHEN 5 THEN 'src/sitemap.xml' WHEN 6 THEN 'app/Layout.tsx' WHEN 7 THEN 'app/shop/page.tsx' WHEN 8 THEN 'content/a.md' WHEN 9 THEN 'lib/x.test.ts'
 WHEN 10 THEN '.env.local' WHEN 11 THEN 'dist/a.js.map' WHEN 12 THEN 'certs/server.PEM' WHEN 13 THEN 'src/routes/a/+page.svelte' WHEN 14 THEN 'pages/index.vue' ELSE 'README' || CAST(p_partkey AS STRING) END AS path, 'https://s' || CAST(p_size AS STRING) || '.example' AS site_id, 'r0' AS run_id"""


@query("S16_listed_files", f"SELECT p_partkey, path FROM (SELECT {PATH_SQL} FROM part) WHERE p_partkey % 16 NOT IN (10, 11, 12)")
def s16(spark, sf):
    return it.listed_files(inputs.table(spark, sf, "part").selectExpr(*inputs._split(PATH_SQL))).select("p_partkey", "path")


@query("I11_file_kinds", f"SELECT p_partkey, ['package', 'framework_config', 'deployment', 'static_asset', 'robots', 'sitemap', 'metadata', CASE WHEN p_partkey % 2 = 1 THEN 'route' END, 'content', 'test', NULL, NULL, NULL, 'route', 'route', NULL][CAST(p_partkey % 16 AS INT) + 1] AS kind FROM part")
def i11(spark, sf):
    files = inputs.table(spark, sf, "part").selectExpr(*inputs._split(PATH_SQL))
    fw = F.when(F.col("p_partkey") % 2 == 1, F.array(F.lit("nextjs"))).otherwise(F.array().cast("array<string>"))
    return files.select("p_partkey", it.file_kind(F.col("path"), fw)["kind"].alias("kind"))


@query("I12_repo_profile", f"""WITH f AS (SELECT {PATH_SQL} FROM part), d AS (SELECT {DEP_SQL} FROM lineitem), k AS (SELECT site_id FROM f UNION SELECT site_id FROM d)
SELECT site_id, array_to_string(list_filter([CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.site_id = k.site_id AND dependency = 'next') OR EXISTS (SELECT 1 FROM f WHERE f.site_id = k.site_id AND path LIKE '%next.config%') THEN 'nextjs' END, """ + ", ".join(
    f"CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.site_id = k.site_id AND dependency = '{dep}') THEN '{n}' END" for n, dep in (("astro", "astro"), ("nuxt", "nuxt"), ("sveltekit", "@sveltejs/kit"), ("remix", "@remix-run/react"), ("vite", "vite"), ("react", "react"))
) + "], lambda x: x IS NOT NULL), ',') AS frameworks FROM k")
def i12(spark, sf):
    files = inputs.table(spark, sf, "part").selectExpr(*inputs._split(PATH_SQL))
    return it.repo_profile(files, deps(spark, sf), ["site_id"]).select("site_id", F.array_join("frameworks", ",").alias("frameworks"))


AG = "ag AS (SELECT site_id, count(*) AS n_agent, count(*) FILTER (severity = 'critical') AS n_crit, sum(CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 14 WHEN 'medium' THEN 7 WHEN 'low' THEN 3 ELSE 1 END) AS pen FROM sf JOIN cat2 USING (rule_id) WHERE category IN ('agent_readiness', 'protocol_discovery', 'api_auth_mcp', 'policy') GROUP BY 1), aw AS (SELECT site_id, avg(word_count) AS w FROM snap GROUP BY 1)"


@query("I13_agent_experience", o.with_([*SITE_CTES, _CAT, AG], """SELECT site_id, nm + n_pages AS canonical_sources, CASE WHEN llms_ok AND md THEN 2 WHEN llms_ok OR cat_ok THEN 3 ELSE 5 END AS estimated_agent_requests_to_source, CAST(floor(greatest(0, w - 200) * 1.4::DOUBLE + 0.5) AS BIGINT) AS estimated_context_waste, CAST(llms_ok AS INT) AS llms_txt_available, CAST(md AS INT) AS markdown_available,
 CAST(mcp_ok AS INT) AS mcp_discovery_available, CAST(cat_ok AS INT) AS api_catalog_available, CAST(skill_ok AS INT) AS agent_skills_available, n_agent AS agent_readiness_findings, n_crit AS critical_agent_readiness_findings,
 CAST(greatest(0, least(100, 100 - pen + CASE WHEN llms_ok THEN 8 ELSE 0 END + CASE WHEN md THEN 6 ELSE 0 END + CASE WHEN mcp_ok THEN 4 ELSE 0 END + CASE WHEN cat_ok THEN 4 ELSE 0 END + CASE WHEN skill_ok THEN 4 ELSE 0 END)) AS INT) AS score FROM (SELECT *, regexp_matches(md_type, '(?i)markdown|text/plain') AS md FROM sj) JOIN ag USING (site_id) JOIN aw USING (site_id)"""))
def i13(spark, sf):
    ep, snap = inputs.endpoint_raw(spark, sf), silver(spark, sf)
    wide = r.endpoint_wide(ep)
    ok = lambda path: F.coalesce(F.col(r.probe(path))["ok"], F.lit(False))
    kind = F.col(r.probe(dims.MARKDOWN_PROBE))["content_type"]
    flags = wide.select(
        "site_id", "run_id", ok("/llms.txt").alias("has_llms"), F.coalesce(kind.rlike("(?i)markdown|text/plain"), F.lit(False)).alias("has_markdown"),
        ok("/.well-known/mcp.json").alias("has_mcp"), ok("/.well-known/api-catalog").alias("has_api_catalog"), ok("/.well-known/agent-skills/index.json").alias("has_skills"),
    )
    found = r.with_catalogue(site_findings_of(spark, sf, snap)).filter(F.col("category").isin("agent_readiness", "protocol_discovery", "api_auth_mcp", "policy"))
    points = it.lookup(F.col("severity"), it.AGENT_PENALTY)
    agent = found.groupBy("site_id", "run_id").agg(
        F.count("*").alias("n_agent_findings"), F.count_if(F.col("severity") == "critical").alias("n_critical_agent"), F.sum(points).alias("agent_penalty")
    )
    words = snap.groupBy("site_id", "run_id").agg(F.count("*").alias("n_pages"), F.avg("word_count").alias("avg_words"))
    key = ["site_id", "run_id"]
    joined = flags.join(agent, key, "left").join(words, key).join(d.sitemap_url_counts(ep, inputs.sitemap_documents(spark, sf)), key, "left").fillna(0, ["n_sitemap_urls", "n_agent_findings", "n_critical_agent", "agent_penalty"])
    return it.agent_experience(joined).drop("run_id")


# --- the whole audit ----------------------------------------------------------------------------------------
_CATC = "cc(rule_id, category, confidence) AS (VALUES " + dims.values_sql([(x["rule_id"], x["category"], x["confidence"]) for x in dims.EMITTED]) + ")"
_D = "::DOUBLE"
_SEV = lambda table: "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}{_D}" for k, v in table.items()) + " END"
REFS = f"refs AS (SELECT site_id, 'SEO-SITEMAP-008' AS rule_id, unnest({o.private_refs('map')}) AS ref FROM sj UNION ALL SELECT site_id, 'AR-LLMS-008', unnest({o.private_refs('llms')}) FROM sj UNION ALL SELECT site_id, 'AR-MCP-005', 'delete_order' FROM sj)"
FACTS = """fct AS (SELECT site_id, rule_id, title, severity, 'f' AS kind, NULL AS value FROM pf UNION ALL SELECT site_id, rule_id, title, severity, 'u', affected_url FROM pf
 UNION ALL SELECT site_id, rule_id, title, severity, 'f', NULL FROM (SELECT site_id, rule_id, k FROM dk WHERE k <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1) JOIN ttl USING (rule_id)
 UNION ALL SELECT site_id, rule_id, title, severity, 'u', final_url FROM (SELECT *, count(*) OVER (PARTITION BY site_id, rule_id, k) AS n FROM dk WHERE k <> '') JOIN ttl USING (rule_id) WHERE n > 1
 UNION ALL SELECT site_id, rule_id, title, severity, 'f', NULL FROM sf UNION ALL SELECT site_id, rule_id, title, severity, 'u', site_id FROM sf WHERE rule_id NOT IN ('SEO-SITEMAP-011', 'SEO-INTL-001')
 UNION ALL SELECT site_id, rule_id, title, severity, 'u', affected_url FROM sf JOIN miss USING (site_id) WHERE rule_id = 'SEO-SITEMAP-011'
 UNION ALL SELECT sf.site_id, rule_id, sf.title, severity, 'u', final_url FROM sf JOIN snap USING (site_id) WHERE rule_id = 'SEO-INTL-001' AND n_hre = 0 UNION ALL SELECT sf.site_id, sf.rule_id, title, severity, 't', ref FROM sf JOIN refs USING (site_id, rule_id)),
gf AS (SELECT site_id, rule_id, title, category, severity, any_value(confidence) AS confidence, count(*) FILTER (kind = 'f') AS nf, count(DISTINCT value) FILTER (kind = 'u') AS nu, count(DISTINCT value) FILTER (kind = 't') AS nt FROM fct JOIN cc USING (rule_id) GROUP BY 1, 2, 3, 4, 5),
gp AS (SELECT *, """ + f"({_SEV(dims.BASE_PENALTY)}) * confidence / 100.0{_D} + least(greatest(0, greatest(nf, nu, nt) - 1){_D} * ({_SEV(dims.STEP_PENALTY)}) * confidence / 100.0{_D}, ({_SEV(dims.CAP_PENALTY)}) * confidence / 100.0{_D}) AS penalty FROM gf)"
_MAP = {**dims.AREAS, "total": dims.PROFILES["core_seo"]}
_AMAP = "am(area, category) AS (VALUES " + dims.values_sql([(k, c) for k, cs in _MAP.items() for c in cs]) + ")"
_SC = "CAST(greatest(0, least(100, floor(round(100.0::DOUBLE - coalesce(sum(penalty) FILTER (area = '{a}' AND ('{a}' <> 'total' OR NOT regexp_matches(rule_id, '^(AR-|SEO-SEARCH-)'))), 0), 6) + 0.5))) AS INT)"


@query("A_site_audit", o.with_([*SITE_CTES, PF.split(",\n", 1)[1], DUP, _CATC, REFS, FACTS, _AMAP, "wide2 AS (SELECT st.site_id, " + ", ".join(f'{_SC.replace("{a}", a)} AS "{a}"' for a in _MAP) + " FROM stype st LEFT JOIN gp USING (site_id) LEFT JOIN am USING (category) GROUP BY 1)"],
    "SELECT *, CASE WHEN total >= 90 THEN 'excellent' WHEN total >= 75 THEN 'strong' WHEN total >= 60 THEN 'medium' WHEN total >= 40 THEN 'weak' ELSE 'critical' END AS level FROM wide2"))
def site_audit_query(spark, sf):
    from auditlake.plans.audit import site_audit

    return site_audit(spark, sf).drop("run_id")
