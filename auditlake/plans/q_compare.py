"""Queries over run comparison, suppressions, portfolio, gates and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions import privacy_patterns as pat
from auditlake.operators import actions as a
from auditlake.operators import checks as ck
from auditlake.operators import compare as cmp
from auditlake.operators import graph as g
from auditlake.operators import pages as p
from auditlake.operators import scoring as s
from auditlake.plans import findings_input as fi
from auditlake.plans import inputs
from auditlake.plans import oracle as o
from auditlake.plans import q_scores as qs
from auditlake.plans.q_pages import snapshots
from auditlake.plans.q_rules import MISS, SMAP, sitemap_urls
from auditlake.plans.registry import query
from auditlake.session import materialise


def sides(spark, sf):
    f = fi.findings(spark, sf)
    return f.filter("run_id = 'r0'"), f.filter("run_id = 'r1'")


def _change(now, before):
    return f"CASE WHEN {now} AND {before} THEN 'recurring' WHEN {now} THEN 'new' ELSE 'resolved' END"


@query("B1_baseline_diff", fi.with_([], f"SELECT site_id, rule_id, {_change('bool_or(n)', 'bool_or(NOT n)')} AS change FROM (SELECT site_id, rule_id, run_id = 'r1' AS n FROM fnd) GROUP BY 1, 2"))
def b1(spark, sf):
    return cmp.baseline_diff(*sides(spark, sf))


SCOPE = """scp0 AS (SELECT site_id, run_id, rule_id, severity, ord, coalesce(template, page_url, 'unscoped') AS scope FROM fnd),
scp AS (SELECT site_id, run_id, rule_id, scope, arg_max(severity, ord) AS severity FROM scp0 GROUP BY 1, 2, 3, 4),
sdf AS (SELECT site_id, rule_id, scope, max(CASE WHEN run_id = 'r1' THEN severity END) AS severity, """ + _change("bool_or(run_id = 'r1')", "bool_or(run_id = 'r0')") + """ AS change FROM scp GROUP BY 1, 2, 3)"""


@query("B2_scope_diff", fi.with_([SCOPE], "SELECT * FROM sdf"))
def b2(spark, sf):
    return cmp.scope_diff(*sides(spark, sf))


CMP = f"""tots AS (SELECT r.site_id, r.run_id, {qs.score('q.x')} AS total FROM runs r LEFT JOIN (SELECT site_id, run_id, sum(penalty) AS x FROM grp JOIN profs USING (category) WHERE profile = 'core_seo' GROUP BY 1, 2) q USING (site_id, run_id)),
two AS (SELECT site_id, max(CASE WHEN run_id = 'r0' THEN total END) AS before, max(CASE WHEN run_id = 'r1' THEN total END) AS after FROM tots GROUP BY 1),
cm0 AS (SELECT site_id, count(*) FILTER (change = 'new') AS n_new, count(*) FILTER (change = 'resolved') AS n_resolved, count(*) FILTER (change = 'recurring') AS n_recurring, count(*) FILTER (change = 'new' AND severity IN ('critical', 'high')) AS new_critical_high FROM sdf GROUP BY 1),
cmpr AS (SELECT *, after - before AS score_delta, CASE WHEN new_critical_high > 0 OR after < before THEN 'regressed' WHEN after > before THEN 'improved' ELSE 'unchanged' END AS verdict FROM two JOIN cm0 USING (site_id))"""
CMP_CTES = [fi.SCOREABLE, qs.GRP, qs.PROFILES, SCOPE, CMP]


def comparison(spark, sf):
    totals = s.primary_total(fi.runs(spark, sf), fi.findings(spark, sf), None)
    pick = lambda run: F.max(F.when(F.col("run_id") == run, F.col("total")))
    scores = totals.groupBy("site_id").agg(pick("r0").alias("before"), pick("r1").alias("after"))
    return cmp.run_comparison(cmp.scope_diff(*sides(spark, sf)), scores)


@query("B2_run_comparison", fi.with_(CMP_CTES, "SELECT *, CASE WHEN verdict = 'regressed' THEN 'failed' ELSE 'passed' END AS gate FROM cmpr"))
def b2b(spark, sf):
    return comparison(spark, sf)


PRIVATE = "rule_id IN ('SEO-SITEMAP-008', 'AR-LLMS-008')"


@query("B3_regression_policy", fi.with_([*CMP_CTES, f"crit AS (SELECT site_id, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'critical' AND {PRIVATE}) AS n_private FROM fnd WHERE run_id = 'r1' GROUP BY 1)"],
    "SELECT site_id, CASE WHEN score_delta < -5 OR new_critical_high > 0 THEN 'failed' ELSE 'passed' END AS regression_gate, array_to_string(list_filter([CASE WHEN length(site_id) % 2 = 1 THEN 'strict report lint failed' END, CASE WHEN n_critical > 0 THEN 'critical findings detected' END, CASE WHEN n_private > 0 THEN 'private URL exposure detected' END, CASE WHEN score_delta < -5 OR new_critical_high > 0 THEN 'regression policy failed' END], lambda x: x IS NOT NULL), '|') AS failed_reasons FROM cmpr JOIN crit USING (site_id)"))
def b3(spark, sf):
    _, now = sides(spark, sf)
    crit = F.col("severity") == "critical"
    counts = now.groupBy("site_id").agg(
        F.count_if(crit).alias("n_critical"), F.count_if(crit & F.col("rule_id").isin("SEO-SITEMAP-008", "AR-LLMS-008")).alias("n_private_critical")
    )
    rows = comparison(spark, sf).join(counts, "site_id").withColumn("lint_ok", F.length("site_id") % 2 == 0)
    return cmp.regression_policy(rows).select("site_id", "regression_gate", F.array_join("failed_reasons", "|").alias("failed_reasons"))


_PATTERNS = ["/p/1", "/p/[0-9]$", None, "(?P<n>broken)"]
SUP_SQL = "'https://s' || CAST(p_partkey % 100 AS STRING) || '.example' AS site_id, 'sup-' || CAST(p_partkey AS STRING) AS suppression_id, CAST(p_partkey % 72 AS INT) AS rule_no, p_partkey % 4 AS pattern_no, CASE p_size % 3 WHEN 0 THEN '2020-01-01' WHEN 1 THEN '2030-01-01' ELSE CASE WHEN p_partkey % 5 = 0 THEN 'soon' END END AS expires_at, 'known' AS reason"
SUP = f"""sup AS (SELECT site_id, suppression_id, rule_id, expires_at, pattern_no FROM (SELECT {SUP_SQL} FROM part) JOIN rules USING (rule_no)),
fu AS (SELECT DISTINCT site_id, rule_id, page_url AS url FROM fnd WHERE page_url IS NOT NULL),
sm AS (SELECT site_id, suppression_id, rule_id, url FROM sup JOIN fu USING (site_id, rule_id) WHERE coalesce(nullif(expires_at, 'soon'), '9') >= '2025-01-01' AND CASE pattern_no WHEN 0 THEN regexp_matches(url, '/p/1') WHEN 1 THEN regexp_matches(url, '/p/[0-9]$') WHEN 2 THEN true ELSE false END)"""


def suppressions(spark, sf):
    rows = inputs.table(spark, sf, "part").selectExpr(*inputs._split(SUP_SQL))
    ids = F.array(*[F.lit(r["rule_id"]) for r in dims.EMITTED])
    patterns = F.array(*[F.lit(x) for x in _PATTERNS])
    listed = rows.select(
        "site_id", "suppression_id", F.element_at(ids, F.col("rule_no") + 1).alias("rule_id"),
        F.element_at(patterns, F.col("pattern_no").cast("int") + 1).alias("url_pattern"), "expires_at", "reason",
    )
    return cmp.checked_patterns(listed)


TODAY = "2025-01-01 00:00:00"


@query("B4_suppression_matches", fi.with_([SUP], "SELECT * FROM sm"))
def b4(spark, sf):
    return cmp.suppression_matches(suppressions(spark, sf), fi.findings(spark, sf), F.lit(TODAY).cast("timestamp"))


@query("B4_suppression_report", fi.with_([SUP], "SELECT site_id, suppression_id, rule_id, CASE WHEN nullif(expires_at, 'soon') < '2025-01-01' THEN 'expired' WHEN n > 0 THEN 'matched' ELSE 'unmatched' END AS state, coalesce(n, 0) AS n_urls FROM sup LEFT JOIN (SELECT site_id, suppression_id, count(*) AS n FROM sm GROUP BY 1, 2) USING (site_id, suppression_id)"))
def b4b(spark, sf):
    now, sup = F.lit(TODAY).cast("timestamp"), suppressions(spark, sf)
    return cmp.suppression_report(sup, cmp.suppression_matches(sup, fi.findings(spark, sf), now), now)


@query("S15_suppression_problems", "SELECT site_id, suppression_id, 'duplicate' AS problem FROM (SELECT 'https://s' || CAST(p_size AS VARCHAR) || '.example' AS site_id, 'sup-' || CAST(p_partkey % 600 AS VARCHAR) AS suppression_id FROM part) GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT 'https://s' || CAST(p_size AS VARCHAR) || '.example', 'sup-' || CAST(p_partkey % 600 AS VARCHAR), 'incomplete' FROM part WHERE p_partkey % 17 = 0")
def s15(spark, sf):
    c = F.col
    rows = inputs.table(spark, sf, "part").select(
        F.concat(F.lit("https://s"), c("p_size").cast("string"), F.lit(".example")).alias("site_id"), F.concat(F.lit("sup-"), (c("p_partkey") % 600).cast("string")).alias("suppression_id"),
        F.lit("R").alias("rule_id"), F.when(c("p_partkey") % 17 == 0, "").otherwise("why").alias("reason"),
    )
    return cmp.duplicate_suppressions(rows)


RUN_SQL = "'https://c' || CAST(o_custkey AS STRING) || '.example' || CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '' END AS target_url, CAST(o_orderkey AS STRING) AS scan_id, o_orderdate AS completed_at, CAST(floor(o_totalprice) AS BIGINT) % 101 AS score, CASE o_orderstatus WHEN 'O' THEN 'passed' WHEN 'F' THEN 'failed' ELSE 'unknown' END AS quality_gate"
RUNS = f"""ar AS (SELECT *, regexp_replace(target_url, '/?$', '/') AS target FROM (SELECT {RUN_SQL} FROM orders)),
rk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY completed_at DESC, scan_id DESC) AS rn, count(*) OVER (PARTITION BY target) AS runs FROM ar),
pf AS (SELECT target, max(scan_id) FILTER (rn = 1) AS latest_scan, max(score) FILTER (rn = 1) AS latest_score, max(score) FILTER (rn = 2) AS previous_score, max(quality_gate) FILTER (rn = 1) AS latest_gate, max(completed_at) FILTER (rn = 1) AS latest_completed_at, any_value(runs) AS runs FROM rk GROUP BY 1)"""


def audit_runs(spark, sf):
    return inputs.table(spark, sf, "orders").selectExpr(*inputs._split(RUN_SQL))


@query("B5_portfolio", o.with_([RUNS], "SELECT target, latest_scan, latest_score, previous_score, latest_gate, strftime(latest_completed_at, '%Y-%m-%d') AS latest_day, runs, latest_score - previous_score AS score_delta FROM pf"))
def b5(spark, sf):
    out = cmp.portfolio(audit_runs(spark, sf))
    return out.withColumn("latest_day", F.date_format("latest_completed_at", "yyyy-MM-dd")).drop("latest_completed_at")


@query("B5_portfolio_totals", o.with_([RUNS], "SELECT count(*) AS targets, CAST(sum(runs) AS BIGINT) AS runs, count(*) FILTER (latest_gate = 'passed') AS passing, count(*) FILTER (latest_gate <> 'passed') AS failing FROM pf"))
def b5b(spark, sf):
    return cmp.portfolio_totals(cmp.portfolio(audit_runs(spark, sf)))


# Workflow events: a conversation is a run, a turn is an event, a role is a phase.
EV_SQL = "CAST(conv_id AS STRING) AS scan_id, turn, role AS phase, CASE turn % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'blocked' ELSE 'running' END AS state, md5(text) AS message"
EV = f"ev AS (SELECT {EV_SQL} FROM conversations)"


def workflow_events(spark, sf):
    return inputs.table(spark, sf, "conversations").selectExpr(*inputs._split(EV_SQL))


@query("B6_run_list", o.with_([RUNS, EV, "st AS (SELECT scan_id, arg_max(state, turn) AS state FROM ev GROUP BY 1)"], "SELECT scan_id, score, state FROM ar LEFT JOIN st USING (scan_id)"))
def b6(spark, sf):
    states = cmp.latest_phase(workflow_events(spark, sf), ["scan_id"], ["turn"], ["state"]).select("scan_id", "state")
    return cmp.run_list(audit_runs(spark, sf), states).select("scan_id", "score", "state")


@query("B7_evidence_gate", fi.with_([fi.LEDGER], """SELECT site_id, run_id, array_to_string(list_filter([CASE WHEN n > 0 THEN CAST(n AS VARCHAR) || ' findings have no evidence' END, CASE WHEN app > 0 AND mea = 0 THEN 'no applicable deterministic rules were measured' END], lambda x: x IS NOT NULL), '|') AS reasons, n = 0 AND NOT (app > 0 AND mea = 0) AS ok
 FROM (SELECT site_id, run_id, count(*) FILTER (applicable) AS app, count(*) FILTER (applicable AND measured) AS mea FROM led GROUP BY 1, 2) JOIN (SELECT site_id, run_id, count(*) FILTER (evidence_count = 0) AS n FROM fnd GROUP BY 1, 2) USING (site_id, run_id)"""))
def b7(spark, sf):
    cov = s.coverage(fi.ledger(spark, sf), ["site_id", "run_id"])
    out = cmp.evidence_gate(fi.findings(spark, sf), cov)
    return out.select("site_id", "run_id", F.array_join("reasons", "|").alias("reasons"), "ok")


@query("B8_quality_gate", fi.with_([], """SELECT *, CASE WHEN stop_conditions = '' THEN 'passed' ELSE 'failed' END AS status FROM (SELECT site_id, run_id, count(*) FILTER (ord % 13 = 0) AS missing_actionability, count(*) FILTER (evidence_count = 0) AS evidence_free, count(*) FILTER (safe_to_auto_fix AND approval_required) AS invalid_safe_fixes,
 array_to_string(list_filter([CASE WHEN length(site_id) % 2 = 1 THEN 'validation failed' END, CASE WHEN count(*) FILTER (ord % 13 = 0) > 0 THEN 'findings missing actionability' END, CASE WHEN count(*) FILTER (evidence_count = 0) > 0 THEN 'findings missing evidence' END, CASE WHEN run_id = 'r0' THEN 'agent review incomplete' END], lambda x: x IS NOT NULL), '|') AS stop_conditions FROM fnd GROUP BY 1, 2)"""))
def b8(spark, sf):
    f = fi.findings(spark, sf).withColumn("owner", F.when(F.col("ord") % 13 != 0, a.owner(F.col("category"))))
    runs = fi.runs(spark, sf).select("site_id", "run_id", (F.length("site_id") % 2 == 0).alias("validation_ok"), (F.col("run_id") == "r1").alias("review_complete"))
    return cmp.quality_gate(f, runs).withColumn("stop_conditions", F.array_join("stop_conditions", "|"))


CONTRACT = {
    "finding.id": "rule_id <> ''",
    "finding.title": "title <> ''",
    "finding.confidence": "confidence BETWEEN 0 AND 100",
    "finding.evidence": "evidence_count > 0",
    "finding.recommendation": "recommendation <> ''",
    "finding.affected": "page_url IS NOT NULL OR template IS NOT NULL",
}


def check_sql(source, keys, checks):
    parts = [f"SELECT {keys}, '{n}' AS check_id, count(*) FILTER (NOT coalesce({c}, false)) AS n_bad FROM {source} GROUP BY ALL" for n, c in checks.items()]
    return "SELECT *, CASE WHEN n_bad = 0 THEN 'passed' ELSE 'failed' END AS status FROM (" + " UNION ALL ".join(parts) + ")"


@query("V1_finding_contract", fi.with_([], check_sql("fnd", "site_id, run_id", CONTRACT)))
def v1(spark, sf):
    return ck.finding_contract(fi.findings(spark, sf))


SC2 = f"sc2 AS (SELECT r.site_id, r.run_id, {qs.score('q.x')} AS total FROM runs r LEFT JOIN (SELECT site_id, run_id, sum(penalty) AS x FROM ga JOIN profs USING (category) WHERE profile = 'core_seo' GROUP BY 1, 2) q USING (site_id, run_id)), cv AS (SELECT site_id, run_id, {qs.COV} FROM led GROUP BY 1, 2), sv AS (SELECT * FROM sc2 JOIN cv USING (site_id, run_id))"
SCORE_CHECKS = {
    "score.total": "total BETWEEN 0 AND 100",
    "score.primary-profile": "total = total",
    "score.coverage": "measured_rules <= applicable_rules AND percent_measured BETWEEN 0 AND 100",
    "score.experimental-separation": "true",
}


@query("V2_score_contract", fi.with_([fi.SCOREABLE, fi.LEDGER, qs.ALLOWED, fi.grp("sca", "ga"), qs.PROFILES, SC2], check_sql("sv", "site_id, run_id", SCORE_CHECKS)))
def v2(spark, sf):
    key = ["site_id", "run_id"]
    led = materialise(fi.ledger(spark, sf), "ledger")
    runs = materialise(led.select(*key).distinct(), "runs")
    penalties = materialise(s.with_penalty(s.finding_groups(fi.findings(spark, sf))), "penalties")
    core = s.profiles_of(runs, penalties, led).filter("profile = 'core_seo'").select(*key, F.col("score").alias("core_score"))
    combined = s.composite(s.scores_by(runs, penalties, dims.AREAS, "area"))
    scores = s.primary_of(runs, penalties, led)
    for of_run in (core, s.coverage(led, key), combined):
        scores = scores.join(s.sorted_side(of_run), key)
    return ck.score_contract(scores)


V3_PLAN = {"plan.classification": "fix_class IN ('safe_auto_fix', 'approval_required', 'manual_strategy')", "plan.phases": "phase_id IS NOT NULL"}
V3_BOARD = {"dashboard.queue-title": "item_title <> ''", "dashboard.queue-owner": "owner IS NOT NULL", "dashboard.queue-gates": "NOT (safe_to_auto_fix AND approval_required)"}


@query("V3_plan_contract", fi.with_([*qs.QUEUE_CTES, f"ph AS (SELECT site_id, run_id, fix_class, {qs.PHASE} AS phase_id FROM (SELECT *, {qs.AGENT} AS agent FROM opt JOIN fst USING (site_id, run_id, rule_id)))"], check_sql("ph", "site_id, run_id", V3_PLAN) + " UNION ALL " + check_sql("items", "site_id, run_id", V3_BOARD)))
def v3(spark, sf):
    return ck.plan_contract(a.plan(qs.queue_facts(spark, sf)), qs.queue_items(spark, sf))


V4 = f"""v4 AS (SELECT site_id, 'site.pages-crawled' AS check_id, 0 AS n_bad FROM snap GROUP BY 1 UNION ALL SELECT site_id, 'jsonld.parse', CAST(sum(n_bad) AS BIGINT) FROM snap GROUP BY 1 UNION ALL SELECT site_id, 'canonical.no-private', 0 FROM snap GROUP BY 1
 UNION ALL SELECT site_id, unnest(['site.robots-probed', 'site.sitemap-probed', 'site.llms-probed']), 0 FROM snap GROUP BY 1
 UNION ALL SELECT site_id, 'llms.no-private-refs', count(*) FILTER (len({o.private_refs('body')}) > 0) FROM ep WHERE path = '/llms.txt' GROUP BY 1
 UNION ALL SELECT site_id, 'sitemap.no-private-urls', count(*) FILTER (regexp_matches(regexp_extract(loc, '^https?://[^/?#]+([^#]*)', 1), {o.q(pat.PRIVATE_ANY)})) FROM smap GROUP BY 1
 UNION ALL SELECT site_id, 'links.internal-coverage', count(DISTINCT dst) FROM links JOIN (SELECT page_id, site_id FROM rp) USING (page_id) WHERE internal AND dst NOT IN (SELECT url FROM rp) GROUP BY 1)"""


@query("V4_scan_artifacts", o.with_([*o.PAGE_CTES, o.ENDPOINTS, SMAP, V4], "SELECT site_id, check_id, CAST(n_bad AS BIGINT) AS n_bad, CASE WHEN n_bad = 0 THEN 'passed' ELSE 'failed' END AS status FROM v4"))
def v4(spark, sf):
    snap = materialise(snapshots(spark, sf), "snapshots")
    nodes, edges = g.nodes_and_edges(snap, p.page_links(snap))
    ep = inputs.endpoint_raw(spark, sf)
    return ck.scan_artifacts(snap, ep, sitemap_urls(spark, sf), g.uncrawled_links(edges, nodes)).drop("run_id")


_NEED = f"regexp_matches(lower(title || chr(10) || recommendation), {o.q(pat.APPROVAL_ANY)})"
SAFETY = {"finding.approval": f"NOT {_NEED} OR approval_required", "finding.safe-conflict": "NOT (safe_to_auto_fix AND approval_required)", "finding.private-suggestion": f"NOT regexp_matches(recommendation, {o.q(pat.PRIVATE_ANY)})"}


@query("V5_finding_safety", fi.with_([], check_sql("fnd", "site_id, run_id", SAFETY)))
def v5(spark, sf):
    return ck.finding_safety(fi.findings(spark, sf))


# Claims: orders claim, their line items cite documents, labels and parts.
LINK_SQL = "l_orderkey AS claim_id, CASE l_linenumber % 3 WHEN 0 THEN 'evidence' WHEN 1 THEN 'finding' ELSE 'artifact' END AS kind, CASE WHEN l_tax > 0 OR l_linenumber > 2 THEN CASE l_linenumber % 3 WHEN 0 THEN CAST(l_partkey AS STRING) WHEN 1 THEN CAST(l_suppkey AS STRING) ELSE CAST(l_partkey % 41 AS STRING) END END AS ref"
KNOWN = {"evidence": ("documents", "doc_id"), "finding": ("labels", "doc_id"), "artifact": ("benchmark", "item_id")}
KNOWN_SQL = " UNION ".join(f"SELECT '{k}' AS kind, CAST({c} AS VARCHAR) AS ref FROM {t}" for k, (t, c) in KNOWN.items())


@query("V6_citation_support", f"WITH l AS (SELECT {LINK_SQL} FROM lineitem), k AS ({KNOWN_SQL}) SELECT claim_id, count(ref) AS n_links, count(k_ref) AS n_found, count(ref) > 0 AND count(ref) = count(k_ref) AS supported FROM (SELECT l.claim_id, l.ref, k.ref AS k_ref FROM l LEFT JOIN k ON k.kind = l.kind AND k.ref = l.ref) GROUP BY 1")
def v6(spark, sf):
    links = inputs.table(spark, sf, "lineitem").selectExpr("'x' AS site_id", *inputs._split(LINK_SQL))
    known = {k: inputs.table(spark, sf, t).select(F.lit("x").alias("site_id"), F.col(c).cast("string").alias("ref")) for k, (t, c) in KNOWN.items()}
    return ck.citation_support(links, known, ["site_id"]).drop("site_id")


# Retrospective claims: a conversation's turns cite checks (labels) and findings (documents) by number.
RLINK_SQL = "conv_id AS claim_id, CASE WHEN turn % 2 = 0 THEN 'check' ELSE 'finding' END AS kind, CASE WHEN length(text) % 5 > 0 THEN CAST(conv_id * 2 + turn AS STRING) END AS ref"


@query("V7_retrospective_citations", f"WITH l AS (SELECT {RLINK_SQL} FROM conversations), k AS (SELECT 'check' AS kind, CAST(doc_id AS VARCHAR) AS ref FROM labels UNION SELECT 'finding', CAST(doc_id AS VARCHAR) FROM documents) SELECT claim_id, count(ref) AS n_links, count(k_ref) AS n_found, count(ref) > 0 AND count(ref) = count(k_ref) AS supported FROM (SELECT l.claim_id, l.ref, k.ref AS k_ref FROM l LEFT JOIN k ON k.kind = l.kind AND k.ref = l.ref) GROUP BY 1")
def v7(spark, sf):
    links = inputs.table(spark, sf, "conversations").selectExpr("'x' AS site_id", *inputs._split(RLINK_SQL))
    known = {k: inputs.table(spark, sf, t).select(F.lit("x").alias("site_id"), F.col("doc_id").cast("string").alias("ref")) for k, t in (("check", "labels"), ("finding", "documents"))}
    return ck.citation_support(links, known, ["site_id"]).drop("site_id")


IDS_SQL = "replace(html, '<article>', '<article id=\"main\"><a href=\"#none\">x</a>' || CASE WHEN page_id % 3 = 0 THEN '<p id=\"main\">' ELSE '' END || '<a href=\"#main\">y</a>') AS html2"


@query("V8_html_ids", f"SELECT page_id, len(ids) - len(list_distinct(ids)) AS n_duplicate_ids, len(list_filter(list_distinct(tg), lambda t: NOT list_contains(ids, t))) AS n_dangling FROM (SELECT page_id, regexp_extract_all(html2, {o.q(ck.ID_ATTR)}, 1) AS ids, regexp_extract_all(html2, {o.q(ck.TARGET_ATTR)}, 1) AS tg FROM (SELECT page_id, {IDS_SQL} FROM pages))")
def v8(spark, sf):
    rows = inputs.dealt(inputs.table(spark, sf, "pages")).selectExpr("page_id", IDS_SQL)
    out = ck.html_id_checks(rows, ["page_id"], "html2")
    return out.select("page_id", F.col("n_duplicate_ids").cast("long").alias("n_duplicate_ids"), F.col("n_dangling").cast("long").alias("n_dangling"))


REV_SQL = "conv_id, text || CASE turn % 4 WHEN 0 THEN ' certified' WHEN 1 THEN ' noindex' ELSE '' END AS text, CASE WHEN turn % 2 = 0 THEN 'approval_required' ELSE 'not_required' END AS approval_state, turn % 3 = 0 AS safe_to_apply"


@query("V9_review_contract", f"WITH r AS (SELECT {REV_SQL} FROM conversations) " + check_sql("r", "conv_id", {"review.approval": f"NOT regexp_matches(text, {o.q(pat.REVIEW_APPROVAL)}) OR approval_state = 'approval_required'", "review.safe-boundary": "NOT safe_to_apply OR approval_state <> 'approval_required'", "review.text": "length(text) > 0"}))
def v9(spark, sf):
    return ck.review_contract(inputs.table(spark, sf, "conversations").selectExpr(*inputs._split(REV_SQL)), ["conv_id"])


LEARN_SQL = "conv_id, CASE turn % 4 WHEN 0 THEN 'improvement' WHEN 1 THEN 'blocker' WHEN 2 THEN 'learning' ELSE 'note' END AS kind, CASE WHEN turn = 5 THEN ' ' ELSE text END AS text, turn % 3 AS n_evidence"


@query("V10_learning_contract", f"WITH r AS (SELECT {LEARN_SQL} FROM conversations) " + check_sql("r", "conv_id", {"learning.kind": "kind IN ('improvement', 'blocker', 'learning')", "learning.text": "length(trim(text)) > 0", "learning.evidence": "n_evidence > 0"}))
def v10(spark, sf):
    return ck.learning_contract(inputs.table(spark, sf, "conversations").selectExpr(*inputs._split(LEARN_SQL)), ["conv_id"])


@query("V11_check_counts", fi.with_(["chk AS (" + check_sql("fnd", "site_id, run_id", CONTRACT) + ")"], "SELECT site_id, run_id, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, 0::BIGINT AS warning, 0::BIGINT AS not_applicable FROM chk GROUP BY 1, 2"))
def v11(spark, sf):
    return ck.check_counts(ck.finding_contract(fi.findings(spark, sf)))


@query("V11_attention_list", fi.with_(["chk AS (" + check_sql("fnd", "site_id, run_id", CONTRACT) + ")"], "SELECT site_id, run_id, check_id FROM chk WHERE status = 'failed'"))
def v11b(spark, sf):
    return ck.attention(ck.finding_contract(fi.findings(spark, sf))).select("site_id", "run_id", "check_id")


@query("V12_standards_snapshot", "WITH r AS (SELECT p_size, count(*) AS n_rules, count(*) FILTER (p_partkey % 50 = 1) AS n_implemented FROM part GROUP BY 1), st AS (SELECT s_suppkey % 60 AS p_size, count(*) AS n_standards FROM supplier GROUP BY 1), j AS (SELECT p_size, n_rules, n_implemented, coalesce(n_standards, 0) AS n_standards FROM r LEFT JOIN st USING (p_size)) " + check_sql("j", "p_size", {"standards.snapshot-standards": "n_standards > 0", "standards.snapshot-rule-mapping": "n_rules > 0", "standards.snapshot-rule-count": "n_implemented > 0"}))
def v12(spark, sf):
    rules = inputs.table(spark, sf, "part").select("p_size", (F.col("p_partkey") % 50 == 1).alias("implemented"))
    standards = inputs.table(spark, sf, "supplier").select((F.col("s_suppkey") % 60).cast("int").alias("p_size"))
    return ck.standards_snapshot(rules, standards, ["p_size"])


@query("V13_missing_artifacts", "SELECT DISTINCT e.site_id, e.path FROM (SELECT DISTINCT l_suppkey AS site_id, 'artifact-' || CAST(l_partkey % 40 AS VARCHAR) AS path FROM lineitem) e WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey % 100 = e.site_id AND 'artifact-' || CAST(p.p_size AS VARCHAR) = e.path)")
def v13(spark, sf):
    c = F.col
    art = lambda x: F.concat(F.lit("artifact-"), x.cast("string")).alias("path")
    expected = inputs.table(spark, sf, "lineitem").select(c("l_suppkey").alias("site_id"), art(c("l_partkey") % 40)).distinct()
    written = inputs.table(spark, sf, "part").select((c("p_partkey") % 100).alias("site_id"), art(c("p_size")))
    return ck.missing_artifacts(expected, written, ["site_id"])


@query("V14_field_contract", "WITH r AS (SELECT o_custkey, CASE o_orderkey % 6 WHEN 0 THEN 'disabled' WHEN 1 THEN 'ok' WHEN 2 THEN 'partial' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'failed' ELSE 'odd' END AS status, o_orderkey % 5 <> 0 AS good FROM orders) " + check_sql("r", "o_custkey", {"field-data.status": "status <> 'odd'", "field-data.providers": "good"}))
def v14(spark, sf):
    c = F.col
    names = F.array(*[F.lit(x) for x in ("disabled", "ok", "partial", "unavailable", "failed", "odd")])
    rows = inputs.table(spark, sf, "orders").select(
        "o_custkey", F.element_at(names, (c("o_orderkey") % 6).cast("int") + 1).alias("status"),
        F.when(c("o_orderkey") % 5 != 0, F.array(F.lit("crux"), F.lit("rum"))).otherwise(F.array(F.lit("gsc"), F.lit("other"))).alias("providers"),
    )
    return ck.field_contract(rows, ["o_custkey"])


COMPLETE_SQL = "conv_id, CASE turn % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'blocked' ELSE 'running' END AS status, CASE turn % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'complete' WHEN 2 THEN 'invalid' ELSE 'x' END AS retrospective_status, turn AS n_checks"


@query("V15_completion_contract", f"WITH r AS (SELECT {COMPLETE_SQL} FROM conversations) " + check_sql("r", "conv_id", {"workflow-completion.status": "status IN ('complete', 'blocked')", "workflow-completion.retrospective-status": "retrospective_status <> 'x'", "workflow-completion.checks": "n_checks > 0"}))
def v15(spark, sf):
    return ck.completion_contract(inputs.table(spark, sf, "conversations").selectExpr(*inputs._split(COMPLETE_SQL)), ["conv_id"])


@query("B9_verification_manifest", fi.with_([fi.SCOREABLE, qs.GRP, qs.PROFILES, SCOPE, CMP, "chk AS (" + check_sql("fnd", "site_id, run_id", CONTRACT) + ")"], "SELECT site_id, run_id, total, n_checks, n_failed, n_failed = 0 AS ok FROM tots JOIN (SELECT site_id, run_id, count(*) AS n_checks, count(*) FILTER (status = 'failed') AS n_failed FROM chk GROUP BY 1, 2) USING (site_id, run_id)"))
def b9(spark, sf):
    f, runs = fi.findings(spark, sf), fi.runs(spark, sf)
    return cmp.verification_manifest(runs, s.primary_total(runs, f, None), ck.finding_contract(f))


@query("B10_latest_phase", o.with_([EV], "SELECT scan_id, phase, arg_max(state, turn) AS state, arg_max(message, turn) AS message, count(*) AS n_events FROM ev GROUP BY 1, 2"))
def b10(spark, sf):
    return cmp.latest_phase(workflow_events(spark, sf), ["scan_id", "phase"], ["turn"], ["state", "message"])


@query("B11_pending_decisions", "SELECT c_custkey AS decision_id, coalesce(s, 'pending') AS status FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, arg_max(CASE o_orderstatus WHEN 'O' THEN 'approved' WHEN 'F' THEN 'rejected' ELSE 'deferred' END, o_orderkey) AS s FROM orders GROUP BY 1) USING (c_custkey)")
def b11(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "approved").when(F.col("o_orderstatus") == "F", "rejected").otherwise("deferred")
    events = inputs.table(spark, sf, "orders").select(F.col("o_custkey").alias("decision_id"), status.alias("status"), F.col("o_orderkey").alias("decided_at"))
    return cmp.pending_decisions(inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("decision_id")), events, ["decision_id"])


@query("J24_baseline_summary", fi.with_([SCOPE], "SELECT r.site_id, CASE WHEN c.n_new IS NULL THEN 'not_configured' ELSE 'ok' END AS status, coalesce(c.n_new, 0) AS n_new, coalesce(c.n_resolved, 0) AS n_resolved, coalesce(c.n_recurring, 0) AS n_recurring, coalesce(c.n_recurring, 0) AS n_unchanged FROM (SELECT DISTINCT site_id FROM runs) r LEFT JOIN (SELECT site_id, count(*) FILTER (change = 'new') AS n_new, count(*) FILTER (change = 'resolved') AS n_resolved, count(*) FILTER (change = 'recurring') AS n_recurring FROM (SELECT site_id, rule_id, CASE WHEN bool_or(run_id = 'r1') AND bool_or(run_id = 'r0') THEN 'recurring' WHEN bool_or(run_id = 'r1') THEN 'new' ELSE 'resolved' END AS change FROM fnd WHERE length(site_id) % 2 = 0 GROUP BY 1, 2) GROUP BY 1) c USING (site_id)"))
def j24(spark, sf):
    diff = cmp.baseline_diff(*sides(spark, sf)).withColumn("severity", F.lit("low"))
    zero = fi.runs(spark, sf).select("site_id").distinct().select("site_id", F.lit(0).alias("before"), F.lit(0).alias("after"))
    configured = zero.filter(F.length("site_id") % 2 == 0)
    return cmp.baseline_summary(zero, cmp.run_comparison(diff, configured))


@query("V4_bounded_payloads", "SELECT l_suppkey, 'performance.resources-bounded' AS check_id, CAST(count(*) > 600 AS BIGINT) AS n_bad, CASE WHEN count(*) <= 600 THEN 'passed' ELSE 'failed' END AS status FROM lineitem GROUP BY 1")
def v4b(spark, sf):
    counts = inputs.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return ck.bounded_payloads(counts, ["l_suppkey"], 600)
