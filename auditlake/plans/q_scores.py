"""Queries over rules, scores, actions and the queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions.numeric import lookup
from auditlake.operators import actions as a
from auditlake.operators import rules as r
from auditlake.operators import scoring as s
from auditlake.plans import findings_input as fi
from auditlake.plans import inputs
from auditlake.plans.registry import query
from auditlake.session import materialise

SCORE = "CAST(greatest(0, least(100, floor(round(100.0::DOUBLE - coalesce({x}, 0), 6) + 0.5))) AS INT)"


def score(x):
    return SCORE.replace("{x}", x)


LEVEL = "CASE WHEN {x} >= 90 THEN 'excellent' WHEN {x} >= 75 THEN 'strong' WHEN {x} >= 60 THEN 'medium' WHEN {x} >= 40 THEN 'weak' ELSE 'critical' END"
GRP = fi.grp("sc", "grp")
ALLOWED = "sca AS (SELECT sc.* FROM sc SEMI JOIN (SELECT * FROM led WHERE maturity = 'stable' AND measured) l ON l.site_id = sc.site_id AND l.run_id = sc.run_id AND l.rule_id = sc.rule_id)"
AREAS = fi.areas_cte(dims.AREAS, "areas", "area")
PROFILES = fi.areas_cte(dims.PROFILES, "profs", "profile")


@query("R5_coverage_ledger", fi.with_([fi.LEDGER], "SELECT * FROM led"))
def r5(spark, sf):
    return fi.ledger(spark, sf)


@query("R6_rule_maturity", fi.with_([], "SELECT site_id, CASE WHEN regexp_matches(rule_id, '^(AR-(LLMS|MD|SKILL|MCP|API)|SEO-SEARCH)-') THEN 'experimental' WHEN starts_with(rule_id, 'AR-') THEN 'emerging' ELSE 'stable' END AS maturity, count(*) AS n FROM fnd GROUP BY 1, 2"))
def r6(spark, sf):
    f = fi.findings(spark, sf)
    return f.groupBy("site_id", r.maturity(F.col("rule_id")).alias("maturity")).agg(F.count("*").alias("n"))


@query("R7_catalogue_integrity", """WITH m AS (SELECT 'rule-' || CAST(p_partkey % 500 AS VARCHAR) AS rule_id, 'std-' || CAST(p_size AS VARCHAR) AS standard FROM part), c AS (SELECT DISTINCT 'rule-' || CAST(l_partkey % 450 AS VARCHAR) AS rule_id, 'std-' || CAST(l_partkey % 50 AS VARCHAR) AS standard FROM lineitem),
 st AS (SELECT DISTINCT 'std-' || CAST(p_size % 40 AS VARCHAR) AS standard FROM part)
 SELECT 'duplicate-rule' AS check_id, rule_id FROM c GROUP BY rule_id HAVING count(*) > 1 UNION ALL SELECT 'duplicate-mapping', rule_id FROM m GROUP BY rule_id HAVING count(*) > 1 UNION ALL SELECT 'duplicate-standard', standard FROM st GROUP BY standard HAVING count(*) > 1
 UNION ALL SELECT 'unmapped-rule', rule_id FROM c WHERE rule_id NOT IN (SELECT rule_id FROM m) UNION ALL SELECT 'unknown-rule', rule_id FROM m WHERE rule_id NOT IN (SELECT rule_id FROM c)
 UNION ALL SELECT 'unknown-standard', rule_id FROM m WHERE standard NOT IN (SELECT standard FROM st) UNION ALL SELECT 'standard-mismatch', m.rule_id FROM m JOIN c USING (rule_id) WHERE m.standard <> c.standard""")
def r7(spark, sf):
    part, line = inputs.table(spark, sf, "part"), inputs.table(spark, sf, "lineitem")
    mapping = part.selectExpr("'rule-' || CAST(p_partkey % 500 AS STRING) AS rule_id", "'std-' || CAST(p_size AS STRING) AS standard")
    rules = line.selectExpr("'rule-' || CAST(l_partkey % 450 AS STRING) AS rule_id", "'std-' || CAST(l_partkey % 50 AS STRING) AS standard").distinct()
    standards = part.selectExpr("'std-' || CAST(p_size % 40 AS STRING) AS standard").distinct()
    return r.catalogue_integrity(rules, mapping, standards)


@query("R8_standards_snapshot", fi.with_([], f"SELECT site_id, run_id, count(DISTINCT rule_id) AS rules_seen, count(DISTINCT rule_id) FILTER (rule_id LIKE 'AR-%') AS agent_rules FROM fnd GROUP BY 1, 2"))
def r8(spark, sf):
    seen = fi.findings(spark, sf).select("site_id", "run_id", "rule_id").distinct()
    return seen.groupBy("site_id", "run_id").agg(
        F.count("*").alias("rules_seen"), F.count_if(F.col("rule_id").startswith("AR-")).alias("agent_rules")
    )


@query("C1_finding_groups", fi.with_([fi.SCOREABLE, GRP], "SELECT site_id, run_id, rule_id, title, category, severity, n_findings, confidence, n_urls, n_templates FROM grp"))
def c1(spark, sf):
    return s.finding_groups(fi.findings(spark, sf))


@query("C2_group_penalty", fi.with_([fi.SCOREABLE, GRP], "SELECT site_id, run_id, rule_id, severity, round(penalty, 6) AS penalty FROM grp"))
def c2(spark, sf):
    g = s.with_penalty(s.finding_groups(fi.findings(spark, sf)))
    return g.select("site_id", "run_id", "rule_id", "severity", F.round("penalty", 6).alias("penalty"))


AREA_SCORES = f"ars AS (SELECT r.site_id, r.run_id, a.area, {score('p.x')} AS score FROM runs r CROSS JOIN (SELECT DISTINCT area FROM areas) a LEFT JOIN (SELECT site_id, run_id, area, sum(penalty) AS x FROM grp JOIN areas USING (category) GROUP BY 1, 2, 3) p USING (site_id, run_id, area))"


def area_scores(spark, sf):
    g = s.with_penalty(s.finding_groups(fi.findings(spark, sf)))
    return s.scores_by(fi.runs(spark, sf), g, dims.AREAS, "area")


@query("C3_area_scores", fi.with_([fi.SCOREABLE, GRP, AREAS, AREA_SCORES], "SELECT * FROM ars"))
def c3(spark, sf):
    return area_scores(spark, sf)


@query("C4_primary_total", fi.with_([fi.SCOREABLE, fi.LEDGER, ALLOWED, fi.grp("sca", "ga"), PROFILES], f"SELECT site_id, run_id, total, {LEVEL.replace('{x}', 'total')} AS level FROM (SELECT r.site_id, r.run_id, {score('p.x')} AS total FROM runs r LEFT JOIN (SELECT site_id, run_id, sum(penalty) AS x FROM ga JOIN profs USING (category) WHERE profile = 'core_seo' GROUP BY 1, 2) p USING (site_id, run_id))"))
def c4(spark, sf):
    return s.primary_total(fi.runs(spark, sf), fi.findings(spark, sf), fi.ledger(spark, sf))


W = "CASE area " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.AREA_WEIGHTS.items()) + " END"


@query("C5_composite", fi.with_([fi.SCOREABLE, GRP, AREAS, AREA_SCORES], f"SELECT site_id, run_id, CAST(floor(round(sum(score * {W})::DOUBLE / sum({W})::DOUBLE, 6) + 0.5) AS INT) AS experimental_combined FROM ars GROUP BY 1, 2"))
def c5(spark, sf):
    return s.composite(area_scores(spark, sf))


COV = """count(*) AS catalog_rules, count(*) FILTER (applicable) AS applicable_rules, count(*) FILTER (applicable AND measured) AS measured_rules, count(*) FILTER (applicable AND measured AND status = 'passed') AS passed_rules,
 count(*) FILTER (applicable AND measured AND status = 'failed') AS failed_rules, count(*) FILTER (status = 'not_applicable') AS not_applicable_rules, count(*) FILTER (applicable AND status = 'not_measured') AS not_measured_rules,
 CASE WHEN count(*) FILTER (applicable) = 0 THEN 0 ELSE CAST(floor(count(*) FILTER (applicable AND measured) * 100.0::DOUBLE / count(*) FILTER (applicable) + 0.5) AS INT) END AS percent_measured"""


@query("C6_score_profiles", fi.with_([fi.SCOREABLE, fi.LEDGER, ALLOWED, GRP, fi.grp("sca", "ga"), PROFILES, f"cov AS (SELECT site_id, run_id, profile, {COV} FROM led JOIN profs USING (category) GROUP BY 1, 2, 3)",
    "pen AS (SELECT site_id, run_id, profile, sum(penalty) AS x FROM (SELECT ga.*, profile FROM ga JOIN profs USING (category) WHERE profile = 'core_seo' UNION ALL SELECT grp.*, profile FROM grp JOIN profs USING (category) WHERE profile <> 'core_seo') GROUP BY 1, 2, 3)",
    f"ps AS (SELECT r.site_id, r.run_id, p.profile, {score('pen.x')} AS score FROM runs r CROSS JOIN (SELECT DISTINCT profile FROM profs) p LEFT JOIN pen USING (site_id, run_id, profile))"],
    f"SELECT ps.*, {LEVEL.replace('{x}', 'score')} AS level, cov.* EXCLUDE (site_id, run_id, profile) FROM ps LEFT JOIN cov USING (site_id, run_id, profile)"))
def c6(spark, sf):
    return s.profiles(fi.runs(spark, sf), fi.findings(spark, sf), fi.ledger(spark, sf))


@query("C7_coverage", fi.with_([fi.LEDGER], f"SELECT site_id, run_id, {COV} FROM led GROUP BY 1, 2"))
def c7(spark, sf):
    return s.coverage(fi.ledger(spark, sf), ["site_id", "run_id"])


@query("C8_score_level", f"SELECT l_orderkey, l_linenumber, {LEVEL.replace('{x}', '(l_quantity * 2)')} AS level FROM lineitem")
def c8(spark, sf):
    return inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", s.level(F.col("l_quantity") * 2).alias("level"))


SEV_COUNTS = ", ".join(f"count(*) FILTER (severity = '{x}') AS n_{x}" for x in dims.SEVERITIES)
SEV_TEXT = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN n_{x} > 0 THEN CAST(n_{x} AS VARCHAR) || ' {x}' END" for x in dims.SEVERITIES) + "], lambda x: x IS NOT NULL), ', ')"


@query("C9_category_notes", fi.with_([fi.SCOREABLE, GRP, AREAS], f"SELECT *, {SEV_TEXT} AS by_severity FROM (SELECT site_id, run_id, area, count(*) AS unique_issues, CAST(sum(greatest(n_urls, n_findings)) AS BIGINT) AS url_references, {SEV_COUNTS} FROM grp JOIN areas USING (category) GROUP BY 1, 2, 3)"))
def c9(spark, sf):
    return s.category_notes(s.finding_groups(fi.findings(spark, sf)))


SEVS = "(VALUES " + ", ".join(f"('{x}')" for x in dims.SEVERITIES) + ") sev(severity)"


@query("C10_severity_counts", fi.with_([], f"SELECT r.site_id, r.run_id, sev.severity, count(f.ord) AS n FROM runs r CROSS JOIN {SEVS} LEFT JOIN fnd f ON f.site_id = r.site_id AND f.run_id = r.run_id AND f.severity = sev.severity GROUP BY 1, 2, 3"))
def c10(spark, sf):
    f = fi.findings(spark, sf)
    return s.severity_counts(fi.runs(spark, sf), f)


# --- actionability and queue --------------------------------------------------------------------------------
OWNER = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.OWNERS.items()) + " ELSE 'unknown' END"
IMPACT = "CASE WHEN severity IN ('critical', 'high') THEN 'high' WHEN severity = 'medium' THEN 'medium' ELSE 'low' END"
NSRC = "(ord % 4)"


@query("J1_owner", fi.with_([], f"SELECT site_id, {OWNER} AS owner, count(*) AS n FROM fnd GROUP BY 1, 2"))
def j1(spark, sf):
    return fi.findings(spark, sf).groupBy("site_id", a.owner(F.col("category")).alias("owner")).agg(F.count("*").alias("n"))


# Repository files: parts stand for files of the sites' repositories.
FILE_SQL = """'https://s' || CAST(p_partkey % 100 AS STRING) || '.example' AS site_id, p_partkey AS ord, CASE p_partkey % 9 WHEN 0 THEN 'app/blog/page' || CAST(p_partkey AS STRING) || '.tsx' WHEN 1 THEN 'public/robots.txt' WHEN 2 THEN 'src/sitemap.ts' WHEN 3 THEN 'app/layout.tsx'
 WHEN 4 THEN 'next.config.js' WHEN 5 THEN 'vercel.json' WHEN 6 THEN 'public/img/' || CAST(p_size AS STRING) || '.png' WHEN 7 THEN 'content/posts/' || CAST(p_partkey AS STRING) || '.md' ELSE 'src/pages/index.tsx' END AS path,
 CASE p_partkey % 9 WHEN 0 THEN 'route' WHEN 1 THEN 'robots' WHEN 2 THEN 'sitemap' WHEN 3 THEN 'metadata' WHEN 4 THEN 'framework_config' WHEN 5 THEN 'deployment' WHEN 6 THEN 'static_asset' WHEN 7 THEN 'content' ELSE 'route' END AS kind"""


@query("J2_source_candidates", fi.with_([f"files AS (SELECT {FILE_SQL} FROM part)", "fk AS (SELECT DISTINCT site_id, rule_id, category FROM fnd)",
    """rt AS (SELECT site_id, rule_id, unnest(generate_series(1, len(ks))) AS prio, unnest(ks) AS kind, lim FROM (SELECT site_id, rule_id, CASE WHEN contains(r, 'robots') THEN ['robots'] WHEN contains(r, 'sitemap') THEN ['sitemap'] WHEN regexp_matches(r, 'llms|mcp|api|auth') THEN ['t1']
 WHEN category IN ('onpage_seo', 'indexability', 'structured_data', 'international_seo') OR regexp_matches(r, 'schema|canonical') THEN ['metadata', 'route', 't2'] WHEN category IN ('content_seo', 'internal_linking') THEN ['content', 'route'] WHEN category IN ('media_seo', 'accessibility') THEN ['route', 'static_asset']
 WHEN category IN ('performance_seo', 'technical_seo') THEN ['deployment', 'framework_config', 'route'] WHEN category IN ('security', 'policy') THEN ['robots', 'sitemap', 'metadata', 'deployment'] ELSE ['route'] END AS ks,
 CASE WHEN contains(r, 'robots') OR contains(r, 'sitemap') OR regexp_matches(r, 'llms|mcp|api|auth') OR category IN ('crawlability', 'javascript_seo', 'local_seo', 'ecommerce_seo', 'agent_readiness', 'protocol_discovery', 'api_auth_mcp') AND NOT regexp_matches(r, 'schema|canonical') THEN 5 ELSE 8 END AS lim FROM (SELECT *, lower(rule_id) AS r FROM fk)))""",
    "ranked AS (SELECT rt.site_id, rt.rule_id, rt.lim, f.path, row_number() OVER (PARTITION BY rt.site_id, rt.rule_id ORDER BY prio, f.ord, f.path) AS rank FROM rt JOIN files f ON f.site_id = rt.site_id AND (f.kind = rt.kind OR rt.kind = 't1' AND regexp_matches(f.path, 'llms|mcp|api|auth|well-known|public') OR rt.kind = 't2' AND regexp_matches(f.path, 'seo|metadata|head|layout|document')))"],
    "SELECT site_id, rule_id, rank, path FROM ranked WHERE rank <= lim"))
def j2(spark, sf):
    files = inputs.table(spark, sf, "part").selectExpr(*inputs._split(FILE_SQL))
    kinds = fi.findings(spark, sf).select("site_id", "rule_id", "category").distinct()
    return a.source_candidates(kinds, files).select("site_id", "rule_id", F.col("rank").cast("long").alias("rank"), "path")


READY = f"CASE WHEN approval_required THEN 'approval_required' WHEN {NSRC} > 0 THEN 'repo_assisted' WHEN safe_to_auto_fix THEN 'auto' ELSE 'manual' END"


def actionable(spark, sf):
    f = fi.findings(spark, sf)
    return a.actionability(f, F.col("run_id") == "r1", F.col("ord") % 4)


@query("J3_actionability", fi.with_([], f"""SELECT site_id, ord, rule_id, {READY} AS readiness, {IMPACT} AS expected_impact, CASE WHEN approval_required THEN 'get_approval' WHEN {NSRC} > 0 THEN 'edit_source' ELSE 'edit_site' END AS next_step,
 array_to_string(list_filter([CASE WHEN approval_required THEN 'owner approval required' END, CASE WHEN run_id <> 'r1' THEN 'website source repo not connected' WHEN {NSRC} = 0 THEN 'no confident source candidate found' END, CASE WHEN evidence_count = 0 THEN 'missing evidence' END], lambda x: x IS NOT NULL), '|') AS blockers FROM fnd"""))
def j3(spark, sf):
    return actionable(spark, sf).select("site_id", "ord", "rule_id", "readiness", "expected_impact", "next_step", F.array_join("blockers", "|").alias("blockers"))


FIRST = "fst AS (SELECT site_id, run_id, rule_id, arg_min(title, ord) AS title, arg_min(severity, ord) AS severity, arg_min(category, ord) AS category, arg_min(approval_required, ord) AS approval_required, arg_min(safe_to_auto_fix, ord) AS safe_to_auto_fix, arg_min(n_affected, ord) AS n_affected FROM fnd GROUP BY 1, 2, 3)"
OPTS = "opt AS (SELECT site_id, run_id, rule_id, recommendation, fix_class, min(ord) AS ord, arg_min(effort, ord) AS effort, arg_min(risk, ord) AS risk FROM fnd GROUP BY 1, 2, 3, 4, 5)"
SEVRANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
PLAN_ORDER = f"{SEVRANK}, CASE fix_class WHEN 'safe_auto_fix' THEN 0 WHEN 'approval_required' THEN 1 ELSE 2 END, -n_affected, CASE effort WHEN 'small' THEN 0 ELSE 1 END, ord, rule_id"
PHASE = """CASE WHEN fix_class = 'approval_required' THEN 'user_decision_required' WHEN severity IN ('critical', 'high') AND NOT agent THEN 'do_now_seo' WHEN severity IN ('critical', 'high') THEN 'do_now_agent' WHEN severity = 'medium' AND NOT agent THEN 'do_next_seo'
 WHEN severity IN ('medium', 'low') AND agent THEN 'do_next_agent' WHEN severity IN ('low', 'info') AND NOT agent THEN 'later' END"""
AGENT = "category IN ('agent_readiness', 'protocol_discovery', 'api_auth_mcp', 'policy')"


def queue_facts(spark, sf):
    return materialise(a.queue_facts(fi.findings(spark, sf)), "queue-facts")


@query("J4_option_order", fi.with_([FIRST, OPTS], f"SELECT site_id, run_id, rule_id, row_number() OVER (PARTITION BY site_id, run_id ORDER BY {PLAN_ORDER}) AS plan_rank FROM opt JOIN fst USING (site_id, run_id, rule_id)"))
def j4(spark, sf):
    return a.plan(queue_facts(spark, sf)).select("site_id", "run_id", "rule_id", "plan_rank")


@query("J5_unique_options", fi.with_([OPTS], "SELECT * FROM opt"))
def j5(spark, sf):
    return a.unique_options(queue_facts(spark, sf)).select("site_id", "run_id", "rule_id", "recommendation", "fix_class", "ord", "effort", "risk")


@query("J6_phases", fi.with_([FIRST, OPTS], f"SELECT site_id, run_id, rule_id, {PHASE} AS phase_id FROM (SELECT *, {AGENT} AS agent FROM opt JOIN fst USING (site_id, run_id, rule_id))"))
def j6(spark, sf):
    return a.plan(queue_facts(spark, sf)).select("site_id", "run_id", "rule_id", "phase_id")


@query("J7_fix_class_split", fi.with_([OPTS], "SELECT site_id, run_id, fix_class, count(*) AS n FROM opt GROUP BY 1, 2, 3 UNION ALL SELECT site_id, run_id, 'policy', CASE WHEN run_id = 'r1' THEN 3 ELSE 1 END FROM runs"))
def j7(spark, sf):
    opts = a.unique_options(a.queue_facts(fi.findings(spark, sf))).groupBy("site_id", "run_id", "fix_class").agg(F.count("*").alias("n"))
    new = F.col("run_id") == "r1"
    pol = fi.runs(spark, sf).select(
        "site_id", "run_id", F.when(new, "ask").otherwise("no").alias("ai_input"), F.when(new, "ask").otherwise("yes").alias("ai_train"),
        F.lit("read").alias("mcp_mutations"), F.lit("disabled").alias("commerce_actions"),
    )
    policy = a.policy_options(pol).groupBy("site_id", "run_id").agg(F.count("*").alias("n")).withColumn("fix_class", F.lit("policy"))
    return opts.unionByName(policy)


@query("X9_policy_options", fi.with_([], "SELECT site_id, run_id, unnest(CASE WHEN run_id = 'r1' THEN ['DECISION-AI-INPUT', 'DECISION-AI-TRAIN', 'DECISION-MCP-MUTATIONS'] ELSE ['DECISION-MCP-MUTATIONS', 'DECISION-COMMERCE-ACTIONS'] END) AS option_id FROM runs"))
def x9(spark, sf):
    new = F.col("run_id") == "r1"
    pol = fi.runs(spark, sf).select(
        "site_id", "run_id", F.when(new, "ask").otherwise("no").alias("ai_input"), F.when(new, "ask").otherwise("yes").alias("ai_train"),
        F.lit("read").alias("mcp_mutations"), F.when(new, "disabled").otherwise("enabled").alias("commerce_actions"),
    )
    return a.policy_options(pol)


@query("X8_enforce_approval", fi.with_([], "SELECT site_id, run_id, ord, CASE WHEN regexp_matches(lower(title || chr(10) || recommendation), '" + "|".join(__import__("auditlake.functions.privacy_patterns", fromlist=["x"]).APPROVAL_TERMS) + "') THEN 'approval_required' ELSE fix_class END AS fix_class FROM fnd"))
def x8(spark, sf):
    f = fi.findings(spark, sf).withColumnRenamed("fix_class", "declared_fix_class")
    return r.enforce_approval(f).select("site_id", "run_id", "ord", "fix_class")


PREFIX_SQL = "(VALUES ('ai-input-policy', 'AR-ROBOTS-004'), ('ai-training-policy', 'AR-ROBOTS-004'), ('mcp-publication', 'AR-MCP-'), ('authenticated-agent-access', 'AR-AUTH-'), ('indexnow', 'SEO-SEARCH-')) d(decision_id, prefix)"


@query("J8_relevant_decisions", fi.with_([], f"SELECT DISTINCT site_id, run_id, decision_id FROM fnd JOIN {PREFIX_SQL} ON starts_with(rule_id, prefix)"))
def j8(spark, sf):
    return a.relevant_decisions(fi.findings(spark, sf))


@query("J9_decision_queue", fi.with_([], f"SELECT DISTINCT site_id, run_id, decision_id, 'policy' AS kind FROM fnd JOIN {PREFIX_SQL} ON starts_with(rule_id, prefix) UNION ALL SELECT DISTINCT site_id, run_id, 'finding-' || lower(rule_id), 'approval' FROM fnd WHERE fix_class = 'approval_required'"))
def j9(spark, sf):
    return a.decision_queue(fi.findings(spark, sf))


QG = "qg AS (SELECT site_id, run_id, rule_id, title, severity, category, count(*) AS n_findings, bool_or(safe_to_auto_fix) AS safe_to_auto_fix, bool_or(approval_required) AS approval_required, CAST(sum(evidence_count) AS BIGINT) AS n_evidence, min(ord) AS first_ord, count(DISTINCT page_url) AS n_urls FROM fnd GROUP BY 1, 2, 3, 4, 5, 6)"


@query("J10_queue_groups", fi.with_([QG], "SELECT * FROM qg"))
def j10(spark, sf):
    return a.finding_groups(fi.findings(spark, sf))


@query("J11_formatted_sets", fi.with_([], "SELECT site_id, rule_id, array_to_string(list_sort(list(DISTINCT page_url))[1:8], ', ') || CASE WHEN count(DISTINCT page_url) > 8 THEN ' plus ' || CAST(count(DISTINCT page_url) - 8 AS VARCHAR) || ' more' ELSE '' END AS text FROM fnd WHERE page_url IS NOT NULL GROUP BY 1, 2"))
def j11(spark, sf):
    urls = fi.findings(spark, sf).select("site_id", "rule_id", F.explode("affected_urls").alias("url"))
    return a.format_sample(urls, ["site_id", "rule_id"], "url")


LASTG = f"lg AS (SELECT site_id, run_id, rule_id, arg_max(n_findings, {SEVRANK} * 1000000 - n_findings) AS instances, arg_max(n_evidence, {SEVRANK} * 1000000 - n_findings) AS n_evidence FROM qg GROUP BY 1, 2, 3)"
# The reference has an option for each emitted finding; here the safe ones of the first run have none, to exercise the rest.
QUEUE = f"""opt2 AS (SELECT * FROM opt WHERE NOT (run_id = 'r0' AND fix_class = 'safe_auto_fix')),
qi AS (SELECT o.site_id, o.run_id, lower(o.rule_id) || '-' || lower(o.rule_id) || '-fix' AS item_id, o.rule_id, o.recommendation AS item_title, f.severity, f.category, o.fix_class, o.effort, o.risk, o.fix_class = 'approval_required' OR f.approval_required AS approval_required, o.fix_class = 'safe_auto_fix' AND NOT f.approval_required AS safe_to_auto_fix, g.instances, g.n_evidence
 FROM opt2 o JOIN fst f USING (site_id, run_id, rule_id) JOIN lg g USING (site_id, run_id, rule_id)
 UNION ALL SELECT f.site_id, f.run_id, lower(f.rule_id) || '-finding', f.rule_id, f.title, f.severity, f.category, CASE WHEN f.approval_required THEN 'approval_required' WHEN f.safe_to_auto_fix THEN 'safe_auto_fix' ELSE 'manual_strategy' END, CASE WHEN f.severity IN ('critical', 'high') THEN 'medium' ELSE 'small' END,
 CASE WHEN f.approval_required THEN 'high' WHEN f.severity = 'critical' THEN 'medium' ELSE 'low' END, f.approval_required, f.safe_to_auto_fix, g.instances, g.n_evidence FROM fst f JOIN lg g USING (site_id, run_id, rule_id) WHERE NOT EXISTS (SELECT 1 FROM opt2 o WHERE o.site_id = f.site_id AND o.run_id = f.run_id AND o.rule_id = f.rule_id)),
items AS (SELECT *, {IMPACT} AS expected_impact, {OWNER} AS owner FROM qi)"""
QUEUE_CTES = [FIRST, OPTS, QG, LASTG, QUEUE]


def queue_items(spark, sf):
    f = fi.findings(spark, sf)
    without = (F.col("run_id") == "r0") & (F.col("fix_class") == "safe_auto_fix")
    optioned = f.withColumn("fix_class", F.when(without, "not_applicable").otherwise(F.col("fix_class")))
    return a.queue(materialise(a.queue_facts(optioned), "queue-facts"))


@query("J12_queue_rows", fi.with_(QUEUE_CTES, "SELECT * FROM items"))
def j12(spark, sf):
    return queue_items(spark, sf)


# Search rows: part = page, line number = clicks, quantity = impressions, discount = position.
SEARCH_SQL = "'https://s' || CAST(l_suppkey AS STRING) || '.example' AS site_id, 'https://s' || CAST(l_suppkey AS STRING) || '.example/p/' || CAST(l_partkey % 60 AS STRING) AS page, 'q' || CAST(l_orderkey % 500 AS STRING) AS query, CAST(l_linenumber AS BIGINT) AS clicks, CAST(l_quantity AS BIGINT) AS impressions, CAST(round(l_discount * 100 + 1) AS BIGINT) AS position"
SR = f"sr AS (SELECT {SEARCH_SQL} FROM lineitem)"
OPP = """iu AS (SELECT DISTINCT site_id, run_id, rule_id, page_url AS url FROM fnd WHERE page_url IS NOT NULL),
sp AS (SELECT site_id, regexp_replace(page, '/$', '') AS form, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(position * impressions) AS weighted, count(*) AS n FROM sr GROUP BY 1, 2),
opp AS (SELECT site_id, run_id, rule_id, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, sum(weighted)::DOUBLE / sum(impressions) AS average_position, CAST(sum(n) AS BIGINT) AS matched_rows FROM (SELECT site_id, run_id, rule_id, regexp_replace(url, '([^/])/$', '\\1') AS form FROM iu) JOIN sp USING (site_id, form) GROUP BY 1, 2, 3)"""


def search_rows(spark, sf):
    return inputs.table(spark, sf, "lineitem").selectExpr(*inputs._split(SEARCH_SQL))


def opportunities(spark, sf):
    urls = fi.findings(spark, sf).select("site_id", "run_id", "rule_id", F.explode("affected_urls").alias("url")).distinct()
    return a.search_opportunity(urls, search_rows(spark, sf), ["site_id", "run_id", "rule_id"])


@query("J13_search_opportunity", fi.with_([SR, OPP], "SELECT site_id, run_id, rule_id, clicks, impressions, round(average_position, 6) AS average_position, matched_rows FROM opp"))
def j13(spark, sf):
    return opportunities(spark, sf).withColumn("average_position", F.round("average_position", 6))


PRIORITY = """floor(round((CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 80 WHEN 'medium' THEN 50 WHEN 'low' THEN 20 ELSE 5 END + CASE expected_impact WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 0 END)::DOUBLE + least(20.0::DOUBLE, log10(coalesce(impressions, 0) + 1) * 5) + least(10.0::DOUBLE, log10(coalesce(clicks, 0) + 1) * 4)
 + CASE WHEN average_position BETWEEN 4 AND 20 THEN 15 ELSE 0 END, 9) * 10.0::DOUBLE + 0.5) / 10.0::DOUBLE"""
SCORED = f"scored AS (SELECT items.*, {PRIORITY} AS priority_score FROM items LEFT JOIN opp USING (site_id, run_id, rule_id))"


def scored_items(spark, sf):
    items = queue_items(spark, sf).join(opportunities(spark, sf), ["site_id", "run_id", "rule_id"], "left")
    c = F.col
    score_ = a.priority_score(c("severity"), c("expected_impact"), c("clicks"), c("impressions"), c("average_position"))
    return items.withColumn("priority_score", score_).drop("clicks", "impressions", "average_position", "matched_rows")


SCORED_CTES = [*QUEUE_CTES, SR, OPP, SCORED]


@query("J14_priority_score", fi.with_(SCORED_CTES, "SELECT site_id, run_id, item_id, item_title, priority_score FROM scored"))
def j14(spark, sf):
    return scored_items(spark, sf).select("site_id", "run_id", "item_id", "item_title", "priority_score")


QORDER = f"priority_score DESC, {SEVRANK}, CASE expected_impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, CAST(approval_required AS INT), CASE fix_class WHEN 'safe_auto_fix' THEN 0 WHEN 'manual_strategy' THEN 1 ELSE 2 END, CASE effort WHEN 'small' THEN 0 ELSE 1 END, rule_id, item_id, item_title"


@query("J15_queue_order", fi.with_(SCORED_CTES, f"SELECT site_id, run_id, item_id, item_title, row_number() OVER (PARTITION BY site_id, run_id ORDER BY {QORDER}) AS queue_rank FROM scored"))
def j15(spark, sf):
    return a.ranked_queue(materialise(scored_items(spark, sf), "queue")).select("site_id", "run_id", "item_id", "item_title", "queue_rank")


@query("J16_highlights", fi.with_([*SCORED_CTES,
    f"best AS (SELECT *, row_number() OVER (PARTITION BY site_id, run_id ORDER BY {QORDER}) AS list_rank FROM scored WHERE NOT approval_required)",
    f"win AS (SELECT *, row_number() OVER (PARTITION BY site_id, run_id ORDER BY list_rank) AS w FROM best WHERE list_rank <= 8 AND expected_impact <> 'low')",
    f"risk2 AS (SELECT *, row_number() OVER (PARTITION BY site_id, run_id ORDER BY {QORDER}) AS list_rank FROM scored WHERE severity IN ('critical', 'high'))"],
    f"""SELECT site_id, run_id, 'next_best_fixes' AS list, list_rank, rule_id, item_id, item_title FROM best WHERE list_rank <= 8 UNION ALL SELECT site_id, run_id, 'top_wins', w, rule_id, item_id, item_title FROM win WHERE w <= 5
 UNION ALL SELECT site_id, run_id, 'top_risks', list_rank, rule_id, item_id, item_title FROM risk2 WHERE list_rank <= 5 UNION ALL SELECT site_id, run_id, 'approvals', row_number() OVER (PARTITION BY site_id, run_id ORDER BY {QORDER}), rule_id, item_id, item_title FROM scored WHERE approval_required"""))
def j16(spark, sf):
    return a.highlights(materialise(scored_items(spark, sf), "queue"))


QUAD = "CASE WHEN approval_required THEN ['strategic_approvals'] WHEN effort = 'small' AND expected_impact <> 'low' THEN ['quick_wins'] WHEN expected_impact = 'high' AND effort <> 'small' THEN ['major_projects'] ELSE ['fill_ins'] END"


@query("J17_quadrants", fi.with_([*SCORED_CTES, f"qq AS (SELECT *, unnest({QUAD}) AS quadrant FROM scored)", f"qr AS (SELECT *, row_number() OVER (PARTITION BY site_id, run_id, quadrant ORDER BY {QORDER}) AS quadrant_rank FROM qq)"], "SELECT site_id, run_id, quadrant, quadrant_rank, item_id, item_title FROM qr WHERE quadrant_rank <= 12"))
def j17(spark, sf):
    return a.quadrants(scored_items(spark, sf)).select("site_id", "run_id", "quadrant", F.col("quadrant_rank").cast("long").alias("quadrant_rank"), "item_id", "item_title")


@query("J18_template_heatmap", fi.with_(["h AS (SELECT *, coalesce(template, 'Unmapped URL-level issues') AS t FROM fnd)"], """SELECT site_id, run_id, t AS template, count(*) AS issue_count, count(*) FILTER (severity IN ('critical', 'high')) AS critical_high, count(DISTINCT rule_id) AS n_rules,
 array_to_string(list_sort(list(DISTINCT page_url) FILTER (page_url IS NOT NULL))[1:8], '|') AS url_sample FROM h GROUP BY 1, 2, 3"""))
def j18(spark, sf):
    return a.template_heatmap(fi.findings(spark, sf))


@query("J19_evidence_stats", fi.with_(QUEUE_CTES, """SELECT site_id, run_id, findings, evidence_entries, grouped_findings, approval_required, safe_auto_fixes FROM (SELECT site_id, run_id, count(*) AS findings, CAST(sum(evidence_count) AS BIGINT) AS evidence_entries FROM fnd GROUP BY 1, 2)
 JOIN (SELECT site_id, run_id, count(*) AS grouped_findings FROM qg GROUP BY 1, 2) USING (site_id, run_id) JOIN (SELECT site_id, run_id, count(*) FILTER (approval_required) AS approval_required, count(*) FILTER (safe_to_auto_fix) AS safe_auto_fixes FROM items GROUP BY 1, 2) USING (site_id, run_id)"""))
def j19(spark, sf):
    return a.evidence_stats(fi.findings(spark, sf), queue_items(spark, sf))


@query("J20_actionability_counts", fi.with_([], f"SELECT site_id, run_id, 'owner' AS dimension, {OWNER} AS value, count(*) AS n FROM fnd GROUP BY 1, 2, 4 UNION ALL SELECT site_id, run_id, 'readiness', {READY}, count(*) FROM fnd GROUP BY 1, 2, 4"))
def j20(spark, sf):
    return a.actionability_counts(actionable(spark, sf))


@query("J21_manual_actions", fi.with_([], "SELECT site_id, run_id, rule_id, recommendation, count(*) AS n FROM fnd WHERE NOT safe_to_auto_fix GROUP BY 1, 2, 3, 4"))
def j21(spark, sf):
    f = fi.findings(spark, sf)
    return a.manual_actions(f, f.filter("safe_to_auto_fix").select("site_id", "run_id", "rule_id").distinct())


@query("J22_review_packet", fi.with_([QG, f"rp AS (SELECT *, row_number() OVER (PARTITION BY site_id, run_id ORDER BY {SEVRANK}, n_findings DESC, rule_id, title) AS group_rank FROM qg)"], """SELECT site_id, run_id, rule_id, severity, group_rank, n_findings, (SELECT array_to_string(list_sort(list(DISTINCT page_url))[1:12], '|') FROM fnd f WHERE f.page_url IS NOT NULL AND f.site_id = rp.site_id AND f.run_id = rp.run_id AND f.rule_id = rp.rule_id AND f.severity = rp.severity) AS urls FROM rp WHERE group_rank <= 30"""))
def j22(spark, sf):
    f = fi.findings(spark, sf)
    return a.review_packet(a.finding_groups(f), f).select("site_id", "run_id", "rule_id", "severity", F.col("group_rank").cast("long").alias("group_rank"), "n_findings", "urls")


SECT = "sect(section, category) AS (VALUES " + dims.values_sql([(k, c) for k, cs in a.SECTIONS.items() for c in cs]) + ")"


@query("J23_section_findings", fi.with_([SECT], "SELECT site_id, run_id, section, count(*) AS n FROM fnd JOIN sect USING (category) GROUP BY 1, 2, 3"))
def j23(spark, sf):
    return a.section_findings(fi.findings(spark, sf))


@query("J1_fallback_owner", fi.with_([], "SELECT category, CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in a.FALLBACK_OWNERS.items()) + " ELSE 'seo' END AS owner, count(*) AS n FROM fnd GROUP BY 1"))
def j1b(spark, sf):
    return fi.findings(spark, sf).groupBy("category").agg(F.count("*").alias("n")).select("category", lookup(F.col("category"), a.FALLBACK_OWNERS, "seo").alias("owner"), "n")


# Review claims: conversation turns stand for review rows.
@query("J25_review_summary", "SELECT conv_id, count(*) FILTER (role = 'user') AS strategic_findings, count(*) FILTER (role = 'assistant') AS copy_items, count(*) FILTER (role = 'assistant' AND turn % 2 = 1 AND length(text) > 200) AS approval_gated FROM conversations GROUP BY 1")
def j25(spark, sf):
    from auditlake.operators.checks import review_summary

    rows = inputs.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("review_id"),
        F.when(F.col("role") == "user", "strategic").when(F.col("role") == "assistant", "copy").alias("kind"),
        F.when((F.col("turn") % 2 == 1) & (F.length("text") > 200), "approval_required").otherwise("none").alias("approval_state"),
    )
    return review_summary(rows).withColumnRenamed("review_id", "conv_id")
