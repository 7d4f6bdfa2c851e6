"""Findings at the size of the line item table: every line is one finding of some rule on some site and run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.plans import inputs
from auditlake.plans import oracle as o

# Scalar columns, plain SQL for both engines.
LINE_SQL = """'https://s' || CAST(l_suppkey AS STRING) || '.example' AS site_id, CASE WHEN l_linestatus = 'O' THEN 'r1' ELSE 'r0' END AS run_id,
 l_orderkey * 10 + l_linenumber AS ord, CAST(l_partkey % 72 AS INT) AS rule_no, CAST(l_quantity * 3 - 20 AS INT) AS confidence,
 CASE WHEN l_discount = 0.1 THEN 'passed' WHEN l_discount = 0.09 THEN 'not_applicable' WHEN l_discount = 0.08 THEN 'warning' ELSE 'open' END AS status,
 CASE WHEN l_tax > 0 THEN 'https://s' || CAST(l_suppkey AS STRING) || '.example/p/' || CAST(l_partkey % 50 AS STRING) || CASE WHEN l_linenumber = 1 THEN '/' ELSE '' END END AS page_url,
 CASE WHEN l_linenumber > 4 THEN 'https://s' || CAST(l_suppkey AS STRING) || '.example/e/' || CAST(l_orderkey % 30 AS STRING) END AS evidence_url,
 CASE l_returnflag WHEN 'A' THEN 'Products template' WHEN 'N' THEN 'Blog template' END AS template, l_linenumber % 3 AS evidence_count, l_orderkey % 11 = 0 AS downgraded"""
_FIELDS = ["rule_id", "title", "category", "severity", "recommendation", "fix"]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = F.array(*[F.struct(*[F.lit(r[f]).alias(f) for f in _FIELDS]) for r in dims.EMITTED])
    lines = inputs.dealt(inputs.table(spark, sf_dir, "lineitem")).selectExpr(*inputs._split(LINE_SQL))
    c = F.col
    rows = lines.withColumn("r", F.element_at(rules, c("rule_no") + 1))
    one = lambda x: F.array_compact(F.array(x))
    fix = F.when(c("r.fix") == "A", "approval_required").when(c("r.fix") == "S", "safe_auto_fix").otherwise("manual_strategy")
    return rows.select(
        "site_id", "run_id", "ord", "r.rule_id", "r.title", "r.category",
        F.when(c("downgraded"), "info").otherwise(c("r.severity")).alias("severity"), "confidence", "status",
        "r.recommendation", fix.alias("fix_class"), (c("r.fix") == "A").alias("approval_required"),
        (c("r.fix") == "S").alias("safe_to_auto_fix"),
        F.when(c("r.fix") == "S", "small").otherwise("medium").alias("effort"),
        F.when(c("r.fix") == "A", "high").when(c("r.fix") == "S", "low").otherwise("medium").alias("risk"),
        one("page_url").alias("affected_urls"), one("evidence_url").alias("evidence_urls"),
        one("template").alias("affected_templates"), "evidence_count",
        (c("page_url").isNotNull().cast("int") + c("template").isNotNull().cast("int")).alias("n_affected"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).select("site_id", "run_id").distinct()


FND = f"""rules(rule_id, title, category, default_severity, recommendation, fix, rule_no) AS (VALUES {dims.values_sql([(*(r[f] for f in _FIELDS), i) for i, r in enumerate(dims.EMITTED)])}),
line AS (SELECT {LINE_SQL} FROM lineitem),
fnd AS (SELECT site_id, run_id, ord, rule_id, title, category, CASE WHEN downgraded THEN 'info' ELSE default_severity END AS severity, confidence, status, recommendation,
 CASE fix WHEN 'A' THEN 'approval_required' WHEN 'S' THEN 'safe_auto_fix' ELSE 'manual_strategy' END AS fix_class, fix = 'A' AS approval_required, fix = 'S' AS safe_to_auto_fix,
 CASE fix WHEN 'S' THEN 'small' ELSE 'medium' END AS effort, CASE fix WHEN 'A' THEN 'high' WHEN 'S' THEN 'low' ELSE 'medium' END AS risk,
 page_url, evidence_url, template, evidence_count, CAST(page_url IS NOT NULL AS INT) + CAST(template IS NOT NULL AS INT) AS n_affected FROM line JOIN rules USING (rule_no)),
runs AS (SELECT DISTINCT site_id, run_id FROM fnd)"""


def _case(col: str, table: dict, cast: str = "") -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}{cast}" for k, v in table.items()) + " END"


def grp(source: str, name: str) -> str:
    conf = "greatest(0.0, least(100.0, confidence)) / 100.0"
    d = "::DOUBLE"
    return f"""{name}u AS (SELECT site_id, run_id, rule_id, title, category, severity, count(DISTINCT u) AS n_urls FROM (SELECT *, unnest([page_url, evidence_url]) AS u FROM {source}) GROUP BY 1, 2, 3, 4, 5, 6),
{name}0 AS (SELECT site_id, run_id, rule_id, title, category, severity, count(*) AS n_findings, max(confidence) AS confidence, count(DISTINCT template) AS n_templates FROM {source} GROUP BY 1, 2, 3, 4, 5, 6),
{name} AS (SELECT *, ({_case("severity", dims.BASE_PENALTY, d)}) * ({conf})::DOUBLE + least(greatest(0, greatest(n_findings, n_urls, n_templates) - 1)::DOUBLE * ({_case("severity", dims.STEP_PENALTY, d)}) * ({conf})::DOUBLE, ({_case("severity", dims.CAP_PENALTY, d)}) * ({conf})::DOUBLE) AS penalty
 FROM {name}0 JOIN {name}u USING (site_id, run_id, rule_id, title, category, severity))"""


SCOREABLE = "sc AS (SELECT * FROM fnd WHERE status IN ('open', 'warning'))"
LEDGER = f"""cat(rule_id, category, maturity, ord) AS (VALUES {dims.values_sql([(r["rule_id"], r["category"], r["maturity"], i) for i, r in enumerate(dims.RULES)])}),
cfg AS (SELECT site_id, run_id, CASE length(site_id) % 3 WHEN 0 THEN 'commerce' WHEN 1 THEN 'content' ELSE 'local-business' END AS site_type, run_id = 'r1' AS include_agent, length(site_id) % 2 = 0 AS lcp_measured FROM runs),
cnt AS (SELECT site_id, run_id, rule_id, count(*) AS n FROM fnd GROUP BY 1, 2, 3),
led0 AS (SELECT cfg.*, cat.*, coalesce(n, 0) AS n, CASE WHEN starts_with(rule_id, 'AR-') AND NOT include_agent THEN false WHEN starts_with(rule_id, 'SEO-SEARCH-') THEN false WHEN category = 'local_seo' THEN site_type = 'local-business' WHEN category = 'ecommerce_seo' THEN site_type = 'commerce' ELSE true END AS applicable
 FROM cfg CROSS JOIN cat LEFT JOIN cnt USING (site_id, run_id, rule_id)),
led AS (SELECT site_id, run_id, rule_id, category, maturity, applicable, CASE WHEN NOT applicable THEN 'not_applicable' WHEN rule_id = 'SEO-PERF-001' AND NOT lcp_measured THEN 'not_measured' WHEN n > 0 THEN 'failed' ELSE 'passed' END AS status,
 applicable AND NOT (rule_id = 'SEO-PERF-001' AND NOT lcp_measured) AS measured, CASE WHEN applicable AND NOT (rule_id = 'SEO-PERF-001' AND NOT lcp_measured) THEN n ELSE 0 END AS finding_count FROM led0)"""


def run_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("site_id")
    kind = F.when(n % 3 == 0, "commerce").when(n % 3 == 1, "content").otherwise("local-business")
    yes, no = F.lit(True), F.lit(False)
    return runs(spark, sf_dir).select(
        "site_id", "run_id", kind.alias("site_type"), (F.col("run_id") == "r1").alias("include_agent"),
        (n % 2 == 0).alias("lcp_measured"), no.alias("include_search"), yes.alias("include_accessibility"),
        yes.alias("include_international"), yes.alias("include_local"), yes.alias("include_commerce"), yes.alias("include_vitals"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from auditlake.operators import rules as r

    counts = findings(spark, sf_dir).groupBy("site_id", "run_id", "rule_id").agg(F.count("*").alias("n_findings"))
    return r.coverage_ledger(run_config(spark, sf_dir), counts)


def areas_cte(mapping: dict, name: str, key: str) -> str:
    rows = [(k, c) for k, cats in mapping.items() for c in cats]
    return f"{name}({key}, category) AS (VALUES {dims.values_sql(rows)})"


def with_(ctes: list[str], select: str) -> str:
    return o.with_([FND, *ctes], select)
