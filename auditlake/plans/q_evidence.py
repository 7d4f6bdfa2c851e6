"""Queries over the evidence store (content-addressed rows, who cites them, their JSONL file) and the gold store."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.operators import discovery as d
from auditlake.operators import evidence as ev
from auditlake.operators import intel as it
from auditlake.operators import rules as r
from auditlake.operators import scoring as sc
from auditlake.plans import findings_input as fi
from auditlake.plans import gold
from auditlake.plans import oracle as o
from auditlake.plans import q_scores as qs
from auditlake.plans.audit import audit_inputs
from auditlake.plans.q_rules import DUP, PF, SITE_CTES, silver
from auditlake.plans.registry import query
from auditlake.session import materialise, new_shared_path
from auditlake.sources import goldstore, sinks

_J = lambda x: f"coalesce(CAST(to_json({x}) AS VARCHAR), 'null')"
_PART = lambda x: f"coalesce(CAST(strlen({x}) AS VARCHAR) || ':' || {x}, '-')"


def _id(kind: str, at: str, type_: str, url: str, subject: str, status: str, value: str, excerpt: str) -> str:
    parts = " || ".join(_PART(f"CAST({x} AS VARCHAR)") for x in ("site_id", "'r0'", at, type_, url, subject, status, value, excerpt))
    return f"{kind} || '-' || substr(sha256({parts}), 1, 24)"


def _rows(source: str, kind: str, type_: str, url: str = "NULL", at: str = "NULL", subject: str = "NULL", status: str = "NULL", value: str = "NULL", excerpt: str = "NULL") -> str:
    """Evidence rows of one kind as SQL."""
    key = _id(f"'{kind}'", at, f"'{type_}'", url, subject, status, value, excerpt)
    return f"SELECT site_id, {key} AS evidence_id, '{kind}' AS kind, '{type_}' AS type, {url} AS url, {subject} AS subject, CAST({status} AS INT) AS status, {value} AS value, {excerpt} AS excerpt FROM {source}"


_SPREAD = "(SELECT site_id, count(*) AS n, count(*) FILTER (n_int >= 4) AS hubs, count(*) FILTER (n_hre > 0) AS alt FROM snap GROUP BY 1)"
_GROUPS = "(SELECT site_id, rule_id || ':' || sha256(k) AS subject, arg_min(final_url, page_id) AS url, CAST(count(*) AS VARCHAR) AS n FROM dk WHERE k IS NOT NULL AND k <> '' GROUP BY site_id, rule_id, k HAVING count(*) > 1)"
_KINDS = [
    _rows("snap", "page-status", "http_status", "final_url", "page_id", status="status", value="'{\"contentType\":' || " + _J("content_type") + " || '}'"),
    _rows("snap", "page-title", "html_selector", "final_url", "page_id", "'title'", value="title"),
    _rows("snap", "page-meta", "html_selector", "final_url", "page_id", "'meta[name=description]'", value="meta_description"),
    _rows("snap", "page-body", "body_excerpt", "final_url", "page_id", value="'{\"wordCount\":' || word_count || '}'", excerpt="body_excerpt"),
    _rows("(SELECT DISTINCT site_id, page_id, affected_url, rule_id, title FROM pf)", "finding", "html_selector", "affected_url", "page_id", "rule_id", value="title"),
    _rows("ep", "endpoint", "http_status", "url", subject="path", status="status", value="'{\"path\":' || " + _J("path") + " || ',\"ok\":' || CAST(ok AS VARCHAR) || ',\"contentType\":' || " + _J("content_type") + " || '}'", excerpt="substr(body, 1, 500)"),
    _rows(_GROUPS, "cross-page", "html_selector", "url", subject="subject", value="n"),
    _rows(_SPREAD, "cross-page", "html_selector", subject="'hreflang-coverage'", value="'{\"withAlternates\":' || alt || ',\"without\":' || (n - alt) || '}'"),
    _rows(_SPREAD, "cross-page", "crawl_graph", subject="'crawl-graph'", value="'{\"pages\":' || n || ',\"hubs\":' || hubs || '}'"),
    _rows("(SELECT site_id, unnest(failed_metrics) AS m FROM fmet)", "performance", "performance_metric", subject="m"),
]
STORE = "ev AS (" + "\n UNION ALL ".join(_KINDS) + ")"
CTES = [*SITE_CTES, PF.split(",\n", 1)[1], DUP, STORE]


def store(spark, sf):
    """(evidence, citations) of the audit of the given tables, each part of the crawl read once from its written form."""
    (_, endpoints, documents, failed), options = audit_inputs(spark, sf)
    snap = silver(spark, sf)
    types = materialise(it.site_types(snap), "site-types")
    prepared = r.prepare_pages(snap, types)
    keys = materialise(r.duplicate_keys(snap), "duplicate-keys")
    sizes = materialise(r.duplicate_groups(keys), "duplicate-groups")
    groups, rollup = r.group_representatives(keys, sizes), r.page_rollup(snap)
    runs = snap.select(*ev.SITE).unionByName(endpoints.select(*ev.SITE)).distinct()
    # Metrics of runs that the crawl doesn't hold have no finding to back.
    failed = failed.join(runs, ev.SITE, "left_semi")
    parts = [ev.page_rows(prepared), ev.endpoint_rows(runs, endpoints), ev.cross_page_rows(groups, rollup), ev.metric_rows(failed)]
    evidence = parts[0]
    for part in parts[1:]:
        evidence = evidence.unionByName(part)
    evidence = materialise(evidence, "evidence")

    universe = materialise(d.sitemap_universe(endpoints, documents), "sitemap-urls")
    missing = r.missing_from_sitemap(snap, universe).groupBy(*ev.SITE).agg(F.count("*").alias("n_missing_from_sitemap"))
    site = r.site_rule_findings(types, endpoints, d.sitemap_url_counts(endpoints, documents, universe), rollup, types, missing, failed, **options)
    return evidence, ev.citations(evidence, r.page_rule_findings(prepared), sizes, site, endpoints)


@query("R2_evidence_store", o.with_(CTES, "SELECT * FROM ev"))
def evidence_store(spark, sf):
    return store(spark, sf)[0].drop("run_id")


_OF_SITE = "CASE rule_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**ev.RULE_PATHS, **ev.RULE_METRICS, **ev.GRAPH_RULES}.items()) + " WHEN 'SEO-SITEMAP-002' THEN coalesce(fm, '/sitemap.xml') WHEN 'SEO-SITEMAP-008' THEN coalesce(fm, '/sitemap.xml') END"
CITED = f"""fmap AS (SELECT site_id, min(path) AS fm FROM ep WHERE ok AND path IN ('/sitemap.xml', '/sitemap_index.xml') GROUP BY 1),
own AS (SELECT site_id, {_id("'finding'", "page_id", "'html_selector'", "affected_url", "rule_id", "NULL", "title", "NULL")} AS evidence_id FROM pf),
asked AS (SELECT site_id, subject FROM {_GROUPS} UNION ALL SELECT site_id, {_OF_SITE} FROM sf LEFT JOIN fmap USING (site_id)),
cited AS (SELECT site_id, evidence_id, count(*) AS n FROM (SELECT site_id, evidence_id FROM own UNION ALL
 SELECT asked.site_id, coalesce(ev.evidence_id, 'none-' || asked.subject) FROM asked LEFT JOIN ev ON ev.site_id = asked.site_id AND ev.subject = asked.subject AND ev.kind IN ('endpoint', 'cross-page', 'performance')) GROUP BY 1, 2)"""


@query("V6_evidence_references", o.with_([*CTES, CITED], "SELECT coalesce(ev.site_id, cited.site_id) AS site_id, coalesce(ev.evidence_id, cited.evidence_id) AS evidence_id, coalesce(n, 0) AS n_citations, CASE WHEN ev.evidence_id IS NULL THEN 'dangling' WHEN n IS NULL THEN 'unused' ELSE 'used' END AS state FROM ev FULL JOIN cited ON ev.site_id = cited.site_id AND ev.evidence_id = cited.evidence_id"))
def evidence_references(spark, sf):
    evidence, cited = store(spark, sf)
    return ev.evidence_references(cited, evidence).drop("run_id")


@query("S18_evidence_jsonl", o.with_(CTES, "SELECT * FROM ev"))
def evidence_jsonl(spark, sf):
    path = new_shared_path(spark, "evidence-jsonl")
    evidence = store(spark, sf)[0]
    sinks.jsonl(evidence, path)
    return spark.read.schema(evidence.schema).json(path).drop("run_id")


# What is told of each gold table: its rows and one sum that any lost, doubled or mixed-up row changes.
GOLD = {
    "finding": ("fnd", "ord"),
    "evidence": ("(SELECT * FROM fnd WHERE evidence_url IS NOT NULL)", "ord * 7 + length(evidence_url)"),
    "ledger": ("led", "finding_count * 3 + length(status)"),
    "score": ("ars", "score * length(area)"),
    "plan": (f"(SELECT site_id, run_id, rule_id, row_number() OVER (PARTITION BY site_id, run_id ORDER BY {qs.PLAN_ORDER}) AS plan_rank FROM opt JOIN fst USING (site_id, run_id, rule_id))", "plan_rank * length(rule_id)"),
    "queue": ("items", "instances * length(item_id) + n_evidence"),
}
_ALL_OPTIONS = qs.QUEUE.replace("opt2 AS (SELECT * FROM opt WHERE NOT (run_id = 'r0' AND fix_class = 'safe_auto_fix'))", "opt2 AS (SELECT * FROM opt)")
GOLD_CTES = [fi.SCOREABLE, qs.GRP, fi.LEDGER, qs.AREAS, qs.AREA_SCORES, qs.FIRST, qs.OPTS, qs.QG, qs.LASTG, _ALL_OPTIONS]


@query("S19_run_tables", fi.with_(GOLD_CTES, " UNION ALL ".join(f"SELECT '{name}' AS gold_table, run_id, site_id, count(*) AS n, CAST(sum({total}) AS BIGINT) AS total FROM {source} GROUP BY 2, 3" for name, (source, total) in GOLD.items())))
def run_tables(spark, sf):
    """Six gold tables of all runs in one commit; then the newer run is committed again and replaces itself, and a third
    commit breaks off before its end. What is read are the rows of the finished ones."""
    root, commit = new_shared_path(spark, "gold"), goldstore.new_commit()
    found = fi.findings(spark, sf)
    goldstore.add(root, commit, {"finding": gold.placed_findings(found)}, lying=["finding"])
    back = goldstore.written(spark, root, commit, "finding", found.schema)
    runs = back.select("site_id", "run_id").distinct()
    config = fi.run_config(spark, sf)
    penalties = materialise(sc.with_penalty(sc.finding_groups(back)), "penalties")
    rest = gold.derived_tables(back, penalties, config)
    rest["evidence"] = back.select("site_id", "run_id", "ord", "rule_id", F.explode("evidence_urls").alias("evidence_url"))
    goldstore.add(root, commit, rest, lying=rest)
    goldstore.finish(root, commit, runs, {"finding": found.schema} | {name: df.schema for name, df in rest.items()})

    newer = {name: rows.filter("run_id = 'r1'") for name, rows in goldstore.tables(spark, root, list(GOLD)).items()}
    goldstore.commit_tables(root, runs.filter("run_id = 'r1'"), newer, lying=newer)
    goldstore.add(root, goldstore.new_commit(), {"finding": newer["finding"].withColumn("run_id", F.lit("r2"))}, lying=["finding"])
    out, seen = None, goldstore.tables(spark, root, list(GOLD))
    for name, (_, total) in GOLD.items():
        rows = seen[name].groupBy("run_id", "site_id").agg(F.count("*").alias("n"), F.sum(F.expr(total)).cast("long").alias("total"))
        rows = rows.withColumn("gold_table", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
