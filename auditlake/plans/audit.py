"""The whole audit of a page lake as one plan: snapshots, rules of every grain, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.operators import discovery, intel, pages, rules, runfacts, scoring
from auditlake.session import materialise
from auditlake.sources import sinks

SITE = ["site_id", "run_id"]


def _as_findings(rows: DataFrame, urls, templates) -> DataFrame:
    """Rule output in the shape the scoring reads."""
    none = F.array().cast("array<string>")
    return rules.with_catalogue(rows).select(
        *scoring.GROUP, "confidence", "status", urls.alias("affected_urls"), none.alias("evidence_urls"),
        templates.alias("affected_templates"),
    )


def audit_facts(
    page_raw: DataFrame,
    endpoints: DataFrame,
    sitemap_documents: DataFrame | None = None,
    failed_metrics: DataFrame | None = None,
    *,
    search_integrations: bool | DataFrame = False,
) -> tuple[DataFrame, DataFrame]:
    """(runs, facts): long scoring facts of page, group and site rules.

    HTML is parsed once: the snapshot table is written and every rule reads the written columns it needs. Runs are those
    of any input, so a site that answered probes without an HTML page is scored too. ``sitemap_documents`` holds
    fetched child sitemaps (site_id, run_id, url, body), ``failed_metrics`` the metrics over budget of each run
    (site_id, run_id, failed_metrics), ``search_integrations`` whether search data is missing (site_id, run_id,
    search_integrations, or the same for all runs)."""
    snap = materialise(pages.with_json_ld_types(pages.page_snapshots(page_raw)), "snapshots")
    typed = intel.site_types(snap)
    runs = snap.select(*SITE).unionByName(endpoints.select(*SITE)).distinct()
    types = materialise(runs.join(typed, SITE, "left").fillna("content", ["site_type"]), "site-types")
    none = F.array().cast("array<string>")

    page = rules.page_rule_findings(rules.prepare_pages(snap, types))
    page_facts = scoring.finding_facts(_as_findings(page, F.array("affected_url"), F.col("refs")))

    keys = materialise(rules.duplicate_keys(snap), "duplicate-keys")
    groups = rules.duplicate_groups(keys)
    named = rules.with_catalogue(rules.group_rule_findings(groups))
    of_group = [*scoring.GROUP, "confidence"]
    group_facts = named.select(*of_group, F.lit("f").alias("kind"), F.lit(None).cast("string").alias("value")).unionByName(
        named.select(*of_group, "key_hash")
        .join(rules.duplicate_members(keys, groups), [*SITE, "rule_id", "key_hash"])
        .select(*of_group, F.lit("u").alias("kind"), F.col("affected_url").alias("value"))
    )

    universe = materialise(discovery.sitemap_universe(endpoints, sitemap_documents), "sitemap-urls")
    missing = materialise(rules.missing_from_sitemap(snap, universe).select(*SITE, "affected_url"), "missing-from-sitemap")
    n_missing = missing.groupBy(*SITE).agg(F.count("*").alias("n_missing_from_sitemap"))
    site = materialise(
        rules.site_rule_findings(
            types, endpoints, discovery.sitemap_url_counts(endpoints, sitemap_documents, universe), rules.page_rollup(snap), types, n_missing,
            failed_metrics, search_integrations=search_integrations,
        ),
        "site-findings",
    )
    # A rule about pages names each of them, one row per page; the others name their site.
    of_pages = missing.withColumn("rule_id", F.lit("SEO-SITEMAP-011")).unionByName(
        rules.missing_hreflang(snap).select(*SITE, "affected_url").withColumn("rule_id", F.lit("SEO-INTL-001"))
    )
    own = F.when(F.col("rule_id").isin("SEO-SITEMAP-011", "SEO-INTL-001"), none).otherwise(F.array("site_id"))
    site_facts = scoring.finding_facts(_as_findings(site, own, F.coalesce("refs", none)))
    named_pages = (
        rules.with_catalogue(site).select(*of_group).join(of_pages, [*SITE, "rule_id"])
        .select(*of_group, F.lit("u").alias("kind"), F.col("affected_url").alias("value"))
    )
    return runs, page_facts.unionByName(group_facts).unionByName(site_facts).unionByName(named_pages)


def audit_groups(page_raw: DataFrame, endpoints: DataFrame, sitemap_documents: DataFrame | None = None, failed_metrics: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(runs, groups): findings per rule, title and severity of each run, with counts and penalty. Written once; scores,
    plan and comparison read it instead of the findings."""
    runs, facts = audit_facts(page_raw, endpoints, sitemap_documents, failed_metrics, **options)
    return runs, materialise(scoring.with_penalty(scoring.group_facts(facts)), "penalties")


def scores_of(runs: DataFrame, penalties: DataFrame) -> DataFrame:
    """Area scores and total of every run. The total counts stable rules only, as the ledger's primary score."""
    stable = penalties.filter(rules.maturity(F.col("rule_id")) == "stable")
    long = scoring.scores_by(runs, penalties, dims.AREAS, "area").unionByName(
        scoring.scores_by(runs, stable, {"total": dims.PROFILES["core_seo"]}, "area")
    )
    wide = long.groupBy(*SITE).agg(*[F.max(F.when(F.col("area") == a, F.col("score"))).alias(a) for a in (*dims.AREAS, "total")])
    return wide.withColumn("level", scoring.level(F.col("total")))


def audit_scores(page_raw: DataFrame, endpoints: DataFrame, sitemap_documents: DataFrame | None = None, failed_metrics: DataFrame | None = None, **options) -> DataFrame:
    return scores_of(*audit_groups(page_raw, endpoints, sitemap_documents, failed_metrics, **options))


def write_audit(root: str, page_raw: DataFrame, endpoints: DataFrame, sitemap_documents: DataFrame | None = None, failed_metrics: DataFrame | None = None, **options) -> None:
    """Gold tables of the given runs below ``root``: finding_groups and scores, partitioned by run. Runs that are written
    again are replaced, others stay."""
    runs, groups = audit_groups(page_raw, endpoints, sitemap_documents, failed_metrics, **options)
    sinks.gold(groups, f"{root}/finding_groups")
    sinks.gold(scores_of(runs, groups), f"{root}/scores")


def audit_inputs(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], dict[str, DataFrame]]:
    """All inputs of the audit from the driver's tables: pages, probes, sitemap children, metrics over budget of each run
    as of its time, and search state."""
    from auditlake.plans import inputs

    logs = [of(spark, sf_dir) for of in (inputs.fetch_log, inputs.asset_log, inputs.paint_samples)]
    failed = materialise(runfacts.failed_by_run(*logs, inputs.audit_runs(spark, sf_dir)), "failed-metrics")
    # Probes are read by many parts; in a lake they are a table of their own.
    probes = materialise(inputs.endpoint_raw(spark, sf_dir), "endpoints")
    given = [inputs.page_raw(spark, sf_dir), probes, inputs.sitemap_documents(spark, sf_dir), failed]
    return given, {"search_integrations": inputs.search_state(spark, sf_dir)}


def site_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship query on the driver's tables."""
    given, options = audit_inputs(spark, sf_dir)
    return audit_scores(*given, **options)
