"""Gold tables of an audit: findings, the URLs they name, evidence, citations, ledger, scores, plan and queue of every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from auditlake import dims
from auditlake.functions.numeric import lookup
from auditlake.operators import actions, codes, discovery, evidence, intel, pages, rules, scoring
from auditlake.session import materialise
from auditlake.sources import goldstore

SITE = ["site_id", "run_id"]
# Grains in the order in which their findings are told.
GRAINS = {"site": 0, "page": 1, "group": 2}


# Texts and enums of a rule that a finding row repeats.
RULE_COLUMNS = ["rule_id", "title", "category", "severity", "recommendation", "fix_class", "effort", "risk", "status"]


def placed_findings(findings: DataFrame) -> DataFrame:
    """Findings as the gold store lays its rows. Between tasks the texts of the catalogue are a number and URLs leave their site
    out; whole rows are made where they are written."""
    site = F.col("site_id")
    urls = {f.name: f.dataType for f in findings.schema if f.name in ("affected_url", "affected_urls", "evidence_urls")}

    def each(name: str, change) -> Column:
        return F.transform(name, lambda u: change(u, site)) if isinstance(urls[name], ArrayType) else change(F.col(name), site)

    short = codes.coded(findings, RULE_COLUMNS).withColumns({name: each(name, codes.short_url) for name in urls})
    whole = codes.decoded(goldstore.placed(short), RULE_COLUMNS).withColumns({name: each(name, codes.long_url) for name in urls})
    return whole.select(*findings.columns)


def derived_tables(findings: DataFrame, penalties: DataFrame, config: DataFrame) -> dict[str, DataFrame]:
    """Ledger, scores, plan and queue. ``findings`` is read once, for the few rows per rule that all four need. Rows of a run
    lie together in each of them.

    ``config`` has one row per run with what the ledger needs; its runs are those that get scores."""
    # Written first: a filter on decoded rule ids would be pushed below the grouping and decode every finding.
    facts = materialise(actions.queue_facts(findings), "queue-facts")
    rows = materialise(actions.told(facts), "told")
    plan = actions.plan_of(rows)
    return {
        "ledger": rules.coverage_ledger(config, rows.filter("rule_no = 1").select(*SITE, "rule_id", "n_findings")),
        "score": scoring.scores_by(config, penalties, dims.AREAS, "area"),
        "plan": plan.select(*SITE, "plan_rank", "rule_id", "recommendation", "fix_class", "effort", "risk", "severity", "category", "phase_id"),
        "queue": actions.queue_of(rows),
    }


def page_findings(prepared: DataFrame) -> DataFrame:
    """Findings of the page rules with the page's place in its run."""
    rows = prepared.select(
        *SITE, "page_id", F.col("final_url").alias("affected_url"), F.col("ord").alias("page_ord"),
        F.posexplode(F.flatten(F.array(*rules.page_rule_structs()))).alias("emit_ord", "f"),
    )
    return rows.select(*SITE, "page_id", "affected_url", "page_ord", "emit_ord", "f.rule_id", "f.title", "f.severity", "f.refs")


def _record(rows: DataFrame, grain: str, place: Column, url: Column, seq: Column, refs: Column, n_affected: Column) -> DataFrame:
    """Rule output with advice as finding records. ``affected_url`` is the one URL of a finding about one, null for a finding
    about several, whose URLs are rows of finding_url. ``ord`` tells site rules first, then pages, then groups."""
    ord_ = F.lit(GRAINS[grain] << 60) + seq.cast("long")
    return rules.with_catalogue(rows).select(
        *SITE, ord_.alias("ord"), "rule_id", place.cast("string").alias("place"), url.cast("string").alias("affected_url"), "title", "category", "severity",
        "confidence", "status", "recommendation", "fix_class", "approval_required", "safe_to_auto_fix", "effort", "risk",
        n_affected.cast("int").alias("n_affected"), F.lit(1).alias("evidence_count"), refs.alias("refs"),
    )


def write_run_tables(
    root: str, page_raw: DataFrame, endpoints: DataFrame, sitemap_documents: DataFrame | None = None, failed_metrics: DataFrame | None = None,
    *, search_integrations: bool | DataFrame = False,
) -> str:
    """Audits the given runs and commits their eight gold tables below ``root``; returns the commit.

    Pages are parsed once. Findings and their URLs go into the open commit as soon as they are known; the other tables are
    derived from what was written, and the commit becomes visible at the end."""
    spark, commit, none = page_raw.sparkSession, goldstore.new_commit(), F.lit("")
    snap = materialise(pages.with_json_ld_types(pages.page_snapshots(page_raw)), "snapshots")
    runs = snap.select(*SITE).unionByName(endpoints.select(*SITE)).distinct()
    types = materialise(runs.join(intel.site_types(snap), SITE, "left").fillna("content", ["site_type"]), "site-types")
    prepared = rules.prepare_pages(snap, types)
    keys = materialise(rules.duplicate_keys(snap), "duplicate-keys")
    sizes = materialise(rules.duplicate_groups(keys), "duplicate-groups")
    universe = materialise(discovery.sitemap_universe(endpoints, sitemap_documents), "sitemap-urls")
    missing = materialise(rules.missing_from_sitemap(snap, universe).select(*SITE, "affected_url"), "missing-from-sitemap")
    n_missing = missing.groupBy(*SITE).agg(F.count("*").alias("n_missing_from_sitemap"))
    rollup = materialise(rules.page_rollup(snap), "page-rollup")
    found_site = materialise(
        rules.site_rule_findings(
            types, endpoints, discovery.sitemap_url_counts(endpoints, sitemap_documents, universe), rollup, types, n_missing,
            failed_metrics, search_integrations=search_integrations,
        ),
        "site-findings",
    )
    found_page = page_findings(prepared)

    c, nowhere, no_refs = F.col, F.lit(None).cast("string"), F.array().cast("array<string>")
    # A rule about pages names each of them, one row per page; the other site rules name their site.
    about = c("rule_id").isin("SEO-SITEMAP-011", "SEO-INTL-001")
    groups = rules.group_rule_findings(sizes).join(sizes.select(*SITE, "rule_id", "key_hash", "first_ord"), [*SITE, "rule_id", "key_hash"])
    rule_no = lookup(c("rule_id"), {r: i for i, r in enumerate(rules.DUPLICATE_KEYS)})
    findings = (
        _record(found_site, "site", none, F.when(~about, c("site_id")), c("emit_ord"), F.coalesce("refs", no_refs), F.lit(1))
        .unionByName(_record(found_page, "page", c("page_id"), c("affected_url"), c("page_ord") * 1000 + c("emit_ord"), c("refs"), F.lit(1)))
        .unionByName(_record(groups, "group", c("key_hash"), nowhere, c("first_ord") * 4 + rule_no, no_refs, c("n_urls")))
    )
    of_pages = missing.withColumn("rule_id", F.lit("SEO-SITEMAP-011")).unionByName(
        rules.missing_hreflang(snap).select(*SITE, "affected_url").withColumn("rule_id", F.lit("SEO-INTL-001"))
    )
    site_urls = found_site.filter(about).select(*SITE, "rule_id").join(of_pages, [*SITE, "rule_id"]).select(*SITE, "rule_id", none.alias("place"), c("affected_url").alias("url"))
    group_urls = rules.duplicate_members(keys, sizes).select(*SITE, "rule_id", c("key_hash").alias("place"), c("affected_url").alias("url"))

    parts = [evidence.page_rows(prepared), evidence.endpoint_rows(runs, endpoints), evidence.cross_page_rows(rules.group_representatives(keys, sizes), rollup)]
    if failed_metrics is not None:
        parts.append(evidence.metric_rows(failed_metrics.join(runs, SITE, "left_semi")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    first = {"finding": findings, "finding_url": site_urls.unionByName(group_urls), "evidence": rows}
    goldstore.add(root, commit, first | {"finding": placed_findings(findings)}, lying=["finding"])
    back = {name: goldstore.written(spark, root, commit, name, df.schema) for name, df in first.items()}

    second = derived_tables(back["finding"], _penalties(back["finding"], back["finding_url"]), _config(types, failed_metrics, search_integrations))
    lying = list(second)
    second["citation"] = evidence.citations(back["evidence"], found_page, sizes, found_site, endpoints)
    goldstore.add(root, commit, second, lying=lying)
    goldstore.finish(root, commit, runs, {name: df.schema for name, df in (first | second).items()})
    return commit


def _penalties(findings: DataFrame, urls: DataFrame) -> DataFrame:
    """Penalties of the groups. A finding about one URL holds it in its row; only those about several, few per run, are
    joined with their URLs."""
    of_group = [*scoring.GROUP, "confidence"]
    scored = findings.filter(F.col("status").isin(scoring.SCOREABLE))
    fact = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    told = F.concat(
        F.array(fact("f", F.lit(None).cast("string"))),
        F.filter(F.array(fact("u", F.col("affected_url"))), lambda x: x["value"].isNotNull()),
        F.transform("refs", lambda v: fact("t", v)),
    )
    facts = scored.select(*of_group, F.explode(told).alias("x")).select(*of_group, "x.kind", "x.value")
    several = scored.filter("affected_url IS NULL").select(*of_group, "place").join(urls, [*SITE, "rule_id", "place"])
    facts = facts.unionByName(several.select(*of_group, F.lit("u").alias("kind"), F.col("url").alias("value")))
    return materialise(scoring.with_penalty(scoring.group_facts(facts)), "penalties")


def _config(types: DataFrame, failed_metrics: DataFrame | None, search: bool | DataFrame) -> DataFrame:
    """What a run was asked for: all parts; vitals count as measured where the run has metrics."""
    yes = F.lit(True)
    runs = types.select(*SITE, "site_type", *[yes.alias(f"include_{p}") for p in ("agent", "accessibility", "international", "local", "commerce", "vitals")])
    measured = None if failed_metrics is None else failed_metrics.select(*SITE, yes.alias("lcp_measured")).distinct()
    runs = runs.withColumn("lcp_measured", F.lit(False)) if measured is None else runs.join(measured, SITE, "left").fillna(False, ["lcp_measured"])
    if isinstance(search, DataFrame):
        return runs.join(search.select(*SITE, F.col("search_integrations").alias("include_search")), SITE, "left").fillna(False, ["include_search"])
    return runs.withColumn("include_search", F.lit(bool(search)))
