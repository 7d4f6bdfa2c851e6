"""Data-quality checks: every check is a row (run, check_id, status, n_bad)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import privacy as x

RUN = ["site_id", "run_id"]


def check_rows(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """One scan: each check counts the rows that break it, then the counts are turned into rows.

    A check is a condition every row should satisfy; NULL counts as broken."""
    wide = df.groupBy(*keys).agg(
        *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"c{i}") for i, ok in enumerate(checks.values())]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("check_id"), F.col(f"c{i}").alias("n_bad")) for i, n in enumerate(checks)])
    long = wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.check_id", "r.n_bad")
    return long.withColumn("status", F.when(F.col("n_bad") == 0, "passed").otherwise("failed"))


def finding_contract(findings: DataFrame, keys: list[str] = RUN) -> DataFrame:
    c = F.col
    return check_rows(
        findings,
        keys,
        {
            "finding.id": c("rule_id") != "",
            "finding.title": c("title") != "",
            "finding.confidence": c("confidence").between(0, 100),
            "finding.evidence": c("evidence_count") > 0,
            "finding.recommendation": c("recommendation") != "",
            "finding.affected": (F.size("affected_urls") > 0) | (F.size("affected_templates") > 0),
        },
    )


def score_contract(scores: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Needs total, core_score, measured_rules, applicable_rules, percent_measured, experimental_combined per run."""
    c = F.col
    return check_rows(
        scores,
        keys,
        {
            "score.total": c("total").between(0, 100),
            "score.primary-profile": c("total") == c("core_score"),
            "score.coverage": (c("measured_rules") <= c("applicable_rules")) & c("percent_measured").between(0, 100),
            "score.experimental-separation": c("experimental_combined").isNotNull(),
        },
    )


def plan_contract(options: DataFrame, items: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Plan options are classified; queue items are complete and never safe and gated at once."""
    c = F.col
    plan = check_rows(
        options,
        keys,
        {
            "plan.classification": c("fix_class").isin("safe_auto_fix", "approval_required", "manual_strategy"),
            "plan.phases": c("phase_id").isNotNull(),
        },
    )
    board = check_rows(
        items,
        keys,
        {
            "dashboard.queue-title": c("item_title") != "",
            "dashboard.queue-owner": c("owner").isNotNull(),
            "dashboard.queue-gates": ~(c("safe_to_auto_fix") & c("approval_required")),
        },
    )
    return plan.unionByName(board)


def scan_artifacts(pages: DataFrame, endpoints: DataFrame, sitemap_urls: DataFrame, uncrawled: DataFrame) -> DataFrame:
    """Checks over the crawl itself, one row per run and check.

    Every part is an aggregate to the run before anything is united, so the union holds a few rows per run."""
    c = F.col
    status = F.when(c("n_bad") == 0, "passed").otherwise("failed")

    def rows(df: DataFrame, check: str, n_bad: Column) -> DataFrame:
        return df.select(*RUN, F.lit(check).alias("check_id"), n_bad.cast("long").alias("n_bad"))

    page_facts = pages.groupBy(*RUN).agg(
        F.count("*").alias("n_pages"),
        F.sum(F.size(F.filter("json_ld", lambda b: b["parse_error"]))).alias("n_bad_ld"),
        F.count_if(F.coalesce(x.is_private_url(c("canonical")), F.lit(False))).alias("n_private_canonical"),
    )
    probed = endpoints.groupBy(*RUN).agg(
        F.count_if(c("path") == "/robots.txt").alias("n_robots"),
        F.count_if(c("path") == "/sitemap.xml").alias("n_sitemap"),
        F.count_if(c("path") == "/llms.txt").alias("n_llms"),
        F.count_if(
            (c("path") == "/llms.txt") & c("ok") & (F.size(x.private_references(F.coalesce("body", F.lit("")))) > 0)
        ).alias("n_llms_private"),
    )
    private = sitemap_urls.groupBy(*RUN).agg(F.count_if(x.is_private_url(c("loc"))).alias("n_private"))
    links = uncrawled.groupBy(*RUN).agg(F.count("*").alias("n_uncrawled"))
    parts = [
        rows(page_facts, "site.pages-crawled", F.when(c("n_pages") > 0, 0).otherwise(1)),
        rows(page_facts, "jsonld.parse", c("n_bad_ld")),
        rows(page_facts, "canonical.no-private", c("n_private_canonical")),
        rows(probed, "site.robots-probed", F.when(c("n_robots") > 0, 0).otherwise(1)),
        rows(probed, "site.sitemap-probed", F.when(c("n_sitemap") > 0, 0).otherwise(1)),
        rows(probed, "site.llms-probed", F.when(c("n_llms") > 0, 0).otherwise(1)),
        rows(probed, "llms.no-private-refs", c("n_llms_private")),
        rows(private, "sitemap.no-private-urls", c("n_private")),
        rows(links, "links.internal-coverage", c("n_uncrawled")),
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("status", status)


def metric_honesty(metrics: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """A vital that was not measured carries no value."""
    vital = F.col("metric_id").isin("lcp-ms", "inp-ms", "cls", "ttfb-ms", "fcp-ms")
    honest = ~vital | (F.col("reliability") != "not_measured") | F.col("value").isNull() | (F.col("status") == "not_measured")
    return check_rows(metrics, keys, {"performance.cwv-no-fake-measurement": honest})


def bounded_payloads(resource_counts: DataFrame, keys: list[str] = RUN, limit: int = 2000) -> DataFrame:
    return check_rows(resource_counts, keys, {"performance.resources-bounded": F.col("n") <= limit})


def finding_safety(findings: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Approval boundary, safe fixes that conflict with it, and private references in advice."""
    c = F.col
    text = F.concat_ws("\n", "title", "recommendation")
    return check_rows(
        findings,
        keys,
        {
            "finding.approval": ~x.needs_approval(text) | c("approval_required"),
            "finding.safe-conflict": ~(c("safe_to_auto_fix") & c("approval_required")),
            "finding.private-suggestion": F.size(x.private_references(c("recommendation"))) == 0,
        },
    )


def citation_support(links: DataFrame, known: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Claims whose every link hits a known id of its kind.

    ``links``: keys, claim_id, kind, ref (kind and ref NULL for a claim without links). All known sets are
    united into one (kind, ref) table that is joined once; a link counts as found when it matches."""
    c = F.col
    sets = reduce(
        DataFrame.unionByName,
        [df.select(*keys, F.lit(kind).alias("kind"), c("ref")).distinct() for kind, df in known.items()],
    ).withColumn("hit", F.lit(True))
    joined = links.join(sets, [*keys, "kind", "ref"], "left")
    per_claim = joined.groupBy(*keys, "claim_id").agg(
        F.count("ref").alias("n_links"), F.count_if(F.coalesce("hit", F.lit(False))).alias("n_found")
    )
    return per_claim.withColumn("supported", (c("n_links") > 0) & (c("n_links") == c("n_found")))


ID_ATTR = r'\sid="([^"]+)"'
TARGET_ATTR = r'(?:href="#|data-copy=")([^"]+)"'


def html_id_checks(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Ids used twice in a document and targets that no id answers, counted inside the document's own row."""
    ids = F.regexp_extract_all(html, F.lit(ID_ATTR), F.lit(1))
    targets = F.regexp_extract_all(html, F.lit(TARGET_ATTR), F.lit(1))
    staged = pages.select(*keys, ids.alias("ids"), targets.alias("targets"))
    return staged.select(
        *keys,
        (F.size("ids") - F.size(F.array_distinct("ids"))).alias("n_duplicate_ids"),
        F.size(F.array_except("targets", "ids")).alias("n_dangling"),
    )


def review_contract(reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Risky review text must be gated and a gated copy item cannot be marked safe."""
    c = F.col
    gated = c("approval_state") == "approval_required"
    return check_rows(
        reviews,
        keys,
        {
            "review.approval": ~x.needs_review_approval(c("text")) | gated,
            "review.safe-boundary": ~c("safe_to_apply") | ~gated,
            "review.text": F.length("text") > 0,
        },
    )


def learning_contract(items: DataFrame, keys: list[str]) -> DataFrame:
    """Retrospective items: known kind, non-empty text, evidence."""
    c = F.col
    return check_rows(
        items,
        keys,
        {
            "learning.kind": c("kind").isin("improvement", "blocker", "learning"),
            "learning.text": F.length(F.trim("text")) > 0,
            "learning.evidence": c("n_evidence") > 0,
        },
    )


CHECK_STATUSES = ["passed", "failed", "warning", "not_applicable"]


def check_counts(checks: DataFrame, keys: list[str] = RUN) -> DataFrame:
    return checks.groupBy(*keys).agg(*[F.count_if(F.col("status") == s).alias(s) for s in CHECK_STATUSES])


def attention(checks: DataFrame) -> DataFrame:
    return checks.filter(F.col("status").isin("failed", "warning"))


def standards_snapshot(rules: DataFrame, standards: DataFrame, keys: list[str]) -> DataFrame:
    """A snapshot lists standards, maps rules and counts implemented ones."""
    a = rules.groupBy(*keys).agg(F.count("*").alias("n_rules"), F.count_if("implemented").alias("n_implemented"))
    b = standards.groupBy(*keys).agg(F.count("*").alias("n_standards"))
    joined = a.join(b, keys, "left").fillna(0, ["n_standards"])
    return check_rows(
        joined,
        keys,
        {
            "standards.snapshot-standards": F.col("n_standards") > 0,
            "standards.snapshot-rule-mapping": F.col("n_rules") > 0,
            "standards.snapshot-rule-count": F.col("n_implemented") > 0,
        },
    )


def missing_artifacts(expected: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Expected files that no run wrote."""
    return expected.join(written.select(*keys, "path").distinct(), [*keys, "path"], "left_anti")


FIELD_STATUSES = ["disabled", "ok", "partial", "unavailable", "failed"]
PROVIDERS = ["crux", "gsc", "rum"]


def field_contract(reports: DataFrame, keys: list[str]) -> DataFrame:
    return check_rows(
        reports,
        keys,
        {
            "field-data.status": F.col("status").isin(FIELD_STATUSES),
            "field-data.providers": F.forall("providers", lambda p: p.isin(PROVIDERS)),
        },
    )


def completion_contract(rows: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    return check_rows(
        rows,
        keys,
        {
            "workflow-completion.status": c("status").isin("complete", "blocked"),
            "workflow-completion.retrospective-status": c("retrospective_status").isin("pending", "complete", "invalid"),
            "workflow-completion.checks": c("n_checks") > 0,
        },
    )


def review_summary(rows: DataFrame) -> DataFrame:
    """Strategic findings, copy items and gated copy items of a review."""
    c = F.col
    copy = c("kind") == "copy"
    return rows.groupBy("review_id").agg(
        F.count_if(c("kind") == "strategic").alias("strategic_findings"),
        F.count_if(copy).alias("copy_items"),
        F.count_if(copy & (c("approval_state") == "approval_required")).alias("approval_gated"),
    )
