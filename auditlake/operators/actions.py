"""From findings to work: owners, readiness, remediation options, queue, matrix and heat map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions import urls as u
from auditlake.functions.numeric import lookup, name_of, rank_case, round_half_up
from auditlake.functions.text import slugify
from auditlake.operators.codes import KEY, coded, decoded
from auditlake.operators.ranking import ranked, top_k

SITE = ["site_id", "run_id"]
RULE = ["rule_id", "title", "severity", "category"]
GROUP = [*SITE, *RULE]
OPTION = [*RULE, "recommendation", "fix_class"]
FIX_ORDER_PLAN = ["safe_auto_fix", "approval_required", "manual_strategy"]
FIX_ORDER_QUEUE = ["safe_auto_fix", "manual_strategy", "approval_required", "not_applicable"]
EFFORTS = ["small", "medium", "large"]
IMPACTS = ["high", "medium", "low"]
AGENT = ["agent_readiness", "protocol_discovery", "api_auth_mcp", "policy"]
# Fixed values of the priority score.
SEVERITY_POINTS = {"critical": 100.0, "high": 80.0, "medium": 50.0, "low": 20.0, "info": 5.0}
IMPACT_POINTS = {"high": 20.0, "medium": 10.0, "low": 0.0}
# Owner of a category where a finding has no actionability of its own.
FALLBACK_OWNERS = {
    "policy": "policy", "security": "security", "performance_seo": "frontend", "structured_data": "backend",
    "api_auth_mcp": "backend", "protocol_discovery": "backend", "content_seo": "content", "onpage_seo": "content",
    "media_seo": "content", "agent_readiness": "agent-platform",
}


def owner(category: Column) -> Column:
    return lookup(category, dims.OWNERS, "unknown")


def fallback_owner(category: Column) -> Column:
    return lookup(category, FALLBACK_OWNERS, "seo")


def impact(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "high").when(severity == "medium", "medium").otherwise("low")


def readiness(approval: Column, safe: Column, n_sources: Column) -> Column:
    return (
        F.when(approval, "approval_required")
        .when(n_sources > 0, "repo_assisted")
        .when(safe, "auto")
        .otherwise("manual")
    )


def actionability(findings: DataFrame, repo_connected: Column, n_sources: Column) -> DataFrame:
    """Owner, readiness, impact, next step and blockers of each finding."""
    blockers = F.array_compact(
        F.array(
            F.when(F.col("approval_required"), "owner approval required"),
            F.when(~repo_connected, "website source repo not connected").when(
                n_sources == 0, "no confident source candidate found"
            ),
            F.when(F.col("evidence_count") == 0, "missing evidence"),
        )
    )
    step = (
        F.when(F.col("approval_required"), "get_approval")
        .when(n_sources > 0, "edit_source")
        .otherwise("edit_site")
    )
    return findings.select(
        "*",
        owner(F.col("category")).alias("owner"),
        readiness(F.col("approval_required"), F.col("safe_to_auto_fix"), n_sources).alias("readiness"),
        impact(F.col("severity")).alias("expected_impact"),
        step.alias("next_step"),
        blockers.alias("blockers"),
    )


def source_route(rule_id: Column, category: Column) -> Column:
    """Which kinds of repository files a finding is routed to, in order of preference, and how many are listed."""
    rid = F.lower(rule_id)

    def route(kinds: list[str], limit: int) -> Column:
        return F.struct(F.array(*[F.lit(k) for k in kinds]).alias("kinds"), F.lit(limit).alias("max_files"))

    return (
        F.when(rid.contains("robots"), route(["robots"], 5))
        .when(rid.contains("sitemap"), route(["sitemap"], 5))
        .when(rid.rlike("llms|mcp|api|auth"), route(["match:llms|mcp|api|auth|well-known|public"], 5))
        .when(
            category.isin("onpage_seo", "indexability", "structured_data", "international_seo")
            | rid.rlike("schema|canonical"),
            route(["metadata", "route", "match:seo|metadata|head|layout|document"], 8),
        )
        .when(category.isin("content_seo", "internal_linking"), route(["content", "route"], 8))
        .when(category.isin("media_seo", "accessibility"), route(["route", "static_asset"], 8))
        .when(category.isin("performance_seo", "technical_seo"), route(["deployment", "framework_config", "route"], 8))
        .when(category.isin("security", "policy"), route(["robots", "sitemap", "metadata", "deployment"], 8))
        .otherwise(route(["route"], 5))
    )


def source_candidates(finding_kinds: DataFrame, repo_files: DataFrame) -> DataFrame:
    """Top files per (site, rule). ``finding_kinds``: distinct (site, rule, category); ``repo_files``: site, path,
    kind, ord. Routes are exploded to one row per kind so that the join is an equality; the three text routes
    become a kind of their own on the file side. Files keep their concatenation order, repeats included."""
    routes = finding_kinds.select(
        "site_id", "rule_id", F.posexplode(source_route(F.col("rule_id"), F.col("category"))["kinds"]).alias("prio", "kind"),
        source_route(F.col("rule_id"), F.col("category"))["max_files"].alias("max_files"),
    )
    path = F.lower("path")
    texts = ["llms|mcp|api|auth|well-known|public", "seo|metadata|head|layout|document"]
    kinds = F.array_compact(F.array(F.col("kind"), *[F.when(path.rlike(t), F.lit(f"match:{t}")) for t in texts]))
    files = repo_files.select("site_id", "path", "ord", F.explode(kinds).alias("kind"))
    # No more than the first 8 files of a kind can be among the first 8 of a rule.
    files = top_k(files, ["site_id", "kind"], [F.col("ord"), F.col("path")], 8).drop("rank")
    joined = routes.join(files, ["site_id", "kind"])
    best = top_k(joined, ["site_id", "rule_id"], [F.col("prio"), F.col("ord"), F.col("path")], 8)
    return best.filter(F.col("rank") <= F.col("max_files")).select("site_id", "rule_id", "rank", "path", "kind")


RISKS = ["low", "medium", "high"]


def queue_facts(findings: DataFrame) -> DataFrame:
    """The one pass over the findings that plan and queue need: per group and option the count, the flags, the evidence
    and the first finding. Everything below works on these few rows.

    Flags and places of enum values of the first finding lie in the bits of one number, and the rule's texts are a number
    too: rows stay short, and this stays a hash aggregation with map-side combine."""
    c, kind = F.col, findings.schema["n_affected"].dataType
    bits = [
        (c("n_affected").isNull().cast("int"), 1), (_flag("approval_required"), 2), (_flag("safe_to_auto_fix"), 2),
        (rank_case(c("effort"), EFFORTS), 2), (rank_case(c("risk"), RISKS), 2),
    ]
    packed = F.coalesce(c("n_affected").cast("long"), F.lit(0))
    for value, width in bits:
        packed = F.shiftleft(packed, width) + value
    rows = coded(findings, OPTION).select(*SITE, *KEY, "ord", "evidence_count", packed.alias("first"))
    short = rows.groupBy(*SITE, *KEY).agg(
        F.count("*").alias("n"), F.sum("evidence_count").alias("evidence"), F.min("ord").alias("ord"), F.min_by("first", "ord").alias("first")
    )
    part = lambda shift, width=2: F.shiftright("first", shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    flag = lambda shift: F.when(part(shift) < 2, part(shift) == 1)
    return decoded(short, OPTION).select(
        *GROUP, "recommendation", "fix_class", "n", "evidence", "ord", flag(6).alias("approval_required"), flag(4).alias("safe_to_auto_fix"),
        F.when(part(8, 1) == 0, F.shiftright("first", 9)).cast(kind).alias("n_affected"), part(2).alias("k_effort"), part(0).alias("k_risk"),
    )


def _flag(column: str) -> Column:
    """0 or 1, 2 for null."""
    return F.coalesce(F.col(column).cast("int"), F.lit(2))


def unique_options(facts: DataFrame) -> DataFrame:
    """Remediation options, first of each (rule, advice, fix class) kept."""
    advice = ["rule_id", "recommendation", "fix_class"]
    marks = (F.col("k_effort") * 4 + F.col("k_risk")).alias("marks")
    short = coded(facts.select(*SITE, *advice, "ord", marks), advice).groupBy(*SITE, *KEY)
    best = decoded(short.agg(F.min("ord").alias("ord"), F.min_by("marks", "ord").alias("marks")), advice)
    return best.select(
        *SITE, *advice, "ord", name_of(F.floor(F.col("marks") / 4).cast("int"), EFFORTS).alias("effort"), name_of(F.col("marks") % 4, RISKS).alias("risk")
    )


def told(facts: DataFrame) -> DataFrame:
    """Facts with what the first finding and the last group of their rule tell, their place among the rule's facts and among those
    of their option, and the option's rank in the plan.

    A run has few facts, however many findings it has. So the facts of a run meet in one task: they travel once, with short
    keys, and everything is a window inside the run instead of a join. The last group is the one that wins the lookup by rule in
    the order severity, count, title."""
    c = F.col
    rows = facts.filter(c("site_id").isNotNull() & c("run_id").isNotNull() & c("rule_id").isNotNull())
    rows = decoded(coded(rows, OPTION).repartition(*SITE), OPTION)
    rule, option = W.partitionBy(*SITE, "rule_id"), W.partitionBy(*SITE, "rule_id", "recommendation", "fix_class")
    seen = [c("ord").asc_nulls_last(), c("k_effort"), c("k_risk")]
    first = F.struct("ord", "title", "severity", "category", "approval_required", "safe_to_auto_fix", "n_affected")
    rows = rows.select(
        "*",
        F.min(first).over(rule).alias("first"), F.sum("n").over(rule).alias("n_findings"),
        F.row_number().over(rule.orderBy(*seen)).alias("rule_no"), F.row_number().over(option.orderBy(*seen)).alias("option_no"),
        F.max(F.coalesce(c("fix_class") != "not_applicable", F.lit(False))).over(rule).alias("has_option"),
        F.sum("n").over(W.partitionBy(*GROUP)).alias("group_n"), F.sum("evidence").over(W.partitionBy(*GROUP)).alias("group_evidence"),
    )
    order = [rank_case(c("severity"), dims.SEVERITIES).alias("k1"), (-c("group_n")).alias("k2"), c("title").alias("k3")]
    last = F.max(F.struct(*order, c("group_n").alias("instances"), c("group_evidence").alias("n_evidence"))).over(rule)
    rows = rows.select(
        *SITE, "rule_id", "recommendation", "fix_class", name_of(c("k_effort"), EFFORTS).alias("effort"), name_of(c("k_risk"), RISKS).alias("risk"),
        "ord", "first", last.alias("last"), "n_findings", "rule_no", "option_no", "has_option",
    )
    place = W.partitionBy(*SITE).orderBy(c("option_no") > 1, *_plan_keys().values(), "ord", "rule_id", "recommendation")
    return rows.withColumn("plan_rank", F.row_number().over(place).cast("long"))


def _plan_keys() -> dict[str, Column]:
    """Plan order: severity, fix class, affected count, effort, then first seen."""
    c = F.col
    return {
        "k_severity": rank_case(c("first.severity"), dims.SEVERITIES), "k_fix": rank_case(c("fix_class"), FIX_ORDER_PLAN),
        "k_affected": -c("first.n_affected"), "k_effort": rank_case(c("effort"), EFFORTS),
    }


def plan(facts: DataFrame) -> DataFrame:
    """Options with their rank, the keys of their order and their phase (NULL where no phase applies)."""
    return plan_of(told(facts))


def plan_of(rows: DataFrame) -> DataFrame:
    """The plan from what :func:`told` gives."""
    c = F.col
    severity, category = c("first.severity"), c("first.category")
    open_ = c("fix_class") != "approval_required"
    agent = category.isin(AGENT)
    phase = (
        F.when(~open_, "user_decision_required")
        .when(severity.isin("critical", "high") & ~agent, "do_now_seo")
        .when(severity.isin("critical", "high") & agent, "do_now_agent")
        .when((severity == "medium") & ~agent, "do_next_seo")
        .when(severity.isin("medium", "low") & agent, "do_next_agent")
        .when(severity.isin("low", "info") & ~agent, "later")
    )
    return rows.filter("option_no = 1").select(
        *SITE, "rule_id", "recommendation", "fix_class", "effort", "risk", "ord", severity.alias("severity"), category.alias("category"),
        phase.alias("phase_id"), *[key.alias(name) for name, key in _plan_keys().items()], "plan_rank",
    )


def finding_groups(findings: DataFrame) -> DataFrame:
    """Groups for the queue: counts, flags, evidence, first position, distinct URL count by two-level grouping."""
    base = findings.groupBy(*GROUP).agg(
        F.count("*").alias("n_findings"),
        F.bool_or("safe_to_auto_fix").alias("safe_to_auto_fix"),
        F.bool_or("approval_required").alias("approval_required"),
        F.sum("evidence_count").alias("n_evidence"),
        F.min("ord").alias("first_ord"),
    )
    urls = (
        findings.select(*GROUP, F.explode("affected_urls").alias("v"))
        .groupBy(*GROUP, "v")
        .agg(F.lit(1).alias("one"))
        .groupBy(*GROUP)
        .agg(F.count("*").alias("n_urls"))
    )
    return base.join(urls, GROUP, "left").fillna(0, ["n_urls"])


def queue(facts: DataFrame) -> DataFrame:
    """Queue items: every option with its first finding and the last group of the rule, then the rules left over."""
    return queue_of(told(facts))


def queue_of(rows: DataFrame) -> DataFrame:
    """The queue from what :func:`told` gives."""
    c, f = F.col, lambda name: F.col("first")[name]
    of_option = (c("option_no") == 1) & (c("fix_class") != "not_applicable")
    # A rule without an option has one item, which its first finding tells.
    left_over = (c("rule_no") == 1) & ~c("has_option")
    either = lambda option, finding: F.when(c("has_option"), option).otherwise(finding)
    approval, safe, severe = f("approval_required"), f("safe_to_auto_fix"), f("severity").isin("critical", "high")
    items = rows.filter(of_option | left_over).select(
        *SITE,
        either(slugify(F.concat_ws("-", "rule_id", "rule_id", F.lit("FIX"))), slugify(F.concat_ws("-", "rule_id", F.lit("finding")))).alias("item_id"),
        "rule_id", either(c("recommendation"), f("title")).alias("item_title"), f("severity").alias("severity"), f("category").alias("category"),
        either(c("fix_class"), F.when(approval, "approval_required").when(safe, "safe_auto_fix").otherwise("manual_strategy")).alias("fix_class"),
        either(c("effort"), F.when(severe, "medium").otherwise("small")).alias("effort"),
        either(c("risk"), F.when(approval, "high").when(f("severity") == "critical", "medium").otherwise("low")).alias("risk"),
        either((c("fix_class") == "approval_required") | approval, approval).alias("approval_required"),
        either((c("fix_class") == "safe_auto_fix") & ~approval, safe).alias("safe_to_auto_fix"),
        c("last")["instances"].alias("instances"), c("last")["n_evidence"].alias("n_evidence"),
    )
    return items.select("*", impact(c("severity")).alias("expected_impact"), owner(c("category")).alias("owner"))


def search_opportunity(item_urls: DataFrame, search_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Clicks, impressions and weighted position of the search rows on each item's URLs.

    Search rows are summed per normalised page first, so the join meets one row per page and a hot page is
    already combined."""
    sums = [
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.sum("weighted").alias("weighted"),
        F.sum("n_rows").alias("n_rows"),
    ]
    # Summed by page text first: the comparison form is then computed once per distinct page.
    by_page = (
        search_rows.filter(F.col("page").isNotNull() & (F.col("page") != ""))
        .withColumns({"weighted": F.col("position") * F.col("impressions"), "n_rows": F.lit(1)})
        .groupBy("site_id", "page")
        .agg(*sums)
    )
    pages = by_page.groupBy("site_id", u.queue_form(F.col("page")).alias("form")).agg(*sums)
    urls = item_urls.select(*keys, u.queue_form(F.col("url")).alias("form"))
    joined = urls.join(pages, ["site_id", "form"])
    return joined.groupBy(*keys).agg(
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        (F.sum("weighted") / F.nullif(F.sum("impressions"), F.lit(0))).alias("average_position"),
        F.sum("n_rows").alias("matched_rows"),
    )


def priority_score(severity: Column, expected: Column, clicks: Column, impressions: Column, position: Column) -> Column:
    near = F.when(position.isNotNull() & (position >= 4) & (position <= 20), 15.0).otherwise(0.0)
    total = (
        lookup(severity, SEVERITY_POINTS)
        + lookup(expected, IMPACT_POINTS)
        + F.least(F.lit(20.0), F.log10(F.coalesce(impressions, F.lit(0)) + 1) * 5)
        + F.least(F.lit(10.0), F.log10(F.coalesce(clicks, F.lit(0)) + 1) * 4)
        + near
    )
    return round_half_up(F.round(total, 9), 1)


def queue_order() -> list[Column]:
    """The eight keys of the queue order; the title only parts options that share an id."""
    c = F.col
    return [
        c("priority_score").desc(),
        rank_case(c("severity"), dims.SEVERITIES),
        rank_case(c("expected_impact"), IMPACTS),
        c("approval_required").cast("int"),
        rank_case(c("fix_class"), FIX_ORDER_QUEUE),
        rank_case(c("effort"), EFFORTS),
        c("rule_id"),
        c("item_id"),
        c("item_title"),
    ]


def ranked_queue(items: DataFrame) -> DataFrame:
    """Whole queue with its positions; the leading score buckets the sort."""
    return ranked(items, SITE, -F.floor(F.col("priority_score") * 10), queue_order(), "queue_rank")


def highlights(items: DataFrame) -> DataFrame:
    """Next best fixes (8), the wins among them (5), top risks (5) and every approval, as list name and rank."""
    c, order = F.col, queue_order()
    best = top_k(items.filter(~c("approval_required") & (c("fix_class") != "not_applicable")), SITE, order, 8, "list_rank")
    wins = top_k(best.filter(c("expected_impact") != "low").drop("list_rank"), SITE, order, 5, "list_rank")
    risks = top_k(items.filter(c("severity").isin("critical", "high")), SITE, order, 5, "list_rank")
    waiting = ranked(
        items.filter("approval_required"), SITE, -F.floor(c("priority_score") * 10), order, "list_rank"
    )
    lists = {"next_best_fixes": best, "top_wins": wins, "top_risks": risks, "approvals": waiting}
    out = None
    for name, rows in lists.items():
        rows = rows.select(*SITE, F.lit(name).alias("list"), c("list_rank").cast("long").alias("list_rank"), "rule_id", "item_id", "item_title")
        out = rows if out is None else out.unionByName(rows)
    return out


def quadrants(items: DataFrame, size: int = 12) -> DataFrame:
    """Impact/effort matrix, the first items of each quadrant; one item may stand in two."""
    c = F.col
    quick = ~c("approval_required") & (c("effort") == "small") & (c("expected_impact") != "low")
    major = ~c("approval_required") & (c("expected_impact") == "high") & (c("effort") != "small")
    fill = ~quick & ~major & ~c("approval_required")
    names = F.array_compact(
        F.array(
            F.when(quick, "quick_wins"),
            F.when(major, "major_projects"),
            F.when(fill, "fill_ins"),
            F.when(c("approval_required"), "strategic_approvals"),
        )
    )
    rows = items.select("*", F.explode(names).alias("quadrant"))
    return top_k(rows, [*SITE, "quadrant"], queue_order(), size, "quadrant_rank")


def template_heatmap(findings: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """Issues per template with 8-item samples; distinct values are counted before any array is built."""
    named = F.when(F.size("affected_templates") > 0, F.col("affected_templates")).otherwise(
        F.array(F.lit("Unmapped URL-level issues"))
    )
    rows = findings.select("*", F.explode(named).alias("template"))
    key = [*SITE, "template"]
    base = rows.groupBy(*key).agg(
        F.count("*").alias("issue_count"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("critical_high"),
    )
    ids = rows.groupBy(*key, "rule_id").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count("*").alias("n_rules"))
    url_rows = rows.select(*key, F.explode("affected_urls").alias("url")).distinct()
    sample = top_k(url_rows, key, [F.col("url")], 8).groupBy(*key).agg(
        F.array_join(F.array_sort(F.collect_list("url")), "|").alias("url_sample")
    )
    out = base.join(ids, key, "left").join(sample, key, "left")
    if templates is not None:
        # Labels collide, so the last details of a label are taken.
        details = templates.groupBy(*SITE, F.col("label").alias("template")).agg(
            F.max_by("url_pattern", "ord").alias("url_pattern"), F.max_by("page_count", "ord").alias("page_count")
        )
        out = out.join(details, key, "left")
    return out


def actionability_counts(findings: DataFrame) -> DataFrame:
    """Findings by owner and by readiness in one pass."""
    long = findings.select(
        *SITE,
        F.explode(
            F.array(
                F.struct(F.lit("owner").alias("dimension"), F.col("owner").alias("value")),
                F.struct(F.lit("readiness").alias("dimension"), F.col("readiness").alias("value")),
            )
        ).alias("d"),
    )
    return long.groupBy(*SITE, "d.dimension", "d.value").agg(F.count("*").alias("n"))


def manual_actions(findings: DataFrame, safe_rules: DataFrame) -> DataFrame:
    """Advice that is not covered by a safe fix, with its instance count."""
    rest = findings.join(safe_rules, [*SITE, "rule_id"], "left_anti")
    return rest.groupBy(*SITE, "rule_id", "recommendation").agg(F.count("*").alias("n"))


# Which decisions ask about which rules.
DECISION_PREFIXES = [
    ("ai-input-policy", "AR-ROBOTS-004"),
    ("ai-training-policy", "AR-ROBOTS-004"),
    ("mcp-publication", "AR-MCP-"),
    ("authenticated-agent-access", "AR-AUTH-"),
    ("indexnow", "SEO-SEARCH-"),
]


def relevant_decisions(findings: DataFrame) -> DataFrame:
    """Decisions some finding of the run asks for; five prefixes tested per distinct rule, no join."""
    rules = findings.select(*SITE, "rule_id").distinct()
    hits = F.array_compact(F.array(*[F.when(F.col("rule_id").startswith(p), F.lit(d)) for d, p in DECISION_PREFIXES]))
    return rules.select(*SITE, F.explode(hits).alias("decision_id")).distinct()


def decision_queue(findings: DataFrame) -> DataFrame:
    """User decisions plus one approval per approval-required option that no decision covers yet."""
    asked = relevant_decisions(findings)
    approvals = (
        findings.filter(F.col("fix_class") == "approval_required")
        .select(*SITE, F.concat(F.lit("finding-"), F.lower("rule_id")).alias("decision_id"))
        .distinct()
    )
    fresh = approvals.join(asked, [*SITE, "decision_id"], "left_anti")
    return asked.withColumn("kind", F.lit("policy")).unionByName(fresh.withColumn("kind", F.lit("approval")))


POLICY_ASKS = {
    "ai_input": ("ask", "DECISION-AI-INPUT"),
    "ai_train": ("ask", "DECISION-AI-TRAIN"),
}
POLICY_ENABLED = {"mcp_mutations": "DECISION-MCP-MUTATIONS", "commerce_actions": "DECISION-COMMERCE-ACTIONS"}


def policy_options(policies: DataFrame) -> DataFrame:
    """Approval options that follow from a run's policy row."""
    tests = [F.when(F.col(c) == v, F.lit(d)) for c, (v, d) in POLICY_ASKS.items()]
    tests += [F.when(F.col(c) != "disabled", F.lit(d)) for c, d in POLICY_ENABLED.items()]
    return policies.select(*SITE, F.explode(F.array_compact(F.array(*tests))).alias("option_id"))


def format_sample(values: DataFrame, keys: list[str], column: str, visible: int = 8) -> DataFrame:
    """First values of each key in order, and how many more there are; 'N/A' never occurs as keys come from rows."""
    distinct = values.select(*keys, column).distinct()
    totals = distinct.groupBy(*keys).agg(F.count("*").alias("total"))
    shown = top_k(distinct, keys, [F.col(column)], visible).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(column)), ", ").alias("shown")
    )
    more = F.col("total") - F.least(F.col("total"), F.lit(visible))
    return totals.join(shown, keys).select(
        *keys,
        F.when(more > 0, F.concat("shown", F.lit(" plus "), more.cast("string"), F.lit(" more")))
        .otherwise(F.col("shown"))
        .alias("text"),
    )


def review_packet(groups: DataFrame, findings: DataFrame, n_groups: int = 30, n_values: int = 12) -> DataFrame:
    """The first groups of a run with a bounded list of URLs each, for a reviewer."""
    order = [rank_case(F.col("severity"), dims.SEVERITIES), F.col("n_findings").desc(), F.col("rule_id"), F.col("title")]
    first = top_k(groups, SITE, order, n_groups, "group_rank")
    urls = findings.join(first.select(*GROUP), GROUP, "left_semi").select(*GROUP, F.explode("affected_urls").alias("url")).distinct()
    lists = top_k(urls, GROUP, [F.col("url")], n_values).groupBy(*GROUP).agg(
        F.array_join(F.array_sort(F.collect_list("url")), "|").alias("urls")
    )
    return first.join(lists, GROUP, "left")


# Numbered report sections and the categories each one shows; the others show no findings.
SECTIONS = {
    4: ["technical_seo", "crawlability", "indexability"],
    5: ["agent_readiness", "protocol_discovery", "api_auth_mcp"],
    6: ["technical_seo"],
    7: ["crawlability", "indexability"],
    8: ["onpage_seo"],
    9: ["content_seo"],
    10: ["internal_linking"],
    11: ["structured_data"],
    12: ["performance_seo"],
    13: ["javascript_seo"],
    14: ["media_seo", "accessibility"],
    15: ["international_seo"],
    16: ["local_seo"],
    17: ["ecommerce_seo"],
    18: ["crawlability", "agent_readiness"],
    19: ["agent_readiness"],
    20: ["protocol_discovery", "api_auth_mcp"],
    21: ["security", "policy"],
}
N_SECTIONS = 27


def section_findings(findings: DataFrame) -> DataFrame:
    """Findings per report section; a category may belong to several sections."""
    hits = [F.when(F.col("category").isin(cats), F.lit(number)) for number, cats in SECTIONS.items()]
    member = F.array_compact(F.array(*hits))
    return findings.select(*SITE, F.explode(member).alias("section")).groupBy(*SITE, "section").agg(F.count("*").alias("n"))


def evidence_stats(findings: DataFrame, items: DataFrame) -> DataFrame:
    a = findings.groupBy(*SITE).agg(F.count("*").alias("findings"), F.sum("evidence_count").alias("evidence_entries"))
    g = findings.select(*GROUP).distinct().groupBy(*SITE).agg(F.count("*").alias("grouped_findings"))
    i = items.groupBy(*SITE).agg(
        F.count_if("approval_required").alias("approval_required"), F.count_if("safe_to_auto_fix").alias("safe_auto_fixes")
    )
    return a.join(g, SITE).join(i, SITE, "left").fillna(0)
