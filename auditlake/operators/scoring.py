"""Scores of a run: grouped findings, penalties, areas, profiles, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions.numeric import clamp, lookup
from auditlake.operators.codes import KEY, coded, decoded, short_url
from auditlake.session import materialise

SITE = ["site_id", "run_id"]
RULE = ["rule_id", "title", "category", "severity"]
GROUP = [*SITE, *RULE]
SCOREABLE = ["open", "warning"]


def _scoreable(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("status").isin(SCOREABLE))


def _facts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding, which also tells its first template, and one per URL and per further template that it names."""
    fact = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    named = lambda kind, column: F.transform(column, lambda v: fact(kind, v))
    templates = F.col("affected_templates")
    facts = F.concat(
        F.array(fact("f", F.get(templates, F.lit(0)))),
        named("u", F.concat("affected_urls", "evidence_urls")),
        named("t", F.slice(templates, F.lit(2), F.greatest(F.size(templates) - 1, F.lit(0)))),
    )
    return findings.select(*keys, "confidence", F.explode(facts).alias("x")).select(*keys, "confidence", "x.kind", "x.value")


def finding_facts(findings: DataFrame) -> DataFrame:
    """Scoreable findings as long rows: kind f for the finding with its first template as value, u for a URL, t for a further
    template."""
    return _facts(_scoreable(findings), GROUP)


def group_facts(facts: DataFrame) -> DataFrame:
    """Counts per (rule, title, category, severity) of long rows as :func:`finding_facts` gives them."""
    return _counted(coded(facts, RULE))


def _counted(facts: DataFrame) -> DataFrame:
    """Counting by value first and by group afterwards spreads a group of any size over the tasks, and needs no
    multi-distinct expansion. Nearly every value is its own row, so rows are kept short: a URL below its site leaves the
    site out, and the rule's texts are a number."""
    c = F.col
    fact = F.when(c("kind") == "u", short_url(c("value"), c("site_id"))).otherwise(F.concat(F.lit("t"), c("value")))
    short = facts.select(*SITE, *KEY, fact.alias("fact"), (c("kind") == "f").cast("int").alias("n"), "confidence")
    by_value = short.groupBy(*SITE, *KEY, "fact").agg(F.sum("n").alias("n"), F.max("confidence").alias("confidence"))
    groups = by_value.groupBy(*SITE, *KEY).agg(
        F.sum("n").alias("n_findings"),
        F.max("confidence").alias("confidence"),
        F.count_if(~c("fact").startswith("t")).alias("n_urls"),
        F.count_if(c("fact").startswith("t")).alias("n_templates"),
    )
    return decoded(groups, RULE).select(*GROUP, "n_findings", "confidence", "n_urls", "n_templates")


def finding_groups(findings: DataFrame) -> DataFrame:
    return _counted(_facts(coded(_scoreable(findings), RULE), [*SITE, *KEY]))


def sorted_side(side: DataFrame) -> DataFrame:
    """``side`` as one side of a join that sorts both. Rows per run repeat their texts, so files of a byte a row look small to
    the planner, which then sends more than a gigabyte of rows through the driver."""
    return side.hint("merge")


def allowed_groups(groups: DataFrame, allowed: DataFrame) -> DataFrame:
    """Groups of allow-listed rules. The rule is part of the group key, so the few groups are filtered, not the findings."""
    return groups.join(sorted_side(allowed), [*SITE, "rule_id"], "left_semi")


def penalty(severity: Column, confidence: Column, repeats: Column) -> Column:
    """Base plus capped repeat penalty, both scaled by the clamped confidence."""
    factor = clamp(confidence.cast("double"), 0.0, 100.0) / F.lit(100.0)
    base = lookup(severity, dims.BASE_PENALTY) * factor
    step = repeats * lookup(severity, dims.STEP_PENALTY) * factor
    return base + F.least(step, lookup(severity, dims.CAP_PENALTY) * factor)


def with_penalty(groups: DataFrame) -> DataFrame:
    repeats = F.greatest(F.lit(0), F.greatest("n_findings", "n_urls", "n_templates") - 1).cast("double")
    return groups.withColumn("penalty", penalty(F.col("severity"), F.col("confidence"), repeats))


def score_of(total_penalty: Column) -> Column:
    """0..100; sums are cut to six digits first so that addition order never decides a rounding."""
    return clamp(F.floor(F.round(F.lit(100.0) - F.coalesce(total_penalty, F.lit(0.0)), 6) + 0.5), 0, 100).cast("int")


def _memberships(mapping: dict[str, list[str]]) -> Column:
    """array of the areas a category belongs to; areas overlap, so a row may count in several."""
    inverse: dict[str, list[str]] = {}
    for area, cats in mapping.items():
        for cat in cats:
            inverse.setdefault(cat, []).append(area)
    out = F.array().cast("array<string>")
    for cat, areas in inverse.items():
        out = F.when(F.col("category") == cat, F.array(*[F.lit(a) for a in areas])).otherwise(out)
    return out


def scores_by(runs: DataFrame, penalties: DataFrame, mapping: dict[str, list[str]], key: str) -> DataFrame:
    """Score per area or profile of every run; an area without findings scores 100."""
    long = penalties.select(*SITE, "penalty", F.explode(_memberships(mapping)).alias(key))
    sums = long.groupBy(*SITE, key).agg(F.sum("penalty").alias("total_penalty"))
    grid = runs.select(*SITE, F.explode(F.array(*[F.lit(a) for a in mapping])).alias(key))
    return grid.join(sorted_side(sums), [*SITE, key], "left").select(*SITE, key, score_of(F.col("total_penalty")).alias("score"))


def stable_measured(ledger: DataFrame) -> DataFrame:
    """Rules a primary score may use. Coverage rows exist for every run, so no run falls outside."""
    return ledger.filter((F.col("maturity") == "stable") & F.col("measured")).select(*SITE, "rule_id")


def primary_total(runs: DataFrame, findings: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """Core score over stable measured rules; without any evaluation every rule counts."""
    return primary_of(runs, with_penalty(finding_groups(findings)), ledger)


def primary_of(runs: DataFrame, penalties: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """The core score from groups that are known already."""
    if ledger is not None:
        penalties = allowed_groups(penalties, stable_measured(ledger))
    scores = scores_by(runs, penalties, {"total": dims.PROFILES["core_seo"]}, "profile")
    return scores.select(*SITE, F.col("score").alias("total"), level(F.col("score")).alias("level"))


def composite(area_scores: DataFrame) -> DataFrame:
    """Weighted mean of the six areas, rounded half up."""
    weight = lookup(F.col("area"), dims.AREA_WEIGHTS)
    return area_scores.groupBy(*SITE).agg(
        clamp(F.floor(F.round(F.sum(F.col("score") * weight) / F.sum(weight), 6) + 0.5), 0, 100)
        .cast("int")
        .alias("experimental_combined")
    )


def coverage(ledger: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    out = ledger.groupBy(*keys).agg(
        F.count("*").alias("catalog_rules"),
        F.count_if("applicable").alias("applicable_rules"),
        F.count_if(c("applicable") & c("measured")).alias("measured_rules"),
        F.count_if(c("applicable") & c("measured") & (c("status") == "passed")).alias("passed_rules"),
        F.count_if(c("applicable") & c("measured") & (c("status") == "failed")).alias("failed_rules"),
        F.count_if(c("status") == "not_applicable").alias("not_applicable_rules"),
        F.count_if(c("applicable") & (c("status") == "not_measured")).alias("not_measured_rules"),
    )
    share = F.floor(c("measured_rules") * 100.0 / c("applicable_rules") + 0.5).cast("int")
    return out.withColumn("percent_measured", F.when(c("applicable_rules") == 0, 0).otherwise(share))


def profiles(runs: DataFrame, findings: DataFrame, ledger: DataFrame) -> DataFrame:
    """Four profiles; only the core one is restricted to stable measured rules.

    Findings are grouped once; the written groups and ledger serve every profile."""
    return profiles_of(runs, materialise(with_penalty(finding_groups(findings)), "penalties"), materialise(ledger, "ledger"))


def profiles_of(runs: DataFrame, penalties: DataFrame, ledger: DataFrame) -> DataFrame:
    """The profiles from written groups and ledger."""
    core = {"core_seo": dims.PROFILES["core_seo"]}
    rest = {k: v for k, v in dims.PROFILES.items() if k != "core_seo"}
    restricted = allowed_groups(penalties, stable_measured(ledger))
    scores = scores_by(runs, restricted, core, "profile").unionByName(scores_by(runs, penalties, rest, "profile"))
    member = ledger.select("*", F.explode(_memberships(dims.PROFILES)).alias("profile"))
    covered = sorted_side(coverage(member, [*SITE, "profile"]))
    return scores.join(covered, [*SITE, "profile"], "left").withColumn("level", level(F.col("score")))


def level(score: Column) -> Column:
    return (
        F.when(score >= 90, "excellent")
        .when(score >= 75, "strong")
        .when(score >= 60, "medium")
        .when(score >= 40, "weak")
        .otherwise("critical")
    )


def category_notes(groups: DataFrame, mapping: dict[str, list[str]] = dims.AREAS, key: str = "area") -> DataFrame:
    """Unique issues, URL references and a severity line per area."""
    long = groups.select("*", F.explode(_memberships(mapping)).alias(key))
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in dims.SEVERITIES]
    out = long.groupBy(*SITE, key).agg(
        F.count("*").alias("unique_issues"),
        F.sum(F.greatest("n_urls", "n_findings")).alias("url_references"),
        *counts,
    )
    parts = [F.when(F.col(f"n_{s}") > 0, F.concat(F.col(f"n_{s}").cast("string"), F.lit(f" {s}"))) for s in dims.SEVERITIES]
    return out.withColumn("by_severity", F.array_join(F.array_compact(F.array(*parts)), ", "))


def severity_counts(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings per severity of each run, zeros kept."""
    counts = findings.groupBy(*SITE, "severity").agg(F.count("*").alias("n"))
    grid = runs.select(*SITE, F.explode(F.array(*[F.lit(s) for s in dims.SEVERITIES])).alias("severity"))
    return grid.join(counts, [*SITE, "severity"], "left").fillna(0, ["n"])
