"""Runs against each other: baseline, scope comparison, suppressions, portfolio, gates, event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions import urls as u
from auditlake.functions.numeric import name_of, rank_case
from auditlake.operators.ranking import top_k

HIGH = ["critical", "high"]


def baseline_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Rule ids per site as new, resolved or recurring. One grouping of both sides instead of an outer join: a flag
    per side is OR-ed, so a rule with a third of all findings is combined map-side."""
    sides = current.select("site_id", "rule_id", F.lit(True).alias("now"), F.lit(False).alias("before")).unionByName(
        baseline.select("site_id", "rule_id", F.lit(False).alias("now"), F.lit(True).alias("before"))
    )
    both = sides.groupBy("site_id", "rule_id").agg(F.bool_or("now").alias("now"), F.bool_or("before").alias("before"))
    return both.select("site_id", "rule_id", _change().alias("change"))


def _change() -> Column:
    return (
        F.when(F.col("now") & F.col("before"), "recurring").when(F.col("now"), "new").otherwise("resolved")
    )


def scoped(findings: DataFrame) -> DataFrame:
    """(site, rule, scope) rows: templates, else URLs, else 'unscoped'; the last finding gives the severity."""
    scope = (
        F.when(F.size("affected_templates") > 0, F.col("affected_templates"))
        .when(F.size("affected_urls") > 0, F.col("affected_urls"))
        .otherwise(F.array(F.lit("unscoped")))
    )
    rows = findings.select("site_id", "rule_id", "severity", "ord", F.explode(scope).alias("scope"))
    rank = rank_case(F.col("severity"), dims.SEVERITIES)
    return rows.groupBy("site_id", "rule_id", "scope").agg(F.max_by(rank, F.col("ord")).alias("k_severity"))


def scope_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    sides = scoped(current).select("*", F.lit(True).alias("now"), F.lit(False).alias("before")).unionByName(
        scoped(baseline).select("*", F.lit(False).alias("now"), F.lit(True).alias("before"))
    )
    both = sides.groupBy("site_id", "rule_id", "scope").agg(
        F.bool_or("now").alias("now"),
        F.bool_or("before").alias("before"),
        F.max(F.when(F.col("now"), F.col("k_severity"))).alias("k_severity"),
    )
    severity = name_of(F.col("k_severity"), dims.SEVERITIES).alias("severity")
    return both.select("site_id", "rule_id", "scope", severity, _change().alias("change"))


def run_comparison(diff: DataFrame, scores: DataFrame) -> DataFrame:
    """Per site counts of changes, new critical or high groups, score delta, verdict and gate.

    ``scores``: site_id, before, after."""
    c = F.col
    counts = diff.groupBy("site_id").agg(
        F.count_if(c("change") == "new").alias("n_new"),
        F.count_if(c("change") == "resolved").alias("n_resolved"),
        F.count_if(c("change") == "recurring").alias("n_recurring"),
        F.count_if((c("change") == "new") & c("severity").isin(HIGH)).alias("new_critical_high"),
    )
    joined = scores.join(counts, "site_id", "left").fillna(0, ["n_new", "n_resolved", "n_recurring", "new_critical_high"])
    delta = c("after") - c("before")
    verdict = (
        F.when((c("new_critical_high") > 0) | (delta < 0), "regressed").when(delta > 0, "improved").otherwise("unchanged")
    )
    out = joined.withColumn("score_delta", delta).withColumn("verdict", verdict)
    return out.withColumn("gate", F.when(c("verdict") == "regressed", "failed").otherwise("passed"))


def regression_policy(
    runs: DataFrame,
    *,
    max_score_drop: float = 5,
    fail_on_new_high: bool = True,
    fail_on_critical: bool = True,
    fail_on_private: bool = True,
    fail_on_lint: bool = True,
) -> DataFrame:
    """Reasons why a run fails the gate. Needs score_delta (NULL without baseline), new_critical_high, n_critical,
    n_private_critical and lint_ok per site."""
    c = F.col
    regression = F.coalesce(
        (c("score_delta") < -abs(max_score_drop)) | (F.lit(fail_on_new_high) & (c("new_critical_high") > 0)), F.lit(False)
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.lit(fail_on_lint) & ~c("lint_ok"), "strict report lint failed"),
            F.when(F.lit(fail_on_critical) & (c("n_critical") > 0), "critical findings detected"),
            F.when(F.lit(fail_on_private) & (c("n_private_critical") > 0), "private URL exposure detected"),
            F.when(regression, "regression policy failed"),
        )
    )
    gate = F.when(c("score_delta").isNull(), "not-configured").when(regression, "failed").otherwise("passed")
    return runs.select("*", reasons.alias("failed_reasons"), gate.alias("regression_gate"))


NEVER = "$a"


def required_literal(pattern: Column) -> Column:
    """Longest text that every match of the pattern contains; '' where none is known.

    Escaped signs and character classes stand for one unknown character. What is then left without groups, alternatives and
    counted repeats is a sequence, whose runs of plain characters must all occur; a character that may be absent ends a run."""
    plain = F.regexp_replace(F.regexp_replace(pattern, r"\\\W", "."), r"\[\^?[^\[\]\\&^]+\]", ".")
    runs = F.regexp_extract_all(plain, F.lit(r"[A-Za-z0-9/_:=%~,;@ -]+(?![?*])"), F.lit(0))
    longest = F.aggregate(runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best))
    return F.when(plain.rlike(r"[\\|()\[\]{}]"), F.lit("")).otherwise(longest)


def checked_patterns(suppressions: DataFrame) -> DataFrame:
    """Suppressions whose url_pattern can be run, with the text that a match must contain (url_literal).

    Each pattern is given to the JVM's own compiler in its row; one that it refuses matches nothing instead of failing the
    job. No list of patterns passes through the driver, so their number has no limit."""
    pattern = F.nullif("url_pattern", F.lit(""))
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("url_pattern"))
    tried = suppressions.withColumn("url_pattern", pattern).withColumn("_compiled", compiled)
    usable = F.when(F.col("url_pattern").isNotNull(), F.coalesce("_compiled", F.lit(NEVER)))
    return tried.withColumn("url_pattern", usable).drop("_compiled").withColumn("url_literal", required_literal(F.col("url_pattern")))


def _until(expires_at: str = "expires_at") -> Column:
    """End of a suppression; a date that can't be read is no end."""
    return F.try_to_timestamp(expires_at)


def suppression_matches(suppressions: DataFrame, findings: DataFrame, today: Column) -> DataFrame:
    """Distinct matched URLs per suppression still in force.

    Equality on site and rule first; the pattern is a residual, and its required text is looked for before the pattern is run,
    since a pattern that changes from row to row is compiled for each. Findings are made distinct by URL before the join, and
    findings without URL cannot match. Patterns come checked from :func:`checked_patterns`."""
    active = suppressions.filter(_until().isNull() | (_until() >= today))
    urls = findings.select("site_id", "rule_id", F.explode("affected_urls").alias("url")).distinct()
    fits = F.col("url_pattern").isNull() | (F.col("url").contains(F.col("url_literal")) & F.expr("url rlike url_pattern"))
    return active.join(urls, ["site_id", "rule_id"]).filter(fits).select("site_id", "suppression_id", "rule_id", "url")


def suppression_report(suppressions: DataFrame, matches: DataFrame, today: Column) -> DataFrame:
    """State of every suppression: expired, matched or unmatched, with its URL count."""
    hits = matches.groupBy("site_id", "suppression_id").agg(F.count("*").alias("n_urls"))
    expired = F.coalesce(_until() < today, F.lit(False))
    state = F.when(expired, "expired").when(F.col("n_urls") > 0, "matched").otherwise("unmatched")
    return (
        suppressions.join(hits, ["site_id", "suppression_id"], "left")
        .fillna(0, ["n_urls"])
        .select("site_id", "suppression_id", "rule_id", state.alias("state"), "n_urls")
    )


def duplicate_suppressions(suppressions: DataFrame) -> DataFrame:
    """Ids used more than once and rows without id, rule or reason."""
    dup = suppressions.groupBy("site_id", "suppression_id").agg(F.count("*").alias("n")).filter("n > 1")
    return dup.select("site_id", "suppression_id", F.lit("duplicate").alias("problem")).unionByName(
        suppressions.filter("suppression_id IS NULL OR rule_id IS NULL OR reason IS NULL OR reason = ''").select(
            "site_id", "suppression_id", F.lit("incomplete").alias("problem")
        )
    )


def portfolio(runs: DataFrame) -> DataFrame:
    """Latest and previous run of every target. Two rows per target survive the map side of the ranking."""
    rows = runs.withColumn("target", u.portfolio_target(F.col("target_url")))
    totals = rows.groupBy("target").agg(F.count("*").alias("runs"))
    two = top_k(rows, ["target"], [F.col("completed_at").desc(), F.col("scan_id").desc()], 2)
    pick = lambda n, c: F.max(F.when(F.col("rank") == n, F.col(c)))
    latest = two.groupBy("target").agg(
        pick(1, "scan_id").alias("latest_scan"),
        pick(1, "score").alias("latest_score"),
        pick(2, "score").alias("previous_score"),
        pick(1, "quality_gate").alias("latest_gate"),
        pick(1, "completed_at").alias("latest_completed_at"),
    )
    return latest.join(totals, "target").withColumn("score_delta", F.col("latest_score") - F.col("previous_score"))


def portfolio_totals(targets: DataFrame) -> DataFrame:
    passed = F.col("latest_gate") == "passed"
    return targets.agg(
        F.count("*").alias("targets"),
        F.sum("runs").alias("runs"),
        F.count_if(passed).alias("passing"),
        F.count_if(~F.coalesce(passed, F.lit(False))).alias("failing"),
    )


def run_list(runs: DataFrame, states: DataFrame) -> DataFrame:
    """Runs with their workflow state; order is a range sort over (completed_at, scan_id), newest first."""
    return runs.join(states, "scan_id", "left").orderBy(F.col("completed_at").desc(), F.col("scan_id").desc())


def evidence_gate(findings: DataFrame, coverage: DataFrame) -> DataFrame:
    """Findings without evidence, and runs where nothing applicable was measured."""
    bare = findings.groupBy("site_id", "run_id").agg(F.count_if(F.col("evidence_count") == 0).alias("n_without"))
    joined = coverage.join(bare, ["site_id", "run_id"], "left").fillna(0, ["n_without"])
    nothing = (F.col("applicable_rules") > 0) & (F.col("measured_rules") == 0)
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_without") > 0, F.concat(F.col("n_without").cast("string"), F.lit(" findings have no evidence"))),
            F.when(nothing, F.lit("no applicable deterministic rules were measured")),
        )
    )
    return joined.select("site_id", "run_id", reasons.alias("reasons"), (F.size(reasons) == 0).alias("ok"))


def quality_gate(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """One aggregate per run. ``findings`` needs owner, evidence_count, safe and approval flags; ``runs`` needs
    validation_ok and review_complete."""
    c = F.col
    facts = findings.groupBy("site_id", "run_id").agg(
        F.count_if(c("owner").isNull()).alias("missing_actionability"),
        F.count_if(c("evidence_count") == 0).alias("evidence_free"),
        F.count_if(c("safe_to_auto_fix") & c("approval_required")).alias("invalid_safe_fixes"),
    )
    joined = runs.join(facts, ["site_id", "run_id"], "left").fillna(0, ["missing_actionability", "evidence_free", "invalid_safe_fixes"])
    stops = F.array_compact(
        F.array(
            F.when(~c("validation_ok"), "validation failed"),
            F.when(c("missing_actionability") > 0, "findings missing actionability"),
            F.when(c("evidence_free") > 0, "findings missing evidence"),
            F.when(c("invalid_safe_fixes") > 0, "safe auto-fix conflicts with approval gate"),
            F.when(~c("review_complete"), "agent review incomplete"),
        )
    )
    return joined.select(
        "site_id", "run_id", "missing_actionability", "evidence_free", "invalid_safe_fixes", stops.alias("stop_conditions"),
        F.when(F.size(stops) == 0, "passed").otherwise("failed").alias("status"),
    )


def verification_manifest(runs: DataFrame, scores: DataFrame, checks: DataFrame) -> DataFrame:
    """Score and check totals of a run in one row."""
    totals = checks.groupBy("site_id", "run_id").agg(
        F.count("*").alias("n_checks"), F.count_if(F.col("status") == "failed").alias("n_failed")
    )
    return (
        runs.join(scores, ["site_id", "run_id"], "left")
        .join(totals, ["site_id", "run_id"], "left")
        .select("site_id", "run_id", "total", "n_checks", "n_failed", (F.coalesce("n_failed", F.lit(0)) == 0).alias("ok"))
    )


def latest_phase(events: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Last event of each key; a max over a struct combines map-side."""
    last = F.max(F.struct(*order, *fields)).alias("e")
    return events.groupBy(*keys).agg(last, F.count("*").alias("n_events")).select(*keys, *[F.col(f"e.{f}").alias(f) for f in fields], "n_events")


def pending_decisions(decisions: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Latest disposition of every decision; those without one are pending."""
    last = events.groupBy(*keys).agg(F.max_by("status", "decided_at").alias("status"))
    return decisions.join(last, keys, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def baseline_summary(runs: DataFrame, diff_counts: DataFrame) -> DataFrame:
    """Baseline part of a dashboard: counts where a baseline exists, defaults where none does."""
    joined = runs.join(diff_counts, "site_id", "left")
    has = F.col("n_new").isNotNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(
        "site_id",
        F.when(has, "ok").otherwise("not_configured").alias("status"),
        zero("n_new"),
        zero("n_resolved"),
        zero("n_recurring"),
        F.coalesce("n_recurring", F.lit(0)).alias("n_unchanged"),
    )
