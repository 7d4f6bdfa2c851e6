from auditlake import dims
from auditlake.operators import scoring as s

F = "site_id string, run_id string, rule_id string, title string, category string, severity string, confidence int, status string, affected_urls array<string>, evidence_urls array<string>, affected_templates array<string>"


def finding(rule="R", sev="medium", cat="onpage_seo", conf=100, status="open", url=None, title="t"):
    return ("s", "r", rule, title, cat, sev, conf, status, [url] if url else [], [], [])


def areas(spark, rows):
    runs = spark.createDataFrame([("s", "r")], "site_id string, run_id string")
    groups = s.with_penalty(s.finding_groups(spark.createDataFrame(rows, F)))
    return {r.area: r.score for r in s.scores_by(runs, groups, dims.AREAS, "area").collect()}


def test_repeats_are_capped(spark):
    got = areas(spark, [finding(url=f"https://a/{i}") for i in range(20)])
    assert got["seo"] == 84 and got["contentQuality"] == 84 and got["agentReadiness"] == 100


def test_seven_distinct_high_issues_give_zero(spark):
    assert areas(spark, [finding(rule=f"R{i}", sev="high", title=f"t{i}") for i in range(7)])["seo"] == 0


def test_status_and_confidence(spark):
    assert areas(spark, [finding(status="passed"), finding(status="not_applicable")])["seo"] == 100
    assert areas(spark, [finding(conf=250)])["seo"] == 92
    assert areas(spark, [finding(conf=-25)])["seo"] == 100


def test_scores_stay_in_bounds(spark):
    rows = [finding(rule=f"R{i}", sev=sev, cat=cat, conf=100 * (i % 2)) for i, (sev, cat) in enumerate((a, b) for a in dims.SEVERITIES for b in dims.OWNERS)]
    assert all(0 <= v <= 100 for v in areas(spark, rows).values())


def test_composite_weights(spark):
    scores = {"seo": 100, "agentReadiness": 0, "technicalHealth": 50, "contentQuality": 80, "performanceAccessibility": 30, "securityPolicy": 10}
    df = spark.createDataFrame([("s", "r", k, v) for k, v in scores.items()], "site_id string, run_id string, area string, score int")
    assert s.composite(df).first().experimental_combined == 51


def test_experimental_critical_leaves_the_total_alone(spark):
    runs = spark.createDataFrame([("s", "r")], "site_id string, run_id string")
    ledger = spark.createDataFrame(
        [("s", "r", "AR-LLMS-008", "security", "experimental", "failed", True, True, 1), ("s", "r", "SEO-ONPAGE-001", "onpage_seo", "stable", "passed", True, True, 0)],
        "site_id string, run_id string, rule_id string, category string, maturity string, status string, applicable boolean, measured boolean, finding_count long",
    )
    rows = spark.createDataFrame([finding(rule="AR-LLMS-008", sev="critical", cat="security")], F)
    assert s.primary_total(runs, rows, ledger).first().total == 100
    assert s.primary_total(runs, rows, None).first().total == 70


def test_catalogue_shape():
    assert len(dims.RULES) == 77 and len(dims.EMITTED) == 72
    assert {r["rule_id"] for r in dims.RULES if r["fix"] == "-"} == {"SEO-TECH-011", "SEO-TECH-012", "SEO-A11Y-002", "SEO-A11Y-006", "AR-ROBOTS-003"}


def test_only_three_rules_change_class_by_text():
    from auditlake.functions.privacy_patterns import APPROVAL_TERMS

    flips = {r["rule_id"] for r in dims.EMITTED if r["fix"] != "A" and any(t in f"{r['title']}\n{r['recommendation']}".lower() for t in APPROVAL_TERMS)}
    assert flips == {"SEO-SITEMAP-008", "AR-ROBOTS-006", "SEO-CONTENT-001"}, flips
