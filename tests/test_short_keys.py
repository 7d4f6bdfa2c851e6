"""Grouping with short keys: the same groups as with the texts, and fewer bytes between tasks."""

import re

from auditlake import dims
from auditlake.operators import actions, codes, scoring
from auditlake.plans import findings_input as fi

SF = "/root/testdata/sf0.001"
RULE = dims.EMITTED[0]
COLUMNS = "site_id string, run_id string, rule_id string, title string, category string, severity string, confidence int, status string, affected_urls array<string>, evidence_urls array<string>, affected_templates array<string>"


def exchanged(df):
    """Names of the columns that the aggregations of a plan group by, and so exchange."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return set(re.findall(r"(\w+)#\d+", " ".join(re.findall(r"Aggregate \[([^\]]*)\]", plan))))


def test_groups_of_texts_in_and_out_of_the_catalogue(spark):
    row = lambda rule=RULE["rule_id"], title=RULE["title"], category=RULE["category"], severity="high", urls=(), shown=(), templates=(), conf=50: (
        "https://a", "r", rule, title, category, severity, conf, "open", list(urls), list(shown), list(templates)
    )
    rows = [
        row(urls=["https://a/x"], shown=["https://a/x", "/x"], templates=["T", "U", "T"]), row(urls=["https://a"], templates=["U"], conf=70), row(urls=["https://a/x"]),
        row(title="own title", urls=["x"]), row(title="own title"), row(title=None), row(severity="urgent"), row(category=None), row(rule="NEW"), row(rule=None), row(severity="low"),
    ]
    found = spark.createDataFrame(rows, COLUMNS)
    got = {tuple(r) for r in scoring.finding_groups(found).collect()}
    key = lambda **o: tuple({"site_id": "https://a", "run_id": "r", **{c: RULE[c] for c in ("rule_id", "title", "category")}, "severity": "high", **o}.values())
    one = (1, 50, 0, 0)
    assert got == {
        key() + (3, 70, 3, 2), key(title="own title") + (2, 50, 1, 0), key(title=None) + one, key(severity="urgent") + one, key(category=None) + one,
        key(rule_id="NEW") + one, key(rule_id=None) + one, key(severity="low") + one,
    }
    assert {tuple(r) for r in scoring.group_facts(scoring.finding_facts(found)).collect()} == got


def test_texts_of_the_catalogue_are_not_exchanged(spark):
    found = fi.findings(spark, SF)
    texts = {"title", "category", "severity", "recommendation"}
    assert not exchanged(scoring.finding_groups(found)) & texts
    assert not exchanged(actions.queue_facts(found)) & texts


def test_coded_columns_come_back(spark):
    rows = [(r["rule_id"], r["title"], s, f) for r in dims.EMITTED for s in (*dims.SEVERITIES, "odd", None) for f in ("safe_auto_fix", "not_applicable", "x")]
    columns = ["rule_id", "title", "severity", "fix_class"]
    df = spark.createDataFrame(rows, "rule_id string, title string, severity string, fix_class string")
    short = codes.coded(df, columns)
    assert short.filter("(_code is null) = (_own is null)").isEmpty() and short.select("_code").distinct().count() == len(dims.EMITTED) * 5 * 2 + 1
    assert {tuple(r) for r in codes.decoded(short, columns).select(*columns).collect()} == set(rows)


def test_first_finding_speaks_for_a_group(spark):
    schema = "site_id string, run_id string, rule_id string, title string, severity string, category string, recommendation string, fix_class string, ord long, evidence_count int, approval_required boolean, safe_to_auto_fix boolean, n_affected int, effort string, risk string"
    of = lambda ord_, approval, safe, n, effort, risk, advice: ("s", "r", "R", "t", "low", "c", advice, "f", ord_, 2, approval, safe, n, effort, risk)
    rows = [of(2, True, True, 9, "small", "low", "A"), of(1, False, None, -3, "large", "high", "A"), of(5, None, True, None, "odd", "medium", "B"), of(7, True, False, 2**31 - 1, "medium", "low", "C")]
    got = {r.recommendation: r for r in actions.queue_facts(spark.createDataFrame(rows, schema)).collect()}
    told = lambda a: (got[a].n, got[a].evidence, got[a].ord, got[a].approval_required, got[a].safe_to_auto_fix, got[a].n_affected, got[a].k_effort, got[a].k_risk)
    assert told("A") == (2, 4, 1, False, None, -3, 2, 2)
    assert told("B") == (1, 2, 5, None, True, None, 3, 1)
    assert told("C") == (1, 2, 7, True, False, 2**31 - 1, 1, 0)
