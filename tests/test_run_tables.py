"""Gold tables of runs: rows cross the network once, with short keys, and stay where they lie afterwards."""

from auditlake.operators import actions, rules
from auditlake.plans import findings_input as fi
from auditlake.plans import gold, q_evidence
from auditlake.session import materialise
from auditlake.sources import goldstore

SF = "/root/testdata/sf0.001"
ROWS = "site_id string, run_id string, v long"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    sc = spark._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_findings_are_shuffled_once_and_short(spark):
    n, before = fi.findings(spark, SF).count(), shuffled(spark)
    q_evidence.run_tables(spark, SF).collect()
    assert shuffled(spark) - before < 300 * n


def test_replaced_runs_are_left_out_without_an_exchange_of_rows(spark, tmp_path):
    root = str(tmp_path / "gold")
    rows = spark.range(4000).selectExpr("'s' || id % 1000 AS site_id", "'r' || id % 2 AS run_id", "id AS v")
    newer = rows.filter("run_id = 'r1'").selectExpr("site_id", "run_id", "-v AS v")
    goldstore.commit_tables(root, rows, {"x": rows})
    goldstore.commit_tables(root, newer, {"x": newer})
    seen = goldstore.table(spark, root, "x")
    assert exchanges(seen) == 0
    assert sorted(r.v for r in seen.collect()) == sorted(-i if i % 2 else i for i in range(4000))


def test_a_run_that_is_replaced_for_some_sites(spark, tmp_path):
    root, frame = str(tmp_path / "gold"), lambda *rows: spark.createDataFrame(rows, ROWS)
    first = frame(("a", "r0", 1), ("b", "r0", 2), ("b", "r1", 3), ("c", "r2", 4))
    goldstore.commit_tables(root, first, {"x": first, "y": first})
    goldstore.commit_tables(root, frame(("b", "r0", 0), ("c", "r2", 0)), {"x": frame(("b", "r0", 5))})
    goldstore.commit_tables(root, frame(("d", "r0", 0)), {"x": frame(("d", "r0", 6))})
    got = {name: sorted(tuple(r) for r in rows.collect()) for name, rows in goldstore.tables(spark, root, ["x", "y"]).items()}
    assert got == {"x": [("a", "r0", 1), ("b", "r0", 5), ("b", "r1", 3), ("d", "r0", 6)], "y": [("a", "r0", 1), ("b", "r1", 3)]}


def test_placed_findings_are_the_findings(spark):
    found = fi.findings(spark, SF).limit(200)
    odd = found.limit(20).selectExpr(*[
        {"title": "if(ord % 2 = 0, 'own', title) AS title", "severity": "if(ord % 3 = 0, NULL, 'urgent') AS severity", "effort": "'huge' AS effort",
         "affected_urls": "array('/x', site_id, NULL, site_id || '/', 'u', '') AS affected_urls", "evidence_urls": "CAST(NULL AS array<string>) AS evidence_urls"}.get(c, c)
        for c in found.columns
    ])
    rows = materialise(found.unionByName(odd), "odd-findings")
    told = lambda df: sorted(map(repr, df.collect()))
    placed = gold.placed_findings(rows)
    assert placed.columns == rows.columns and told(placed) == told(rows)


def test_plan_and_queue_exchange_the_facts_once(spark):
    facts = materialise(actions.queue_facts(fi.findings(spark, SF)), "queue-facts")
    assert exchanges(actions.plan(facts)) == 1 and exchanges(actions.queue(facts)) == 1


def test_items_and_ranks_of_a_rule_with_several_options(spark):
    schema = "site_id string, run_id string, rule_id string, title string, severity string, category string, recommendation string, fix_class string, ord long, evidence_count int, approval_required boolean, safe_to_auto_fix boolean, n_affected int, effort string, risk string"
    row = lambda rule, ord_, title, severity, advice, fix, effort: ("s", "r", rule, title, severity, "c", advice, fix, ord_, 1, False, fix == "safe_auto_fix", 1, effort, "low")
    facts = actions.queue_facts(spark.createDataFrame([
        row("A", 5, "late", "low", "first", "safe_auto_fix", "large"), row("A", 2, "early", "high", "first", "safe_auto_fix", "small"),
        row("A", 7, "late", "low", "second", "manual_strategy", "medium"), row("B", 3, "none", "critical", "third", "not_applicable", "small"),
        row(None, 1, "no rule", "high", "fourth", "manual_strategy", "small"),
    ], schema))
    plan = sorted((r.plan_rank, r.rule_id, r.recommendation, r.effort, r.severity) for r in actions.plan(facts).collect())
    assert plan == [(1, "B", "third", "small", "critical"), (2, "A", "first", "small", "high"), (3, "A", "second", "medium", "high")]
    items = sorted((r.item_id, r.item_title, r.fix_class, r.effort, r.instances, r.n_evidence) for r in actions.queue(facts).collect())
    assert items == [("a-a-fix", "first", "safe_auto_fix", "small", 2, 2), ("a-a-fix", "second", "manual_strategy", "medium", 2, 2), ("b-finding", "none", "manual_strategy", "medium", 1, 1)]


def test_ledger_rows_are_not_exchanged(spark):
    counts = spark.createDataFrame([("https://s1.example", "r0", "SEO-LINK-009", 4), ("https://s1.example", "r0", "OWN", 9)], "site_id string, run_id string, rule_id string, n_findings long")
    ledger = rules.coverage_ledger(fi.run_config(spark, SF), counts)
    plan = ledger._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
    found = {r.rule_id: r.finding_count for r in ledger.filter("site_id = 'https://s1.example' AND run_id = 'r0' AND finding_count > 0").collect()}
    assert found in ({"SEO-LINK-009": 4}, {})
