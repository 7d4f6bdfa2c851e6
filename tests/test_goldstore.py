"""Gold tables are seen whole or not at all, and a run belongs to its last commit."""

import pytest

from auditlake.plans.audit import audit_scores
from auditlake.plans.gold import write_run_tables
from auditlake.sources import goldstore

EP = "site_id string, run_id string, path string, url string, ok boolean, status int, content_type string, body string"
ROWS = "site_id string, run_id string, v long"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def seen(spark, root, name):
    return sorted((r.site_id, r.run_id, r.v) for r in goldstore.table(spark, root, name).collect())


def test_a_run_is_replaced_with_all_its_tables(spark, tmp_path):
    root = str(tmp_path / "gold")
    both = frame(spark, [("a", "001", 1), ("a", "001", 2), ("b", "001", 3), ("a", "002", 4)])
    goldstore.commit_tables(root, both, {"x": both, "y": both})
    again = frame(spark, [("a", "001", 9)])
    goldstore.commit_tables(root, again, {"x": again, "y": again.limit(0)})
    assert seen(spark, root, "x") == [("a", "001", 9), ("a", "002", 4), ("b", "001", 3)]
    assert seen(spark, root, "y") == [("a", "002", 4), ("b", "001", 3)]


def test_a_broken_commit_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "gold")
    goldstore.commit_tables(root, frame(spark, [("a", "r0", 1)]), {"x": frame(spark, [("a", "r0", 1)])})
    commit, bad = goldstore.new_commit(), frame(spark, [("a", "r0", 7), ("a", "r9", 8)])
    goldstore.add(root, commit, {"x": bad})
    with pytest.raises(Exception):
        goldstore.add(root, commit, {"y": bad.selectExpr("site_id", "run_id", "raise_error('lost') AS v")})
    assert seen(spark, root, "x") == [("a", "r0", 1)]
    goldstore.finish(root, commit, bad, {"x": bad.schema})
    assert seen(spark, root, "x") == [("a", "r0", 7), ("a", "r9", 8)]


def test_later_columns_are_null_in_older_files(spark, tmp_path):
    root = str(tmp_path / "gold")
    goldstore.commit_tables(root, frame(spark, [("a", "r0", 1)]), {"x": frame(spark, [("a", "r0", 1)])})
    wider = spark.createDataFrame([("a", "r1", 2, "n")], ROWS + ", note string")
    goldstore.commit_tables(root, wider, {"x": wider})
    assert sorted((r.v, r.note) for r in goldstore.table(spark, root, "x").collect()) == [(1, None), (2, "n")]
    with pytest.raises(ValueError):
        goldstore.table(spark, root, "nothing")


def test_audit_tables_agree_with_the_scores(spark, make_pages, tmp_path):
    words = "Words about things. " * 60
    pages = make_pages([{"url": f"https://{s}.test/{i}", "html": f"<html lang=en><head><title>Page {i % 2} of site {s}</title></head><body><h1>x</h1><img src=a.png><p>{i} {words}</p></body></html>"} for s in ("one", "two") for i in range(5)])
    urls = "<urlset><url><loc>https://one.test/1</loc></url></urlset>"
    answer = lambda path, body: ("https://one.test", "r0", path, f"https://one.test{path}", True, 200, "text/plain", body)
    ep = spark.createDataFrame([answer("/sitemap.xml", urls), answer("/llms.txt", "# x")], EP)
    failed = spark.createDataFrame([("https://one.test", "r0", ["lcp-ms"])], "site_id string, run_id string, failed_metrics array<string>")
    root = str(tmp_path / "gold")
    write_run_tables(root, pages, ep, None, failed)
    read = lambda name: goldstore.table(spark, root, name)
    areas = {(r.site_id, r.area): r.score for r in read("score").collect()}
    for r in audit_scores(pages, ep, None, failed).collect():
        for area in {a for _, a in areas}:
            assert areas[(r.site_id, area)] == r[area]
    from auditlake.operators.evidence import evidence_references

    states = {r.state for r in evidence_references(read("citation"), read("evidence")).collect()}
    assert states == {"used", "unused"}
    found = read("finding").collect()
    assert read("citation").count() == len(found)
    named = {(r.rule_id, r.url) for r in read("finding_url").collect()}
    assert ("SEO-SITEMAP-011", "https://one.test/0") in named and ("SEO-ONPAGE-002", "https://two.test/3") in named
    ledger = {(r.site_id, r.rule_id): r.status for r in read("ledger").collect()}
    assert all(ledger[(r.site_id, r.rule_id)] == "failed" for r in found)
    assert ledger[("https://one.test", "SEO-PERF-001")] == "failed" and ledger[("https://two.test", "SEO-PERF-001")] == "not_measured"
    assert read("queue").count() and read("plan").count()
