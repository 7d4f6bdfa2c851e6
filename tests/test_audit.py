"""The whole audit on small sites: what its total counts, and which runs and URLs it knows."""

import pytest

from auditlake.operators import discovery
from auditlake.plans.audit import audit_facts, audit_scores

EP = "site_id string, run_id string, path string, url string, ok boolean, status int, content_type string, body string"
DOC = "site_id string, run_id string, url string, body string"


@pytest.fixture(scope="module")
def lake(spark, make_pages):
    words = "Words about things. " * 60
    pages = [{"url": f"https://{s}.test/{i}", "html": f"<html lang=en><head><title>Page {i} of site {s}</title></head><body><h1>x</h1><p>{i} {words}</p></body></html>"} for s in ("index", "plain", "leak") for i in range(4)]
    answer = lambda s, path, body: (f"https://{s}.test", "r0", path, f"https://{s}.test{path}", True, 200, "text/plain", body)
    urls = lambda s, n: "<urlset>" + "".join(f"<url><loc>https://{s}.test/{i}</loc></url>" for i in range(n)) + "</urlset>"
    probes = [
        answer("index", "/sitemap.xml", "<sitemapindex><sitemap><loc>https://index.test/child.xml</loc></sitemap></sitemapindex>"),
        answer("plain", "/sitemap.xml", urls("plain", 1)),
        answer("probed", "/robots.txt", "User-agent: *\nDisallow: /"),
        answer("leak", "/llms.txt", "# x"),
    ]
    documents = [("https://index.test", "r0", "https://index.test/child.xml", urls("index", 4))]
    return make_pages(pages), probes, spark.createDataFrame(documents, DOC)


def rules_of(spark, lake, documents, probes=None, metrics=None):
    runs, facts = audit_facts(lake[0], spark.createDataFrame(probes or lake[1], EP), documents, metrics)
    found = {}
    for r in facts.collect():
        found.setdefault(r.site_id.split("//")[1].split(".")[0], {}).setdefault(r.rule_id, set()).add((r.kind, r.value))
    return {r.site_id for r in runs.collect()}, found


def test_index_with_a_complete_child_misses_nothing(spark, lake):
    runs, found = rules_of(spark, lake, lake[2])
    assert "SEO-SITEMAP-011" not in found["index"] and "SEO-SITEMAP-002" not in found["index"]
    named = {v for k, v in found["plain"]["SEO-SITEMAP-011"] if k == "u"}
    assert named == {f"https://plain.test/{i}" for i in (1, 2, 3)}
    assert "https://probed.test" in runs and "SEO-CRAWL-003" in found["probed"]


@pytest.mark.parametrize("with_documents", [False, True])
def test_probed_sitemap_that_robots_names_counts_beside_the_first(spark, lake, with_documents):
    answer = lambda s, path, body: (f"https://{s}.test", "r0", path, f"https://{s}.test{path}", True, 200, "text/plain", body)
    loc = lambda s, i: f"<urlset><url><loc>https://{s}.test/{i}</loc></url></urlset>"
    probes = [answer(s, path, body) for s in ("plain", "leak") for path, body in (("/sitemap.xml", loc(s, 0)), ("/sitemap_index.xml", loc(s, "cart/1")))]
    probes += [answer("plain", "/robots.txt", "Sitemap: https://plain.test/sitemap_index.xml"), answer("leak", "/robots.txt", "Sitemap: https://leak.test/sitemap.xml")]
    ep, documents = spark.createDataFrame(probes, EP), lake[2] if with_documents else None
    found = sorted((r.site_id, r.loc) for r in discovery.sitemap_universe(ep, documents).collect())
    assert found == [("https://leak.test", "https://leak.test/0"), ("https://plain.test", "https://plain.test/0"), ("https://plain.test", "https://plain.test/cart/1")]
    counts = {r.site_id: r.n_sitemap_urls for r in discovery.sitemap_url_counts(ep, documents).collect()}
    assert counts == {"https://leak.test": 1, "https://plain.test": 2}


def test_performance_metrics_fire_their_rules(spark, lake):
    names = ["lcp-ms", "document-fetch-ms", "total-js-kb", "third-party-js-kb", "render-blocking-requests", "total-requests"]
    metrics = spark.createDataFrame([("https://plain.test", "r0", names)], "site_id string, run_id string, failed_metrics array<string>")
    _, found = rules_of(spark, lake, None, metrics=metrics)
    assert {"SEO-PERF-001", "SEO-PERF-020", "SEO-PERF-021", "SEO-PERF-022", "SEO-PERF-023", "SEO-PERF-024"} <= set(found["plain"])
    assert not {"SEO-PERF-001", "SEO-PERF-020"} & set(found["index"])


def test_experimental_rules_leave_the_total_alone(spark, lake):
    leaked = [(*p[:-1], "# x\nhttps://leak.test/account/token") if p[2] == "/llms.txt" else p for p in lake[1]]
    before, after = ({r.site_id: r for r in audit_scores(lake[0], spark.createDataFrame(p, EP)).collect()} for p in (lake[1], leaked))
    a, b = before["https://leak.test"], after["https://leak.test"]
    assert a.total == b.total and a.level == b.level
    assert any(a[c] > b[c] for c in a.__fields__ if c not in ("site_id", "run_id", "total", "level"))
    assert before["https://probed.test"].total is not None


def test_gold_tables_keep_runs_apart(spark, lake, tmp_path):
    from pyspark.sql import functions as F

    from auditlake.plans.audit import write_audit

    ep = spark.createDataFrame(lake[1], EP)
    for run in ("r0", "r1"):
        at = lambda df: df.withColumn("run_id", F.lit(run))
        write_audit(str(tmp_path), at(lake[0]), at(ep))
    scores = spark.read.parquet(f"{tmp_path}/scores")
    assert scores.select("run_id").distinct().count() == 2 and scores.count() == 8
    assert spark.read.parquet(f"{tmp_path}/finding_groups").where("run_id = 'r0'").count() > 0
