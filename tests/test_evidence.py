"""Evidence ids follow from content, every finding cites a row, and lost or idle rows are told."""

from auditlake.operators import evidence as ev
from auditlake.operators import rules

EP = "site_id string, run_id string, path string, url string, ok boolean, status int, content_type string, body string"
SITE = "https://a.test"


def probes(spark, paths):
    return spark.createDataFrame([(SITE, "r0", p, SITE + p, True, 200, "text/plain", "x" * 600) for p in paths], EP)


def test_paths_never_probed_have_a_row_with_status_zero(spark):
    runs = spark.createDataFrame([(SITE, "r0")], "site_id string, run_id string")
    rows = ev.endpoint_rows(runs, probes(spark, ["/robots.txt", "/robots.txt", "/llms.txt"])).collect()
    of = lambda kind: sorted(r.subject for r in rows if r.kind == kind)
    assert of("endpoint") == ["/llms.txt", "/robots.txt"] and {len(r.excerpt) for r in rows if r.kind == "endpoint"} == {500}
    assert "/sitemap.xml" in of("missing") and "/robots.txt" not in of("missing")
    assert all(r.status == 0 for r in rows if r.kind == "missing")
    assert len({r.evidence_id for r in rows}) == len(rows)


def test_ids_change_with_content_and_nothing_else(spark):
    runs = spark.createDataFrame([(SITE, "r0")], "site_id string, run_id string")
    ids = lambda df: {r.subject: r.evidence_id for r in ev.endpoint_rows(runs, df).collect()}
    first, again = ids(probes(spark, ["/robots.txt", "/auth.md"])), ids(probes(spark, ["/auth.md", "/robots.txt"]).repartition(5))
    assert first == again
    other = ids(probes(spark, ["/robots.txt", "/auth.md"]).withColumn("status", rules.F.when(rules.F.col("path") == "/auth.md", 404).otherwise(200)))
    assert other["/robots.txt"] == first["/robots.txt"] and other["/auth.md"] != first["/auth.md"]


def test_dangling_and_unused_rows_are_both_listed(spark):
    known = spark.createDataFrame([(SITE, "r0", i) for i in ("a", "b")], "site_id string, run_id string, evidence_id string")
    cited = spark.createDataFrame([(SITE, "r0", i) for i in ["a"] * 50 + ["gone"]], "site_id string, run_id string, evidence_id string")
    got = {r.evidence_id: (r.n_citations, r.state) for r in ev.evidence_references(cited, known).collect()}
    assert got == {"a": (50, "used"), "b": (0, "unused"), "gone": (1, "dangling")}


def test_a_finding_whose_evidence_is_lost_dangles(spark):
    runs = spark.createDataFrame([(SITE, "r0")], "site_id string, run_id string")
    ep = probes(spark, ["/robots.txt", "/llms.txt"])
    evidence = ev.endpoint_rows(runs, ep)
    site = spark.createDataFrame([(SITE, "r0", r) for r in ("SEO-CRAWL-003", "AR-LLMS-003", "SEO-LINK-009", "SEO-SITEMAP-001")], "site_id string, run_id string, rule_id string")
    pages = spark.createDataFrame([], "site_id string, run_id string, page_id long, affected_url string, rule_id string, title string")
    groups = spark.createDataFrame([], "site_id string, run_id string, rule_id string, key_hash string")
    cite = lambda rows: {r.rule_id: r.evidence_id for r in ev.citations(rows, pages, groups, site, ep).collect()}
    whole = cite(evidence)
    assert whole["SEO-CRAWL-003"].startswith("endpoint-") and whole["SEO-SITEMAP-001"].startswith("missing-")
    assert whole["SEO-LINK-009"] == "none-crawl-graph"
    assert cite(evidence.where("subject <> '/llms.txt'"))["AR-LLMS-003"] == "none-/llms.txt"


def test_every_rule_of_a_site_knows_its_evidence(spark):
    import re

    known = {*ev.RULE_PATHS, *ev.RULE_METRICS, *ev.GRAPH_RULES, *ev.OPEN_SITEMAP_RULES}
    emitted = set(re.findall(r"(?:SEO|AR)-[A-Z0-9]+-\d{3}", " ".join(str(s) for s in rules.site_rule_structs())))
    assert len(emitted) > 20 and emitted <= known
