"""Exact ranks, percentiles, graph depth and skewed groups against brute force."""

import math
import random
from collections import defaultdict, deque

from pyspark.sql import Window
from pyspark.sql import functions as F

from auditlake.operators import compare, discovery, graph, performance, ranking, rules, submission
from auditlake.sources import readers, sinks


def nearest(values, p):
    values = sorted(values)
    return values[max(0, math.ceil(len(values) * p) - 1)]


def test_nearest_ranks_match_brute_force_on_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.uniform(-5, 5), rng.uniform(0, 1e6), 7.0])) for _ in range(3000)]
    rows += [(f"k{i}", rng.uniform(-1e3, 1e3)) for i in range(200) for _ in range(rng.randint(1, 9))] + [("k0", None)]
    by = defaultdict(list)
    for k, v in rows:
        if v is not None:
            by[k].append(v)
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.p50, r.p75, r.p95) for r in ranking.nearest_ranks(df, ["k"], "v", {"p50": 0.5, "p75": 0.75, "p95": 0.95}).collect()}
    assert got == {k: tuple(nearest(vs, p) for p in (0.5, 0.75, 0.95)) for k, vs in by.items()}


def test_ranked_numbers_every_row(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randint(0, 50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, score int, id int")
    got = {r.id: r.rank for r in ranking.ranked(df, ["k"], -F.floor(F.col("score") / 5), [F.col("score").desc(), F.col("id")]).collect()}
    by = defaultdict(list)
    for k, s, i in rows:
        by[k].append((-s, i))
    want = {i: n for vs in by.values() for n, (_, i) in enumerate(sorted(vs), 1)}
    assert got == want


def test_crawl_depth_handles_cycles_and_limits(spark):
    rng = random.Random(3)
    site = "https://a.com"
    edges = {(f"{site}/p{rng.randint(0, 60)}", f"{site}/p{rng.randint(0, 60)}") for _ in range(150)} | {(f"{site}/p0", f"{site}/admin/x")}
    df = spark.createDataFrame([(site, "r", a, b) for a, b in edges], "site_id string, run_id string, src string, dst string")
    seeds = spark.createDataFrame([(site, "r", f"{site}/p0")], "site_id string, run_id string, url string")
    got = {r.url: r.depth for r in graph.crawl_depth(df, seeds, max_depth=4).collect()}
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    want, todo = {f"{site}/p0": 0}, deque([f"{site}/p0"])
    while todo:
        at = todo.popleft()
        for nxt in out[at]:
            if nxt not in want and want[at] < 4 and "/admin" not in nxt:
                want[nxt] = want[at] + 1
                todo.append(nxt)
    assert got == want
    few = {r.url for r in graph.crawl_depth(df, seeds, max_depth=4, max_pages=5).collect()}
    assert few == {u for u, _ in sorted(want.items(), key=lambda x: (x[1], x[0]))[:5]}
    blocked = seeds.select("site_id", "run_id")
    assert graph.crawl_depth(df, seeds, blocked_sites=blocked).count() == 1


def test_hot_duplicate_group_keeps_every_member(spark, make_pages):
    from auditlake.operators import pages

    html = "<title>{}</title><p>x</p>"
    rows = [{"url": f"https://a.com/{i}", "html": html.format("same title" if i % 3 else f"own {i}")} for i in range(150)]
    keys = rules.duplicate_keys(pages.page_snapshots(make_pages(rows)))
    groups = rules.duplicate_groups(keys)
    groups = rules.group_representatives(keys, groups)
    assert [(g.rule_id, g.n_pages, g.first_url) for g in groups.collect()] == [("SEO-ONPAGE-002", 100, "https://a.com/1")]
    assert rules.duplicate_members(keys, groups).count() == 100


def test_submission_batches_cover_all(spark):
    df = spark.createDataFrame([("a.com", f"https://a.com/{i}") for i in range(250)] + [("a.com", "https://b.com/x")], "approved_host string, url string")
    sizes = [r["count"] for r in submission.submission_batches(df, batch_size=100).groupBy("batch").count().orderBy("batch").collect()]
    assert sizes == [100, 100, 50]
    keys = spark.createDataFrame([("abcdef12",), ("no",)], "k string").select(submission.valid_key(F.col("k"))).collect()
    assert [r[0] for r in keys] == [True, False]


def test_robots_and_sitemap_reading(spark):
    body = "# AI input: no\r\nUser-agent: *\nDisallow: /\nDisallow: /checkout\nUser-agent: x\nDisallow: /private\nSitemap: https://a.com/s.xml?a:b\n"
    info = discovery.robots_info(spark.createDataFrame([("s", "r", body)], "site_id string, run_id string, body string")).first()
    assert info.disallow_all and info.has_private_disallows and info.has_ai_signal and info.sitemap_urls == ["https://a.com/s.xml?a:b"]
    err = lambda t: spark.createDataFrame([(t,)], "b string").select(discovery.sitemap_errors(F.col("b"))).first()[0]
    assert err("<feed></feed>")[0] == "Sitemap XML does not contain urlset or sitemapindex root."
    assert err("<urlset><loc> https://a.com/?x=1&amp;y=2 </loc></urlset>") == []
    assert len(err("hello")) == 3


def test_bad_suppression_pattern_matches_nothing(spark):
    sup = spark.createDataFrame([("s", "a", "R", "(?P<n>p)", None, "why"), ("s", "b", "R", "/p", "soon", "why"), ("s", "c", "R", "", "2000-01-01", "why")], "site_id string, suppression_id string, rule_id string, url_pattern string, expires_at string, reason string")
    fnd = spark.createDataFrame([("s", "R", ["https://a/p", "https://a/p", "https://a/q"]), ("s", "R", [])], "site_id string, rule_id string, affected_urls array<string>")
    sup = compare.checked_patterns(sup)
    now = F.lit("2025-01-01").cast("timestamp")
    hits = compare.suppression_matches(sup, fnd, now)
    assert [(r.suppression_id, r.url) for r in hits.collect()] == [("b", "https://a/p")]
    assert {r.suppression_id: r.state for r in compare.suppression_report(sup, hits, now).collect()} == {"a": "unmatched", "b": "matched", "c": "expired"}


def test_new_and_recurring_make_the_current_set(spark):
    now = spark.createDataFrame([("s", f"R{i % 5}") for i in range(20)], "site_id string, rule_id string")
    old = spark.createDataFrame([("s", f"R{i % 5 + 2}") for i in range(20)], "site_id string, rule_id string")
    kinds = defaultdict(set)
    for r in compare.baseline_diff(old, now).collect():
        kinds[r.change].add(r.rule_id)
    assert kinds["new"] | kinds["recurring"] == {f"R{i}" for i in range(5)} and kinds["resolved"] == {"R5", "R6"}


def test_field_beats_lab(spark):
    df = spark.createDataFrame([(900.0, 2000.0, 3000.0), (None, 2000.0, 3000.0), (None, None, 3000.0), (None, None, None)], "a double, b double, c double")
    got = [(r.x.value, r.x.source, r.x.reliability) for r in df.select(performance.choose_source(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()]
    assert got == [(900.0, "rum", "field"), (2000.0, "crux", "field"), (3000.0, "browser", "browser_lab"), (None, None, "not_measured")]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id":"1","findingId":"R","reason":"x"}]')
    (tmp_path / "b.json").write_text('{"suppressions":[{"id":"2","findingId":"R","reason":"y","urlPattern":"/p"}]}')
    rows = readers.suppression_files(spark, str(tmp_path)).collect()
    assert {(r.suppression_id, r.url_pattern) for r in rows} == {("1", None), ("2", "/p")}
    files = {r.path.rsplit("/", 1)[1]: r for r in readers.artifact_files(spark, str(tmp_path)).collect()}
    assert files["a.json"].bytes == 41 and len(files["a.json"].sha256) == 64
    out = str(tmp_path / "csv")
    sinks.quoted_csv(spark.createDataFrame([('a "b", c', 1)], "t string, n int").coalesce(1), out)
    text = next(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv").read_text()
    assert text == '"t","n"\n"a ""b"", c","1"\n'


def test_previous_run(spark):
    df = spark.createDataFrame([("s", "r1", "2024-01-01"), ("s", "r2", "2024-02-01"), ("s", "r3", "2024-03-01"), ("t", "r1", "2024-01-01")], "site_id string, run_id string, completed_at string")
    assert [(r.site_id, r.run_id) for r in readers.previous_run(df).collect()] == [("s", "r2")]


def test_a_run_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "gold")
    for run, sites in (("r0", ["a", "b"]), ("r1", ["a"]), ("r1", ["c", "d", "e"])):
        sinks.gold(spark.createDataFrame([(run, s, i) for i, s in enumerate(sites)], "run_id string, site_id string, ord long"), path)
    got = sorted((r.run_id, r.site_id) for r in readers.gold(spark, path).collect())
    assert got == [("r0", "a"), ("r0", "b"), ("r1", "c"), ("r1", "d"), ("r1", "e")]


def test_first_pages_of_a_large_site(spark):
    rows = [("https://a.com", "r", f"https://a.com/p{i % 7}/{i:05d}", i % 3) for i in range(9000)] + [("https://b.com", "r", "https://b.com/", 0)]
    got = graph.first_pages(spark.createDataFrame(rows, "site_id string, run_id string, url string, depth int"), 5000)
    want = sorted((r for r in rows if r[0] == "https://a.com"), key=lambda r: (r[3], r[2]))[:5000] + rows[-1:]
    assert sorted((r.site_id, r.run_id, r.url, r.depth) for r in got.collect()) == sorted(want)


def test_nothing_is_cut_by_default(spark, make_pages):
    from auditlake.operators import pages, resources

    head, tail = "same words " * 300, ["one end", "other end"]
    snap = pages.page_snapshots(make_pages([{"url": f"https://a.com/{i}", "html": f"<title>{i}</title><p>{head}{t}</p>"} for i, t in enumerate(tail)]))
    assert rules.duplicate_groups(rules.duplicate_keys(snap)).count() == 0
    html = "<img srcset='" + ", ".join(f"/i{i}.png {i}w" for i in range(9)) + "'>"
    assert resources.page_resources(make_pages([{"url": "https://a.com/", "html": html}])).count() == 9
    site = "site_id string, run_id string, "
    index = spark.createDataFrame([("https://a.com", "r", i, f"https://a.com/m{i}.xml", "https://a.com") for i in range(50)], site + "ord int, loc string, site_origin string")
    docs = spark.createDataFrame([("https://a.com", "r", f"https://a.com/m{i}.xml", f"<urlset><url><loc>https://a.com/{i}</loc></url></urlset>") for i in range(50)], site + "url string, body string")
    assert discovery.expand_index(index, docs).count() == 50 and discovery.expand_index(index, docs, max_children=20).count() == 20
    chain = spark.createDataFrame([("https://a.com", "r", f"https://a.com/{i}", f"https://a.com/{i + 1}") for i in range(12)], site + "src string, dst string")
    seeds = spark.createDataFrame([("https://a.com", "r", "https://a.com/0")], site + "url string")
    assert graph.crawl_depth(chain, seeds).count() == 13


def test_bodies_stay_in_their_rows(spark):
    from auditlake.operators import rules as r

    big = "<urlset>" + "<url><loc>https://a.com/x</loc></url>" * 500_000 + "</urlset>"
    ep = spark.createDataFrame([("https://a.com", "r", "/sitemap.xml", "https://a.com/sitemap.xml", True, 200, "application/xml", big)], "site_id string, run_id string, path string, url string, ok boolean, status int, content_type string, body string")
    wide = r.endpoint_wide(ep)
    assert wide.select(F.col(r.probe("/sitemap.xml"))["ok"]).first()[0] and "body" not in str(wide.schema)
    assert discovery.sitemap_url_counts(ep).first().n_sitemap_urls == 1


def test_open_headings_and_many_attributes_are_read_once(spark, make_pages):
    import time

    from auditlake.operators import pages

    began = time.time()
    html = "<h2>x" * 50_000 + "<h3>end</h3><h2>y"
    snap = pages.page_snapshots(make_pages([{"url": "https://a.com/", "html": html}]))
    assert [(h.level, h.text) for h in snap.select(F.explode("headings").alias("h")).select("h.*").collect()] == [(3, "end")]
    tag = "<p " + " ".join(f"a{i % 15_000}={i}" for i in range(30_000)) + ">"
    rows = pages.page_attributes(make_pages([{"url": "https://a.com/", "html": tag}]))
    assert {int(r.value) for r in rows.collect()} == set(range(15_000, 30_000))
    assert time.time() - began < 90


def test_fetches_of_a_hot_url_are_labelled_without_one_task_for_all(spark):
    from auditlake.operators.performance import label_runs

    log = spark.range(3000).selectExpr(
        "'s' AS site_id", "'r0' AS run_id", "id AS event_id", "CASE WHEN id % 10 = 9 THEN NULL ELSE 'u' END AS url",
        "CASE WHEN id % 7 <> 0 THEN timestamp_seconds((id * 7919) % 3000 * 60) END AS started_at",
    )
    keys = ["site_id", "run_id"]
    got = label_runs(log, keys)
    assert "_bucket" in got._jdf.queryExecution().analyzed().toString()
    w = Window.partitionBy(*keys, "url").orderBy("started_at", "event_id")
    want = {r.event_id: r.n for r in log.withColumn("n", F.row_number().over(w)).collect()}
    rows = got.collect()
    assert len(rows) == 3000 and {r.event_id: r.run for r in rows} == want
    assert {r.profile for r in rows if r.run == 2} == {"cold"} and got.columns == [*log.columns, "run", "profile"]


def test_deep_crawl_keeps_one_small_plan(spark, monkeypatch):
    """A chain deeper than the levels kept apart, with shortcuts and a cycle: depths are exact, levels are folded into one."""
    import collections

    monkeypatch.setattr(graph, "LEVELS_APART", 4)
    site, n = "https://deep.test", 23
    url = lambda i: f"{site}/p/{i}"
    pairs = [(i, i + 1) for i in range(n)] + [(3, 9), (9, 4), (12, 0), (n, 2)] + [(i, i) for i in range(0, n, 5)]
    edges = spark.createDataFrame([(site, "r", url(a), url(b)) for a, b in pairs] + [(site, "r2", url(0), url(7))], "site_id string, run_id string, src string, dst string")
    seeds = spark.createDataFrame([(site, "r", url(0)), (site, "r", url(0)), (site, "r2", url(0)), (site, "r3", url(5))], "site_id string, run_id string, url string")
    want, todo = {("r", 0): 0, ("r2", 0): 0, ("r2", 7): 1, ("r3", 5): 0}, collections.deque([0])
    while todo:
        a = todo.popleft()
        for x, b in pairs:
            if x == a and ("r", b) not in want:
                want["r", b] = want["r", a] + 1
                todo.append(b)
    out = graph.crawl_depth(edges, seeds)
    assert {(r.run_id, int(r.url.rsplit("/", 1)[1])): r.depth for r in out.collect()} == want and out.count() == len(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 4
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("auditlake_edges")]
    assert graph.crawl_depth(edges.limit(0), seeds).count() == 3 and graph.crawl_depth(edges, seeds.limit(0)).count() == 0
