"""Small sites with known problems: every expected rule must fire."""

import pytest
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.operators import discovery, intel, pages, rules

LONG = " ".join(f"useful sentence number {i} about gardens and tools" for i in range(40))
HEAD = '<title>A page with a proper title</title><meta name="description" content="About it"><meta name="viewport" content="width=device-width">'


def page(body, head=HEAD, lang=' lang="en"'):
    return f"<!doctype html><html{lang}><head>{head}</head><body>{body}</body></html>"


ROBOTS = "User-agent: *\nAllow: /\nDisallow: /admin/\nSitemap: {o}/sitemap.xml\n# content-signal: search=yes\n"
SITES = {
    "api": ({"/": page(f"<h1>API Reference</h1>{LONG}", HEAD + '<link rel="canonical" href="/other">')}, {}, {"AR-API-001", "AR-API-003", "AR-AUTH-001"}),
    "bad-robots": ({"/": page(LONG)}, {"/robots.txt": "User-agent: *\nDisallow: /"}, {"SEO-CRAWL-003"}),
    "broken-jsonld": ({"/": page(LONG, HEAD + '<script type="application/ld+json">{"@type":"Organization"</script>')}, {}, {"SEO-SCHEMA-001"}),
    "docs": ({"/": page(f"<h1>Documentation</h1>guides {LONG}")}, {}, {"AR-LLMS-001"}),
    "duplicate": ({"/": page(f'<a href="/copy">c</a>{LONG}'), "/copy": page(f'<a href="/">c</a>{LONG}')}, {}, {"SEO-CONTENT-002", "SEO-ONPAGE-002"}),
    "shop": ({"/": page(f"<p>Price: 10. Add to cart.</p>{LONG}")}, {}, {"SEO-SCHEMA-003", "SEO-SCHEMA-004", "SEO-ECOM-001"}),
    "bad-mcp": ({"/": page(LONG)}, {"/.well-known/mcp.json": "{nope"}, {"AR-MCP-002"}),
    "bad-sitemap": ({"/": page(LONG)}, {"/sitemap.xml": "not xml"}, {"SEO-SITEMAP-002"}),
    "js-only": ({"/": page('<div id="root"></div><script src="/app.js"></script>', "<title>App with scripts</title>", "")}, {}, {"SEO-JS-001", "SEO-ONPAGE-010", "SEO-ONPAGE-011"}),
    "local": ({"/": page(f"<p>Our address: 1 Main Street. Phone 555 123 4567. Opening hours: daily.</p>{LONG}")}, {}, {"SEO-SCHEMA-003", "SEO-SCHEMA-004", "SEO-LOCAL-003"}),
    "no-canonical": ({"/": page(LONG)}, {}, {"SEO-INDEX-003"}),
    "leak": ({"/": page(LONG)}, {"/sitemap.xml": "<urlset><url><loc>https://leak.test/checkout/session?token=abcdefabcdefab</loc></url></urlset>", "/llms.txt": "# x\nhttps://leak.test/account/token"}, {"SEO-SITEMAP-008", "AR-LLMS-008"}),
    "thin": ({"/": page("two words", "<title>Weak content page title</title>")}, {}, {"SEO-CONTENT-001", "SEO-ONPAGE-005"}),
    "risky-tools": ({"/": page(LONG)}, {"/.well-known/mcp.json": '{"tools":[{"id":"pay","summary":"Starts a payment"}]}'}, {"AR-MCP-005"}),
    "redirects": ({"/": page(LONG, HEAD + '<link rel="alternate" hreflang="de" href="/de">'), "/b": page(LONG)}, {}, {"SEO-TECH-002", "SEO-INTL-005", "SEO-INTL-001"}),
}
GOOD = '<a href="#main">skip</a><h1>Perfect</h1><a href="/about">About</a>' + LONG
PERFECT_HEAD = (
    HEAD + '<link rel="canonical" href="/"><meta property="og:title" content="x"><meta name="twitter:card" content="summary">'
    '<script type="application/ld+json">[{"@type":"Organization"},{"@type":"WebSite"}]</script>'
)


@pytest.fixture(scope="module")
def found(spark, make_pages):
    rows, probes = [], []
    sites = {**SITES, "perfect": ({"/": page(GOOD, PERFECT_HEAD)}, {"/robots.txt": ROBOTS.format(o="https://perfect.test"), "/sitemap.xml": "<urlset><url><loc>https://perfect.test/</loc></url></urlset>", "/llms.txt": "# Perfect"}, set())}
    for name, (paths, files, _) in sites.items():
        origin = f"https://{name}.test"
        chain = [{"url": f"{origin}/{i}", "status": 301, "location": "x"} for i in range(3)] if name == "redirects" else []
        rows += [{"url": origin + path, "html": html, "redirect_chain": [tuple(h.values()) for h in chain]} for path, html in paths.items()]
        for path in [dims.MARKDOWN_PROBE, *dims.ENDPOINT_PATHS]:
            kind = "text/plain" if path.endswith(".txt") else "text/html" if path == "/" else "application/xml"
            probes.append((origin, "r0", path, origin + path, path in files or path == "/", 200, kind, files.get(path, "")))
    raw = make_pages(rows)
    ep = spark.createDataFrame(probes, "site_id string, run_id string, path string, url string, ok boolean, status int, content_type string, body string")
    snap = pages.with_json_ld_types(pages.page_snapshots(raw)).cache()
    types = intel.site_types(snap)
    page_rows = rules.page_rule_findings(rules.prepare_pages(snap, types)).select("site_id", "rule_id", "severity")
    groups = rules.group_rule_findings(rules.duplicate_groups(rules.duplicate_keys(snap))).select("site_id", "rule_id", "severity")
    maps = discovery.sitemap_entries(ep.filter("ok AND path = '/sitemap.xml'"))
    missing = rules.missing_from_sitemap(snap, maps).groupBy("site_id", "run_id").agg(F.count("*").alias("n_missing_from_sitemap"))
    site_rows = rules.site_rule_findings(types, ep, discovery.sitemap_url_counts(ep), rules.page_rollup(snap), types, missing).select("site_id", "rule_id", "severity")
    out = {}
    for r in page_rows.unionByName(groups).unionByName(site_rows).collect():
        out.setdefault(r.site_id.removeprefix("https://").removesuffix(".test"), set()).add((r.rule_id, r.severity))
    return out, {r.site_id: r.site_type for r in types.collect()}


@pytest.mark.parametrize("site", SITES)
def test_expected_rules_fire(found, site):
    ids = {rule for rule, _ in found[0][site]}
    assert SITES[site][2] <= ids, SITES[site][2] - ids


def test_perfect_site_has_no_critical_finding(found):
    assert not [x for x in found[0]["perfect"] if x[1] == "critical"]


def test_site_types(found):
    types = found[1]
    assert types["https://api.test"] == "api" and types["https://docs.test"] == "docs"
    assert types["https://shop.test"] == "commerce" and types["https://local.test"] == "local-business"
