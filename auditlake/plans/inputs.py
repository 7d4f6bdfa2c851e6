"""Binding of the driver's tables to the audit inputs.

``pages`` stands for crawled pages. It carries few page features, so every page gets deterministic markup derived
from its own id and URL; the text below is plain SQL that both engines read, so both sides audit the same bytes.
Every page is kept whole and nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import dims

_ID = "CAST(page_id AS STRING)"


def _when(cond: str, text: str) -> str:
    return f"CASE WHEN {cond} THEN {text} ELSE '' END"


HEAD_MARKUP = " || ".join(
    [
        _when("page_id % 3 <> 0", "'<meta name=\"description\" content=\"Guide &amp; notes ' || CAST(page_id % 40 AS STRING) || '\">'"),
        _when("page_id % 11 = 0", "'<META NAME=robots CONTENT=\"NoIndex, follow\"/>'"),
        _when("page_id % 5 <> 0", "'<meta name=\"viewport\" content=\"width=device-width\">'"),
        _when("page_id % 4 = 0", "'<link rel=\"canonical\" href=\"' || url || '\">'"),
        _when("page_id % 4 = 1", f"'<link rel=\"nofollow Canonical\" href=\"/canonical/' || {_ID} || '/\">'"),
        _when("page_id % 7 = 0", "'<link rel=\"alternate\" hreflang=\"DE\" href=\"/de/x\"><link rel=\"alternate\" hreflang=\"fr\" href=\"/fr/x\">'"),
        _when("page_id % 14 = 0", "'<link rel=\"alternate\" hreflang=\"x-default\" href=\"/\">'"),
        _when("page_id % 2 = 0", f"'<meta property=\"og:title\" content=\"First\"><meta property=\"og:title\" content=\"Title ' || {_ID} || '\"><meta property=\"og:type\" content=\"article\">'"),
        _when("page_id % 6 = 0", "'<meta name=\"twitter:card\" content=\"summary\">'"),
        _when("page_id % 5 = 0", "'<script type=\"application/ld+json\">{\"@context\":\"https://schema.org\",\"@graph\":[{\"@type\":\"Organization\",\"name\":\"N\"},{\"@type\":[\"WebSite\",\"Thing\"],\"name\":\"W\"}]}</script>'"),
        _when("page_id % 5 = 1", "'<script type=\"application/ld+json\">{\"@type\":\"Product\",</script>'"),
        _when("page_id % 5 = 2", "'<script type=\"application/LD+json\">{\"@type\":\"Product\",\"offers\":{\"@type\":\"Offer\",\"price\":\"1\"}}</script>'"),
        _when("page_id % 10 = 3", "'<script type=\"application/ld+json\">{\"@type\":\"LocalBusiness\",\"openingHours\":\"Mo-Fr\"}</script>'"),
        "'<link rel=\"stylesheet\" href=\"/css/site' || CAST(page_id % 6 AS STRING) || '.css\"><script src=\"https://cdn.example.com/lib' || CAST(page_id % 9 AS STRING) || '.js\" async></script><script defer src=\"/js/app.js\"></script><link rel=\"preload\" href=\"/fonts/a.woff2\"><link rel=\"icon\" href=\"/favicon.ico\">'",
        _when("page_id % 3 = 1", "'<script src=\"/js/block.js\"></script>'"),
    ]
)
BODY_MARKUP = " || ".join(
    [
        _when("page_id % 3 = 0", "'<img src=\"/img/a' || CAST(page_id % 5 AS STRING) || '.png\" alt=\"\" width=\"10\" height=\"10\">'"),
        _when("page_id % 3 = 1", "'<img src=\"../up/b.jpg\" alt=\"Photo\" loading=\"lazy\">'"),
        _when("page_id % 3 = 2", "'<picture><source srcset=\"/img/s1.webp 1x, /img/s2.webp 2x, https://cdn.example.com/s3.webp 3x, /img/s4.webp 4x\"><img src=/img/c.gif alt=Logo width=1 height=2></picture>'"),
        _when("page_id % 4 = 0", "'<a class=\"skip\" href=\"#main\">Skip</a>'"),
        _when("page_id % 9 = 0", "'<form action=\"/login\"><input></form>'"),
        _when("page_id % 8 = 0", f"'<h1>Second heading ' || {_ID} || '</h1>'"),
        _when("page_id % 6 = 1", "'<h2>Part</h2><h4 class=\"x\">Jump</h4>'"),
        "'<a href=\"https://partner.example.org/p/' || CAST(page_id % 20 AS STRING) || '?a=1#frag\">Partner</a><a href=\"../rel/./x.html\">Rel</a><a href=\"mailto:a@b.c\">m</a>'",
        _when("page_id % 13 = 0", "'<a href=\"/admin/users\">Admin</a>'"),
        _when("page_id % 12 = 5", "'<p>Opening hours, phone and address: 12 Main Street, 555-123-4567.</p>'"),
        _when("page_id % 12 = 7", "'<p>Price list and cart with a return policy.</p>'"),
        _when("page_id % 15 = 2", "'<p>Developer API reference.</p>'"),
    ]
)
# One row per page of the bronze table, as SQL both engines accept.
PAGE_RAW_SQL = f"""
  regexp_extract(url, '^https?://[^/]+', 0) AS site_id, 'r0' AS run_id, page_id, url, url AS final_url,
  CASE WHEN page_id % 29 = 28 THEN 500 WHEN page_id % 17 = 16 THEN 404 ELSE 200 END AS status,
  'text/html; charset=utf-8' AS content_type,
  CASE WHEN page_id % 3 = 0 THEN 'public, max-age=60' ELSE '' END AS cache_control,
  CASE WHEN page_id % 4 = 0 THEN 'gzip' ELSE '' END AS content_encoding,
  CASE WHEN page_id % 13 = 12 THEN 3 WHEN page_id % 31 = 30 THEN 11 ELSE page_id % 2 END AS n_hops,
  page_id % 5 AS depth, page_id AS ord,
  replace(replace(html, '</head>', {HEAD_MARKUP} || '</head>'), '</body>', {BODY_MARKUP} || '</body>') AS html
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts."""
    return dealt(table(spark, sf_dir, "documents"))


#: Setting of the caller: deal the rows of text tables out to so many partitions. Off unless set: a lake of many files is
#: read as it lies. A table in one small file, as in benches, is read by one task otherwise.
INPUT_PARTITIONS = "spark.auditlake.inputPartitions"


def dealt(df: DataFrame) -> DataFrame:
    """Text is costly to scan; the caller may have its rows dealt out."""
    n = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(n)) if n else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Short rows that each stand for much work, dealt out by ``key`` over the session's shuffle partitions: a table of few bytes
    is read by one task otherwise, however long its rows take."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def page_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze pages with response facts."""
    bound = dealt(table(spark, sf_dir, "pages")).selectExpr(*_split(PAGE_RAW_SQL))
    headers = F.map_filter(
        F.create_map(
            F.lit("content-type"), F.col("content_type"), F.lit("cache-control"), F.col("cache_control"),
            F.lit("content-encoding"), F.col("content_encoding"),
        ),
        lambda k, v: v != "",
    )
    hops = F.when(
        F.col("n_hops") > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.col("n_hops"), F.lit(1)).cast("int")),
            lambda i: F.struct(
                F.when((i == 2) & (F.col("page_id") % 5 == 0), F.concat(F.col("site_id"), F.lit("/login/")))
                .otherwise(F.concat(F.col("site_id"), F.lit("/hop/"), i.cast("string")))
                .alias("url"),
                F.lit(301).alias("status"),
                F.col("url").alias("location"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<url:string,status:int,location:string>>"))
    return bound.select(
        "site_id", "run_id", "page_id", "url", "final_url", "status", "content_type", headers.alias("headers"),
        hops.alias("redirect_chain"), "depth", "ord", "html",
    )


def _split(text: str) -> list[str]:
    """Select list cut at its top-level commas."""
    out, depth, quoted, cur = [], 0, False, ""
    for ch in text:
        if ch == "'":
            quoted = not quoted
        if not quoted:
            depth += ch in "([{"
            depth -= ch in ")]}"
            if ch == "," and depth == 0:
                out.append(cur.strip())
                cur = ""
                continue
        cur += ch
    return [*out, cur.strip()]


# Endpoint probes: every site's first page decides which of the 22 paths answer and with what body.
ENDPOINT_CASES = {
    "/": ("page_id % 3 = 0", "CASE WHEN page_id % 6 = 0 THEN 'text/markdown' ELSE 'text/html' END", "'# Home'"),
    "/robots.txt": (
        "page_id % 5 <> 4",
        "'text/plain'",
        "'User-agent: *' || chr(10) || CASE WHEN page_id % 7 = 0 THEN 'Disallow: /' || chr(10) ELSE '' END || CASE WHEN page_id % 3 = 0 THEN 'Disallow: /admin/' || chr(10) ELSE '' END"
        " || CASE WHEN page_id % 4 = 0 THEN 'Sitemap: ' || site_id || '/sitemap.xml' || chr(10) ELSE '' END"
        " || CASE WHEN page_id % 8 = 3 THEN 'Sitemap: ' || site_id || '/sitemap_index.xml' || chr(10) ELSE '' END || CASE WHEN page_id % 9 = 2 THEN 'Sitemap: ' || site_id || '/maps/named.xml' || chr(10) ELSE '' END"
        " || CASE WHEN page_id % 9 = 0 THEN '# content-signal: ai-train=no' || chr(10) ELSE '' END || 'User-agent: GoodBot' || chr(10) || 'Disallow: /private/x' || chr(10)"
        " || CASE WHEN page_id % 2 = 0 THEN 'User-agent: GPTBot' ELSE 'Allow: /' END",
    ),
    "/sitemap.xml": (
        "page_id % 6 <> 5",
        "'application/xml'",
        "CASE WHEN page_id % 10 = 3 THEN 'not xml' WHEN page_id % 10 = 6 THEN '<feed><loc>' || url || '</loc></feed>' ELSE '<urlset><url><loc> ' || url || ' </loc></url><url><loc>' || site_id || '/a?x=1&amp;y=2</loc></url>'"
        " || CASE WHEN page_id % 8 = 0 THEN '<url><loc>' || site_id || '/checkout/session?token=abcdefabcdef12</loc></url>' ELSE '' END || '</urlset>' END",
    ),
    "/sitemap_index.xml": (
        "page_id % 6 = 5 OR page_id % 7 = 3",
        "'application/xml'",
        "'<sitemapindex><sitemap><loc>' || site_id || '/maps/0.xml</loc></sitemap><sitemap><loc>' || site_id || '/maps/1.xml</loc></sitemap><sitemap><loc>https://elsewhere.example/maps/2.xml</loc></sitemap></sitemapindex>'",
    ),
    "/llms.txt": (
        "page_id % 2 = 0",
        "CASE WHEN page_id % 4 = 0 THEN 'text/html' ELSE 'text/plain' END",
        "'# Site' || chr(10) || url || CASE WHEN page_id % 10 = 0 THEN ' see ' || site_id || '/account/token now' ELSE '' END",
    ),
    "/.well-known/mcp.json": (
        "page_id % 3 <> 0",
        "'application/json'",
        "CASE WHEN page_id % 3 = 1 THEN '{\"tools\":[{\"name\":\"delete_order\",\"description\":\"Removes it\"},{\"name\":\"find\",\"description\":\"Looks up\"}]}' ELSE '{\"tools\":[' END",
    ),
    "/.well-known/api-catalog": ("page_id % 4 = 1", "'application/json'", "CASE WHEN page_id % 8 = 1 THEN '{\"apis\":[]}' ELSE '{broken' END"),
    "/.well-known/agent-skills/index.json": ("page_id % 5 = 0", "'application/json'", "CASE WHEN page_id % 10 = 0 THEN '[]' ELSE 'nope' END"),
    "/openapi.json": ("page_id % 7 = 1", "'application/json'", "'{}'"),
    "/auth.md": ("page_id % 7 = 2", "'text/markdown'", "'# Auth'"),
    "/.well-known/oauth-protected-resource": ("page_id % 7 = 3", "'application/json'", "'{}'"),
}
_PATHS = [dims.MARKDOWN_PROBE, *dims.ENDPOINT_PATHS]


def _by_path(i: int, default: str) -> str:
    arms = " ".join(f"WHEN path = '{p}' THEN ({c[i]})" for p, c in ENDPOINT_CASES.items())
    return f"CASE {arms} ELSE {default} END"


# Columns of an endpoint probe over a frame that has path and the first page of the site.
ENDPOINT_SQL = f"""
  site_id, run_id, path, site_id || path AS url, {_by_path(0, "false")} AS ok,
  CASE WHEN {_by_path(0, "false")} THEN 200 ELSE 404 END AS status, {_by_path(1, "'text/plain'")} AS content_type,
  CASE WHEN {_by_path(0, "false")} THEN {_by_path(2, "''")} ELSE '' END AS body
"""


def endpoint_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe table, long form: a path without an answer is a row with ok = false."""
    pages = table(spark, sf_dir, "pages").selectExpr(
        "regexp_extract(url, '^https?://[^/]+', 0) AS site_id", "'r0' AS run_id", "page_id", "url"
    )
    firsts = pages.groupBy("site_id", "run_id").agg(F.min(F.struct("page_id", "url")).alias("f"))
    wide = firsts.select(
        "site_id", "run_id", "f.page_id", "f.url", F.explode(F.array(*[F.lit(p) for p in _PATHS])).alias("path")
    )
    return wide.selectExpr(*_split(ENDPOINT_SQL))


# Per page one robots and one sitemap body, so that line work has as many documents as there are pages.
DOC_SQL = f"""
  'site-' || CAST(page_id AS STRING) AS site_id, 'r0' AS run_id, page_id,
  {ENDPOINT_CASES["/robots.txt"][2]} AS robots_body,
  {ENDPOINT_CASES["/sitemap.xml"][2]} AS sitemap_body,
  {ENDPOINT_CASES["/llms.txt"][2]} AS llms_body, {ENDPOINT_CASES["/.well-known/mcp.json"][2]} AS mcp_body
"""
DOC_SOURCE_SQL = "SELECT page_id, url, html, regexp_extract(url, '^https?://[^/]+', 0) AS site_id FROM pages"


def site_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovery documents, one site per page."""
    src = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url", "html", "regexp_extract(url, '^https?://[^/]+', 0) AS site_id"
    )
    return src.selectExpr(*_split(DOC_SQL))


_HOST = "regexp_extract(url, '^https?://[^/]+', 0)"
#: Two runs per site, in seconds; pages and probes belong to the later one.
EARLIER, LATER = 1709251200, 1709337600
RUNS_SQL = f"site_id, run_id, started_at FROM (SELECT DISTINCT {_HOST} AS site_id FROM pages), (VALUES ('r-1', {EARLIER}), ('r0', {LATER})) AS v(run_id, started_at)"
# Every page was fetched before the first run, in it and in the later one; k is the number of the visit.
_VISITS = "k, page_id, url, " + _HOST + f" AS site_id, {EARLIER} + (k - 1) * 86400 + page_id * 7 % 80000 AS seen_at"
FETCH_SQL = "site_id, seen_at, url, CASE WHEN page_id % 23 = 0 THEN 'application/pdf' ELSE 'text/html' END AS content_type, CAST((page_id * 37 + k * 911) % 2400 AS DOUBLE) AS total_ms"
SAMPLE_SQL = "site_id, seen_at, CAST((page_id * 53 + k * 400) % 4000 AS DOUBLE) AS value"
# Assets of a page by number a: their kind and size follow from their URL, or from the visit.
ASSET_SQL = """
  site_id, seen_at, CASE a WHEN 0 THEN 'https://cdn.example.com/lib' || CAST(page_id % 9 AS STRING) || '.js' WHEN 1 THEN site_id || '/js/app' || CAST(page_id % 13 AS STRING) || '.js'
    WHEN 2 THEN site_id || '/css/site' || CAST(page_id % 12 AS STRING) || '.css' WHEN 3 THEN site_id || '/js/block' || CAST(page_id % 3 AS STRING) || '.js' ELSE site_id || '/img/a' || CAST(page_id AS STRING) || '-' || CAST(a AS STRING) || '.png' END AS url,
  CASE WHEN a = 2 THEN 'stylesheet' WHEN a > 3 THEN 'image' ELSE 'script' END AS type, a = 0 AS third_party, a <> 0 AS same_origin, a IN (2, 3) AS render_blocking,
  CASE a WHEN 0 THEN 20000 + page_id % 9 * 3000 WHEN 1 THEN 30000 + k * 5000 WHEN 2 THEN 9000 WHEN 3 THEN 12000 ELSE 40000 END AS bytes
"""
# Fetched sitemaps of a run in pieces, one page each: the children of an index, and one that only robots.txt names.
CHILD_SQL = f"{_HOST} AS site_id, 'r0' AS run_id, {_HOST} || CASE WHEN page_id % 10 = 7 THEN '/maps/named.xml' ELSE '/maps/' || CAST(page_id % 2 AS STRING) || '.xml' END AS url, '<urlset><url><loc>' || url || CASE WHEN page_id % 40 = 1 THEN '/checkout/session?token=abcdefabcdef12' ELSE '' END || '</loc></url></urlset>' AS body"
SEARCH_SQL = "site_id, run_id, page_id % 4 = 1 AS search_integrations"


def audit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every site: site_id, run_id, started_at."""
    sites = table(spark, sf_dir, "pages").selectExpr(f"{_HOST} AS site_id").distinct()
    starts = F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(t).cast("long").alias("started_at")) for r, t in (("r-1", EARLIER), ("r0", LATER))])
    return sites.select("site_id", F.explode(starts).alias("r")).select("site_id", "r.*")


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("k"))
    return pages.selectExpr(*_split(_VISITS))


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document fetches of all times."""
    return _visits(spark, sf_dir).selectExpr(*_split(FETCH_SQL))


def asset_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched assets of all times, with what their page uses them for."""
    return _visits(spark, sf_dir).withColumn("a", F.explode(F.array(*[F.lit(a) for a in range(8)]))).selectExpr(*_split(ASSET_SQL))


def paint_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest contentful paint as visitors had it."""
    return _visits(spark, sf_dir).selectExpr(*_split(SAMPLE_SQL))


def sitemap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched sitemaps beyond the probed ones; a document may come in several rows."""
    return table(spark, sf_dir, "pages").selectExpr(*_split(CHILD_SQL))


def search_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run asked for search data that nobody imported, by the first page of each site."""
    firsts = table(spark, sf_dir, "pages").groupBy(F.expr(_HOST).alias("site_id")).agg(F.min("page_id").alias("page_id"))
    return firsts.withColumn("run_id", F.lit("r0")).selectExpr(*_split(SEARCH_SQL))
