"""Queries over URLs, privacy, discovery documents, the link graph and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions import privacy as x
from auditlake.functions import privacy_patterns as pat
from auditlake.functions import urls as u
from auditlake.functions.hosts import ascii_url
from auditlake.operators import discovery as d
from auditlake.operators import graph as g
from auditlake.operators import pages as p
from auditlake.operators import rules as r
from auditlake.plans import inputs
from auditlake.plans import oracle as o
from auditlake.plans.q_pages import snapshots
from auditlake.plans.registry import query
from auditlake.session import materialise

# URL variants derived from every page: fragments, ports, case, private paths, files and text that is no URL.
VARIANT_SQL = """page_id, url, CASE page_id % 12 WHEN 0 THEN url || '#part' WHEN 1 THEN replace(url, '.example.', '.EXAMPLE.') WHEN 2 THEN replace(replace(url, '.com/', '.com:443/'), 'http:', 'https:')
 WHEN 3 THEN url || '/admin/x' WHEN 4 THEN site_id || '/report.PDF' WHEN 5 THEN site_id || '/cart?step=2' WHEN 6 THEN 'not a url ' || CAST(page_id AS STRING) WHEN 7 THEN 'ftp://files.example.com/x' WHEN 8 THEN site_id || '/a?api_key=abcdefabcdef99'
 WHEN 9 THEN site_id || '/blog/My-Post/2024/deadbeef99/' WHEN 10 THEN site_id ELSE 'https://other.example.org/docs/intro/' END AS v, site_id"""
VAR = f"vv AS (SELECT {VARIANT_SQL} FROM (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+', 0) AS site_id FROM pages))"
NORM = "CASE WHEN regexp_matches(v, '^https?://') THEN lower(regexp_extract(regexp_replace(v, '^(https://[^/]*):443', '\\1'), '^https?://[^/?#]+')) || CASE WHEN regexp_matches(v, '^https?://[^/?#]+$') THEN '/' ELSE regexp_extract(v, '^https?://[^/?#]+([^#]*)', 1) END END"


def variants(spark, sf):
    base = inputs.table(spark, sf, "pages").selectExpr("page_id", "url", "regexp_extract(url, '^https?://[^/]+', 0) AS site_id")
    return base.selectExpr(*inputs._split(VARIANT_SQL))


def _u(name, column, sql):
    def run(spark, sf):
        return variants(spark, sf).select("page_id", "v", column().alias("result"))

    query(name, o.with_([VAR], f"SELECT page_id, v, {sql} AS result FROM vv"))(run)


v = lambda: F.col("v")
ORIGIN = "regexp_extract(n, '^https?://[^/]+')"
_u("U1_normalize_absolute", lambda: u.normalize_url(v()), NORM)
_u("U2_same_origin", lambda: u.same_origin(v(), F.col("url")), f"coalesce(regexp_extract({NORM}, '^https?://[^/]+') = lower(regexp_extract(url, '^https?://[^/]+')), false)")
_u("U3_is_http_url", lambda: u.is_http_url(v()), "regexp_matches(v, '^https?://')")
_u("U4_safe_crawl_url", lambda: u.is_safe_crawl_url(v(), F.col("site_id")), f"coalesce(regexp_matches(v, '^https?://') AND regexp_extract({NORM}, '^https?://[^/]+') = site_id AND NOT regexp_matches(regexp_extract(v, '^https?://[^/?#]+([^#]*)', 1), {o.q(pat.PRIVATE_ANY)}) AND NOT regexp_matches(lower(regexp_extract(v, '^https?://[^/?#]+([^?#]*)', 1)), '[.](jpg|jpeg|png|gif|webp|svg|pdf|zip|mp4|mp3|woff|woff2)$'), false)")
_u("U6_canonical_form", lambda: u.canonical_form(v()), o.canon(f"({NORM})"))
_u("U7_queue_form", lambda: u.queue_form(v()), f"coalesce({o.canon(f'({NORM})')}, regexp_replace(v, '/$', ''))")
_u("U12_hostname", lambda: u.hostname(v()), "CASE WHEN regexp_matches(v, '^https?://') THEN regexp_replace(lower(regexp_extract(v, '^https?://([^/?#]+)', 1)), ':[0-9]+$', '') ELSE '' END")
_u("U13_portfolio_target", lambda: u.portfolio_target(v()), f"coalesce({NORM}, v)")
_SEG = f"CASE WHEN regexp_matches(s, '^[0-9]+$') THEN ':number' WHEN regexp_matches(s, '^[0-9a-f]{{8,}}$') THEN ':id' WHEN i > 1 AND s NOT IN ({', '.join(o.q(s) for s in u.STATIC_SEGMENTS)}) THEN ':slug' WHEN length(s) > 32 OR contains(s, '-') THEN ':slug' ELSE s END"
PATTERN = f"'/' || array_to_string(list_transform(list_filter(string_split(lower(regexp_extract(v, '^https?://[^/?#]+([^?#]*)', 1)), '/'), lambda s: s <> ''), lambda s, i: {_SEG}), '/')"
LABEL = "CASE WHEN t = '/' THEN 'Home template' ELSE array_to_string(list_transform(regexp_extract_all(regexp_replace(regexp_extract(t, '^/([^/]*)', 1), '[:_-]+', ' ', 'g'), '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: upper(w[1]) || w[2:]), '') || ' template' END"


@query("U9_route_pattern", o.with_([VAR], f"SELECT page_id, v, t AS pattern, {LABEL} AS label FROM (SELECT page_id, v, {PATTERN} AS t FROM vv WHERE regexp_matches(v, '^https?://'))"))
def u9(spark, sf):
    rows = variants(spark, sf).filter(u.is_http_url(F.col("v")))
    return rows.select("page_id", "v", u.route_pattern(F.col("v")).alias("pattern")).withColumn("label", u.template_label(F.col("pattern")))


@query("U10_template_label", o.with_([VAR], f"SELECT t AS pattern, {LABEL} AS label, n FROM (SELECT {PATTERN} AS t, count(*) AS n FROM vv WHERE regexp_matches(v, '^https?://') GROUP BY 1)"))
def u10(spark, sf):
    rows = variants(spark, sf).filter(u.is_http_url(F.col("v"))).groupBy(u.route_pattern(F.col("v")).alias("pattern")).agg(F.count("*").alias("n"))
    return rows.select("pattern", u.template_label(F.col("pattern")).alias("label"), "n")


@query("U5_dedupe_urls", o.with_([o.RP, o.TAGS, o.LINKS], "SELECT page_id, dst, ord AS first_ord FROM links"))
def u5(spark, sf):
    from auditlake.functions import markup as m

    rows = inputs.page_raw(spark, sf).select(
        "page_id", u.url_parts(F.col("url")).alias("b"), F.posexplode(m.tag_stream(F.col("html"), attributes=True)).alias("ord", "t")
    ).filter("t.name = 'a' AND NOT t.closing")
    urls = rows.select("page_id", "ord", u.admit_href(m.attr(F.col("t"), "href"), F.col("b")).alias("dst")).filter("dst IS NOT NULL")
    return urls.groupBy("page_id", "dst").agg(F.min("ord").cast("long").alias("first_ord"))


@query("U8_href_admission", f"""SELECT doc_id, CASE WHEN regexp_matches(lower(regexp_replace(h, '[\\x00-\\x20\\x7f]', '', 'g')), '^(javascript|data|vbscript|mailto|tel):') THEN NULL ELSE 'https://base.example/d/' || CAST(doc_id AS VARCHAR) END AS admitted
FROM (SELECT doc_id, ['java' || chr(10) || ' script:x', ' MAILTO:a', 'tel:1', 'vb' || chr(9) || 'script:', 'data:,x', ''][CAST(doc_id % 6 AS INT) + 1] || CASE WHEN doc_id % 6 = 5 THEN CAST(doc_id AS VARCHAR) ELSE text END AS h FROM documents)""")
def u8(spark, sf):
    heads = F.array(*[F.lit(s) for s in ("java\n script:x", " MAILTO:a", "tel:1", "vb\tscript:", "data:,x", "")])
    h = F.concat(
        F.element_at(heads, (F.col("doc_id") % 6).cast("int") + 1),
        F.when(F.col("doc_id") % 6 == 5, F.col("doc_id").cast("string")).otherwise(F.col("text")),
    )
    base = u.url_parts(F.lit("https://base.example/d/page.html"))
    return inputs.texts(spark, sf).select("doc_id", u.admit_href(h, base).alias("admitted"))


@query("U11_text_shape", f"SELECT doc_id, CASE WHEN {o.trim('t')} = '' THEN 'empty' ELSE substr({o.sub(o.sub(o.sub(o.trim('t'), '[A-Z][a-z]+', 'Word'), '[0-9]+', '0'), '[' + u.JS_SPACE + ']+', ' ')}, 1, 80) END AS shape FROM (SELECT doc_id, text AS t FROM documents)")
def u11(spark, sf):
    return inputs.texts(spark, sf).select("doc_id", u.text_shape(F.col("text")).alias("shape"))


# Every document's first word as a host label: most are plain, some international. The coding can't be said in SQL.
HOST_SQL = "doc_id, 'https://' || lower(regexp_extract(text, '(\\\\p{L}+)', 1)) || '.' || source || '.example/p/' || doc_id AS url"


@query("U12_ascii_hosts")
def u12_ascii(spark, sf):
    urls = inputs.table(spark, sf, "documents").selectExpr(*inputs._split(HOST_SQL))
    return urls.select("doc_id", "url", u.normalize_url(ascii_url(F.col("url"))).alias("normal"))


@query("U14_site_slug", "SELECT c_custkey, regexp_replace(regexp_replace(lower(translate(c_name || ' Café & Co', 'áàâäéèêëíîïóôöúûüçñ', 'aaaaeeeeiiiooouuucn')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM customer")
def u14(spark, sf):
    from auditlake.functions.text import site_slug

    return inputs.table(spark, sf, "customer").select("c_custkey", site_slug(F.concat("c_name", F.lit(" Café & Co"))).alias("slug"))


@query("U15_row_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def u15(spark, sf):
    from auditlake.functions.text import slugify

    return inputs.table(spark, sf, "part").select("p_partkey", slugify(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("U16_submission_batches", """SELECT host, CAST(floor((rn - 1) / 25) AS BIGINT) AS batch, count(*) AS n_urls FROM (SELECT host, row_number() OVER (PARTITION BY host ORDER BY n) AS rn FROM
(SELECT DISTINCT lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host, regexp_replace(url, '#.*$', '') AS n FROM pages)) GROUP BY 1, 2""")
def u16(spark, sf):
    from auditlake.operators.submission import submission_batches

    urls = inputs.table(spark, sf, "pages").select(u.hostname(F.col("url")).alias("approved_host"), "url")
    return submission_batches(urls, batch_size=25).groupBy(F.col("approved_host").alias("host"), "batch").agg(F.count("*").alias("n_urls"))


# --- privacy -----------------------------------------------------------------------------------------------
SECRET_SQL = """doc_id, CASE doc_id % 7 WHEN 0 THEN text || ' see https://shop.example/account/orders?id=1 and https://x.example/?token=abcdefabcdef1234, ok' WHEN 1 THEN text || ' ghp_abcdefghijklmnopqrstuvwx'
 WHEN 2 THEN text || ' https://u.example/p?step=confirm&session=9&x=1 api_key=AAAABBBBCCCC1' WHEN 3 THEN text || ' /admin/ and xoxb-1234567890abcdefghij /home/joe/x.txt' ELSE text END AS body"""
SEC = f"sec AS (SELECT {SECRET_SQL} FROM documents)"


def secrets(spark, sf):
    return inputs.texts(spark, sf).selectExpr(*inputs._split(SECRET_SQL))


@query("X1_private_url", o.with_([VAR], f"SELECT page_id, v, regexp_matches(CASE WHEN regexp_matches(v, '^[a-z]+://') THEN coalesce(nullif(regexp_extract(v, '^[a-z]+://[^/?#]+([^#]*)', 1), ''), '/') ELSE v END, {o.q(pat.PRIVATE_ANY)}) AS is_private FROM vv"))
def x1(spark, sf):
    return variants(spark, sf).select("page_id", "v", x.is_private_url(F.col("v")).alias("is_private"))


@query("X2_private_references", o.with_([SEC], f"SELECT doc_id, unnest({o.private_refs('body')}) AS ref FROM sec"))
def x2(spark, sf):
    return secrets(spark, sf).select("doc_id", F.explode(x.private_references(F.col("body"))).alias("ref"))


@query("X3_redact_url", o.with_([VAR], """SELECT page_id, v, CASE WHEN page_id % 12 = 8 THEN replace(r, 'api_key=abcdefabcdef99', 'redacted_sensitive_query=1') ELSE v END AS redacted FROM (SELECT *, lower(regexp_extract(v, '^https?://[^/]+')) || regexp_extract(v, '^https?://[^/]+(.*)$', 1) AS r FROM vv)"""))
def x3(spark, sf):
    return variants(spark, sf).select("page_id", "v", x.redact_url(F.col("v")).alias("redacted"))


def _redact(c):
    c = f"replace({c}, 'https://x.example/?token=abcdefabcdef1234', 'https://x.example/?redacted_sensitive_query=1')"
    c = f"replace({c}, 'https://u.example/p?step=confirm&session=9&x=1', 'https://u.example/p?step=confirm&x=1&redacted_sensitive_query=1')"
    c = o.sub(c, pat.ASSIGNMENT, r"\1=[REDACTED]")
    c = o.sub(c, r"sk-[A-Za-z0-9_-]{20,}", "sk-[REDACTED]")
    c = o.sub(c, r"gh[pousr]_[A-Za-z0-9_]{20,}", "gh[REDACTED]")
    return o.sub(c, r"xox[baprs]-[A-Za-z0-9-]{20,}", "xox[REDACTED]")


@query("X4_redact_text", o.with_([SEC], f"SELECT doc_id, md5({_redact('body')}) AS redacted_md5 FROM sec"))
def x4(spark, sf):
    return secrets(spark, sf).select("doc_id", F.md5(x.redact_text(F.col("body"))).alias("redacted_md5"))


@query("X5_redact_record", o.with_([SEC], f"SELECT doc_id, {_redact('body')} AS a, {_redact('body')} AS b, doc_id * 2 AS n FROM sec"))
def x5(spark, sf):
    nested = secrets(spark, sf).select(
        "doc_id",
        F.struct(
            F.col("body").alias("a"),
            F.array(F.create_map(F.lit("k"), F.col("body"))).alias("list"),
            (F.col("doc_id") * 2).alias("n"),
        ).alias("rec"),
    )
    out = x.redact_frame(nested)
    return out.select("doc_id", "rec.a", F.col("rec.list")[0]["k"].alias("b"), "rec.n")


@query("X6_private_evidence", o.with_([SEC], f"SELECT doc_id % 50 AS finding_id, bool_or(len({o.private_refs('body')}) > 0) AS has_private, count(*) FILTER (len({o.private_refs('body')}) > 0) AS n_private FROM sec GROUP BY 1"))
def x6(spark, sf):
    hit = F.size(x.private_references(F.col("body"))) > 0
    return secrets(spark, sf).select((F.col("doc_id") % 50).alias("finding_id"), hit.alias("hit")).groupBy("finding_id").agg(
        F.bool_or("hit").alias("has_private"), F.count_if("hit").alias("n_private")
    )


APPROVAL_SQL = "doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' The author writes' WHEN 1 THEN ' several addresses' WHEN 2 THEN ' Product Price' WHEN 3 THEN ' certified by' ELSE '' END AS body"


@query("X7_approval_text", f"SELECT doc_id, regexp_matches(lower(body), {o.q(pat.APPROVAL_ANY)}) AS needs_approval FROM (SELECT {APPROVAL_SQL} FROM documents)")
def x7(spark, sf):
    docs = inputs.texts(spark, sf).selectExpr(*inputs._split(APPROVAL_SQL))
    return docs.select("doc_id", x.needs_approval(F.col("body")).alias("needs_approval"))


@query("X10_review_approval", f"SELECT doc_id, regexp_matches(body, {o.q(pat.REVIEW_APPROVAL)}) AS needs_review FROM (SELECT {APPROVAL_SQL} FROM documents)")
def x10(spark, sf):
    docs = inputs.texts(spark, sf).selectExpr(*inputs._split(APPROVAL_SQL))
    return docs.select("doc_id", x.needs_review_approval(F.col("body")).alias("needs_review"))


@query("X11_secret_reference", o.with_([SEC], f"SELECT doc_id, regexp_matches(body, {o.q(pat.SECRET_REFERENCE)}) AS secret_like FROM sec"))
def x11(spark, sf):
    return secrets(spark, sf).select("doc_id", x.is_secret_like(F.col("body")).alias("secret_like"))


@query("X12_credential_leak", f"SELECT doc_id, regexp_matches(body, {o.q(pat.CREDENTIAL_LEAK)}) AS leaks FROM (SELECT doc_id, text || CASE doc_id % 9 WHEN 0 THEN ' Bearer abc.def' WHEN 1 THEN ' AIzaAAAAAAAAAAAAAAAAAAAAAAAA' ELSE '' END AS body FROM documents)")
def x12(spark, sf):
    docs = inputs.texts(spark, sf).selectExpr(
        "doc_id", "text || CASE doc_id % 9 WHEN 0 THEN ' Bearer abc.def' WHEN 1 THEN ' AIzaAAAAAAAAAAAAAAAAAAAAAAAA' ELSE '' END AS body"
    )
    return docs.select("doc_id", F.to_json(F.struct("body")).rlike(pat.CREDENTIAL_LEAK).alias("leaks"))


def _export(c):
    for pattern, mark in pat.LOCAL_PATHS:
        c = o.sub(c, pattern, mark)
    return o.sub(c, pat.EXPORT_URL, "[redacted-url]")


@query("X13_export_redaction", o.with_([SEC], f"SELECT doc_id, md5({_export('body')}) AS export_md5 FROM sec"))
def x13(spark, sf):
    return secrets(spark, sf).select("doc_id", F.md5(x.redact_export(F.col("body"), True)).alias("export_md5"))


# --- discovery ----------------------------------------------------------------------------------------------
LINES = f"""rl0 AS (SELECT page_id, unnest(string_split(robots_body, chr(10))) AS raw, generate_subscripts(string_split(robots_body, chr(10)), 1) - 1 AS ord FROM docs),
rl AS (SELECT page_id, ord, trim(raw) AS line, CASE WHEN trim(raw) = '' OR starts_with(trim(raw), '#') THEN NULL ELSE lower(trim(split_part(trim(raw), ':', 1))) END AS key, CASE WHEN trim(raw) = '' OR starts_with(trim(raw), '#') THEN NULL ELSE trim(regexp_extract(trim(raw), '^[^:]*:(.*)$', 1)) END AS value FROM rl0),
ra AS (SELECT *, last_value(CASE WHEN key = 'user-agent' THEN value END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS agent FROM rl)"""


def page_of(df):
    return df.withColumn("page_id", F.regexp_replace("site_id", "site-", "").cast("long"))


@query("D1_robots_lines", o.with_([o.DOCS, LINES], "SELECT page_id, ord, key, value, agent FROM ra"))
def d1(spark, sf):
    return page_of(d.robots_lines(inputs.site_documents(spark, sf), "robots_body")).select("page_id", F.col("ord").cast("long").alias("ord"), "key", "value", "agent")


@query("D2_robots_rollup", o.with_([o.DOCS, LINES], f"""SELECT page_id, coalesce(string_agg(CASE WHEN key = 'sitemap' AND value <> '' THEN value END, '|' ORDER BY ord), '') AS sitemaps, coalesce(bool_or(key = 'disallow' AND agent = '*' AND value = '/'), false) AS disallow_all,
bool_or(CASE WHEN key IS NULL THEN regexp_matches(line, {o.q(d.AI_COMMENT)}) ELSE regexp_matches(line, {o.q(d.AI_LINE)}) END) AS has_ai_signal, coalesce(bool_or(key = 'disallow' AND agent = '*' AND regexp_matches(value, {o.q(d.PRIVATE_VALUE)})), false) AS has_private_disallows FROM ra GROUP BY page_id"""))
def d2(spark, sf):
    info = page_of(d.robots_info(inputs.site_documents(spark, sf), "robots_body"))
    return info.select("page_id", F.array_join("sitemap_urls", "|").alias("sitemaps"), "disallow_all", "has_ai_signal", "has_private_disallows")


@query("D3_robots_rule_signals", o.with_([o.DOCS], f"SELECT page_id, regexp_matches(robots_body, {o.q(r.AI_SIGNAL)}) AS has_ai_signal, regexp_matches(robots_body, {o.rx(r.PRIVATE_DISALLOW)}) AS has_private_disallows FROM docs"))
def d3(spark, sf):
    c = F.col("robots_body")
    return inputs.site_documents(spark, sf).select("page_id", c.rlike(r.AI_SIGNAL).alias("has_ai_signal"), c.rlike(r.PRIVATE_DISALLOW).alias("has_private_disallows"))


@query("D4_blanket_block", o.with_([o.DOCS], r"SELECT page_id, regexp_matches(robots_body, '(?im)disallow:\s*/\s*$') AS blanket FROM docs"))
def d4(spark, sf):
    return inputs.site_documents(spark, sf).select("page_id", F.col("robots_body").rlike(r"(?im)disallow:\s*/\s*$").alias("blanket"))


LOCS = "locs AS (SELECT page_id, unnest(regexp_extract_all(sitemap_body, '<loc>(.*?)</loc>', 1)) AS raw, generate_subscripts(regexp_extract_all(sitemap_body, '<loc>(.*?)</loc>', 1), 1) - 1 AS ord FROM docs), loc AS (SELECT page_id, ord, trim(replace(raw, '&amp;', '&')) AS loc FROM locs)"


@query("D5_sitemap_entries", o.with_([o.DOCS, LOCS], "SELECT page_id, CAST(ord AS INT) AS ord, loc FROM loc"))
def d5(spark, sf):
    return page_of(d.sitemap_entries(inputs.site_documents(spark, sf), "sitemap_body")).select("page_id", "ord", "loc")


@query("D6_sitemap_errors", o.with_([o.DOCS], """SELECT page_id, array_to_string(list_filter([CASE WHEN NOT starts_with(sitemap_body, '<') THEN 'Sitemap response is not XML.' END, CASE WHEN NOT regexp_matches(sitemap_body, '<(urlset|sitemapindex)>') THEN 'Sitemap XML does not contain urlset or sitemapindex root.' END,
CASE WHEN NOT contains(sitemap_body, '<loc>') THEN 'Sitemap XML contains no loc entries.' END], lambda e: e IS NOT NULL), '|') AS errors FROM docs"""))
def d6(spark, sf):
    return inputs.site_documents(spark, sf).select("page_id", F.array_join(d.sitemap_errors(F.col("sitemap_body")), "|").alias("errors"))


# Index documents: every site lists its own pages as child sitemaps; each page's link list is the child's body.
@query("D7_sitemap_index", o.with_([o.RP], """SELECT site_id, child, loc FROM (SELECT site_id, url AS child, unnest(list_transform(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), lambda h: 'https://x.example' || h)) AS loc FROM (SELECT DISTINCT site_id, url, html FROM rp))"""))
def d7(spark, sf):
    raw = inputs.page_raw(spark, sf)
    index = raw.select("site_id", "run_id", "ord", F.col("url").alias("loc"), F.col("site_id").alias("site_origin"))
    body = F.array_join(
        F.transform(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1)), lambda h: F.concat(F.lit("<loc>https://x.example"), h, F.lit("</loc>"))), ""
    )
    docs = raw.select("site_id", "run_id", "url", body.alias("body"))
    return d.expand_index(index, docs).select("site_id", "child", "loc")


@query("D8_sitemap_candidates", o.with_([o.ENDPOINTS], """SELECT DISTINCT site_id, s AS sitemap_url FROM (SELECT site_id, unnest(regexp_extract_all(body, '(?m)^Sitemap: (.*)$', 1)) AS s FROM ep WHERE path = '/robots.txt' UNION ALL SELECT site_id, url FROM ep WHERE path IN ('/sitemap.xml', '/sitemap_index.xml') AND ok)"""))
def d8(spark, sf):
    ep = inputs.endpoint_raw(spark, sf)
    return d.sitemap_candidates(d.robots_info(ep.filter("path = '/robots.txt'")), ep).select("site_id", "sitemap_url")


@query("D9_discovery_json", o.with_([o.ENDPOINTS], "SELECT site_id, path, CASE WHEN NOT ok THEN 'missing' WHEN NOT json_valid(body) THEN 'invalid' ELSE 'valid' END AS state FROM ep WHERE path IN ('/.well-known/agent-skills/index.json', '/.well-known/mcp.json', '/.well-known/api-catalog')"))
def d9(spark, sf):
    return d.discovery_json(inputs.endpoint_raw(spark, sf)).select("site_id", "path", "state")


@query("D10_published_json", o.with_([o.ENDPOINTS], "SELECT site_id, path, json_valid(body) AS parses FROM ep WHERE ok AND starts_with(trim(body), '{')"))
def d10(spark, sf):
    return d.published_json(inputs.endpoint_raw(spark, sf)).select("site_id", "path", "parses")


@query("D11_llms_checks", o.with_([o.DOCS], f"SELECT page_id, array_to_string({o.private_refs('llms_body')}, '|') AS private_refs FROM docs"))
def d11(spark, sf):
    return inputs.site_documents(spark, sf).select("page_id", F.array_join(F.array_sort(x.private_references(F.col("llms_body"))), "|").alias("private_refs"))


@query("D12_markdown_negotiation", o.with_([o.ENDPOINTS], "SELECT site_id, path, regexp_matches(content_type, '(?i)markdown|text/plain') AS usable FROM ep"))
def d12(spark, sf):
    return inputs.endpoint_raw(spark, sf).select("site_id", "path", F.col("content_type").rlike("(?i)markdown|text/plain").alias("usable"))


@query("S3_probe_grid", o.with_([o.ENDPOINTS], "SELECT site_id, path, ok, body FROM ep WHERE path <> '/'"))
def s3(spark, sf):
    ep = inputs.endpoint_raw(spark, sf)
    sites = ep.select("site_id", "run_id").distinct()
    answered = ep.filter("ok OR content_type <> 'text/plain' OR path <> '/'")
    return d.probes(sites, answered).select("site_id", "path", "ok", "body")


@query("S4_body_excerpt", "SELECT doc_id, length(substr(text, 1, 4000)) AS n, md5(substr(text, 1, 4000)) AS excerpt_md5 FROM documents")
def s4(spark, sf):
    cut = F.substring("text", 1, 4000)
    return inputs.texts(spark, sf).select("doc_id", F.length(cut).alias("n"), F.md5(cut).alias("excerpt_md5"))


# --- graph -------------------------------------------------------------------------------------------------
# Link targets of the table never hit a crawled URL, so an edge list between pages is derived from the ids.
EDGE_SQL = """SELECT DISTINCT site_id, 'r0' AS run_id, src, dst FROM (SELECT 'https://h' || CAST(l_suppkey AS STRING) || '.example' AS site_id, 'https://h' || CAST(l_suppkey AS STRING) || '.example/p/' || CAST(l_partkey % 97 AS STRING) AS src,
 'https://h' || CAST(l_suppkey AS STRING) || '.example/' || CASE WHEN l_linenumber = 7 THEN 'admin/' ELSE 'p/' END || CAST((l_partkey * 7 + l_orderkey) % 211 AS STRING) AS dst FROM lineitem)"""
EDGES = f"edges AS ({EDGE_SQL})"


def edges(spark, sf):
    inputs.table(spark, sf, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(EDGE_SQL)


SAFE = "safe AS (SELECT * FROM edges WHERE NOT contains(dst, '/admin/'))"
SEEDS = "seeds AS (SELECT DISTINCT site_id, site_id || '/p/1' AS url FROM edges)"


@query("G1_crawl_depth", "WITH RECURSIVE " + ",\n".join([EDGES, SAFE, SEEDS,
    "walk AS (SELECT site_id, url, 0 AS depth FROM seeds UNION SELECT s.site_id, s.dst, w.depth + 1 FROM walk w JOIN safe s ON s.site_id = w.site_id AND s.src = w.url WHERE w.depth < 60)"])
    + "\nSELECT site_id, url, min(depth) AS depth FROM walk GROUP BY 1, 2")
def g1(spark, sf):
    e = edges(spark, sf)
    seeds = e.select("site_id", "run_id").distinct().withColumn("url", F.concat("site_id", F.lit("/p/1")))
    return g.crawl_depth(e, seeds).select("site_id", "url", "depth")


@query("G2_nodes_and_edges", o.with_([o.RP, o.TAGS, o.LINKS], "SELECT url AS src, dst, rp.depth, rp.status FROM links JOIN (SELECT page_id, depth, status FROM rp) rp USING (page_id) WHERE internal"))
def g2(spark, sf):
    s = snapshots(spark, sf)
    links = s.select("site_id", "run_id", "depth", "status", F.col("final_url").alias("src"), F.explode("internal_links").alias("dst"))
    return links.select("src", "dst", "depth", "status")


@query("G3_next_frontier", o.with_([EDGES], "SELECT DISTINCT site_id, dst AS url FROM edges WHERE NOT contains(dst, '/admin/') AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT src FROM edges) n WHERE n.src = edges.dst)"))
def g3(spark, sf):
    e = edges(spark, sf).withColumn("internal", F.lit(True))
    nodes = e.select("site_id", "run_id", F.col("src").alias("url")).distinct()
    return g.next_frontier(e, nodes).select("site_id", "url")


PN = "pn AS (SELECT site_id, src AS url, count(*) AS out_degree FROM edges GROUP BY 1, 2), ind AS (SELECT site_id, dst AS url, count(*) AS in_degree FROM edges GROUP BY 1, 2)"


@query("G4_link_opportunities", o.with_([EDGES, PN], "SELECT pn.site_id, pn.url, coalesce(in_degree, 0) AS in_degree, 'add_incoming' AS advice FROM pn LEFT JOIN ind USING (site_id, url) WHERE coalesce(in_degree, 0) <= 1"))
def g4(spark, sf):
    e = edges(spark, sf)
    pages = e.groupBy("site_id", "run_id", F.col("src").alias("final_url")).agg(F.count("*").alias("n"), F.lit(0).alias("page_id"))
    pages = pages.withColumn("internal_links", F.array(F.lit("x")))
    return g.link_opportunities(pages, e).select("site_id", F.col("final_url").alias("url"), "in_degree", "advice")


@query("G5_orphan_pages", o.with_([EDGES], "SELECT DISTINCT site_id, src AS url FROM edges WHERE NOT EXISTS (SELECT 1 FROM edges t WHERE t.dst = edges.src)"))
def g5(spark, sf):
    e = edges(spark, sf)
    nodes = e.select("site_id", "run_id", F.col("src").alias("url"), F.lit(1).alias("depth")).distinct()
    return g.orphans(nodes, e, every=True).select("site_id", "url")


@query("G6_deep_pages", o.with_([o.RP], "SELECT page_id, url, depth FROM rp WHERE depth >= 3"))
def g6(spark, sf):
    return g.deep_pages(snapshots(spark, sf)).select("page_id", "url", "depth")


@query("G7_hub_detection", o.with_(o.PAGE_CTES, "SELECT site_id, count(*) AS n_pages, count(*) FILTER (n_int >= 4) AS n_hubs, count(*) >= 4 AND count(*) FILTER (n_int >= 4) = 0 AS missing_hub FROM snap GROUP BY site_id"))
def g7(spark, sf):
    return g.hub_summary(snapshots(spark, sf)).select("site_id", "n_pages", "n_hubs", "missing_hub")


@query("G8_uncrawled_links", o.with_([o.RP, o.TAGS, o.LINKS], "SELECT DISTINCT site_id, dst AS url FROM links JOIN (SELECT page_id, site_id FROM rp) USING (page_id) WHERE internal AND dst NOT IN (SELECT url FROM rp)"))
def g8(spark, sf):
    s = materialise(snapshots(spark, sf), "snapshots")
    nodes, e = g.nodes_and_edges(s, p.page_links(s))
    return g.uncrawled_links(e, nodes).select("site_id", "url")


@query("G9_long_redirects", o.with_([o.RP], "SELECT page_id, CAST(n_hops AS INT) AS n_hops FROM rp WHERE n_hops > 2"))
def g9(spark, sf):
    return g.long_redirects(inputs.page_raw(spark, sf)).select("page_id", "n_hops")


@query("G10_redirect_hygiene", o.with_([o.RP], "SELECT page_id, n_hops >= 2 AND page_id % 5 = 0 AS private_hop, n_hops >= 10 AS redirect_limit FROM rp WHERE n_hops >= 10 OR (n_hops >= 2 AND page_id % 5 = 0)"))
def g10(spark, sf):
    return g.redirect_hygiene(inputs.page_raw(spark, sf)).select("page_id", "private_hop", "redirect_limit")
