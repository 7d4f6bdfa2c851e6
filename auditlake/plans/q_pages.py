"""Queries over page features."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import markup as m
from auditlake.functions import urls as u
from auditlake.operators import pages as p
from auditlake.operators import resources as res
from auditlake.plans import inputs
from auditlake.plans import oracle as o
from auditlake.plans.registry import query


def snapshots(spark, sf):
    return p.page_snapshots(inputs.page_raw(spark, sf))


@query("S2_html_admission", o.with_([o.RP], """SELECT page_id, status, content_type FROM rp
WHERE contains(content_type, 'text/html') OR contains(html, '<html')"""))
def s2(spark, sf):
    return p.html_pages(inputs.page_raw(spark, sf)).select("page_id", "status", "content_type")


@query("P1_tag_stream", o.with_([o.RP, o.TAGS], f"""SELECT page_id, CAST(ord AS INT) AS ord, name, closing,
CASE WHEN closing THEN '' ELSE regexp_extract(tag, {o.rx(m.TAG)}, 3) END AS attrs_text FROM tags"""))
def p1(spark, sf):
    return p.page_tags(inputs.page_raw(spark, sf)).select("page_id", "ord", "name", "closing", "attrs_text")


@query("P2_attribute_map", o.with_([o.RP, o.TAGS], f"""SELECT page_id, count(*) AS n_attrs, count(*) FILTER (name = 'href') AS n_href,
sum(length(value)) AS value_chars FROM (SELECT page_id, lower(regexp_extract(a, '^[^=]+')) AS name,
{o.decode("trim(regexp_replace(a, '^[^=]+=?', ''), " + o.q(chr(34)) + ")")} AS value FROM (
SELECT page_id, unnest(regexp_extract_all(regexp_extract(tag, {o.rx(m.TAG)}, 3), '[A-Za-z-]+(?:=(?:"[^"]*"|[^ ">][^ >]*))?')) AS a FROM tags WHERE NOT closing)) GROUP BY page_id"""))
def p2(spark, sf):
    rows = p.page_attributes(inputs.page_raw(spark, sf))
    return rows.groupBy("page_id").agg(
        F.count("*").alias("n_attrs"),
        F.count_if(F.col("name") == "href").alias("n_href"),
        F.sum(F.length("value")).alias("value_chars"),
    )


@query("P3_visible_text", o.with_([o.RP], f"SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM (SELECT page_id, {o.visible('html')} AS t FROM rp)"))
def p3(spark, sf):
    return inputs.page_raw(spark, sf).select("page_id", m.visible_text(F.col("html")).alias("t")).select(
        "page_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars")
    )


@query("P4_entity_decode", f"SELECT doc_id, md5({o.decode('t')}) AS decoded_md5 FROM (SELECT doc_id, replace(replace(text, ' the ', ' &amp;lt; '), ' and ', ' &quot;&nbsp;') AS t FROM documents)")
def p4(spark, sf):
    docs = inputs.texts(spark, sf).select(
        "doc_id", F.expr("replace(replace(text, ' the ', ' &amp;lt; '), ' and ', ' &quot;&nbsp;')").alias("t")
    )
    return docs.select("doc_id", F.md5(m.decode_entities(F.col("t"))).alias("decoded_md5"))


@query("P5_title_text", o.with_(o.PAGE_CTES, "SELECT page_id, title FROM snap"))
def p5(spark, sf):
    return inputs.page_raw(spark, sf).select("page_id", m.element_text(F.col("html"), "title").alias("title"))


@query("P6_meta_by_name", o.with_(o.PAGE_CTES, "SELECT page_id, meta_description, robots_meta, viewport FROM snap"))
def p6(spark, sf):
    return snapshots(spark, sf).select("page_id", "meta_description", "robots_meta", "viewport")


@query("P7_open_graph", o.with_([o.RP, o.TAGS], f"""SELECT page_id, k AS property, arg_max(v, ord) AS content FROM (SELECT page_id, ord, {o.at("tag", "property")} AS k, {o.at("tag", "content")} AS v FROM tags WHERE name = 'meta')
WHERE starts_with(k, 'og:') GROUP BY page_id, k"""))
def p7(spark, sf):
    return snapshots(spark, sf).select("page_id", F.explode("open_graph").alias("property", "content"))


@query("P8_twitter_card", o.with_([o.RP, o.TAGS], f"""SELECT page_id, k AS name, arg_max(v, ord) AS content FROM (SELECT page_id, ord, {o.at("tag", "name")} AS k, {o.at("tag", "content")} AS v FROM tags WHERE name = 'meta')
WHERE starts_with(k, 'twitter:') GROUP BY page_id, k"""))
def p8(spark, sf):
    return snapshots(spark, sf).select("page_id", F.explode("twitter_cards").alias("name", "content"))


@query("P9_canonical_link", o.with_(o.PAGE_CTES, "SELECT page_id, canonical FROM snap"))
def p9(spark, sf):
    return snapshots(spark, sf).select("page_id", "canonical")


@query("P10_hreflang_pairs", o.with_(o.PAGE_CTES, "SELECT page_id, language, href FROM hre WHERE href IS NOT NULL"))
def p10(spark, sf):
    return snapshots(spark, sf).select("page_id", F.explode("hreflang").alias("h")).select("page_id", "h.language", "h.href")


@query("P11_headings", o.with_([o.RP, o.HEADS], "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS INT) AS ord, level, text FROM heads WHERE text <> ''"))
def p11(spark, sf):
    return p.page_headings(snapshots(spark, sf)).select("page_id", "ord", "level", "text")


@query("P12_images", o.with_(o.PAGE_CTES, "SELECT page_id, src, alt, w AS has_width, h AS has_height FROM img"))
def p12(spark, sf):
    return snapshots(spark, sf).select("page_id", F.explode("images").alias("i")).select("page_id", "i.*")


@query("P13_json_ld_blocks", o.with_([o.RP, o.LD], "SELECT page_id, raw, bad AS parse_error FROM ld"))
def p13(spark, sf):
    return inputs.page_raw(spark, sf).select("page_id", F.explode(p.json_ld_list(F.col("html"))).alias("b")).select("page_id", "b.*")


@query("P14_json_ld_types", o.with_([o.RP, o.LD], "SELECT page_id, t AS type FROM ldt"))
def p14(spark, sf):
    blocks = inputs.page_raw(spark, sf).select("page_id", p.json_ld_list(F.col("html")).alias("json_ld"))
    return p.with_json_ld_types(blocks).select("page_id", F.explode("json_ld_types").alias("type"))


@query("P15_links", o.with_([o.RP, o.TAGS, o.LINKS], "SELECT page_id, dst, internal FROM links"))
def p15(spark, sf):
    return p.page_links(snapshots(spark, sf)).select("page_id", "dst", "internal")


@query("P16_first_tag_attribute", o.with_(o.PAGE_CTES, "SELECT page_id, lang FROM snap"))
def p16(spark, sf):
    return snapshots(spark, sf).select("page_id", "lang")


@query("P17_skip_link", o.with_(o.PAGE_CTES, "SELECT page_id, skip AS has_skip_link FROM snap"))
def p17(spark, sf):
    return snapshots(spark, sf).select("page_id", "has_skip_link")


@query("P18_form_count", o.with_(o.PAGE_CTES, "SELECT page_id, n_form AS forms FROM snap"))
def p18(spark, sf):
    return snapshots(spark, sf).select("page_id", F.col("forms").cast("long").alias("forms"))


@query("P19_words_and_excerpt", o.with_(o.PAGE_CTES, "SELECT page_id, word_count, body_excerpt FROM snap"))
def p19(spark, sf):
    return snapshots(spark, sf).select("page_id", F.col("word_count").cast("long").alias("word_count"), "body_excerpt")


@query("P20_page_snapshot", o.with_(o.PAGE_CTES, """SELECT site_id, page_id, url, status, title, meta_description, robots_meta, viewport, canonical, lang, word_count,
n_heads, n_h1, n_int AS n_internal, n_ext AS n_external, n_img AS n_images, n_ld AS n_json_ld, array_to_string(types, '|') AS json_ld_types, n_og, n_tw, n_form AS forms, skip AS has_skip_link, n_hre AS n_hreflang FROM snap"""))
def p20(spark, sf):
    n = lambda c: F.size(c).cast("long")
    return p.with_json_ld_types(snapshots(spark, sf)).select(
        "site_id", "page_id", "url", "status", "title", "meta_description", "robots_meta", "viewport", "canonical", "lang",
        F.col("word_count").cast("long").alias("word_count"),
        n("headings").alias("n_heads"),
        n(F.filter("headings", lambda h: h["level"] == 1)).alias("n_h1"),
        n("internal_links").alias("n_internal"), n("external_links").alias("n_external"), n("images").alias("n_images"),
        n("json_ld").alias("n_json_ld"), F.array_join(F.array_sort("json_ld_types"), "|").alias("json_ld_types"),
        n("open_graph").alias("n_og"), n("twitter_cards").alias("n_tw"), F.col("forms").cast("long").alias("forms"),
        "has_skip_link", n("hreflang").alias("n_hreflang"),
    )


RES = f"""rt0 AS (SELECT page_id, url AS page_url, unnest(ts) AS tag, generate_subscripts(ts, 1) AS pos, hlen, html FROM (SELECT page_id, url, html, strpos(lower(html), '</head>') AS hlen, regexp_extract_all(html, '(?i)<\\s*(?:script|link|img|source)\\b[^>]*>') AS ts FROM rp)),
rt AS (SELECT page_id, page_url, pos, tag, lower(regexp_extract(tag, '[A-Za-z]+')) AS name, strpos(html, tag) < hlen AS in_head FROM rt0),
rc AS (
 SELECT page_id, page_url, pos, 0 AS sub, in_head, {o.resolve(o.at("tag", "src"), "page_url")} AS url, 'script' AS type, NOT regexp_matches(tag, '(?i)\\s(async|defer)[\\s>]') AS render_blocking, regexp_matches(tag, '(?i)\\sasync[\\s>]') AS is_async, regexp_matches(tag, '(?i)\\sdefer[\\s>]') AS is_defer, false AS lazy FROM rt WHERE name = 'script'
 UNION ALL SELECT page_id, page_url, pos, 0, in_head, {o.resolve(o.at("tag", "href"), "page_url")}, CASE {o.at("tag", "rel")} WHEN 'stylesheet' THEN 'stylesheet' WHEN 'preload' THEN 'font' ELSE 'image' END, {o.at("tag", "rel")} = 'stylesheet', false, false, false FROM rt WHERE name = 'link' AND {o.at("tag", "rel")} IN ('stylesheet', 'preload', 'icon')
 UNION ALL SELECT page_id, page_url, pos, 0, in_head, {o.resolve(o.at("tag", "src"), "page_url")}, 'image', false, false, false, contains(tag, 'loading="lazy"') FROM rt WHERE name IN ('img', 'source')
 UNION ALL SELECT page_id, page_url, pos, i, in_head, {o.resolve("trim(s)", "page_url")}, 'image', false, false, false, false FROM (SELECT page_id, page_url, pos, in_head, unnest(range(1, 5)) AS i, split_part(trim(split_part({o.at("tag", "srcset")}, ',', CAST(unnest(range(1, 5)) AS INT))), ' ', 1) AS s FROM rt WHERE name = 'source')),
res AS (SELECT page_id, url, arg_min(type, pos * 10 + sub) AS type, arg_min(in_head, pos * 10 + sub) AS in_head, bool_or(render_blocking) AS render_blocking, bool_or(is_async) AS is_async, bool_or(is_defer) AS is_defer, bool_or(lazy) AS lazy,
 bool_or(regexp_extract(url, '^https?://[^/]+') = regexp_extract(page_url, '^https?://[^/]+')) AS same_origin FROM rc WHERE url IS NOT NULL GROUP BY page_id, url)"""


@query("P21_resource_discovery", o.with_([o.RP, RES], "SELECT page_id, url, type, in_head, render_blocking, is_async, is_defer, lazy FROM res"))
def p21(spark, sf):
    return res.page_resources(inputs.page_raw(spark, sf)).select(
        "page_id", "url", "type", "in_head", "render_blocking", "is_async", "is_defer", "lazy"
    )


@query("P22_resource_type", """SELECT doc_id, CASE WHEN e IN ('woff', 'woff2', 'ttf', 'otf', 'eot') THEN 'font' WHEN e IN ('png', 'jpg', 'jpeg', 'webp', 'avif', 'gif', 'svg', 'ico') THEN 'image'
 WHEN e IN ('js', 'mjs', 'jsx', 'ts', 'tsx') THEN 'script' WHEN e = 'css' THEN 'stylesheet' ELSE 'other' END AS type
 FROM (SELECT doc_id, ['woff2', 'JPEG', 'mjs', 'css', 'html', 'ico', 'tsx', 'eot', 'ts', 'txt'][CAST(doc_id % 10 AS INT) + 1] AS e0, lower(['woff2', 'JPEG', 'mjs', 'css', 'html', 'ico', 'tsx', 'eot', 'ts', 'txt'][CAST(doc_id % 10 AS INT) + 1]) AS e FROM documents)""")
def p22(spark, sf):
    exts = F.array(*[F.lit(e) for e in ("woff2", "JPEG", "mjs", "css", "html", "ico", "tsx", "eot", "ts", "txt")])
    url = F.concat(
        F.lit("https://"), "source", F.lit(".example/f/x."), F.element_at(exts, (F.col("doc_id") % 10).cast("int") + 1), F.lit("?v=1")
    )
    return inputs.texts(spark, sf).select("doc_id", res.resource_type(url, "other").alias("type"))


@query("P23_third_party", o.with_([o.RP, RES], "SELECT page_id, url, same_origin, NOT same_origin AS third_party FROM res"))
def p23(spark, sf):
    return res.page_resources(inputs.page_raw(spark, sf)).select("page_id", "url", "same_origin", "third_party")


@query("P24_site_resources", o.with_([o.RP, RES], """SELECT site_id, url, arg_min(type, page_id) AS type, bool_or(render_blocking) AS render_blocking, bool_or(lazy) AS lazy, bool_or(NOT same_origin) AS third_party, count(*) AS n_pages
FROM res JOIN (SELECT page_id, site_id FROM rp) USING (page_id) GROUP BY site_id, url"""))
def p24(spark, sf):
    return res.site_resources(res.page_resources(inputs.page_raw(spark, sf))).select(
        "site_id", "url", "type", "render_blocking", "lazy", "third_party", "n_pages"
    )


@query("P25_heading_jump", o.with_([o.RP, o.HEADS], """SELECT page_id, arg_min(prev, ord) AS from_level, arg_min(level, ord) AS to_level
FROM (SELECT page_id, ord, level, lag(level) OVER (PARTITION BY page_id ORDER BY ord) AS prev FROM heads WHERE text <> '') WHERE level > prev + 1 GROUP BY page_id"""))
def p25(spark, sf):
    jump = p.first_heading_jump(F.col("headings")).alias("j")
    return snapshots(spark, sf).select("page_id", jump).filter("j IS NOT NULL").select("page_id", "j.from_level", "j.to_level")


@query("P26_json_key_test", o.with_([o.RP, o.LD], """SELECT page_id, bool_or(contains(raw, '"openingHours"') OR contains(raw, '"openingHoursSpecification"')) AS has_hours, bool_or(contains(raw, '"offers"')) AS has_offers
FROM ld WHERE NOT bad GROUP BY page_id"""))
def p26(spark, sf):
    from auditlake.functions.json_walk import json_keys

    rows = inputs.page_raw(spark, sf).select("page_id", F.explode(p.json_ld_list(F.col("html"))).alias("b"))
    keyed = rows.filter("NOT b.parse_error").select("page_id", json_keys("b.raw").alias("keys"))
    return keyed.groupBy("page_id").agg(
        F.bool_or(F.arrays_overlap("keys", F.array(F.lit("openingHours"), F.lit("openingHoursSpecification")))).alias("has_hours"),
        F.bool_or(F.array_contains("keys", "offers")).alias("has_offers"),
    )


@query("P27_risky_tools", o.with_([o.DOCS], f"""SELECT page_id, t AS tool FROM (SELECT page_id, unnest(regexp_extract_all(mcp_body, '"name":"([^"]*)"', 1)) AS t, mcp_body FROM docs WHERE json_valid(mcp_body)) WHERE regexp_matches(lower(t), 'create|update|delete|remove|write|mutate|checkout|payment|purchase|refund|cancel|send')"""))
def p27(spark, sf):
    from auditlake.functions.json_walk import risky_tool_names

    docs = inputs.site_documents(spark, sf)
    return docs.select("page_id", F.explode(risky_tool_names("mcp_body")).alias("tool"))


# Rendered twin of a page: the same page after scripts ran, derived row by row from the raw snapshot.
RENDERED_SQL = """page_id, CASE WHEN page_id % 4 = 0 THEN title || ' (app)' ELSE title END AS title, CASE WHEN page_id % 5 = 0 THEN 'rendered' ELSE meta_description END AS meta_description,
 CASE WHEN page_id % 3 = 0 THEN canonical END AS canonical, word_count + (page_id % 50) AS word_count, page_id % 6 = 5 AS failed"""
DIFF_SQL = f"rend AS (SELECT {RENDERED_SQL} FROM snap)"


@query("P28_render_diff", o.with_([*o.PAGE_CTES, DIFF_SQL], """SELECT s.page_id, array_to_string(list_filter([CASE WHEN s.title IS DISTINCT FROM r.title THEN 'title' END, CASE WHEN s.meta_description IS DISTINCT FROM r.meta_description THEN 'metaDescription' END,
 CASE WHEN s.canonical IS DISTINCT FROM r.canonical THEN 'canonical' END, CASE WHEN abs(s.word_count - r.word_count) > 25 THEN 'wordCount' END], lambda x: x IS NOT NULL), ',') AS changed FROM snap s JOIN rend r USING (page_id) WHERE NOT r.failed"""))
def p28(spark, sf):
    from auditlake.operators import rendering as rd

    s = snapshots(spark, sf)
    return rd.render_diff(s, s.selectExpr(*inputs._split(RENDERED_SQL)).filter("NOT failed"), ["page_id"]).select("page_id", F.array_join("changed", ",").alias("changed"))


@query("P29_render_diff_report", o.with_([*o.PAGE_CTES, DIFF_SQL], """SELECT s.page_id, CASE WHEN r.failed IS FALSE THEN 'rendered' ELSE 'raw_only' END AS basis,
 CASE WHEN r.failed IS FALSE THEN s.title IS DISTINCT FROM r.title OR s.meta_description IS DISTINCT FROM r.meta_description OR s.canonical IS DISTINCT FROM r.canonical OR abs(s.word_count - r.word_count) > 25 ELSE s.word_count < 30 AND s.n_int = 0 END AS hydration_risk
 FROM snap s LEFT JOIN (SELECT * FROM rend WHERE NOT failed) r USING (page_id)"""))
def p29(spark, sf):
    from auditlake.operators import rendering as rd

    s = snapshots(spark, sf)
    return rd.render_diff_report(s, s.selectExpr(*inputs._split(RENDERED_SQL)).filter("NOT failed"), ["page_id"], render_always=False).select("page_id", "basis", "hydration_risk")


@query("P30_raw_fallback", o.with_([*o.PAGE_CTES, DIFF_SQL], """SELECT s.page_id, CASE WHEN r.failed THEN s.title ELSE r.title END AS title, CASE WHEN r.failed THEN s.word_count ELSE r.word_count END AS word_count FROM snap s JOIN rend r USING (page_id)"""))
def p30(spark, sf):
    from auditlake.operators import rendering as rd

    s = snapshots(spark, sf)
    return rd.raw_fallback(s, s.selectExpr(*inputs._split(RENDERED_SQL)), ["page_id"], ["title", "word_count"]).select("page_id", "title", F.col("word_count").cast("long").alias("word_count"))


URLS = "page_id, url"


@query("U1_normalize_url", o.with_([o.RP, o.TAGS], f"SELECT page_id, href, {o.resolve('href', 'url')} AS resolved FROM (SELECT page_id, url, {o.at('tag', 'href')} AS href FROM tags WHERE name IN ('a', 'link') AND NOT closing) WHERE href IS NOT NULL"))
def u1(spark, sf):
    rows = inputs.page_raw(spark, sf).select(
        "page_id", u.url_parts(F.col("url")).alias("b"), F.explode(m.tag_stream(F.col("html"), ["a", "link"])).alias("t")
    )
    href = rows.filter("NOT t.closing").select("page_id", "b", m.attr(F.col("t"), "href").alias("href")).filter("href IS NOT NULL")
    return href.select("page_id", "href", u.admit_href(F.col("href"), F.col("b")).alias("resolved"))
