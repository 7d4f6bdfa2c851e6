"""Shared pieces of the oracle SQL: common table expressions and small text builders."""

from __future__ import annotations

from auditlake.functions import markup as m
from auditlake.functions import privacy_patterns as pat
from auditlake.functions import urls as u
from auditlake.plans import inputs


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    """Pattern literal without possessive repeats."""
    return q(m.rx(pattern))


SP = r"[\t\n\f\r ]"
VALUE = r"""*("[^"]*"|'[^']*'|[^\t\n\f\r >]+)"""


def trim(x: str) -> str:
    return f"trim({x}, {q(m.JS_SPACE_CHARS)})"


def decode(x: str) -> str:
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return trim(x)


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {rx(pattern)}, {q(to)}, 'g')"


def visible(x: str) -> str:
    x = sub(x, m.DROP_ELEMENTS, " ")
    x = sub(sub(x, m.DROP_OPENERS, ""), m.DROP_TAIL, "")
    x = sub(x, m.ANY_COMMENT, " ")
    x = sub(f"trim({sub(x, '[' + m.WS + ']+', ' ')})", m.TAG, " ")
    return trim(f"trim({sub(decode(x), '[' + m.WS + ']+', ' ')})")


def has(t: str, name: str) -> str:
    return f"regexp_matches({t}, {q('(?i)' + SP + name + r'[\t\n\f\r =/>]')})"


def at(t: str, name: str) -> str:
    raw = f"regexp_extract({t}, {q('(?i)' + SP + name + SP + '*=' + SP + VALUE)}, 1)"
    return f"CASE WHEN {has(t, name)} THEN {decode(f'trim({raw}, {q(chr(34) + chr(39))})')} END"


def encode(x: str, keep: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, {q(f'[{keep}]+|[^{keep}]+')}), "
        f"lambda r: CASE WHEN regexp_matches(r, {q(f'^[{keep}]')}) THEN r ELSE url_encode(r) END), '')"
    )


def resolve(href: str, base: str) -> str:
    """Link targets of the bound pages: absolute, rooted, dotted, query and fragment references."""
    site = f"regexp_extract({base}, '^https?://[^/]+', 0)"
    path = f"regexp_extract({base}, '^https?://[^/?#]+([^?#]*)', 1)"
    folder = f"regexp_replace({path}, '[^/]*$', '')"
    bare = f"regexp_replace({href}, '#.*$', '')"
    blocked = r"^(?:javascript|data|vbscript|mailto|tel):"
    return f"""CASE WHEN {href} IS NULL OR trim({href}) = '' OR regexp_matches(lower({href}), {q(blocked)}) THEN NULL
      WHEN regexp_matches({href}, '^https?://') THEN {bare}
      WHEN {href} = '../rel/./x.html' THEN {site} || regexp_replace({folder}, '[^/]+/$', '') || 'rel/x.html'
      WHEN {href} = '../up/b.jpg' THEN {site} || regexp_replace({folder}, '[^/]+/$', '') || 'up/b.jpg'
      WHEN starts_with({href}, '#') THEN regexp_replace({base}, '#.*$', '')
      ELSE {site} || {encode(href, u.PATH_KEEP)} END"""


def canon(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '#.*$', ''), '^(https?://[^/]+/(?:[^?]*[^/?])?)/(\\?|$)', '\\1\\2')"


def private_refs(x: str) -> str:
    """Private URLs of a text, then the first hit of each pattern, distinct and sorted."""
    hit = f"regexp_matches(regexp_extract(t, '^https?://[^/?#]+(.*)', 1), {q(pat.PRIVATE_ANY)})"
    firsts = ", ".join(f"regexp_extract({x}, {q(p)})" for p in pat.PRIVATE_PATHS + pat.SECRET_SHAPES)
    return (
        f"list_sort(list_distinct(list_concat(list_filter(regexp_extract_all({x}, {q(pat.URL_IN_TEXT)}), lambda t: {hit}), "
        f"list_filter([{firsts}], lambda t: t <> ''))))"
    )


RP = f"rp AS (SELECT {inputs.PAGE_RAW_SQL} FROM pages)"
TAGS = f"""tl AS (SELECT site_id, page_id, url, list_filter(regexp_extract_all(html, {rx(m.TOKEN)}), lambda x: NOT starts_with(x, '<!--')) AS ts FROM rp),
tags AS (SELECT site_id, page_id, url, ord, tag, lower(regexp_extract(tag, {rx(m.TAG)}, 2)) AS name, regexp_extract(tag, {rx(m.TAG)}, 1) = '/' AS closing
  FROM (SELECT site_id, page_id, url, unnest(ts) AS tag, generate_subscripts(ts, 1) - 1 AS ord FROM tl))"""
_H = "|".join(f"<h{n}(?:[\\t\\n\\f\\r ][^>]*)?>.*?</h{n}>" for n in range(1, 7))
HEADS = f"""hl AS (SELECT page_id, regexp_extract_all(html, {q('(?is)' + _H)}) AS hs FROM rp),
heads AS (SELECT page_id, ord, CAST(substr(h, 3, 1) AS INT) AS level, {visible("h")} AS text FROM (SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS ord FROM hl))"""
LINKS = f"""lk0 AS (SELECT page_id, url, ord, {resolve("href", "url")} AS dst FROM (SELECT page_id, url, ord, {at("tag", "href")} AS href FROM tags WHERE name = 'a' AND NOT closing)),
links AS (SELECT page_id, url, dst, min(ord) AS ord, regexp_extract(dst, '^https?://[^/?#]+', 0) = regexp_extract(url, '^https?://[^/]+', 0) AS internal FROM lk0 WHERE dst IS NOT NULL GROUP BY page_id, url, dst)"""
LD = f"""ldl AS (SELECT page_id, regexp_extract_all(html, {q('(?is)<script type="application/ld.json">.*?</script>')}) AS bs FROM rp),
ld AS (SELECT page_id, ord, raw, TRY_CAST(raw AS JSON) IS NULL OR NOT json_valid(raw) AS bad FROM (SELECT page_id, ord, trim(regexp_replace(b, '(?i)^<script[^>]*>|</script>$', '', 'g')) AS raw
  FROM (SELECT page_id, unnest(bs) AS b, generate_subscripts(bs, 1) - 1 AS ord FROM ldl))),
ldt AS (SELECT DISTINCT page_id, t FROM (SELECT page_id, unnest(regexp_extract_all(raw, '"@type":"([^"]*)"', 1)) AS t FROM ld WHERE NOT bad
  UNION ALL SELECT page_id, unnest(regexp_extract_all(regexp_extract(raw, '"@type":\\[([^\\]]*)\\]', 1), '"([^"]*)"', 1)) FROM ld WHERE NOT bad))"""


def meta(name: str) -> str:
    return f"(SELECT page_id, nullif(trim(arg_min(coalesce({at('tag', 'content')}, ''), ord)), '') AS v FROM tags WHERE name = 'meta' AND lower({at('tag', 'name')}) = '{name}' GROUP BY page_id)"


SNAP = f"""img AS (SELECT page_id, ord, {resolve(at("tag", "src"), "url")} AS src, {at("tag", "alt")} AS alt, {has("tag", "width")} AS w, {has("tag", "height")} AS h FROM tags WHERE name = 'img'),
hre AS (SELECT DISTINCT page_id, lower({at("tag", "hreflang")}) AS language, {resolve(at("tag", "href"), "url")} AS href FROM tags WHERE name = 'link' AND {has("tag", "hreflang")} AND lower({at("tag", "rel")}) = 'alternate'),
txt AS (SELECT page_id, {visible("html")} AS text, nullif({visible("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}, '') AS title FROM rp),
snap AS (SELECT rp.site_id, rp.run_id, rp.page_id, rp.url, rp.final_url, rp.status, rp.content_type, rp.cache_control, rp.content_encoding, rp.n_hops, rp.depth, rp.ord,
  txt.title, d.v AS meta_description, r.v AS robots_meta, w.v AS viewport, c.v AS canonical, l.v AS lang,
  substr(txt.text, 1, 1200) AS body_excerpt, txt.text AS body_text, len(list_filter(regexp_split_to_array(txt.text, {q(SP + "+")}), lambda s: s <> '')) AS word_count,
  coalesce(h.n_heads, 0) AS n_heads, coalesce(h.n_h1, 0) AS n_h1, coalesce(k.n_int, 0) AS n_int, coalesce(k.n_ext, 0) AS n_ext,
  coalesce(i.n_img, 0) AS n_img, coalesce(i.n_noalt, 0) AS n_noalt, coalesce(i.n_nodim, 0) AS n_nodim,
  coalesce(j.n_ld, 0) AS n_ld, coalesce(j.n_bad, 0) AS n_bad, coalesce(t.types, []) AS types,
  coalesce(g.n_og, 0) AS n_og, coalesce(g.n_tw, 0) AS n_tw, coalesce(g.n_form, 0) AS n_form, coalesce(g.skip, false) AS skip,
  coalesce(e.n_hre, 0) AS n_hre, coalesce(e.xdef, false) AS xdef
  FROM rp JOIN txt USING (page_id) LEFT JOIN {meta("description")} d USING (page_id) LEFT JOIN {meta("robots")} r USING (page_id) LEFT JOIN {meta("viewport")} w USING (page_id)
  LEFT JOIN (SELECT page_id, arg_min({resolve(at("tag", "href"), "url")}, ord) AS v FROM tags WHERE name = 'link' AND regexp_matches(lower({at("tag", "rel")}), '(^| )canonical( |$)') GROUP BY page_id) c USING (page_id)
  LEFT JOIN (SELECT page_id, nullif(arg_min({at("tag", "lang")}, ord), '') AS v FROM tags WHERE name = 'html' AND NOT closing GROUP BY page_id) l USING (page_id)
  LEFT JOIN (SELECT page_id, count(*) AS n_heads, count(*) FILTER (level = 1) AS n_h1 FROM heads WHERE text <> '' GROUP BY page_id) h USING (page_id)
  LEFT JOIN (SELECT page_id, count(*) FILTER (internal) AS n_int, count(*) FILTER (NOT internal) AS n_ext FROM links GROUP BY page_id) k USING (page_id)
  LEFT JOIN (SELECT page_id, count(*) AS n_img, count(*) FILTER (coalesce(alt, '') = '') AS n_noalt, count(*) FILTER (NOT w OR NOT h) AS n_nodim FROM img GROUP BY page_id) i USING (page_id)
  LEFT JOIN (SELECT page_id, count(*) AS n_ld, count(*) FILTER (bad) AS n_bad FROM ld GROUP BY page_id) j USING (page_id)
  LEFT JOIN (SELECT page_id, list_sort(list(t)) AS types FROM ldt GROUP BY page_id) t USING (page_id)
  LEFT JOIN (SELECT page_id, count(DISTINCT {at("tag", "property")}) FILTER (name = 'meta' AND starts_with({at("tag", "property")}, 'og:')) AS n_og,
     count(DISTINCT {at("tag", "name")}) FILTER (name = 'meta' AND starts_with({at("tag", "name")}, 'twitter:')) AS n_tw, count(*) FILTER (name = 'form' AND NOT closing) AS n_form,
     bool_or(name = 'a' AND NOT closing AND coalesce({at("tag", "href")}, '') IN ('#main', '#content', '#main-content')) AS skip FROM tags GROUP BY page_id) g USING (page_id)
  LEFT JOIN (SELECT page_id, count(*) AS n_hre, bool_or(language = 'x-default') AS xdef FROM hre GROUP BY page_id) e USING (page_id))"""
PAGE_CTES = [RP, TAGS, HEADS, LINKS, LD, SNAP]


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


ENDPOINTS = f"""fp AS (SELECT site_id, 'r0' AS run_id, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM (SELECT regexp_extract(url, '^https?://[^/]+', 0) AS site_id, page_id, url FROM pages) GROUP BY site_id),
ep AS (SELECT {inputs.ENDPOINT_SQL} FROM (SELECT fp.*, unnest([{", ".join(q(p) for p in inputs._PATHS)}]) AS path FROM fp))"""
DOCS = f"docs AS (SELECT {inputs.DOC_SQL} FROM ({inputs.DOC_SOURCE_SQL}))"
