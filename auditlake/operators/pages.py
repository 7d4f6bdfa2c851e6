"""Page feature extraction: bronze ``page_raw`` rows to silver snapshots, tags, links and resources.

Input columns: site_id, run_id, page_id, url, final_url, status, content_type, headers, html, redirect_chain, depth, ord.
The snapshot is one narrow projection over the scan; only the long tables (tags, links, ...) explode, and they
explode what is already extracted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import markup as m
from auditlake.functions import urls as u
from auditlake.functions.binding import bind
from auditlake.functions.json_walk import json_types

KEYS = ["site_id", "run_id", "page_id"]
SNAPSHOT_TAGS = ["a", "meta", "link", "html", "img", "form"]
#: Characters of a page's text kept for display.
EXCERPT = 1200


def html_pages(page_raw: DataFrame) -> DataFrame:
    """Admission: HTML content type, or a body that opens an html element."""
    return page_raw.filter(
        F.coalesce(F.col("content_type").contains("text/html"), F.lit(False)) | F.col("html").contains("<html")
    )


def page_tags(page_raw: DataFrame) -> DataFrame:
    """Tag stream as rows: one per tag, document order."""
    return page_raw.select(
        *KEYS, F.posexplode(m.tag_stream(F.col("html"), attributes=False)).alias("ord", "t")
    ).select(*KEYS, "ord", "t.name", "t.closing", "t.attrs_text")


def page_attributes(page_raw: DataFrame) -> DataFrame:
    """Attributes as rows; of duplicates on one tag the last wins: after sorting by name and place it stands before
    another name."""
    tags = page_raw.select(*KEYS, F.posexplode(m.tag_stream(F.col("html"))).alias("ord", "t")).filter(~F.col("t.closing"))
    placed = F.array_sort(F.transform("t.attrs", lambda a, i: F.struct(a["name"].alias("name"), i.alias("place"), a["value"].alias("value"))))
    ordered = tags.select(*KEYS, "ord", F.col("t.name").alias("tag"), placed.alias("attrs"))
    last = F.filter("attrs", lambda a, i: ~F.try_element_at(F.col("attrs"), i + 2)["name"].eqNullSafe(a["name"]))
    return ordered.select(*KEYS, "ord", "tag", F.explode(last).alias("a")).select(*KEYS, "ord", "tag", "a.name", "a.value")


def meta_content(tags: Column, name: str) -> Column:
    """The first meta of that name decides, even when its content is empty."""
    hits = F.filter(m.open_tags(tags, "meta"), lambda t: F.coalesce(F.lower(m.attr(t, "name")) == name, F.lit(False)))
    return bind(m.first(hits), lambda t: m.null_if_blank(m.attr(t, "content")))


def prefixed_meta(tags: Column, key: str, prefix: str) -> Column:
    """map of metas whose key attribute starts with the prefix; the last of each key wins."""
    pairs = F.filter(
        F.transform(
            m.open_tags(tags, "meta"),
            lambda t: F.struct(
                F.coalesce(m.attr(t, key), F.lit("")).alias("k"),
                F.coalesce(m.attr(t, "content"), F.lit("")).alias("v"),
            ),
        ),
        lambda p: p["k"].startswith(prefix),
    )

    def dedupe(items: Column) -> Column:
        # Sorted by key and place, the last of a key is the one before another key; then back to document order.
        placed = F.array_sort(F.transform(items, lambda p, i: F.struct(p["k"].alias("k"), i.alias("place"), p["v"].alias("v"))))
        last = bind(placed, lambda rows: F.filter(rows, lambda p, i: ~F.try_element_at(rows, i + 2)["k"].eqNullSafe(p["k"])))
        ordered = F.array_sort(F.transform(last, lambda p: F.struct(p["place"].alias("place"), p["k"].alias("k"), p["v"].alias("v"))))
        kept = F.transform(ordered, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))
        return F.map_from_entries(kept)

    return bind(pairs, dedupe)


def canonical_link(tags: Column, base: Column) -> Column:
    """First link with that rel token whose target resolves."""
    links = F.filter(m.open_tags(tags, "link"), lambda t: m.rel_has(m.attr(t, "rel"), "canonical"))
    return m.first(
        F.filter(F.transform(links, lambda t: u.admit_href(m.attr(t, "href"), base)), lambda x: x.isNotNull())
    )


def hreflang_pairs(tags: Column, base: Column) -> Column:
    links = F.filter(
        m.open_tags(tags, "link"), lambda t: m.rel_has(m.attr(t, "rel"), "alternate") & m.has_attr(t, "hreflang")
    )
    pairs = F.transform(
        links,
        lambda t: F.struct(
            F.lower(m.js_trim(m.attr(t, "hreflang"))).alias("language"),
            u.admit_href(m.attr(t, "href"), base).alias("href"),
        ),
    )
    return F.array_distinct(F.filter(pairs, lambda p: p["href"].isNotNull() & (p["language"] != "")))


def image_list(tags: Column, base: Column) -> Column:
    images = F.transform(
        m.open_tags(tags, "img"),
        lambda t: F.struct(
            u.admit_href(m.attr(t, "src"), base).alias("src"),
            m.attr(t, "alt").alias("alt"),
            m.has_attr(t, "width").alias("has_width"),
            m.has_attr(t, "height").alias("has_height"),
        ),
    )
    return F.filter(images, lambda i: i["src"].isNotNull())


def link_list(tags: Column, base: Column) -> Column:
    """Distinct resolved link targets in first-seen order."""
    targets = F.transform(m.open_tags(tags, "a"), lambda t: u.admit_href(m.attr(t, "href"), base))
    return F.array_distinct(F.filter(targets, lambda x: x.isNotNull()))


def json_ld_list(html: Column) -> Column:
    """Each block with its parse flag and the types found in it."""
    return F.transform(
        m.json_ld_blocks(html),
        lambda raw: F.struct(raw.alias("raw"), F.try_parse_json(raw).isNull().alias("parse_error")),
    )


def skip_link(tags: Column) -> Column:
    return F.exists(
        m.open_tags(tags, "a"),
        lambda t: F.coalesce(m.js_trim(m.attr(t, "href")).isin("#main", "#content", "#main-content"), F.lit(False)),
    )


def first_heading_jump(headings: Column) -> Column:
    """First heading more than one level below its predecessor: struct<from,to>, or NULL."""
    jumps = F.filter(
        F.zip_with(
            F.slice(headings, 1, F.greatest(F.size(headings) - 1, F.lit(0))),
            F.slice(headings, 2, F.size(headings)),
            lambda a, b: F.struct(a["level"].alias("from_level"), b["level"].alias("to_level")),
        ),
        lambda j: j["to_level"] > j["from_level"] + 1,
    )
    return m.first(jumps)


def page_snapshots(page_raw: DataFrame, judged_chars: int | None = None) -> DataFrame:
    """One row per HTML page with every extracted feature; a single narrow stage over the scan.

    ``body_excerpt`` is for display. Rules and duplicates judge ``body_text``, the whole text unless ``judged_chars``
    cuts it."""
    html, tags, base, text = F.col("html"), F.col("_tags"), F.col("_base"), F.col("_text")
    staged = html_pages(page_raw).select(
        *[c for c in page_raw.columns],
        m.tag_stream(html, SNAPSHOT_TAGS).alias("_tags"),
        m.visible_text(html).alias("_text"),
        u.url_parts(F.col("final_url")).alias("_base"),
        u.origin(F.col("final_url")).alias("_origin"),
    )
    listed = staged.select(
        *[c for c in page_raw.columns if c != "html"],
        "_text",
        "_origin",
        m.element_text(html, "title").alias("title"),
        meta_content(tags, "description").alias("meta_description"),
        meta_content(tags, "robots").alias("robots_meta"),
        meta_content(tags, "viewport").alias("viewport"),
        canonical_link(tags, base).alias("canonical"),
        hreflang_pairs(tags, base).alias("hreflang"),
        bind(m.first(m.open_tags(tags, "html")), lambda t: m.null_if_blank(m.attr(t, "lang"))).alias("lang"),
        m.headings(html).alias("headings"),
        F.transform(
            link_list(tags, base),
            lambda x: F.struct(x.alias("url"), (u.origin(x) == F.col("_origin")).alias("internal")),
        ).alias("_links"),
        image_list(tags, base).alias("images"),
        json_ld_list(html).alias("json_ld"),
        prefixed_meta(tags, "property", "og:").alias("open_graph"),
        prefixed_meta(tags, "name", "twitter:").alias("twitter_cards"),
        skip_link(tags).alias("has_skip_link"),
        F.size(m.open_tags(tags, "form")).alias("forms"),
    )

    def side(internal: bool) -> Column:
        return F.transform(F.filter("_links", lambda x: x["internal"] == internal), lambda x: x["url"])

    return listed.select(
        *[c for c in listed.columns if not c.startswith("_")],
        side(True).alias("internal_links"),
        side(False).alias("external_links"),
        m.word_count(text).alias("word_count"),
        F.substring(text, 1, EXCERPT).alias("body_excerpt"),
        (F.substring(text, 1, judged_chars) if judged_chars else text).alias("body_text"),
    )


def with_json_ld_types(snapshots: DataFrame) -> DataFrame:
    """Adds json_ld_types, the distinct types over the page's valid blocks.

    The recursive walk runs in an Arrow worker; pages without any block send NULL, which it skips."""
    valid = F.transform(F.filter("json_ld", lambda b: ~b["parse_error"]), lambda b: b["raw"])
    return snapshots.withColumn(
        "json_ld_types",
        F.when(F.size("json_ld") > 0, F.coalesce(json_types(valid), F.array().cast("array<string>"))).otherwise(
            F.array().cast("array<string>")
        ),
    )


def page_links(snapshots: DataFrame) -> DataFrame:
    """Link table: one row per distinct target of a page, with the internal flag."""
    both = F.concat(
        F.transform("internal_links", lambda x: F.struct(x.alias("dst"), F.lit(True).alias("internal"))),
        F.transform("external_links", lambda x: F.struct(x.alias("dst"), F.lit(False).alias("internal"))),
    )
    return snapshots.select(
        *KEYS, F.col("url"), F.col("final_url").alias("src"), F.explode(both).alias("l")
    ).select(*KEYS, "url", "src", "l.dst", "l.internal")


def page_headings(snapshots: DataFrame) -> DataFrame:
    return snapshots.select(*KEYS, F.posexplode("headings").alias("ord", "h")).select(
        *KEYS, "ord", "h.level", "h.text"
    )
