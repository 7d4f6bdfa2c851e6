"""Resources referenced by pages: scripts, styles, fonts, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import markup as m
from auditlake.functions import urls as u
from auditlake.functions.binding import bind
from auditlake.functions.numeric import name_of, rank_case
from auditlake.functions.text import ascii_edges

KEYS = ["site_id", "run_id", "page_id"]
# This scan is simpler than the tag grammar on purpose: comments and quoted '>' are not special in it.
RESOURCE_TAG = r"(?i)<\s*(?:script|link|img|source)\b[^>]*>"
RESOURCE_NAME = r"(?i)^<\s*(script|link|img|source)"
RESOURCE_ATTR = r"""[^\s"'<>/=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""
# Resource type by file extension.
TYPE_PATTERNS = [
    ("font", r"\.(woff2?|ttf|otf|eot)$"),
    ("image", r"\.(png|jpe?g|webp|avif|gif|svg|ico)$"),
    ("script", r"\.(m?js|jsx|ts|tsx)$"),
    ("stylesheet", r"\.css$"),
]

TYPES = ["font", "image", "script", "stylesheet", "preload"]


def resource_type(url: Column, fallback: str) -> Column:
    def classify(path: Column) -> Column:
        out = F.lit(fallback)
        for kind, pattern in reversed(TYPE_PATTERNS):
            out = F.when(path.rlike(pattern), F.lit(kind)).otherwise(out)
        return out

    return bind(F.lower(F.coalesce(u.url_path(url), F.lit(""))), classify)


def _attrs(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(RESOURCE_ATTR), F.lit(0)),
        lambda t: F.struct(
            F.lower(F.regexp_extract(t, r"^[^\s=]+", 0)).alias("name"),
            m.decode_entities(
                F.regexp_replace(F.regexp_replace(t, r"^[^\s=]+\s*=?\s*", ""), r"""^["']|["']$""", "")
            ).alias("value"),
        ),
    )


def _resolve(value: Column, base: Column) -> Column:
    return F.when(~F.lower(F.trim(value)).rlike("^(data|javascript|mailto|tel):"), u.admit_href(value, base))


def _candidates(tag: Column, base: Column, in_head: Column) -> Column:
    """Zero or more (url, type, flags) of one tag."""
    name, attrs = tag["name"], tag["attrs"]

    def get(key: str) -> Column:
        return F.try_element_at(F.filter(attrs, lambda a: a["name"] == key), F.lit(-1))["value"]

    def flag(key: str) -> Column:
        return F.exists(attrs, lambda a: a["name"] == key)

    rel = F.coalesce(F.lower(get("rel")), F.lit(""))
    is_async, is_defer = flag("async"), flag("defer")
    lazy = F.coalesce(F.lower(get("loading")) == "lazy", F.lit(False))
    no = F.lit(False)

    def one(url: Column, kind: Column, blocking: Column, a: Column, d: Column, z: Column) -> Column:
        return F.struct(
            url.alias("url"), kind.alias("type"), blocking.alias("render_blocking"), a.alias("is_async"),
            d.alias("is_defer"), z.alias("lazy"), in_head.alias("in_head"),
        )

    script = bind(
        _resolve(get("src"), base),
        lambda s: one(s, F.lit("script"), ~is_async & ~is_defer, is_async, is_defer, lazy),
    )
    link = bind(
        _resolve(get("href"), base),
        lambda s: one(
            F.when(rel.rlike("stylesheet|preload|icon"), s),
            F.when(rel.contains("stylesheet"), F.lit("stylesheet"))
            .when(rel.contains("preload"), resource_type(s, "preload"))
            .otherwise(F.lit("image")),
            rel.contains("stylesheet"),
            no,
            no,
            no,
        ),
    )
    image = one(_resolve(get("src"), base), F.lit("image"), no, no, no, lazy)
    srcset = F.transform(
        F.filter(
            F.transform(F.split(get("srcset"), ","), lambda p: F.element_at(F.split(m.js_trim(p), r"\s+"), 1)),
            lambda p: p != "",
        ),
        lambda p: one(_resolve(p, base), F.lit("image"), no, no, no, lazy),
    )
    found = (
        F.when(name == "script", F.array(script))
        .when(name == "link", F.array(link))
        .otherwise(F.concat(F.array(image), F.coalesce(srcset, F.array().cast(
            "array<struct<url:string,type:string,render_blocking:boolean,is_async:boolean,is_defer:boolean,lazy:boolean,in_head:boolean>>"
        ))))
    )
    return F.filter(found, lambda c: c["url"].isNotNull())


def page_resources(page_raw: DataFrame) -> DataFrame:
    """One row per distinct resource of a page; flags OR-merged, the first sighting gives type and place."""
    html = F.col("html")
    head_end = F.locate("</head>", F.lower(html))
    head = F.when(head_end > 0, F.substr(html, F.lit(1), head_end - 1)).otherwise(F.lit(""))
    body = F.when(head_end > 0, F.substr(html, head_end)).otherwise(html)

    def parse(part: Column, in_head: bool) -> Column:
        return F.transform(
            F.regexp_extract_all(part, F.lit(ascii_edges(RESOURCE_TAG)), F.lit(0)),
            lambda t: F.struct(
                F.lower(F.regexp_extract(t, RESOURCE_NAME, 1)).alias("name"),
                _attrs(F.regexp_replace(F.regexp_replace(t, RESOURCE_NAME, ""), r">$", "")).alias("attrs"),
                F.lit(in_head).alias("in_head"),
            ),
        )

    staged = page_raw.select(
        *KEYS,
        "final_url",
        u.url_parts(F.col("final_url")).alias("_base"),
        F.concat(parse(head, True), parse(body, False)).alias("_tags"),
    )
    found = F.flatten(F.transform("_tags", lambda t: _candidates(t, F.col("_base"), t["in_head"])))
    rows = staged.select(*KEYS, "final_url", F.explode(bind(found, _merged)).alias("r")).select(*KEYS, "final_url", "r.*")
    return rows.select(
        *[c for c in rows.columns if c not in ("final_url", "type")],
        "type",
        u.same_origin(F.col("url"), F.col("final_url")).alias("same_origin"),
    ).withColumn("third_party", ~F.col("same_origin"))


def _merged(found: Column) -> Column:
    """Sightings of a page by URL, inside its row: sorted by URL and place, equal URLs are neighbours."""
    placed = F.array_sort(F.transform(found, lambda c, i: F.struct(c["url"].alias("url"), i.alias("ord"), c.alias("c"))))

    def merge(rows: Column) -> Column:
        n = F.size(rows)
        at = lambda i: F.element_at(rows, i)["url"]
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == 1) | (at(i) != at(F.greatest(i - 1, F.lit(1))))))

        def groups(first: Column) -> Column:
            after = F.concat(F.slice(first, 2, F.greatest(F.size(first), F.lit(1))), F.array(n + 1))
            return F.zip_with(first, after, lambda i, j: F.slice(rows, i, j - i))

        def one(g: Column) -> Column:
            head = F.element_at(g, 1)
            any_of = lambda flag: F.exists(g, lambda x: x["c"][flag]).alias(flag)
            return F.struct(
                head["url"].alias("url"), head["ord"].alias("ord"), head["c"]["type"].alias("type"), head["c"]["in_head"].alias("in_head"),
                any_of("render_blocking"), any_of("is_async"), any_of("is_defer"), any_of("lazy"),
            )

        return F.transform(bind(starts, groups), one)

    return F.when(F.size(found) > 0, bind(placed, merge))


def site_resources(resources: DataFrame) -> DataFrame:
    """Distinct resources of a site over all its pages; partial aggregation meets the hot CDN files map-side."""
    # A page has one row per resource, so the first page alone decides the type.
    merged = resources.groupBy("site_id", "run_id", "url").agg(
        F.min_by(rank_case(F.col("type"), TYPES), F.col("page_id")).alias("k_type"),
        F.bool_or("render_blocking").alias("render_blocking"),
        F.bool_or("is_async").alias("is_async"),
        F.bool_or("is_defer").alias("is_defer"),
        F.bool_or("lazy").alias("lazy"),
        F.bool_or("third_party").alias("third_party"),
        F.count("*").alias("n_pages"),
    )
    return merged.withColumn("type", name_of(F.col("k_type"), TYPES)).drop("k_type")
