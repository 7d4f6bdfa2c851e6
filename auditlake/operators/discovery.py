"""Discovery documents: robots.txt lines and roll-ups, sitemap entries and checks, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions import markup as m
from auditlake.functions import urls as u
from auditlake.functions.binding import bind

SITE = ["site_id", "run_id"]
# Fixed patterns of the robots reading.
AI_COMMENT = "(?i)ai-|ai_|content-signal|ai input|ai train"
AI_LINE = "(?i)content-signal|ai-input|ai-train|gptbot|google-extended|ccbot"
PRIVATE_VALUE = "(?i)admin|account|login|logout|checkout|cart|payment|private|preview|api/internal"


def probes(sites: DataFrame, endpoint_raw: DataFrame, excerpt_limit: int | None = None) -> DataFrame:
    """Every site with every well-known path; a path nobody answered is a row with ok = false.

    The path list is a literal of 22 entries exploded per site, not a join."""
    grid = sites.select(*SITE, F.explode(F.array(*[F.lit(p) for p in dims.ENDPOINT_PATHS])).alias("path"))
    out = grid.join(endpoint_raw, [*SITE, "path"], "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return out.withColumn("body", F.substring("body", 1, excerpt_limit)) if excerpt_limit else out


def robots_line_array(body: Column) -> Column:
    """array<struct<ord,kind,key,value,line>>: trimmed lines, comments and blanks marked."""

    def line(raw: Column, i: Column) -> Column:
        def build(text: Column) -> Column:
            note = (text == "") | text.startswith("#")
            return F.struct(
                i.alias("ord"),
                note.alias("note"),
                F.when(~note, F.lower(m.js_trim(F.regexp_replace(text, "(?s):.*$", "")))).alias("key"),
                F.when(~note, m.js_trim(F.regexp_extract(text, "(?s)^[^:]*:(.*)$", 1))).alias("value"),
                text.alias("line"),
            )

        return bind(m.js_trim(raw), build)

    return F.transform(F.split(body, r"\r?\n", -1), line)


def robots_lines(docs: DataFrame, body: str = "body") -> DataFrame:
    """Line table with the user agent in force: the last user-agent line at or before each line."""
    rows = docs.select(*SITE, F.explode(robots_line_array(F.col(body))).alias("l")).select(*SITE, "l.*")
    w = W.partitionBy(*SITE).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    agent = F.last(F.when(F.col("key") == "user-agent", F.col("value")), ignorenulls=True).over(w)
    return rows.withColumn("agent", agent)


def robots_info(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per document: sitemaps, blanket block for '*', AI signal, private disallows.

    A fold over the document's own lines carries the current agent, so no line ever leaves its row."""
    start = F.struct(
        F.lit(False).alias("star"),
        F.lit(False).alias("block"),
        F.lit(False).alias("private"),
        F.lit(False).alias("ai"),
        F.array().cast("array<string>").alias("maps"),
    )

    def step(acc: Column, ln: Column) -> Column:
        key, value = F.coalesce(ln["key"], F.lit("")), F.coalesce(ln["value"], F.lit(""))
        star = F.when(key == "user-agent", value == "*").otherwise(acc["star"])
        disallow = star & (key == "disallow")
        ai = F.when(ln["note"], ln["line"].rlike(AI_COMMENT)).otherwise(ln["line"].rlike(AI_LINE))
        return F.struct(
            star.alias("star"),
            (acc["block"] | (disallow & (value == "/"))).alias("block"),
            (acc["private"] | (disallow & value.rlike(PRIVATE_VALUE))).alias("private"),
            (acc["ai"] | ai).alias("ai"),
            F.when((key == "sitemap") & (value != ""), F.array_append(acc["maps"], value))
            .otherwise(acc["maps"])
            .alias("maps"),
        )

    folded = docs.select(*SITE, F.aggregate(robots_line_array(F.col(body)), start, step).alias("r"))
    return folded.select(
        *SITE,
        F.col("r.maps").alias("sitemap_urls"),
        F.col("r.block").alias("disallow_all"),
        F.col("r.ai").alias("has_ai_signal"),
        F.col("r.private").alias("has_private_disallows"),
    )


LOC = r"(?is)<loc(?:[/\t\n\r ][^>]*+)?>(.*?)</loc[>/\t\n\r ]"


def sitemap_locs(body: Column) -> Column:
    """array<string> of decoded, trimmed loc values."""
    raw = F.regexp_extract_all(m.js_trim(body), F.lit(LOC), F.lit(1))
    return F.filter(F.transform(raw, lambda v: m.js_trim(_xml_decode(v))), lambda v: v != "")


def _xml_decode(text: Column) -> Column:
    out = text
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sitemap_entries(docs: DataFrame, body: str = "body") -> DataFrame:
    return docs.select(*SITE, F.posexplode(sitemap_locs(F.col(body))).alias("ord", "loc"))


def sitemap_errors(body: Column) -> Column:
    """array<string> of what is wrong with a sitemap body; empty when it is usable."""
    text = m.js_trim(body)
    root = text.rlike(r"(?i)<(?:urlset|sitemapindex)(?:>|[/\t\n\r ][^>]*>)")
    return F.array_compact(
        F.array(
            F.when(~text.startswith("<"), F.lit("Sitemap response is not XML.")),
            F.when(
                (F.length(text) > 0) & ~root, F.lit("Sitemap XML does not contain urlset or sitemapindex root.")
            ),
            F.when(
                (F.length(text) > 0) & (F.size(sitemap_locs(body)) == 0), F.lit("Sitemap XML contains no loc entries.")
            ),
        )
    )


MAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml"]
INDEX_ROOT = r"(?i)<sitemapindex(?:>|[/\t\n\r ][^>]*>)"


def _entries(docs: DataFrame, *keep: str) -> DataFrame:
    """Entries of sitemap bodies and whether they are those of an index; bodies stay in their rows."""
    return docs.select(
        *SITE, *keep, F.coalesce(F.col("body").rlike(INDEX_ROOT), F.lit(False)).alias("is_index"), F.posexplode(sitemap_locs(F.col("body"))).alias("ord", "loc")
    )


def named_maps(endpoints: DataFrame) -> DataFrame:
    """Distinct (site_id, run_id, url) of the sitemaps that robots.txt names."""
    robots = robots_info(endpoints.filter((F.col("path") == "/robots.txt") & F.col("ok")))
    return robots.select(*SITE, F.explode("sitemap_urls").alias("url")).distinct()


def probed_entries(endpoints: DataFrame) -> DataFrame:
    """Entries of the probed sitemaps that count: the first of each site that answered, and the other one if it answered
    and robots.txt names it."""
    which = F.when(F.col("path") == MAP_PATHS[0], 0).otherwise(1)
    maps = endpoints.filter(F.col("path").isin(MAP_PATHS) & F.col("ok")).withColumn("which", which)
    first = maps.groupBy(*SITE).agg(F.min("which").alias("which"))
    named = maps.select(*SITE, "which", "url").join(named_maps(endpoints), [*SITE, "url"], "left_semi").select(*SITE, "which")
    return _entries(maps, "which").join(first.unionByName(named).distinct(), [*SITE, "which"]).drop("which")


def sitemap_universe(endpoints: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Distinct page URLs (site_id, run_id, loc) on the site's own origin that its sitemaps list.

    Sitemaps are the probed ones and those that robots.txt names, an index is expanded one level. ``documents``
    (site_id, run_id, url, body) holds the fetched children and named sitemaps; without it only what was probed counts,
    the named ones among it too, and the entries of an index are no pages."""
    entries = probed_entries(endpoints)
    if documents is not None:
        # A named map that was probed is among the entries already.
        probed = endpoints.filter(F.col("path").isin(MAP_PATHS) & F.col("ok")).select(*SITE, "url")
        named = named_maps(endpoints).join(probed, [*SITE, "url"], "left_anti")
        entries = entries.unionByName(_entries(documents.join(named, [*SITE, "url"], "left_semi")))
        children = expand_index(entries.filter("is_index").withColumn("site_origin", F.col("site_id")), documents).select(*SITE, "loc")
        pages = entries.filter("NOT is_index").select(*SITE, "loc").unionByName(children)
    else:
        pages = entries.filter("NOT is_index").select(*SITE, "loc")
    return pages.filter(u.same_origin(F.col("loc"), F.col("site_id"))).distinct()


def sitemap_url_counts(endpoints: DataFrame, documents: DataFrame | None = None, universe: DataFrame | None = None) -> DataFrame:
    """Sitemap URLs per site and how many of them are private; a site whose map is empty has a row of zeros. Where the
    children of an index aren't known, its entries keep the map from counting as empty. ``universe`` is what
    ``sitemap_universe`` gives, where it is at hand."""
    answered = endpoints.filter(F.col("path").isin(MAP_PATHS) & F.col("ok")).select(*SITE)
    urls = universe if universe is not None else sitemap_universe(endpoints, documents)
    if documents is None:
        urls = urls.unionByName(probed_entries(endpoints).filter("is_index").select(*SITE, "loc").distinct())
    answered = answered.unionByName(urls.select(*SITE)).distinct()
    counts = urls.groupBy(*SITE).agg(F.count("*").alias("n_sitemap_urls"), F.count_if(u.is_private_url(F.col("loc"))).alias("n_private_sitemap_urls"))
    return answered.join(counts, SITE, "left").fillna(0, ["n_sitemap_urls", "n_private_sitemap_urls"])


def expand_index(index_entries: DataFrame, documents: DataFrame, max_children: int | None = None) -> DataFrame:
    """One level of a sitemap index: the children on the site's own origin, joined to their documents.

    All children are read; ``max_children`` keeps those among the first so many entries of an index, before the origin
    test, by position."""
    if max_children is not None:
        w = W.partitionBy(*SITE).orderBy("ord", "loc")
        index_entries = index_entries.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max_children).drop("rn")
    own = index_entries.filter(u.same_origin(F.col("loc"), F.col("site_origin")))
    children = own.select(*SITE, "loc").distinct()
    docs = documents.select(*SITE, F.col("url").alias("loc"), "body")
    joined = children.join(docs, [*SITE, "loc"])
    return joined.select(*SITE, F.col("loc").alias("child"), F.explode(sitemap_locs(F.col("body"))).alias("loc"))


def sitemap_candidates(robots: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Sitemaps named in robots.txt united with the probed ones that answered."""
    named = robots.select(*SITE, F.explode("sitemap_urls").alias("sitemap_url"))
    probed = endpoints.filter(F.col("path").isin("/sitemap.xml", "/sitemap_index.xml") & F.col("ok")).select(
        *SITE, F.col("url").alias("sitemap_url")
    )
    return named.unionByName(probed).distinct()


def discovery_json(endpoints: DataFrame) -> DataFrame:
    """State of the three JSON discovery documents of every site."""
    paths = ["/.well-known/agent-skills/index.json", "/.well-known/mcp.json", "/.well-known/api-catalog"]
    rows = endpoints.filter(F.col("path").isin(paths))
    state = (
        F.when(~F.coalesce("ok", F.lit(False)), "missing")
        .when(F.try_parse_json(F.coalesce("body", F.lit(""))).isNull(), "invalid")
        .otherwise("valid")
    )
    return rows.select(*SITE, "path", state.alias("state"))


def published_json(endpoints: DataFrame) -> DataFrame:
    """Bodies that start with a brace must parse."""
    rows = endpoints.filter(F.col("ok") & m.js_trim(F.col("body")).startswith("{"))
    return rows.select(*SITE, "path", F.try_parse_json(F.col("body")).isNotNull().alias("parses"))
