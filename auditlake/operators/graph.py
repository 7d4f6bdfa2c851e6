"""Link graph of a crawl: depth, in-degree, orphans, hubs, frontier."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from auditlake.functions import privacy as x
from auditlake.functions import urls as u
from auditlake.operators.ranking import ranked
from auditlake.session import materialise, new_shared_path

SITE = ["site_id", "run_id"]
#: Characters after the site that spread its URLs over ranking buckets.
PATH_START = 6


#: Levels that are kept apart before they are written as one.
LEVELS_APART = 32


def crawl_depth(
    edges: DataFrame,
    seeds: DataFrame,
    *,
    max_depth: int | None = None,
    max_pages: int | None = None,
    blocked_sites: DataFrame | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Breadth-first depth of every reachable URL, site by site, all sites in the same sweep.

    ``edges``: site_id, run_id, src, dst. ``seeds``: site_id, run_id, url. A site whose robots file blocks everything
    keeps its seeds only. Levels go on until one is empty or, if given, for ``max_depth`` levels.

    URLs are numbered by a 64-bit hash of site, run and URL. The checked edges are pairs of such numbers, written once
    and bucketed by their source, so that no level shuffles them: a small frontier is broadcast by its size, a large
    one is dealt to the buckets. What was seen is a table (node, depth) with a folder per level, made one every so many
    levels, so each level has the same small plan however deep the crawl. A lost executor costs one level at most."""
    spark = edges.sparkSession
    # As many buckets as shuffle partitions, so that what is dealt to them meets them as they are.
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    node = lambda c: F.xxhash64(*SITE, c)
    safe = edges.filter(u.is_safe_crawl_url(F.col("dst"), F.col("site_id"))).select(*SITE, "src", "dst")
    if blocked_sites is not None:
        safe = safe.join(blocked_sites.select(*SITE), SITE, "left_anti")
    named = materialise(safe.select(*SITE, F.col("dst").alias("url"), node("src").alias("a"), node("dst").alias("node")), "safe-edges")
    starts = materialise(seeds.select(*SITE, "url").distinct().withColumn("node", node("url")), "crawl-seeds")
    table = f"auditlake_edges_{uuid.uuid4().hex[:12]}"
    pairs = named.select("a", "node").distinct().repartition(buckets, "a")
    pairs.write.bucketBy(buckets, "a").sortBy("a").option("path", new_shared_path(spark, "crawl-edges")).saveAsTable(table)
    levels: list[str] = []

    def keep(nodes: DataFrame, depth: int) -> int:
        """Writes a level and tells its size."""
        path, told = new_shared_path(spark, "crawl-level"), Observation()
        nodes.select("node", F.lit(depth).alias("depth")).observe(told, F.count(F.lit(1)).alias("n")).write.parquet(path)
        levels.append(path)
        return told.get["n"]

    def seen() -> DataFrame:
        return spark.read.schema("node long, depth int").parquet(*levels)

    try:
        linked, depth = spark.table(table), 0
        size = keep(starts.select("node").distinct(), 0)
        while size and (max_depth is None or depth < max_depth):
            depth += 1
            frontier = spark.read.schema("node long, depth int").parquet(levels[-1]).select(F.col("node").alias("a"))
            step = linked.join(frontier, "a", "left_semi").select("node").distinct().join(seen().select("node"), "node", "left_anti")
            size = keep(step, depth)
            if len(levels) > LEVELS_APART:
                # All but the last, which is the next frontier.
                path = new_shared_path(spark, "crawl-seen")
                spark.read.schema("node long, depth int").parquet(*levels[:-1]).write.parquet(path)
                levels[:-1] = [path]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    urls = starts.select(*SITE, "url", "node").unionByName(named.select(*SITE, "url", "node")).distinct()
    out = urls.join(seen(), "node").select(*SITE, "url", "depth")
    if max_pages is None:
        return out
    # The page limit of a crawl run: exact, by depth then URL.
    return first_pages(out, max_pages)


def first_pages(nodes: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` nodes of each site in (depth, url) order.

    Nodes are ranked inside (site, depth, start of the path), whose sizes are counted first, so no task sorts a whole
    site whatever the limit is."""
    start = F.substr("url", F.lit(1), F.length("site_id") + PATH_START)
    bucket = F.struct("depth", start)
    return ranked(nodes, SITE, bucket, [F.col("depth"), F.col("url")], "rn").filter(F.col("rn") <= limit).drop("rn")


def nodes_and_edges(snapshots: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes use the requested URL, edges the final one; under redirects the two differ."""
    nodes = snapshots.select(*SITE, "url", "final_url", "depth", "status")
    return nodes, links.filter("internal").select(*SITE, "src", "dst")


def next_frontier(links: DataFrame, nodes: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Discovered, safe and not crawled yet. A crawl run bounds it by four times its page limit."""
    found = (
        links.filter("internal")
        .filter(u.is_safe_crawl_url(F.col("dst"), F.col("site_id")))
        .select(*SITE, F.col("dst").alias("url"))
        .distinct()
        .join(nodes.select(*SITE, "url"), [*SITE, "url"], "left_anti")
    )
    if max_pages is None:
        return found
    return first_pages(found.withColumn("depth", F.lit(0)), 4 * max_pages).drop("depth")


def in_degree(edges: DataFrame) -> DataFrame:
    """Edges are distinct per (page, target) already; counts are partial before the shuffle."""
    return edges.groupBy(*SITE, F.col("dst").alias("final_url")).agg(F.count("*").alias("in_degree"))


def link_opportunities(snapshots: DataFrame, edges: DataFrame) -> DataFrame:
    """Pages with at most one incoming link or none outgoing, with what to do about it."""
    pages = snapshots.select(*SITE, "page_id", "final_url", F.size("internal_links").alias("out_degree"))
    joined = pages.join(in_degree(edges), [*SITE, "final_url"], "left").fillna(0, ["in_degree"])
    return joined.filter((F.col("in_degree") <= 1) | (F.col("out_degree") == 0)).withColumn(
        "advice", F.when(F.col("out_degree") == 0, "add_outgoing").otherwise("add_incoming")
    )


def orphans(nodes: DataFrame, edges: DataFrame, *, every: bool = False, sitemap_urls: DataFrame | None = None) -> DataFrame:
    """Nodes no edge points to. The default leaves seeds (depth 0) out; ``every`` counts pages and sitemap URLs."""
    targets = edges.select(*SITE, F.col("dst").alias("url"))
    base = nodes.select(*SITE, "url", "depth")
    if every:
        base = base.select(*SITE, "url")
        if sitemap_urls is not None:
            base = base.unionByName(sitemap_urls.select(*SITE, F.col("loc").alias("url")))
        return base.distinct().join(targets, [*SITE, "url"], "left_anti")
    return base.filter("depth > 0").join(targets, [*SITE, "url"], "left_anti")


def deep_pages(nodes: DataFrame, at_least: int = 3) -> DataFrame:
    return nodes.filter(F.col("depth") >= at_least)


def hub_summary(snapshots: DataFrame) -> DataFrame:
    return (
        snapshots.groupBy(*SITE)
        .agg(F.count("*").alias("n_pages"), F.count_if(F.size("internal_links") >= 4).alias("n_hubs"))
        .withColumn("missing_hub", (F.col("n_pages") >= 4) & (F.col("n_hubs") == 0))
    )


def uncrawled_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Internal targets that are no node: (site, dst) once each."""
    return (
        edges.select(*SITE, F.col("dst").alias("url"))
        .distinct()
        .join(nodes.select(*SITE, F.col("final_url").alias("url")), [*SITE, "url"], "left_anti")
    )


def long_redirects(snapshots: DataFrame, hops: int = 2) -> DataFrame:
    return snapshots.filter(F.size("redirect_chain") > hops).select(
        *SITE, "page_id", "url", F.size("redirect_chain").alias("n_hops")
    )


def redirect_hygiene(snapshots: DataFrame, loop_at: int = 10) -> DataFrame:
    """Hops into private URLs and chains as long as the redirect limit."""
    private = F.exists("redirect_chain", lambda h: x.is_private_url(h["url"]))
    looped = F.size("redirect_chain") >= loop_at
    return snapshots.select(
        *SITE, "page_id", private.alias("private_hop"), looped.alias("redirect_limit")
    ).filter("private_hop OR redirect_limit")
