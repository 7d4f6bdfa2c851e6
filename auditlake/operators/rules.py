"""Rule evaluation: page, group and site rules as predicates that emit finding rows.

Page rules are one projection over the snapshot: every rule adds a struct when its predicate holds, and the array
of structs is exploded once. Site rules do the same on a frame with one row per site. Rules over groups of pages
count by a hashed key, and their member URLs stay in a long child table, so one giant group never becomes one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import dims
from auditlake.functions import privacy as x
from auditlake.functions import urls as u
from auditlake.functions.markup import js_trim
from auditlake.functions.json_walk import json_keys, risky_tool_names
from auditlake.functions.numeric import lookup
from auditlake.functions.text import ascii_edges
from auditlake.operators.pages import first_heading_jump, with_json_ld_types

SITE = ["site_id", "run_id"]


def _emit(rule_id: str, when: Column, *, severity: Column | None = None, suffix: Column | None = None, refs: Column | None = None, repeat: Column | None = None) -> Column:
    """array of zero or more structs of one rule."""
    rule = dims.RULE[rule_id]
    title = F.lit(rule["title"]) if suffix is None else F.concat(F.lit(rule["title"] + " "), suffix.cast("string"))
    one = F.struct(
        F.lit(rule_id).alias("rule_id"),
        title.alias("title"),
        (F.lit(rule["severity"]) if severity is None else severity).alias("severity"),
        (F.array().cast("array<string>") if refs is None else refs).alias("refs"),
    )
    times = F.lit(1) if repeat is None else repeat
    return F.when(F.coalesce(when, F.lit(False)), F.array_repeat(one, times)).otherwise(
        F.array_repeat(one, F.lit(0))
    )


def _types_lack(name: str) -> Column:
    return ~F.array_contains("json_ld_types", name)


def _lacks_nap() -> Column:
    text = F.lower("body_text")
    address = text.rlike(r"street|st\.|road|avenue|suite|address")
    digits = F.length(F.regexp_replace("body_text", "[^0-9]", ""))
    return ~address | (digits < 7)


def page_rule_structs() -> list[Column]:
    """One array column per page rule. Needs the snapshot columns plus site_type, json_ld_types and json_ld_keys."""
    c = F.col
    h1 = F.size(F.filter("headings", lambda h: h["level"] == 1))
    internal = F.size("internal_links")
    status_bad = (c("status") < 200) | (c("status") >= 400)
    local, shop = c("site_type") == "local-business", c("site_type") == "commerce"
    has_key = lambda *names: F.arrays_overlap("json_ld_keys", F.array(*[F.lit(n) for n in names]))
    return [
        _emit("SEO-TECH-002", F.size("redirect_chain") > 2),
        _emit(
            "SEO-TECH-001",
            status_bad,
            severity=F.when(c("status") >= 500, "critical").otherwise("high"),
            suffix=c("status"),
        ),
        _emit(
            "SEO-PERF-010",
            (F.coalesce(F.try_element_at("headers", F.lit("cache-control")), F.lit("")) == "")
            & (F.coalesce(F.try_element_at("headers", F.lit("expires")), F.lit("")) == ""),
        ),
        _emit(
            "SEO-PERF-011",
            (F.coalesce(F.try_element_at("headers", F.lit("content-encoding")), F.lit("")) == "")
            & c("content_type").contains("text/html")
            & (F.length("body_text") > 500),
        ),
        _emit("SEO-INDEX-001", c("robots_meta").rlike("(?i)noindex")),
        _emit("SEO-INDEX-003", c("canonical").isNull()),
        _emit("SEO-INDEX-004", u.canonical_form(c("canonical")) != u.canonical_form(c("final_url"))),
        _emit("SEO-ONPAGE-001", c("title").isNull()),
        _emit("SEO-ONPAGE-003", F.length("title") < 15),
        _emit("SEO-ONPAGE-004", F.length("title") > 70),
        _emit("SEO-ONPAGE-005", c("meta_description").isNull()),
        _emit("SEO-ONPAGE-007", h1 == 0),
        _emit("SEO-ONPAGE-008", h1 > 1),
        _emit("SEO-ONPAGE-009", first_heading_jump(c("headings")).isNotNull()),
        _emit("SEO-ONPAGE-010", c("lang").isNull()),
        _emit("SEO-ONPAGE-011", c("viewport").isNull()),
        _emit("SEO-ONPAGE-014", F.size("open_graph") == 0),
        _emit("SEO-ONPAGE-015", F.size("twitter_cards") == 0),
        _emit("SEO-CONTENT-001", (c("word_count") > 0) & (c("word_count") < 150)),
        _emit(
            "SEO-SCHEMA-001",
            F.exists("json_ld", lambda b: b["parse_error"]),
            repeat=F.size(F.filter("json_ld", lambda b: b["parse_error"])),
        ),
        _emit("SEO-SCHEMA-003", _types_lack("Organization")),
        _emit("SEO-SCHEMA-004", _types_lack("WebSite")),
        _emit("SEO-SCHEMA-006", (internal > 2) & _types_lack("BreadcrumbList")),
        _emit("SEO-JS-001", (c("word_count") < 30) & (internal == 0)),
        _emit("SEO-LINK-003", (c("word_count") >= 30) & (internal == 0)),
        _emit("SEO-MEDIA-001", F.exists("images", lambda i: F.coalesce(js_trim(i["alt"]), F.lit("")) == "")),
        _emit("SEO-MEDIA-005", F.exists("images", lambda i: ~i["has_width"] | ~i["has_height"])),
        _emit("SEO-A11Y-010", ~c("has_skip_link") & (F.size("headings") > 2)),
        _emit(
            "SEO-INTL-005",
            (F.size("hreflang") > 0) & ~F.exists("hreflang", lambda h: h["language"] == "x-default"),
        ),
        _emit("SEO-LOCAL-001", local & _lacks_nap()),
        _emit("SEO-LOCAL-003", local & _types_lack("LocalBusiness")),
        _emit(
            "SEO-LOCAL-004",
            local
            & ~has_key("openingHours", "openingHoursSpecification")
            & ~c("body_text").rlike(
                ascii_edges(r"(?i)\b(?:open|hours|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b")
            ),
        ),
        _emit("SEO-ECOM-001", shop & _types_lack("Product")),
        _emit("SEO-ECOM-002", shop & _types_lack("Offer")),
        _emit(
            "SEO-ECOM-013",
            shop
            & _types_lack("MerchantReturnPolicy")
            & ~has_key("hasMerchantReturnPolicy", "merchantReturnPolicy")
            & ~c("body_text").rlike(ascii_edges(r"(?i)\breturn(?:s| policy)?\b")),
        ),
    ]


def prepare_pages(snapshots: DataFrame, site_types: DataFrame | None = None) -> DataFrame:
    """Adds what the page rules read besides the snapshot: JSON-LD types, JSON-LD keys and the site type."""
    valid = F.transform(F.filter("json_ld", lambda b: ~b["parse_error"]), lambda b: b["raw"])
    as_array = F.concat(F.lit("["), F.array_join(valid, ","), F.lit("]"))
    out = snapshots if "json_ld_types" in snapshots.columns else with_json_ld_types(snapshots)
    empty = F.array().cast("array<string>")
    out = out.withColumn(
        "json_ld_keys",
        F.when(F.size("json_ld") > 0, F.coalesce(json_keys(F.when(F.size("json_ld") > 0, as_array)), empty)).otherwise(
            empty
        ),
    )
    if site_types is not None:
        # One small row per site against all pages of the site: broadcast when small, else AQE splits the hot site.
        out = out.join(site_types.select(*SITE, "site_type"), SITE, "left")
    elif "site_type" not in out.columns:
        out = out.withColumn("site_type", F.lit("content"))
    return out


def page_rule_findings(prepared: DataFrame) -> DataFrame:
    """Long findings of all page and block rules; one scan of the snapshot, one explode."""
    rows = prepared.select(
        *SITE,
        "page_id",
        F.col("final_url").alias("affected_url"),
        F.posexplode(F.flatten(F.array(*page_rule_structs()))).alias("emit_ord", "f"),
    )
    return rows.select(*SITE, "page_id", "affected_url", "emit_ord", "f.rule_id", "f.title", "f.severity", "f.refs")


def page_rule_counts(prepared: DataFrame) -> DataFrame:
    """Findings per site and page rule; counted map-side before the shuffle."""
    long = page_rule_findings(prepared)
    return long.groupBy(*SITE, "rule_id").agg(F.count("*").alias("n_findings"))


DUPLICATE_KEYS = {
    "SEO-ONPAGE-002": lambda: F.lower(js_trim(F.col("title"))),
    "SEO-ONPAGE-006": lambda: F.lower(js_trim(F.col("meta_description"))),
    "SEO-CONTENT-002": lambda: F.when(
        F.col("word_count") >= 80, F.lower(js_trim(F.col("body_text")))
    ),
}


def duplicate_keys(snapshots: DataFrame) -> DataFrame:
    """(page, rule, key hash) rows for the three duplicate rules in one pass; only the hash is shuffled later."""
    structs = [
        F.struct(F.lit(rule).alias("rule_id"), F.nullif(key(), F.lit("")).alias("key"))
        for rule, key in DUPLICATE_KEYS.items()
    ]
    rows = snapshots.select(*SITE, "page_id", "ord", "final_url", F.explode(F.array(*structs)).alias("k"))
    return rows.filter(F.col("k.key").isNotNull()).select(
        *SITE, "page_id", "ord", "final_url", "k.rule_id", F.sha2(F.col("k.key"), 256).alias("key_hash")
    )


def duplicate_groups(keys: DataFrame) -> DataFrame:
    """One row per group of two or more pages: size and position of the first member.

    Counts are combined before the shuffle; the first page's URL comes from :func:`group_representatives`."""
    return (
        keys.groupBy(*SITE, "rule_id", "key_hash")
        .agg(F.count("*").alias("n_pages"), F.min("ord").alias("first_ord"))
        .filter("n_pages > 1")
    )


def group_representatives(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups with the URL of their first member."""
    heads = keys.select(*SITE, "rule_id", "key_hash", F.col("ord").alias("first_ord"), F.col("final_url").alias("first_url"))
    return groups.join(heads, [*SITE, "rule_id", "key_hash", "first_ord"])


def duplicate_members(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """Member URLs of each group as rows. The groups side is small per key, so a hot key only splits the pages side."""
    return keys.join(groups.select(*SITE, "rule_id", "key_hash"), [*SITE, "rule_id", "key_hash"]).select(
        *SITE, "rule_id", "key_hash", "ord", F.col("final_url").alias("affected_url")
    )


def group_rule_findings(groups: DataFrame) -> DataFrame:
    title = lookup(F.col("rule_id"), {r: dims.RULE[r]["title"] for r in DUPLICATE_KEYS})
    severity = lookup(F.col("rule_id"), {r: dims.RULE[r]["severity"] for r in DUPLICATE_KEYS})
    return groups.select(
        *SITE, "rule_id", title.alias("title"), severity.alias("severity"), "key_hash", F.col("n_pages").alias("n_urls")
    )


def page_rollup(snapshots: DataFrame) -> DataFrame:
    """The page facts that site rules need, one row per site."""
    return snapshots.groupBy(*SITE).agg(
        F.count("*").alias("n_pages"),
        F.count_if(F.size("internal_links") >= 4).alias("n_hubs"),
        F.count_if(F.size("hreflang") > 0).alias("n_hreflang"),
        F.count_if(F.size("hreflang") == 0).alias("n_no_hreflang"),
    )


def missing_from_sitemap(snapshots: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """Successful pages whose canonical form is in no sitemap of the site, for sites with a non-empty sitemap."""
    listed = sitemap_urls.select(*SITE, u.canonical_form(F.col("loc")).alias("form")).distinct()
    has_map = sitemap_urls.select(*SITE).distinct()
    ok = snapshots.filter((F.col("status") >= 200) & (F.col("status") < 300)).select(
        *SITE, "page_id", "final_url", u.canonical_form(F.col("final_url")).alias("form")
    )
    return (
        ok.join(listed, [*SITE, "form"], "left_anti")
        .join(has_map, SITE, "left_semi")
        .select(*SITE, "page_id", F.col("final_url").alias("affected_url"))
    )


def missing_hreflang(snapshots: DataFrame) -> DataFrame:
    """Pages without alternates on sites where some page has them."""
    sites = snapshots.filter(F.size("hreflang") > 0).select(*SITE).distinct()
    return (
        snapshots.filter(F.size("hreflang") == 0)
        .join(sites, SITE, "left_semi")
        .select(*SITE, "page_id", F.col("final_url").alias("affected_url"))
    )


JSON_DOCUMENTS = ["/.well-known/agent-skills/index.json", "/.well-known/mcp.json", "/.well-known/api-catalog"]


def judged_endpoints(endpoints: DataFrame) -> DataFrame:
    """What site rules ask of each probe, judged in the probe's own row: bodies never leave it."""
    c = F.col
    body = F.coalesce("body", F.lit(""))
    at = lambda *paths: c("path").isin(*paths)
    asks = lambda path, pattern: F.when(at(path), body.rlike(pattern))
    mcp = F.when(at(JSON_DOCUMENTS[1]) & c("ok") & F.trim("body").startswith("{"), c("body"))
    return endpoints.select(
        *SITE, "path", F.coalesce("ok", F.lit(False)).alias("ok"), "status", "content_type", "url",
        asks("/robots.txt", r"(?im)disallow:\s*/\s*$").alias("blocks_all"),
        asks("/robots.txt", r"(?im)^\s*sitemap:").alias("names_map"),
        asks("/robots.txt", AI_SIGNAL).alias("signals_ai"),
        asks("/robots.txt", PRIVATE_DISALLOW).alias("hides_private"),
        F.when(at(*JSON_DOCUMENTS), F.try_parse_json(body).isNull()).alias("bad_json"),
        F.when(at("/sitemap.xml", "/sitemap_index.xml", "/llms.txt"), x.private_references(body)).alias("private_refs"),
        risky_tool_names(mcp).alias("risky_tools"),
    )


def endpoint_wide(endpoints: DataFrame) -> DataFrame:
    """One row per site with a struct of judgements per probed path. A site has at most one row per path, 23 in all."""
    paths = [dims.MARKDOWN_PROBE, *dims.ENDPOINT_PATHS]
    judged = judged_endpoints(endpoints)
    found = F.struct(*[n for n in judged.columns if n not in (*SITE, "path")])
    return judged.groupBy(*SITE).agg(*[F.max(F.when(F.col("path") == p, found)).alias(f"p_{i}") for i, p in enumerate(paths)])


def probe(path: str) -> str:
    return f"p_{[dims.MARKDOWN_PROBE, *dims.ENDPOINT_PATHS].index(path)}"


PRIVATE_DISALLOW = (
    r"(?im)^[ \t\r\x0b\f]*disallow:[^\n]*(?:/admin|/account|/login|/logout|/checkout|/cart|/payment|/private"
    r"|/preview|/api/internal)"
)
AI_SIGNAL = "(?i)content-signal|ai-input|ai-train|gptbot|google-extended|ccbot"


def site_rule_structs() -> list[Column]:
    c = F.col
    ok = lambda path: F.coalesce(c(probe(path))["ok"], F.lit(False))
    kind = lambda path: c(probe(path))["content_type"]
    robots = c(probe("/robots.txt"))
    sitemap_path_ok = ok("/sitemap.xml") | ok("/sitemap_index.xml")
    api_like = c("site_type").isin("api", "app")
    bad_json = lambda path: c(probe(path))["bad_json"]
    mcp = JSON_DOCUMENTS[1]
    out = [
        _emit("SEO-CRAWL-001", ~ok("/robots.txt")),
        _emit("SEO-CRAWL-003", ok("/robots.txt") & robots["blocks_all"]),
        _emit("SEO-SITEMAP-001", ~sitemap_path_ok),
        _emit("SEO-SITEMAP-002", sitemap_path_ok & (c("n_sitemap_urls") == 0)),
        _emit(
            "SEO-SITEMAP-008",
            sitemap_path_ok & ((F.size("sitemap_private") > 0) | (c("n_private_sitemap_urls") > 0)),
            refs=c("sitemap_private"),
        ),
        _emit("SEO-CRAWL-004", ok("/robots.txt") & ~robots["names_map"]),
        _emit("AR-ROBOTS-004", ok("/robots.txt") & ~robots["signals_ai"]),
        _emit("AR-ROBOTS-006", ok("/robots.txt") & ~robots["hides_private"]),
        _emit("SEO-INTL-001", (c("n_hreflang") > 0) & (c("n_no_hreflang") > 0)),
        _emit("SEO-SITEMAP-011", (c("n_sitemap_urls") > 0) & (c("n_missing_from_sitemap") > 0)),
        _emit("SEO-LINK-009", (c("n_pages") >= 4) & (c("n_hubs") == 0)),
        _emit(
            "AR-LLMS-001",
            ~ok("/llms.txt"),
            severity=F.when(c("site_type").isin("docs", "api"), "high").otherwise("medium"),
        ),
        _emit(
            "AR-LLMS-003",
            ok("/llms.txt")
            & (kind("/llms.txt") != "")
            & ~kind("/llms.txt").rlike("(?i)text/plain|text/markdown|text/x-markdown"),
        ),
        _emit("AR-LLMS-008", ok("/llms.txt") & (F.size("llms_private") > 0), refs=c("llms_private")),
        _emit(
            "AR-MD-001", ~F.coalesce(kind(dims.MARKDOWN_PROBE).rlike("(?i)markdown|text/plain"), F.lit(False))
        ),
    ]
    for path, missing, invalid in (
        ("/.well-known/agent-skills/index.json", "AR-SKILL-001", "AR-SKILL-002"),
        (mcp, "AR-MCP-001", "AR-MCP-002"),
        ("/.well-known/api-catalog", "AR-API-001", "AR-API-002"),
    ):
        out += [_emit(missing, ~ok(path)), _emit(invalid, ok(path) & bad_json(path))]
    out += [
        _emit("AR-MCP-005", F.size("risky_tools") > 0, refs=c("risky_tools")),
        _emit("AR-API-003", api_like & ~ok("/openapi.json") & ~ok("/swagger.json")),
        _emit("AR-AUTH-001", api_like & ~ok("/auth.md")),
        _emit("AR-AUTH-002", api_like & ~ok("/.well-known/oauth-authorization-server")),
        _emit("AR-AUTH-003", api_like & ~ok("/.well-known/oauth-protected-resource")),
    ]
    perf = [
        ("SEO-PERF-001", "lcp-ms"),
        ("SEO-PERF-024", "document-fetch-ms"),
        ("SEO-PERF-020", "total-js-kb"),
        ("SEO-PERF-021", "third-party-js-kb"),
        ("SEO-PERF-022", "render-blocking-requests"),
        ("SEO-PERF-023", "total-requests"),
    ]
    out += [_emit(rule, F.array_contains("failed_metrics", metric)) for rule, metric in perf]
    out += [_emit(r, c("search_integrations")) for r in ("SEO-SEARCH-001", "SEO-SEARCH-002")]
    return out


def site_rule_findings(
    sites: DataFrame,
    endpoints: DataFrame,
    sitemap_counts: DataFrame,
    page_facts: DataFrame,
    site_types: DataFrame,
    missing_counts: DataFrame | None = None,
    failed_metrics: DataFrame | None = None,
    *,
    search_integrations: bool | DataFrame = False,
) -> DataFrame:
    """Site grain findings. All inputs are one row per site (endpoints: one per path), joined on the site key.

    ``search_integrations`` says whether search data was asked for and not imported: for all runs, or as a table
    (site_id, run_id, search_integrations)."""
    none = F.array().cast("array<string>")
    wide = sites.select(*SITE).join(endpoint_wide(endpoints), SITE, "left").join(sitemap_counts, SITE, "left")
    wide = wide.join(page_facts, SITE, "left").join(site_types.select(*SITE, "site_type"), SITE, "left")
    wide = (
        wide.join(missing_counts, SITE, "left")
        if missing_counts is not None
        else wide.withColumn("n_missing_from_sitemap", F.lit(0))
    )
    wide = (
        wide.join(failed_metrics, SITE, "left")
        if failed_metrics is not None
        else wide.withColumn("failed_metrics", none)
    )
    if isinstance(search_integrations, DataFrame):
        wide = wide.join(search_integrations.select(*SITE, F.coalesce("search_integrations", F.lit(False)).alias("search_integrations")), SITE, "left").fillna(False, ["search_integrations"])
    else:
        wide = wide.withColumn("search_integrations", F.lit(search_integrations))
    answered = [F.when(F.col(probe(p))["ok"], F.col(probe(p))["private_refs"]) for p in ("/sitemap.xml", "/sitemap_index.xml")]
    judged = wide.select(
        "*",
        F.coalesce(*answered, none).alias("sitemap_private"),
        F.coalesce(F.col(probe("/llms.txt"))["private_refs"], none).alias("llms_private"),
        F.coalesce(F.col(probe(JSON_DOCUMENTS[1]))["risky_tools"], none).alias("risky_tools"),
    ).fillna(0, ["n_sitemap_urls", "n_private_sitemap_urls", "n_pages", "n_hubs", "n_hreflang", "n_no_hreflang", "n_missing_from_sitemap"])
    rows = judged.select(*SITE, F.posexplode(F.flatten(F.array(*site_rule_structs()))).alias("emit_ord", "f"))
    return rows.select(*SITE, "emit_ord", "f.rule_id", "f.title", "f.severity", "f.refs")


def with_catalogue(findings: DataFrame) -> DataFrame:
    """Adds category, confidence, fix class and advice; constants, so a CASE over the rule id."""
    rid = F.col("rule_id")
    pick = lambda field: lookup(rid, {r["rule_id"]: r[field] for r in dims.EMITTED})
    declared = lookup(rid, {r["rule_id"]: dims.FIX_CLASSES[r["fix"]] for r in dims.EMITTED})
    out = findings.select(
        "*",
        pick("category").alias("category"),
        pick("confidence").alias("confidence"),
        pick("recommendation").alias("recommendation"),
        declared.alias("declared_fix_class"),
    )
    return enforce_approval(out)


def enforce_approval(findings: DataFrame) -> DataFrame:
    """A term that needs an owner in title or advice forces approval and clears the safe flag."""
    hit = x.needs_approval(F.concat_ws("\n", "title", "recommendation"))
    fix = F.when(hit, F.lit("approval_required")).otherwise(F.col("declared_fix_class"))
    return findings.withColumns(
        {
            "fix_class": fix,
            "approval_required": fix == "approval_required",
            "safe_to_auto_fix": fix == "safe_auto_fix",
            "effort": F.when(F.col("declared_fix_class") == "safe_auto_fix", "small").otherwise("medium"),
            "risk": lookup(
                F.col("declared_fix_class"),
                {"approval_required": "high", "safe_auto_fix": "low", "manual_strategy": "medium"},
            ),
            "owner": lookup(F.col("category"), dims.OWNERS, "unknown"),
            "status": F.lit("open"),
        }
    )


def maturity(rule_id: Column) -> Column:
    return (
        F.when(rule_id.rlike("^(AR-(LLMS|MD|SKILL|MCP|API)|SEO-SEARCH)-"), "experimental")
        .when(rule_id.startswith("AR-"), "emerging")
        .otherwise("stable")
    )


def coverage_ledger(runs: DataFrame, counts: DataFrame, *, strict_coverage: bool = False) -> DataFrame:
    """One row per rule and run: passed, failed, not_applicable or not_measured.

    ``runs``: site_id, run_id, site_type, lcp_measured and the include flags. The catalogue side is a fixed
    list of rules exploded from a literal, so there is no cross join. ``counts``: one row per run and rule with n_findings; those
    of the catalogue's rules meet the run as one short map, so the ledger's rows themselves are not exchanged."""
    cat = F.array(
        *[
            F.struct(F.lit(r["rule_id"]).alias("rule_id"), F.lit(r["category"]).alias("category"), F.lit(r["fix"] != "-").alias("has_evaluator"))
            for r in dims.RULES
        ]
    )
    c = F.col
    per_rule = F.map_from_entries(F.collect_list(F.struct("rule_id", "n_findings")))
    of_run = counts.filter(c("rule_id").isin([r["rule_id"] for r in dims.RULES])).groupBy(*SITE).agg(per_rule.alias("_counts"))
    ledger = runs.join(of_run, SITE, "left").select("*", F.explode(cat).alias("r")).select(*runs.columns, "_counts", "r.rule_id", "r.category", "r.has_evaluator")
    applicable = (
        F.when(c("rule_id").startswith("AR-") & ~c("include_agent"), False)
        .when(c("rule_id").startswith("SEO-SEARCH-") & ~c("include_search"), False)
        .when((c("category") == "accessibility") & ~c("include_accessibility"), False)
        .when((c("category") == "international_seo") & ~c("include_international"), False)
        .when(c("category") == "local_seo", c("include_local") & c("site_type").isin("local-business", "mixed"))
        .when(
            c("category") == "ecommerce_seo",
            c("include_commerce") & c("site_type").isin("commerce", "marketplace", "mixed"),
        )
        .when((c("rule_id") == "SEO-PERF-001") & ~c("include_vitals"), False)
        .otherwise(True)
    )
    measured = ~((c("rule_id") == "SEO-PERF-001") & ~c("lcp_measured"))
    if strict_coverage:
        measured = measured & c("has_evaluator")
    found = F.coalesce(F.try_element_at("_counts", c("rule_id")), F.lit(0))
    return ledger.withColumn("applicable", applicable).select(
        *SITE,
        "rule_id",
        "category",
        maturity(c("rule_id")).alias("maturity"),
        F.when(~c("applicable"), "not_applicable")
        .when(~measured, "not_measured")
        .when(found > 0, "failed")
        .otherwise("passed")
        .alias("status"),
        "applicable",
        (c("applicable") & measured).alias("measured"),
        F.when(c("applicable") & measured, found).otherwise(F.lit(0)).cast("long").alias("finding_count"),
    )


def catalogue_integrity(rules: DataFrame, mapping: DataFrame, standards: DataFrame) -> DataFrame:
    """Referential checks between catalogue, rule mapping and standards, one row per breach."""
    ids = rules.select("rule_id", "standard")
    checks = [
        ("duplicate-rule", ids.groupBy("rule_id").count().filter("count > 1").select("rule_id")),
        ("duplicate-mapping", mapping.groupBy("rule_id").count().filter("count > 1").select("rule_id")),
        ("duplicate-standard", standards.groupBy("standard").count().filter("count > 1").select(F.col("standard").alias("rule_id"))),
        ("unmapped-rule", ids.join(mapping, "rule_id", "left_anti").select("rule_id")),
        ("unknown-rule", mapping.join(ids, "rule_id", "left_anti").select("rule_id")),
        ("unknown-standard", mapping.join(standards, "standard", "left_anti").select("rule_id")),
        (
            "standard-mismatch",
            mapping.alias("m").join(ids.alias("r"), "rule_id").filter("m.standard <> r.standard").select("rule_id"),
        ),
    ]
    out = None
    for name, df in checks:
        rows = df.select(F.lit(name).alias("check_id"), "rule_id")
        out = rows if out is None else out.unionByName(rows)
    return out
