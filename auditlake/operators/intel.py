"""What a site is: type, technology, route templates, repository, agent experience."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import urls as u
from auditlake.functions.binding import bind
from auditlake.functions.numeric import clamp, lookup, name_of, rank_case
from auditlake.functions.text import ascii_edges
from auditlake.operators.ranking import top_k

SITE = ["site_id", "run_id"]
# Fixed patterns: the six site types in order of precedence.
SITE_TYPES = [
    ("api", r"openapi|swagger|api reference|developer api|/api\b"),
    ("docs", r"/docs|documentation|guides|get started|reference"),
    ("commerce", r"cart|checkout|product|price|sku|offer|shopify"),
    ("local-business", r"localbusiness|opening hours|address|phone|map"),
    ("publisher", r"article|newsarticle|publisher|rss|atom"),
    ("app", r"login|dashboard|app\."),
]


def page_text(types: Column | None = None) -> Column:
    parts = ["final_url", "body_text"] + ([F.array_join(types, " ")] if types is not None else [])
    return F.lower(F.concat_ws("\n", *parts))


def site_types(pages: DataFrame) -> DataFrame:
    """Site type: per page six flags, OR-ed per site map-side, first true in order. Text never leaves its row."""
    text = page_text(F.col("json_ld_types") if "json_ld_types" in pages.columns else None)
    flagged = pages.select(*SITE, text.alias("t")).select(
        *SITE, *[F.col("t").rlike(ascii_edges(p)).alias(f"is_{i}") for i, (_, p) in enumerate(SITE_TYPES)]
    )
    any_ = flagged.groupBy(*SITE).agg(*[F.bool_or(f"is_{i}").alias(f"is_{i}") for i in range(len(SITE_TYPES))])
    out = F.lit("content")
    for i in range(len(SITE_TYPES) - 1, -1, -1):
        out = F.when(F.col(f"is_{i}"), F.lit(SITE_TYPES[i][0])).otherwise(out)
    return any_.select(*SITE, out.alias("site_type"))


# First framework marker found in headers and text wins.
FRAMEWORK_TEXT = [
    ("nextjs", "/_next/|__next_data__|x-nextjs|next-router-state-tree"),
    ("astro", "astro"),
    ("nuxt", "__nuxt"),
    ("sveltekit", "/_app/immutable|data-sveltekit|sveltekit"),
    ("docusaurus", "docusaurus"),
    ("wordpress", "wp-content"),
    ("shopify", "shopify"),
    ("webflow", "webflow"),
]


def framework_of(text: Column) -> Column:
    def pick(t: Column) -> Column:
        out = F.lit("unknown")
        for name, pattern in reversed(FRAMEWORK_TEXT):
            out = F.when(t.rlike(pattern), F.lit(name)).otherwise(out)
        return out

    return bind(F.lower(text), pick)


def site_framework(pages: DataFrame) -> DataFrame:
    """Framework by the first page of a run; the label is computed per row, so only a word is shuffled."""
    headers = F.array_join(
        F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "\n"
    )
    named = pages.select(*SITE, "ord", framework_of(F.concat(headers, F.lit("\n"), F.col("text"))).alias("framework"))
    return named.groupBy(*SITE).agg(F.min_by("framework", "ord").alias("framework"))


# Technology patterns over lower-cased text: pattern, category, name, confidence.
TECH_PATTERNS = [
    (r"/_next/|__next_data__|x-nextjs|next-router-state-tree", "framework", "nextjs", 93),
    (r"\bnext\.js\b", "framework", "nextjs", 48),
    (r"astro-island|astro\.assets|/_astro/", "framework", "astro", 92),
    (r"/_nuxt/|__nuxt|nuxt", "framework", "nuxt", 90),
    (r"/_app/immutable|data-sveltekit", "framework", "sveltekit", 94),
    (r"sveltekit|svelte-kit", "framework", "sveltekit", 62),
    (r"___gatsby|gatsby", "framework", "gatsby", 90),
    (r"docusaurus", "framework", "docusaurus", 88),
    (r"wp-content|wp-includes|wordpress", "cms", "wordpress", 94),
    (r"shopify|cdn\.shopify", "cms", "shopify", 92),
    (r"webflow|wf-page", "cms", "webflow", 88),
    (r"server:\s*netlify|x-nf-|netlify", "hosting", "netlify", 92),
    (r"x-vercel|server:\s*vercel|vercel", "hosting", "vercel", 92),
    (r"cf-cache-status|server:\s*cloudflare|cloudflare", "cdn", "cloudflare", 90),
    (r"fastly|x-served-by", "cdn", "fastly", 84),
    (r"googletagmanager|gtm\.js", "analytics", "google-tag-manager", 88),
    (r"google-analytics|gtag\(", "analytics", "google-analytics", 86),
    (r"plausible\.io", "analytics", "plausible", 86),
    (r"posthog", "analytics", "posthog", 84),
    (r'/assets/.*\.(js|css)|type="module"|vite', "bundler", "vite", 70),
    (r"/_next/image|\?url=.*image", "image", "next-image", 78),
    (r"server-rendered|__next_data__|window\.__nuxt__", "rendering", "hybrid-rendering", 76),
]
# Substrings one of which every match of the pattern with that number contains.
TECH_LITERALS = [
    ["/_next/", "__next_data__", "x-nextjs", "next-router"], ["next.js"], ["astro"], ["nuxt"], ["/_app/immutable", "data-sveltekit"],
    ["sveltekit", "svelte-kit"], ["gatsby"], ["docusaurus"], ["wp-content", "wp-includes", "wordpress"], ["shopify"],
    ["webflow", "wf-page"], ["netlify", "x-nf-"], ["vercel"], ["cf-cache-status", "cloudflare"], ["fastly", "x-served-by"],
    ["googletagmanager", "gtm.js"], ["google-analytics", "gtag("], ["plausible.io"], ["posthog"], ["/assets/", 'type="module"', "vite"],
    ["/_next/image", "?url="], ["server-rendered", "__next_data__", "window.__nuxt__"],
]
SOURCE_WEIGHT = {"repo": 40, "browser": 28, "asset_path": 18, "headers": 12, "endpoint": 8, "inference": 6, "dns": 5, "html": 0}
STRUCTURAL = ["repo", "asset_path", "headers", "endpoint"]
# What a dependency reveals.
DEPENDENCIES = {
    "next": ("framework", "nextjs", 95),
    "astro": ("framework", "astro", 95),
    "nuxt": ("framework", "nuxt", 95),
    "@sveltejs/kit": ("framework", "sveltekit", 95),
    "@remix-run/react": ("framework", "remix", 90),
    "@docusaurus/core": ("framework", "docusaurus", 95),
    "vite": ("bundler", "vite", 90),
    "@vercel/analytics": ("analytics", "vercel-analytics", 86),
    "@netlify/plugin-nextjs": ("hosting", "netlify", 86),
    "sharp": ("image", "sharp", 82),
    "next-sitemap": ("sitemap", "next-sitemap", 84),
}


def evidence_excerpt(text: Column, pattern: str) -> Column:
    """24 characters before to 96 after the start of the first match, spaces collapsed."""
    before = F.length(F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1))
    start = F.greatest(F.lit(1), before - 23)
    length = F.least(F.lit(24), before) + 96
    return F.regexp_replace(F.substring(text, start, length), r"\s+", " ")


def text_signals(texts: DataFrame) -> DataFrame:
    """Signals of each (site, source, text); the 22 patterns are tried inside the row, hits only are exploded."""
    t = F.col("text")

    def any_of(words: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [t.contains(w) for w in words])

    hits = [
        F.when(
            any_of(words) & t.rlike(ascii_edges(p)),
            F.struct(
                F.lit(cat).alias("category"),
                F.lit(name).alias("name"),
                F.lit(conf).alias("confidence"),
                F.lit(no).alias("no"),
                evidence_excerpt(t, ascii_edges(p)).alias("evidence"),
            ),
        )
        for no, ((p, cat, name, conf), words) in enumerate(zip(TECH_PATTERNS, TECH_LITERALS, strict=True))
    ]
    rows = texts.select(*SITE, "source", "ord", F.lower("text").alias("text"))
    long = rows.select(*SITE, "source", "ord", F.explode(F.array_compact(F.array(*hits))).alias("s"))
    # Texts in their order, patterns in theirs: one number says which signal came first.
    place = (F.col("ord") * 100 + F.col("s.no")).alias("ord")
    return dedupe_signals(long.select(*SITE, "source", place, "s.category", "s.name", "s.confidence", "s.evidence"))


SOURCES = list(SOURCE_WEIGHT)


def dedupe_signals(signals: DataFrame) -> DataFrame:
    """First signal of each (category, name, evidence)."""
    first = lambda c: F.min_by(c, F.col("ord"))
    best = signals.groupBy(*SITE, "category", "name", "evidence").agg(
        first(rank_case(F.col("source"), SOURCES)).alias("k_source"),
        first(F.col("confidence")).alias("confidence"),
        F.min("ord").alias("ord"),
    )
    return best.withColumn("source", name_of(F.col("k_source"), SOURCES)).drop("k_source")


def dependency_signals(dependencies: DataFrame) -> DataFrame:
    table = {d: F.struct(F.lit(c).alias("category"), F.lit(n).alias("name"), F.lit(k).alias("confidence")) for d, (c, n, k) in DEPENDENCIES.items()}
    hit = F.lit(None)
    for dep, value in table.items():
        hit = F.when(F.col("dependency") == dep, value).otherwise(hit)
    rows = dependencies.withColumn("s", hit).filter(F.col("s").isNotNull())
    return rows.select(
        *SITE, "s.category", "s.name", F.concat(F.lit("Dependency: "), "dependency").alias("evidence"),
        F.lit("repo").alias("source"), "s.confidence", F.lit(0).alias("ord"),
    ).distinct()


def signal_scores(signals: DataFrame, category: str = "framework") -> DataFrame:
    rows = signals.filter(F.col("category") == category)
    weight = lookup(F.col("source"), SOURCE_WEIGHT, 0)
    scored = rows.groupBy(*SITE, "name").agg(
        F.max("confidence").alias("max_confidence"),
        F.max(weight).alias("max_weight"),
        F.count_if(F.col("source").isin(STRUCTURAL)).alias("structural"),
        # At most one entry per source kind.
        F.size(F.collect_set("source")).alias("diversity"),
        F.count("*").alias("n_signals"),
    )
    c = F.col
    return scored.withColumn(
        "score",
        c("max_confidence") + c("max_weight") + F.least(F.lit(24), c("structural") * 4) + F.least(F.lit(8), c("diversity") * 2),
    )


def winner(signals: DataFrame, category: str = "framework") -> DataFrame:
    c = F.col
    order = [c("score").desc(), c("max_confidence").desc(), c("n_signals").desc(), c("name")]
    return top_k(signal_scores(signals, category), SITE, order, 1).drop("rank")


def stack_names(signals: DataFrame) -> DataFrame:
    """Names per category and the overall confidence; names come from the fixed tables, so lists stay short."""
    names = signals.groupBy(*SITE, "category").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    overall = signals.groupBy(*SITE).agg(
        clamp(F.floor(F.round(F.avg("confidence"), 6) + 0.5), 0, 99).cast("int").alias("confidence")
    )
    return names.join(overall, SITE)


def route_templates(pages: DataFrame) -> DataFrame:
    """Pages clustered by route pattern, with the first page as representative and distinct shapes counted."""
    c = F.col
    h1 = F.try_element_at(F.filter("headings", lambda h: h["level"] == 1), F.lit(1))["text"]
    rows = pages.select(
        *SITE, "ord", "final_url", u.route_pattern(c("final_url")).alias("url_pattern"),
        u.text_shape(c("title")).alias("title_shape"), u.text_shape(h1).alias("h1_shape"),
    )
    key = [*SITE, "url_pattern"]
    base = rows.groupBy(*key).agg(
        F.count("*").alias("page_count"), F.min_by("final_url", "ord").alias("representative_url")
    )
    shapes = (
        rows.select(*key, F.explode(F.array(F.concat(F.lit("t"), "title_shape"), F.concat(F.lit("h"), "h1_shape"))).alias("s"))
        .distinct()
        .groupBy(*key)
        .agg(F.count_if(c("s").startswith("t")).alias("title_shapes"), F.count_if(c("s").startswith("h")).alias("h1_shapes"))
    )
    return base.join(shapes, key).withColumn("label", u.template_label(c("url_pattern")))


INDEX_FILE = r"(^|/)(index|page)\.[cm]?[jt]sx?$|(^|/)\+page\.svelte$|(^|/)index\.astro$"


GRAM = 3


def template_sources(templates: DataFrame, route_files: DataFrame, k: int = 5) -> DataFrame:
    """Route files whose path contains the first segment of a pattern, best confidence first, else the first files.

    A segment holds no slash, so a path contains it where one of its parts does. Each distinct part of a site keeps its
    best k files: every file of a part that matches a pattern matches it too, so nothing else of the part can be
    among the pattern's best. Segments then meet distinct parts only, by equality on their first characters,
    and a pattern is joined with k files per part at most, however many files share a folder."""
    seg = F.regexp_replace(F.regexp_extract("url_pattern", "^/([^/]*)", 1), "^:", "")
    left = templates.select("site_id", "url_pattern", seg.alias("segment")).distinct()
    files = route_files.select("site_id", "path", "confidence", "ord")
    low = F.lower("path")
    best_first = [F.col("confidence").desc(), F.col("ord")]
    parts = files.select("*", F.explode(F.array_distinct(F.split(low, "/"))).alias("part")).filter("part <> ''")
    tops = top_k(parts, ["site_id", "part"], best_first, k).drop("rank")
    text = F.col("part")
    gram = lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n))
    )
    grams = F.array_distinct(F.flatten(F.array(*[gram(n) for n in range(1, GRAM + 1)])))
    keyed = parts.select("site_id", "part").distinct().select("site_id", "part", F.explode(grams).alias("gram"))
    asked = left.filter("url_pattern <> '/' AND segment <> ''")
    holding = (
        asked.select("site_id", "segment").distinct()
        .withColumn("gram", F.substring("segment", 1, GRAM))
        .join(keyed, ["site_id", "gram"])
        .filter(text.contains(F.col("segment")))
        .select("site_id", "segment", "part")
    )
    by_text = asked.join(holding, ["site_id", "segment"]).join(tops, ["site_id", "part"]).drop("part", "segment").distinct()
    cols = ["site_id", "url_pattern", "path", "confidence", "ord"]
    home = left.filter("url_pattern = '/'").join(files.filter(low.rlike(INDEX_FILE)), "site_id")
    matched = by_text.select(*cols).unionByName(home.select(*cols))
    best = top_k(matched, ["site_id", "url_pattern"], best_first, k)
    bare = left.join(best.select("site_id", "url_pattern").distinct(), ["site_id", "url_pattern"], "left_anti")
    first = top_k(files, ["site_id"], [F.col("ord")], k)
    return best.select("site_id", "url_pattern", "path", "rank").unionByName(
        bare.join(first, "site_id").select("site_id", "url_pattern", "path", "rank")
    )


IGNORED_FILE = r"(?i)\.(pem|key|crt|p12|pfx|sqlite|db)$"


def listed_files(files: DataFrame) -> DataFrame:
    """Repository files without secrets, source maps and local databases."""
    base = F.regexp_extract("path", "[^/]*$", 0)
    return files.filter(~base.startswith(".env") & ~base.endswith(".map") & ~base.rlike(IGNORED_FILE))


# Fixed patterns: kinds of repository files, first match wins: kind, confidence, pattern, part tested.
FILE_KINDS = [
    ("package", 99, r"^package\.json$", "base"),
    ("framework_config", 96, r"^(next|astro|nuxt|svelte|vite|gatsby|docusaurus|remix)\.config\.", "base"),
    ("deployment", 94, r"^(vercel\.json|netlify\.toml|wrangler\.toml|firebase\.json|_headers|_redirects)$", "base"),
    ("static_asset", 78, r"(?i)(\bpublic/|^static/|^assets/).*\.(png|jpe?g|webp|avif|gif|svg|ico)$", "path"),
    ("robots", 97, r"(^|/)(robots\.txt|robots\.[cm]?[jt]s|robots\.ts)$", "lower"),
    ("sitemap", 97, r"(^|/)(sitemap\.xml|sitemap\.[cm]?[jt]s|sitemap\.ts)$", "lower"),
    ("metadata", 88, r"(^|/)(layout|head|metadata|seo|document)\.[cm]?[jt]sx?$", "lower"),
]
LATE_KINDS = [
    ("content", 72, r"(?i)(\bcontent/|\bposts/|\barticles/|\bpages/).*\.(md|mdx|json|ya?ml)$", "path"),
    ("test", 70, r"\.(test|spec)\.[cm]?[jt]sx?$", "lower"),
]
ROUTE_BY_FRAMEWORK = {
    "nextjs": r"(^|/)(app|pages)/.*\.(page\.)?[cm]?[jt]sx?$",
    "sveltekit": r"(^|/)src/routes/.*\+page\.svelte$",
    "nuxt": r"(^|/)pages/.*\.vue$",
    "astro": r"(^|/)src/pages/.*\.(astro|mdx?|[cm]?[jt]sx?)$",
    "remix": r"(^|/)app/routes/.*\.[cm]?[jt]sx?$",
}
ROUTE_ANY = r"(^|/)(pages|routes)/.*\.(astro|vue|svelte|mdx?|[cm]?[jt]sx?)$"


def file_kind(path: Column, frameworks: Column) -> Column:
    """struct<kind,confidence> of a repository file, NULL for files that say nothing."""
    parts = {"base": F.regexp_extract(path, "[^/]*$", 0), "lower": F.lower(path), "path": path}
    route = parts["lower"].rlike(ROUTE_ANY)
    for name, pattern in ROUTE_BY_FRAMEWORK.items():
        route = route | (F.array_contains(frameworks, name) & parts["lower"].rlike(pattern))
    kind = lambda k, conf: F.struct(F.lit(k).alias("kind"), F.lit(conf).alias("confidence"))
    out = F.lit(None)
    for k, conf, pattern, part in reversed(LATE_KINDS):
        out = F.when(parts[part].rlike(ascii_edges(pattern)), kind(k, conf)).otherwise(out)
    out = F.when(route, kind("route", 82)).otherwise(out)
    for k, conf, pattern, part in reversed(FILE_KINDS):
        out = F.when(parts[part].rlike(ascii_edges(pattern)), kind(k, conf)).otherwise(out)
    return out


# Framework of a repository by dependency or config file.
REPO_FRAMEWORKS = {
    "nextjs": (["next"], r"(^|/)next\.config\.[cm]?[jt]s$"),
    "astro": (["astro"], r"(^|/)astro\.config\.[cm]?[jt]s$"),
    "nuxt": (["nuxt", "nuxt3"], r"(^|/)nuxt\.config\.[cm]?[jt]s$"),
    "sveltekit": (["@sveltejs/kit"], r"(^|/)svelte\.config\.[cm]?[jt]s$"),
    "remix": (["@remix-run/node", "@remix-run/react"], r"(^|/)remix\.config\.[cm]?[jt]s$"),
    "docusaurus": (["@docusaurus/core"], r"(^|/)docusaurus\.config\.[cm]?[jt]s$"),
    "vite": (["vite"], r"(^|/)vite\.config\.[cm]?[jt]s$"),
    "gatsby": (["gatsby"], r"(^|/)gatsby-config\.[cm]?[jt]s$"),
    "react": (["react"], r"^$"),
    "vue": (["vue"], r"^$"),
}
# Lock files in order of precedence.
LOCK_FILES = [("pnpm", ["pnpm-lock.yaml"]), ("yarn", ["yarn.lock"]), ("bun", ["bun.lockb", "bun.lock"]), ("npm", ["package-lock.json"])]


def repo_profile(files: DataFrame, dependencies: DataFrame, keys: list[str]) -> DataFrame:
    """Package manager and frameworks per repository from one pass over files and dependencies together."""
    none = F.lit(None).cast("string")
    rows = files.select(*keys, F.col("path"), none.alias("dependency")).unionByName(
        dependencies.select(*keys, none.alias("path"), F.col("dependency"))
    )
    flags = [
        F.bool_or(F.coalesce(F.col("dependency").isin(deps), F.lit(False)) | F.coalesce(F.col("path").rlike(pattern), F.lit(False))).alias(f"fw_{i}")
        for i, (deps, pattern) in enumerate(REPO_FRAMEWORKS.values())
    ]
    locks = [F.bool_or(F.coalesce(F.col("path").isin(names), F.lit(False))).alias(f"pm_{i}") for i, (_, names) in enumerate(LOCK_FILES)]
    wide = rows.groupBy(*keys).agg(*flags, *locks)
    manager = F.lit(None).cast("string")
    for i in range(len(LOCK_FILES) - 1, -1, -1):
        manager = F.when(F.col(f"pm_{i}"), F.lit(LOCK_FILES[i][0])).otherwise(manager)
    names = F.array_compact(F.array(*[F.when(F.col(f"fw_{i}"), F.lit(n)) for i, n in enumerate(REPO_FRAMEWORKS)]))
    return wide.select(*keys, manager.alias("package_manager"), names.alias("frameworks"))


# Fixed values of the agent-experience score.
AGENT_PENALTY = {"critical": 30, "high": 14, "medium": 7, "low": 3, "info": 1}


def agent_experience(sites: DataFrame) -> DataFrame:
    """Ten metrics and the score of a run.

    Needs per site: flags has_llms, has_markdown, has_mcp, has_api_catalog, has_skills, n_sitemap_urls, n_pages,
    avg_words, n_agent_findings, n_critical_agent, agent_penalty."""
    c = F.col
    requests = F.when(c("has_llms") & c("has_markdown"), 2).when(c("has_llms") | c("has_api_catalog"), 3).otherwise(5)
    waste = F.floor(F.greatest(F.lit(0.0), c("avg_words") - 200) * 1.4 + 0.5)
    bonus = lambda flag, points: F.when(c(flag), points).otherwise(0)
    score = (
        F.lit(100) - c("agent_penalty") + bonus("has_llms", 8) + bonus("has_markdown", 6) + bonus("has_mcp", 4)
        + bonus("has_api_catalog", 4) + bonus("has_skills", 4)
    )
    metrics = {
        "canonical_sources": c("n_sitemap_urls") + c("n_pages"),
        "estimated_agent_requests_to_source": requests,
        "estimated_context_waste": waste,
        "llms_txt_available": c("has_llms").cast("int"),
        "markdown_available": c("has_markdown").cast("int"),
        "mcp_discovery_available": c("has_mcp").cast("int"),
        "api_catalog_available": c("has_api_catalog").cast("int"),
        "agent_skills_available": c("has_skills").cast("int"),
        "agent_readiness_findings": c("n_agent_findings"),
        "critical_agent_readiness_findings": c("n_critical_agent"),
    }
    return sites.select(
        *SITE,
        *[v.cast("long").alias(n) for n, v in metrics.items()],
        clamp(score, 0, 100).cast("int").alias("score"),
    )
