"""Fixed dimensions: rule catalogue, severities, score areas and profiles, budgets, owners.

All are small constants, so they are used as literals inside column expressions or as local relations that are
bounded by their number of lines here.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# The rule catalogue. Columns:
# id, slug, category, default severity, standard, confidence, fix class (A approval, S safe, M manual), title
RULE_ROWS = [
    ("SEO-TECH-001", "invalid-http-status", "technical_seo", "critical", "http-status", 99, "M", "Page returned HTTP"),
    ("SEO-TECH-002", "redirect-chain-too-long", "technical_seo", "medium", "redirects", 99, "M", "Redirect chain is too long"),
    ("SEO-TECH-011", "missing-compression", "technical_seo", "low", "http-headers", 0, "-", ""),
    ("SEO-TECH-012", "poor-cacheability", "technical_seo", "low", "http-headers", 0, "-", ""),
    ("SEO-CRAWL-001", "robots-missing", "crawlability", "low", "robots-txt", 99, "S", "robots.txt is missing or unreachable"),
    ("SEO-CRAWL-003", "important-page-blocked", "crawlability", "critical", "robots-txt", 98, "A", "robots.txt blocks the whole public site"),
    ("SEO-CRAWL-004", "sitemap-not-linked-in-robots", "crawlability", "medium", "robots-txt", 95, "S", "robots.txt does not link the sitemap"),
    ("SEO-SITEMAP-001", "sitemap-missing", "crawlability", "medium", "sitemap", 96, "S", "sitemap.xml is missing or unreachable"),
    ("SEO-SITEMAP-002", "sitemap-invalid-xml", "crawlability", "high", "sitemap", 90, "M", "sitemap.xml does not expose canonical URLs"),
    ("SEO-SITEMAP-008", "sitemap-contains-private-url", "security", "critical", "sitemap", 99, "M", "sitemap.xml exposes private URLs"),
    ("SEO-SITEMAP-011", "important-page-missing-from-sitemap", "crawlability", "medium", "sitemap", 84, "M", "Crawled public pages are missing from sitemap.xml"),
    ("SEO-INDEX-001", "accidental-noindex", "indexability", "high", "robots-meta", 98, "A", "Important page is marked noindex"),
    ("SEO-INDEX-003", "canonical-missing", "indexability", "medium", "canonicalization", 92, "S", "Canonical URL is missing"),
    ("SEO-INDEX-004", "canonical-non-self-reference", "indexability", "medium", "canonicalization", 88, "A", "Canonical URL is not self-referencing"),
    ("SEO-ONPAGE-001", "title-missing", "onpage_seo", "high", "html-title", 99, "M", "Title tag is missing"),
    ("SEO-ONPAGE-002", "title-duplicate", "onpage_seo", "medium", "html-title", 88, "M", "Duplicate title tags found"),
    ("SEO-ONPAGE-003", "title-too-short", "onpage_seo", "low", "html-title", 85, "M", "Title tag is very short"),
    ("SEO-ONPAGE-004", "title-too-long", "onpage_seo", "low", "html-title", 85, "M", "Title tag is likely too long"),
    ("SEO-ONPAGE-005", "meta-description-missing", "onpage_seo", "medium", "meta-description", 96, "M", "Meta description is missing"),
    ("SEO-ONPAGE-006", "meta-description-duplicate", "onpage_seo", "medium", "meta-description", 84, "M", "Duplicate meta descriptions found"),
    ("SEO-ONPAGE-007", "h1-missing", "onpage_seo", "medium", "headings", 96, "M", "H1 heading is missing"),
    ("SEO-ONPAGE-008", "multiple-conflicting-h1", "onpage_seo", "medium", "headings", 90, "M", "Multiple H1 headings were found"),
    ("SEO-ONPAGE-009", "heading-hierarchy-broken", "onpage_seo", "low", "headings", 80, "M", "Heading hierarchy jumps levels"),
    ("SEO-ONPAGE-010", "missing-html-lang", "onpage_seo", "low", "html-lang", 96, "S", "HTML lang attribute is missing"),
    ("SEO-ONPAGE-011", "missing-viewport", "onpage_seo", "medium", "viewport", 96, "S", "Viewport meta tag is missing"),
    ("SEO-ONPAGE-014", "missing-open-graph", "onpage_seo", "low", "open-graph", 88, "S", "Open Graph metadata is missing"),
    ("SEO-ONPAGE-015", "missing-twitter-card", "onpage_seo", "low", "twitter-card", 88, "S", "Twitter/X Card metadata is missing"),
    ("SEO-CONTENT-001", "thin-content", "content_seo", "medium", "content-quality", 82, "M", "Page has thin visible content"),
    ("SEO-CONTENT-002", "duplicate-content", "content_seo", "medium", "content-quality", 78, "A", "Duplicate visible content found across pages"),
    ("SEO-LINK-003", "weak-internal-linking", "internal_linking", "medium", "internal-links", 76, "M", "Page has weak internal linking"),
    ("SEO-LINK-009", "missing-hub-page", "internal_linking", "low", "internal-links", 68, "M", "No clear internal hub page was detected"),
    ("SEO-SCHEMA-001", "jsonld-invalid", "structured_data", "high", "json-ld", 99, "S", "JSON-LD is invalid"),
    ("SEO-SCHEMA-003", "organization-missing", "structured_data", "low", "schema-org", 75, "A", "Organization structured data is missing"),
    ("SEO-SCHEMA-004", "website-schema-missing", "structured_data", "low", "schema-org", 75, "A", "WebSite structured data is missing"),
    ("SEO-SCHEMA-006", "breadcrumb-schema-missing", "structured_data", "low", "schema-org", 72, "S", "Breadcrumb structured data is missing"),
    ("SEO-JS-001", "important-content-only-rendered", "javascript_seo", "medium", "javascript-seo", 70, "M", "Important content may depend on client-side rendering"),
    ("SEO-MEDIA-001", "missing-alt-text", "media_seo", "medium", "image-alt", 96, "M", "Images are missing alt text"),
    ("SEO-MEDIA-005", "missing-width-height", "media_seo", "low", "image-dimensions", 90, "M", "Images are missing width or height attributes"),
    ("SEO-PERF-010", "missing-cache-headers", "performance_seo", "low", "http-headers", 78, "M", "HTML response is missing cache headers"),
    ("SEO-PERF-011", "missing-compression", "performance_seo", "low", "http-headers", 70, "M", "Compressible HTML response has no compression header"),
    ("SEO-PERF-020", "javascript-budget-exceeded", "performance_seo", "medium", "performance-budgets", 74, "M", "JavaScript transfer exceeds the configured budget"),
    ("SEO-PERF-021", "third-party-javascript-budget-exceeded", "performance_seo", "medium", "performance-budgets", 72, "M", "Third-party JavaScript transfer exceeds the configured budget"),
    ("SEO-PERF-022", "render-blocking-request-budget-exceeded", "performance_seo", "low", "performance-budgets", 70, "M", "Render-blocking request pressure exceeds the configured budget"),
    ("SEO-PERF-023", "request-budget-exceeded", "performance_seo", "low", "performance-budgets", 68, "M", "Request count exceeds the configured budget"),
    ("SEO-PERF-024", "document-fetch-budget-exceeded", "performance_seo", "medium", "performance-budgets", 78, "M", "Document fetch duration exceeds the configured budget"),
    ("SEO-A11Y-002", "heading-order-invalid", "accessibility", "low", "wcag-headings", 0, "-", ""),
    ("SEO-A11Y-006", "image-alt-missing", "accessibility", "medium", "wcag-images", 0, "-", ""),
    ("SEO-A11Y-010", "skip-link-missing", "accessibility", "low", "wcag-navigation", 70, "S", "Skip link is missing"),
    ("SEO-INTL-005", "x-default-missing", "international_seo", "low", "hreflang", 92, "A", "Hreflang cluster has no x-default URL"),
    ("SEO-LOCAL-001", "nap-missing", "local_seo", "medium", "local-seo", 70, "A", "Local business NAP signals are incomplete"),
    ("SEO-LOCAL-003", "localbusiness-schema-missing", "local_seo", "medium", "local-seo", 82, "A", "LocalBusiness structured data is missing"),
    ("SEO-ECOM-001", "product-schema-missing", "ecommerce_seo", "high", "ecommerce-seo", 84, "M", "Product structured data is missing"),
    ("SEO-ECOM-002", "offer-schema-missing", "ecommerce_seo", "medium", "ecommerce-seo", 80, "A", "Offer structured data is missing"),
    ("AR-ROBOTS-003", "sitemap-directive-missing", "agent_readiness", "medium", "robots-txt", 0, "-", ""),
    ("AR-ROBOTS-004", "ai-policy-not-explicit", "policy", "info", "content-signals", 82, "A", "robots.txt does not state AI/content policy signals"),
    ("AR-ROBOTS-006", "private-area-not-blocked", "security", "medium", "robots-txt", 90, "S", "robots.txt does not block common private areas"),
    ("AR-LLMS-001", "llms-missing", "agent_readiness", "high", "llms-txt", 99, "S", "llms.txt is missing"),
    ("AR-LLMS-003", "llms-invalid-content-type", "agent_readiness", "low", "llms-txt", 90, "S", "llms.txt has an unexpected content type"),
    ("AR-LLMS-008", "llms-contains-private-url", "security", "critical", "llms-txt", 98, "M", "llms.txt exposes private references"),
    ("AR-MD-001", "markdown-negotiation-missing", "agent_readiness", "low", "markdown-negotiation", 80, "M", "Markdown negotiation is not available"),
    ("AR-SKILL-001", "agent-skills-index-missing", "protocol_discovery", "low", "agent-skills", 88, "S", "Agent Skills index is missing"),
    ("AR-SKILL-002", "agent-skills-index-invalid", "protocol_discovery", "medium", "agent-skills", 96, "S", "Agent Skills index JSON is invalid"),
    ("AR-MCP-001", "mcp-discovery-missing", "protocol_discovery", "low", "mcp", 88, "M", "MCP discovery is missing"),
    ("AR-MCP-002", "mcp-server-card-invalid", "protocol_discovery", "medium", "mcp", 96, "S", "MCP discovery JSON is invalid"),
    ("AR-MCP-005", "mcp-mutating-tool-without-approval", "api_auth_mcp", "critical", "mcp", 82, "A", "MCP metadata appears to expose mutating tools"),
    ("AR-API-001", "api-catalog-missing", "api_auth_mcp", "low", "api-catalog", 88, "S", "API Catalog is missing"),
    ("AR-API-002", "api-catalog-invalid", "api_auth_mcp", "medium", "api-catalog", 96, "S", "API Catalog JSON is invalid"),
    ("AR-API-003", "openapi-missing", "api_auth_mcp", "high", "openapi", 85, "M", "OpenAPI discovery is missing for API-like site"),
    ("AR-AUTH-001", "auth-md-missing", "api_auth_mcp", "info", "auth-discovery", 80, "A", "auth.md is not published for agent auth guidance"),
    ("AR-AUTH-002", "oauth-authorization-server-metadata-missing", "api_auth_mcp", "info", "oauth", 75, "A", "OAuth authorization server metadata is missing"),
    ("AR-AUTH-003", "oauth-protected-resource-metadata-missing", "api_auth_mcp", "info", "oauth", 75, "A", "OAuth protected resource metadata is missing"),
    ("SEO-SEARCH-001", "google-search-console-not-connected", "protocol_discovery", "info", "search-integrations", 70, "M", "Google Search Console data was not imported"),
    ("SEO-SEARCH-002", "bing-webmaster-tools-not-connected", "protocol_discovery", "info", "search-integrations", 70, "M", "Bing Webmaster Tools data was not imported"),
    ("SEO-PERF-001", "poor-lcp", "performance_seo", "medium", "core-web-vitals", 90, "M", "Largest Contentful Paint exceeds the configured budget"),
    ("SEO-INTL-001", "hreflang-missing", "international_seo", "low", "hreflang", 88, "A", "Pages in an international site are missing hreflang"),
    ("SEO-LOCAL-004", "opening-hours-missing", "local_seo", "low", "local-seo", 76, "A", "Opening-hours information is missing"),
    ("SEO-ECOM-013", "return-policy-missing", "ecommerce_seo", "low", "ecommerce-seo", 74, "A", "Merchant return policy is not discoverable"),
]
# Rules declared safe or manual whose published advice names an approval term, so that they end as approval_required.
APPROVAL_BY_TEXT = {"SEO-SITEMAP-008": "checkout and auth URLs", "AR-ROBOTS-006": "auth and checkout paths", "SEO-CONTENT-001": "content that addresses the query"}

SEVERITIES = ["critical", "high", "medium", "low", "info"]
FIX_CLASSES = {"A": "approval_required", "S": "safe_auto_fix", "M": "manual_strategy"}
# Fixed values of the score formula.
BASE_PENALTY = {"critical": 30.0, "high": 16.0, "medium": 8.0, "low": 3.0, "info": 0.5}
STEP_PENALTY = {"critical": 2.5, "high": 1.5, "medium": 0.75, "low": 0.25, "info": 0.05}
CAP_PENALTY = {"critical": 20.0, "high": 12.0, "medium": 8.0, "low": 3.0, "info": 0.5}
CORE = [
    "technical_seo", "crawlability", "indexability", "onpage_seo", "content_seo", "internal_linking", "structured_data",
    "javascript_seo", "media_seo", "performance_seo", "accessibility", "international_seo", "local_seo", "ecommerce_seo",
]
EXPERIENCE = ["performance_seo", "media_seo", "accessibility", "javascript_seo"]
AREAS = {
    "seo": CORE,
    "agentReadiness": ["agent_readiness", "protocol_discovery", "api_auth_mcp", "policy"],
    "technicalHealth": ["technical_seo", "crawlability", "indexability", "javascript_seo"],
    "contentQuality": ["content_seo", "onpage_seo", "structured_data", "internal_linking"],
    "performanceAccessibility": EXPERIENCE,
    "securityPolicy": ["security", "policy"],
}
AREA_WEIGHTS = {
    "seo": 25.0, "agentReadiness": 20.0, "technicalHealth": 20.0, "contentQuality": 15.0,
    "performanceAccessibility": 10.0, "securityPolicy": 10.0,
}
PROFILES = {
    "core_seo": CORE + ["security"],
    "experience": EXPERIENCE,
    "agent_readiness": ["agent_readiness", "protocol_discovery", "api_auth_mcp"],
    "governance": ["security", "policy"],
}
OWNERS = {
    "content_seo": "content", "internal_linking": "content", "local_seo": "content", "ecommerce_seo": "content",
    "technical_seo": "infra", "crawlability": "infra", "performance_seo": "infra", "security": "security",
    "policy": "policy", "agent_readiness": "agent-platform", "protocol_discovery": "agent-platform",
    "api_auth_mcp": "agent-platform", "onpage_seo": "frontend", "indexability": "frontend",
    "structured_data": "frontend", "javascript_seo": "frontend", "media_seo": "frontend",
    "accessibility": "frontend", "international_seo": "frontend",
}
# Default budgets of an audited site: metric -> (limit, unit).
BUDGETS = {
    "lcp-ms": 2500.0, "inp-ms": 200.0, "cls": 0.1, "ttfb-ms": 800.0, "document-fetch-ms": 1200.0, "total-js-kb": 250.0,
    "third-party-js-kb": 120.0, "total-css-kb": 100.0, "image-bytes-kb": 1000.0, "render-blocking-requests": 6.0,
    "total-requests": 80.0,
}
# The 22 well-known paths probed on every site.
ENDPOINT_PATHS = [
    "/robots.txt", "/sitemap.xml", "/sitemap_index.xml", "/llms.txt", "/llms-full.txt", "/.well-known/api-catalog",
    "/.well-known/oauth-authorization-server", "/.well-known/oauth-protected-resource", "/auth.md",
    "/.well-known/mcp.json", "/.well-known/mcp/server-card.json", "/.well-known/agent-card.json",
    "/.well-known/agent-skills/index.json", "/.well-known/ai", "/.well-known/ai-discovery", "/openapi.json",
    "/swagger.json", "/asyncapi.json", "/arazzo.yaml", "/feed.xml", "/rss.xml", "/atom.xml",
]
# The Markdown negotiation probe asks for the root page; it is kept under this path.
MARKDOWN_PROBE = "/"


def maturity(rule_id: str) -> str:
    if re.match(r"(AR-(LLMS|MD|SKILL|MCP|API)|SEO-SEARCH)-", rule_id):
        return "experimental"
    return "emerging" if rule_id.startswith("AR-") else "stable"


def advice(rule_id: str, slug: str) -> str:
    """Short recommendation of a rule; names what has to be resolved."""
    extra = APPROVAL_BY_TEXT.get(rule_id)
    return f"Resolve {slug.replace('-', ' ')}" + (f": {extra}" if extra else "")


def rules() -> list[dict]:
    out = []
    for ord_, (rid, slug, category, severity, standard, confidence, fix, title) in enumerate(RULE_ROWS):
        out.append(
            {
                "rule_id": rid, "slug": slug, "category": category, "severity": severity, "standard": standard,
                "confidence": confidence, "fix": fix, "title": title, "maturity": maturity(rid), "ord": ord_,
                "recommendation": advice(rid, slug),
            }
        )
    return out


RULES = rules()
RULE = {r["rule_id"]: r for r in RULES}
EMITTED = [r for r in RULES if r["fix"] != "-"]


def catalogue(spark: SparkSession) -> DataFrame:
    """Rule dimension, one row per rule; its size is the number of lines above."""
    cols = ["rule_id", "slug", "category", "severity", "standard", "confidence", "fix", "title", "maturity", "ord", "recommendation"]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in RULES], ", ".join(
        f"{c} {'int' if c in ('confidence', 'ord') else 'string'}" for c in cols
    ))


def values_sql(rows: list[tuple]) -> str:
    """VALUES list of a small dimension, for SQL text."""

    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
