"""URL resolution, comparison and templates as column expressions.

One deviation from the browser URL standard is known: international host names are lower-cased but not turned into
punycode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.binding import bind
from auditlake.functions.markup import JS_SPACE, js_trim
from auditlake.functions.privacy_patterns import PRIVATE_ANY

SPLIT = r"^([A-Za-z][A-Za-z0-9+.-]*):[/\\]{2}([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?$"
PATH_KEEP = r"!$%&'()*+,\-./0-9:;=@A-Z\[\]_a-z|~"
QUERY_KEEP = r"!$%&()*+,\-./0-9:;=?@A-Z\[\\\]\^_`a-z{|}~"
# Most URLs of a lake are already in normal form; these two tests let them skip the general work.
PLAIN_URL = rf"^https?://[a-z0-9.-]+/[{PATH_KEEP}]*(?:\?[{QUERY_KEEP}]*)?$"
PLAIN_ORIGIN = r"^(https?://[a-z0-9.-]+)(?:[/?#]|$)"
# Fixed list: file extensions never crawled.
BLOCKED_EXTENSIONS = ["jpg", "jpeg", "png", "gif", "webp", "svg", "pdf", "zip", "mp4", "mp3", "woff", "woff2"]
# Fixed list: path segments that stay literal in a route pattern.
STATIC_SEGMENTS = [
    "about",
    "contact",
    "privacy",
    "terms",
    "legal",
    "pricing",
    "docs",
    "blog",
    "projects",
    "services",
    "products",
]


def _encode(text: Column, keep: str) -> Column:
    """Percent-encode what the standard encodes; text that needs nothing takes the short way."""
    runs = F.regexp_extract_all(text, F.lit(f"[{keep}]+|[^{keep}]+"), F.lit(0))
    encoded = F.array_join(
        F.transform(
            runs,
            lambda r: F.when(r.rlike(f"^[{keep}]"), r).otherwise(
                F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))
            ),
        ),
        "",
    )
    return F.when(text.rlike(f"^[{keep}]*$"), text).otherwise(encoded)


def _dot_segments(path: Column) -> Column:
    """Resolve '.' and '..' path segments with one fold over the segments."""
    dot = r"(?i)^(?:\.|%2e)$"
    dots = r"(?i)^(?:\.|%2e){2}$"
    parts = F.split(path, "/", -1)
    tail = F.element_at(parts, -1).rlike(r"(?i)^(?:\.|%2e){1,2}$")
    parts = F.when(tail, F.array_append(parts, F.lit(""))).otherwise(parts)
    folded = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg.rlike(dots), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg.rlike(dot), acc)
        .otherwise(F.array_append(acc, seg)),
    )
    return F.when(
        path.rlike(r"(?i)/(?:\.|%2e){1,2}(?:/|$)"), F.concat(F.lit("/"), F.array_join(folded, "/"))
    ).otherwise(path)


def _authority(scheme: Column, raw: Column) -> Column:
    """Lower-cased host, default port dropped, user part kept; NULL when the host is not usable."""
    user = F.when(raw.contains("@"), F.regexp_extract(raw, "^(.*@)", 1)).otherwise(F.lit(""))
    host = F.lower(F.when(raw.contains("@"), F.regexp_replace(raw, "^.*@", "")).otherwise(raw))

    def check(h: Column) -> Column:
        port = F.when(scheme == "http", F.lit(":80")).otherwise(F.lit(":443"))
        bare = (
            F.when(~h.contains(":"), h)
            .when(h.endswith(":"), F.regexp_replace(h, ":$", ""))
            .when(h.endswith(port), F.regexp_replace(h, ":[0-9]+$", ""))
            .otherwise(h)
        )
        ok = h.rlike(r"^(?:\[[0-9a-f:.]+\]|[^\x00-\x20<>\\^|#%/:?@\[\]]+)(?::[0-9]{0,5})?$")
        return F.when(ok, F.concat(user, bare))

    return bind(host, check)


_CUT = "\x01"


def url_parts(url: Column) -> Column:
    """struct<scheme,auth,path,query> of an absolute URL, all empty when it is none.

    One pattern match marks the borders and one split takes the parts; compute it once per page as the base."""
    marked = F.regexp_replace(url, SPLIT, _CUT.join(["$1", "$2", "$3", "$4"]))

    def take(parts: Column) -> Column:
        part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        whole = F.size(parts) == 4
        return F.struct(
            *[F.when(whole, part(i)).otherwise("").alias(n) for i, n in enumerate(("scheme", "auth", "path", "query"))]
        )

    return bind(F.split(marked, _CUT, -1), take)


def _absolute(text: Column, base: Column) -> Column:
    """Reference resolution before normalising: each kind of relative reference against the base parts."""

    def resolve(ref: Column) -> Column:
        scheme, auth, path, query = (base[n] for n in ("scheme", "auth", "path", "query"))
        site = F.concat(scheme, F.lit("://"), auth)
        return (
            F.when(ref.rlike(r"^[/\\]{2}"), F.concat(scheme, F.lit(":"), ref))
            .when(ref.rlike(r"^[/\\]"), F.concat(site, ref))
            .when(ref.startswith("?"), F.concat(site, path, ref))
            .when(ref == "", F.concat(site, path, query))
            .otherwise(F.concat(site, F.lit("/"), F.regexp_extract(path, "^/(.*/)?", 1), ref))
        )

    return F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(bind(text, resolve))


def _rebuild(parts: Column) -> Column:
    scheme = F.lower(parts["scheme"])
    auth = _authority(scheme, parts["auth"])
    path = F.replace(parts["path"], F.lit("\\"), F.lit("/"))
    path = F.when(path == "", F.lit("/")).otherwise(bind(_encode(path, PATH_KEEP), _dot_segments))
    return F.when(
        scheme.isin("http", "https"),
        F.concat(scheme, F.lit("://"), auth, path, _encode(parts["query"], QUERY_KEEP)),
    )


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """Absolute http(s) form without fragment and default port; NULL where it is not such a URL.

    ``base`` is the struct made by :func:`url_parts`."""

    def general(u: Column) -> Column:
        text = F.regexp_replace(u, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", "")
        text = F.regexp_replace(text, "(?s)#.*$", "")
        absolute = text if base is None else bind(text, lambda t: _absolute(t, base))
        absolute = F.regexp_replace(absolute, r"^(?i)(https?):[/\\]*", "$1://")
        return bind(bind(absolute, url_parts), _rebuild)

    return F.when(url.rlike(PLAIN_URL) & ~url.contains("/."), url).otherwise(general(url))


def admit_href(href: Column, base: Column) -> Column:
    """Resolved link target (``base`` from :func:`url_parts`), NULL for script, data, mail and phone targets even when written with control characters."""


    def admit(trimmed: Column) -> Column:
        compact = F.regexp_replace(F.lower(trimmed), r"[\x00-\x20\x7f]", "")
        blocked = compact.rlike("^(?:javascript|data|vbscript|mailto|tel):")
        return F.when((trimmed != "") & ~blocked, normalize_url(trimmed, base))

    return bind(js_trim(href), admit)


def origin(url: Column) -> Column:
    """Scheme, host and non-default port of an absolute http(s) URL; NULL otherwise."""

    def build(parts: Column) -> Column:
        scheme = F.lower(parts["scheme"])
        auth = F.regexp_replace(_authority(scheme, parts["auth"]), "^.*@", "")
        return F.when(scheme.isin("http", "https"), F.concat(scheme, F.lit("://"), auth))

    plain = F.regexp_extract(url, PLAIN_ORIGIN, 1)
    return bind(plain, lambda p: F.when(p != "", p).otherwise(bind(url_parts(url), build)))


def same_origin(left: Column, right: Column) -> Column:
    return F.coalesce(origin(left) == origin(right), F.lit(False))


def is_http_url(url: Column) -> Column:
    return origin(url).isNotNull()


def url_path(url: Column) -> Column:
    return bind(url_parts(url), lambda p: F.when(p["scheme"] != "", F.when(p["path"] == "", "/").otherwise(p["path"])))


def hostname(url: Column) -> Column:
    """Host without port, or '' when the text is not an absolute URL."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(origin(url), "^https?://", ""), ":[0-9]+$", ""), F.lit(""))


def is_private_url(url: Column) -> Column:
    """Private path or secret in path and query; text that is no URL is tested as a whole."""

    def target(p: Column) -> Column:
        path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
        return F.when(p["scheme"] == "", url).otherwise(F.concat(path, p["query"]))

    # A private form somewhere in the text is necessary, so the URL is only taken apart where one is.
    return F.when(url.rlike(PRIVATE_ANY), bind(url_parts(url), target).rlike(PRIVATE_ANY)).otherwise(
        F.when(url.isNotNull(), F.lit(False))
    )


def is_safe_crawl_url(url: Column, site_origin: Column) -> Column:
    blocked = F.lower(url_path(url)).rlike(r"\.(?:" + "|".join(BLOCKED_EXTENSIONS) + ")$")
    has_dot = F.regexp_replace(url, "^[a-z]+://[^/]*", "").contains(".")
    # Cheapest tests first: most links pass without their path being taken apart.
    return same_origin(url, site_origin) & ~is_private_url(url) & ~F.when(has_dot, blocked).otherwise(F.lit(False))


def canonical_form(url: Column) -> Column:
    """Comparison form: no fragment, no trailing slash unless the path is the root. NULL for bad URLs."""
    return F.regexp_replace(normalize_url(url), r"^(https?://[^/?#]+/[^?]*)/(\?|$)", "$1$2")


def queue_form(url: Column) -> Column:
    """Comparison form that tolerates text that is no URL."""
    return F.coalesce(canonical_form(url), F.regexp_replace(url, "/$", ""))


def route_pattern(url: Column) -> Column:
    """Path with numbers, ids and free segments replaced by placeholders."""
    segments = F.filter(F.split(F.coalesce(url_path(url), F.lit("")), "/"), lambda s: s != "")

    def shape(segment: Column, i: Column) -> Column:
        text = F.lower(F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment))
        return bind(text, lambda t: placeholder(t, i))

    def placeholder(text: Column, i: Column) -> Column:
        return (
            F.when(text.rlike("^[0-9]+$"), F.lit(":number"))
            .when(text.rlike("^[0-9a-f]{8,}$"), F.lit(":id"))
            .when((i > 0) & ~text.isin(STATIC_SEGMENTS), F.lit(":slug"))
            .when((F.length(text) > 32) | text.contains("-"), F.lit(":slug"))
            .otherwise(text)
        )

    return F.concat(F.lit("/"), F.array_join(F.transform(segments, shape), "/"))


def title_case(text: Column) -> Column:
    """Upper-case every ASCII lower-case letter that starts a word."""
    parts = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.regexp_extract(p, "^[a-z]", 0)), F.regexp_replace(p, "^[a-z]", ""))), "")


def template_label(pattern: Column) -> Column:
    head = F.regexp_extract(pattern, "^/([^/]*)", 1)
    return F.when(pattern == "/", F.lit("Home template")).otherwise(
        F.concat(title_case(F.regexp_replace(head, "[:_-]+", " ")), F.lit(" template"))
    )


def text_shape(text: Column) -> Column:
    """Words, digits and spaces flattened so that titles of one template look alike; 80 characters."""
    trimmed = js_trim(F.coalesce(text, F.lit("")))
    shaped = F.regexp_replace(trimmed, "[A-Z][a-z]+", "Word")
    shaped = F.regexp_replace(shaped, "[0-9]+", "0")
    shaped = F.regexp_replace(shaped, "[" + JS_SPACE + "]+", " ")
    return F.when(trimmed == "", F.lit("empty")).otherwise(F.substring(shaped, 1, 80))


def portfolio_target(value: Column) -> Column:
    return F.coalesce(normalize_url(value), value)
