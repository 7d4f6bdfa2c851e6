"""Privacy and approval scans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from auditlake.functions import privacy_patterns as pat
from auditlake.functions import urls as u
from auditlake.functions.binding import bind
from auditlake.functions.text import ascii_edges

is_private_url = u.is_private_url


def _may_hold(text: Column) -> Column:
    """Plain substring tests every private form needs; far cheaper than a pattern scan of long prose."""
    marks = ["/", "=", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox"]
    out = text.contains(marks[0])
    for mark in marks[1:]:
        out = out | text.contains(mark)
    return out


def private_references(text: Column) -> Column:
    """Every private URL of a text, then the first hit of each pattern, distinct, in that order."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(text, F.lit(pat.URL_IN_TEXT), F.lit(0))
    private = F.when(text.contains("://"), F.filter(found, u.is_private_url)).otherwise(none)
    # One pass tells whether the single-pattern passes are needed at all; most texts stop here.
    firsts = F.filter(
        F.array(*[F.regexp_extract(text, p, 0) for p in pat.PRIVATE_PATHS + pat.SECRET_SHAPES]), lambda x: x != ""
    )
    hits = F.when(text.rlike(pat.PRIVATE_ANY), F.array_distinct(F.concat(private, firsts))).otherwise(
        F.array_distinct(private)
    )
    return F.when(_may_hold(text), hits).otherwise(F.when(text.isNotNull(), none))


def redact_assignments(text: Column) -> Column:
    """key=value secrets and three token families."""
    out = F.regexp_replace(text, ascii_edges(pat.ASSIGNMENT), "$1=[REDACTED]")
    out = F.regexp_replace(out, r"sk-[A-Za-z0-9_-]{20,}", "sk-[REDACTED]")
    out = F.regexp_replace(out, r"gh[pousr]_[A-Za-z0-9_]{20,}", "gh[REDACTED]")
    return F.regexp_replace(out, r"xox[baprs]-[A-Za-z0-9-]{20,}", "xox[REDACTED]")


def is_sensitive_key(key: Column) -> Column:
    k = F.lower(F.trim(key))
    return k.isin(pat.SENSITIVE_KEYS) | k.rlike("[_-]token$|secret|password")


MARKER = "redacted_sensitive_query"


def redact_url(url: Column) -> Column:
    """Drops user data, sensitive query keys and secret-like values of an absolute URL and marks what it did."""

    def rebuild(parts: Column) -> Column:
        query = F.regexp_replace(parts["query"], r"^\?", "")
        pairs = F.transform(
            F.filter(F.split(query, "&"), lambda q: q != ""),
            lambda q: F.struct(
                F.regexp_replace(q, "(?s)=.*$", "").alias("raw_key"),
                F.replace(q, F.lit("%20"), F.lit("+")).alias("pair"),
                F.coalesce(F.try_url_decode(F.regexp_replace(q, "(?s)=.*$", "")), q).alias("key"),
                F.coalesce(F.try_url_decode(F.regexp_replace(q, "^[^=]*=?", "")), F.lit("")).alias("value"),
            ),
        )

        def cut(ps: Column) -> Column:
            bad = F.transform(
                F.filter(ps, lambda p: is_sensitive_key(p["key"]) | p["value"].rlike(pat.SECRET_ANY)), lambda p: p["key"]
            )
            has_user = parts["auth"].contains("@")
            user = F.when(
                parts["auth"].rlike("^[^:@]*:[^@]+@"),
                F.when(parts["auth"].startswith(":"), F.lit(":redacted@")).otherwise(F.lit("redacted:redacted@")),
            ).otherwise(F.lit("redacted@"))
            keep = F.filter(ps, lambda p: ~F.array_contains(bad, p["key"]))
            kept = F.filter(keep, lambda p: p["key"] != MARKER)
            tail = F.array_join(
                F.concat(F.transform(kept, lambda p: p["pair"]), F.array(F.lit(f"{MARKER}=1"))), "&"
            )
            host = F.when(has_user, F.concat(user, F.regexp_replace(parts["auth"], "^.*@", ""))).otherwise(parts["auth"])
            clean = F.concat(parts["scheme"], F.lit("://"), host, parts["path"], F.lit("?"), tail)
            return F.when(has_user | (F.size(bad) > 0), clean)

        return F.when(parts["scheme"] != "", bind(pairs, cut))

    done = bind(bind(F.coalesce(u.normalize_url(url), F.lit("")), u.url_parts), rebuild)
    with_fragment = F.concat(done, F.regexp_extract(url, r"(?s)#.*$", 0))
    return redact_assignments(F.coalesce(with_fragment, url))


def redact_text(text: Column) -> Column:
    """Redacts each URL of a text, then the assignments and tokens left in it.

    The text is cut at its URLs, the URLs are rewritten and both lists are joined again."""

    def stitch(parts: Column) -> Column:
        merged = F.zip_with(
            parts["plain"],
            F.transform(parts["found"], redact_url),
            lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))),
        )
        return F.array_join(merged, "")

    parts = F.struct(
        F.split(text, pat.URL_IN_TEXT, -1).alias("plain"),
        F.regexp_extract_all(text, F.lit(pat.URL_IN_TEXT), F.lit(0)).alias("found"),
    )
    rewritten = F.when(F.lower(text).rlike("https?://"), bind(parts, stitch)).otherwise(text)
    return redact_assignments(rewritten)


def redact_value(col: Column, dtype) -> Column:
    """Redacts every string inside a column of any nested type, driven by its schema."""
    if isinstance(dtype, StringType):
        return redact_text(col)
    if isinstance(dtype, ArrayType):
        return F.transform(col, lambda x: redact_value(x, dtype.elementType))
    if isinstance(dtype, MapType):
        return F.transform_values(col, lambda _, v: redact_value(v, dtype.valueType))
    if isinstance(dtype, StructType):
        return F.when(
            col.isNotNull(), F.struct(*[redact_value(col[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        )
    return col


def redact_frame(df):
    """Every string leaf of a DataFrame redacted; other types untouched."""
    return df.select(*[redact_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def needs_approval(text: Column) -> Column:
    """Plain substring test, so a term inside a longer word counts too."""
    return F.lower(text).rlike(pat.APPROVAL_ANY)


def needs_review_approval(text: Column) -> Column:
    return text.rlike(ascii_edges(pat.REVIEW_APPROVAL))


def is_secret_like(text: Column) -> Column:
    return text.rlike(pat.SECRET_REFERENCE)


def redact_export(text: Column, site_identity: bool = False) -> Column:
    """Text of an exported artifact without local paths and, on request, without any URL."""
    out = text
    for pattern, mark in pat.LOCAL_PATHS:
        out = F.regexp_replace(out, pattern, mark)
    return F.regexp_replace(out, pat.EXPORT_URL, "[redacted-url]") if site_identity else out
