"""HTML extraction as column expressions.

Everything here works on one page at a time inside the JVM: no explode, no Python worker and no shuffle, so that
parsing a lake of pages is one narrow scan. Patterns are written for Java with possessive repeats (no
stack growth on very long tags) and use neither look-around nor back-references, so dropping the extra ``+``
gives text that RE2 accepts too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.binding import bind

# Fixed patterns of the markup grammar.
WS = r"\t\n\f\r "
COMMENT = r"<!--(?s:.*?)(?:-->|\z)"
ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TAG = r"<(/?)[" + WS + r"]*+([A-Za-z0-9:-]++)(" + ATTRS + r")>"
TAG_NAME = "^</?[" + WS + "]*+([A-Za-z0-9:-]++)"
TOKEN = COMMENT + "|" + TAG
ATTR_NAME = r"""[^\x00-\x20"'/=>]++"""
ATTR_VALUE = r"""(?:"[^"]*+"?|'[^']*+'?|[^""" + WS + r""">"'][^""" + WS + r""">]*+|)"""
ATTR = ATTR_NAME + "(?:[" + WS + "]*+=[" + WS + "]*+" + ATTR_VALUE + ")?"
ATTR_PREFIX = "^(?:[" + WS + "]++|" + ATTR + r"""|[\x00-\x08\x0b\x0e-\x1f"'=>])*+"""
JS_SPACE = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
JS_SPACE_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def rx(pattern: str) -> str:
    """The same pattern for engines without possessive repeats."""
    return pattern.replace("*+", "*").replace("++", "+")


def js_trim(text: Column) -> Column:
    """Trim of every Unicode space, both ends."""
    return F.btrim(text, F.lit(JS_SPACE_CHARS))


def collapse_space(text: Column) -> Column:
    """Runs of ASCII white space become one space; ends are cut."""
    return F.trim(F.regexp_replace(text, "[" + WS + "]++", " "))


def decode_entities(text: Column) -> Column:
    """Six named entities, ampersand last so nothing is decoded twice, then trimmed."""
    out = text
    # Fixed entity list, in decoding order.
    for entity, char in (
        ("&nbsp;", " "),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&#39;", "'"),
        ("&amp;", "&"),
    ):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return js_trim(out)


def _element(name: str) -> str:
    end = r"[" + WS + r"/][^>]*+"
    return f"<{name}(?:{end})?>.*?</{name}(?:>|{end}(?:>|\\z))"


DROP_ELEMENTS = "(?is)" + _element("script") + "|" + _element("style")
DROP_OPENERS = r"(?is)<(?:script|style)(?:[" + WS + r"/][^>]*+)?>"
DROP_TAIL = r"(?is)<(?:script|style)[" + WS + r"/][^>]*+\z"
ANY_COMMENT = r"(?s)<!--.*?(?:-->|\z)"


LEFT_OPEN = r"(?i)<s(?:cript|tyle)[>/" + WS + "]"


def visible_text(html: Column) -> Column:
    """Text a reader sees: scripts and styles with their content, comments and tags removed, entities decoded.

    Passes that most pages do not need are behind a plain substring test."""

    def leftovers(t: Column) -> Column:
        cut = F.regexp_replace(F.regexp_replace(t, DROP_OPENERS, ""), DROP_TAIL, "")
        return F.when(t.rlike(LEFT_OPEN), cut).otherwise(t)

    def comments(t: Column) -> Column:
        return F.when(t.contains("<!--"), F.regexp_replace(t, ANY_COMMENT, " ")).otherwise(t)

    def entities(t: Column) -> Column:
        return F.when(t.contains("&"), decode_entities(t)).otherwise(t)

    out = bind(F.regexp_replace(html, DROP_ELEMENTS, " "), leftovers)
    out = F.regexp_replace(bind(out, comments), TAG, " ")
    return js_trim(collapse_space(bind(out, entities)))


def _attr_struct(token: Column) -> Column:
    value = F.regexp_replace(token, "^" + ATTR_NAME + "(?:[" + WS + "]*+=[" + WS + "]*+)?", "")
    # The quote that opens a value is the one that ends it, so one alternative of each kind is enough.
    bare = bind(
        value,
        lambda v: F.when(v.startswith('"'), F.regexp_replace(v, r'^"|"\z', ""))
        .when(v.startswith("'"), F.regexp_replace(v, r"^'|'\z", ""))
        .otherwise(v),
    )
    return F.struct(
        F.lower(F.regexp_extract(token, "^" + ATTR_NAME, 0)).alias("name"),
        bind(bare, lambda v: F.when(v.contains("&"), decode_entities(v)).otherwise(js_trim(v))).alias("value"),
    )


def parse_attributes(attrs_text: Column) -> Column:
    """array<struct<name,value>> in source order; reading stops at a slash between attributes."""
    head = F.regexp_extract(attrs_text, ATTR_PREFIX, 0)
    return F.transform(F.regexp_extract_all(head, F.lit(ATTR), F.lit(0)), _attr_struct)


def tag_stream(html: Column, names: list[str] | None = None, attributes: bool = True) -> Column:
    """array<struct<name,closing,attrs_text[,attrs]>> of the tags of a page in document order.

    ``names`` keeps the named tags only, before any attribute is parsed."""
    raw = F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))
    if names:
        wanted = r"^</?[" + WS + "]*+(?i:" + "|".join(names) + r")(?:[^A-Za-z0-9:-]|\z)"
        raw = F.filter(raw, lambda t: t.rlike(wanted))
    else:
        raw = F.filter(raw, lambda t: ~t.startswith("<!--"))

    def build(token: Column) -> Column:
        closing = token.startswith("</")
        body = F.regexp_replace(token, TAG_NAME, "")
        text = F.when(closing, F.lit("")).otherwise(F.left(body, F.length(body) - 1))
        fields = [
            F.lower(F.regexp_extract(token, TAG_NAME, 1)).alias("name"),
            closing.alias("closing"),
            text.alias("attrs_text"),
        ]
        if attributes:
            fields.append(parse_attributes(text).alias("attrs"))
        return F.struct(*fields)

    return F.transform(raw, build)


def attr(tag: Column, name: str) -> Column:
    """Value of the last attribute of that name, NULL when the tag has none."""
    hits = F.filter(tag["attrs"], lambda a: a["name"] == name)
    return F.try_element_at(hits, F.lit(-1))["value"]


def has_attr(tag: Column, name: str) -> Column:
    return F.exists(tag["attrs"], lambda a: a["name"] == name)


def open_tags(tags: Column, name: str) -> Column:
    return F.filter(tags, lambda t: (t["name"] == name) & ~t["closing"])


def first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def null_if_blank(text: Column) -> Column:
    return F.nullif(js_trim(text), F.lit(""))


def rel_has(rel: Column, token: str) -> Column:
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(rel, F.lit(""))), "[" + WS + "]", " "), F.lit(" "))
    return padded.contains(f" {token} ")


def _named_open(name: str) -> str:
    """Opening tag of exactly this name (the character after the name is not a name character)."""
    return (
        "<[" + WS + "]*+" + name + r"""(?:(?:[^A-Za-z0-9:>"'-]|"[^"]*+"|'[^']*+')""" + ATTRS + ")?>"
    )


def element_text(html: Column, name: str) -> Column:
    """Text of the first element of that name; NULL when it is never closed or empty."""
    opener = _named_open(name)
    closer = f"</{name}(?:[{WS}>]|\\z)"
    scan = f"(?is){COMMENT}|{opener}(?:.*?{closer})?"
    hits = F.filter(F.regexp_extract_all(html, F.lit(scan), F.lit(0)), lambda t: ~t.startswith("<!--"))
    return bind(
        first(hits), lambda hit: null_if_blank(visible_text(F.regexp_extract(hit, f"(?is)^{opener}(.*?){closer}", 1)))
    )


def headings(html: Column) -> Column:
    """array<struct<level,text>>: closed h1..h6 with text, document order.

    The page is cut at every heading opener. The content normally ends inside its own piece; only
    where it does not, and a closing tag of its level still follows, the following pieces are joined back up to it.
    So a page of many headings that are never closed costs no more than one reading."""
    opener = (
        "<[" + WS + "]*+h[1-6]" + r"""(?:(?:[^A-Za-z0-9:>"'-]|"[^"]*+"|'[^']*+')""" + ATTRS + ")?>"
    )
    cut = f"(?i){COMMENT}|{opener}"
    closer = f"</h(?:LEVEL)(?:[{WS}>]|\\z)"

    def by_level(level: Column, build) -> Column:
        out = F.lit(None).cast("string")
        for n in range(1, 7):
            out = F.when(level == str(n), build(str(n))).otherwise(out)
        return out

    def content(level: Column, text: Column) -> Column:
        """What stands before the closing tag of that level, NULL when there is none."""

        def upto(n: str) -> Column:
            end = closer.replace("LEVEL", n)
            return F.try_element_at(F.regexp_extract_all(text, F.lit(f"(?is)^(.*?){end}"), F.lit(1)), F.lit(1))

        return by_level(level, upto)

    def cut_page(parts: Column) -> Column:
        marks, pieces, ends = parts["marks"], parts["pieces"], parts["ends"]

        def build(mark: Column, i: Column) -> Column:
            later = F.concat(
                F.element_at(pieces, i + 2),
                F.array_join(
                    F.zip_with(
                        F.slice(marks, i + 2, F.size(marks)),
                        F.slice(pieces, i + 3, F.size(pieces)),
                        lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))),
                    ),
                    "",
                ),
            )
            level = F.regexp_extract(mark, "(?i)^<[" + WS + "]*h([1-6])", 1)
            inner = bind(
                level,
                lambda lv: F.coalesce(
                    content(lv, F.element_at(pieces, i + 2)),
                    F.when((lv != "") & (F.element_at(ends, F.greatest(F.coalesce(lv.try_cast("int"), F.lit(1)), F.lit(1))) > i + 2), content(lv, later)),
                ),
            )
            return F.struct(level.try_cast("int").alias("level"), inner.alias("inner"))

        closed = F.filter(F.transform(marks, build), lambda h: h["inner"].isNotNull())
        texts = F.transform(
            closed, lambda h: F.struct(h["level"].alias("level"), visible_text(h["inner"]).alias("text"))
        )
        return F.filter(texts, lambda h: h["text"] != "")

    def with_ends(parts: Column) -> Column:
        """The last piece, with the mark before it, in which each level has a closing tag; 0 for none."""
        closed = F.transform(
            parts["pieces"],
            lambda p, i: F.regexp_extract_all(
                F.concat(F.when(i > 0, F.element_at(parts["marks"], F.greatest(i, F.lit(1)))).otherwise(F.lit("")), p), F.lit(f"(?i)</h([1-6])(?:[{WS}>]|\\z)"), F.lit(1)
            ),
        )

        def last_of(seen: Column, level: str) -> Column:
            return F.coalesce(F.array_max(F.transform(seen, lambda c, i: F.when(F.array_contains(c, level), i + 1))), F.lit(0))

        last = lambda seen: F.array(*[last_of(seen, str(n)) for n in range(1, 7)])
        return bind(closed, lambda seen: F.struct(parts["marks"].alias("marks"), parts["pieces"].alias("pieces"), last(seen).alias("ends")))

    parts = F.struct(
        F.regexp_extract_all(html, F.lit(cut), F.lit(0)).alias("marks"), F.split(html, cut, -1).alias("pieces")
    )
    return bind(bind(parts, with_ends), cut_page)


def json_ld_blocks(html: Column) -> Column:
    """array<string>: trimmed bodies of closed script elements typed application/ld+json."""
    opener = _named_open("script")
    closer = f"</script(?:[{WS}>]|\\z)"
    scan = f"(?is){COMMENT}|{opener}.*?{closer}"
    hits = F.regexp_extract_all(html, F.lit(scan), F.lit(0))
    hits = F.filter(hits, lambda t: ~t.startswith("<!--") & t.rlike(r"(?i)application/ld\+json"))

    def typed(t: Column) -> Column:
        attrs = parse_attributes(F.regexp_extract(t, TAG, 3))
        last = F.try_element_at(F.filter(attrs, lambda a: a["name"] == "type"), F.lit(-1))["value"]
        return F.coalesce(F.lower(last) == "application/ld+json", F.lit(False))

    return F.transform(
        F.filter(hits, typed), lambda t: js_trim(F.regexp_extract(t, f"(?is)^{opener}(.*?){closer}", 1))
    )


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[" + WS + "]+"), lambda w: w != ""))
