"""International host names against the standard library's coding."""

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.functions import urls as u
from auditlake.functions.hosts import ascii_host, ascii_url

LETTERS = st.text("abz019-äöüßñéπλωЖщы日本語中文字한국😀𝒳ÿāğ", min_size=1, max_size=24)


def lower_ascii(label):
    return label if label.isascii() else "xn--" + label.encode("punycode").decode()


@settings(max_examples=3, deadline=None, phases=[Phase.generate])
@given(st.lists(LETTERS, min_size=150, max_size=300))
def test_labels_agree_with_the_library(spark, labels):
    rows = spark.createDataFrame([(x,) for x in labels], "x string").select(F.lower("x").alias("x"), ascii_host(F.col("x")).alias("got")).collect()
    assert [(r.x, r.got) for r in rows] == [(r.x, lower_ascii(r.x)) for r in rows]


def test_hosts(spark):
    rows = {"Bücher.example": "xn--bcher-kva.example", "a.b.example": "a.b.example", "": "", "日本語。jp": "xn--wgv71a119e.jp", "MÜNCHEN.de": "xn--mnchen-3ya.de", "x" * 40 + "é.fr": None}
    got = {r.x: r.got for r in spark.createDataFrame([(x,) for x in rows] + [(None,)], "x string").select("x", ascii_host(F.col("x")).alias("got")).collect()}
    assert got[None] is None
    for x, want in rows.items():
        assert got[x] == (want if want is not None else ".".join(lower_ascii(p) for p in x.split("."))), x


def test_urls_of_such_hosts(spark):
    c = F.col
    rows = [
        ("https://bücher.example/ä", "https://xn--bcher-kva.example/%C3%A4"), ("http://u@BÜCHER.example:80/a/?q=ä", "http://u@xn--bcher-kva.example/a/?q=%C3%A4"),
        ("https://bücher.example:8443/", "https://xn--bcher-kva.example:8443/"), ("/ä", None), ("", None), (None, None), ("https://a.example/ü", "https://a.example/%C3%BC"),
    ]
    a = ascii_url(c("a"))
    for r in spark.createDataFrame(rows, "a string, b string").select(
        "a", "b", u.normalize_url(a).alias("n"), u.same_origin(a, c("b")).alias("same"), u.queue_form(a).alias("qa"), u.queue_form(c("b")).alias("qb")
    ).collect():
        assert r.n == r.b and (r.b is None or (r.same, r.qa) == (True, r.qb)), r


def test_query_against_the_library(spark):
    import __spark_entry__ as entry

    rows = entry.queries()["U12_ascii_hosts"](spark, "/root/testdata/sf0.01").collect()
    coded = 0
    for r in rows:
        host = r.url.split("/")[2]
        assert r.normal.split("/")[2] == ".".join(lower_ascii(x) for x in host.split(".")), r
        coded += not host.isascii()
    assert len(rows) == 1000 and coded > 0, (len(rows), coded)
