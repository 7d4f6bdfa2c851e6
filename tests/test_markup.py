from pyspark.sql import functions as F

from auditlake.functions import markup as m
from auditlake.operators import pages as p
from auditlake.operators import resources as res


def one(spark, html, expr):
    return spark.createDataFrame([(html,)], "html string").select(expr(F.col("html")).alias("x")).first().x


def snap(make_pages, html, url="https://ex.com/dir/page"):
    return p.page_snapshots(make_pages([{"url": url, "html": html}])).first()


def test_entities_decode_once_and_hidden_content_goes(spark):
    html = "<p>&amp;lt;x&amp;gt;</p><script>bad()</script><style>a{}</style><!-- note --><b>ok</b>"
    assert one(spark, html, m.visible_text) == "&lt;x&gt; ok"


def test_unclosed_script_drops_only_its_tag(spark):
    assert one(spark, "a <script src=x>b c", m.visible_text) == "a b c"
    assert one(spark, "a <script src=x", m.visible_text) == "a"


def test_unterminated_comment_runs_to_the_end(spark):
    assert one(spark, "a <!-- b <p>c</p>", m.visible_text) == "a"
    assert one(spark, "<i>a</i><!-- <b>", lambda c: F.size(m.tag_stream(c))) == 2


def test_tag_grammar(spark):
    html = """<a title="x > y" HREF='/p' href="/q">t</a>< div data-x=1/><br/ id=late><![CDATA[x]]>"""
    tags = one(spark, html, m.tag_stream)
    assert [(t.name, t.closing) for t in tags] == [("a", False), ("a", True), ("div", False), ("br", False)]
    first = spark.createDataFrame([(html,)], "html string").select(m.tag_stream(F.col("html")).alias("t"))
    attr = lambda n: first.select(m.attr(F.col("t")[0], n)).first()[0]
    assert attr("href") == "/q" and attr("title") == "x > y" and attr("none") is None
    assert tags[2].attrs[0].value == "1/"
    assert tags[3].attrs == []


def test_very_long_tag_does_not_overflow(spark):
    html = "<p " + " ".join(f'a{i}="v"' for i in range(20000)) + ">x</p>"
    assert one(spark, html, m.visible_text) == "x"
    assert one(spark, html, lambda c: F.size(m.tag_stream(c)[0]["attrs"])) == 20000


def test_links_reject_script_targets(make_pages):
    html = '<a href=" Java\n Script:alert(1)">x</a><a href="mailto:a@b.c">m</a><a href="../up?x=1#f">u</a><a href="../up?x=1">again</a><a href="//other.org/z">o</a>'
    row = snap(make_pages, html)
    assert row.internal_links == ["https://ex.com/up?x=1"]
    assert row.external_links == ["https://other.org/z"]


def test_hreflang_keeps_labels(make_pages):
    html = '<link rel="alternate" hreflang="EN" href="/en"><link rel=alternate hreflang=x-default href="/"><link rel="alternate" hreflang="en" href="/en">'
    assert [(h.language, h.href) for h in snap(make_pages, html).hreflang] == [("en", "https://ex.com/en"), ("x-default", "https://ex.com/")]


def test_first_meta_decides_even_when_empty(make_pages):
    row = snap(make_pages, '<meta name="Description" content=""><meta name=description content=later><meta property="og:title" content=a><meta property="og:title" content=b>')
    assert row.meta_description is None
    assert row.open_graph == {"og:title": "b"}


def test_title_and_lang_edge_cases(make_pages):
    assert snap(make_pages, "<title>open").title is None
    assert snap(make_pages, "<title> </title><title>second</title>").title is None
    row = snap(make_pages, "<!-- <title>no</title> --><html><title>yes &amp; no</title></html><html lang=en>")
    assert row.title == "yes & no" and row.lang is None


def test_headings_nested_and_unclosed(make_pages):
    html = "<h1>a<h2>b</h2></h1><h3>never<h4> </h4><H5>e</h5 ><h7>x</h7>"
    got = [(h.level, h.text) for h in snap(make_pages, html).headings]
    assert got == [(1, "a b"), (2, "b"), (5, "e")]


def test_heading_jump(make_pages):
    row = p.page_snapshots(make_pages([{"url": "https://e.com/", "html": "<h1>a</h1><h3>b</h3><h6>c</h6>"}])).select(p.first_heading_jump(F.col("headings")).alias("j")).first()
    assert (row.j.from_level, row.j.to_level) == (1, 3)


def test_json_ld(make_pages):
    html = """<script type="Application/LD+json">{"@graph":[{"@type":["A","B"],"x":{"@type":"C"}}]}</script><script type="application/ld+json">{"@type":</script><script>{"@type":"No"}</script>"""
    row = p.with_json_ld_types(p.page_snapshots(make_pages([{"url": "https://e.com/", "html": html}]))).first()
    assert [b.parse_error for b in row.json_ld] == [False, True]
    assert row.json_ld_types == ["A", "B", "C"]


def test_images_and_skip_link(make_pages):
    row = snap(make_pages, '<img src=a.png alt="" width=1><img src="data:x"><img alt=n><a href=" #main ">s</a><form></form>')
    assert [(i.src, i.alt, i.has_width, i.has_height) for i in row.images] == [("https://ex.com/dir/a.png", "", True, False)]
    assert row.has_skip_link and row.forms == 1


def test_resources_merge_flags(make_pages):
    html = '<head><script src=/a.js async></script><link rel="preload" href="/f.woff2"></head><script src="/a.js"></script><img srcset="/1.png 1x, /2.png 2x, /3.png 3x, /4.png 4x">'
    rows = {r.url: r for r in res.page_resources(make_pages([{"url": "https://ex.com/", "html": html}])).collect()}
    a = rows["https://ex.com/a.js"]
    assert a.render_blocking and a.is_async and a.in_head and not a.third_party
    assert rows["https://ex.com/f.woff2"].type == "font"
    assert "https://ex.com/3.png" in rows and "https://ex.com/4.png" in rows


def test_snapshot_is_one_narrow_stage(make_pages):
    plan = p.page_snapshots(make_pages([{"url": "https://e.com/", "html": "<p>"}]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_many_metas_keep_the_last_of_each_key_in_linear_time(make_pages):
    import time

    html = "".join(f'<meta property="og:k{i % 4000}" content="{i}">' for i in range(16000))
    page = p.page_snapshots(make_pages([{"url": "https://e.com/", "html": html}])).select("open_graph")
    start = time.time()
    got = page.first().open_graph
    assert len(got) == 4000 and got["og:k0"] == "12000" and got["og:k3999"] == "15999"
    assert time.time() - start < 20
