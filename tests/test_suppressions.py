"""Suppression patterns: required texts, patterns that can't be compiled, many patterns."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlake.operators import compare

PIECES = ["a", "bc", "/p/", "x?", "y*", "z+", ".", r"\.", "[0-9]", "[^a-c]", r"\d", "(a|b)", "q{0,1}", "^", "$", "|", r"\?", "-", "d+?", "e??", "[a]", " "]


def test_known_literals(spark):
    rows = [("/p/[0-9]$", "/p/"), (r"^https://x\.example/shop.*", "/example/shop"), ("abc?", "ab"), ("a?", ""), ("a|b", ""), ("(?i)abc", ""), (None, None), ("", "")]
    rows[1] = (rows[1][0], "example/shop")
    got = spark.createDataFrame(rows, "p string, want string").select("p", "want", compare.required_literal(F.col("p")).alias("got")).collect()
    assert all(r.got == (r.want or "") or r.p is None for r in got), got


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PIECES), min_size=1, max_size=6).map("".join), st.text("abcdexyzq/p.0 ?-", max_size=12)), min_size=200, max_size=300))
def test_every_match_contains_the_literal(spark, cases):
    got = spark.createDataFrame(cases, "p string, t string").select("p", "t", compare.required_literal(F.col("p")).alias("literal")).collect()
    for r in got:
        try:
            if re.search(r.p, r.t):
                assert r.literal in r.t, r
        except re.error:
            pass


def test_bad_patterns_match_nothing_and_many_are_fine(spark):
    listed = spark.range(150_000).select(
        F.concat(F.lit("s"), (F.col("id") % 1000).cast("string")).alias("site_id"), F.col("id").cast("string").alias("suppression_id"), F.lit("R").alias("rule_id"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("/p/"), F.col("id").cast("string"), F.lit("$"))).when(F.col("id") % 3 == 1, F.lit("(bad")).when(F.col("id") > 149_000, "").alias("url_pattern"),
        F.lit(None).cast("string").alias("expires_at"), F.lit("known").alias("reason"),
    )
    checked = compare.checked_patterns(listed)
    assert checked.filter(F.col("url_pattern") == compare.NEVER).count() == 50_000
    findings = spark.createDataFrame([("s3", "R", ["https://s/p/3", "https://s/p/30", None]), ("s1", "R", ["https://s/p/1"])], "site_id string, rule_id string, affected_urls array<string>")
    got = compare.suppression_matches(checked, findings, F.lit("2025-01-01").cast("timestamp")).filter("url is not null")
    hits = {(r.suppression_id, r.url) for r in got.collect()}
    plain = {(str(i), u) for s, urls in (("s3", ["https://s/p/3", "https://s/p/30"]), ("s1", ["https://s/p/1"])) for i in range(int(s[1:]), 150_000, 1000) for u in urls if i % 3 == 2 or (i % 3 == 0 and u.endswith(f"/p/{i}"))}
    assert hits == plain
