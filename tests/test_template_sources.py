"""Route files of a pattern: held against all pairs, with folders that most files share."""

import random

from auditlake.operators.intel import INDEX_FILE, template_sources


def brute(patterns, files, k):
    import re

    out = {}
    for site, pattern in patterns:
        seg = re.sub("^:", "", re.match("^/([^/]*)", pattern).group(1))
        own = [f for f in files if f[0] == site]
        hit = [f for f in own if (re.search(INDEX_FILE, f[1].lower()) if pattern == "/" else seg and seg in f[1].lower())]
        best = sorted(hit, key=lambda f: (-f[2], f[3]))[:k] or sorted(own, key=lambda f: f[3])[:k]
        out.update({(site, pattern, i + 1): f[1] for i, f in enumerate(best)})
    return out


def test_template_sources_agree_with_all_pairs(spark):
    rng = random.Random(5)
    names = ["blog", "Blogs", "shop", "a", "shop-blog", "x.page.tsx", "index.tsx", "p", "docs", "blog.blog"]
    files = [(f"s{i % 3}", "/".join(["src", *rng.choices(names, k=rng.randint(1, 4)), f"f{i}.tsx"]), rng.choice([70, 82, 90]), i) for i in range(300)]
    patterns = [(f"s{s}", pt) for s in range(4) for pt in ("/", "/blog/:id", "/blogs", "/:id", "/sh", "/p/x", "/none", "/shop-blog", "/o", "/tsx")]
    t = spark.createDataFrame(patterns, "site_id string, url_pattern string")
    f = spark.createDataFrame(files, "site_id string, path string, confidence int, ord long")
    got = {(r.site_id, r.url_pattern, r.rank): r.path for r in template_sources(t, f).collect()}
    assert got == brute(patterns, files, 5)
