"""Operator 5: anchors and gaps against plain dynamic programming, planted and edited licenses."""

import random
import re

from auditlake.llm import license_texts
from auditlake.llm import licenses as x

SF = "/root/testdata/sf0.01"
LINES = r"Licensed under CC BY-NC \d|This work is licensed under the GNU General Public License, version \d|Licensed under the Apache License, Version \d|Released under the MIT License"


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for w in a:
        new = [0]
        for j, v in enumerate(b):
            new.append(row[j] + 1 if w == v else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_increasing_is_longest():
    rng = random.Random(0)
    for _ in range(200):
        n = rng.randint(0, 12)
        ys = rng.sample(range(40), n)
        got = x.increasing(list(enumerate(ys)))
        best = max((bin(k).count("1") for k in range(1 << n) if (s := [y for i, y in enumerate(ys) if k >> i & 1]) == sorted(s)), default=0)
        assert len(got) == best and [y for _, y in got] == sorted(y for _, y in got)


def test_alignment_of_distinct_words_is_best_and_always_valid():
    rng = random.Random(1)
    for words in (range(400), range(25)):
        for _ in range(100):
            b = tuple(str(w) for w in (rng.sample(words, 20) if len(words) > 20 else rng.choices(words, k=20)))
            a = [w if rng.random() > 0.2 else str(rng.choice(words)) for w in b]
            pairs = x.align(a, b)
            assert all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
            if len(words) > 25 and len(set(a)) == len(a):
                assert len(pairs) == common(a, b)


def test_every_template_is_found_whole_and_edited():
    rng = random.Random(2)
    known = x.templates()
    for name, text in license_texts.TEMPLATES:
        words = x.TOKEN.findall(text.lower())
        noise = [rng.choice("la le the of and to in und der que".split()) for _ in range(300)]
        got = x.matches([*noise, *words, *noise], known)
        assert [(m.name, m.matched, m.first) for m in got] == [(name, len(words), 300)], name
        if len(words) > 40:
            edited = [w for w in words if rng.random() > 0.1]
            assert [m.name for m in x.matches([*noise, *edited, *noise, *edited], known)] == [name] * 2


def test_fuller_templates_win():
    known, named = x.templates(), {}
    for name, text in license_texts.TEMPLATES:
        named.setdefault(name, []).append(text)
    find = lambda text: [(m.name, m.matched, m.total) for m in x.matches(x.TOKEN.findall(text.lower()), known)]
    for kind, n in (("BY", 6), ("BY-ND", 7), ("BY-NC", 7), ("BY-SA", 7), ("BY-NC-ND", 8), ("BY-NC-SA", 8)):
        assert find(f"See below. Licensed under CC {kind} 4.0.") == [(f"CC-{kind}", n, n)]
    assert find("Licensed under the Eclipse Public License, version 2.0.")[0][0] == "EPL-line"
    affero = "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"
    assert any(affero in t for t in named["AGPL-notice"]) and {m[0] for t in named["AGPL-notice"] for m in find(t)} == {"AGPL-notice"}
    for name, last in (("BSD-2-Clause", "damage"), ("BSD-3-Clause", "damage"), ("Unlicense", "software")):
        words = x.TOKEN.findall(max(named[name], key=len).lower())
        got = x.matches(words, known)
        assert [(m.name, m.last) for m in got] == [(name, len(words) - 1)] and words[-1] == last
    assert {"Zlib", "BSL-1.0", "EPL-2.0", "WTFPL"} <= set(named)


def test_signs_are_mandatory():
    for t in x.templates():
        kept = sum(w not in t.signs for w in t.words)
        assert kept < x.COVERAGE * len(t.words)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: len(re.findall(LINES, r.text)) for r in docs.collect()}
    got = {r.doc_id: r for r in x.license_spans(docs).collect()}
    assert {i: r.n_licenses for i, r in got.items()} == want and sum(want.values()) > 5
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, r in got.items():
        for part in filter(None, r.licenses.split(",")):
            _, a, b, _ = part.split(":")
            assert re.match(LINES.replace(r" \d", ""), texts[i][int(a) : int(b)])


def test_odd_rows(spark, odd):
    docs = odd("license int", rows=[(1, None, "en", "a", 1, 1), (2, "", None, None, 0, 2), (3, "É RELEASED under\nthe MIT license!", "en", "a", 5, 3), (3, "É RELEASED under\nthe MIT license!", "en", "a", 5, 3), (4, "license " * 20_000, "en", "a", 5, 3)])
    got = sorted(map(tuple, x.license_spans(docs).collect()))
    assert got[:4] == [(1, 0, None, 0.0, ""), (2, 0, None, 0.0, ""), (3, 1, "MIT-line", 1.0, "MIT-line:2:32:5/5"), (3, 1, "MIT-line", 1.0, "MIT-line:2:32:5/5")]
    assert got[4][1] == 0
    assert x.license_spans(odd(rows=[])).count() == 0
