"""Operator 8: facts against plain counting, the verdict against the rules in any order."""

import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import quality as q


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(["a", "b", " ", " ", "\n", "é", "#|", "a b a b a b a b a b\n"]), st.text(max_size=3)), max_size=40).map("".join), min_size=1, max_size=4))
def test_facts(texts):
    block = q.Block([t.encode("utf-8", "replace") for t in texts])
    got = list(zip(*(getattr(block, f).tolist() for f in q.FACTS), strict=True))
    assert got == [plain(t.encode("utf-8", "replace").decode()) for t in texts]


def test_order_saves_work_but_not_the_verdict():
    texts = [b"word " * 3, " ".join(f"w{i}" for i in range(60)).encode(), " ".join(f"## {i}" for i in range(60)).encode(), "é ".encode() * 90, " ".join(f"année{i}" for i in range(50)).encode()]
    block = q.Block(texts)
    want = ~block.base_failed()
    for r in q.RULES:
        want &= ~r.rejects(block, np.arange(len(texts)))
    assert want.any() and not want.all()
    for order in (q.RULES, q.RULES[::-1]):
        assert np.array_equal(q.cascade(block, order), want)
    seen = []
    spy = q.Rule("spy", lambda b, rows: seen.append(len(rows)) or np.zeros(len(rows), bool))
    q.cascade(block, [*q.RULES, spy])
    assert seen == [int(want.sum())]


def test_rules_are_ordered_by_rejections_per_cost():
    known = {"odd_word_length": (1.0, 0.1), "many_symbols": (0.1, 0.1), "repeated_lines": (1.0, 0.0), "few_letters": (2.0, 0.0), "small_vocabulary": (0.5, 0.4)}
    assert [r.name for r in q.in_order(q.RULES, known)] == ["many_symbols", "small_vocabulary", "odd_word_length", "repeated_lines", "few_letters"]


def test_odd_rows(spark, odd):
    docs = odd("kept string")
    got = {}
    for r in q.quality(docs).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    assert got[2] == got[3] == [(0, 0, 0, 0, 0, True, False)] and len(got[1]) == 2
    assert got[7] == [(30_000, 120_000, 0, 0, 30_000, True, False)]
    assert q.good_documents(docs).columns == docs.columns
    assert q.quality(odd(rows=[])).count() == 0 and q.good_documents(odd(rows=[])).count() == 0
