"""Operator 1: derived queries and the index against plain scans."""

import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import secrets as s


def plain(text, rules=s.RULES):
    out = [(m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text, re.ASCII) if m.end(r.group) - m.start(r.group) >= r.least]
    return sorted(out)


def test_queries():
    assert s.trigram_query(r"[0-9a-f]+") == []
    assert s.trigram_query(r"AKIA[A-Z0-9]+") == [frozenset({frozenset({b"aki", b"kia"})})]
    assert s.trigram_query(r"abc|abd|xyz") == [frozenset({frozenset({b"abc"}), frozenset({b"abd"}), frozenset({b"xyz"})})]
    assert s.trigram_query(r"(?:abc)?x") == [] and s.trigram_query(r"a.c") == []
    assert s.trigram_query(r"(?:ab){2}[^q]+cde") == [frozenset({frozenset({b"aba", b"bab"})}), frozenset({frozenset({b"cde"})})]
    assert s.trigram_query(r"(?:abc\w+|\d)z") == []


PIECES = ["password", "PASSWD=", "api_key", "apikey: '", "token", '" : "', " = ", "AKIA", "ABCDEFGH01234567", "deadbeef", "0123456789abcdef", "é", "\n", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "A1b2C3d4" * 5, "xoxb-", "sk_live_", "eyJhbGciOi", ".", " ", "\0"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from(PIECES), st.text(string.printable + "éß", max_size=4)), max_size=14).map("".join), min_size=1, max_size=6))
def test_index_finds_what_plain_scans_find(texts):
    assert s.scan(texts, [t.encode() for t in texts], s.RULES) == [plain(t) for t in texts]


def test_odd_rows(spark, odd):
    got = {}
    for r in s.secret_spans(odd("spans string")).collect():
        got.setdefault(r.doc_id, []).append((r.n_assign, r.n_hex, r.spans))
    assert got[2] == [(0, 0, "")] and got[3] == [(0, 0, "")]
    text = [r.text for r in odd().where("doc_id = 9").collect()][0]
    assert got[9][0][2] == s.listed(plain(text), s.RULES) and got[9][0][:2] == (1, 1)
    assert s.secret_spans(odd(rows=[])).count() == 0


def test_redaction(spark, odd):
    docs = odd("clean string")
    out = {r.doc_id: r for r in s.redacted(docs).where("doc_id is not null").collect()}
    assert s.redacted(docs).columns == docs.columns
    assert out[9].text.endswith("[SECRET]\"") and "aaaa" not in out[9].text
    assert out[2].text is None and out[6].text == "one two three"
    assert s.joined([(0, 0, 5), (3, 1, 9), (12, 0, 14)]) == [(0, 9), (12, 14)]
