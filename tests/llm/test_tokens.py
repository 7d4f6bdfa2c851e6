"""Operator 9 against the library on whole texts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import tokens

SF = "/root/testdata/sf0.01"
PARTS = [" ", "\n", "\x0b", "\x1c", "\x85", " ", "<|endoftext|>", "<|startoftext|>", "it's", "'S", "É", "é", "́", "!!", "123", "İ", "\U0001f600", "日本", "\0", "<|endof", "word"]


@pytest.fixture(scope="module")
def counter():
    with open(tokens.default_tokenizer(), encoding="utf-8") as f:
        return tokens.PieceCounter(f.read())


def whole(counter, text):
    return len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=5)), max_size=12).map("".join))
def test_any_text(counter, text):
    assert counter.counts([text]) == [whole(counter, text)]


def test_documents_and_a_small_memory(spark, counter, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 500)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 0")
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: (len(r.text.encode()), whole(counter, r.text), whole(counter, r.text) > 2048) for r in rows}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs).collect()} == want


def test_odd_rows(spark, odd, counter):
    docs = odd("n_tokens string")
    want = sorted(((r.doc_id, whole(counter, r.text or "")) for r in docs.collect()), key=repr)
    got = tokens.token_counts(docs)
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=repr) == want
    assert tokens.token_counts(odd(rows=[])).count() == 0
