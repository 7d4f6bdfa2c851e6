"""Operator 13: equal to the library, pair tests against plain merging, odd rows."""

import hashlib
import json
import random

import pytest

from auditlake.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load())


def agree(encoder, library, texts):
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode_all(texts) == want
    for ids in want[:2000]:
        assert encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_code_point(encoder, library):
    agree(encoder, library, ["a" + chr(c) + "b1" + chr(c) * 2 + " " + chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000])


def test_random_texts(encoder, library):
    rng = random.Random(1)
    letters = "aaaabe  \n\t'stlldre1290.,<|endoftext|>éßü漢😀́"
    agree(encoder, library, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(5000)])
    pieces = [t.decode("utf-8", "replace") for t in encoder.bytes_of[300:50000:7]]
    agree(encoder, library, ["".join(rng.choice(pieces) for _ in range(8)) for _ in range(5000)])


def test_runs_and_special_strings(encoder, library):
    runs = [u * n for u in ("a", "ab", "aab", " ", "\n", "é", "😀", "!") for n in (*range(1, 40), 1000)]
    agree(encoder, library, [*runs, "", "x" * 70_000, "<|endoftext|>", "a <|endoftext|><|endoftext|> b", "<|endoftext|", "<|endoftext|>" * 3 + "\n"])


def test_pairs_that_fit_are_those_that_merging_leaves(encoder):
    v, rng = bpe.load(), random.Random(2)
    ids = {t: i for i, t in enumerate(v.bytes_of) if i != 50256}
    some = [i for i in range(50256) if 0 < len(v.bytes_of[i]) <= 4]
    fitting = 0
    for _ in range(20_000):
        a, b = rng.choice(some), rng.choice(some[:2000])
        want = v.merged(v.bytes_of[a] + v.bytes_of[b], ids) == [a, b]
        assert encoder.fits(a, b) == want
        fitting += want
    assert 500 < 20_000 - fitting and fitting > 10_000


def test_small_memory_gives_the_same(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    monkeypatch.setattr(bpe, "PAIRS", 20)
    monkeypatch.setattr(bpe, "AT_ONCE", 7)
    agree(bpe.Encoder(bpe.load()), library, [f"some words number {i} and {i * i} <|endoftext|> <|endoftext|>ing" for i in range(300)])
    monkeypatch.setattr(bpe, "TOGETHER", 10)
    assert list(bpe.together([None, "a" * 12, "b", "c"])) == [["", "a" * 12], ["b", "c"]] and list(bpe.together([])) == []


def test_automaton_holds_all_substrings():
    words = [b"abab", b"bab", b"ba", b"cab"]
    a = bpe.SuffixAutomaton(words)
    for w in words:
        assert a.length[a.state(w)] == len(w)
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                assert a.length[a.link[a.state(w[i:j])]] < j - i <= a.length[a.state(w[i:j])]


def test_other_files_are_refused():
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        good = json.load(f)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"decoder": None}, {"model": {**good["model"], "ignore_merges": True}}, {"model": {**good["model"], "type": "Unigram"}}):
        with pytest.raises(ValueError):
            bpe.Vocabulary(json.dumps({**good, **change}))


def test_tables(spark, odd, library):
    docs = odd("ids string")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = bpe.encode_documents(docs)
    assert ids.columns == ["doc_id", "ids"]
    for r in ids.collect():
        assert r.ids == library.encode(text[r.doc_id], add_special_tokens=False).ids
    assert sorted((r.doc_id or 0, r.text) for r in bpe.decode_documents(ids).collect()) == sorted((r.doc_id or 0, r.text or "") for r in docs.collect())
    got = bpe.digests(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        want = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert bpe.digests(odd(rows=[])).count() == 0 and bpe.encode_documents(odd(rows=[])).count() == 0
    assert [r.text for r in bpe.decode_documents(spark.createDataFrame([(1, None, "x")], "doc_id long, ids array<int>, text string")).collect()] == [""]
