"""Operator 6 against plain dynamic programming and the library's unigram model over the same scores."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.llm import pieces as p

SF = "/root/testdata/sf0.01"
FOREIGN = ["", "  a  b ", "日本語テスト\n\n \U0001f600 \t tab", "é" * 60, "a" * 100, "naïve — “quote”", "x\0y", "$$$$ ###", "word.\nNext line\r\n", "   "]


@pytest.fixture(scope="module")
def encoder():
    with open(p.default_model(), "rb") as f:
        return p.Encoder(p.read_model(f.read()))


def plain(enc, text):
    """Best sum of scores by the textbook recursion, over the whole marked text."""
    if not text:
        return 0.0
    s = p.MARK + text.replace(" ", p.MARK)
    known = {w: enc.score[i] for i, (w, k) in enumerate(zip(enc.text, enc.kind, strict=True)) if k in (p.NORMAL, p.USER)}
    best = [0.0] + [-1e30] * len(s)
    for j in range(1, len(s) + 1):
        best[j] = best[j - 1] + enc.fallback
        for i in range(max(0, j - enc.trie.longest), j):
            if s[i:j] in known:
                best[j] = max(best[j], best[i] + known[s[i:j]])
    return best[-1]


def value(enc, ids):
    """Sum of scores of ids, with a fallback for each character spelled in bytes."""
    spelled = bytes(int(enc.text[i][3:5], 16) for i in ids if enc.kind[i] == p.BYTE)
    return sum(enc.score[i] for i in ids if enc.kind[i] != p.BYTE) + enc.fallback * len(spelled.decode())


def test_best_sum(encoder):
    for text in FOREIGN + ["hello world, this is a test of the encoder", "Straße façade 12345"]:
        ids = encoder.encode([text])[0].tolist()
        assert value(encoder, ids) == pytest.approx(plain(encoder, text))
        assert encoder.decode(ids) == text


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_characters=p.MARK, exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=5))
def test_round_trip(encoder, texts):
    ids, offsets = encoder.encode(texts)
    assert [b.decode() for b in encoder.decode_many(ids, offsets)] == texts


def test_many_and_one_agree(encoder):
    chunks = ["▁hello", "▁▁▁x", "zzzz", "▁naïve", "\n", "▁日本", "▁-------"]
    assert [x.tolist() for x in encoder.solve_many(chunks)] == [encoder.solve_one(c) for c in chunks]


def test_trie_holds_exactly_its_words():
    words = {"a": 0, "ab": 1, "abc": 2, "b": 3, "日本": 4, "日": 5}
    trie = p.Trie(words)

    def find(w):
        state = 0
        for c in trie.codes(w).tolist():
            to = int(trie.base[state]) + c
            if not c or trie.check[to] != state:
                return -1
            state = to
        return int(trie.value[state])

    assert {w: find(w) for w in words} == words
    assert find("ac") == find("bc") == find("x") == find("本") == -1


def test_library_agrees(spark, encoder):
    sentencepiece = pytest.importorskip("sentencepiece")

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(tag, body):
        return bytes([tag]) + number(len(body)) + body

    model = b"".join(field(10, field(10, w.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + number(int(k))) for w, s, k in zip(encoder.text, encoder.score, encoder.kind, strict=True))
    # Unigram with byte fallback; no normalisation, a blank in front, blanks kept.
    model += field(18, b"\x18\x01\x98\x02\x01") + field(26, field(10, b"identity") + b"\x18\x01\x20\x00")
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 5 = 0").select("text").collect()]
    for t in texts:
        ours, theirs = encoder.encode([t])[0].tolist(), library.encode(t, num_threads=1)
        assert ours == theirs or value(encoder, ours) == pytest.approx(value(encoder, theirs), abs=1e-2)


def test_odd_rows(spark, odd):
    got = {}
    for r in p.encode_documents(odd("ids string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert all(len(r.ids) == r.n_pieces for rows in got.values() for r in rows)
    assert got[2][0].n_pieces == got[3][0].n_pieces == 0 and got[2][0].round_trip
    assert not got[9][0].round_trip and all(r.round_trip for i, rows in got.items() if i != 9 for r in rows)
    assert got[9][0].n_byte_pieces >= 4
    assert p.encode_documents(odd(rows=[])).count() == 0
