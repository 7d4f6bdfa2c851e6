"""Operator 12: pairs against brute force, forms and roots by hand, odd rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from auditlake.llm import spelling as s


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def literal(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


def edited(word, rng, letters):
    i = rng.randrange(len(word) + 1)
    return rng.choice([word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :], word[:i] + word[i + 1 :]])


@pytest.mark.parametrize("letters", ["ab", "abcdefé", "abcdefghijklmnopqrstuvwxyzàÿß"])
def test_pairs_against_brute_force(spark, letters):
    """Small alphabets make crowded neighbourhoods and anagrams; no pair is lost, none is too many."""
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(150)}
    words |= {edited(w, rng, letters) for w in list(words)} | {"a" * n for n in range(6, 14)}
    words = sorted(words)
    got = {(r.a, r.b) for r in s.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()}
    pairs = {tuple(sorted(p)) for p in got}
    assert len(pairs) == len(got) and pairs == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}


def test_signatures_of_any_letters():
    words = ["漢字仮名交じり文", "漢字仮名交り文", "x" * 5000, "x" * 4999, "y" + "x" * 4999]
    keys = s.signatures(words)
    half = keys.shape[1] // 2
    for a, b in ((1, 0), (3, 2), (2, 4), (3, 4)):
        same = len(words[a]) == len(words[b])
        assert (keys[a, :half] == (keys[b, :half] if same else keys[b, half:])).any()


def test_forms_and_roots(spark):
    text = ["kaffeebar"] * 400 + ["kaffeebars"] * 40 + ["kaffeeebars"] * 4 + ["kaffebar"] * 2 + ["Kaffeebaß"] * 3 + ["tischbein"] * 3 + ["tischbeim"] * 3
    rows = [(None, " ".join(text)), (7, None), (8, ""), (9, "kurz Kürzel"), (9, "×÷×÷×÷×÷ ×÷×÷×÷×÷")]
    want = literal(rows)
    got = rows_of(s.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == want
    by = {r[0]: r for r in want}
    assert by["kaffeeebars"][1:3] == ("kaffeebars", "kaffeebar") and by["tischbein"][1:3] == (None, "tischbein")


def test_corpus_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé") for _ in range(8)) for _ in range(60)]
    rows = []
    for i in range(300):
        words = [rng.choice(base[:6]) if rng.random() < 0.8 else rng.choice(base) for _ in range(30)]
        words = [edited(w, rng, "abcdé") if rng.random() < 0.1 else w for w in words]
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words)))
    assert rows_of(s.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == literal(rows)


def test_small_memory_counts_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "wortlaut wortlaute anderes") for i in range(50)], "doc_id long, text string")
    want = sorted(map(tuple, s.word_counts(docs).collect()))
    monkeypatch.setattr(s, "HELD_WORDS", 2)
    assert sorted(map(tuple, s.word_counts(docs).collect())) == want


def test_odd_rows(spark, odd):
    for extra in ("word string", "n string"):
        docs = odd(extra)
        assert rows_of(s.variants(docs)) == literal([(r.doc_id, r.text) for r in docs.collect()])
    assert s.variants(odd(rows=[])).count() == 0
    long = odd(rows=[(1, "x" * 70_000 + " " + "x" * 70_000 + " " + ("x" * 69_999 + "y ") * 2, "en", "s", 1, "x")])
    assert [r.n_near for r in s.variants(long).collect()] in ([1, 1], [])
