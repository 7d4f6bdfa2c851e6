"""Operator 2: gradients against differences, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np

from auditlake.llm import language

SF = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = language.Net(3, units=4)
    x, real = language.padded([b"abcde", b"xy", b"hello"], 5)
    lang = np.array([0, 2, 1])
    _, g = net.gradients(x, lang, real)
    for name, w in net.w.items():
        for _ in range(6):
            at = tuple(rng.integers(n) for n in w.shape)
            if name == "x":
                at = (at[0], at[1], int(x[0, 0]))
            old, ends = w[at], []
            for step in (1e-2, -1e-2):
                w[at] = old + step
                ends.append(net.gradients(x, lang, real)[0])
            w[at] = old
            assert abs((ends[0] - ends[1]) / 2e-2 - g[name][at]) < 5e-3, name


def test_every_position_counts_and_windows_cover_long_texts():
    net = language.Net(3)
    texts = [b"", b"a", b"some words " * 40, bytes(range(32, 127)) * 5]
    p = language.pooled(net, texts)
    assert np.allclose(p.sum(axis=1), [0, 1, 1, 1], atol=1e-5)
    for t, got in zip(texts[1:], p[1:], strict=True):
        total = 0
        for i in range(0, len(t), language.WINDOW):
            x = np.frombuffer(t[i : i + language.WINDOW], np.uint8)[:, None]
            real = np.ones(x.shape, bool)
            total = total + net.probabilities(net.states(x, real, 0), net.states(x, real, 1)).sum(axis=(0, 2))
        assert np.allclose(total / len(t), got, atol=1e-5)


def test_held_out_accuracy(spark, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 250)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identify(docs).toPandas()
    truth = docs.select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert len(got) == len(truth) and ((got.score >= 0) & (got.score <= 1)).all()
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95


#: Sentences of languages that the tables don't hold.
FOREIGN = [
    "Suomen kieli kuuluu itämerensuomalaisiin kieliin ja sitä puhutaan pääosin Suomessa, missä se on toinen virallisista kielistä.",
    "Türkçe, Güneydoğu Avrupa ve Batı Asya'da konuşulan, Türk dilleri dil ailesine ait sondan eklemeli bir dildir ve çok sayıda lehçesi vardır.",
    "Русский язык является одним из восточнославянских языков и национальным языком русского народа, на нём говорят во многих странах мира.",
    "日本語は、日本国内や、かつての日本領だった国、そして国外移民や移住者を含む日本人同士の間で使用されている言語である。",
    "Język polski należy do grupy zachodniosłowiańskiej i jest językiem urzędowym w Polsce oraz jednym z języków Unii Europejskiej.",
    "A magyar nyelv az uráli nyelvcsalád tagja, a finnugor nyelvek közé tartozó ugor nyelvek egyike, legközelebbi rokonai a manysi és a hanti.",
    "한국어는 대한민국과 조선민주주의인민공화국의 공용어이며 세계 여러 지역의 한민족 사회에서 널리 쓰이는 언어이다.",
    "Tiếng Việt là ngôn ngữ của người Việt và là ngôn ngữ chính thức tại Việt Nam, được dùng bởi phần lớn dân số của nước này.",
]


def test_foreign_and_garbled_texts_are_rejected_and_clean_ones_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rng = random.Random(6)
    garbled = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz      ") for _ in range(rng.randint(80, 2000))) for _ in range(60)]
    foreign = [" ".join(rng.sample(t.split(), len(t.split()))) if i % 3 else t for t in FOREIGN for i in range(5)]
    texts = [*garbled, *foreign]
    planted = spark.createDataFrame([(10**9 + i, t, None, None, None) for i, t in enumerate(texts)], docs.schema)
    kept = language.known_language(docs.unionByName(planted))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    wrong = [t[:40] for i, t in enumerate(texts) if 10**9 + i in ids]
    assert len(wrong) <= 0.1 * len(texts), wrong
    assert sum(i < 10**9 for i in ids) >= 0.98 * docs.count()


def test_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 40)
    docs = odd("lang_pred string")
    got = {}
    for r in language.identify(docs).collect():
        got.setdefault(r.doc_id, []).append(tuple(r))
    for i in (2, 3, 4, 5):
        assert got[i][0][2:] == ("und", 0.0)
    assert len(got[1]) == 2 and got[1][0] == got[1][1] and got[1][0][2] in ("en", "de")
    assert got[None][0][1] is False
    assert language.known_language(docs).columns == docs.columns
    assert language.identify(odd(rows=[])).count() == 0
    nothing = docs.withColumn("lang", docs.lang.substr(0, 0)).where("doc_id = 1").withColumn("lang", docs.source.cast("string")).where("lang is null")
    assert language.identify(nothing).count() == 0
    unlabelled = odd(rows=[(1, "some words", None, None, None, None)])
    assert [tuple(r) for r in language.identify(unlabelled).collect()] == [(1, zlib.crc32(b"1") % 4 == 2, "und", 0.0)]
