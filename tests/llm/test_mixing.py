"""Operator 4: targets, balance, and that nothing exceeds its limit."""

import random

import pytest

from auditlake.llm import mixing as m


def literal_targets(sizes):
    """The rule read literally: shares by weight, what is above three times a source's size goes to the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        out = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / share for s in order}
        over = {s for s in order if s not in full and out[s] > 3 * sizes[s]}
        if not over or len(over) + len(full) == len(order):
            return out
        full |= over


def test_targets(spark):
    def got(sizes):
        rows = m.with_targets(spark.createDataFrame(list(sizes.items()), "source string, words long")).collect()
        assert [r.source for r in sorted(rows, key=lambda r: r.source_no)] == sorted(sizes, key=lambda s: (s is None, s or ""))
        return {r.source: r.target for r in rows}

    # Weights a:1 b:2 c:3 null:1 over 700 words; c stops at 3 * 20, what is over goes to the others by 1:2:1.
    assert got({"b": 300, "a": 200, None: 180, "c": 20}) == {"a": 160.0, "b": 320.0, "c": 60.0, None: 160.0}
    assert got({"a": 0}) == {"a": 0.0} and got({}) == {}
    assert got({"a": 0, "b": 10}) == {"a": 0.0, "b": 10.0}
    # Sources that stop one after the other.
    many = {f"s{i:03}é": 3**i for i in range(25)} | {f"t{i}": i for i in range(200)}
    want = literal_targets(many)
    assert got(many) == pytest.approx(want)


def test_reruns_agree_on_any_layout(spark):
    """200 sources; shuffle partitions and the way rows are dealt decide nothing."""
    rng = random.Random(2)
    rows = [(i, "w " * int(rng.lognormvariate(3, 1)), "hot" if i % 3 == 0 else f"s{rng.randrange(200)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for partitions, layout in ((1, docs), (3, docs.repartition(5)), (200, docs), (4, docs.orderBy("text")), (3, docs.repartition(2, "source"))):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            results.append(sorted(map(tuple, m.mixture(layout).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert all(r == results[0] for r in results)
    sizes, target, source = {}, {}, {i: s for i, _, s in rows}
    for r in results[0]:
        sizes[source[r[0]]], target[source[r[0]]] = r[2], r[3]
    assert target == pytest.approx(literal_targets(sizes))


def test_flight_keeps_both_sums_and_expectations():
    rng = random.Random(4)
    size = [float(int(rng.lognormvariate(4, 1)) + 1) for _ in range(60)]
    p = [rng.random() for _ in size]
    mean = [0.0] * len(p)
    for seed in range(600):
        q = m.flight(p, size, random.Random(seed))
        assert sum(q) == pytest.approx(sum(p)) and sum(x * s for x, s in zip(q, size, strict=True)) == pytest.approx(sum(x * s for x, s in zip(p, size, strict=True)))
        assert sum(0 < x < 1 for x in q) <= 2 and all(0 <= x <= 1 for x in q)
        mean = [a + b / 600 for a, b in zip(mean, q, strict=True)]
    assert max(abs(a - b) for a, b in zip(mean, p, strict=True)) < 0.12


def test_equal_sizes_and_tiny_groups():
    for n in range(5):
        q = m.landing(m.flight([0.5] * n, [3.0] * n, random.Random(1)), [3.0] * n, 1.5 * n)
        assert set(q) <= {0.0, 1.0} and abs(3 * sum(q) - 1.5 * n) <= 1.5


def documents(n, seed=9):
    rng = random.Random(seed)
    return [(i, "w " * int(rng.lognormvariate(3, 1)), "hot" if i % 3 else f"s{i % 7}") for i in range(n)]


@pytest.mark.parametrize("units", [2000, 100])
def test_sources_come_near_their_targets(spark, monkeypatch, units):
    monkeypatch.setattr(m, "FLIGHT_UNITS", units)
    docs = spark.createDataFrame(documents(3000), "doc_id long, text string, source string")
    rows = m.mixture(docs).collect()
    assert len(rows) == 3000 and all(0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0) for r in rows)
    source = {i: s for i, _, s in documents(3000)}
    for s in set(source.values()):
        of = [r for r in rows if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 5 and sum(r.size for r in of) == of[0].source_size
    again = m.mixture(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_the_mix_repeats_rows(spark):
    docs = spark.createDataFrame([(*r, i % 5) for i, r in enumerate(documents(400))], "doc_id long, text string, source string, mix_key int")
    want = {r.doc_id: r.taken // r.size for r in m.mixture(docs).collect() if r.taken}
    mix = m.mixed_documents(docs)
    assert mix.columns == docs.columns
    got = {}
    for r in mix.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want


def test_odd_rows(spark, odd):
    docs = odd("size string")
    rows = m.mixture(docs).collect()
    assert len(rows) == docs.count() and {r.doc_id: r.taken for r in rows if r.doc_id in (2, 3, 4)} == {2: 0, 3: 0, 4: 0}
    assert m.mixture(odd(rows=[])).count() == 0 and m.mixed_documents(odd(rows=[])).count() == 0
    assert m.mixed_documents(docs).columns == docs.columns
    assert m.mixture(odd(rows=[(1, None, None, None, None, None)])).collect()[0].taken == 0
