"""Operator 3 against brute force over sets of word 5-grams."""

import random

import numpy as np
import pytest

from auditlake.llm import blockpairs, minhash


def grams(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """n_links and class_id by row index."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, links[i], least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(n):
        kind = i % 4
        w = list(base) if kind < 2 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 150))]
        if kind == 1:
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows


def check(spark, rows, **options):
    got = minhash.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    return sorted(((r.doc_id, r.n_links, r.class_id) for r in got.collect()), key=repr)


def test_links_and_classes_match_brute_force(spark):
    rows = corpus(240)
    assert check(spark, rows, recall=0.9999999) == brute(rows)


def test_blocks_give_the_same_answer(spark, monkeypatch):
    monkeypatch.setattr(blockpairs, "BLOCK_ROWS", 7)
    rows = corpus(120, 5)
    assert check(spark, rows, recall=0.9999999) == brute(rows)


def test_odd_rows(spark, odd):
    got = minhash.jaccard_join(odd())
    assert got.columns == ["doc_id", "copy_of", "n_copies", "n_links", "class_id", "kept"]
    by_id = {}
    for r in got.collect():
        by_id.setdefault(r.doc_id, []).append((r.n_copies, r.n_links, r.class_id, r.kept))
    assert by_id[1] == [(2, 1, 1, True)] * 2
    assert by_id[2] == [(1, 0, 2, True)] and by_id[3] == [(1, 0, 3, True)] and by_id[4] == [(1, 0, 4, True)]
    assert by_id[None] == [(1, 0, None, True)]
    assert sum(map(len, by_id.values())) == 11


def test_one_of_each_keeps_columns_and_one_row(spark, odd):
    docs = odd("key string")
    kept = minhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 2, 3, 4, None, 5, 6, 7, 8, 9], key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.jaccard_join(empty).count() == 0 and minhash.one_of_each(empty).count() == 0


def test_bands_reach_the_recall():
    for recall in (0.9, 0.99, 0.9999):
        bands, rows = minhash.bands_and_rows(recall=recall)
        assert 1 - (1 - 0.8**rows) ** bands >= recall and bands * rows <= minhash.MAX_HASHES
    with pytest.raises(ValueError):
        minhash.bands_and_rows(recall=1 - 1e-15, most=2)


def test_overlaps_count_common_values():
    rng = np.random.default_rng(0)
    sides = []
    for n in (30, 17):
        lists = [np.unique(rng.integers(0, 20_000, rng.integers(0, 900))) for _ in range(n)]
        sides.append((lists, np.concatenate(lists), np.cumsum([0, *map(len, lists)])))
    (la, av, ao), (lb, bv, bo) = sides
    assert np.array_equal(blockpairs.overlaps(av, ao, bv, bo), [[len(np.intersect1d(x, y)) for y in lb] for x in la])
    same = blockpairs.overlaps(av, ao, av, ao)
    assert all(same[i, j] == len(np.intersect1d(la[i], la[j])) for i in range(30) for j in range(30) if i != j)
