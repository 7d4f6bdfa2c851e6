"""Operator 7 against brute force."""

import math

import numpy as np

from auditlake.llm import forest

SCHEMA = "vec_id long, embedding array<float>, node string, weight int"


def vectors(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dims))
    v = centres[rng.integers(len(centres), size=n)] + 0.25 * rng.normal(size=(n, dims))
    v[: n // 3] = centres[0] + 0.12 * rng.normal(size=(n // 3, dims))
    return v.astype(np.float32)


def brute(v):
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(v))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(v)).min(axis=1))
        if (new == label).all():
            return link.sum(axis=1), label
        label = new


def test_one_leaf_is_exact(spark):
    v = vectors(400, 16)
    links, label = brute(v)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in forest.near_vectors(spark.createDataFrame([(i, x.tolist(), "a", 1) for i, x in enumerate(v)], SCHEMA)).collect()}
    assert got == {i: (links[i], label[i], label[i] == i) for i in range(len(v))}


def test_trees_find_nine_in_ten_links_and_no_others(spark):
    v = vectors(3000, 32)
    links, _ = brute(v)
    df = spark.createDataFrame([(i, x.tolist(), "a", 1) for i, x in enumerate(v)], SCHEMA)
    got = {r.vec_id: r.n_links for r in forest.near_vectors(df, leaf=150).collect()}
    assert all(got[i] <= links[i] for i in got)
    assert sum(got.values()) >= 0.9 * links.sum() > 0


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], None, 1), (1, [1.0, 0.0], None, 1), (2, [2.0, 0.0], None, 1), (3, [0.0, 0.0], None, 1), (4, None, None, 1), (5, [1.0, None], None, 1),
        (6, [math.nan, 1.0], None, 1), (7, [math.inf, 1.0], None, 1), (8, [], None, 1), (9, [1.0, 0.0, 0.0], None, 1), (None, [0.0, 1.0], None, 1), (10, [1e-30, 0.0], None, 1), (11, [1e30, 0.0], None, 1),
    ]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in forest.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    want = [(1, 4, 1, True)] * 2 + [(2, 4, 1, False), (10, 4, 1, False), (11, 4, 1, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)] + [(None, 0, None, True)]
    assert got == sorted(want, key=repr)
    assert forest.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_length_is_compared(spark):
    """Lengths beside the commonest have links too, in one leaf or in many."""
    few = [(i, [1.0, 0.5], "a", 1) for i in (1, 2)] + [(3, [2.0, 1.0], "a", 1)] + [(i, [1.0, float(i), 0.0], "a", 1) for i in range(4, 9)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in forest.near_vectors(spark.createDataFrame(few, SCHEMA)).collect()}
    assert [got[i] for i in (1, 2, 3)] == [(2, 1)] * 3
    a, b = vectors(900, 24), vectors(700, 16, seed=4)
    links = [*brute(a)[0], *brute(b)[0]]
    rows = [(i, x.tolist(), "a", 1) for i, x in enumerate([*a, *b])]
    got = {r.vec_id: r.n_links for r in forest.near_vectors(spark.createDataFrame(rows, SCHEMA), leaf=100).collect()}
    assert all(got[i] <= n for i, n in enumerate(links)) and sum(got.values()) >= 0.9 * sum(links)


def test_leaves_keep_every_row_in_every_tree():
    v = forest.unit(vectors(2000, 16))
    trees = forest.fit_forest(v[::4], 200_000, trees=3, leaf=100)
    codes, offsets = forest.leaf_codes(trees, v)
    assert (np.diff(offsets) >= 3).all() and {c >> 48 for c in codes.tolist()} == {0, 1, 2}
    assert trees[0].extra.max() >= 3 and len(trees[0].child) < 200
