"""Operator 11: against the definition read literally, tampering, layout, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from auditlake.llm import manifest as m

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def climb(nodes, fan):
    """Root of digests, and by node the siblings left and right on its way."""
    ways, here = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(here):
            run = at // fan * fan
            ways[i].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + fan])))
            here[i] = at // fan
        nodes = [sha(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], ways


def literal(rows, fan=16):
    def leaf(r, lower):
        text = r[4] if not lower or r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, False), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by[s], key=lambda x: x[:3])], fan) for s in sources}
    root, tops = climb([trees[s][0] for s in sources], fan) if sources else (None, [])
    out = []
    for s, above in zip(sources, tops, strict=True):
        for (_, _, own, r), way in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            at = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for left, right in [*way, *above]:
                at = sha(left, at, right)
            out.append((r[0], own, trees[s][0], root, sha(*(x + y for x, y in [*way, *above])), at, at == root))
    return sorted(out, key=repr)


def rows_of(n, n_sources, seed=3):
    rng = random.Random(seed)
    names = [None, "", "é", "zeta", "Z", *(f"s{i}" for i in range(n_sources))]
    return [(i * 7 % n, rng.choice(names) if rng.random() < 0.6 else "hot", rng.choice(["en", None]), rng.choice([5, None]), rng.choice(["Ab cd", "é Ü", "", None, "x" * 50])) for i in range(n)]


@pytest.mark.parametrize(("n", "n_sources", "height", "fan"), [(700, 30, 3, 16), (700, 30, 1, 16), (300, 3, 2, 2), (40, 100, 1, 3), (1, 0, 3, 16), (17, 0, 1, 16)])
def test_agrees_with_the_definition(spark, n, n_sources, height, fan):
    rows = rows_of(n, n_sources)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    got = sorted(map(tuple, m.manifest(docs, height, fan).select(*COLUMNS).collect()), key=repr)
    assert got == literal(rows, fan)


def test_only_what_was_changed_fails(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(500)], "doc_id long, source string, lang string, n_chars long, text string")
    for r in m.manifest(docs).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 5 != 0 or r.doc_id % 2 == 0)


@pytest.mark.parametrize(("levels", "fan"), [(1, 16), (2, 16), (4, 16), (5, 2), (7, 2), (6, 3)])
def test_layout_has_every_place_once_and_keeps_subtrees_together(levels, fan):
    place = m.addresses(levels, fan)
    assert [len(p) for p in place] == [fan**d for d in range(levels)]
    flat = sorted(int(x) for p in place for x in p)
    assert flat == list(range(len(flat)))
    lower = levels - levels // 2
    if levels > 1:
        size = sum(fan**d for d in range(lower))
        for i, top in enumerate(place[levels // 2]):
            inside = {int(x) for d in range(lower) for x in place[levels // 2 + d][i * fan**d : (i + 1) * fan**d]}
            assert inside == set(range(int(top), int(top) + size))


def test_stored_subtree_gives_siblings():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(37)]
    tree = m.Subtree.of(leaves, 2)
    want, ways = climb([x.hex() for x in leaves], 16)
    assert tree.root.hex() == want and list(tree.ways()) == ways
    again = m.Subtree(tree.tree.copy(), 37, 2)
    assert again.root == tree.root and m.folded(leaves[5].hex(), ways[5]) == want


def test_odd_rows(spark, odd):
    for extra in ("leaf string", "part string", "pos string"):
        docs = odd(extra)
        got = sorted(map(tuple, m.manifest(docs).select(*COLUMNS).collect()), key=repr)
        assert got == literal([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])
    assert m.manifest(odd(rows=[])).count() == 0
    # A row that is there many times.
    many = odd(rows=[(1, "t", "en", "s", 1, None)] * 300)
    assert {r.subroot for r in m.manifest(many, 1).collect()} == {literal([(1, "s", "en", 1, "t")] * 300)[0][2]}
