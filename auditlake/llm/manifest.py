"""Operator 11, Merkle dataset manifest: hash trees over sources, stored as aligned subtrees in van Emde Boas order."""

from __future__ import annotations

import hashlib
import string
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import bound_batches
from auditlake.llm.spelling import crc32_sql
from auditlake.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Children of a node, and levels of edges in a stored subtree: 16 ** 3 = 4,096 leaves each.
FAN, HEIGHT = 16, 3
#: One row in so many, by crc32 of its id, is checked as if its text had been lower-cased.
TAMPERED = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32
#: A way to the root: the siblings left and right of each node on it, as hex text.
WAY = "array<struct<left:string,right:string>>"
#: Addresses by number of levels and fan.
_PLACES: dict[tuple[int, int], list[np.ndarray]] = {}


def addresses(levels: int, fan: int = FAN) -> list[np.ndarray]:
    """By depth, where each node of a full tree of so many levels lies in van Emde Boas order: the tree is cut at half its
    height, the upper part comes first, then the lower parts one after the other, each laid out in the same way."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    upper, lower = addresses(levels // 2, fan), addresses(levels - levels // 2, fan)
    top, each = sum(map(len, upper)), sum(map(len, lower))
    roots = top + each * np.arange(len(upper[-1]) * fan)
    return [*upper, *((roots[:, None] + a[None, :]).reshape(-1) for a in lower)]


def joint(digests: list[bytes]) -> bytes:
    """Hash of the digests' hex texts, one after the other."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


class Subtree:
    """Up to fan ** height leaves under one root. ``tree`` holds all digests in van Emde Boas order; ``counts`` says how
    many nodes of each depth are there."""

    def __init__(self, tree: np.ndarray, n: int, height: int, fan: int = FAN):
        self.tree, self.height, self.fan = tree, height, fan
        if (height, fan) not in _PLACES:
            _PLACES[height, fan] = addresses(height + 1, fan)
        self.place = _PLACES[height, fan]
        self.counts = [-(-n // fan ** (height - d)) for d in range(height + 1)]

    @classmethod
    def of(cls, leaves: list[bytes], height: int, fan: int = FAN) -> Subtree:
        made = cls(np.zeros((sum(fan**d for d in range(height + 1)), DIGEST), np.uint8), len(leaves), height, fan)
        made.tree[made.place[height][: len(leaves)]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, DIGEST)
        for depth in range(height - 1, -1, -1):
            below = made.level(depth + 1)
            for i in range(made.counts[depth]):
                made.tree[made.place[depth][i]] = np.frombuffer(joint(below[i * fan : (i + 1) * fan]), np.uint8)
        return made

    def level(self, depth: int) -> list[bytes]:
        flat = self.tree[self.place[depth][: self.counts[depth]]].tobytes()
        return [flat[i : i + DIGEST] for i in range(0, len(flat), DIGEST)]

    @property
    def root(self) -> bytes:
        return self.tree[self.place[0][0]].tobytes()

    def ways(self) -> Iterator[list[tuple[str, str]]]:
        """For every leaf the siblings left and right of it and of the nodes above it, up to below the root."""
        hexes = [[d.hex() for d in self.level(depth)] for depth in range(self.height + 1)]
        for leaf in range(self.counts[-1]):
            way, at = [], leaf
            for depth in range(self.height, 0, -1):
                first = at - at % self.fan
                row = hexes[depth]
                way.append(("".join(row[first:at]), "".join(row[at + 1 : first + self.fan])))
                at //= self.fan
            yield way


def folded(digest: str, way: list[tuple[str, str]]) -> str:
    """The root that a leaf's digest and its siblings lead to."""
    for left, right in way:
        digest = hashlib.sha256(f"{left}{digest}{right}".encode()).hexdigest()
    return digest


def height_of(n: int, height: int = HEIGHT, fan: int = FAN) -> int:
    """Levels of edges over n nodes in one subtree: as many as it takes, or all of them where n needs several."""
    h = 0
    while h < height and fan**h < n:
        h += 1
    return h


def leaf_hash(docs: DataFrame, text: Column) -> Column:
    """Hash of the fields of a row, with ``text`` in place of its text, as hex."""
    values = [text.cast("string") if f == "text" else F.col(f).cast("string") for f in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def tampered(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % TAMPERED == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """part, doc_id, leaf, forged of every row of ``docs``: the source as a string that sorts null first, the row's digest,
    and that of the tampered row where it is checked for tampering."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    part = F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    forged = F.when(tampered(), F.unhex(leaf_hash(docs, lower)))
    return docs.select(part.alias("part"), "doc_id", F.unhex(leaf_hash(docs, F.col("text"))).alias("leaf"), forged.alias("forged"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with pos, the number of a row in its part by ``order``, and n, the rows of its part.

    Rows are dealt by ranges of (part, order), so a part with a third of all rows lies in many tasks; a row's number is
    its place in its range plus the rows that the ranges before it hold of its part. Rows that agree in all of it
    are told apart by where they were read, so a row that is there a million times doesn't land in one task either."""
    told = rows.withColumn("read_at", F.monotonically_increasing_id())
    dealt = told.repartitionByRange("part", *order, "read_at").sortWithinPartitions("part", *order, "read_at").drop("read_at")
    ranged = materialise(dealt.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("place")), "llm-ranged")
    held = ranged.groupBy("part", "task").agg(F.min("place").alias("first"), F.count("*").alias("held"))
    whole = Window.partitionBy("part")
    before = F.sum("held").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = materialise(held.select("part", "task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("held").over(whole).alias("n")), "llm-starts")
    return ranged.join(starts, ["part", "task"]).select(*rows.columns, (F.col("place") + F.col("shift")).alias("pos"), "n")


def subtrees(rows: DataFrame, height: int, fan: int, extra: list[str]) -> DataFrame:
    """part, block, n, size, tree, root and the ``extra`` columns as arrays, of rows (part, pos, n, leaf, extra): one row
    per aligned subtree, with its digests in van Emde Boas order. Rows go to their block's task, at most fan ** height each."""
    bound_batches(rows.sparkSession)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    dealt = (
        rows.select("part", F.expr(f"pos div {fan**height}").alias("block"), "pos", "n", "leaf", *extra)
        .repartition("part", "block")
        .sortWithinPartitions("part", "block", "pos")
    )
    out = "part string, block long, n long, size int, tree binary, root binary" + "".join(f", {c} array<{types[c]}>" for c in extra)
    names = ["part", "block", "n", "size", "tree", "root", *extra]

    def made(group: pa.Table) -> pa.RecordBatch:
        n = group.column("n")[0].as_py()
        tree = Subtree.of(group.column("leaf").to_pylist(), height_of(n, height, fan), fan)
        one = [group.column("part")[:1].combine_chunks(), group.column("block")[:1].combine_chunks(), pa.array([n], pa.int64()), pa.array([len(group)], pa.int32())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), group.column(c).combine_chunks()) for c in extra]
        arrays = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in [*one, pa.array([tree.tree.tobytes()], pa.binary()), pa.array([tree.root], pa.binary()), *lists]]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and keys[i] != last:
                    yield made(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
                last = keys[i]
        if held:
            yield made(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, out)


def forest(rows: DataFrame, height: int, fan: int, extra: list[str]) -> list[DataFrame]:
    """Subtrees over all rows of every part, then over the roots of its subtrees, and so on until every part has one."""
    levels = []
    while True:
        made = materialise(subtrees(rows, height, fan, extra if not levels else []), f"llm-subtrees{len(levels)}")
        levels.append(made)
        most = made.agg(F.max("n")).first()[0]
        if most is None or most <= fan**height:
            return levels
        above = F.expr(f"(n + {fan**height - 1}) div {fan**height}")
        rows = made.where(F.col("n") > fan**height).select("part", F.col("block").alias("pos"), above.alias("n"), F.col("root").alias("leaf"))


def tops(levels: list[DataFrame], capacity: int) -> list[DataFrame]:
    """By level, (part, block, root) of the parts that are one subtree there."""
    return [level.where(F.col("n") <= capacity).select("part", "block", "root") for level in levels]


def ways_down(level: DataFrame, above: DataFrame, height: int, fan: int, name: str | None = None) -> DataFrame:
    """Ways from the leaves of stored subtrees, given those from their roots (part, block, way, subroot, root).

    A leaf is a subtree of the level below, (part, block), or has the name that the column ``name`` holds for it, which
    is then its ``part``."""
    step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    kept = ["subroot", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in rows_one_by_one(batch):
                upper = [(s["left"], s["right"]) for s in r["way"]]
                ways = pa.array([[{"left": a, "right": b} for a, b in [*way, *upper]] for way in opened(r, height, fan).ways()], step)
                parts = r[name] if name else [r["part"]] * len(ways)
                first = 0 if name else r["block"] * fan**height
                blocks = pa.array([0] * len(ways) if name else range(first, first + len(ways)), pa.int64())
                carried = [pa.array([r[c]] * len(ways), pa.binary()) for c in kept]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), blocks, ways, *carried], names=["part", "block", "way", *kept])

    columns = ["part", "block", "n", "size", "tree", *([name] if name else [])]
    joined = level.select(*columns).join(above, ["part", "block"])
    return joined.mapInArrow(run, f"part string, block long, way {WAY}, subroot binary, root binary")


def rows_one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts, each made when it is asked for: a row may hold a whole subtree."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def opened(row: dict, height: int, fan: int) -> Subtree:
    """A stored subtree."""
    return Subtree(np.frombuffer(row["tree"], np.uint8).reshape(-1, DIGEST), row["size"], height_of(row["n"], height, fan), fan)


def manifest(docs: DataFrame, height: int = HEIGHT, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``.

    A row is a leaf: the hash of its doc_id, source, lang, n_chars and text. Leaves of a source, by doc_id, are joined 16
    by 16 until one is left, its subroot; subroots by source (null first) likewise give the root. ``proof_sha256`` hashes
    all siblings on a leaf's way up, ``folded_root`` is the root that these and the leaf lead to, where one row in five
    (by crc32 of its id) is taken with the letters A-Z of its text lower-cased, and ``verified`` says whether that
    is the root.

    Trees are stored as aligned subtrees of ``height`` levels, each one row with its digests in van Emde Boas order;
    the next level is built over the subtrees' roots, and ways go down in the same steps. A task holds one
    subtree at a time, whatever the size of a source. Texts are never shuffled.

    Null ids come first in their source and aren't tampered with; rows with equal ids are ordered by their leaf, so that
    rows that agree in all fields have the leaves but not the places in common. Other columns aren't read; an empty table
    gives an empty result."""
    capacity, none = fan**height, F.array().cast(WAY)
    hashed = materialise(leaves(docs), "llm-leaves")
    levels = forest(numbered(hashed, ["doc_id", "leaf"]), height, fan, ["doc_id", "forged"])
    own = tops(levels, capacity)
    # The same once more over the roots of the parts, which are the rows of a part without a name.
    roots = materialise(reduce(DataFrame.unionByName, own), "llm-subroots")
    upper = forest(numbered(roots.select(F.lit("").alias("part"), F.col("part").alias("named"), F.col("root").alias("leaf")), ["named"]), height, fan, ["named"])
    way = upper[-1].select("part", "block", none.alias("way"), F.lit(None).cast("binary").alias("subroot"), "root")
    for level in upper[:0:-1]:
        way = materialise(ways_down(level, way, height, fan), "llm-ways")
    of_parts = materialise(ways_down(upper[0], way, height, fan, "named").select("part", "way", "root"), "llm-ways")
    # Down the parts' own trees. A part joins in on the level where it is one subtree.
    way = None
    for level, top in zip(levels[::-1], own[::-1], strict=True):
        joining = top.withColumnRenamed("root", "subroot").join(of_parts, "part").select("part", "block", "way", "subroot", "root")
        above = joining if way is None else joining.unionByName(way)
        if level is not levels[0]:
            way = materialise(ways_down(level, above, height, fan), "llm-ways")
    return verified(levels[0], above, height, fan, docs.schema["doc_id"].dataType.simpleString())


def verified(level: DataFrame, above: DataFrame, height: int, fan: int, id_type: str) -> DataFrame:
    """The rows of the manifest, from the lowest subtrees and the ways above them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r in enumerate(rows_one_by_one(batch)):
                upper = [(s["left"], s["right"]) for s in r["way"]]
                rest = "".join(a + b for a, b in upper).encode()
                tree = opened(r, height, fan)
                digests = [d.hex() for d in tree.level(tree.height)]
                proofs, ends = [], []
                for own, forged, way in zip(digests, r["forged"], tree.ways(), strict=True):
                    proof = hashlib.sha256("".join(a + b for a, b in way).encode())
                    proof.update(rest)
                    proofs.append(proof.hexdigest())
                    ends.append(folded(folded(own if forged is None else forged.hex(), way), upper))
                subroot, root = ([r[c].hex()] * len(ends) for c in ("subroot", "root"))
                arrays = [batch.column("doc_id")[i].values, *(pa.array(x, pa.string()) for x in (digests, subroot, root, proofs, ends)), pa.array([e == r["root"].hex() for e in ends])]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    joined = level.select("part", "block", "n", "size", "tree", "doc_id", "forged").join(above, ["part", "block"])
    return joined.mapInArrow(run, f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _sql(levels: int = 8, source_levels: int = 4) -> str:
    """The same level by level, for sources of up to 16 ** levels rows and up to 16 ** source_levels sources."""

    def field(c: str) -> str:
        v = f"CAST({c} AS VARCHAR)"
        return f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(field(c) if c != "text" else field(text) for c in FIELDS) + ")"

    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    ctes = [
        f"d AS (SELECT doc_id, source, {digest('text')} AS leaf, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % {TAMPERED} = 0 THEN {digest(lower)} END AS forged FROM documents)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
        "a0 AS (SELECT source AS g, pos AS i, leaf AS h FROM r)",
    ]

    def climb(name: str, n_levels: int) -> None:
        for k in range(n_levels):
            ctes.append(
                f"{name}s{k} AS (SELECT g, i // {FAN} AS j, list(h ORDER BY i) AS hs, any_value(m) AS m FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {name}{k}) GROUP BY g, j)"
            )
            ctes.append(f"{name}{k + 1} AS (SELECT g, j AS i, CASE WHEN m = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}s{k})")

    climb("a", levels)
    ctes.append(f"b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, g AS source, h FROM a{levels})")
    climb("b", source_levels)
    ctes.append("w0 AS (SELECT r.doc_id, r.source, r.leaf, r.pos, b0.i AS spos, b0.h AS subroot, coalesce(r.forged, r.leaf) AS x, '' AS proof FROM r JOIN b0 ON b0.source IS NOT DISTINCT FROM r.source)")
    steps = [("a", k, "w.source", "w.pos") for k in range(levels)] + [("b", k, "0", "w.spos") for k in range(source_levels)]
    for number, (name, k, group, place) in enumerate(steps):
        here = f"({place} // {FAN**k})"
        left, right = f"array_to_string(t.hs[1:{here} % {FAN}], '')", f"array_to_string(t.hs[{here} % {FAN} + 2:], '')"
        ctes.append(
            f"w{number + 1} AS (SELECT w.* REPLACE (CASE WHEN t.m = 1 THEN w.x ELSE sha256({left} || w.x || {right}) END AS x, CASE WHEN t.m = 1 THEN w.proof ELSE w.proof || {left} || {right} END AS proof)"
            f" FROM w{number} w JOIN {name}s{k} t ON t.g IS NOT DISTINCT FROM {group} AND t.j = {here} // {FAN})"
        )
    root = f"(SELECT h FROM b{source_levels})"
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, {root} AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = {root} AS verified FROM w{len(steps)}"


SQL = _sql()
