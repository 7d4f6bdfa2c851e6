"""Operator 7, embedding near-dedup: a forest of random-projection trees finds candidates, cosines decide."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from auditlake.llm.blockpairs import bucket_lists, pair_links
from auditlake.llm.common import mixed, with_batch_columns
from auditlake.llm.components import components
from auditlake.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.95
TREES = 6
#: Share of a node's vectors on each side of a split that go to both children, at most.
SPILL = 0.03
#: Expected vectors in a leaf before spill.
LEAF = 1024
#: Vectors on which the splits are fitted, and the fewest in a node that still gets splits of its own.
FIT_ROWS, FIT_LEAST = 20_000, 32
#: Directions that a node chooses from, and quantiles between which it looks for a cut: near the middle, and further
#: out where even the best cut there comes near to more than this share of its vectors.
TRIES, MIDDLE, WIDE, CROWDED = 12, (0.4, 0.6), (0.1, 0.9), 0.35
#: A node stays whole where every cut comes near to more than this share.
COHESIVE = 0.5


class Tree:
    """Splits of one tree. A fitted node has a direction and a zone of its own; rows inside the zone go to both sides.

    Of some random directions a node takes that whose emptiest place near the middle parts fewest near vectors, and one
    further out if the middle is crowded, so that a hot cluster isn't cut through; a node that is one tight cluster
    stays a leaf, however large. Nodes are split until the share of the table they stand for is small. Where the sample
    is too small for that, a fitted leaf is split further along random directions that all leaves share, with zones from
    its own vectors: the tree gets as deep as the table needs while its size depends on the sample only."""

    def __init__(self, sample: np.ndarray, n_vectors: int, leaf: int, spill: float, rng: np.random.Generator):
        n_dims = sample.shape[1]
        self.spill, self.leaf, self.rng = spill, leaf, rng
        self.scale = n_vectors / max(len(sample), 1)
        # Vectors at the threshold differ by this much along a random direction, as a standard deviation.
        self.reach = math.sqrt((2 - 2 * THRESHOLD) / max(n_dims, 1))
        deepest = self._levels(min(len(sample), 2 * FIT_LEAST)) if len(sample) else 0
        self.shared = _directions(rng, deepest, n_dims)
        self.direction: list[np.ndarray] = []
        #: By node: ends of its zone; of a leaf, its levels along shared directions, and the ends for each.
        self.zone: list[tuple[float, float]] = []
        self.extra: list[int] = []
        self.leaf_zone: list[np.ndarray] = []
        self.child: list[tuple[int, int]] = []
        self._grow(sample)
        self.direction, self.zone, self.child = np.stack(self.direction), np.array(self.zone), np.array(self.child)
        self.extra, self.leaf_zone = np.array(self.extra), np.stack(self.leaf_zone)

    def _levels(self, n: int) -> int:
        """Halvings that n sampled vectors' share of the table still needs."""
        return max(0, min(40, math.ceil(math.log2(max(n, 1) * self.scale / self.leaf))))

    def _grow(self, sample: np.ndarray) -> int:
        me, n = len(self.child), len(sample)
        self.child.append((me, me))
        self.direction.append(np.zeros(sample.shape[1]))
        self.zone.append((np.inf, np.inf))
        self.extra.append(0)
        self.leaf_zone.append(np.zeros((2, len(self.shared))))
        if n * self.scale <= self.leaf:
            return me
        if n < 2 * FIT_LEAST:
            self._end(me, sample)
            return me
        share, direction, cut = self._best(sample, MIDDLE)
        if share > CROWDED:
            share, direction, cut = self._best(sample, WIDE)
        if share > COHESIVE:
            return me
        # The zone is as wide as near vectors may differ, but holds no more than its share of the rows.
        p = sample @ direction
        half = min(self.reach, float(np.sort(np.abs(p - cut))[min(n - 1, int(2 * self.spill * n))]))
        left = p < cut
        if left.any() and not left.all():
            self.direction[me], self.zone[me] = direction, (cut - half, cut + half)
            self.child[me] = (self._grow(sample[left]), self._grow(sample[~left]))
        return me

    def _end(self, me: int, sample: np.ndarray) -> None:
        """A fitted leaf that stands for too many vectors yet."""
        self.extra[me] = min(self._levels(len(sample)), len(self.shared))
        proj = sample @ self.shared.T
        zone = np.quantile(proj, [0.5 - self.spill, 0.5 + self.spill], axis=0)
        zone[:, (np.abs(proj - np.median(proj, axis=0)) <= self.reach).mean(axis=0) > COHESIVE] = np.inf
        self.leaf_zone[me] = zone

    def _best(self, sample: np.ndarray, where: tuple[float, float]) -> tuple[float, np.ndarray, float]:
        """Share of vectors that a cut comes near to, direction and place of the best cut between two quantiles."""
        tries = _directions(self.rng, TRIES, sample.shape[1])
        proj, n = np.sort(sample @ tries.T, axis=0), len(sample)
        places = np.unique(np.linspace(where[0] * n, where[1] * n, 33).astype(int)).clip(1, n - 1)
        best = (np.inf, tries[0], 0.0)
        for k in range(TRIES):
            cut = (proj[places - 1, k] + proj[places, k]) / 2
            near = np.searchsorted(proj[:, k], cut + self.reach) - np.searchsorted(proj[:, k], cut - self.reach)
            i = int(near.argmin())
            best = min(best, (near[i] / n, tries[k], float(cut[i])), key=lambda x: x[0])
        return best

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaf codes; a row inside a zone is on both sides."""
        common = vectors @ self.shared.T
        row = np.arange(len(vectors))
        node, inside, code = (np.zeros(len(row), dtype=np.int64) for _ in range(3))
        code += 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(row):
            fitted = self.child[node, 0] != node
            ended = ~fitted & (inside >= self.extra[node])
            done.append((row[ended], code[ended]))
            row, node, inside, code, fitted = (x[~ended] for x in (row, node, inside, code, fitted))
            at = np.minimum(inside, max(len(self.shared) - 1, 0))
            own = np.einsum("ij,ij->i", vectors[row], self.direction[node])
            p = np.where(fitted, own, common[row, at]) if len(self.shared) else own
            low = np.where(fitted, self.zone[node, 0], self.leaf_zone[node, 0, at]) if len(self.shared) else self.zone[node, 0]
            high = np.where(fitted, self.zone[node, 1], self.leaf_zone[node, 1, at]) if len(self.shared) else self.zone[node, 1]
            left, right = p <= high, p >= low
            right |= ~left
            inside = inside + ~fitted
            sides = [(row[s], self.child[node[s], k], inside[s], code[s] * 2 + k) for k, s in enumerate((left, right))]
            row, node, inside, code = (np.concatenate(x) for x in zip(*sides, strict=True))
        return np.concatenate([r for r, _ in done]), np.concatenate([c for _, c in done])


def _directions(rng: np.random.Generator, n: int, n_dims: int) -> np.ndarray:
    d = rng.normal(size=(n, n_dims))
    return d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first so that squares neither overflow nor vanish."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column in which all lists have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def close_vectors(a: pa.Table, b: pa.Table) -> np.ndarray:
    ca, cb = a.column("vector").chunk(0), b.column("vector").chunk(0)
    la, lb = lengths(ca), lengths(cb)
    out = np.zeros((len(la), len(lb)), dtype=bool)
    for n in np.intersect1d(la, lb):
        i, j = np.flatnonzero(la == n), np.flatnonzero(lb == n)
        va = unit(matrix(ca.take(pa.array(i))))
        vb = va if a is b else unit(matrix(cb.take(pa.array(j))))
        out[np.ix_(i, j)] = va @ vb.T >= THRESHOLD
    return out


def lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().to_numpy(zero_copy_only=False)


def leaf_codes(trees: list[Tree], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat codes over all trees and offsets by row; a code also tells its tree."""
    found = [(row, code + (i << 48)) for i, t in enumerate(trees) for row, code in [t.leaves(vectors)]]
    row, code = np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])
    order = np.argsort(row, kind="stable")
    return code[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(vectors)))])


def leaf_lists(forests: dict[int, list[Tree]], column: pa.Array) -> pa.Array:
    """Buckets of every vector: codes of its leaves in the forest of its length, told apart by length. Lengths without a
    forest are one leaf each."""
    size = lengths(column)
    rows, codes = [], []
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        if n in forests:
            code, offsets = leaf_codes(forests[n], unit(matrix(column.take(pa.array(at)))))
            row = np.repeat(at, np.diff(offsets))
        else:
            code, row = np.ones(len(at), dtype=np.int64), at
        rows.append(row)
        codes.append(mixed(code.view(np.uint64) ^ mixed(np.full(len(code), int(n) + 1, np.uint64))).view(np.int64))
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(codes)[order]))


def fit_forest(sample: np.ndarray, n_vectors: int, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF) -> list[Tree]:
    return [Tree(sample, n_vectors, leaf, spill, np.random.default_rng(1000 + i)) for i in range(trees if n_vectors > leaf else 1)]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = TREES, spill: float = SPILL, leaf: int = LEAF) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors with a cosine of at least 0.95), component_id (smallest
    vec_id reachable by links, itself included), kept (vec_id = component_id).

    Splits are fitted on FIT_ROWS distinct vectors with the smallest hash; every vector is indexed and every leaf
    compared in full, a large one in blocks (see ``blockpairs``). Equal vectors are compared once and weighed by their
    number. A pair is missed only if every tree parts it. Vectors of each length have a forest of their own, fitted on
    the sampled ones of that length; a length that the sample lacks is one leaf, compared in full.

    Vectors that are null, empty, all zero or hold a null or non-finite component link with nothing. Null ids stay rows, never become component_id while the component has an id, and
    otherwise count as kept. Repeated rows link with each other. Other columns aren't read."""
    base = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.col("vector").isNotNull() & F.coalesce(~odd, F.lit(False)) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    base = base.withColumn("node", F.when(sound, F.xxhash64("vector")))
    classes = (
        base.where("node is not null")
        .groupBy("node")
        .agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
        .withColumn("n_dims", F.size("vector"))
    )
    classes = materialise(classes, "llm-vectors")
    counts = {r["n_dims"]: r["count"] for r in classes.groupBy("n_dims").count().orderBy(F.desc("count"), "n_dims").limit(FIT_ROWS).collect()}
    picked = classes.orderBy(F.xxhash64(F.col("node"), F.lit(7))).limit(FIT_ROWS).select("vector").toArrow().column("vector").combine_chunks()
    size = lengths(picked) if len(picked) else np.zeros(0, np.int32)
    forests = {int(n): fit_forest(unit(matrix(picked.take(pa.array(np.flatnonzero(size == n))))), counts[n], trees, spill, leaf) for n in np.unique(size) if n in counts}

    def work(column: pa.Array) -> list:
        return [leaf_lists(forests, column)]

    leaves = with_batch_columns(classes.select("node", "n_dims", "vector"), ["vector"], StructType([StructField("leaves", ArrayType(LongType()))]), work)
    members = leaves.select(F.explode("leaves").alias("bucket"), "node", F.col("n_dims").alias("weight"))
    members = materialise(members, "llm-leaves")
    nodes = classes.select("node", "vector", "weight").join(bucket_lists(members), "node")
    links = materialise(pair_links(nodes, ["vector"], close_vectors, weighted=True), "llm-vector-links")
    roots = components(links.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    per_class = (
        classes.select("node", "least_id", "weight")
        .join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    least = per_class.groupBy("root").agg(F.min("least_id").alias("component_id"))
    facts = per_class.join(least, "root").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    return (
        base.select("vec_id", "node")
        .join(facts, "node", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
