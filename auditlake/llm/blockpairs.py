"""Similar pairs inside overlapping buckets, without a row per pair and without a bucket in one task.

Buckets (bands, tree leaves) overlap, and a hot one may hold a third of all nodes. So:

* buckets with the same members are compared once;
* a bucket is dealt into blocks of bounded rows and bytes, and every pair of blocks is a task of its own;
* a pair that meets in several buckets counts in the one with the smallest id only;
* a task returns a row per node with links: how many, and the smallest node it is connected with in that task.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import bound_batches, rows_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows and 64-bit items of payload in a block.
BLOCK_ROWS, BLOCK_ITEMS = 1024, 2_000_000
KEYS = ["bucket", "lo", "hi"]
#: Columns of the dense slices in which overlaps are counted.
SLICE = 4096


def bucket_lists(members: DataFrame) -> DataFrame:
    """node and its buckets (id, number of blocks) from distinct rows (bucket, node, weight).

    Buckets of one node go. The weight is the number of payload items of a node."""
    each = members.groupBy("bucket").agg(
        F.count("*").alias("n"),
        F.sum("weight").alias("items"),
        F.bit_xor(F.xxhash64("node")).alias("together"),
        F.min("node").alias("first"),
        F.max("node").alias("last"),
    )
    kept = (
        each.where("n > 1")
        .groupBy("n", "together", "first", "last")
        .agg(F.min("bucket").alias("bucket"), F.max("items").alias("items"))
    )
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("items") / BLOCK_ITEMS, F.lit(1))).cast("int")
    return (
        members.join(kept.select("bucket", blocks.alias("blocks")), "bucket")
        .groupBy("node")
        .agg(F.collect_list(F.struct("bucket", "blocks")).alias("buckets"))
    )


def overlaps(av: np.ndarray, ao: np.ndarray, bv: np.ndarray, bo: np.ndarray) -> np.ndarray:
    """How many values each row of a (flat values, offsets) shares with each row of b. Values of a row are distinct."""
    out = np.zeros((len(ao) - 1, len(bo) - 1), dtype=np.float32)
    known, at = np.unique(np.concatenate([av, bv]), return_inverse=True)
    in_a, in_b = np.bincount(at[: len(av)], minlength=len(known)), np.bincount(at[len(av) :], minlength=len(known))
    both = (in_a > 0) & (in_b > 0)
    if av is bv:
        both &= in_a > 1
    column = np.where(both, np.cumsum(both) - 1, -1)
    sides = []
    for part, offsets in ((at[: len(av)], ao), (at[len(av) :], bo)):
        col, row = column[part], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        col, row = col[col >= 0], row[col >= 0]
        order = np.argsort(col, kind="stable")
        sides.append((col[order], row[order]))
    for start in range(0, int(both.sum()), SLICE):
        dense = []
        for (col, row), offsets in zip(sides, (ao, bo), strict=True):
            i, j = np.searchsorted(col, [start, start + SLICE])
            m = np.zeros((len(offsets) - 1, SLICE), dtype=np.float32)
            m[row[i:j], col[i:j] - start] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def lowest(linked: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each node by links; ``linked`` is a symmetric matrix."""
    label = nodes.copy()
    i, j = np.nonzero(linked)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        if (new == label).all():
            return label
        label = new


def block_links(group: pa.Table, similar: Callable, weigh: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """node, smallest node it is connected with, links of one pair of blocks."""
    bucket, lo, hi = (group.column(k)[0].as_py() for k in KEYS)
    node, own = group.column("node").to_numpy(), group.column("own").to_numpy()
    _, once = np.unique(node, return_index=True)
    if len(once) < len(node):
        group, node, own = group.take(pa.array(once)), node[once], own[once]
    left = np.flatnonzero(own == lo)
    right = left if lo == hi else np.flatnonzero(own == hi)
    if not len(left) or not len(right) or (lo == hi and len(left) < 2):
        return node[:0], node[:0], node[:0]
    a = group.take(pa.array(left)).combine_chunks()
    b = a if lo == hi else group.take(pa.array(right)).combine_chunks()
    found = similar(a, b)
    if lo == hi:
        np.fill_diagonal(found, False)
    if not found.any():
        return node[:0], node[:0], node[:0]

    def before(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat, offsets = rows_of(t.column("ids").chunk(0))
        earlier = flat < bucket
        return flat[earlier], np.concatenate([[0], np.cumsum(earlier)])[offsets]

    av, ao = before(a)
    bv, bo = (av, ao) if lo == hi else before(b)
    found &= overlaps(av, ao, bv, bo) == 0
    weight = group.column("weight").to_numpy() if weigh else np.ones(len(node), dtype=np.int64)
    links = np.zeros(len(node), dtype=np.int64)
    links[left] += found @ weight[right]
    if lo != hi:
        links[right] += found.T @ weight[left]
    linked = np.zeros((len(node), len(node)), dtype=bool)
    linked[np.ix_(left, right)] = found
    linked |= linked.T
    some = links > 0
    return node[some], lowest(linked, node)[some], links[some]


def pair_links(nodes: DataFrame, payload: list[str], similar: Callable, weighted: bool = False) -> DataFrame:
    """node, peer, links from rows (node, buckets, weight, payload...): ``buckets`` as ``bucket_lists`` gives them.

    ``similar(a, b)`` gets two Arrow tables with the payload and returns the matrix of linked pairs. Sum ``links`` by
    node for the number of its links (weighted by the other node's weight if asked for); (node, peer) are edges that
    connect what the links connect."""
    bound_batches(nodes.sparkSession)
    tasks = F.expr(
        "flatten(transform(buckets, b -> transform(sequence(0, b.blocks - 1), j -> named_struct("
        "'bucket', b.bucket, 'own', cast(pmod(xxhash64(node, b.bucket), b.blocks) as int), "
        "'lo', least(j, cast(pmod(xxhash64(node, b.bucket), b.blocks) as int)), 'hi', greatest(j, cast(pmod(xxhash64(node, b.bucket), b.blocks) as int))))))"
    )
    weight = F.col("weight").cast("long") if weighted else F.lit(1).cast("long")
    dealt = (
        nodes.select("node", weight.alias("weight"), F.expr("transform(buckets, b -> b.bucket)").alias("ids"), *payload, F.explode(tasks).alias("t"))
        .select("t.*", "node", "weight", "ids", *payload)
        .repartition(*KEYS)
        .sortWithinPartitions(*KEYS)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for group in groups_of(batches, KEYS):
            made = block_links(group, similar, weighted)
            out.append(made)
            held += len(made[0])
            if held > 50_000:
                yield packed(out)
                out, held = [], 0
        if out:
            yield packed(out)

    def packed(parts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["node", "peer", "links"])

    return dealt.mapInArrow(run, "node long, peer long, links long")


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, from batches sorted by them."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in keys], axis=1).astype(np.int64)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), batch.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and not np.array_equal(key[i], last):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(i, j - i))
            last = key[i]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
