"""Operator 4, mixing sources to target weights: balanced sampling by the cube method."""

from __future__ import annotations

import bisect
import math
import random
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.blockpairs import groups_of
from auditlake.llm.common import WORD_JVM, bound_batches, fresh
from auditlake.llm.manifest import numbered
from auditlake.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Weights in turn, over sources by code point with null last.
WEIGHTS = (1, 2, 3)
#: A source gives at most this many times its size.
MOST_TIMES = 3
#: Units of a source that one flight works on.
FLIGHT_UNITS = 2000
#: Units of a source that are left for its last flight, so that it can land well.
SPARE_UNITS = 64
#: A probability this near to 0 or 1 is there.
NEAR = 1e-9


def size_of(text: str = "text"):
    """Words of a text, null as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_JVM)), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """``sources`` (source, words, one row each) with source_no, their number by code point with null last, and target,
    the words to take: all words are shared by weight, what lies above a source's limit is shared again by weight
    among the others, until none is above. Each round is one sum over the sources, whatever their number."""
    named = sources.withColumn("is_null", F.col("source").isNull())
    told = numbered(named.withColumn("part", F.lit("")), ["is_null", "source"]).withColumnRenamed("pos", "source_no").drop("part", "n", "is_null")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    told = materialise(told.withColumn("weight", turn.cast("long")).withColumn("limit", F.col("words") * most_times), "llm-sources")
    total = told.agg(F.sum("words")).first()[0] or 0
    share_of, full, n_full = F.lit(0.0), F.lit(False), -1
    while True:
        row = told.agg(F.sum(F.when(full, F.col("limit")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if not row[1] or row[2] == n_full:
            break
        n_full = row[2]
        share_of = F.lit(float(total - row[0])) * F.col("weight") / F.lit(float(row[1]))
        full = share_of > F.col("limit")
    return told.withColumn("target", F.when(full, F.col("limit").cast("double")).otherwise(share_of)).drop("weight", "limit")


def flight(p: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Moves probabilities p along directions that keep the sums of p and of p * size, until two or fewer are left
    between 0 and 1. Each step takes three open units; the null space of their two constraints is a line, and the two
    ends where a unit gets to 0 or 1 are drawn so that each unit's expectation stays."""
    p = list(p)
    open_units: list[int] = []
    for unit in range(len(p)):
        if not NEAR < p[unit] < 1 - NEAR:
            p[unit] = float(round(p[unit]))
            continue
        open_units.append(unit)
        if len(open_units) < 3:
            continue
        a, b, c = open_units
        # Orthogonal to (1, 1, 1) and to the sizes.
        move = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(move):
            move = (1.0, -1.0, 0.0)
        up = min((1 - p[u]) / m if m > 0 else p[u] / -m for u, m in zip(open_units, move, strict=True) if m)
        down = min(p[u] / m if m > 0 else (1 - p[u]) / -m for u, m in zip(open_units, move, strict=True) if m)
        step = up if rng.random() * (up + down) < down else -down
        left = []
        for u, m in zip(open_units, move, strict=True):
            p[u] += step * m
            if p[u] <= NEAR or p[u] >= 1 - NEAR:
                p[u] = 1.0 if p[u] > 0.5 else 0.0
            else:
                left.append(u)
        if len(left) == 3:  # rounding left the end open by a hair: close the nearest
            u = min(left, key=lambda x: min(p[x], 1 - p[x]))
            p[u] = float(round(p[u]))
            left.remove(u)
        open_units = left
    return p


def landing(p: list[float], size: list[float], words: float) -> list[float]:
    """The few units left open go to 0 or 1 so that the words come nearest to ``words``; then units change sides one by
    one, each time that which brings them nearest, as long as that gains."""
    at = [i for i, x in enumerate(p) if 0 < x < 1]
    sure = sum(s for x, s in zip(p, size, strict=True) if x == 1)

    def gap(mask: int) -> tuple[float, int]:
        return abs(sure + sum(size[i] for j, i in enumerate(at) if mask >> j & 1) - words), mask

    best = min(range(1 << len(at)), key=gap)
    out = list(p)
    for j, i in enumerate(at):
        out[i] = float(best >> j & 1)
    by_side = {side: sorted((size[i], i) for i, x in enumerate(out) if x == side) for side in (0.0, 1.0)}
    while True:
        missing = words - sum(x * s for x, s in zip(out, size, strict=True))
        side = by_side[0.0 if missing > 0 else 1.0]
        k = bisect.bisect_left(side, (abs(missing), -1))
        near = min(side[max(k - 1, 0) : k + 1], key=lambda x: (abs(abs(missing) - x[0]), x), default=None)
        if near is None or abs(abs(missing) - near[0]) >= abs(missing):
            return out
        side.remove(near)
        out[near[1]] = 1.0 - out[near[1]]


def settle(units: DataFrame, level: int, last: bool) -> DataFrame:
    """One level: every (source, block) flies on its own; ``last`` also lands what is left."""
    bound_batches(units.sparkSession)
    dealt = units.repartition("source_no", "block").sortWithinPartitions("source_no", "block", F.desc("size"), "order", "unit_id")
    names = [f.name for f in dealt.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["source_no", "block"]):
            p, size = group.column("p").to_pylist(), [float(x) for x in group.column("size").to_pylist()]
            rng = random.Random(f"{level} {group.column('source_no')[0]} {group.column('block')[0]}")
            if last:
                p = landing(flight(p, size, rng), size, sum(x * s for x, s in zip(p, size, strict=True)))
            else:
                # Spread over all sizes, a few units of a source wait for the end.
                every = max(1, len(p) // SPARE_UNITS) if group.column("block")[0].as_py() == 0 else len(p) + 1
                fly = [i for i in range(len(p)) if (i + 1) % every]
                for i, x in zip(fly, flight([p[i] for i in fly], [size[i] for i in fly], rng), strict=True):
                    p[i] = x
            done = group.set_column(names.index("p"), "p", pa.array(p, pa.float64()))
            yield from done.combine_chunks().to_batches()

    return dealt.mapInArrow(run, dealt.schema)


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, text, source).

    A source whose target is r times its size takes every document floor(r) times, and once more those that balanced
    sampling picks with probability r - floor(r) each. The cube method keeps both the words and the number of documents
    of the pick at their expectation. Sources are cut into blocks of units; flights over blocks leave two open units
    each, which are gathered block by block until one block per source is left, and only that lands.

    Draws depend on ids, sizes and the order of the sources alone, not on how rows are dealt out, so reruns agree on any
    cluster. Documents without words (null, empty) are taken 0 times; a source without words has target 0. Null is a
    source of its own, the last. Null ids stay rows; repeated rows are units of their own. Other columns aren't read."""
    out = _drawn(docs, weights, most_times)
    taken = F.col("size") * (F.col("whole") + F.col("p").cast("long"))
    return out.select(F.col("unit_id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"))


def _drawn(docs: DataFrame, weights: tuple[int, ...], most_times: int) -> DataFrame:
    """A row per row of ``docs``: unit_id, key, size, source_size, target, whole (sure times) and p, by now 0 or 1."""
    spark = docs.sparkSession
    base = materialise(docs.select("doc_id", "source", size_of().alias("size"), _key().alias("key")), "llm-sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("words"), F.count_if(F.col("size") > 0).alias("units"))
    rate = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0))
    whole = F.floor(rate + F.lit(1e-12))
    sources = materialise(
        with_targets(sizes, weights, most_times).select(
            F.col("source").alias("s"), "source_no", F.col("words").alias("source_size"), "target", whole.alias("whole"),
            F.when(rate - whole > NEAR, rate - whole).otherwise(F.lit(0.0)).alias("p"), F.ceil(F.col("units") / FLIGHT_UNITS).alias("n_blocks"),
        ),
        "llm-targets",
    )
    order = F.xxhash64(F.col("doc_id"), F.col("size"), F.lit(3))
    joined = base.join(sources, base["source"].eqNullSafe(sources["s"])).drop("s", "source")
    sure = (F.col("size") == 0) | (F.col("p") == 0)
    units = (
        joined.withColumn("p", F.when(sure, F.lit(0.0)).otherwise(F.col("p")))
        .withColumn("order", order)
        .withColumn("block", F.when(sure, F.lit(-1)).otherwise(F.pmod("order", F.greatest("n_blocks", F.lit(1)))).cast("long"))
        .withColumnRenamed("doc_id", "unit_id")
    )
    settled = [units.where("block < 0")]
    open_units, blocks, level = units.where("block >= 0"), sources.agg(F.max("n_blocks")).first()[0] or 0, 0
    while blocks:
        flown = materialise(settle(open_units, level, blocks == 1), f"llm-flight{level}")
        settled.append(flown.where("p in (0, 1)"))
        if blocks == 1:
            break
        blocks, level = math.ceil(2 * blocks / FLIGHT_UNITS), level + 1
        open_units = flown.where("p not in (0, 1)").withColumn("block", F.pmod(F.xxhash64("order", F.lit(level)), F.lit(blocks)).cast("long"))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """The rows of the mix: ``docs`` with every row as many times as it is taken, all columns kept.

    Rows that agree in doc_id, text and source share the times they are taken, and one of them stands for all."""
    key, times = fresh(docs, "mix_key"), fresh(docs, "mix_times")
    per = (
        _drawn(docs, weights, most_times)
        .groupBy(F.col("key").alias(key))
        .agg(F.sum(F.col("whole") + F.col("p").cast("long")).cast("int").alias(times))
        .where(F.col(times) > 0)
    )
    keyed = docs.withColumn(key, _key()).dropDuplicates([key])
    return keyed.join(per, key).select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col(times))).alias(key)).drop(key)


def _key():
    return F.xxhash64("doc_id", "text", "source")
