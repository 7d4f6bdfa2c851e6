"""Operator 3, n-gram Jaccard join: MinHash bands find candidates, full sets of word n-grams decide."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from auditlake.llm.blockpairs import bucket_lists, overlaps, pair_links
from auditlake.llm.common import fresh, mixed, rows_of, utf8, with_batch_columns, words
from auditlake.llm.components import components
from auditlake.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NGRAM = 5
#: Similarity as a fraction, so that the test of a pair is in whole numbers.
THRESHOLD = (4, 5)
TARGET_RECALL = 0.997
#: Largest number of minima in a signature.
MAX_HASHES = 64


def bands_and_rows(threshold: float = THRESHOLD[0] / THRESHOLD[1], recall: float = TARGET_RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """Bands and rows for which a pair at the threshold meets with the target recall.

    More rows mean fewer false candidates; the largest row count whose bands still fit into ``most`` minima is taken."""
    for rows in range(most, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            return bands, rows
    raise ValueError("the recall can't be reached with so few hashes")


def ngram_hashes(texts: list[bytes], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the word n-grams of each text, in order: flat values and offsets.

    A text of fewer than n words has one gram of all its words, a text without words none."""
    split = [words(t) for t in texts]
    size = np.array([len(w) for w in split], dtype=np.int64)
    total = int(size.sum())
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in split for w in ws), dtype=np.uint64, count=total)
    start = np.concatenate([[0], np.cumsum(size)])
    grams = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    first = np.repeat(start[:-1], grams) + np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)
    length = np.repeat(np.minimum(size, n), grams)
    out = length.astype(np.uint64)
    for k in range(n):
        word = h[np.minimum(first + k, max(total - 1, 0))] if total else h[:0]
        out = np.where(length > k, mixed(out + word), out)
    return out, np.concatenate([[0], np.cumsum(grams)])


def signatures(flat: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value per text and band: the hash of its minima. Texts without grams are left at zero."""
    out = np.zeros((len(offsets) - 1, bands), dtype=np.uint64)
    some = np.flatnonzero(np.diff(offsets))
    if not len(some):
        return out
    seeds = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    for band in range(bands):
        value = np.full(len(some), band + 1, dtype=np.uint64)
        for row in range(rows):
            least = np.minimum.reduceat(flat * seeds[band * rows + row], offsets[some])
            value = mixed(value + least)
        out[some, band] = value
    return out


def similar_sets(a: pa.Table, b: pa.Table) -> np.ndarray:
    av, ao = rows_of(a.column("grams").chunk(0))
    bv, bo = (av, ao) if a is b else rows_of(b.column("grams").chunk(0))
    common = overlaps(av, ao, bv, bo).astype(np.int64)
    union = np.diff(ao)[:, None] + np.diff(bo)[None, :] - common
    return (common * THRESHOLD[1] >= union * THRESHOLD[0]) & (union > 0)


def banded(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, node (64-bit hash of the text), n_grams, bands of every row; text isn't kept."""
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")

    def work(column: pa.Array) -> list:
        flat, offsets = ngram_hashes(utf8(column))
        sig = signatures(flat, offsets, bands, rows).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * bands), pa.array(sig.ravel()))
        return [pa.array(np.diff(offsets)), lists]

    out = StructType([StructField("n_grams", LongType()), StructField("bands", ArrayType(LongType()))])
    return with_batch_columns(base, ["text"], out, work).drop("text")


def jaccard_join(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """One row per document row with what the join of the corpus with itself finds at a Jaccard similarity of 0.8 or
    more of the sets of word 5-grams.

    Columns: doc_id; copy_of (smallest doc_id with the same text); n_copies (rows with it, itself included); n_links
    (other rows linked directly, copies included); class_id (smallest doc_id connected by links, itself included);
    kept (doc_id = class_id).

    The join runs over distinct texts. Band values are shuffled as single longs; whole texts move once, and only those
    that share a band with another text. Pairs are counted inside tasks on pairs of blocks (see ``blockpairs``).

    Null and empty texts, and texts without a word, have no grams and so no links (n_links 0, class_id = doc_id).
    A row with null doc_id stays a row; class_id is null only if no row of the class has an id, and such rows count as
    kept. Repeated rows are copies of each other, and both are kept. Texts are told apart by a 64-bit hash. Columns
    beside doc_id and text aren't read."""
    sig, facts = _classes(docs, recall)
    empty = F.col("n_grams") == 0
    return (
        sig.select("doc_id", "node", "n_grams")
        .join(facts, "node", "left")
        .select(
            "doc_id",
            F.when(empty, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
            F.when(empty, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
            F.when(empty, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
            F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
    )


def one_of_each(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class of ``jaccard_join`` stays: that with the smallest
    doc_id, once. Documents without a word stay, repeated rows once. All columns are kept."""
    node, key = fresh(docs, "node"), fresh(docs, "key")
    sig, facts = _classes(docs, recall)
    # Told by the classes alone, so that copies of a text never meet in one task.
    firsts = facts.where(F.col("copy_of").eqNullSafe(F.col("class_id"))).select("node", F.coalesce("copy_of", "node").alias("key"))
    wordless = sig.where("n_grams = 0").select("node", F.coalesce("doc_id", "node").alias("key"))
    kept = firsts.union(wordless.distinct()).toDF(node, key)
    keyed = docs.withColumn(node, _node()).withColumn(key, F.coalesce("doc_id", node))
    return keyed.join(kept, [key, node], "left_semi").dropDuplicates([key, node]).select(*docs.columns)


def _node():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _classes(docs: DataFrame, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node, n_grams, bands of every row; node, copy_of, n_copies, n_links, class_id of every text with words)."""
    bands, rows = bands_and_rows(recall=recall)
    sig = materialise(banded(docs, bands, rows), "llm-bands")
    classes = (
        sig.where("n_grams > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    )
    classes = materialise(classes, "llm-classes")
    members = classes.select(F.explode("bands").alias("bucket"), "node", F.col("n_grams").alias("weight"))
    wanted = bucket_lists(members).join(classes.select("node", "copy_of", "n_copies"), "node").withColumn("key", F.coalesce("copy_of", "node"))
    texts = docs.select("doc_id", "text").withColumn("node", _node()).withColumn("key", F.coalesce("doc_id", "node"))
    found = texts.join(wanted, ["key", "node"]).dropDuplicates(["key", "node"])

    def work(column: pa.Array) -> list:
        flat, offsets = ngram_hashes(utf8(column))
        return [pa.array([np.unique(flat[i:j]).tobytes() for i, j in zip(offsets, offsets[1:], strict=False)], type=pa.binary())]

    grams = StructType([StructField("grams", BinaryType())])
    sets = with_batch_columns(found.select("node", "buckets", F.col("n_copies").alias("weight"), "text"), ["text"], grams, work)
    links = materialise(pair_links(sets.drop("text"), ["grams"], similar_sets, weighted=True), "llm-links")
    roots = components(links.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    per_class = (
        classes.select("node", "copy_of", "n_copies")
        .join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    least = per_class.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1
    return sig, per_class.join(least, "root").select("node", "copy_of", "n_copies", n_links.alias("n_links"), "class_id")
