"""Operator 9, token counts: the pieces of a pre-token are counted once and summed by its frequency in each document."""

from __future__ import annotations

import os
import sys
from collections import Counter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from auditlake.llm.common import with_batch_columns, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A document with more tokens is over the limit.
LIMIT = 2048
#: Counted pre-tokens that a task remembers; a new block starts afresh beyond it.
MEMORY = 400_000
#: Pre-tokens that the library encodes at once.
AT_ONCE = 20_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceCounter:
    """Numbers of pieces by pre-token, as the library for the tokenizer file gives them.

    Pre-tokens are runs between ASCII white space. That fits tokenizers that drop white space and never join over it,
    as their pattern, normaliser and special strings show; the library splits a run further by itself."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.pieces: dict[str, int] = {}

    def learn(self, pre_tokens) -> None:
        new = [p for p in pre_tokens if p not in self.pieces]
        for i in range(0, len(new), AT_ONCE):
            part = new[i : i + AT_ONCE]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.pieces[p] = len(e)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of every text of a block: each distinct pre-token of the block is encoded once."""
        frequencies = [Counter(x.decode() for x in words(t.encode())) for t in texts]
        distinct = dict.fromkeys(p for f in frequencies for p in f)
        if len(self.pieces) + len(distinct) > MEMORY:
            self.pieces.clear()
        self.learn(distinct)
        n = self.pieces
        return [sum(n[p] * k for p, k in f.items()) for f in frequencies]


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of ``docs``; no ids are kept.

    ``tokenizer`` is the path of a tokenizer file on the driver. Each block of documents is a join of its own: the
    distinct pre-tokens with their pieces on one side, the frequencies per document on the other, so nothing is
    shuffled (frequencies of all documents take more room than the texts). Null texts count as empty. Other columns
    aren't read; repeated rows give equal rows."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        definition = f.read()
    held: list[PieceCounter] = []

    def work(column: pa.Array) -> list:
        if not held:
            held.append(PieceCounter(definition))
        return [pa.array(held[0].counts([t or "" for t in column.to_pylist()]), pa.int64())]

    base = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    counted = with_batch_columns(base, ["text"], StructType([StructField("n_tokens", LongType())]), work)
    return counted.drop("text").withColumn("over_limit", F.col("n_tokens") > limit)
