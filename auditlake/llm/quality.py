"""Operator 8, quality rules: a cascade that runs the rules with the most rejections per cost first."""

from __future__ import annotations

import re
import sys
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from auditlake.llm.common import bound_batches, fresh, utf8, with_batch_columns, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 8
#: Rows on which costs and rejections are estimated, about.
SAMPLE_ROWS = 2000
FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_BEYOND = re.compile(r"[^\x00-\x7F]")


class Block:
    """Texts with what several rules share; what a rule alone needs it works out by itself."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.words = [words(t) for t in texts]
        self.n_words = np.array([len(w) for w in self.words], np.int64)
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.start = np.cumsum([0, *map(len, texts)])
        first = (self.flat & 0xC0) != 0x80
        self.word_chars = self.total(first & ~_SPACE[self.flat])
        self.n_symbols = self.total(_SYMBOL[self.flat])
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
        self.n_lines = np.array([len(x) for x in lines], np.int64)
        self.n_dup_lines = self.n_lines - np.array([len(set(x)) for x in lines], np.int64)
        self.n_repeat_words = repeated_words(self.words, self.n_words)

    def total(self, marks: np.ndarray) -> np.ndarray:
        """Marked bytes of every text."""
        sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return np.diff(sums[self.start])

    def base_failed(self) -> np.ndarray:
        return (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)


def repeated_words(split: list[list[bytes]], n_words: np.ndarray) -> np.ndarray:
    """Words of each text inside windows of WINDOW words that the text has twice or more.

    Windows get exact numbers by doubling: a pair of numbers of length n is a number of length 2n."""
    out = np.zeros(len(split), np.int64)
    total = int(n_words.sum())
    if not (n_words > WINDOW).any():
        return out
    known: dict[bytes, int] = {}
    rank = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), np.int64, total)
    doc = np.repeat(np.arange(len(split)), n_words)
    width = 1
    while width < WINDOW:
        pair = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank = np.unique(pair, return_inverse=True)[1]
        width *= 2
    whole = doc[: len(rank)] == doc[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    key = doc[at] * (int(rank.max()) + 1) + rank[at]
    _, which, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[which] > 1]
    edge = np.zeros(total + 1, np.int64)
    edge[twice] += 1
    edge[twice + WINDOW] -= 1
    return np.bincount(doc[np.cumsum(edge[:-1]) > 0], minlength=len(split))


@dataclass(frozen=True)
class Rule:
    """``rejects(block, rows)`` tells which of the given rows of a block fail."""

    name: str
    rejects: Callable[[Block, np.ndarray], np.ndarray]


def odd_word_length(b: Block, rows: np.ndarray) -> np.ndarray:
    """Words longer than 20 or shorter than 1.5 characters on average."""
    chars, n = b.word_chars[rows], b.n_words[rows]
    return (chars > 20 * n) | (2 * chars < 3 * n)


def many_symbols(b: Block, rows: np.ndarray) -> np.ndarray:
    """More symbols than words."""
    return b.n_symbols[rows] > b.n_words[rows]


def repeated_lines(b: Block, rows: np.ndarray) -> np.ndarray:
    """More than half of the lines said before."""
    return 2 * b.n_dup_lines[rows] > b.n_lines[rows]


def few_letters(b: Block, rows: np.ndarray) -> np.ndarray:
    """Less than half of the characters in words are letters."""
    out = []
    for i in rows.tolist():
        t = b.texts[i]
        n = int(_LETTER[np.frombuffer(t, np.uint8)].sum())
        if not t.isascii():
            n += sum(map(str.isalpha, _BEYOND.findall(t.decode())))
        out.append(2 * n < b.word_chars[i])
    return np.array(out, bool)


def small_vocabulary(b: Block, rows: np.ndarray) -> np.ndarray:
    """Less than one distinct word in a hundred."""
    return np.array([100 * len(set(b.words[i])) < len(b.words[i]) for i in rows.tolist()], bool)


RULES = [
    Rule("odd_word_length", odd_word_length),
    Rule("many_symbols", many_symbols),
    Rule("repeated_lines", repeated_lines),
    Rule("few_letters", few_letters),
    Rule("small_vocabulary", small_vocabulary),
]


def estimates(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """Seconds per row and share rejected of every rule, over a random sample of about ``sample_rows`` rows.

    Tasks measure their part of the sample and return a row per rule and block; only the sums reach the driver."""
    bound_batches(docs.sparkSession)
    n = docs.count()
    share = min(1.0, sample_rows / n) if n else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block = Block(utf8(batch.column(0)))
            rows = np.arange(batch.num_rows)
            got = []
            for k, r in enumerate(rules):
                began = time.perf_counter()
                bad = int(r.rejects(block, rows).sum())
                got.append((k, time.perf_counter() - began, batch.num_rows, bad))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*got, strict=True)], names=["rule", "seconds", "n", "bad"])

    picked = docs.select("text").sample(fraction=share, seed=5)
    sums = picked.mapInArrow(run, "rule long, seconds double, n long, bad long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    found = {rules[r["rule"]].name: (r["s"] / r["n"], r["bad"] / r["n"]) for r in sums.collect()}
    return {r.name: found.get(r.name, (1.0, 0.0)) for r in rules}


def in_order(rules: list[Rule], known: dict[str, tuple[float, float]]) -> list[Rule]:
    """Rules by rejections per second, the greatest first; equal ones by cost."""
    return sorted(rules, key=lambda r: (-known[r.name][1] / max(known[r.name][0], 1e-12), known[r.name][0]))


def cascade(block: Block, rules: list[Rule]) -> np.ndarray:
    """Which rows pass the base test and every rule. A rule sees only the rows that all rules before it passed."""
    left = np.flatnonzero(~block.base_failed())
    for r in rules:
        if not len(left):
            break
        left = left[~r.rejects(block, left)]
    kept = np.zeros(len(block.texts), bool)
    kept[left] = True
    return kept


def quality(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every row of ``docs``.

    The order of the rules comes from a sample and from clocks, so it may differ between runs; ``kept`` doesn't depend
    on it. Null texts have no words and fail. Other columns aren't read; repeated rows give equal rows."""
    order = in_order(rules, estimates(docs, rules, sample_rows))

    def work(column: pa.Array) -> list:
        block = Block(utf8(column))
        return [*(pa.array(getattr(block, f)) for f in FACTS), pa.array(block.base_failed()), pa.array(cascade(block, order))]

    out = StructType([*(StructField(f, LongType()) for f in FACTS), StructField("base_failed", BooleanType()), StructField("kept", BooleanType())])
    return with_batch_columns(docs.select("doc_id", "text"), ["text"], out, work).drop("text")


def good_documents(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that the cascade keeps, with their columns."""
    order, kept = in_order(rules, estimates(docs, rules)), fresh(docs, "kept")
    flags = with_batch_columns(docs, ["text"], StructType([StructField(kept, BooleanType())]), lambda c: [pa.array(cascade(Block(utf8(c)), order))])
    return flags.where(kept).select(*docs.columns)


SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest(range(0, 8)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM win) WHERE c > 1) GROUP BY rid),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words, len(list_distinct(ws)) AS n_distinct, length(regexp_replace(t, '\P{L}', '', 'g')) AS n_letters
  FROM w LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words) AND n_symbols <= n_words AND 2 * n_dup_lines <= n_lines AND 2 * n_letters >= word_chars AND 100 * n_distinct >= n_words AS kept
FROM b"""
