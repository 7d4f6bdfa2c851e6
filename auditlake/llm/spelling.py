"""Operator 12, spelling variant grouping: PartEnum signatures over letter multisets find words one edit apart."""

from __future__ import annotations

import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from auditlake.llm.common import bound_batches, mixed, with_batch_columns
from auditlake.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words have this many code points and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as the word.
DOMINANT = 10
#: One occurrence in so many, by crc32, loses a code point.
DAMAGED = 31
#: Words that a task counts before it hands its counts on.
HELD_WORDS = 500_000
#: Words one edit apart differ in this many bits of their multisets at most; bits are dealt to this many parts.
MOST_BITS, PARTS = 2, 4
#: Sets of parts of which at least one agrees for such words, whichever bits differ.
AGREEING = list(combinations(range(PARTS), PARTS - MOST_BITS))
#: A-Z to a-z, letters of the runs as they are, all else of Latin-1 to a space.
RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def damaged_words(doc_id, text: str) -> Counter:
    """Words of a text with at least LEAST_LENGTH letters, after the crc32 rule has cut a letter here and there."""
    runs = Counter(r for r in text.encode("latin-1", "replace").translate(RUNS).split() if len(r) >= LEAST_LENGTH)
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in runs.items():
        word = run.decode("latin-1")
        h = zlib.crc32(word.encode(), start)
        if h % DAMAGED == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) < LEAST_LENGTH:
                continue
        out[word] += n
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts of ``docs`` (doc_id, text), for words that occur LEAST_COUNT times. Tasks count first."""
    bound_batches(docs.sparkSession)

    def packed(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    for word, n in damaged_words(doc_id, text).items():
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield packed(held)
                    held = Counter()
        yield packed(held)

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def signatures(words: list[str]) -> np.ndarray:
    """Keys (word, key) such that any two words one edit apart share one, the shorter (or either, at equal lengths) in
    the first half of its columns and the longer (or the other) in the half that its length asks for.

    A word's letters are a binary vector with a bit for every (letter, how many of it came before), so one edit changes
    two bits at most. Bits are dealt to PARTS parts; two differing bits leave PARTS - 2 parts alike, so one of AGREEING
    is alike in both words. With a single edit, also all before or all after the middle is alike: each signature is
    refined by either half of the word, the middle being that of the shorter word. The first half of the columns takes
    the word as the shorter one, the second as the longer one."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(flat)) - start[row]
    order = np.lexsort((flat, row))
    same = np.zeros(len(flat), dtype=bool)
    same[1:] = (flat[order][1:] == flat[order][:-1]) & (row[order][1:] == row[order][:-1])
    firsts = np.flatnonzero(~same)
    before = np.arange(len(flat)) - np.repeat(firsts, np.diff(np.append(firsts, len(flat))))
    bit = mixed((flat[order] * 100_003 + before + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    parts = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(parts, (row[order], (bit >> np.uint64(32)) % np.uint64(PARTS)), bit)
    alike = [mixed(parts[:, list(s)].sum(axis=1) + np.uint64(i + 1)) for i, s in enumerate(AGREEING)]

    def sums(place: np.ndarray) -> np.ndarray:
        """Running sums of hashes of (letter, place), with a zero in front."""
        h = mixed((flat * 1_000_003 + place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])

    front, back = sums(at), sums(size[row] - at)
    end = start + size
    keys = []
    for shorter in (size, size - 1):
        middle = shorter // 2
        length = shorter.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        halves = (front[start + middle] - front[start], back[end] - back[end - (shorter - middle)])
        for side, half in enumerate(halves):
            refined = mixed(half + length + np.uint64(side))
            keys += [mixed(a ^ refined) for a in alike]
    return np.stack(keys, axis=1).view(np.int64) if words else np.zeros((0, 4 * len(AGREEING)), np.int64)


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: every two rows of ``words`` (distinct word, n) that are one edit apart, once, whole.

    Equal keys are joined and a pair leaves the join only if it is one edit apart; pairs met under several keys are made
    one. A key holds words that agree in half their letters in order and half of them in number, so few at any size."""

    def work(column: pa.Array) -> list:
        keys = signatures(column.to_pylist())
        offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1])
        return [pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))]

    keyed = with_batch_columns(words.select("word", "n"), ["word"], StructType([StructField("keys", ArrayType(LongType()))]), work)
    longer = (F.col("at") >= 2 * len(AGREEING)).alias("longer")
    each = keyed.select("word", "n", F.posexplode("keys").alias("at", "key")).select("key", "word", "n", longer)
    a, b = each.alias("a"), each.alias("b")
    # Written so that both sides of the join read one exchange: no condition is about one side alone.
    roles = ~(F.col("a.longer") & F.col("b.longer")) & ((F.col("a.longer") < F.col("b.longer")) | ((F.col("a.longer") == F.col("b.longer")) & (F.col("a.word") < F.col("b.word"))))
    return (
        a.join(b, (F.col("a.key") == F.col("b.key")) & roles & (F.levenshtein("a.word", "b.word", 1) == 1))
        .select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))
        .distinct()
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word when (word, form) is followed. Every step multiplies the count, so chains are short, and
    each round doubles what is covered."""
    to = materialise(forms.select("word", F.col("form").alias("root")), "llm-forms")
    while True:
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("further"))
        to = materialise(to.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "llm-forms")
        if to.where("moved").isEmpty():
            return to.select("word", "root")
        to = to.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text).

    Words are the runs of letters of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, after one occurrence in 31 (by
    the crc32 of ``doc_id:run``; a null id counts as empty) has lost a code point, that have 7 code points and 2
    occurrences at least. ``form`` is the near word (one edit apart) of largest n, ties by code points, where that n is
    at least 10 times the word's, else null with ``form_n``; ``root`` follows forms to the last; ``n_near`` counts near
    words. Null and empty texts have no words; repeated rows count as often as they are there; other columns aren't
    read; an empty table gives an empty result."""
    words = materialise(word_counts(docs), "llm-words")
    pairs = near_pairs(words)
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), (-F.col("b_n")).alias("less"), F.col("b").alias("near")),
            F.struct(F.col("b").alias("word"), (-F.col("a_n")).alias("less"), F.col("a").alias("near")),
        )
    )
    best = pairs.select(both.alias("p")).select("p.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    dominant = -F.col("best.less") >= DOMINANT * F.col("n")
    told = materialise(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(dominant, F.col("best.near")).alias("form"), F.when(dominant, -F.col("best.less")).alias("form_n"),
        ),
        "llm-near-words",
    )
    followed = roots(told.where("form is not null"))
    return told.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _sql() -> str:
    """The same by SQL: crc32 a bit at a time, near words by the patterns that they share."""
    damaged = "list_filter(list_transform(range(1, length(w) + 1), lambda i: CASE WHEN i = h % length(w) + 1 THEN '' ELSE w[i] END), lambda c: c <> '')"
    return f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
runs7 AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS k FROM runs WHERE length(raw) >= {LEAST_LENGTH} GROUP BY ALL),
hashed AS (SELECT w, k, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM runs7),
cut AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN array_to_string({damaged}, '') ELSE w END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS rest FROM spots),
other AS (SELECT word, n, left(word, i - 1) || '?' || substr(word, i + 1) AS pattern FROM spots),
near AS (SELECT a.word, b.word AS o, b.n AS o_n FROM other a JOIN other b ON a.pattern = b.pattern AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(o, (-o_n, o)) AS o, max(o_n) AS o_n FROM near GROUP BY word),
told AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN o_n >= {DOMINANT} * w.n THEN o END AS form, CASE WHEN o_n >= {DOMINANT} * w.n THEN o_n END AS form_n FROM words w LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at FROM told UNION ALL SELECT way.word, told.form FROM way JOIN told ON way.at = told.word WHERE told.form IS NOT NULL)
SELECT t.word, t.form, way.at AS root, t.n, t.n_near, t.form_n FROM told t JOIN way ON way.word = t.word JOIN told e ON e.word = way.at WHERE e.form IS NULL"""


def crc32_sql(text: str) -> str:
    """DuckDB's unsigned crc32 of a string of code points below 2048: each byte is folded in, then eight bits shifted out."""
    data = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c), 0, 0, 0, 0, 0, 0, 0] ELSE [192 + unicode(c) // 64, 0, 0, 0, 0, 0, 0, 0, 128 + unicode(c) % 64, 0, 0, 0, 0, 0, 0, 0] END))"
    step = "xor(xor(c, b) >> 1, CASE WHEN xor(c, b) % 2 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_transform({data}, lambda x: CAST(x AS BIGINT)), lambda c, b: {step}, CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"


SQL = _sql()
