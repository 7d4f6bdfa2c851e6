"""Operator 6, SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces."""

from __future__ import annotations

import re
import struct
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from auditlake.llm.common import utf8, with_batch_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Chunks up to this many characters are solved many at a time, longer ones alone.
SHORT = 32
#: Distinct chunks that a task remembers.
MEMORY = 200_000
NEVER = -1e30


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of every id of a model file."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if data[i - 1] < 128:
                return value, i

    out, i = [], 0
    while i < len(data):
        tag, i = number(i)
        size, i = number(i)
        if tag != 10:
            i += size
            continue
        end, piece, score, kind = i + size, "", 0.0, NORMAL
        while i < end:
            tag, i = number(i)
            if tag == 10:
                size, i = number(i)
                piece, i = data[i : i + size].decode(), i + size
            elif tag == 21:
                (score,), i = struct.unpack("<f", data[i : i + 4]), i + 4
            else:
                kind, i = number(i)
        out.append((piece, score, kind))
    return out


def log_scores(pieces: list[tuple[str, float, int]]) -> np.ndarray:
    """Log scores of pieces. A file whose scores are negated merge ranks gets logs of ranks under Zipf's law, so that
    its order of pieces is kept; scores that are log probabilities already stay."""
    raw = np.array([s for _, s, _ in pieces])
    usual = np.array([k in (NORMAL, USER) for *_, k in pieces])
    ranks = usual & (raw > -1e8)
    if not ranks.any() or raw[ranks].min() > -1000:
        return raw
    out = -np.log(np.maximum(-raw, 0) + 2) - np.log(np.log(ranks.sum() + 2))
    out[usual & ~ranks] = out[ranks].min() - 1
    return out


class Trie:
    """Double-array trie over the pieces' characters: from state s, character code c leads to base[s] + c if check there
    is s. Codes number the characters of the pieces from 1, common ones first, so that children lie close; other characters have code 0 and lead nowhere."""

    def __init__(self, words: dict[str, int]):
        letters = [c for c, _ in sorted(Counter(c for w in words for c in w).items(), key=lambda x: (-x[1], x[0]))]
        code = {c: i + 1 for i, c in enumerate(letters)}
        self.longest = max(map(len, words), default=0)
        tree: dict = {}
        for w, i in words.items():
            at = tree
            for c in w:
                at = at.setdefault(code[c], {})
            at[0] = i
        width = len(letters) + 1
        # Room at the start; the arrays grow where that isn't enough.
        size = 4096 + 4 * (sum(map(len, words)) + width)
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.check[0] = 0
        used = np.zeros(size, bool)
        used[0] = True
        free_from, top, todo = 1, 1, [(0, tree)]
        while todo:
            state, at = todo.pop()
            self.value[state] = at.pop(0, -1)
            if not at:
                continue
            codes = np.array(sorted(at))
            while used[free_from]:
                free_from += 1
            # The first of the next free slots where all children fit, else the end of what is used.
            slots = free_from + np.flatnonzero(~used[free_from : free_from + 2048])
            bases = slots - codes[0]
            bases = bases[(bases > 0) & (bases + codes[-1] < len(used))]
            fits = ~used[bases[:, None] + codes].any(axis=1)
            base = int(bases[fits.argmax()]) if fits.any() else max(1, top - int(codes[0]))
            if base + width > len(used):
                more = len(used)
                used = np.concatenate([used, np.zeros(more, bool)])
                self.base, self.value = np.concatenate([self.base, np.zeros(more, np.int32)]), np.concatenate([self.value, np.full(more, -1, np.int32)])
                self.check = np.concatenate([self.check, np.full(more, -1, np.int32)])
            self.base[state] = base
            used[base + codes] = True
            top = max(top, base + int(codes[-1]) + 1)
            self.check[base + codes] = state
            todo.extend((base + c, at[c]) for c in at)
        last = top + width
        room = max(0, last - len(self.base))
        self.base = np.pad(self.base[:last], (0, room))
        self.check = np.pad(self.check[:last], (0, room), constant_values=-1)
        self.value = np.pad(self.value[:last], (0, room), constant_values=-1)

        self.of_point = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)
        self.of_point[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.of_point[np.minimum(points, len(self.of_point) - 1)]


class Encoder:
    """Splits text into the pieces with the greatest sum of log scores; among equal sums the one whose last piece is
    longest, from the end of the text. Characters that no piece covers become byte pieces, or the unknown piece where
    the model has none."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.text = [p for p, *_ in pieces]
        self.kind = np.array([k for *_, k in pieces], np.int8)
        self.score = log_scores(pieces)
        found: dict[str, int] = {}
        for i, (p, _, k) in enumerate(pieces):
            if k in (NORMAL, USER) and p:
                found.setdefault(p, i)
        self.trie = Trie(found)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next((i for i, (*_, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.fallback = (self.score[list(found.values())].min() if found else 0.0) - 10
        # No piece has a mark after another character, and none joins a line end to anything, if that holds here:
        # then no best path crosses there, and the stretches between are solved on their own.
        inner = any(MARK in p.lstrip(MARK) for p in found)
        lines = any("\n" in p and len(p) > 1 for p in found)
        rest = "" if lines else "\n"
        self.split = None if inner else re.compile(f"{MARK}*[^{MARK}{rest}]+|{MARK}+" + ("" if lines else "|\n"))
        self.memory: dict[str, np.ndarray] = {}
        self.spelling = None

    def chunks(self, text: str) -> list[str]:
        """A mark in front and for every blank, then stretches that no piece crosses."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self.split.findall(marked) if self.split else [marked]

    def solve_many(self, chunks: list[str]) -> list[np.ndarray]:
        """Best pieces of short chunks: one step of the Viterbi recursion for all of them at once."""
        n, size = len(chunks), np.array([len(c) for c in chunks])
        width = int(size.max())
        t = self.trie
        code = np.zeros((width + 1, n), np.int32)
        row = np.repeat(np.arange(n), size)
        code[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), row] = t.codes("".join(chunks))
        best = np.full((width + 1, n), NEVER)
        best[0] = 0
        back = np.zeros((width + 1, n), np.int32)
        piece = np.full((width + 1, n), -1, np.int32)
        for start in range(width):
            who = np.flatnonzero(size > start)
            alone = best[start, who] + self.fallback
            wins = alone > best[start + 1, who]
            at = who[wins]
            best[start + 1, at], back[start + 1, at], piece[start + 1, at] = alone[wins], start, -1
            state, here = np.zeros(len(who), np.int32), best[start, who]
            for end in range(start, min(width, start + t.longest)):
                c = code[end, who]
                to = t.base[state] + c
                ok = (c > 0) & (t.check[to] == state)
                if not ok.any():
                    break
                who, state, here = who[ok], to[ok], here[ok]
                value = t.value[state]
                is_piece = value >= 0
                rows, total, val = who[is_piece], here[is_piece] + self.score[value[is_piece]], value[is_piece]
                wins = total > best[end + 1, rows]
                at = rows[wins]
                best[end + 1, at], back[end + 1, at], piece[end + 1, at] = total[wins], start, val[wins]
        end, who = size.copy(), np.arange(n)
        ids = np.full((width, n), -2, np.int32)
        for step in range(width):
            who = who[end[who] > 0]
            if not len(who):
                break
            ids[step, who] = piece[end[who], who]
            end[who] = back[end[who], who]
        count = (ids > -2).sum(axis=0)
        spelled = np.flatnonzero((ids == -1).any(axis=0))
        out = [x[:k][::-1] for x, k in zip(np.ascontiguousarray(ids.T), count.tolist(), strict=True)]
        for i in spelled.tolist():
            out[i] = np.array(self.solve_one(chunks[i]), np.int32)
        return out

    def solve_one(self, chunk: str) -> list[int]:
        """Best pieces of one chunk of any length."""
        t, n = self.trie, len(chunk)
        base, check, value, score = t.base, t.check, t.value, self.score
        code = t.codes(chunk).tolist()
        best, back, piece = [NEVER] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            here = best[start]
            if here + self.fallback > best[start + 1]:
                best[start + 1], back[start + 1], piece[start + 1] = here + self.fallback, start, -1
            state = 0
            for end in range(start, n):
                to = int(base[state]) + code[end]
                if not code[end] or check[to] != state:
                    break
                state = to
                if value[state] >= 0 and here + score[value[state]] > best[end + 1]:
                    best[end + 1], back[end + 1], piece[end + 1] = here + float(score[value[state]]), start, int(value[state])
        ids, end = [], n
        while end:
            ids.extend([piece[end]] if piece[end] >= 0 else reversed(self.spelled(chunk[back[end] : end])))
            end = back[end]
        return ids[::-1]

    def spelled(self, char: str) -> list[int]:
        if len(self.bytes) == 256:
            return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and offsets by text. Each distinct chunk is solved once."""
        split = [self.chunks(t) for t in texts]
        known = {c: i for i, c in enumerate(dict.fromkeys(c for cs in split for c in cs))}
        if len(self.memory) + len(known) > MEMORY:
            self.memory.clear()
        new = [c for c in known if c not in self.memory]
        short = sorted((c for c in new if len(c) <= SHORT), key=len)
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            self.memory.update(zip(part, self.solve_many(part), strict=True))
        for c in new:
            if len(c) > SHORT:
                self.memory[c] = np.array(self.solve_one(c), np.int32)
        table = [self.memory[c] for c in known]
        flat = np.concatenate([*table, np.zeros(0, np.int32)])
        length = np.array([len(x) for x in table], np.int64)
        first = np.cumsum(length) - length
        use = np.fromiter((known[c] for cs in split for c in cs), np.int64, sum(map(len, split)))
        size = length[use]
        ends = np.cumsum(size)
        ids = flat[np.repeat(first[use] - (ends - size), size) + np.arange(int(size.sum()))]
        by_text = np.cumsum([0, *map(len, split)])
        return ids, np.concatenate([[0], ends])[by_text]

    def decode(self, ids) -> str:
        """The text of ids: byte pieces joined and read as UTF-8 (a broken one as U+FFFD), marks turned to blanks, the
        blank in front taken off. Control pieces have no text."""
        ids = np.asarray(ids, np.int64)
        return self.decode_many(ids, np.array([0, len(ids)]))[0].decode("utf-8", "replace")

    def decode_many(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of several texts, from flat ids and offsets."""
        if self.spelling is None:
            each = [bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(self.text, self.kind.tolist(), strict=True)]
            size = np.array([len(x) for x in each])
            self.spelling = np.frombuffer(b"".join(each), np.uint8), np.cumsum(size) - size, size
        flat, first, sizes = self.spelling
        size = sizes[ids]
        ends = np.cumsum(size)
        data = flat[np.repeat(first[ids] - (ends - size), size) + np.arange(int(size.sum()))].tobytes()
        cuts = np.concatenate([[0], ends])[offsets].tolist()
        return [data[i + (data[i : i + 1] == b" " and i < j) : j] for i, j in zip(cuts, cuts[1:], strict=False)]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids and round_trip (decoding the ids gives the text) of every row of ``docs``.

    ``model`` is the path of a model file on the driver; tasks get the trie made from it. Null texts count as empty: no pieces, round_trip true. A
    text that holds the mark U+2581 itself comes back with a blank there, so its round_trip is false. Other columns
    aren't read; repeated rows give equal rows."""
    with open(model or default_model(), "rb") as f:
        enc = Encoder(read_model(f.read()))

    def work(column: pa.Array) -> list:
        texts = [t or "" for t in column.to_pylist()]
        ids, offsets = enc.encode(texts)
        is_byte = np.concatenate([[0], np.cumsum(enc.kind[ids] == BYTE)])
        same = [a == b for a, b in zip(enc.decode_many(ids, offsets), utf8(column), strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
        return [pa.array(np.diff(offsets)), pa.array(np.diff(is_byte[offsets])), lists, pa.array(same)]

    out = StructType([StructField("n_pieces", LongType()), StructField("n_byte_pieces", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])
    return with_batch_columns(docs.select("doc_id", "text"), ["text"], out, work).drop("text")
