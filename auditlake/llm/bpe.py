"""Operator 13, BPE encoding and decoding: the last token of every prefix, from suffix automaton matches."""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from auditlake.llm.common import with_batch_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pre-tokens and token pairs that a task remembers; beyond that it starts afresh.
MEMORY, PAIRS = 400_000, 1_000_000
#: Pre-tokens solved at once; characters of the texts encoded at once.
AT_ONCE, TOGETHER = 20_000, 4_000_000
# Fixed value: the pattern of byte-level pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable Latin-1 characters for themselves, the other
    bytes in order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class SuffixAutomaton:
    """Suffix automaton of a set of byte strings: a state for every class of substrings with the same ends. ``link``
    leads to the longest suffix in another class, ``length`` is that of the longest string of the class."""

    def __init__(self, words: list[bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for w in words:
            last = 0
            for c in w:
                last = self._extend(last, c)

    def _new(self, edges: dict[int, int], link: int, length: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest string and c; parted from a class that holds longer strings too."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._new(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.link[q] = part
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = part
            p = self.link[p]
        return part

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        made, p = self._new({}, 0, self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, c)
        return made

    def state(self, word: bytes) -> int:
        at = 0
        for c in word:
            at = self.next[at][c]
        return at


class Vocabulary:
    """What a tokenizer file says, as plain arrays: bytes of every id, the two parts and the rank of every merged token,
    and the automaton over all tokens that merges can reach. Raises ValueError for a file of another kind."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd or spec.get("normalizer"):
            raise ValueError(f"not a plain BPE tokenizer: {odd or model.get('type')}")
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("not byte-level pre-tokens by the usual pattern")
        if (spec.get("decoder") or {}).get("type") != "ByteLevel":
            raise ValueError("not a byte-level decoder")
        letters = byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings")
        ids = {bytes(letters[c] for c in piece): i for piece, i in model["vocab"].items() if all(c in letters for c in piece)}
        if any(bytes([b]) not in ids for b in range(256)):
            raise ValueError("not all bytes are tokens")
        n = max([*model["vocab"].values(), *self.specials.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * n
        for text, i in [*ids.items(), *((s.encode(), i) for s, i in self.specials.items())]:
            self.bytes_of[i] = text
        self.rank, self.left, self.right = (np.full(n, -1, np.int32) for _ in range(3))
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = model["vocab"][a], model["vocab"][b]
            whole = model["vocab"][a + b]
            self.pairs[pair] = rank
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, *pair
        if any(self.rank[i] <= max(self.rank[self.left[i]], self.rank[self.right[i]]) for i in ids.values() if self.rank[i] >= 0):
            raise ValueError("a merge comes before those that make its parts")
        reached = {text: i for text, i in ids.items() if len(text) == 1 or self.merged(text, ids) == [i]}
        automaton = SuffixAutomaton(list(reached))
        self.link, self.length = np.array(automaton.link, np.int32), np.array(automaton.length, np.int32)
        self.token = np.full(len(self.link), -1, np.int32)
        for text, i in reached.items():
            self.token[automaton.state(text)] = i
        # By state: the nearest on the way of links, itself included, that is a token.
        self.near = np.zeros(len(self.link), np.int32)
        for s in np.argsort(self.length, kind="stable"):
            self.near[s] = s if self.token[s] >= 0 else self.near[self.link[s]] if self.link[s] >= 0 else 0
        self.edges = np.array([(s << 8 | c, t) for s, e in enumerate(automaton.next) for c, t in e.items()], np.int64)

    def merged(self, text: bytes, ids: dict[bytes, int]) -> list[int]:
        """Tokens of a short text by plain merging, lowest rank first, leftmost of equals."""
        parts = [ids[bytes([c])] for c in text]
        while len(parts) > 1:
            rank, at = min((self.pairs.get(p, len(self.pairs)), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.pairs):
                break
            parts[at : at + 2] = [ids[self.bytes_of[parts[at]] + self.bytes_of[parts[at + 1]]]]
        return parts


class Encoder:
    """Encodes and decodes with a vocabulary; what it has seen of pre-tokens and pairs is remembered, within bounds."""

    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.edges = dict(zip(v.edges[:, 0].tolist(), v.edges[:, 1].tolist(), strict=True))
        self.link, self.length, self.near, self.token = (x.tolist() for x in (v.link, v.length, v.near, v.token))
        self.rank, self.left, self.right, self.pairs = v.rank.tolist(), v.left.tolist(), v.right.tolist(), v.pairs
        self.beyond = [self.near[x] if x >= 0 else 0 for x in self.link]
        self.bytes_of, self.specials = v.bytes_of, v.specials
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(v.specials, key=len, reverse=True)) + ")") if v.specials else None
        self.pre_tokens = regex.compile(PATTERN).findall
        self.known: dict[str | int, tuple[int, ...]] = {}
        self.fitting: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b side by side stay as they are: going back in time, merge by merge, no pair across their border
        would have been merged before the merge that is undone. Of equal ranks the left one comes first."""
        before = len(self.pairs)
        while True:
            if self.pairs.get((a, b), before) < before:
                return False
            if self.rank[a] > self.rank[b]:
                before, a = self.rank[a], self.right[a]
            elif self.rank[b] >= 0:
                before, b = self.rank[b] + 1, self.left[b]
            else:
                return True

    def solve(self, texts: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens in sorted order. The last token of a prefix is the one token that ends there and fits behind
        the last token of what it leaves; candidates come from the automaton, longest first. What a pre-token shares
        with the one before it in front is known already, since it depends on the prefix alone."""
        edges, link, length, token, fitting, bytes_of = self.edges, self.link, self.length, self.token, self.fitting, self.bytes_of
        near, beyond = self.near, self.beyond
        # By prefix length: the last token, and the automaton's state with the length of its match.
        last, states, matches = [0], [0], [0]
        out, before = [], b""
        for text in texts:
            done = 0
            for x, y in zip(before, text, strict=False):
                if x != y:
                    break
                done += 1
            del last[done + 1 :], states[done + 1 :], matches[done + 1 :]
            state, matched, end = states[done], matches[done], done
            for c in text[done:] if done else text:
                end += 1
                to = edges.get(state << 8 | c)
                while to is None:
                    state = link[state]
                    matched = length[state]
                    to = edges.get(state << 8 | c)
                state = to
                matched += 1
                at = near[state] if matched == length[state] else beyond[state]
                start = end - length[at]
                while start:
                    pair = last[start] << 20 | token[at]
                    fit = fitting.get(pair)
                    if fit is None:
                        if len(fitting) >= PAIRS:
                            fitting.clear()
                        fit = fitting[pair] = self.fits(last[start], token[at])
                    if fit:
                        break
                    at = beyond[at]
                    start = end - length[at]
                last.append(token[at])
                states.append(state)
                matches.append(matched)
            ids = []
            while end:
                t = last[end]
                ids.append(t)
                end -= len(bytes_of[t])
            out.append(tuple(ids[::-1]))
            before = text
        return out

    def learn(self, pre_tokens: set[str]) -> None:
        """Solves the pre-tokens that aren't known yet."""
        new = sorted(p.encode() for p in pre_tokens if p not in self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = sorted(p.encode() for p in pre_tokens)
        for i in range(0, len(new), AT_ONCE):
            part = new[i : i + AT_ONCE]
            self.known.update(zip((p.decode() for p in part), self.solve(part), strict=True))

    def parts(self, text: str) -> list:
        """Pre-tokens of a text as strings; a special string of the file as its id."""
        if self.special is None or not self.special.search(text):
            return self.pre_tokens(text)
        out: list = []
        for i, part in enumerate(self.special.split(text)):
            out += [self.specials[part]] if i % 2 else self.pre_tokens(part)
        return out

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of every text; each distinct pre-token of the texts is solved once."""
        cut = [self.parts(t) for t in texts]
        self.learn(set().union(*cut).difference(self.specials.values()))
        known = self.known
        for i in self.specials.values():
            known[i] = (i,)
        return [list(chain.from_iterable(map(known.__getitem__, parts))) for parts in cut]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(tokenizer: str | None = None) -> Vocabulary:
    """The vocabulary of a tokenizer file on the driver; its size, not the input's, bounds what tasks get."""
    with open(os.path.abspath(tokenizer or default_tokenizer()), encoding="utf-8") as f:
        return Vocabulary(f.read())


def together(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts of up to about TOGETHER characters, null as empty."""
    held, size = [], 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _shared(vocabulary: Vocabulary):
    """An encoder per task, made when its first batch comes."""
    held: list[Encoder] = []

    def get() -> Encoder:
        if not held:
            held.append(Encoder(vocabulary))
        return held[0]

    return get


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids of every row of ``docs`` (doc_id, text). Null texts count as empty and have no ids; other columns aren't
    read; repeated rows give equal rows. One narrow stage."""
    encoder = _shared(load(tokenizer))

    def work(column: pa.Array) -> list:
        ids = [i for texts in together(column.to_pylist()) for i in encoder().encode_all(texts)]
        return [pa.array(ids, pa.list_(pa.int32()))]

    out = StructType([StructField("ids", ArrayType(IntegerType()))])
    return with_batch_columns(docs.select("doc_id", "text"), ["text"], out, work).drop("text")


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids); null ids give an empty text."""
    encoder = _shared(load(tokenizer))

    def work(column: pa.Array) -> list:
        return [pa.array([encoder().decode(i or []) for i in column.to_pylist()], pa.string())]

    return with_batch_columns(encoded.select("doc_id", "ids"), ["ids"], StructType([StructField("text", StringType())]), work).drop("ids")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 (of the ids decoded again) of every
    row of ``docs``: encoded and decoded in one pass, with neither kept. Rows as in ``encode_documents``."""
    encoder = _shared(load(tokenizer))
    names: list[str] = []

    def work(column: pa.Array) -> list:
        e = encoder()
        if not names:
            names.extend(map(str, range(len(e.bytes_of))))
        counts, of_ids, of_text = [], [], []
        for texts in together(column.to_pylist()):
            for ids in e.encode_all(texts):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)]

    out = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])
    return with_batch_columns(docs.select("doc_id", "text"), ["text"], out, work).drop("text")
