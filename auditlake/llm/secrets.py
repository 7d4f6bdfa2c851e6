"""Operator 1, secret scans: a trigram index names the texts in which a rule can match, the rule's regex decides."""

from __future__ import annotations

import hashlib
import re
import sys
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from auditlake.llm.common import fresh, utf8, with_batch_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules in their order, then published token formats.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
]
MORE = [
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("github", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"(?:sk|rk)_live_[A-Za-z0-9]+", 0, 24),
]
RULES = BASE + MORE

#: Strings that an exact set holds at most while a query is derived.
MOST_STRINGS = 128
Groups = list[frozenset[frozenset[bytes]]]


def trigrams(s: bytes) -> frozenset[bytes]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> Groups:
    """What any match must contain, as an AND of groups: an OR of alternatives, each an AND of folded trigrams.

    No group means that the pattern has no mandatory trigram, so every text is a candidate."""
    exact, groups = _sequence(rp.parse(pattern, re.ASCII))
    return groups + _needs(exact) if exact is not None else groups


def _needs(strings: set[bytes]) -> Groups:
    if not strings or any(len(s) < 3 for s in strings):
        return []
    return [frozenset(trigrams(s) for s in strings)]


def _sequence(items) -> tuple[set[bytes] | None, Groups]:
    """All strings the items match, if they are few, and what they need apart from that."""
    run, groups, exact = {b""}, [], True
    for item in items:
        strings, needs = _item(*item)
        groups += needs
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            groups += _needs(run)
            exact, run = False, strings if strings is not None else {b""}
    return (run, groups) if exact else (None, groups + _needs(run))


def _folded(code: int) -> set[bytes] | None:
    return {chr(code).lower().encode()} if code < 128 else None


def _item(op, arg) -> tuple[set[bytes] | None, Groups]:
    if op is rc.LITERAL:
        return _folded(arg), []
    if op is rc.AT:
        return {b""}, []
    if op is rc.IN:
        out: set[bytes] = set()
        for kind, value in arg:
            codes = [value] if kind is rc.LITERAL else range(value[0], value[1] + 1) if kind is rc.RANGE else None
            if codes is None or len(out) + len(codes) > 8 or any(c > 127 for c in codes):
                return None, []
            for c in codes:
                out |= _folded(c)
        return out, []
    if op is rc.SUBPATTERN:
        return _sequence(arg[3])
    if op is rc.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), []
        each = [g + _needs(s) if s is not None else g for s, g in parts]
        return None, [frozenset().union(*(max(g, key=lambda x: min(map(len, x))) for g in each))] if all(each) else []
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        low, high, inner = arg
        strings, groups = _sequence(inner)
        if low == 0:
            return (strings | {b""}, []) if strings is not None and high == 1 else (None, [])
        if strings is None:
            return None, groups
        times = {b""}
        for _ in range(low):
            if len(times) * len(strings) > MOST_STRINGS:
                return None, _needs(times)
            times = {a + b for a in times for b in strings}
        return (times, []) if low == high else (None, _needs(times))
    return None, []


class TrigramIndex:
    """Postings of the trigrams that the rules ask for, over the texts of one block. ASCII letters are folded."""

    def __init__(self, texts: list[bytes], wanted: list[bytes], slot: np.ndarray):
        data = b"\0\0".join(texts).lower()
        flat = np.frombuffer(data, np.uint8)
        start = np.cumsum([0, *(len(t) + 2 for t in texts[:-1])])
        self.postings: dict[bytes, np.ndarray] = {}
        if len(flat) < 3:
            return
        code = flat[:-2].astype(np.uint32)
        code <<= 8
        code |= flat[1:-1]
        code <<= 8
        code |= flat[2:]
        found = slot[code]
        at = np.flatnonzero(found)
        text = np.searchsorted(start, at, side="right") - 1
        keys = np.unique((found[at].astype(np.int64) - 1) * len(texts) + text)
        which, text = keys // len(texts), keys % len(texts)
        cuts = np.searchsorted(which, np.arange(len(wanted) + 1))
        self.postings = {t: text[i:j] for t, i, j in zip(wanted, cuts, cuts[1:], strict=False)}

    def candidates(self, groups: Groups, n: int) -> np.ndarray:
        """Texts that satisfy a query: postings are intersected within alternatives and across groups."""
        none = np.zeros(0, np.int64)
        left = np.arange(n)
        for group in groups:
            some = none
            for alternative in group:
                lists = sorted((self.postings.get(t, none) for t in alternative), key=len)
                hits = lists[0]
                for p in lists[1:]:
                    hits = np.intersect1d(hits, p, assume_unique=True)
                some = np.union1d(some, hits)
            left = np.intersect1d(left, some, assume_unique=True)
        return left


def slots(wanted: list[bytes]) -> np.ndarray:
    """Number of each wanted trigram plus one at its code, zero elsewhere."""
    out = np.zeros(1 << 24, np.uint16)
    for i, t in enumerate(wanted):
        out[int.from_bytes(t, "big")] = i + 1
    return out


def scan(texts: list[str], raw: list[bytes], rules: list[Rule]) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of every secret of each text, sorted; offsets in code points."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({t for groups in queries for g in groups for alternative in g for t in alternative})
    return _scan(texts, raw, rules, queries, wanted, slots(wanted))


def _scan(texts, raw, rules, queries, wanted, slot) -> list[list[tuple[int, int, int]]]:
    index = TrigramIndex(raw, wanted, slot)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, groups) in enumerate(zip(rules, queries, strict=True)):
        find = re.compile(rule.pattern, re.ASCII).finditer
        if rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+") and rule.pattern.startswith("["):
            # A single class: only runs of the least length can pass, and they are the same runs.
            find = re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}", re.ASCII).finditer
        for i in index.candidates(groups, len(texts)).tolist():
            for m in find(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[i].append((m.start(), k, m.end()))
    for spans in out:
        spans.sort()
    return out


def listed(spans: list[tuple[int, int, int]], rules: list[Rule], only: int | None = None) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans if only is None or k < only)


def _block_scan(rules: list[Rule]):
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({t for groups in queries for g in groups for alternative in g for t in alternative})
    made: list[np.ndarray] = []

    def run(column: pa.Array) -> list[list[tuple[int, int, int]]]:
        if not made:
            made.append(slots(wanted))
        return _scan([t or "" for t in column.to_pylist()], utf8(column), rules, queries, wanted, made[0])

    return run


def secret_spans(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``docs``.

    Each block of texts gets an index of its own, which lives as long as the block is scanned: no shuffle, and memory
    bounded by the block. base_sha256 is the hash of kind:start:end of the base rules' spans by start, then rule;
    spans lists those of all rules. Null texts count as empty and have no spans. Spans of different kinds may overlap.
    Other columns aren't read; repeated rows give equal rows."""
    block = _block_scan(rules)
    n_base = len(BASE)

    def work(column: pa.Array) -> list:
        found = block(column)
        counts = [pa.array([sum(k == i for _, k, _ in s) for s in found], pa.int64()) for i in range(n_base)]
        digest = [hashlib.sha256(listed(s, rules, n_base).encode()).hexdigest() for s in found]
        return [*counts, pa.array(digest), pa.array([listed(s, rules) for s in found])]

    names = [*(f"n_{r.kind}" for r in BASE)]
    out = StructType([*(StructField(n, LongType()) for n in names), StructField("base_sha256", StringType()), StructField("spans", StringType())])
    return with_batch_columns(docs.select("doc_id", "text"), ["text"], out, work).drop("text")


def redacted(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by [SECRET]; overlapping spans become one. Where a column n_chars
    holds the length of the text it is set to the new one. Rows without secrets stay as they are, null texts too."""
    block = _block_scan(rules)
    clean = fresh(docs, "clean")

    def work(column: pa.Array) -> list:
        out = []
        for text, spans in zip(column.to_pylist(), block(column), strict=True):
            parts, done = [], 0
            for a, b in joined(spans):
                parts += [text[done:a], "[SECRET]"]
                done = b
            out.append("".join([*parts, text[done:]]) if spans else text)
        return [pa.array(out, pa.string())]

    made = with_batch_columns(docs, ["text"], StructType([StructField(clean, StringType())]), work)
    if "n_chars" in docs.columns:
        same = F.col("n_chars") == F.length("text")
        made = made.withColumn("n_chars", F.when(same, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return made.withColumn("text", F.col(clean)).select(*docs.columns)


def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans as (start, end), with overlapping ones made one."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _sql() -> str:
    """The same by plain regexes: text is cut into pieces that end with a match, whose lengths give the positions."""
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        keep = f"len(regexp_extract(m, '(?s){p}', {r.group})) >= {r.least}"
        parts.append(
            f"SELECT doc_id, rid, {k} AS k, '{r.kind}' AS kind, e - len(m) AS s, e FROM (SELECT doc_id, rid, unnest(ms) AS m, unnest(list_transform(range(1, len(ps) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda q: len(q))))) AS e"
            f" FROM (SELECT doc_id, rid, regexp_extract_all(text, '(?s).*?(?:{p})') AS ps, regexp_extract_all(text, '{p}') AS ms FROM d)) WHERE {keep}"
        )
    order = "ORDER BY s, k"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents), f AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' {order}) FILTER (k < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' {order}), '') AS spans
FROM d LEFT JOIN f ON d.rid = f.rid GROUP BY d.rid, d.doc_id"""


SQL = _sql()
