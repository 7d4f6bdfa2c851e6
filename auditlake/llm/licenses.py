"""Operator 5, license scans: patience alignment of stretches of a text with license templates."""

from __future__ import annotations

import bisect
import re
import sys
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from auditlake.llm import license_texts
from auditlake.llm.common import with_batch_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(license_texts)

#: Share of a template's words that has to be aligned.
COVERAGE = 0.75
#: A stretch of text is this much longer than the template, and by so many words on either side.
STRETCH, MARGIN = 1.25, 5
TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    #: Words of which a match at COVERAGE holds one at least, with the first place of each.
    signs: dict[str, int]


def template(name: str, text: str) -> Template:
    """Signs are the words that are rarest in license prose and longest; enough of them that without any a match would
    fall short of COVERAGE."""
    words = tuple(TOKEN.findall(text.lower()))
    count = Counter(words)
    common = set(license_texts.COMMON)
    order = sorted(count, key=lambda w: (w in common, w.isdigit(), -len(w), w))
    signs, left = {}, len(words)
    for w in order:
        if left < COVERAGE * len(words):
            break
        signs[w] = words.index(w)
        left -= count[w]
    return Template(name, words, signs)


def templates() -> list[Template]:
    return [template(name, text) for name, text in license_texts.TEMPLATES]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first, whose second members rise: patience piles with back links."""
    tops: list[int] = []
    pile_at: list[int] = []
    before: list[int] = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect.bisect_left(tops, y)
        before[i] = pile_at[k - 1] if k else -1
        if k == len(tops):
            tops.append(y)
            pile_at.append(i)
        else:
            tops[k], pile_at[k] = y, i
    out, i = [], pile_at[-1] if pile_at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: list[str], b: tuple[str, ...]) -> list[tuple[int, int]]:
    """Places (in a, in b) of aligned equal words, rising in both.

    A gap first loses its common ends; then words that occur once on both sides of it are anchors, the longest rising
    run of them stays, and the gaps between are aligned alike. A gap without anchors stays open."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, m = gaps.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        at = {w: x for x, w in enumerate(b[k:m], k) if in_b[w] == 1}
        anchors = increasing([(x, at[w]) for x, w in enumerate(a[i:j], i) if in_a[w] == 1 and w in at])
        if not anchors:
            continue
        out.extend(anchors)
        for (x, y), (x2, y2) in zip([(i - 1, k - 1), *anchors], [*anchors, (j, m)], strict=True):
            gaps.append((x + 1, x2, y + 1, y2))
    return sorted(out)


@dataclass(frozen=True)
class Match:
    name: str
    matched: int
    total: int
    first: int
    last: int


def matches(words: list[str], known: list[Template]) -> list[Match]:
    """Licenses of a text by place: of matches that overlap the one with most aligned words stays, then the one with the
    greatest coverage, then the first by name."""
    places: dict[str, list[int]] = {}
    signs = {w for t in known for w in t.signs}
    for i, w in enumerate(words):
        if w in signs:
            places.setdefault(w, []).append(i)
    found = []
    for t in known:
        n, done, tried = len(t.words), -1, -1
        for at, w in sorted((i, w) for w in t.signs for i in places.get(w, ())):
            if at <= done:
                continue
            start = max(0, at - int(STRETCH * t.signs[w]) - MARGIN)
            if start == tried:
                continue
            tried = start
            end = min(len(words), start + int(STRETCH * n) + 2 * MARGIN)
            pairs = align(words[start:end], t.words)
            if len(pairs) >= COVERAGE * n:
                found.append(Match(t.name, len(pairs), n, start + pairs[0][0], start + pairs[-1][0]))
                done = start + pairs[-1][0]
    found.sort(key=lambda x: (-x.matched, -x.matched / x.total, x.name, x.first))
    out: list[Match] = []
    spans: list[tuple[int, int]] = []
    for x in found:
        k = bisect.bisect_left(spans, (x.first, x.last))
        if (k < len(spans) and spans[k][0] <= x.last) or (k and spans[k - 1][1] >= x.first):
            continue
        spans.insert(k, (x.first, x.last))
        out.append(x)
    return sorted(out, key=lambda x: x.first)


def folded(text: str) -> str:
    """Lower case of ASCII letters only, so that places stay."""
    return text.translate(_FOLD)


_FOLD = {c: c + 32 for c in range(65, 91)}


def license_spans(docs: DataFrame, known: list[Template] | None = None) -> DataFrame:
    """doc_id, n_licenses, license, coverage, licenses of every row of ``docs``.

    ``licenses`` lists name:start:end:aligned/words of every license by place (code points, end exclusive), ``license``
    is the one with most aligned words (ties: first in the text), ``coverage`` its share of aligned template words.
    Texts without a license, null and empty ones among them, have 0, null, 0 and an empty list. Other columns aren't
    read; repeated rows give equal rows.

    A stretch is tried wherever the text has a word that any match of the template must hold one of, so no text is
    skipped that could match."""
    known = known or templates()
    signs = {w for t in known for w in t.signs}

    def work(column: pa.Array) -> list:
        rows = []
        for text in column.to_pylist():
            low = folded(text or "")
            words = TOKEN.findall(low)
            got = [] if signs.isdisjoint(words) else matches(words, known)
            if not got:
                rows.append((0, None, 0.0, ""))
                continue
            spots = [m.span() for m in TOKEN.finditer(low)]
            best = max(got, key=lambda x: (x.matched, -x.first))
            listed = ",".join(f"{x.name}:{spots[x.first][0]}:{spots[x.last][1]}:{x.matched}/{x.total}" for x in got)
            rows.append((len(got), best.name, best.matched / best.total, listed))
        n, name, coverage, listed = zip(*rows, strict=True)
        return [pa.array(n, pa.int64()), pa.array(name, pa.string()), pa.array(coverage, pa.float64()), pa.array(listed, pa.string())]

    out = StructType([StructField("n_licenses", LongType()), StructField("license", StringType()), StructField("coverage", DoubleType()), StructField("licenses", StringType())])
    return with_batch_columns(docs.select("doc_id", "text"), ["text"], out, work).drop("text")
