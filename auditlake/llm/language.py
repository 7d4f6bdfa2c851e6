"""Operator 2, language ID: a bidirectional gated recurrent network over bytes, trained here in numpy."""

from __future__ import annotations

import random
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from auditlake.llm.common import fresh, utf8, with_batch_columns

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Units per direction; bytes in a window of prediction; windows computed together.
UNITS, WINDOW, TOGETHER = 16, 128, 1024
#: The bounded training sample: documents per language, windows per document, characters per window.
DOCS_PER_LANG, WINDOWS_PER_DOC, TRAIN_CHARS = 1200, 4, 64
STEPS, BATCH, RATE, SEED = 600, 256, 0.02, 11
#: Labels that a model can tell apart at most.
MOST_LANGS = 500
#: Learned beside the languages where documents are to be rejected: made-up texts that are none of them.
NEITHER = "\0neither"
#: A document is rejected if its share of NEITHER is above that of all but this share of the labelled sample, and above
#: LEAST_NEITHER; texts of up to SHORT bytes are held against single windows of the sample.
REJECTED, LEAST_NEITHER, SHORT = 0.005, 0.4, 256
UNKNOWN = "und"
# Scripts that made-up texts are written in, by code point ranges, and vowels of Latin letters.
SCRIPTS = ((0x61, 0x7A), (0x3B1, 0x3C9), (0x430, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3093), (0x30A1, 0x30F3), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
VOWELS = "aeiouyàáâäèéêëìíîïòóôöùúûü"


class Net:
    """Weights by direction (0 forward, 1 backward): bytes to gates, state to gates, state bias; then both states to
    languages. Gates come in the order update, reset, candidate. Units are the rows of every matrix, so that the gates
    of a batch are contiguous."""

    def __init__(self, n_langs: int, units: int = UNITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.units = units
        self.w = {
            "x": rng.normal(0, 0.3, (2, 3 * units, 256)).astype(f),
            "u": rng.normal(0, 1 / np.sqrt(units), (2, 3 * units, units)).astype(f),
            "b": np.zeros((2, units, 1), f),
            "v": rng.normal(0, 0.3, (2, n_langs, units)).astype(f),
            "c": np.zeros((n_langs, 1), f),
        }

    def states(self, x: np.ndarray, real: np.ndarray, direction: int, keep: list | None = None) -> np.ndarray:
        """States (time, unit, row) of one direction over bytes x (time, row); the backward one reads from the end.

        Where ``real`` is false there is no byte: the state there is empty, so rows don't feel their padding."""
        k = self.units
        wx, u, b = (self.w[name][direction] for name in "xub")
        time, rows = x.shape
        out = np.empty((time, k, rows), np.float32)
        h = np.zeros((k, rows), np.float32)
        g, a = np.empty((3 * k, rows), np.float32), np.empty((3 * k, rows), np.float32)
        whole = real.all(axis=1)
        for t in range(time) if direction == 0 else range(time - 1, -1, -1):
            np.take(wx, x[t], axis=1, out=g, mode="clip")
            np.matmul(u, h, out=a)
            zr = g[: 2 * k] + a[: 2 * k]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            z, r = zr[:k], zr[k:]
            s = a[2 * k :] + b
            n = r * s
            n += g[2 * k :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((t, h, z, r, s, n))
            new = out[t]
            np.subtract(h, n, out=new)
            new *= z
            new += n
            if not whole[t]:
                new *= real[t]
            h = new
        return out

    def probabilities(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """Language probabilities at every position (time, language, row)."""
        logits = self.w["v"][0] @ forward
        logits += self.w["v"][1] @ backward
        logits += self.w["c"]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, lang: np.ndarray, real: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients by backpropagation through time. x (time, row) bytes, real (time, row) marks no padding."""
        k, w = self.units, self.w
        kept: list[list] = [[], []]
        h = [self.states(x, real, d, kept[d]) for d in (0, 1)]
        p = self.probabilities(*h)
        rows = x.shape[1]
        at = (slice(None), lang, np.arange(rows))
        weight = real.astype(np.float32) / max(real.sum(), 1)
        loss = float(-(np.log(np.maximum(p[at], 1e-9)) * weight).sum())
        p[at] -= 1
        p *= weight[:, None, :]
        g = {name: np.zeros_like(v) for name, v in w.items()}
        g["c"][:, 0] = p.sum((0, 2))
        for d in (0, 1):
            g["v"][d] = np.matmul(p, h[d].transpose(0, 2, 1)).sum(0)
            from_out = w["v"][d].T @ p
            dh = np.zeros((k, rows), np.float32)
            gates, bytes_at = [], []
            for t, prev, z, r, s, n in reversed(kept[d]):
                dh = (dh + from_out[t]) * real[t]
                da = dh * (1 - z) * (1 - n * n)
                dz = dh * (prev - n) * z * (1 - z)
                dr = da * s * r * (1 - r)
                state = np.concatenate([dz, dr, da * r])
                g["b"][d] += state[2 * k :].sum(axis=1, keepdims=True)
                g["u"][d] += state @ prev.T
                gates.append(np.concatenate([dz, dr, da]))
                bytes_at.append(x[t])
                dh = dh * z + w["u"][d].T @ state
            flat, where = np.concatenate(gates, axis=1), np.concatenate(bytes_at)
            order = np.argsort(where, kind="stable")
            seen, first = np.unique(where[order], return_index=True)
            g["x"][d][:, seen] = np.add.reduceat(flat[:, order], first, axis=1)
        return loss, g


def padded(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (width, row) and which of them are real."""
    x = np.zeros((len(texts), width), np.uint8)
    for i, t in enumerate(texts):
        x[i, : len(t[:width])] = np.frombuffer(t[:width], np.uint8)
    size = np.array([min(len(t), width) for t in texts])
    return x.T.copy(), np.arange(width)[:, None] < size[None, :]


def train(texts: list[bytes], langs: list[str], steps: int | None = None, units: int = UNITS) -> tuple[Net, list[str]]:
    """A network and its languages from short labelled texts, with Adam over random batches that draw languages evenly."""
    names, steps = sorted(set(langs)), steps or STEPS
    net = Net(len(names), units)
    rng = np.random.default_rng(SEED)
    of = [np.array([i for i, x in enumerate(langs) if x == name]) for name in names]
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    for step in range(1, steps + 1):
        lang = rng.integers(len(names), size=BATCH)
        rows = [int(of[j][rng.integers(len(of[j]))]) for j in lang]
        x, real = padded([texts[i] for i in rows], TRAIN_CHARS)
        _, g = net.gradients(x, lang, real)
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in g:
            a = g[k] * min(1.0, 1 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            net.w[k] = (net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net, names


def pooled(net: Net, texts: list[bytes]) -> np.ndarray:
    """Mean over all positions of a text of the language probabilities there (row, language); zero for empty texts.

    A text is read in windows of WINDOW bytes, each from an empty state in both directions."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(texts)), count)
    inside = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    start = np.repeat(np.cumsum(size) - size, count) + inside
    width = np.minimum(size[doc] - inside, WINDOW)
    total = np.zeros((len(texts), len(net.w["c"])))
    order = np.argsort(-width, kind="stable")
    for i in range(0, len(order), TOGETHER):
        part = order[i : i + TOGETHER]
        longest = int(width[part[0]])
        at = start[part][None, :] + np.arange(longest)[:, None]
        real = np.arange(longest)[:, None] < width[part][None, :]
        x = np.where(real, flat[np.minimum(at, len(flat) - 1)], 0)
        p = net.probabilities(net.states(x, real, 0), net.states(x, real, 1))
        p *= real[:, None, :]
        np.add.at(total, doc[part], p.sum(axis=0).T)
    return total / np.maximum(size, 1)[:, None]


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def has_letter():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def sampled(docs: DataFrame) -> tuple[list[list[str]], list[str]]:
    """Stretches and language of a bounded sample of the labelled documents that aren't held out: DOCS_PER_LANG of each
    language by the smallest hash of the id, and WINDOWS_PER_DOC stretches of TRAIN_CHARS characters from places all over
    each."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & ~held_out() & has_letter())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()}
    if not counts:
        return [], []
    rows = rows.where(F.col("lang").isin(list(counts)))
    order = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    share = {lang: min(1.0, (1.5 * DOCS_PER_LANG + 50) / n) for lang, n in counts.items()}
    limits = F.create_map(*[F.lit(y) for lang, s in share.items() for y in (lang, int(s * 2**40))])
    near = rows.where(F.pmod(order, F.lit(2**40)) < F.element_at(limits, F.col("lang")))
    stretches = F.transform(
        F.sequence(F.lit(0), F.lit(WINDOWS_PER_DOC - 1)),
        lambda i: F.substring("text", (F.lit(1) + F.pmod(F.xxhash64(order, i), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1)))).cast("int"), F.lit(TRAIN_CHARS)),
    )
    picked = near.select("lang", F.pmod(order, F.lit(2**40)).alias("at"), stretches.alias("stretches")).toArrow().to_pylist()
    picked.sort(key=lambda r: (r["lang"], r["at"], r["stretches"]))
    texts, langs, taken = [], [], dict.fromkeys(counts, 0)
    for r in picked:
        if taken[r["lang"]] < DOCS_PER_LANG:
            taken[r["lang"]] += 1
            texts.append(list(dict.fromkeys(r["stretches"])))
            langs.append(r["lang"])
    return texts, langs


def learn(docs: DataFrame) -> tuple[Net | None, list[str]]:
    """A model from the sample of ``docs``; the languages are the MOST_LANGS commonest at most."""
    return trained(*sampled(docs))


def trained(texts: list[list[str]], langs: list[str]) -> tuple[Net | None, list[str]]:
    if not langs:
        return None, []
    return train([s.encode() for t in texts for s in t], [x for t, x in zip(texts, langs, strict=True) for _ in t])


def made_up(text: str, rng: random.Random) -> str:
    """A text of no learned language, in the outer shape of ``text``: its letters in any order, its letters exchanged for
    others of their kind throughout, or letters of some script drawn at random."""
    way = rng.randrange(3)
    if way == 0:
        letters = [c for c in text if c.isalpha()]
        rng.shuffle(letters)
        return "".join(letters.pop() if c.isalpha() else c for c in text)
    if way == 1:
        lower = "".join(chr(c) for c in range(0x61, 0x7B)) + "àáâäèéêëìíîïòóôöùúûüçñß"
        change = {}
        for group in ([c for c in lower if c in VOWELS], [c for c in lower if c not in VOWELS]):
            plain = [c for c in group if c < "{"]
            for c, d in zip(group, rng.sample(group, len(group)) if rng.random() < 0.3 else [*rng.sample(plain, len(plain)), *rng.choices(plain, k=len(group) - len(plain))], strict=True):
                change[c] = d
        return "".join(change.get(c, c) for c in text.lower())
    low, high = SCRIPTS[0] if rng.random() < 0.4 else rng.choice(SCRIPTS)
    return "".join(chr(rng.randint(low, high)) if c.isalpha() else c for c in text)


def learn_known(docs: DataFrame) -> tuple[Net | None, list[str], float, float]:
    """A model with NEITHER as a further language, and the shares of it above which a short or a long text is rejected,
    as the labelled sample has them."""
    texts, langs = sampled(docs)
    if not langs:
        return None, [], 1.0, 1.0
    rng = random.Random(SEED)
    others = [[made_up(s, rng) for s in t] for t in texts]
    net, names = trained([*texts, *others], [*langs, *([NEITHER] * len(others))])
    at = names.index(NEITHER)
    single = pooled(net, [s.encode() for t in texts for s in t])[:, at]
    whole = pooled(net, ["".join(t).encode() for t in texts])[:, at]
    limits = [max(LEAST_NEITHER, float(np.quantile(x, 1 - REJECTED))) for x in (single, whole)]
    return net, names, *limits


def with_language(docs: DataFrame, model: tuple[Net | None, list[str]], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with predicted language and its probability, from the text alone.

    Null texts and texts without a letter get ``und`` and 0, as does every text if nothing was learned. Ties go to the
    language whose name sorts first."""
    net, names = model
    letter = fresh(docs, "has_letter")

    def work(text: pa.Array, letters: pa.Array) -> list:
        got = letters.to_numpy(zero_copy_only=False)
        langs, scores = [UNKNOWN] * len(got), np.zeros(len(got))
        if net is not None and got.any():
            raw = utf8(text)
            at = np.flatnonzero(got)
            p = pooled(net, [raw[i] for i in at])
            best = p.argmax(axis=1)
            scores[at] = np.clip(p[np.arange(len(at)), best], 0, 1)
            for i, b in zip(at, best, strict=True):
                langs[i] = names[b]
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    out = StructType([StructField(pred, StringType()), StructField(score, DoubleType())])
    return with_batch_columns(docs.withColumn(letter, has_letter()), ["text", letter], out, work).drop(letter)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang); other columns aren't read.

    Null ids are not held out. Repeated rows get equal answers. Empty tables give empty results."""
    model = learn(docs)
    return with_language(docs.select("doc_id", "text").withColumn("held_out", held_out()), model).drop("text")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the learned languages: it has a letter, and no more of NEITHER than
    nearly all labelled documents have. Texts that mix learned languages stay. Without labels only letters count."""
    net, names, short, long = learn_known(docs)
    kept, letter = fresh(docs, "kept"), fresh(docs, "has_letter")

    def work(text: pa.Array, letters: pa.Array) -> list:
        keep = letters.to_numpy(zero_copy_only=False).astype(bool)
        if net is not None and keep.any():
            raw, at = utf8(text), np.flatnonzero(keep)
            share = pooled(net, [raw[i] for i in at])[:, names.index(NEITHER)]
            keep[at] = share <= np.where([len(raw[i]) <= SHORT for i in at], short, long)
        return [pa.array(keep, pa.bool_())]

    told = with_batch_columns(docs.withColumn(letter, has_letter()), ["text", letter], StructType([StructField(kept, BooleanType())]), work)
    return told.where(kept).select(*docs.columns)
