"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its prefixes,
so that inflected and compounded forms share what was learned.  Filters of
several widths run over the words of the whole text, each filter keeps its
largest response (max pooling), and a logistic layer scores the pooled vector.
A threshold per language is calibrated on rows kept out of fitting; language is
no input of the score.

Because convolution is linear before the pooling, a word's contribution to each
filter at each offset is worked out once per distinct word, and scoring a text
is a lookup, a few additions and a maximum per word, in bounded pieces.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brontide.llm.common import Plain, appended, least_by_hash, small_batches, stored, with_columns

#: Rows of each class that are fitted on, at most, and the longest text among them.
SAMPLE = 4000
SAMPLE_CHARS = 32_768
BUCKETS = 1 << 16
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 6
PREFIXES = (4, 5, 6, 7)
EPOCHS = 6
#: Words that one step of scoring holds responses for.
PIECE = 1 << 16
_STRIP = ".,;:!?\"'()[]{}*#$%&|<>-_…«»“”‘’"


def word_features(raw: str) -> list[int]:
    """Hashes of a word and of its prefixes of so many bytes; a word that is shorter stands for its prefix."""
    w = raw.lower().strip(_STRIP).encode("utf-8", "replace")
    return [zlib.crc32(w), *(zlib.crc32(w[:n]) for n in PREFIXES)]


def embedding_rows(features: list[list[int]]) -> np.ndarray:
    """Rows of the embedding for lists of hashes, each kind of feature spread its own way.  Row 0 is kept for padding."""
    kinds = np.arange(1 + len(PREFIXES), dtype=np.uint64) * np.uint64(0x9E3779B1)
    return ((np.array(features, np.uint64).reshape(-1, len(kinds)) + kinds) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1


@dataclass
class ToxicModel:
    embedding: np.ndarray  # (BUCKETS, DIM), row 0 zero
    kernels: np.ndarray  # (offsets, DIM, FILTERS): the offsets of all widths, one width after the other
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    dense: np.ndarray
    shift: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def responses(self, features: np.ndarray) -> np.ndarray:
        """(words, offsets * FILTERS): what a word adds to each filter at each offset."""
        e = self.embedding[features].sum(axis=1)
        return np.einsum("wd,dk->wk", e, self.kernels.transpose(1, 0, 2).reshape(DIM, -1))  # the same for a word, whichever come with it

    def score(self, pooled: np.ndarray) -> np.ndarray:
        z = self.scale[0] * (np.einsum("ij,j->i", np.maximum(pooled + self.bias, 0), self.dense) + self.shift) + self.scale[1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pool(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Largest response of each filter over the words ids, padded with word 0 so that every width has a window."""
    pad = max(WIDTHS) - 1
    best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
    ids = np.concatenate((ids, np.zeros(pad + (len(ids) == 0), ids.dtype)))
    for at in range(0, max(1, len(ids) - pad), PIECE):
        r = rows[ids[at : at + PIECE + pad]]
        o = 0
        for k, width in enumerate(WIDTHS):
            n = len(r) - width + 1
            if n > 0:
                y = r[:n, o * FILTERS : (o + 1) * FILTERS]
                for j in range(1, width):
                    y = y + r[j : j + n, (o + j) * FILTERS : (o + j + 1) * FILTERS]
                np.maximum(best[k * FILTERS : (k + 1) * FILTERS], y.max(axis=0), out=best[k * FILTERS : (k + 1) * FILTERS])
            o += width
    return best


class Words(dict):
    """Numbers of the words met so far, from 1."""

    def __init__(self):
        super().__init__()
        self.met: list[str] = []

    def __missing__(self, word: str) -> int:
        self.met.append(word)
        self[word] = n = len(self.met)  # 0 is the padding
        return n

    def rows_since(self, n: int) -> np.ndarray:
        """Embedding rows of the words from number n on."""
        made = embedding_rows([word_features(w) for w in self.met[max(0, n - 1) :]])
        return made if n else np.concatenate((np.zeros((1, 1 + len(PREFIXES)), np.int64), made))

    def __len__(self) -> int:
        return len(self.met) + 1


def _train(texts: list[str], y: np.ndarray, seed: int = 5, epochs: int = EPOCHS) -> ToxicModel:
    """Adagrad on the logistic loss, classes weighing the same; the pooling passes gradients to the winning windows only."""
    rng = np.random.default_rng(seed)
    words = Words()
    tail = [0] * (max(WIDTHS) - 1)
    docs = [np.array(([words[w] for w in t.split()] or [0]) + tail, np.int32) for t in texts]
    distinct = [(own, inverse.astype(np.int32)) for own, inverse in (np.unique(d, return_inverse=True) for d in docs)]
    feats = words.rows_since(0)
    offsets = sum(WIDTHS)
    m = ToxicModel(
        rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32),
        rng.normal(0, 0.3, (offsets, DIM, FILTERS)).astype(np.float32),
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32),
        0.0,
    )
    m.embedding[0] = 0
    seen = [np.full(a.shape, 1e-6, np.float32) for a in (m.embedding, m.kernels, m.bias, m.dense)]
    seen_shift = 1e-6
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    starts = np.cumsum([0, *WIDTHS[:-1]])
    for epoch in range(epochs):
        rate = 0.08 / (1 + 0.3 * epoch)
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 16):
            batch = order[at : at + 16]
            g_e: dict[str, list] = {"rows": [], "grad": []}
            g_k, g_b, g_d, g_s = np.zeros_like(m.kernels), np.zeros_like(m.bias), np.zeros_like(m.dense), 0.0
            for i in batch:
                ids, (own, inverse) = docs[i], distinct[i]
                e = m.embedding[feats[own]].sum(axis=1)
                r = (e @ m.kernels.transpose(1, 0, 2).reshape(DIM, -1))[inverse].reshape(len(ids), offsets, FILTERS)
                pooled, win = np.empty(len(m.bias), np.float32), np.empty(len(m.bias), np.int64)
                for k, width in enumerate(WIDTHS):
                    n = len(ids) - width + 1
                    z = sum(r[j : j + n, starts[k] + j] for j in range(width))
                    win[k * FILTERS : (k + 1) * FILTERS] = z.argmax(axis=0)
                    pooled[k * FILTERS : (k + 1) * FILTERS] = z.max(axis=0)
                act = np.maximum(pooled + m.bias, 0)
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(act @ m.dense + m.shift)))))
                d = (p - y[i]) * weight[i]
                g_d += d * act
                g_s += d
                back = d * m.dense * (act > 0)
                g_b += back
                for k, width in enumerate(WIDTHS):
                    for j in range(width):
                        cols = slice(k * FILTERS, (k + 1) * FILTERS)
                        hit = ids[win[cols] + j]
                        ev = m.embedding[feats[hit]].sum(axis=1)  # (FILTERS, DIM)
                        g_k[starts[k] + j] += ev.T * back[cols]
                        ge = m.kernels[starts[k] + j].T * back[cols][:, None]
                        g_e["rows"].append(feats[hit].reshape(-1))
                        g_e["grad"].append(np.repeat(ge, feats.shape[1], axis=0))
            for a, s, g in ((m.kernels, seen[1], g_k), (m.bias, seen[2], g_b), (m.dense, seen[3], g_d)):
                g = g / len(batch) + (1e-5 * a)
                s += g * g
                a -= rate * g / np.sqrt(s)
            g_s /= len(batch)
            seen_shift += g_s * g_s
            m.shift -= rate * g_s / math.sqrt(seen_shift)
            rows, grads = np.concatenate(g_e["rows"]), np.concatenate(g_e["grad"]) / len(batch)
            own, inverse = np.unique(rows, return_inverse=True)
            total = np.zeros((len(own), DIM), np.float32)
            np.add.at(total, inverse, grads)
            seen[0][own] += total * total
            m.embedding[own] -= rate * total / np.sqrt(seen[0][own])
            m.embedding[0] = 0
    return m


class Scorer:
    """Scores whole texts; holds responses of the words met, and starts anew when they are too many."""

    def __init__(self, model: ToxicModel, most: int = 150_000):
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        self.words, self.n = Words(), 0
        self.rows = np.zeros((1024, sum(WIDTHS) * FILTERS), np.float32)

    def _numbers(self, split: list[str]) -> np.ndarray:
        """Numbers of words, whose responses are in self.rows afterwards."""
        if len(self.words) > self.most:
            self._clear()
        words = self.words
        ids = np.array([words[w] for w in split], np.int64)
        if len(words) > self.n:
            if len(words) > len(self.rows):
                grown = np.zeros((2 * len(words), self.rows.shape[1]), np.float32)
                grown[: self.n] = self.rows[: self.n]
                self.rows = grown
            self.rows[self.n : len(words)] = self.model.responses(words.rows_since(self.n))
            self.n = len(words)
        return ids

    def pooled(self, text: str | None) -> np.ndarray:
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
        split = (text or "").split()
        step = 1 << 18  # words numbered at a time, with the windows that reach into the next piece
        for at in range(0, max(1, len(split)), step):
            ids = self._numbers(split[at : at + step + max(WIDTHS) - 1])
            np.maximum(best, pool(self.rows, ids), out=best)
        return best

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.model.score(np.array([self.pooled(t) for t in texts], np.float32)) if texts else np.zeros(0)


def _best_threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap at which F1 is largest."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + y.sum())
    i = int(f1.argmax())
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0.0)) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> ToxicModel:
    """A model fitted on a bounded sample of labelled rows.

    labels: only rows that `allowed` (a condition on labels) holds for are ever
    read as labels.  Of each class about `sample` rows are taken, at most so many,
    the least by a hash of the id, among those whose text is not null and has at
    most sample_chars characters; a fifth of them, by the same hash, calibrates the
    score and the languages' thresholds.  Of rows with the same id the one with
    the least text counts.  Null and contradictory labels are left out.  With one
    class only, or none, all scores are near that class's share (0.5 without
    labels).
    """
    known = labels if allowed is None else labels.filter(allowed)
    known = known.select(F.col(f"`{id}`").cast("string").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter("id is not null and y is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2").select("id", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"), F.md5(F.col("id").cast("binary")).alias("h"))
    table = Plain(docs)
    language = F.col(table.name(lang)) if table.find(lang) else F.lit(None)
    texts = table.df.select(F.col(table.name(id)).cast("string").alias("id"), F.col(table.name(text)).alias("text"), language.cast("string").alias("lang")).filter(F.length("text") <= sample_chars)
    short = stored(known.join(texts.select("id"), "id", "left_semi"))  # ids only: the texts' lengths are read once
    picked = least_by_hash(short.filter("y = 1"), "h", sample).unionByName(least_by_hash(short.filter("y = 0"), "h", sample))
    # At most 2 * sample rows: a proven bound, so the texts are not shuffled.
    rows = texts.join(F.broadcast(picked), "id").groupBy("id", "y", "h").agg(F.min(F.struct("text", "lang")).alias("t")).select("id", "y", "h", "t.*").collect()
    rows.sort(key=lambda r: r["h"])
    y = np.array([r["y"] for r in rows], float)
    if not len(rows) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return ToxicModel(np.zeros((BUCKETS, DIM), np.float32), np.zeros((sum(WIDTHS), DIM, FILTERS), np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), np.zeros(len(WIDTHS) * FILTERS, np.float32), math.log(share / (1 - share)))
    out = np.array([int(r["h"][:8], 16) % 5 == 0 for r in rows])
    if len(set(y[~out])) < 2:
        out[:] = False
    model = _train([r["text"] for r, o in zip(rows, out, strict=True) if not o], y[~out])
    held = out if len(set(y[out])) == 2 else np.ones(len(y), bool)
    scorer = Scorer(model)
    s = scorer.score([r["text"] for r, h in zip(rows, held, strict=True) if h])
    z, yh = np.log(np.clip(s, 1e-9, 1 - 1e-9) / np.clip(1 - s, 1e-9, 1)), y[held]
    model.scale = _platt(z, yh)
    s = 1 / (1 + np.exp(-(model.scale[0] * z + model.scale[1])))
    model.threshold = _best_threshold(s, yh)
    langs = np.array([r["lang"] or "" for r, h in zip(rows, held, strict=True) if h])
    for name in sorted(set(langs) - {""}):
        at = langs == name
        if yh[at].sum() >= 5 and (1 - yh[at]).sum() >= 5:
            model.thresholds[name] = _best_threshold(s[at], yh[at])
    return model


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logit by Newton's method, with smoothed targets."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        grad = x.T @ (p - t) / len(z) + np.array([1e-3 * (a - 1), 0])
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x / len(z) + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 1 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b


def toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", lang: str = "lang", keep_text: bool = True) -> DataFrame:
    """docs with score, predicted, threshold and flagged appended.

    predicted: 1 if score >= 0.5.  threshold: the language's, or the one of all
    languages where the language is null, unknown or had too few labelled rows;
    flagged: score >= threshold.  Null and empty texts get the score of a text
    without words.  Columns of docs named as an appended one, in any case, are
    replaced.
    """
    small_batches(docs.sparkSession)
    made = {"score": T.DoubleType(), "predicted": T.IntegerType(), "threshold": T.DoubleType(), "flagged": T.BooleanType()}
    table = Plain(docs, made)
    column, language = table.name(text), table.find(lang)
    slim = table.slim(column, language or column)

    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            names = b.schema.names
            s = scorer.score(b.column(names.index(column)).to_pylist()).astype(float)
            langs = b.column(names.index(language)).to_pylist() if language else [None] * len(s)
            least = np.array([model.thresholds.get(x, model.threshold) for x in langs], float)
            if not keep_text:
                b = b.drop_columns([column])
            yield with_columns(b, list(made), [pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(least), pa.array(s >= least)])

    return slim.mapInArrow(run, appended(slim.schema, [] if keep_text else [column], **made)).select(*table.own(*([] if keep_text else [column])), *made)
