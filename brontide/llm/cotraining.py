"""Quality classifier by co-training of two views.

The text view sees figures of the whole text, the metadata view sees only a
document's other columns.  Both start from a bounded sample of labelled rows.
Unlabelled documents with equal figures are one, with a weight.  In each round
each view scores all that are left, and of each class its surest ones, with the
view's verdict as a pseudo-label, join the *other* view's training set and stay
there; no document is handed on twice.  How many are handed on grows with the
unlabelled documents, and each view is fitted anew, and calibrated anew, before the
next round.

A view's sureness is its calibrated log odds beyond the class's own share, so the
weaker view hands on its surest documents too, but they weigh as little as it
is sure of them: a pseudo-label weighs 2p - 1, where p is the view's probability
for classes of equal size.  What labelled rows weigh together doesn't depend on
how many documents there are.

Labelled rows fall in three parts: one to fit, one to calibrate (which the choice
of pseudo-labels rests on), and one to combine the calibrated views.

Texts are read once where they aren't carried: their figures go to the shared
folder.  The driver holds the bounded sample, histograms of sureness and the
linear models; of the documents handed on it sees only sums, with which Newton's
method goes on.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brontide.llm.common import Plain, appended, discard, least_by_hash, small_batches, stored, with_columns

#: Labelled rows that are fitted on, at most.
SAMPLE = 20_000
ROUNDS = 3
#: Pseudo-labels of each class that a view hands to the other in a round, about: so many for each PER distinct unlabelled rows, and for fewer.
TAUGHT = 200
PER = 10_000
#: A view hands on no document whose odds are not this many times those of the class among the labelled rows.
LIFT = 1.05
#: What pseudo-labels of full sureness weigh, as a share of their class.
INFLUENCE = 0.5
SHAPES = 32
META = 128
_TOP, _FINE = 30, 1024  # log odds that sureness is counted up to, and the steps of one

_SHAPE = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "0"))


def _shape(word: str) -> int:
    """A bucket for the shape of a word: runs of letters by case, digits as 0, other characters as they are."""
    s = _SHAPE[0][0].sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", word)
    return zlib.crc32(_SHAPE[1][0].sub("0", s).encode("utf-8", "replace")) % SHAPES


class Shapes(dict):
    """Shape buckets of the words met so far; forgets all when it holds too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        core = word.rstrip(".,")
        if core.isalpha():  # most words: the same shape without a regular expression
            s = zlib.crc32((("A" if len(core) > 1 and core.isupper() else "a") + word[len(core) :]).encode()) % SHAPES
        else:
            s = _shape(word)
        self[word] = s
        return s


def text_view(text: str | None, shapes: Shapes) -> np.ndarray:
    """Figures of the whole text; null counts as empty."""
    text = text or ""
    words = text.split()
    out = np.zeros(12 + SHAPES, np.float32)
    n = len(words)
    out[0] = math.log1p(n) / 8
    if not n:
        return out
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(text.count(c) for c in "aeiouáéíóúäöüèêAEIOU")
    out[1] = chars / n / 10
    out[2] = len(counts) / n
    out[3] = 1 - len(set(lines)) / len(lines)
    out[4] = math.log1p(n / len(lines)) / 5
    out[5] = min(3.0, sum(text.count(c) for c in "#*$%&") / n)
    out[6] = min(3.0, text.count("!") / n)
    out[7] = min(3.0, text.count("|") / n)
    out[8] = letters / chars
    out[9] = min(3.0, text.count(".") / n)
    out[10] = sum(text.count(c) for c in "0123456789") / chars
    out[11] = sum(1 for w, k in counts.items() if k > 1 and len(w) < 5) / n
    for w, k in counts.items():
        out[12 + shapes[w]] += k
    out[12:] /= n
    return out


def meta_view(values: list) -> list[int]:
    """The buckets, of META, of the metadata columns: each value; a number by its order of magnitude, coarse and fine.  Null is a value too."""
    out = set()
    for i, v in enumerate(values):
        marks = [v]
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            size = math.log2(1 + abs(v)) if math.isfinite(v) else None
            marks = ["not finite"] if size is None else [(k, v < 0, round(size * k)) for k in (2, 8)]
        out |= {zlib.crc32(f"{i}:{mark}".encode("utf-8", "replace")) % META for mark in marks}
    return sorted(out)


@dataclass
class Linear:
    """A logistic model with Platt calibration."""

    w: np.ndarray
    b: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, l2: float = 1e-3, weight: np.ndarray | None = None) -> Linear:
        """Newton's method on the penalised likelihood; classes weigh the same."""
        a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
        y = y.astype(np.float64)
        share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) if weight is None else weight
        ridge = np.full(a.shape[1], l2)
        ridge[-1] = 1e-9
        theta = np.zeros(a.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
            grad = a.T @ (share * (p - y)) + ridge * theta
            hess = (a * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + np.diag(ridge)
            step = np.linalg.solve(hess, grad)
            theta -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        return cls(theta[:-1], float(theta[-1]))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Linear:
        """Platt scaling with smoothed targets; classes weigh as they occur."""
        if len(x) and 0 < y.sum() < len(y):
            hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
            m = Linear.fit(self.raw(x)[:, None], np.where(y > 0, hi, lo), 1e-6, np.full(len(y), 1 / len(y)))
            self.scale = (max(float(m.w[0]), 0.0), m.b)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.einsum("ij,j->i", x, self.w) + self.b  # the same for a row, whichever come with it

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.scale[0] * self.raw(x) + self.scale[1]

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


@dataclass
class CoTrained:
    """The two views, their combination, and what happened on the way.

    taught: for each round, how many documents the text view and the metadata
    view handed on.  held_out: the areas under the curve of the text view and
    the metadata view on the labelled rows that neither was fitted or calibrated
    on, before the first round and after each.
    """

    text: Linear
    meta: Linear
    both: Linear
    metadata: list[str]
    taught: list[tuple[int, int]] = field(default_factory=list)
    held_out: list[tuple[float, float]] = field(default_factory=list)

    def scores(self, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Columns: text view, metadata view, combined."""
        t, k = self.text, self.meta
        pair = np.stack([t.logit(x), k.logit(m)], axis=1)
        return np.stack([t.prob(x), k.prob(m), self.both.prob(pair)], axis=1) if len(x) else np.zeros((0, 3))


def _lists(a: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(a, np.float32).reshape(-1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * (a.shape[1] if a.ndim == 2 else 0)), pa.array(flat))


def _views(batch: pa.RecordBatch, text: str, metadata: list[str], shapes: Shapes) -> tuple[np.ndarray, list[list[int]]]:
    names = batch.schema.names
    x = [text_view(t, shapes) for t in batch.column(names.index(text)).to_pylist()]
    m = [meta_view(list(v)) for v in zip(*(batch.column(names.index(c)).to_pylist() for c in metadata), strict=True)] if metadata else [[] for _ in x]
    return (np.stack(x) if x else np.zeros((0, 12 + SHAPES), np.float32)), m


def _spread(lengths: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Rows of META zeros and ones."""
    out = np.zeros((len(lengths), META), np.float32)
    out[np.repeat(np.arange(len(lengths)), lengths), buckets] = 1
    return out


def _dense(m: list[list[int]]) -> np.ndarray:
    return _spread(np.array([len(r) for r in m], np.int64), np.array([v for r in m for v in r], np.int64))


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The columns x and m of a batch as matrices."""
    x, m = (b.column(b.schema.names.index(c)) for c in "xm")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, 12 + SHAPES), _spread(m.value_lengths().to_numpy(zero_copy_only=False), m.flatten().to_numpy(zero_copy_only=False))


def _number(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.names.index(name)).to_numpy(zero_copy_only=False)


def _viewed(table: Plain, id: str, text: str, metadata: list[str], carried: list[str]) -> DataFrame:
    """(id, x, m) beside the carried columns, one row for each row of the table, in the shared folder."""
    small_batches(table.df.sparkSession)
    marks = [f"meta{i}" for i in range(len(metadata))]

    def run(batches):
        shapes = Shapes()
        for b in batches:
            x, m = _views(b, "text", marks, shapes)
            yield with_columns(b.drop_columns(["text", *marks]), ["x", "m"], [_lists(x), pa.array(m, pa.list_(pa.int32()))])

    slim = table.df.select(*carried, F.col(table.name(id)).cast("string").alias("id"), F.col(table.name(text)).cast("string").alias("text"), *(F.col(table.name(c)).alias(k) for c, k in zip(metadata, marks, strict=True)))
    return stored(slim.mapInArrow(run, appended(slim.schema, ["text", *marks], x=T.ArrayType(T.FloatType()), m=T.ArrayType(T.IntegerType()))))


def _both_classes(part: np.ndarray, y: np.ndarray) -> np.ndarray:
    """part, or all rows where it lacks a class."""
    return part if 0 < y[part].sum() < part.sum() else np.ones(len(y), bool)


def _area(score: np.ndarray, y: np.ndarray) -> float:
    """The share of pairs of one row of either class that the score orders rightly, ties as halves."""
    good, bad = np.sort(score[y > 0]), score[y <= 0]
    return 1 - float((np.searchsorted(good, bad, "left") + np.searchsorted(good, bad, "right")).mean() / 2 / len(good)) if len(good) and len(bad) else 0.5


def _combined(pair: np.ndarray, y: np.ndarray) -> Linear:
    """Logistic regression on the views' log odds; a view never counts against itself."""
    use = np.ones(2, bool)
    while True:
        m = Linear.fit(pair * use, y, 1e-3, np.full(len(y), 1 / len(y)))
        if (m.w >= 0).all() or not use.any():
            return m
        use &= m.w > 0


def fit_cotraining(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    metadata: tuple[str, ...] = ("lang", "source", "n_chars"),
    sample: int = SAMPLE,
    rounds: int = ROUNDS,
    taught: int = TAUGHT,
    lift: float = LIFT,
    influence: float = INFLUENCE,
) -> CoTrained:
    """The two views, calibrated, and their combination.

    Labelled rows: those of docs whose id labels has, at most `sample` of them,
    the least by a hash of the id.  By the same hash a tenth of them calibrates
    and another tenth combines the views; a part that lacks a class is all rows.
    Of rows with the same id the one with the least figures counts.  Ids with
    labels that disagree, and null labels, are left out.  With labels of one
    class only, or none, every score is that class's share, 0.5 without labels.
    """
    table = Plain(docs)
    names = [c for c in metadata if table.find(c)]
    return _fit(_viewed(table, id, text, names, []), labels, id, label, names, sample, rounds, taught, lift, influence)


def _fit(views: DataFrame, labels: DataFrame, id: str, label: str, names: list[str], sample: int = SAMPLE, rounds: int = ROUNDS, taught: int = TAUGHT, lift: float = LIFT, influence: float = INFLUENCE) -> CoTrained:
    known = labels.select(F.col(f"`{id}`").cast("string").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter("id is not null and y is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).filter("y = y2").select("id", (F.col("y") > 0).cast("int").alias("y"), F.md5(F.col("id").cast("binary")).alias("h"))
    views = views.select("id", "x", "m")
    picked = least_by_hash(known.join(views.select("id"), "id", "left_semi"), "h", sample)
    rows = views.join(F.broadcast(picked), "id").groupBy("id", "y", "h").agg(F.min(F.struct("x", "m")).alias("v")).collect()  # at most `sample` rows on either side
    rows.sort(key=lambda r: r["h"])
    y = np.array([r["y"] for r in rows], float)
    if len(rows) < 5 or y.min() == y.max():
        flat = Linear(np.zeros(2), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0)
        return CoTrained(Linear(np.zeros(12 + SHAPES)), Linear(np.zeros(META)), flat, names)
    x, m = np.array([r["v"]["x"] for r in rows], np.float32), _dense([r["v"]["m"] for r in rows])
    part = np.array([int(r["h"][:8], 16) % 10 for r in rows])
    fit, tune, join = (_both_classes(p, y) for p in (part > 1, part == 0, part == 1))
    prior = math.log((y[tune].sum() + 1) / ((1 - y[tune]).sum() + 1))
    t, k = (Linear.fit(v[fit], y[fit]).calibrate(v[tune], y[tune]) for v in (x, m))
    pool = stored(views.join(known.select("id"), "id", "left_anti").groupBy("x", "m").agg(F.count("*").alias("n")).withColumn("u", F.pmod(F.xxhash64("x", "m"), F.lit(1 << 20)) / (1 << 20)))
    rules: list[Rule] = []
    handed: list[DataFrame] = []
    report: list[tuple[int, int]] = []
    areas = [(_area(t.raw(x[join]), y[join]), _area(k.raw(m[join]), y[join]))]
    for _ in range(rounds):
        cuts = _cuts(pool, rules, Rule(t, k, prior, math.log(lift), {}), taught)
        if not cuts:
            break
        rules.append(Rule(t, k, prior, math.log(lift), cuts))
        handed.append(stored(_taught(pool, list(rules))))
        report.append(tuple(handed[-1].agg(F.expr("count_if(by_text >= 0)"), F.expr("count_if(by_meta >= 0)")).first()))
        every = handed[0]
        for more in handed[1:]:
            every = every.unionByName(more)
        t, k = (f.calibrate(v[tune], y[tune]) for f, v in zip(_refit(every, (x[fit], m[fit]), y[fit], (t, k), influence), (x, m), strict=True))
        areas.append((_area(t.raw(x[join]), y[join]), _area(k.raw(m[join]), y[join])))
    discard(pool, *handed)
    return CoTrained(t, k, _combined(np.stack([t.logit(x), k.logit(m)], axis=1)[join], y[join]), names, report, areas)


@dataclass
class Rule:
    """What the views hand on in a round: by view and class, the least step of sureness, and the share of that step's rows."""

    text: Linear
    meta: Linear
    prior: float
    least: float
    cuts: dict[tuple[int, int], tuple[int, float]]

    def sure(self, view: int, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class that a view gives each row, -1 where it isn't sure, and its log odds beyond the class's share."""
        z = (self.meta if view else self.text).logit(a) - self.prior
        return np.where(np.abs(z) >= self.least, (z > 0).astype(int), -1), np.minimum(np.abs(z), _TOP)

    def picks(self, x: np.ndarray, m: np.ndarray, u: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each view, the class that it hands each row on with, -1 for rows that it doesn't, and what that weighs."""
        out = []
        for view, a in enumerate((x, m)):
            c, z = self.sure(view, a)
            step = (z * _FINE).astype(np.int64)
            got = np.full(len(a), -1)
            for (v, k), (cut, share) in self.cuts.items():
                if view == v:
                    got[(c == k) & ((step > cut) | (step == cut) & (u < share))] = k
            out.append((got, np.tanh(z / 2)))
        return out


def _left(rules: list[Rule], x: np.ndarray, m: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Which rows no rule hands on."""
    left = np.ones(len(u), bool)
    for r in rules:
        for got, _ in r.picks(x, m, u):
            left &= got < 0
    return left


def _cuts(pool: DataFrame, rules: list[Rule], now: Rule, taught: int) -> dict[tuple[int, int], tuple[int, float]]:
    """Where the surest rows of each view and class begin, from a histogram; empty if no view is sure of any row that is left."""
    size = _TOP * _FINE + 1

    def run(batches):
        n = np.zeros((2, 2, size), np.int64)
        total = 0
        for b in batches:
            x, m = _rows(b)
            total += b.num_rows
            left = _left(rules, x, m, _number(b, "u"))
            for v, a in enumerate((x[left], m[left])):
                c, z = now.sure(v, a)
                np.add.at(n, (v, c[c >= 0], (z[c >= 0] * _FINE).astype(np.int64)), 1)
        v, c, step = np.nonzero(n)
        columns = (np.append(v, 2), np.append(c, 0), np.append(step, 0), np.append(n[v, c, step], total))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in columns], ["v", "c", "step", "n"])

    counts = {(r["v"], r["c"], r["step"]): r["n"] for r in pool.mapInArrow(run, "v bigint, c bigint, step bigint, n bigint").groupBy("v", "c", "step").agg(F.sum("n").alias("n")).collect()}
    most = math.ceil(taught * max(1.0, counts.pop((2, 0, 0), 0) / PER))
    cuts: dict[tuple[int, int], tuple[int, float]] = {}
    total: dict[tuple[int, int], int] = {}
    for v, c, step in sorted(counts, reverse=True):
        held = total.get((v, c), 0)
        if held < most:
            cuts[v, c] = (step, min(1.0, (most - held) / counts[v, c, step]))
        total[v, c] = held + counts[v, c, step]
    return cuts


def _taught(pool: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that the last rule hands on and none before it: the class that each view gives them, -1 for none, and its weight."""

    def run(batches):
        for b in batches:
            x, m = _rows(b)
            u = _number(b, "u")
            (by_text, wt), (by_meta, wm) = rules[-1].picks(x, m, u)
            mine = _left(rules[:-1], x, m, u) & ((by_text >= 0) | (by_meta >= 0))
            yield with_columns(b, ["by_text", "by_meta", "text_weight", "meta_weight"], [pa.array(by_text, pa.int32()), pa.array(by_meta, pa.int32()), pa.array(wt), pa.array(wm)]).filter(pa.array(mine))

    return pool.mapInArrow(run, appended(pool.schema, [], by_text=T.IntegerType(), by_meta=T.IntegerType(), text_weight=T.DoubleType(), meta_weight=T.DoubleType()))


def _moments(x: np.ndarray, y: np.ndarray, n: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """For each class a row: how many, the sum of weights, the log loss at theta, its gradient and its curvature."""
    a = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    z = a @ theta
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    out = []
    for c in (0, 1):
        w = n * weight * (y == c)
        out.append(np.concatenate(((n * (y == c)).sum(keepdims=True), [w.sum(), w @ np.logaddexp(0, -z if c else z)], a.T @ (w * (p - c)), ((a * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a).ravel())))
    return np.stack(out)


def _refit(handed: DataFrame, labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, start: tuple[Linear, Linear], influence: float = INFLUENCE, l2: float = 1e-3, steps: int = 12) -> list[Linear]:
    """Both views fitted on the labelled rows and those that the other view handed on, from sums over the latter.

    Of a class, pseudo-labels weigh `influence` times their mean sureness, labelled
    rows the rest; classes weigh the same.
    """
    thetas = [np.append(f.w, f.b) for f in start]
    shapes = [(2, 3 + len(f) + len(f) ** 2) for f in thetas]
    best: list[tuple[np.ndarray, float] | None] = [None, None]

    def over(sums):
        yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], ["s"])

    def added(batches):
        total = np.zeros(sum(a * b for a, b in shapes))
        for b in batches:
            total += b.column(0).flatten().to_numpy().reshape(b.num_rows, -1).sum(axis=0)
        yield from over(total)

    for _ in range(steps):
        here = [f.copy() for f in thetas]

        def run(batches, here=here):
            total = [np.zeros(s) for s in shapes]
            for b in batches:
                n = _number(b, "n").astype(np.float64)
                for i, (a, by, weight) in enumerate(zip(_rows(b), ("by_meta", "by_text"), ("meta_weight", "text_weight"), strict=True)):
                    c, w = _number(b, by), _number(b, weight)
                    if (c >= 0).any():
                        total[i] += _moments(a[c >= 0], c[c >= 0], n[c >= 0], w[c >= 0], here[i])
            yield from over(np.concatenate([s.ravel() for s in total]))

        parts = handed.mapInArrow(run, "s array<double>").repartition(4).mapInArrow(added, "s array<double>").collect()
        far = np.sum([r["s"] for r in parts], axis=0)
        moved, at = 0.0, 0
        for i, (x, shape) in enumerate(zip(labelled, shapes, strict=True)):
            own, other = _moments(x, y, np.ones(len(y)), np.ones(len(y)), thetas[i]), far[at : at + shape[0] * shape[1]].reshape(shape)
            at += shape[0] * shape[1]
            beta = influence * other[:, 1:2] / np.maximum(1, other[:, :1])
            s = ((1 - beta) * own[:, 2:] / np.maximum(1, own[:, 1:2]) + beta * other[:, 2:] / np.maximum(1e-9, other[:, 1:2])).mean(axis=0)
            d = len(thetas[i])
            ridge = np.append(np.full(d - 1, l2), 1e-9)
            loss = s[0] + (ridge * thetas[i] ** 2).sum() / 2
            if best[i] and loss > best[i][1] + 1e-9:  # too far: back by half
                step = (thetas[i] - best[i][0]) / 2
            else:
                best[i] = (thetas[i].copy(), loss)
                step = np.linalg.solve(s[1 + d :].reshape(d, d) + np.diag(ridge), s[1 : 1 + d] + ridge * thetas[i])
                step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
            thetas[i] -= step
            moved = max(moved, np.abs(step).max())
        if moved < 1e-3:
            break
    return [Linear(f[:-1], float(f[-1])) for f in thetas]


_MADE = {"text_score": T.DoubleType(), "meta_score": T.DoubleType(), "score": T.DoubleType(), "kept": T.BooleanType()}


def _scored(b: pa.RecordBatch, model: CoTrained, x: np.ndarray, m: np.ndarray, least: float) -> pa.RecordBatch:
    s = model.scores(x, m)
    return with_columns(b, list(_MADE), [*(pa.array(s[:, i]) for i in range(3)), pa.array(s[:, 2] >= least)])


def quality_scores(docs: DataFrame, model: CoTrained, text: str = "text", least: float = 0.5, keep_text: bool = True) -> DataFrame:
    """docs with text_score, meta_score, score (probability of good quality) and kept (score >= least) appended.

    Null and empty texts are scored as texts without words.  Columns of docs
    named as an appended one, in any case, are replaced.  Repeated rows are
    scored alike.
    """
    small_batches(docs.sparkSession)
    table = Plain(docs, _MADE)
    column, marks = table.name(text), [table.name(c) for c in model.metadata]
    slim = table.slim(column, *marks)

    def run(batches):
        shapes = Shapes()
        for b in batches:
            x, m = _views(b, column, marks, shapes)
            yield _scored(b, model, x, _dense(m), least)

    return slim.mapInArrow(run, appended(slim.schema, [], **_MADE)).select(*table.own(*([] if keep_text else [column])), *_MADE)


def quality_classifier(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = ("lang", "source", "n_chars"), least: float = 0.5, keep_text: bool = True, **options) -> DataFrame:
    """fit_cotraining on docs and labels, then the scores of all docs as quality_scores gives them.

    Without keep_text the other columns go with the figures, and no text is read again.
    """
    if keep_text:
        return quality_scores(docs, fit_cotraining(docs, labels, id, text, label, metadata, **options), text, least)
    table = Plain(docs, _MADE)
    names = [c for c in metadata if table.find(c)]
    but = table.name(text)
    views = _viewed(table, id, text, names, [f"c{i}" for i in table.kept if f"c{i}" != but])
    model = _fit(views, labels, id, label, names, **options)

    def run(batches):
        for b in batches:
            yield _scored(b.drop_columns(["x", "m"]), model, *_rows(b), least)

    return views.drop("id").mapInArrow(run, appended(views.drop("id").schema, ["x", "m"], **_MADE)).select(*table.own(but), *_MADE)
