"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Unit vectors u are quantised to q = rint(u / step), one step for the table.  With
e = u - step * q, which is known for each vector, two unit vectors satisfy

    |u . v - step**2 * q . r|  <=  |e| * |v| + |step * q| * |f|

(f is v's error).  So a product of small integers, which float32 holds exactly,
bounds the cosine from both sides: pairs whose upper bound is below the threshold
are done with, pairs whose lower bound is above it are links.  For those in
between the same bounds are drawn again with a second int8 digit for each
component, 254 times finer; the few that even these leave in doubt, and no others,
are worked out again in double precision from the vectors themselves.

Vectors that are equal in every bit (told by their SHA-256) are one, with a
number of copies, so a third of all vectors may be copies of one.  The others are
dealt by hash into blocks; a task compares two blocks, a tile at a time, and only
their int8 digits travel there.  From a tile leave only how many partners each
vector has, a spanning forest of the links, and the pairs in doubt.  All pairs of
blocks are compared: the work grows with the square of the number of distinct
vectors, at a multiply-add a pair and dimension, and is spread evenly.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.llm.common import Plain, stored
from brontide.llm.components import components

THRESHOLD = 0.9
#: Vectors of a block, about: a task holds two blocks.
BLOCK = 4096
#: Rows of one tile.
TILE = 512
_SLACK = 1e-9
_FINER = 254


def unit(values: list | None) -> np.ndarray | None:
    """The unit vector in double precision; None for vectors that link with nothing."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0 or not np.isfinite(x).all():
        return None
    x = x / top
    return x / math.sqrt(float(x @ x))


@dataclass
class Digits:
    """Vectors in int8: their first and second digits, and the norms of the errors that one or both digits leave."""

    q: np.ndarray
    q2: np.ndarray
    e: np.ndarray
    e2: np.ndarray
    copies: np.ndarray

    @classmethod
    def of(cls, u: np.ndarray, step: float, copies: np.ndarray | None = None) -> Digits:
        q = np.clip(np.rint(u / step), -127, 127)
        rest = u - step * q
        q2 = np.clip(np.rint(rest / (step / _FINER)), -127, 127)
        return cls(q.astype(np.int8), q2.astype(np.int8), np.linalg.norm(rest, axis=1), np.linalg.norm(rest - step / _FINER * q2, axis=1), np.ones(len(u), np.int64) if copies is None else copies)

    def at(self, rows) -> Digits:
        return Digits(self.q[rows], self.q2[rows], self.e[rows], self.e2[rows], self.copies[rows])

    def fine(self, step: float, rows) -> np.ndarray:
        """What both digits stand for."""
        return step * self.q[rows] + step / _FINER * self.q2[rows]


def compare(u: Digits, v: Digits | None, step: float, threshold: float, tile: int = TILE) -> tuple[np.ndarray, ...]:
    """Partners of each row of u and of v, copies counted; a forest of the links; and the pairs in doubt.

    Links and pairs are rows of u and v (of u where v is None: u is then compared
    with itself).
    """
    same = v is None
    v = u if same else v
    dim = u.q.shape[1]
    exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # sums of products stay exact integers
    qf, rf = u.q.astype(exact), v.q.astype(exact).T.copy()
    n = np.linalg.norm(step * u.q.astype(np.float64), axis=1)
    worst = v.e.max(initial=0.0)
    count_u, count_v = np.zeros(len(u.q), np.int64), np.zeros(len(v.q), np.int64)
    parent = np.arange(len(u.q) if same else len(u.q) + len(v.q))
    shift = 0 if same else len(u.q)
    links: list[tuple[int, int]] = []
    doubts: list[np.ndarray] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at in range(0, len(u.q), tile):
        rows = slice(at, at + tile)
        first = at if same else 0
        g = qf[rows] @ rf[:, first:]
        least = (threshold - u.e[rows] * (1 + _SLACK) - n[rows] * worst - _SLACK) / step**2
        i, j = np.nonzero(g >= least[:, None])
        dot = g[i, j].astype(np.float64) * step**2
        i, j = i + at, j + first
        if same:
            up = i < j
            i, j, dot = i[up], j[up], dot[up]
        if not len(i):
            continue
        bound = u.e[i] + n[i] * v.e[j] + _SLACK
        link = dot - bound >= threshold
        unsure = np.flatnonzero(~link & (dot + bound >= threshold))
        for s in range(0, len(unsure), 1 << 16):
            part = unsure[s : s + (1 << 16)]
            a, b = u.fine(step, i[part]), v.fine(step, j[part])
            dot2 = np.einsum("ij,ij->i", a, b)
            bound2 = u.e2[i[part]] + np.linalg.norm(a, axis=1) * v.e2[j[part]] + _SLACK
            link[part] = dot2 - bound2 >= threshold
            open_ = ~link[part] & (dot2 + bound2 >= threshold)
            doubts.append(np.stack([i[part][open_], j[part][open_]], axis=1))
        i, j = i[link], j[link]
        if not len(i):
            continue
        np.add.at(count_u, i, v.copies[j])
        np.add.at(count_u if same else count_v, j, u.copies[i])
        # A row's partners join it: one link for each set that was apart.
        starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
        for a, b in zip(starts, [*starts[1:], len(i)], strict=True):
            x = find(int(i[a]))
            new, where = np.unique(_roots(parent, j[a:b] + shift), return_index=True)
            for y, k in zip(new.tolist(), where.tolist(), strict=True):
                if y != x:
                    parent[y] = x
                    links.append((int(i[a]), int(j[a + k])))
    ends, open_ = np.array(links, np.int64).reshape(-1, 2), np.concatenate([np.zeros((0, 2), np.int64), *doubts])
    return count_u, count_v, ends[:, 0], ends[:, 1], open_[:, 0], open_[:, 1]


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The roots of many nodes at once, with their paths shortened."""
    r = parent[at]
    while True:
        up = parent[r]
        if (up == r).all():
            parent[at] = r
            return r
        r = up


def embedding_groups(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vectors with n_links, component_id and kept appended; one row for each row of vectors.

    n_links: how many other rows have a cosine of at least threshold, in double
    precision.  component_id: the smallest id that links reach, the row's own
    included.  kept: the id is the component's.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing; so do vectors of different lengths with each other.
    Repeated rows are vectors of their own and link.  Null ids are never the
    smallest unless the component has no other.  Columns of vectors named as an
    appended one, in any case, are replaced.
    """
    table = Plain(vectors, ("n_links", "component_id", "kept"))
    id_, vector = table.name(id), table.name(embedding)
    # Numbered once and written: from here on a row's number is fixed.
    numbered = stored(table.df.select(*dict.fromkeys([*(f"c{i}" for i in table.kept), id_, vector])).withColumn("row", F.monotonically_increasing_id()))

    def units(batches):
        for b in batches:
            rows, us = b.column(0).to_pylist(), [unit(v) for v in b.column(1).to_pylist()]
            at = [k for k, u in enumerate(us) if u is not None]
            blobs = [us[k].tobytes() for k in at]
            keys = [hashlib.sha256(x).digest() for x in blobs]
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[k] for k in at], pa.int64()), pa.array([len(us[k]) for k in at], pa.int32()), pa.array([float(np.abs(us[k]).max()) for k in at], pa.float64()), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())],
                ["row", "dim", "top", "key", "u"],
            )

    us = stored(numbered.select("row", F.col(vector).cast("array<double>").alias("v")).mapInArrow(units, "row bigint, dim int, top double, key binary, u binary"))
    copies = us.select("row", "key").join(numbered.select("row", F.col(id_).alias("id")), "row").groupBy("key").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.min("id").alias("least"))
    reps = stored(copies)
    n, top = reps.count(), us.agg(F.max("top")).first()[0]
    blocks = max(1, math.ceil(n / block))
    step = (top or 1.0) / 127
    parts, settled = None, None
    if n:
        distinct = us.select("row", "dim", "u").join(reps.select(F.col("rep").alias("row"), "copies"), "row")
        dealt = distinct.mapInArrow(_quantised(step), _DIGITS).withColumn("c", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
        twice = dealt.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = blocks * (blocks + 1) // 2
        keyed = twice.select("dim", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), "c", "row", "copies", "e", "e2", "q", "q2")
        keyed = keyed.repartition(max(min(pairs, 4096), pairs // 16), "dim", "i", "j").sortWithinPartitions("dim", "i", "j", "c", "row")
        parts = stored(keyed.mapInArrow(_tiles(step, threshold), "a bigint, b bigint, n bigint"))
        settled = stored(_settled(parts.filter("n < 0").select("a", "b"), distinct, threshold))
        counts = parts.filter("n > 0").select("a", "n").unionByName(settled.select("a", F.col("copies_b").alias("n"))).unionByName(settled.select(F.col("b").alias("a"), F.col("copies_a").alias("n")))
        counts = counts.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        roots = components(parts.filter("n = 0").select("a", "b").unionByName(settled.select("a", "b"))).select(F.col("node").alias("rep"), "root")
        info = reps.join(counts, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        # Only distinct vectors with links need their component's smallest id looked up.
        linked = info.filter("n > 0").groupBy("root").agg(F.min("least").alias("component"))
        info = info.join(linked, "root", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("least")).alias("component"), F.lit(True).alias("valid"))
    else:
        info = reps.select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("least").alias("component"), F.lit(True).alias("valid"))
    found = us.select("row", "key").join(info, "key").drop("key")
    named = numbered.join(found, "row", "left")
    component = F.when(F.col("valid"), F.col("component")).otherwise(F.col(id_))
    return named.select(*table.own(), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col(id_).eqNullSafe(component).alias("kept"))


_DIGITS = "row bigint, copies bigint, dim int, e double, e2 double, q binary, q2 binary"


def _quantised(step: float):
    """Vectors as their int8 digits.  Rows: row, dim, u, copies."""

    def run(batches):
        for b in batches:
            row, dim, u, copies = (b.column(b.schema.names.index(c)) for c in ("row", "dim", "u", "copies"))
            dims, blobs, rows, n = dim.to_numpy(), u.to_pylist(), row.to_numpy(), copies.to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                digits = Digits.of(np.frombuffer(b"".join(blobs[k] for k in at)).reshape(-1, d), step)
                binary = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(n[at]), pa.array(np.full(len(at), d, np.int32)), pa.array(digits.e), pa.array(digits.e2), binary(digits.q), binary(digits.q2)], [f.split()[0] for f in _DIGITS.split(", ")])

    return run


def _settled(doubts: DataFrame, distinct: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs in doubt that link in double precision, with the copies of either end."""

    def run(batches):
        for b in batches:
            left, right = (b.column(b.schema.names.index(c)).to_pylist() for c in ("u_a", "u_b"))
            yield b.drop_columns(["u_a", "u_b"]).filter(pa.array([float(np.frombuffer(x) @ np.frombuffer(y)) >= threshold for x, y in zip(left, right, strict=True)], pa.bool_()))

    end = lambda name: distinct.select(F.col("row").alias(name), F.col("u").alias(f"u_{name}"), F.col("copies").alias(f"copies_{name}"))
    return doubts.join(end("a"), "a").join(end("b"), "b").select("a", "b", "copies_a", "copies_b", "u_a", "u_b").mapInArrow(run, "a bigint, b bigint, copies_a bigint, copies_b bigint")


def _tiles(step: float, threshold: float):
    """Compares the two blocks of each key as its rows come by.

    Rows: dim, i, j, c, row, copies, e, e2, q, q2, a key's rows together.  Out come rows
    (a, null, n): a has n partners; (a, b, 0): a link; (a, b, -1): a pair in doubt.
    """

    def done(key: tuple[int, int, int], c: np.ndarray, rows: np.ndarray, digits: Digits) -> pa.RecordBatch:
        _, i, j = key
        left = c == i
        if i == j:
            n, _, a, b, x, y = compare(digits, None, step, threshold)
            ids, counts, ends = rows, n, rows
        else:
            n, m, a, b, x, y = compare(digits.at(left), digits.at(~left), step, threshold)
            ids, counts, ends = np.concatenate((rows[left], rows[~left])), np.concatenate((n, m)), rows[~left]
        starts = rows if i == j else rows[left]
        some = counts > 0
        first = np.concatenate((ids[some], starts[a], starts[x]))
        second = np.concatenate((np.zeros(some.sum(), np.int64), ends[b], ends[y]))
        n = np.concatenate((counts[some], np.zeros(len(a), np.int64), np.full(len(x), -1)))
        return pa.RecordBatch.from_arrays([pa.array(first.astype(np.int64)), pa.array(second.astype(np.int64), mask=n > 0), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    def joined(held: list) -> tuple:
        return tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def run(batches):
        key, held = None, []

        def flush():
            c, rows, copies, e, e2, q, q2 = joined(held)
            return done(key, c, rows, Digits(q, q2, e, e2, copies))

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            numbers = [batch.column(k).to_numpy() for k in range(3, 8)]
            blobs = [batch.column(k).to_pylist() for k in (8, 9)]
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                here = tuple(keys[a].tolist())
                if key is not None and here != key:
                    yield flush()
                    held = []
                key = here
                held.append((*(x[a:b] for x in numbers), *(np.frombuffer(b"".join(x[a:b]), np.int8).reshape(b - a, here[0]) for x in blobs)))
        if key is not None:
            yield flush()

    return run
