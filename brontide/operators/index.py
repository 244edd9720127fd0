"""Stored indexes for search: written once, then read a few buckets or cells at a time.

A lexical index holds, for each token, blocks of postings in the order of their
impact, what a posting adds to a BM25 score before the token's weight.  Each
block keeps its largest impact.  A query reads the headers of its tokens, then each
token's first block; the k documents that are best there are looked up by id in
a forward table, and the least of their scores bounds the k-th best score from
below.  Then it reads only those blocks that can still reach that bound: a block
is skipped when its largest impact and the other tokens' largest impacts together
stay below.  A document of a skipped block is below the bound itself, so the
result is exact.

A vector index holds cells: a centre, the vectors nearest to it and the largest
distance among them.  With d the distance of x from its centre c, q.x is at most
q.c + |q| d, so a cell whose bound is below a query's k-th best so far is skipped.

Both write their manifest last and remove an older one first: a reader that finds
no manifest finds no index.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from brontide.functions.text import let, tokenize
from brontide.operators.search import K1, MOST_PRODUCTS, B, query_tokens
from brontide.sources.stored import discard, written

#: Postings of a block, and buckets that the tokens are dealt in.
BLOCK, BUCKETS = 128, 64
#: Vectors of a piece of a cell, queries of a block, and cells at most: the centres are what travels to every task.
PIECE, ASKED, CELLS = 4096, 512, 4096
#: Vectors that the centres are chosen from.
SAMPLE = 65_536
#: Bits of an impact that postings are put in order by.
LEVEL_BITS = 24
#: Documents that a task counts the tokens of at a time.
COUNTED = 1024
#: The most documents that a query looks up by id for its bound.
LOOKED_UP = 1000
_SLACK = 1e-7


class NoIndex(FileNotFoundError):
    """There is no complete index at a path."""


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, path: str) -> None:
    p, fs = _place(spark, path)
    fs.delete(p, True)  # nothing happens where there is none


def _finish(spark: SparkSession, path: str, manifest: dict) -> None:
    """The manifest, one row of JSON, is written when all else is there."""
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> dict:
    """What the index at path says of itself; NoIndex without a complete one."""
    p, fs = _place(spark, f"{path}/manifest/_SUCCESS")
    if not fs.exists(p):
        raise NoIndex(path)
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


# Lexical


def impact(tf: Column, dl: Column, average: float) -> Column:
    """What a posting adds to a BM25 score, before its token's weight."""
    return tf * (K1 + 1) / (tf + F.lit(K1) * (1 - F.lit(B) + F.lit(B) * dl / F.lit(average or 1.0)))


_BLOCKS = "bucket int, token string, top double, n int, ids array<{id}>, tfs array<int>, dls array<int>"


def _counts(kind: pa.DataType, weights: list[int]):
    """Rows (id, tokens of each field) to (id, dl, tokens): each document's distinct tokens with their weighted counts."""
    empty = pa.array([], pa.string())

    def counted(b: pa.RecordBatch) -> pa.RecordBatch:
        fields = [b.column(1 + i) for i in range(len(weights))]
        sizes = [f.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]
        coded = pa.concat_arrays([empty, *(f.flatten() for f in fields)]).dictionary_encode()
        row = np.concatenate([np.repeat(np.arange(b.num_rows), n) for n in sizes])
        w = np.concatenate([np.full(n.sum(), x, np.int64) for n, x in zip(sizes, weights, strict=True)])
        words = max(1, len(coded.dictionary))
        keys, at = np.unique(row * words + coded.indices.to_numpy(), return_inverse=True)
        tf = np.bincount(at, w, len(keys)).astype(np.int32)
        dl = sum((n * x for n, x in zip(sizes, weights, strict=True)), np.zeros(b.num_rows, np.int64)).astype(np.int32)
        offsets = np.searchsorted(keys, np.arange(b.num_rows + 1) * words).astype(np.int32)
        tokens = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(keys % words)), pa.array(tf)], ["token", "tf"])
        return pa.RecordBatch.from_arrays([b.column(0).cast(kind), pa.array(dl), pa.ListArray.from_arrays(pa.array(offsets), tokens)], ["id", "dl", "tokens"])

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, COUNTED):
                yield counted(b.slice(at, COUNTED))

    return run


def _blocks(kind: pa.DataType):
    """Postings (bucket, token, id, tf, dl, impact) in order to blocks of at most BLOCK of one token."""
    names = [f.split()[0] for f in _BLOCKS.split(", ")]

    def cut(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """The blocks that begin at starts; the last start is the end."""
        bucket, token, ids, tfs, dls, tops = (c.combine_chunks() for c in t.slice(0, starts[-1]).columns)
        heads, offsets = pa.array(starts[:-1]), pa.array(starts.astype(np.int32))
        lists = (pa.ListArray.from_arrays(offsets, c) for c in (ids.cast(kind), tfs, dls))
        tops = pa.array(np.maximum.reduceat(tops.to_numpy(), starts[:-1]))
        return pa.RecordBatch.from_arrays([bucket.take(heads), token.take(heads), tops, pa.array(np.diff(starts).astype(np.int32)), *lists], names)

    def starts(t: pa.Table) -> np.ndarray:
        token = t.column(1).combine_chunks().dictionary_encode().indices.to_numpy()
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        within = np.arange(len(token)) - np.repeat(first, np.diff(np.r_[first, len(token)]))
        return np.flatnonzero(within % BLOCK == 0)

    def run(batches):
        left = None  # the rows of the last block, which the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if left is None else pa.concat_tables([left, t])
            at = starts(t)
            if len(at) > 1:
                yield cut(t, at)
            left = t.slice(at[-1]).combine_chunks()
        if left is not None:
            yield cut(left, np.array([0, left.num_rows]))

    return run


def _order(buckets: int) -> Column:
    """A long that puts postings (bucket, token, impact) in order of bucket, of the token's hash, and of falling impact.

    Where tokens share a hash their postings mix, and their blocks are shorter.
    """
    spare = 63 - (buckets - 1).bit_length() - LEVEL_BITS
    level = F.floor((1 - F.col("impact") / (K1 + 1)) * ((1 << LEVEL_BITS) - 1))
    return (F.col("bucket").cast("bigint") * (1 << spare) + F.pmod(F.xxhash64(F.lit("order"), "token"), F.lit(1 << spare))) * (1 << LEVEL_BITS) + level


def build_lexical(docs: DataFrame, path: str, id: str, weights: dict[str, int], built_at: str = "", buckets: int = BUCKETS) -> dict:
    """Writes the postings of docs' weighted fields and returns the manifest.

    ids are unique.  The texts are tokenised once and each document is counted
    where it is read; what is shuffled are counts by document and token, once by
    document and once by token.  The postings are dealt in ranges of (bucket, token,
    impact), so a token that every document has is spread over many tasks.
    Documents with a null id are counted but are in no posting.
    """
    spark = docs.sparkSession
    _remove(spark, f"{path}/manifest")
    kind = docs.select(F.col(id).alias("id")).schema["id"].dataType
    tokens = docs.select(F.col(id).alias("id"), *(tokenize(F.col(f)).alias(f"tokens{i}") for i, f in enumerate(weights)))
    held = f"id {kind.simpleString()}, dl int, tokens array<struct<token:string,tf:int>>"
    seen = Observation()
    counts = tokens.mapInArrow(_counts(to_arrow_type(kind), list(weights.values())), held).observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("average"))
    part = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("part")
    # A document without a token is in neither table.
    forward = counts.filter("id is not null and size(tokens) > 0").select(part, "id", "dl", "tokens")
    forward.repartition("part").sortWithinPartitions("part", "id").write.mode("overwrite").partitionBy("part").parquet(f"{path}/forward")
    n, average = (0, 0.0) if docs.isEmpty() else (seen.get["n"], seen.get["average"])
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int").alias("bucket")
    rows = spark.read.schema(held).parquet(f"{path}/forward").select("id", "dl", F.inline("tokens"))
    postings = rows.select(bucket, "token", "id", "tf", "dl", impact(F.col("tf"), F.col("dl"), average).alias("impact")).withColumn("place", _order(buckets))
    # One long to sort by; the id only deals out the postings of equal documents.
    dealt = postings.repartitionByRange("place", "id").sortWithinPartitions("place").drop("place")
    made = dealt.mapInArrow(_blocks(to_arrow_type(kind)), _BLOCKS.format(id=kind.simpleString()))
    made.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    said = {"kind": "lexical", "built_at": built_at, "documents": n, "average_length": average, "buckets": buckets, "id": kind.simpleString(), "weights": weights}
    _finish(spark, path, said)
    return said


def _weight(weights: dict[str, float]) -> Column:
    """The weight of the column token, one of those of a query."""
    first, *rest = weights.items()
    return reduce(lambda c, p: c.when(F.col("token") == p[0], F.lit(p[1])), rest, F.when(F.col("token") == first[0], F.lit(first[1])))


@dataclass
class Lexical:
    """A stored lexical index."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        self.said = manifest(self.spark, self.path)

    def _held(self, tokens: list[str]) -> DataFrame:
        """The blocks of some tokens: a scan of their buckets alone."""
        rows = self.spark.read.schema(_BLOCKS.format(id=self.said["id"])).parquet(f"{self.path}/postings")
        buckets = self.spark.range(1).select(F.array_distinct(F.transform(F.array(*map(F.lit, tokens)), lambda t: F.pmod(F.xxhash64(t), F.lit(self.said["buckets"])).cast("int")))).first()[0]
        return rows.filter(F.col("bucket").isin(*buckets) & F.col("token").isin(*tokens))

    def token_frequencies(self) -> DataFrame:
        """(token, df) from the blocks' headers."""
        return self.spark.read.schema(_BLOCKS.format(id=self.said["id"])).parquet(f"{self.path}/postings").groupBy("token").agg(F.sum("n").alias("df"))

    def term_frequencies(self) -> DataFrame:
        """(id, token, tf) from the postings."""
        rows = self.spark.read.schema(_BLOCKS.format(id=self.said["id"])).parquet(f"{self.path}/postings")
        return rows.select("token", F.inline(F.arrays_zip("ids", "tfs"))).select(F.col("ids").alias("id"), "token", F.col("tfs").cast("bigint").alias("tf"))

    def bm25(self, queries: dict[str, str], k: int = 10, id: str = "doc_id") -> dict[str, DataFrame]:
        """The k best documents of each query, as search.bm25_all gives them: rows (id, score), ties by id."""
        asked = {name: query_tokens(self.spark, q) for name, q in queries.items()}
        tokens = sorted({t for ts in asked.values() for t in ts})
        none = self.spark.createDataFrame([], f"{id} {self.said['id']}, score double")
        out = {}
        for name, ts in asked.items():
            weights, reach = self._plan(ts, k)
            if not weights:
                out[name] = none
                continue
            scored = self._scores(self._held(list(weights)).filter(reach), weights, id)
            out[name] = scored.orderBy(F.desc("score"), id).limit(max(1, k)).select(id, F.round("score", 4).alias("score"))
        return out

    def blocks(self, query: str, k: int) -> tuple[int, int]:
        """How many blocks a query's tokens have, and how many of them it reads."""
        weights, reach = self._plan(query_tokens(self.spark, query), k)
        if not weights:
            return 0, 0
        held = self._held(list(weights)).select("token", "top")
        return held.count(), held.filter(reach).count()

    def _plan(self, tokens: list[str], k: int) -> tuple[dict[str, float], Column | None]:
        """The weights of those of a query's tokens that occur, and which of their blocks can reach its k-th best score.

        The driver holds a few numbers for each token that the caller wrote down.
        """
        if not tokens:
            return {}, None
        heads = self._held(tokens).select("token", "top", "n")
        first = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("top")))
        # Blocks are full but for a token's last in each range, so this many of the best hold k postings nearly always.
        best = heads.withColumn("place", first).filter(F.col("place") <= 1 + -(-k // BLOCK)).groupBy("token").agg(F.min("top").alias("low"))
        rows = heads.groupBy("token").agg(F.sum("n").alias("df"), F.max("top").alias("top")).join(best, "token").collect()
        n = self.said["documents"]
        weights = {r["token"]: float(np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))) for r in sorted(rows)}
        if not weights:
            return {}, None
        any_ = lambda parts: reduce(lambda x, y: x | y, parts)
        seeds = self._held(list(weights)).filter(any_((F.col("token") == r["token"]) & (F.col("top") >= r["low"]) for r in rows))
        found = self._scores(seeds, weights, "id").orderBy(F.desc("score")).limit(max(1, k)).collect()
        least = 0.0
        if len(found) >= max(1, k):
            least = max(min(r["score"] for r in found), self._known([r["id"] for r in found], weights) if k <= LOOKED_UP else 0.0)
        most = {r["token"]: weights[r["token"]] * r["top"] for r in rows}
        rest = sum(most.values())
        return weights, any_((F.col("token") == t) & (F.col("top") * w >= least - (rest - most[t]) - _SLACK) for t, w in weights.items())

    def _known(self, ids: list, weights: dict[str, float]) -> float:
        """The least score of some documents, from the forward table."""
        rows = self.spark.read.schema(f"part int, id {self.said['id']}, dl int, tokens array<struct<token:string,tf:int>>").parquet(f"{self.path}/forward")
        kind = self.said["id"]
        parts = self.spark.createDataFrame([(i,) for i in ids], f"id {kind}").select(F.collect_set(F.pmod(F.xxhash64("id"), F.lit(self.said["buckets"])).cast("int"))).first()[0]
        held = rows.filter(F.col("part").isin(*parts) & F.col("id").isin(*ids)).select("id", "dl", F.inline("tokens")).filter(F.col("token").isin(*weights))
        scored = held.groupBy("id").agg(F.sum(_weight(weights) * impact(F.col("tf"), F.col("dl"), self.said["average_length"])).alias("score"))
        return scored.agg(F.min("score")).first()[0]

    def _scores(self, blocks: DataFrame, weights: dict[str, float], id: str) -> DataFrame:
        """(id, score): what some blocks add up to."""
        rows = blocks.select(_weight(weights).alias("idf"), F.inline(F.arrays_zip("ids", "tfs", "dls")))
        part = F.col("idf") * impact(F.col("tfs"), F.col("dls"), self.said["average_length"])
        return rows.groupBy(F.col("ids").alias(id)).agg(F.sum(part).alias("score")).filter("score > 0")


# Vectors

_CELL = "cell int, dim int, centre array<double>, radius double, n bigint"


def _centres(sample: np.ndarray, cells: int, rounds: int = 3) -> np.ndarray:
    """Centres of cells: the first of the sample, moved to the mean of the sample's vectors nearest to them."""
    centres = sample[:cells].copy()
    for _ in range(rounds):
        near = np.concatenate([_nearest(sample[a : a + 4096], centres)[0] for a in range(0, len(sample), 4096)])
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes, step = (centres * centres).sum(axis=1), max(1, MOST_PRODUCTS // max(1, len(centres)))
    near = np.concatenate([(sizes - 2 * x[a : a + step] @ centres.T).argmin(axis=1) for a in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)
    return near, np.linalg.norm(x - centres[near], axis=1)


def _by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of a column of vectors."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        yield d, rows, flat[starts[rows][:, None] + np.arange(d)].reshape(len(rows), d)


def _sound(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull())


def build_vectors(chunks: DataFrame, path: str, id: str, embedding: str, built_at: str = "", cells: int | None = None) -> dict:
    """Writes the cells of chunks' vectors and returns the manifest.

    cells: None for about the square root of the number of vectors, CELLS at most.
    Their centres are chosen from a sample of about SAMPLE vectors of the least
    hash; every vector is in the index.  Vectors that are null or have a null
    component are not; those of each length have cells of their own.
    """
    spark = chunks.sparkSession
    _remove(spark, f"{path}/manifest")
    rows = written(chunks.select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("vector")).filter(_sound(F.col("vector"))))
    kind = rows.schema["id"].dataType
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    held = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("id")).limit(2 * SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    centres, first = {}, 0
    for d, _, m in _by_length(held):
        here = _centres(m, min(CELLS, cells or max(1, round(np.sqrt(n)))))
        centres[d] = (first, here)
        first += len(here)
    sent = spark.sparkContext.broadcast(centres)  # at most CELLS vectors of each length
    schema = T.StructType([T.StructField("id", kind), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def placed(batches):
        for b in batches:
            cell, distance = np.full(b.num_rows, -1, np.int32), np.full(b.num_rows, np.inf)
            for d, at, m in _by_length(b.column(1)):
                if d in sent.value:  # a length that the sample missed is in the cell -1, which is always visited
                    low, c = sent.value[d]
                    near, distance[at] = _nearest(m, c)
                    cell[at] = near + low
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell), pa.array(distance)], ["id", "vector", "cell", "distance"])

    dealt = rows.mapInArrow(placed, schema).repartitionByRange("cell", "distance", "id").sortWithinPartitions("cell", "distance", "id")
    dealt.mapInArrow(_packed(to_arrow_type(kind)), f"piece bigint, cell int, dim int, far double, n int, ids array<{kind.simpleString()}>, vectors array<double>").write.mode("overwrite").parquet(f"{path}/pieces")
    discard(rows)
    known = spark.createDataFrame([(low + i, d, v.tolist()) for d, (low, c) in centres.items() for i, v in enumerate(c)], "cell int, dim int, centre array<double>")
    sums = spark.read.parquet(f"{path}/pieces").groupBy("cell", "dim").agg(F.max("far").alias("radius"), F.sum("n").alias("n"))
    sums.join(known, ["cell", "dim"], "left").select(*(f.split()[0] for f in _CELL.split(", "))).write.mode("overwrite").parquet(f"{path}/cells")
    said = {"kind": "vectors", "built_at": built_at, "vectors": n, "cells": first, "id": kind.simpleString()}
    _finish(spark, path, said)
    return said


def _packed(kind: pa.DataType):
    """Rows (id, vector, cell, distance) in order to numbered pieces of one cell, of PIECE * 8 numbers at most."""

    def run(batches):
        key, ids, flat, far, number = None, [], [], 0.0, TaskContext.get().partitionId() << 32

        def out():
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.list_(kind), pa.list_(pa.float64()))
            row = (number, *key, far, len(ids), ids, flat)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["piece", "cell", "dim", "far", "n", "ids", "vectors"])

        for b in batches:
            for i, vector, cell, distance in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != (cell, len(vector)) or len(ids) * len(vector) >= PIECE * 8:
                    if ids:
                        yield out()
                        number += 1
                    key, ids, flat = (cell, len(vector)), [], []
                ids.append(i)
                flat.extend(vector)
                far = distance
        if ids:
            yield out()

    return run


@dataclass
class Vectors:
    """A stored vector index."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        self.said = manifest(self.spark, self.path)
        self.pieces = self.spark.read.parquet(f"{self.path}/pieces")

    def topk(self, queries: DataFrame, k: int, id: str, intent: str = "intent") -> DataFrame:
        """The k vectors of largest inner product for each query: (intent, id, similarity, rank), as search.vector_topk gives them.

        queries: (intent, query).  A query first meets the pieces of the cells
        with the largest bounds that together hold k vectors; the k-th best of
        these is what any other piece must be able to reach.  Queries stay rows:
        those that visit a piece are packed in blocks of at most ASKED.
        """
        hits = self._met(queries, k, intent)
        order = Window.partitionBy(intent).orderBy(F.desc("similarity"), F.col("id"))
        return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(intent, F.col("id").alias(id), "similarity", "rank")

    def _met(self, queries: DataFrame, k: int, intent: str) -> DataFrame:
        first, later = self._rounds(queries, k, intent)
        return first.unionByName(self._products(later, k, intent))

    def compared(self, queries: DataFrame, k: int, intent: str = "intent") -> tuple[int, int]:
        """How many pairs of a query and a vector are worked out, and how many there are."""
        asked = self._asked(queries, intent)
        first = self._visits(asked.withColumn("least", F.lit(None).cast("double")), k, intent)
        later = self._rounds(queries, k, intent)[1]
        sizes = self.pieces.select("piece", "n")
        return sum(v.join(sizes, "piece").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for v in (first, later)), asked.count() * self.said["vectors"]

    def _asked(self, queries: DataFrame, intent: str) -> DataFrame:
        return queries.select(intent, F.col("query").cast("array<double>").alias("query")).filter(_sound(F.col("query")))

    def _rounds(self, queries: DataFrame, k: int, intent: str) -> tuple[DataFrame, DataFrame]:
        """The hits of the first pieces, and the further pieces that each query must visit."""
        asked = written(self._asked(queries, intent))
        near = written(self._products(self._visits(asked.withColumn("least", F.lit(None).cast("double")), k, intent), k, intent))
        best = Window.partitionBy(intent).orderBy(F.desc("similarity"))
        least = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") == k).select(intent, F.col("similarity").alias("least"))
        bound = asked.join(least, intent, "left").select(intent, "query", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        return near, self._visits(bound, k, intent)

    def _visits(self, asked: DataFrame, k: int, intent: str) -> DataFrame:
        """(intent, query, piece) for asked (intent, query, least): with least null the first pieces, else those others that can reach it."""
        cells = self.spark.read.schema(_CELL).parquet(f"{self.path}/cells").orderBy("dim", "cell").collect()  # CELLS of each length at most
        held = {}
        for r in cells:
            held.setdefault(r["dim"], []).append(r)
        tables = {d: (np.array([r["cell"] for r in rs], np.int32), np.array([r["centre"] or [0.0] * d for r in rs]), np.array([r["radius"] for r in rs]), np.array([r["n"] for r in rs])) for d, rs in held.items()}
        sent = self.spark.sparkContext.broadcast(tables)
        kind = asked.schema[intent]
        schema = T.StructType([kind, asked.schema["query"], T.StructField("cell", T.IntegerType()), T.StructField("dim", T.IntegerType()), T.StructField("dot", T.DoubleType()), T.StructField("norm", T.DoubleType()), T.StructField("least", T.DoubleType())])

        def run(batches):
            for b in batches:
                rows, cell, dim, dots, norms = [], [], [], [], []
                bounds = b.column(2).to_numpy(zero_copy_only=False)  # null comes as nan
                for d, at, q in ((d, at[a : a + step], q[a : a + step]) for d, at, q in _by_length(b.column(1)) if d in sent.value for step in [max(1, MOST_PRODUCTS // len(sent.value[d][0]))] for a in range(0, len(at), step)):
                    names, centres, radius, n = sent.value[d]
                    dot, norm = q @ centres.T, np.linalg.norm(q, axis=1)
                    upper = dot + norm[:, None] * radius
                    order = np.argsort(-upper, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    first = np.zeros(upper.shape, bool)
                    np.put_along_axis(first, order, before < k, axis=1)
                    start = np.isnan(bounds[at])
                    wanted = np.where(start[:, None], first, ~first & (upper >= bounds[at][:, None] - _SLACK))
                    i, j = np.nonzero(wanted)
                    rows.append(at[i])
                    cell.append(names[j])
                    dim.append(np.full(len(i), d, np.int32))
                    dots.append(dot[i, j])
                    norms.append(norm[i])
                if rows:
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(np.concatenate(x)) for x in (cell, dim, dots, norms)), b.column(2).take(at)], schema.names)

        visits = asked.select(intent, "query", "least").mapInArrow(run, schema)
        met = visits.join(self.pieces.select("piece", "cell", "dim", "far"), ["cell", "dim"])
        return met.filter(F.col("least").isNull() | (F.col("dot") + F.col("norm") * F.col("far") >= F.col("least") - _SLACK)).select(intent, "query", "piece")

    def _products(self, visits: DataFrame, k: int, intent: str) -> DataFrame:
        """(intent, id, similarity): of each visited piece a query's k best, and those that tie."""
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
        counted = visits.groupBy("piece").agg(F.count("*").alias("asked"))
        block = F.pmod(F.xxhash64(intent), F.ceil(F.col("asked") / ASKED)).alias("block")
        blocks = visits.join(counted, "piece").groupBy("piece", block).agg(F.collect_list(F.struct(F.col(intent).alias("i"), "query")).alias("asked"))  # about ASKED of them
        packed = blocks.select("piece", F.transform("asked", lambda x: x["i"]).alias("intents"), F.flatten(F.transform("asked", lambda x: x["query"])).alias("queries"))
        rows = packed.join(self.pieces.select("piece", "dim", "ids", "vectors"), "piece").select("dim", "intents", "queries", "ids", "vectors")
        schema = T.StructType([visits.schema[intent], T.StructField("id", self.pieces.schema["ids"].dataType.elementType), T.StructField("similarity", T.DoubleType())])

        def run(batches):
            for b in batches:
                for r in range(b.num_rows):
                    d, intents, ids = b.column(0)[r].as_py(), b.column(1)[r].values, b.column(3)[r].values
                    q, x = (b.column(c)[r].values.to_numpy(zero_copy_only=False).reshape(-1, d) for c in (2, 4))
                    sims = np.round(x @ q.T, 9)
                    least = np.partition(sims, len(x) - k, axis=0)[len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
                    row, col = np.nonzero(sims >= least)
                    yield pa.RecordBatch.from_arrays([intents.take(pa.array(col)), ids.take(pa.array(row)), pa.array(sims[row, col])], schema.names)

        return rows.mapInArrow(run, schema)
