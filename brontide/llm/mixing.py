"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sources, in code point order, get target shares of a budget by weight, with no
   target above twice its source's size (the excess is shared again by weight).
2. Each source's documents are dealt into blocks by a hash of their id.  The
   mix takes every block of a source floor(target / size) times, and once more
   the blocks at the front of a permutation of them, up to the target.
3. The blocks so taken are the source's quota.  A binary tree over the output
   shards splits the vector of quotas: at each node a multivariate
   hypergeometric draw says how many blocks of each source go left, so the
   quotas of all shards add up to the sources' quotas exactly.  The draw is made
   by its definition: of the node's blocks, numbered by source, those with the
   least keyed hashes go left.
4. Each shard draws its quota as the next blocks of a second permutation, so
   the shards' blocks are disjoint, and shuffles its documents locally by hash.
   What the mix takes of a document is the sum of these draws.

The driver holds one row per source, one quota per source and shard, and, while
it splits, a number per block drawn; blocks and shards grow with the corpus, by
WORDS_PER_BLOCK and WORDS_PER_SHARD, so these stay a millionth of it.  Only sums of
blocks are ordered in windows; of the one block per source that lies on the
boundary, first sums of 4,096 slices of it and then one slice, by document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brontide.llm.common import Plain, stored, white_words

WEIGHTS = (3.0, 1.0, 2.0)
#: Words of a shard where the number of shards follows the corpus: about 12 MB of text.
WORDS_PER_SHARD = 1 << 21
#: Words of a block, at most about, and how many blocks a source has at least.
WORDS_PER_BLOCK = 1 << 20
LEAST_BLOCKS = 1024
SHARE = 1.5
MOST = 2.0
_MIX = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1))


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, most: float = MOST) -> np.ndarray:
    """Shares of share * sum(sizes) by weight, none above most * its size, the excess shared again by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, caps, left = np.zeros(len(sizes)), most * sizes, share * sizes.sum()
    open_ = np.ones(len(sizes), bool)
    while open_.any():
        given = left / weights[open_].sum() * weights[open_]
        over = given > caps[open_]
        at = np.flatnonzero(open_)
        if not over.any():
            out[at] = given
            break
        out[at[over]] = caps[at[over]]
        left -= caps[at[over]].sum()
        open_[at[over]] = False
    return out


def keyed(*parts) -> np.ndarray:
    """A 32-bit hash of numbers below 2**32; all arguments but arrays of equal length are single numbers."""
    h = np.zeros(1, np.uint64)
    for p in parts:
        h = h ^ np.asarray(p, np.uint64)
        for shift, factor in _MIX:
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor) & np.uint64(0xFFFFFFFF)
    return h


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources): how many blocks of each source each shard gets.

    Each node of the tree keys its own draw, so any subtree can be drawn again
    alone and gives the same numbers.
    """
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1 or not have.any():
            out[lo] = have
            return
        mid, total = (lo + hi) // 2, int(have.sum())
        source = np.repeat(np.arange(len(have)), have)
        number = np.arange(total) - np.repeat(np.cumsum(have) - have, have)
        least = np.argsort(keyed(seed, lo, hi, source, number), kind="stable")[: total * (mid - lo) // (hi - lo)]
        left = np.bincount(source[least], minlength=len(have))
        split(lo, mid, left)
        split(mid, hi, have - left)

    split(0, shards, np.asarray(quotas, np.int64))
    return out


def hashed(*parts: Column) -> Column:
    """The first 32 bits of the MD5 of the parts, joined by colons, as a long; any SQL engine has this."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


_MADE = ("size", "source_size", "target", "taken", "draws")


def mix_sources(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    blocks: int | None = None,
    shards: int | None = 64,
    seed: int = 7,
    split_documents: bool = True,
    carry: bool = True,
    max_sources: int = 65536,
) -> DataFrame:
    """docs with size, source_size, target, taken and draws appended; one row for each row of docs.

    size: words of the text (null: 0).  draws: array of struct<shard, position,
    words>, one for each time a shard draws the document; position orders a
    shard.  taken: the sum of the draws' words.  A document is drawn at most
    twice.  split_documents: the document on a source's boundary gives only the
    words that are missing, else it is drawn whole if at least half is missing.
    carry: False returns the id beside these columns and nothing else, and then
    reads the texts once instead of twice.  shards: None for as many as give
    WORDS_PER_SHARD words each, so that shards keep their size as the corpus
    grows.  blocks: of each source; None for LEAST_BLOCKS, doubled until those of
    the largest source have WORDS_PER_BLOCK words.

    The source null is a source of its own, after all others.  Sources whose
    documents are all empty have target 0 and draw nothing.  Rows with the same
    id, and null ids, fall in one block; rows that also have the same text give
    equal parts if they are on the boundary.  Columns of docs named as an
    appended one, in any case, are replaced.  An empty table gives an empty
    result.  Reruns give the same result.
    """
    table = Plain(docs, _MADE)
    mixed = _mix(table, id, text, source, weights, share, blocks, shards, seed, split_documents, carry, max_sources)[0]
    return mixed.select(*(table.own() if carry else [F.col(table.name(id)).alias(id)]), *_MADE)


def _mix(table: Plain, id, text, source, weights, share, blocks, shards, seed, split_documents, carry, max_sources) -> tuple[DataFrame, int]:
    """The table's rows under their plain names, or only their ids, with what mix_sources appends; and the number of shards."""
    spark = table.df.sparkSession
    text_, source_, id_ = F.col(table.name(text)), F.col(table.name(source)), F.coalesce(F.col(table.name(id)).cast("string"), F.lit(""))
    figures = [
        F.size(white_words(text_)).cast("bigint").alias("size"),
        # Null has a key of its own; every other source is marked, so that none equals it.
        F.when(source_.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), source_.cast("string"))).alias("key"),
        hashed(F.lit("block"), id_).alias("spot"),
        F.struct(hashed(F.lit("order"), id_).alias("h"), id_.alias("id"), F.xxhash64(text_).alias("text")).alias("order"),
    ]
    narrow = stored(table.df.select(table.name(id), *figures))
    source_sums = narrow.groupBy("key").agg(F.sum("size").alias("n")).orderBy(F.col("key") == "", "key").limit(max_sources + 1).collect()
    if len(source_sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources if the driver can hold a row for each")
    names, sizes = [r["key"] for r in source_sums], [r["n"] for r in source_sums]
    wanted = targets(np.array(sizes, float), np.array([weights[i % len(weights)] for i in range(len(sizes))]), share)
    per_source = spark.createDataFrame(pa.table({"key": pa.array(names, pa.string()), "source_size": pa.array(sizes, pa.int64()), "target": pa.array(wanted, pa.float64())}))
    if blocks is None:
        blocks = LEAST_BLOCKS
        while blocks * WORDS_PER_BLOCK < max(sizes, default=0):
            blocks *= 2
    block = F.pmod("spot", F.lit(blocks)).cast("int").alias("block")

    # Which blocks are taken whole, which one is on the boundary, and what that one still has to give.
    sums = narrow.groupBy("key", block).agg(F.sum("size").alias("block_size"))
    before = Window.partitionBy("key").orderBy("rank", "block").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        sums.join(per_source, "key")
        .withColumn("rank", hashed(F.lit("permute"), F.lit(str(seed)), "key", F.col("block").cast("string")))
        .withColumn("start", F.coalesce(F.sum("block_size").over(before), F.lit(0)))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
        .withColumn("missing", F.least("block_size", F.greatest(F.lit(0).cast("bigint"), F.col("rest") - F.col("start"))))
        .withColumn("turns", F.col("epochs") + (F.col("missing") > 0).cast("int"))
    )
    cut = stored(cut.select("key", "block", "source_size", "target", "epochs", "block_size", "missing", "turns"))

    # Quotas of blocks, split over the shards by the tree; each shard draws its share as the next run of a permutation.
    quotas = {r["key"]: r["n"] for r in cut.groupBy("key").agg(F.sum("turns").alias("n")).collect()}
    if shards is None:
        shards = max(1, math.ceil(float(wanted.sum()) / WORDS_PER_SHARD))
    tree = split_tree([quotas[n] for n in names], shards, seed)
    shard, i = np.nonzero(tree)
    ends = np.cumsum(tree, axis=0)[shard, i]
    runs = spark.createDataFrame(pa.table({"key": pa.array([names[k] for k in i], pa.string()), "shard": pa.array(shard, pa.int32()), "first": pa.array(ends - tree[shard, i] + 1, pa.int64()), "last": pa.array(ends, pa.int64())}))
    places = runs.select("key", "shard", F.explode(F.sequence("first", "last")).alias("at"))
    dealt = Window.partitionBy("key").orderBy(hashed(F.lit("deal"), F.lit(str(seed)), "key", F.col("block").cast("string"), F.col("turn").cast("string")), "block", "turn")
    every = cut.filter("turns > 0").select("key", "block", F.explode(F.sequence(F.lit(1), F.col("turns"))).alias("turn"))
    homes = every.withColumn("at", F.row_number().over(dealt).cast("bigint")).join(places, ["key", "at"]).groupBy("key", "block").agg(F.map_from_entries(F.collect_list(F.struct("turn", "shard"))).alias("homes"))

    # The boundary blocks alone, one per source: the slice that the boundary lies in, and there the document.
    edge = F.broadcast(cut.filter("missing > 0 and missing < block_size").select("key", "block", "missing"))  # at most max_sources rows
    on_edge = narrow.select("size", "key", block, "order", F.shiftright("order.h", 20).alias("slice")).join(edge, ["key", "block"])
    slices = on_edge.groupBy("key", "block", "slice", "missing").agg(F.sum("size").alias("s"))
    ahead = Window.partitionBy("key", "block").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("left", F.col("missing") - F.coalesce(F.sum("s").over(ahead), F.lit(0))).filter("s > 0 and left > 0 and left <= s").select("key", "block", "slice", "left")
    groups = on_edge.join(F.broadcast(slices), ["key", "block", "slice"]).groupBy("key", "block", "order", "left").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    within = Window.partitionBy("key", "block").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    at = groups.withColumn("left", F.col("left") - F.coalesce(F.sum("s").over(within), F.lit(0))).filter("s > 0 and left > 0 and left <= s")
    gap = F.floor(F.col("left") / F.col("n")).cast("bigint")
    whole = F.when(2 * F.col("left") >= F.col("s"), F.floor(F.col("s") / F.col("n")).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    edges = at.select("key", "block", F.col("order").alias("edge"), (gap if split_documents else whole).alias("gap"))
    plan = stored(cut.join(homes, ["key", "block"], "left").join(edges, ["key", "block"], "left").select("key", "block", "source_size", "target", "epochs", "missing", "homes", "edge", "gap"))
    if plan.count() <= 200_000:  # a checked bound; beyond it the join shuffles
        plan = F.broadcast(plan)

    zero, here = F.lit(0).cast("bigint"), F.col("order")
    extra = F.when(F.col("missing") == 0, zero).when(F.col("edge").isNull() | (here < F.col("edge")), F.col("size")).when(here == F.col("edge"), F.col("gap")).otherwise(zero)
    turn = lambda t: F.when(F.lit(t) <= F.col("epochs"), F.col("size")).when(F.lit(t) == F.col("epochs") + 1, F.col("extra")).otherwise(zero)
    draw = lambda t: F.struct(F.col("homes")[F.lit(t)].alias("shard"), hashed(F.lit("place"), F.lit(str(seed)), here["id"], F.lit(str(t))).alias("position"), turn(t).alias("words"))
    own = [f"c{i}" for i in table.kept] if carry else [table.name(id)]
    rows = (table.df.select(*own, *figures) if carry else narrow).select(*own, "size", "key", block, "order")
    drawn = rows.join(plan, ["key", "block"]).withColumn("extra", extra).withColumn("draws", F.filter(F.array(draw(1), draw(2)), lambda d: (d["words"] > 0) & d["shard"].isNotNull()))
    return drawn.select(*own, "size", "source_size", "target", F.aggregate("draws", zero, lambda a, d: a + d["words"]).alias("taken"), "draws"), shards


def mixed_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, blocks: int | None = None, shards: int | None = None, seed: int = 7, max_sources: int = 65536) -> DataFrame:
    """The mix itself: a row of docs for each time it is drawn, with docs' columns.

    Documents are drawn whole.  A partition is a shard, in the shard's order.
    """
    table = Plain(docs)
    mixed, n = _mix(table, id, text, source, weights, share, blocks, shards, seed, False, True, max_sources)
    drawn = mixed.select(*table.df.columns, F.inline("draws").alias("shard", "position", "words"))
    return drawn.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "position").select(*table.own())
