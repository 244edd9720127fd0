"""Sharding by a hierarchical weighted hash tree, in native expressions.

Shards are the leaves of a tree of regions, racks and shards.  A row descends it:
at each node every child draws -ln(u) / weight, where u in (0, 1) is a hash of
the row's key and the child's name, and the least draw wins (a child is so won
in proportion to its weight).  A node weighs what its shards weigh.

A child's draw depends on nothing but the key, its name and its weight.  So when
a weight changes, then at each node of the path to it rows move only into or out
of the child on that path; children whose weights stay exchange nothing, and a
subtree that no changed shard is below keeps its order of draws.  A shard that is
added as a region of its own therefore takes rows only into itself: every other
region, rack and shard keeps name and weight.

Slots number a shard's rows without a gap, in the order of a hash of their
content.  No task orders a whole shard: rows are counted by distinct content and
input partition, those counts are summed in ranges of the hash, and only the
ranges' sums are put in order for a shard.  Rows of the same content are numbered
within their input partition, so a mass of copies is never in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brontide.llm.common import Plain, let, stored

#: Distinct contents of a range of the hash, about: what one window of the slots orders.
RANGE = 1 << 16
#: Bits of a draw and of the hash that orders slots: 13 hex digits of an MD5.
BITS = 52


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, base: int = 8, per_rack: int = 2, racks: int = 2) -> list[Shard]:
    """The tree of a number of shards of weight 1.

    The first `base` shards fill racks of per_rack and regions of so many racks;
    each later one is a region of its own, so that one more shard takes rows only
    into itself.  A new base, which lays the tree out again, moves rows.
    """
    laid = [Shard(f"r{i // (per_rack * racks)}", f"k{i // per_rack % racks}", i) for i in range(min(shards, base))]
    return laid + [Shard(f"x{i}", "k0", i) for i in range(len(laid), shards)]


def _number(*parts: Column) -> Column:
    """The first BITS bits of the MD5 of strings joined by slashes, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts).cast("binary")), 1, BITS // 4), 16, 10).cast("bigint")


def draw(key: Column, name: Column) -> Column:
    """A number in (0, 1) from a key and the name of a node."""
    return (_number(key, name).cast("double") + 0.5) / float(1 << BITS)


def _chosen(key: Column, children: Column) -> Column:
    """The child with the least weighted draw; of equal ones the first."""
    drawn = F.transform(children, lambda c, i: F.struct((-F.log(draw(key, c["name"])) / c["weight"]).alias("d"), i.alias("i")))
    return let(drawn, lambda d: F.element_at(children, F.array_min(d)["i"] + 1))


def assigned(key: Column, shards: list[Shard]) -> Column:
    """struct<region, rack, shard>: the leaf that a key descends to.  key: a string, not null.

    Shards of weight 0 take nothing.  Numbers of shards must differ; weights must
    be finite, none below 0 and one above.
    """
    if len({s.shard for s in shards}) < len(shards):
        raise ValueError("two shards have the same number")
    if any(not math.isfinite(s.weight) or s.weight < 0 for s in shards) or not any(s.weight for s in shards):
        raise ValueError("weights of shards must be finite, none below 0 and one above")
    live = sorted((s for s in shards if s.weight), key=lambda s: (s.region, s.rack, s.shard))
    node = lambda name, held, *more: F.struct(F.lit(name).alias("name"), F.lit(math.fsum(s.weight for s in held)).alias("weight"), *more)
    regions = []
    for region, g in groupby(live, lambda s: s.region):
        racks, in_region = [], list(g)
        for rack, h in groupby(in_region, lambda s: s.rack):
            in_rack, name = list(h), f"{region}/{rack}"
            leaves = F.array(*(node(f"{name}/{s.shard}", [s], F.lit(s.shard).cast("int").alias("shard")) for s in in_rack))
            racks.append(node(name, in_rack, leaves.alias("below")))
        regions.append(node(region, in_region, F.array(*racks).alias("below")))
    leaf = lambda region: let(_chosen(key, region["below"]), lambda rack: F.struct(region["name"].alias("region"), rack["name"].alias("rack"), _chosen(key, rack["below"])["shard"].alias("shard")))
    return let(_chosen(key, F.array(*regions)), leaf)


_MADE = ("size", "text_crc32", "law", "region", "rack", "shard", "slot", "grown_shard")


def shard_documents(docs: DataFrame, shards: list[Shard], grown: list[Shard] | None = None, id: str = "doc_id", text: str = "text", carry: bool = True) -> DataFrame:
    """docs with size, text_crc32, law, region, rack, shard, slot and grown_shard appended; one row for each row of docs.

    size: UTF-8 bytes of the text (null: none) plus 1.  text_crc32: of those
    bytes.  law: "key"; the id and the tree decide, so rows with the same id are
    in one shard whatever their texts, and so are rows whose id is null (null is
    a key of its own, which no other equals).  grown_shard: the shard under the
    tree `grown`, null without one.  slot: from 0 in each shard without a gap, by
    a hash of id, size and checksum; rows equal in these have slots in a row, in
    the order in which they were read.

    carry: False returns the id beside these columns and nothing else.  Columns of
    docs named as an appended one, in any case, are replaced.  Very long texts
    only add to size.  An empty table gives an empty result.  Reruns give the
    same result, but for which of several rows equal in id and text has which of
    their slots.
    """
    table = Plain(docs, _MADE)
    id_, text_ = table.name(id), table.name(text)
    raw = F.coalesce(F.col(text_), F.lit("")).cast("binary")
    key = F.when(F.col(id_).isNull(), F.lit("")).otherwise(F.concat(F.lit("k"), F.col(id_).cast("string")))
    own = [f"c{i}" for i in table.kept] if carry else [id_]
    rows = table.df.select(*own, key.alias("key"), (F.length(raw) + F.lit(1)).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    home = rows.select("*", assigned(F.col("key"), shards).alias("home"), (assigned(F.col("key"), grown)["shard"] if grown else F.lit(None).cast("int")).alias("grown_shard"))
    order = _number(F.col("key"), F.col("size").cast("string"), F.col("text_crc32").cast("string"))
    # Written once: from here on a row's number, and so its slot, is fixed.
    dealt = stored(home.select(*own, "key", "size", "text_crc32", "home.region", "home.rack", "home.shard", "grown_shard", order.alias("order"), F.monotonically_increasing_id().alias("row")))
    placed = _slots(dealt)
    law = F.lit("key").alias("law")
    return placed.select(*(table.own() if carry else [F.col(id_).alias(id)]), "size", "text_crc32", law, "region", "rack", "shard", "slot", "grown_shard")


def _slots(dealt: DataFrame) -> DataFrame:
    """dealt with slot: rows of a shard numbered by order, key, size, text_crc32 and row."""
    content = ["shard", "order", "key", "size", "text_crc32"]
    part = F.shiftright("row", 33).alias("part")  # the input partition that the row's number names
    ranges = max(0, math.ceil(math.log2(max(1, dealt.count() / RANGE))))
    runs = dealt.groupBy(*content, part).agg(F.count("*").alias("n")).withColumn("range", F.shiftright("order", BITS - ranges))
    ahead = Window.partitionBy("shard", "range").orderBy("order", "key", "size", "text_crc32", "part").rowsBetween(Window.unboundedPreceding, -1)
    summed = runs.withColumn("within", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.groupBy("shard", "range").agg(F.sum("n").alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    starts = summed.join(starts, ["shard", "range"]).select(*content, "part", (F.col("first") + F.col("within")).alias("start"))
    among = Window.partitionBy(*content, "part").orderBy("row")
    return dealt.withColumn("part", part).join(starts, [*content, "part"]).withColumn("slot", (F.col("start") + F.row_number().over(among) - 1).cast("bigint"))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 1 << 20) -> None:
    """Writes shard_documents' rows below path, a folder for each shard, in files of rows_per_file slots in a row, each in the order of slots."""
    piece = F.floor(F.col("slot") / rows_per_file)
    sharded.repartition("shard", piece).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
