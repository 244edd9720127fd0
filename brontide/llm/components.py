"""Connected components of a graph held as a DataFrame.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014).  Edges and labels stay distributed;
the driver sees two numbers a round.  Each round is written to the shared
folder, so neither lineage nor a lost executor can hurt it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brontide.llm.common import discard, stored


def _stars(edges: DataFrame, upper: bool) -> DataFrame:
    """One star round over rows (a, b) with a > b.

    upper: large-star, which moves each larger neighbour of a node to the least
    of the node's neighbourhood; else small-star, which moves the smaller ones.
    The least is found with a partial aggregate and joined back, so that a node
    with very many neighbours is split by the adaptive skew join.
    """
    if upper:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        moved = edges.join(least, edges["b"] == least["u"]).select(F.col("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        moved = edges.join(least, edges["a"] == least["u"]).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of longs, the ends of undirected links.  Returns (node, root).

    root is the least node of the component.  Loops and repeated links are
    ignored, links with a null end too; nodes without a link get no row.
    """
    a, b = (F.col(f"`{c}`").cast("bigint") for c in edges.columns)
    now = stored(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(a.isNotNull() & b.isNotNull() & (a != b)).distinct())
    sums = lambda df: tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0))).first())
    before = sums(now)
    while before[0]:
        last, now = now, stored(_stars(_stars(now, True), False))
        discard(last)
        after = sums(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
