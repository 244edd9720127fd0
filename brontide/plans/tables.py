"""Flows held as tables: the order of all flows' nodes at once, and what each output needs.

nodes: (flow, node, at), at being the node's place in its flow's list; edges:
(flow, src, dst, at).  A round settles one level of every flow and writes only
what it settles, so a million flows take as many rounds as the deepest of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brontide.sources.stored import Log, discard, written

_KEY = ["flow", "node"]


def order_flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow, node, position): inputs first, ready nodes in the order they become ready; the list's own order in a flow with a cycle.

    Of the nodes that become ready in one level the first is the one whose last
    input comes first, and of one input's the one whose edge does, as in a queue.
    Edges with an end that is no node of the flow don't count; an edge that is
    there twice does twice.
    """
    spark = nodes.sparkSession
    nodes = written(nodes.select("flow", "node", "at"))
    ends = nodes.select("flow", "node")
    good = edges.join(ends.withColumnRenamed("node", "src"), ["flow", "src"], "left_semi").join(ends.withColumnRenamed("node", "dst"), ["flow", "dst"], "left_semi")
    good = written(good.select("flow", "src", "dst", F.col("at").cast("bigint").alias("edge_at")))
    waits = written(good.groupBy("flow", F.col("dst").alias("node")).agg(F.count("*").alias("n")))
    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in _KEY)
    settled, fallen = Log(spark, f"{kinds}, position bigint"), Log(spark, f"{kinds}, n bigint, last struct<position:bigint,edge_at:bigint>")
    place = lambda *order: F.row_number().over(Window.partitionBy("flow").orderBy(*order)).cast("bigint")
    front = settled.append(nodes.join(waits, _KEY, "left_anti").select("flow", "node", (place("at") - 1).alias("position")))
    while not front.isEmpty():
        step = good.join(front.withColumnRenamed("node", "src"), ["flow", "src"]).groupBy("flow", F.col("dst").alias("node"))
        counted = fallen.append(step.agg(F.count("*").alias("n"), F.max(F.struct("position", "edge_at")).alias("last")))
        touched = fallen.rows().join(counted.select(*_KEY), _KEY, "left_semi").groupBy(*_KEY).agg(F.sum("n").alias("gone"), F.max("last").alias("last"))
        ready = touched.join(waits, _KEY).filter("gone = n")
        before = settled.rows().groupBy("flow").agg(F.count("*").alias("before"))
        front = settled.append(ready.join(before, "flow").select("flow", "node", (F.col("before") + place("last") - 1).alias("position")))
    fallen.discard()
    every = nodes.join(settled.rows().select("flow", "node", "position"), _KEY, "left")
    stuck = every.filter("position is null").select("flow").distinct().withColumn("stuck", F.lit(True))
    listed = every.join(stuck, "flow", "left").withColumn("listed", place("at") - 1)
    discard(waits, good)
    return listed.select("flow", "node", F.when(F.col("stuck"), F.col("listed")).otherwise(F.col("position")).alias("position"))


def upstream_of(edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """(flow, output, node): what each output (flow, node) depends on, itself included."""
    edges = written(edges.select("flow", "src", "dst").distinct())
    kind = lambda c: outputs.schema[c].dataType.simpleString()
    seen = Log(edges.sparkSession, f"flow {kind('flow')}, output {kind('node')}, node {kind('node')}")
    front = seen.append(outputs.select("flow", F.col("node").alias("output"), "node").distinct())
    while not front.isEmpty():
        new = front.withColumnRenamed("node", "dst").join(edges, ["flow", "dst"]).select("flow", "output", F.col("src").alias("node")).distinct()
        front = seen.append(new.join(seen.rows().select("flow", "output", "node"), ["flow", "output", "node"], "left_anti"))
    discard(edges)
    return seen.rows().select("flow", "output", "node")
