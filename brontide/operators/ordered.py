"""Order within groups of any size: numbers and neighbours of rows without one task for a group.

A group that has few rows is one window.  Where some group has more than
GROUP_ROWS, which is counted first, all rows are dealt in ranges of (group, order)
and written; a range is then one window, and only each range's count and its first
and last row are put in order for a group.  Both ways give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brontide.sources.stored import written

#: Rows of a group that one task puts in order.
GROUP_ROWS = 4_000_000


def is_crowded(df: DataFrame, group: str, most: int | None = None) -> bool:
    """Whether some group has more rows than one task should put in order."""
    return not df.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") > (GROUP_ROWS if most is None else most)).isEmpty()


def _dealt(df: DataFrame, group: str, order: tuple[str, ...]) -> DataFrame:
    """df with _part: its rows in ranges of (group, order), in as many as give each about GROUP_ROWS rows, and no fewer than a shuffle has."""
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // GROUP_ROWS))
    return written(df.repartitionByRange(ranges, F.col(group), *(F.col(o) for o in order)).withColumn("_part", F.spark_partition_id()))


def numbered(df: DataFrame, group: str, *order: str, name: str = "sequence") -> DataFrame:
    """df with gap-free numbers from 1 within each group, as integers."""
    if not is_crowded(df, group):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    dealt = _dealt(df, group, order)
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(F.col(group).alias("_group"), "_part").agg(F.count("*").alias("n"))
    offsets = counts.select("_group", F.col("_part").alias("_at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    rows = dealt.withColumn("_within", within).join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
    return rows.select(*df.columns, (F.col("_offset") + F.col("_within")).cast("int").alias(name))


def neighbour(df: DataFrame, group: str, value: Column, name: str, *order: str, ahead: bool = False) -> DataFrame:
    """df with value of the row before in its group, or of the row after; null at the end."""
    shift = F.lead if ahead else F.lag
    if not is_crowded(df, group):
        return df.withColumn(name, shift(value).over(Window.partitionBy(group).orderBy(*order)))
    dealt = _dealt(df.withColumn("_value", F.struct(value.alias("v"))), group, order)
    inside = Window.partitionBy(group, "_part").orderBy(*order)
    key = F.struct(*(F.col(o) for o in order))
    edge = (F.min_by if ahead else F.max_by)("_value", key)
    ends = dealt.groupBy(F.col(group).alias("_group"), "_part").agg(edge.alias("end"))
    across = ends.select("_group", F.col("_part").alias("_at"), shift("end").over(Window.partitionBy("_group").orderBy("_part")).alias("_end"))
    rows = dealt.withColumn("_near", shift("_value").over(inside)).join(across, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
    return rows.select(*df.columns, F.coalesce("_near", "_end")["v"].alias(name))
