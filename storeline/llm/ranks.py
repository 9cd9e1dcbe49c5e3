"""Positions of rows within their group, without a group ever lying in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from storeline.session import stored


def ranked(df: DataFrame, group: str, order: list) -> DataFrame:
    """``df`` plus ``pos`` (from 0, by ``order`` within ``group``) and ``n``, the rows of the group.

    Rows are range-partitioned by group and order, so a group of any size is spread over as many tasks as
    it fills; a written table pins the partitions. The rows of a group before a
    partition are a running sum over one row for each partition and group. Rows that ``order`` does not tell
    apart are placed by where they stood in ``df``, so that copies spread too.
    ``group`` must not hold nulls.
    """
    spread = df.withColumn("tie", F.monotonically_increasing_id())
    spread = spread.repartitionByRange(group, *order, "tie").sortWithinPartitions(group, *order, "tie")
    place = F.monotonically_increasing_id()
    rows = stored(spread.drop("tie").select(
        "*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ranked")
    by_part = rows.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select(group, "part", (F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("first")).alias("shift"),
                             F.sum("m").over(whole).alias("n"))
    return rows.join(by_part, [group, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop(
        "part", "at", "shift")
