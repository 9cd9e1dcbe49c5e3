"""Top rows per group by a window that limits each map partition first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group: str, value: str, tiebreak: str, n: int) -> DataFrame:
    """The ``n`` rows with the largest ``value`` per ``group`` (ties ->
    smaller ``tiebreak``), with their rank ``rn`` (1..n); NULL values don't rank.

    Spark plans a partial ``WindowGroupLimit`` before the shuffle, so each map
    partition sends at most ``n`` rows per group, no group is shipped whole
    to one task, and ``df`` is planned once.
    """
    w = Window.partitionBy(group).orderBy(F.col(value).desc(), F.col(tiebreak).asc())
    return (df.filter(F.col(value).isNotNull())
            .withColumn("rn", F.row_number().over(w))
            .filter(F.col("rn") <= n)
            .select(group, value, tiebreak, "rn"))
