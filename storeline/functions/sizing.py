"""Size-checked broadcast.

A side is broadcast only when its size is proven: either it is a global
aggregate (exactly one row) or a bounded probe (``limit(n + 1).count()``)
shows it holds at most ``n`` rows. Anything else is left to Catalyst and
AQE, which re-plan from measured shuffle sizes at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 100_000


def one_row(df: DataFrame) -> DataFrame:
    """Broadcast a global (ungrouped) aggregate: one row by construction."""
    return F.broadcast(df)


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only if a bounded probe proves ``rows <= max_rows``.

    The probe reads at most ``max_rows + 1`` rows, so it stays cheap however
    large the input is. Returns the (maybe hinted) frame and the decision.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small


def in_few_tasks(df: DataFrame, rows_of_task: int, least: int = 4) -> tuple[DataFrame, int]:
    """``df`` (already computed) in one task for each ``rows_of_task`` rows, ``least`` at the least, and their number.

    The number follows the rows, so tasks stay as small as they are on any input; it never exceeds
    the partitions that ``df`` has.
    """
    n = max(least, -(-df.count() // rows_of_task))
    return df.coalesce(n), n
