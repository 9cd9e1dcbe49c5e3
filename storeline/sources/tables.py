"""Typed table scans and the ``Tables`` container.

``Tables`` maps the nine domain table names to DataFrames. Entries may be
given as DataFrames or as zero-argument factories; a factory runs on first
access, so building a ``Tables`` never triggers a Spark job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeline.schemas import SPECS, TableSpec

Factory = Callable[[], DataFrame]


class Tables(Mapping):
    """Lazy, read-only mapping ``table name -> DataFrame``."""

    def __init__(self, entries: Mapping[str, DataFrame | Factory]):
        self._entries = dict(entries)
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            v = self._entries[name]
            self._cache[name] = v if isinstance(v, DataFrame) else v()
        return self._cache[name]

    def __iter__(self):
        return iter(self._entries)

    def __len__(self) -> int:
        return len(self._entries)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as e:
            raise AttributeError(name) from e

    def register_views(self, prefix: str = "") -> list[str]:
        """Expose every table as a temporary view (``spark.sql`` over the
        domain schema); returns the view names."""
        names = []
        for n in self:
            self[n].createOrReplaceTempView(prefix + n)
            names.append(prefix + n)
        return names

    def replace(self, **frames: DataFrame | Factory) -> Tables:
        """A copy with some tables swapped (e.g. stock after a deduction)."""
        merged = dict(self._entries)
        merged.update(self._cache)
        merged.update(frames)
        return Tables(merged)


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Project ``df`` onto the spec's columns, cast by name to its types."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in spec.schema.fields])


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Typed scan of one domain table stored as Parquet under ``root``.

    The declared schema is handed to the reader, so no schema inference or
    footer merge runs, and only the projected columns are read. A table
    written with a partition column (``sale_month``) keeps it, so date
    windows can prune folders.
    """
    spec = SPECS[name]
    # Partition folders (e.g. sale_month=2025-06-01) are discovered by the
    # reader and appended to the declared columns.
    return spark.read.schema(spec.schema).parquet(f"{root.rstrip('/')}/{name}")


def read_tables(spark: SparkSession, root: str, names: Iterable[str] = SPECS) -> Tables:
    return Tables({n: (lambda n=n: read_table(spark, root, n)) for n in names})


# Storage layout of the stored domain tables.
#   sale:           one folder per month (partition pruning for date windows),
#                   rows clustered by store and time inside
#   sale_line_item: clustered by receipt (row-group skipping on sale_id)
#   stock:          clustered by store, then product
#   order_list:     clustered by store and order time
PARTITION_COLUMNS = {"sale": ("sale_month", lambda: F.trunc(F.col("date_time").cast("date"), "month"))}
CLUSTER_COLUMNS = {
    "sale": ("store_id", "date_time"),
    "sale_line_item": ("sale_id", "product_upc"),
    "stock": ("store_id", "product_upc"),
    "order_list": ("store_id", "order_datetime"),
}


def write_tables(tables: Tables, root: str, mode: str = "overwrite",
                 names: Iterable[str] | None = None, files_per_table: int | None = None,
                 layout: bool = True, parallel: int = 4) -> None:
    """Write domain tables as Parquet, one folder per table.

    With ``layout`` the tables follow ``PARTITION_COLUMNS`` /
    ``CLUSTER_COLUMNS``: rows are range-partitioned on (partition column,
    cluster columns), so each task writes one contiguous key range (a hot
    month or store is split by the sampled bounds, not sent to one task) and
    every file holds a narrow range of the cluster keys, which lets pushed
    filters skip row groups.
    """
    def write_one(n: str) -> None:
        df = conform(tables[n], SPECS[n])
        w_part = None
        if layout and n in PARTITION_COLUMNS:
            w_part, derive = PARTITION_COLUMNS[n]
            df = df.withColumn(w_part, derive())
        keys = ([w_part] if w_part else []) + list(CLUSTER_COLUMNS.get(n, ()) if layout else ())
        if keys:
            # Without a file count, AQE merges neighbouring ranges up to its
            # advisory partition size, so files are well sized at any volume
            # and each still holds one contiguous key range.
            df = (df.repartitionByRange(files_per_table, *keys) if files_per_table
                  else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
        w = df.write.mode(mode)
        if w_part:
            w = w.partitionBy(w_part)
        w.parquet(f"{root.rstrip('/')}/{n}")

    todo = list(names or tables)
    # The tables are independent: their write jobs are submitted together so
    # the scheduler can run them side by side (small tables do not wait).
    with ThreadPoolExecutor(max_workers=max(1, min(parallel, len(todo)))) as pool:
        for f in [pool.submit(write_one, n) for n in todo]:
            f.result()
