"""Shared fact frame: revenue per store and product in a date window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storeline.functions.expressions import line_revenue
from storeline.sources.tables import PARTITION_COLUMNS, Tables

MONTH_COLUMN = PARTITION_COLUMNS["sale"][0]


def sale_window(sale: DataFrame, since: Column | None = None,
                until: Column | None = None) -> DataFrame:
    """Sales with ``since <= date_time < until`` (either bound optional).

    Bounds are plain ranges on the raw column, so they reach the Parquet scan
    as pushed filters. When ``sale`` is stored by month the same window is
    also stated on the month column, so whole month folders are pruned
    (a month folder holds ``month <= date_time < next month``).
    """
    cond = F.lit(True)
    month = MONTH_COLUMN in sale.columns
    if since is not None:
        cond = cond & (F.col("date_time") >= since)
        if month:
            cond = cond & (F.col(MONTH_COLUMN) >= F.trunc(since.cast("date"), "month"))
    if until is not None:
        cond = cond & (F.col("date_time") < until)
        if month:
            cond = cond & (F.col(MONTH_COLUMN) < until.cast("date"))
    return sale.filter(cond)


def product_revenue(t: Tables, since: Column | None = None, until: Column | None = None
                    ) -> DataFrame:
    """``(store_id, product_upc, revenue)`` of the items sold in the window.

    The date window is applied to ``sale`` before the join, so it reaches the
    scan (and the month folders) under the sale table; the item side is only
    joined to the surviving sales (AQE broadcasts them when they turn out
    small, and the runtime bloom filter prunes the item scan at scale).
    Quantities are summed per (store, product) first: a hot product is
    combined before it is shuffled, and its price is looked up once per store.
    """
    sale = sale_window(t.sale, since, until).select("sale_id", "store_id")
    price = t.product.select("product_upc", "price")
    return (t.sale_line_item.select("sale_id", "product_upc", "quantity")
            .join(sale, "sale_id")
            .groupBy("store_id", "product_upc").agg(F.sum("quantity").alias("quantity"))
            .join(price, "product_upc")
            .select("store_id", "product_upc", line_revenue().alias("revenue")))
