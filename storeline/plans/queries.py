"""The seven business queries, the row-count summary and two derived flags.

Each function takes a ``Tables`` mapping plus run-time parameters (passed as
Python values, never spliced into SQL text) and returns a lazy DataFrame.

Where the original text leaves an order open (ties), a deterministic
tie-break is added and documented at the function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storeline.functions.expressions import (
    always_open, key_as_bigint, money, month_back, quarter_range, text_match,
)
from storeline.plans.revenue import product_revenue
from storeline.plans.topk import top_n_per_group
from storeline.schemas import COUNT_ORDER, MEMBER_LEVELS
from storeline.sources.tables import Tables


def _store_names(t: Tables, alias: str = "store") -> DataFrame:
    return t.store.select("store_id", F.col("name").alias(alias))


# Q1 ----------------------------------------------------------------------

def product_availability(t: Tables, key: str, literal: bool = False,
                         accent_insensitive: bool = False) -> DataFrame:
    """Stock per store of every product whose UPC equals ``key`` or whose
    name or brand contains it (case-insensitive).

    A non-numeric key never equals a UPC. With ``literal=False`` the key's own
    ``%``/``_`` act as wildcards, as in ``LIKE '%key%'``; ``literal=True``
    matches the text as is; ``accent_insensitive=True`` also ignores accents. An empty key matches every product.
    """
    upc = key_as_bigint(key)
    cond = (text_match("name", key, literal, accent_insensitive)
            | text_match("brand", key, literal, accent_insensitive))
    if upc is not None:
        cond = (F.col("product_upc") == F.lit(upc)) | cond
    products = t.product.filter(cond).select("product_upc", "name")
    stock = t.stock.select("product_upc", "store_id", "inventory_level")
    return (stock.join(products, "product_upc")
            .join(_store_names(t), "store_id")
            .select("store_id", "store", "product_upc", "name", "inventory_level"))


# Q2 ----------------------------------------------------------------------

def top_selling_past_month(t: Tables, as_of=None, n: int = 1) -> DataFrame:
    """Per store, the product with the highest revenue in sales dated on or
    after ``as_of`` minus one month (midnight). Revenue is returned as text.

    Ties on revenue go to the smallest UPC. Map-side partial aggregation and
    the partial limit before the ranking keep a store holding a large share
    of the rows from landing whole in one task. ``n > 1`` returns the top
    ``n`` per store with their rank ``rn``.
    """
    per_product = product_revenue(t, since=month_back(as_of))
    best = top_n_per_group(per_product, "store_id", "revenue", "product_upc", n)
    names = t.product.select("product_upc", "name")
    cols = ["store_id", "store", "product_upc", "name",
            money(F.col("revenue")).cast("string").alias("revenue")]
    if n > 1:
        cols.append("rn")
    return (best.join(names, "product_upc")
            .join(_store_names(t), "store_id")
            .select(*cols)
            .orderBy("store_id", *(["rn"] if n > 1 else [])))


# Q3 ----------------------------------------------------------------------

def best_store_this_quarter(t: Tables, as_of=None) -> DataFrame:
    """Store(s) with the highest revenue in the calendar quarter of ``as_of``.

    All stores tied at the maximum are returned. Revenue is planned once: the
    stores are ranked by it, and a partial limit before the ranking sends only
    each partition's best stores to the task that ranks them.
    """
    start, end = quarter_range(as_of)
    per_store = (product_revenue(t, since=start, until=end).groupBy("store_id")
                 .agg(money(F.sum("revenue")).alias("revenue"))
                 .filter(F.col("revenue").isNotNull()))
    winners = (per_store.withColumn("rk", F.rank().over(Window.orderBy(F.desc("revenue"))))
               .filter(F.col("rk") == 1).drop("rk"))
    return (winners.join(t.store.select("store_id", "name"), "store_id")
            .select("store_id", "name", "revenue"))


# Q4 ----------------------------------------------------------------------

def vendor_stats(t: Tables, distinct: bool = False) -> DataFrame:
    """Per vendor: number of distinct products and total units sold.

    Line items are summed per product before the join, so the join never
    repeats a product per line item, and with the product key unique a plain
    count of products equals the distinct count (no extra shuffle on
    (vendor, product)); ``distinct=True`` counts distinct UPCs for input
    whose keys were not validated. Vendors without products give (0, 0);
    products never sold still count. Ordered by product count, then vendor.
    """
    units = t.sale_line_item.groupBy("product_upc").agg(F.sum("quantity").alias("units"))
    types = F.count_distinct("product_upc") if distinct else F.count("product_upc")
    per_vendor = (t.product.select("product_upc", "vendor_id")
                  .join(units, "product_upc", "left")
                  .groupBy("vendor_id")
                  .agg(types.alias("product_types"), F.sum("units").alias("units")))
    return (t.vendor.select("vendor_id", "vendor_name")
            .join(per_vendor, "vendor_id", "left")
            .select("vendor_id", "vendor_name",
                    F.coalesce("product_types", F.lit(0)).cast("bigint").alias("product_types"),
                    F.coalesce("units", F.lit(0)).cast("bigint").alias("total_units_sold"))
            .orderBy(F.desc("product_types"), "vendor_id"))


# Q5 ----------------------------------------------------------------------

def reorder_alert(t: Tables) -> DataFrame:
    """Stock rows strictly below their reorder threshold (NULL never alerts)."""
    low = t.stock.filter(F.col("inventory_level") < F.col("reorder_threshold"))
    return (low.join(_store_names(t), "store_id")
            .join(t.product.select("product_upc", F.col("name").alias("product")), "product_upc")
            .orderBy("store_id", "product_upc")
            .select("store_id", "store", "product", "inventory_level", "reorder_threshold"))


# Q6 ----------------------------------------------------------------------

def loyalty_bundle(t: Tables, keyword: str, n: int = 3, dedupe: bool = False,
                   levels: tuple[str, ...] = MEMBER_LEVELS) -> DataFrame:
    """Top ``n`` products bought together with a ``keyword`` product on
    receipts of members at the given loyalty levels.

    Bag semantics by default: a receipt with k matching products counts its
    other items k times. That is computed as ``sum(quantity * k)`` with k
    aggregated per receipt first, instead of joining k copies of each item.
    ``dedupe=True`` counts each receipt once. Ties: name, then UPC.
    """
    pattern_hit = text_match("name", keyword)
    members = (t.sale_customer.select("sale_id", "customer_id")
               .join(t.customer.filter(F.col("loyalty_status").isin(*levels))
                     .select("customer_id"), "customer_id", "left_semi")
               .join(t.sale.select("sale_id"), "sale_id", "left_semi"))
    hit_products = t.product.filter(pattern_hit).select("product_upc")
    hits = (t.sale_line_item.select("sale_id", "product_upc")
            .join(hit_products, "product_upc", "left_semi")
            .join(members, "sale_id", "inner")
            .groupBy("sale_id").agg(F.count(F.lit(1)).alias("k")))
    if dedupe:
        hits = hits.withColumn("k", F.lit(1).cast("bigint"))
    other = t.product.filter(~pattern_hit).select("product_upc", "name")
    # numbers only in the aggregate (hash-based); names join the per-product sums
    bundled = (t.sale_line_item.join(hits, "sale_id", "inner")
               .join(other.select("product_upc"), "product_upc", "left_semi")
               .groupBy("product_upc")
               .agg(F.sum(F.col("quantity") * F.col("k")).alias("cnt"))
               .join(other, "product_upc"))
    return (bundled.orderBy(F.desc("cnt"), "name", "product_upc").limit(n)
            .select(F.col("name").alias("item"), F.col("cnt").cast("bigint").alias("cnt")))


# Q7 ----------------------------------------------------------------------

def variety_by_ownership(t: Tables, distinct: bool = False) -> DataFrame:
    """Per ownership type, the store(s) stocking the most distinct products
    (ties kept). A stock row with level 0 still counts as stocked.

    (product, store) is the stock key, so counting rows per store equals
    counting distinct products: one partial aggregate, no shuffle of every
    stock row by (store, product). ``distinct=True`` for unvalidated input.
    """
    kinds_expr = F.count_distinct("product_upc") if distinct else F.count("product_upc")
    kinds = (t.stock.select("store_id", "product_upc")
             .join(t.store.select("store_id", "ownership_type"), "store_id")
             .groupBy("store_id", "ownership_type")
             .agg(kinds_expr.alias("kinds")))
    best = kinds.groupBy("ownership_type").agg(F.max("kinds").alias("max_k"))
    return (kinds.join(best, "ownership_type")
            .filter(F.col("kinds") == F.col("max_k"))
            .select("ownership_type", "store_id", "kinds"))


# Row counts and derived flags ---------------------------------------------

def table_counts(t: Tables, names: tuple[str, ...] = COUNT_ORDER) -> DataFrame:
    """``(table_name, row_count)`` for eight tables, one job for all."""
    parts = [t[n].agg(F.count(F.lit(1)).alias("row_count"))
                 .select(F.lit(n).alias("table_name"), F.lit(i).alias("pos"), "row_count")
             for i, n in enumerate(names)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("pos").select("table_name", "row_count")


def sale_member_flag(t: Tables) -> DataFrame:
    """Each sale with its member (if any): no ``sale_customer`` row = non-member."""
    sc = t.sale_customer.select("sale_id", "customer_id")
    return (t.sale.select("sale_id").join(sc, "sale_id", "left")
            .select("sale_id", F.col("customer_id").isNotNull().alias("is_member"),
                    "customer_id"))


def store_always_open(t: Tables) -> DataFrame:
    """Each store with its 24-hour flag (open time = close time)."""
    return t.store.select("store_id", "name", always_open().alias("always_open"))
