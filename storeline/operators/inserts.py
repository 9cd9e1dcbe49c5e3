"""Insert of line items as one operator: the stock trigger and the table's rules together.

A line is refused, and takes nothing from stock, for the first of these reasons:

* ``NO_STOCK_ROW`` — no stock row for the product in the receipt's store (an unknown or missing receipt,
  product or store included);
* ``NOT_NULL`` — no quantity, or no receipt on a line that carries its store;
* ``SHORT`` — less in stock than the quantity, at that moment;
* ``CHECK_QUANTITY`` — a quantity that is not positive;
* ``DUPLICATE_KEY`` — (receipt, product) is stored already, or an earlier line of the batch was accepted for it;
* ``FOREIGN_KEY`` — the product does not exist (only with ``product``).

Lines are inserted one by one in arrival order, or as one statement (``atomic``): then one
refused line undoes all others (``ROLLED_BACK``), items and stock alike.

Whether a repeated (receipt, product) is refused as SHORT or as DUPLICATE_KEY, and which of its lines is the accepted one,
depends on the level when each arrives: an earlier line that did not fit was not stored, so a later, smaller one may be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeline.functions.sizing import DEFAULT_MAX_ROWS
from storeline.operators.changes import DUPLICATE_KEY, ITEM_KEY, NOT_NULL, ROLLED_BACK
from storeline.operators.deduction import BAD_QTY, NO_STOCK, OK, SHORT, stock_after
from storeline.operators.fold import KEY, KEY_ROWS, ordered_fold
from storeline.session import ensure_checkpoint_dir, ship_package

FOREIGN_KEY = "FOREIGN_KEY"


def insert_line_items(items: DataFrame, stock: DataFrame, sale: DataFrame, batch: DataFrame,
                      order_by: Sequence[str] = ("date_time", "sale_id"), product: DataFrame | None = None,
                      atomic: bool = False, key_rows: int = KEY_ROWS, segments: int | None = None,
                      max_broadcast: int = DEFAULT_MAX_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Insert ``batch`` (sale_id, product_upc, quantity and arrival columns) into ``items``.

    ``order_by`` columns come from the batch or from ``sale``; lines that they do not tell apart are taken in the order
    of the batch. Returns ``(new_items, new_stock, decisions)``; a decision row has sale_id, product_upc,
    store_id, quantity, the other columns of the batch and ``decision``.

    Plan: lines meet their receipt, stock row and stored key by one join each, and are checkpointed once.
    Keys whose whole demand fits need no order but that of repeated lines, which one aggregate over (receipt,
    product) gives; the items of the others go through ``ordered_fold`` with the receipt as claim.
    """
    spark = batch.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    order_by = list(order_by)
    lines = batch.withColumn("_line", F.monotonically_increasing_id())
    missing = [c for c in dict.fromkeys(["store_id", *order_by]) if c not in lines.columns and c != "sale_id"]
    if missing:
        lines = lines.join(sale.select("sale_id", *missing), "sale_id", "left")
    qty, level = F.col("quantity"), F.col("_level")
    valid = qty.isNotNull() & (qty > 0)
    demand = lines.filter(valid).groupBy(*KEY).agg(F.sum("quantity").alias("_demand"))
    shelves = stock.select(*KEY, F.col("inventory_level").alias("_level")).join(demand, KEY, "left")
    lines = (lines.join(shelves, KEY, "left")
             .join(items.select(*ITEM_KEY).dropDuplicates().withColumn("_bar", F.lit(DUPLICATE_KEY)), ITEM_KEY, "left"))
    if product is not None:
        known = product.select("product_upc", F.lit(True).alias("_known"))
        lines = lines.join(known, "product_upc", "left").withColumn(
            "_bar", F.coalesce("_bar", F.when(F.col("_known").isNull(), F.lit(FOREIGN_KEY)))).drop("_known")
    fixed = (F.when(level.isNull(), F.lit(NO_STOCK)).when(qty.isNull() | F.col("sale_id").isNull(), F.lit(NOT_NULL))
             .when(qty <= 0, F.lit(BAD_QTY)).when(qty > level, F.lit(SHORT)))
    lines = lines.withColumn("_fixed", fixed).checkpoint(eager=True)

    open_lines = lines.filter(F.col("_fixed").isNull())
    # where everything fits, the first line of each (receipt, product) is accepted
    at = F.struct(*order_by, "_line")
    roomy = open_lines.filter(F.col("_demand") <= level)
    firsts = roomy.filter(F.col("_bar").isNull()).groupBy(*ITEM_KEY).agg(F.min(at).alias("_first"))
    roomy = roomy.join(firsts, ITEM_KEY, "left").withColumn(
        "decision", F.when(F.col("_bar").isNotNull(), F.col("_bar")).when(at == F.col("_first"), F.lit(OK))
        .otherwise(F.lit(DUPLICATE_KEY)))
    tight = open_lines.filter(F.col("_demand") > level).withColumnsRenamed({"_level": "inventory_level", "_line": "item"})
    tight = ordered_fold(tight, order_by, claim="sale_id", bar="_bar", key_rows=key_rows, segments=segments,
                         max_broadcast=max_broadcast)
    tight = tight.withColumn(
        "decision", F.when(F.col("quantity") > F.col("level_before"), F.lit(SHORT)).when(F.col("taken"), F.lit(OK))
        .otherwise(F.coalesce("_bar", F.lit(DUPLICATE_KEY))))
    out = list(dict.fromkeys(["sale_id", "product_upc", "store_id", "quantity",
                              *[c for c in [*batch.columns, *order_by]], "decision"]))
    decisions = (lines.filter(F.col("_fixed").isNotNull()).withColumn("decision", F.col("_fixed")).select(*out)
                 .unionByName(roomy.select(*out)).unionByName(tight.select(*out)))
    if atomic:
        refused = decisions.filter(F.col("decision") != OK).exists()
        decisions = decisions.withColumn("decision", F.when(refused & (F.col("decision") == OK), F.lit(ROLLED_BACK))
                                         .otherwise(F.col("decision")))
    stored = decisions.filter(F.col("decision") == OK)
    new_items = items.unionByName(stored.select(*ITEM_KEY, F.col("quantity").cast("int").alias("quantity")))
    return new_items, stock_after(stock, decisions), decisions
