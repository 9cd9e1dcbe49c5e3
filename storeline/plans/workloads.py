"""Rule checks and change operators run over the driver's tables.

Each function builds its input batch from the domain tables (so its work
grows with them) and returns one DataFrame: a violations frame, a decisions
frame or a new table version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeline.functions.expressions import text_match
from storeline.operators import changes, checks
from storeline.operators.deduction import deduct_stock_atomic, deduct_stock_rows
from storeline.operators.inserts import insert_line_items
from storeline.plans.queries import reorder_alert
from storeline.schemas import SALE_LINE_ITEM, SPECS
from storeline.session import ensure_checkpoint_dir
from storeline.sources.loader import load_all, load_into, load_positional, load_validated
from storeline.sources.tables import Tables

RAW_ITEMS = "sale_line_item_raw"
ARRIVAL_ORDER = ("date_time", "sale_id")
RECALL_KEYWORD = "widget"      # products whose line items are deleted / zeroed
RESTOCK_KEYWORD = "gear"       # products whose line items get one more unit
ARCHIVE_BEFORE = "1996-01-01"  # sales dated before this are deleted


def _with_raw(t: Tables, raw_items: DataFrame) -> tuple[Tables, dict]:
    return t.replace(**{RAW_ITEMS: raw_items}), {RAW_ITEMS: SALE_LINE_ITEM}


def run_check(t: Tables, raw_items: DataFrame, which: str) -> DataFrame:
    frames, specs = _with_raw(t, raw_items)
    if which == "check_sale_has_items":
        return checks.check_sale_has_items(frames)
    fn = getattr(checks, which)
    if which == "check_foreign_key":
        return fn(frames, specs, parents=t)
    return fn(frames, specs)


def loaded_line_items(t: Tables, raw_lineitem: DataFrame) -> DataFrame:
    """Raw line items loaded through every rule of ``sale_line_item``."""
    valid, _ = load_validated(raw_lineitem, "sale_line_item",
                              parents={"sale": t.sale, "product": t.product})
    return valid


def load_violations(t: Tables, raw_lineitem: DataFrame) -> DataFrame:
    """Rule breaches found while loading raw line items (one per row and rule)."""
    _, violations = load_validated(raw_lineitem, "sale_line_item",
                                   parents={"sale": t.sale, "product": t.product})
    return violations


def positional_order_list_violations(t: Tables, positional: DataFrame) -> DataFrame:
    """Order history inserted by column position, checked against stock."""
    _, violations = load_positional(positional, "order_list", parents={"stock": t.stock})
    return violations


LATE_FROM = "1995-01-01"  # the late batch starts a year before what is stored ends


def _late_load(t: Tables, raw_lineitem: DataFrame):
    """Raw lines of the sales from LATE_FROM on, into a table that holds the items of those before ARCHIVE_BEFORE."""
    def since(day, before=None):
        c = F.col("date_time") >= F.lit(day).cast("timestamp_ntz") if before is None else F.col("date_time") < F.lit(before).cast("timestamp_ntz")
        return t.sale.filter(c).select("sale_id")

    stored = t.sale_line_item.join(since(None, ARCHIVE_BEFORE), "sale_id", "left_semi")
    batch = raw_lineitem.join(since(LATE_FROM), "sale_id", "left_semi")
    return load_into(batch, "sale_line_item", stored, parents={"sale": t.sale, "product": t.product})


def late_violations(t: Tables, raw_lineitem: DataFrame) -> DataFrame:
    return _late_load(t, raw_lineitem)[2]


def late_table(t: Tables, raw_lineitem: DataFrame) -> DataFrame:
    return _late_load(t, raw_lineitem)[0]


def whole_load(t: Tables, overdrawn: DataFrame) -> tuple[dict, DataFrame]:
    """All tables loaded at once, the vendors of ``overdrawn`` without their names: they are rejected, and with them their
    products, the stock rows, orders and line items of those, and sales without any other item."""
    frames = {n: t[n] for n in SPECS}
    gone = overdrawn.select("vendor_id", F.lit(True).alias("_gone"))
    frames["vendor"] = (t.vendor.join(gone, "vendor_id", "left")
                        .withColumn("vendor_name", F.when(F.col("_gone").isNull(), F.col("vendor_name"))).drop("_gone"))
    return load_all(frames)


def whole_load_violations(t: Tables, overdrawn: DataFrame) -> DataFrame:
    return whole_load(t, overdrawn)[1]


def whole_load_counts(t: Tables, overdrawn: DataFrame) -> DataFrame:
    """Accepted rows of each table."""
    done, _ = whole_load(t, overdrawn)
    out = None
    for n, df in done.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def _moves(t: Tables) -> DataFrame:
    """Stock rows without a threshold move to the store with the next number."""
    c = F.col
    return t.stock.filter(c("reorder_threshold").isNull()).select(
        c("product_upc").alias("old_product_upc"), c("store_id").alias("old_store_id"),
        c("product_upc").alias("new_product_upc"), (c("store_id") + 1).alias("new_store_id"))


def moved_stock(t: Tables) -> DataFrame:
    return changes.cascade_update({n: t[n] for n in SPECS}, "stock", _moves(t))[0]["stock"]


def moved_stock_blocked(t: Tables) -> DataFrame:
    return changes.cascade_update({n: t[n] for n in SPECS}, "stock", _moves(t))[1]


def _items_with_order(t: Tables) -> DataFrame:
    return t.sale_line_item.select("sale_id", "product_upc", "quantity")


def fitting_batch(t: Tables) -> DataFrame:
    """Items of the keys whose total demand fits their stock level."""
    s = t.sale.select("sale_id", "store_id")
    items = _items_with_order(t).join(s, "sale_id")
    demand = items.groupBy("product_upc", "store_id").agg(F.sum("quantity").alias("demand"))
    ok = (demand.join(t.stock.select("product_upc", "store_id", "inventory_level"),
                      ["product_upc", "store_id"])
          .filter(F.col("demand") <= F.col("inventory_level"))
          .select("product_upc", "store_id"))
    return items.join(ok, ["product_upc", "store_id"], "left_semi").select(
        "sale_id", "product_upc", "quantity")


def stock_after_fitting_batch(t: Tables) -> DataFrame:
    new_stock, _ = deduct_stock_atomic(t.stock, t.sale, fitting_batch(t))
    return new_stock


def refused_full_batch(t: Tables) -> DataFrame:
    _, rejects = deduct_stock_atomic(t.stock, t.sale, _items_with_order(t))
    return rejects


def row_by_row(t: Tables) -> tuple[DataFrame, DataFrame]:
    return deduct_stock_rows(t.stock, t.sale, _items_with_order(t), order_by=ARRIVAL_ORDER)


def row_decisions(t: Tables) -> DataFrame:
    return row_by_row(t)[1]


def stock_after_rows(t: Tables) -> DataFrame:
    """The stock table after every sold item went through the trigger."""
    return row_by_row(t)[0]


def reorder_alert_after_sales(t: Tables) -> DataFrame:
    """Q5 on the stock left after every sold item went through the trigger."""
    new_stock, _ = row_by_row(t)
    return reorder_alert(t.replace(stock=new_stock))


# receipts of the source repeat some line numbers; the smaller quantity comes first then
LINE_ORDER = ("date_time", "sale_id", "line_no", "quantity")


def inserted_lines(t: Tables, arriving: DataFrame, atomic: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every line sent again from the beginning, into a table that holds the items of the sales before
    ARCHIVE_BEFORE: those are stored already, and receipts repeat some products."""
    old = t.sale.filter(F.col("date_time") < F.lit(ARCHIVE_BEFORE).cast("timestamp_ntz")).select("sale_id")
    stored = t.sale_line_item.join(old, "sale_id", "left_semi")
    return insert_line_items(stored, t.stock, t.sale, arriving, order_by=LINE_ORDER, product=t.product, atomic=atomic)


def insert_decisions(t: Tables, arriving: DataFrame, atomic: bool = False) -> DataFrame:
    return inserted_lines(t, arriving, atomic)[2].select(
        "sale_id", "line_no", "product_upc", "store_id", "quantity", "decision")


def stock_after_insert(t: Tables, arriving: DataFrame) -> DataFrame:
    """Stock rows that the inserted lines took from."""
    return inserted_lines(t, arriving)[1].select(*t.stock.columns)


def items_after_insert(t: Tables, arriving: DataFrame) -> DataFrame:
    return inserted_lines(t, arriving)[0]


def change_log(t: Tables) -> DataFrame:
    """Single-row changes in the order of ``step``, then product: recalled products are set to zero, deleted and
    set to five; restocked ones get one more; of the sales before ARCHIVE_BEFORE every item is deleted, then set to zero."""
    def steps(items: DataFrame, first: int, *news) -> DataFrame:
        one = [F.struct(F.lit(first + i).alias("step"), n.cast("int").alias("new_quantity"),
                        F.lit(d).alias("delete")) for i, (n, d) in enumerate(news)]
        return items.select("sale_id", "product_upc", F.explode(F.array(*one)).alias("c")).select(
            "sale_id", "product_upc", "c.*")

    none = F.lit(None)
    old = t.sale.filter(F.col("date_time") < F.lit(ARCHIVE_BEFORE).cast("timestamp_ntz")).select("sale_id")
    return (steps(_keyword_items(t, RECALL_KEYWORD), 1, (F.lit(0), False), (none, True), (F.lit(5), False))
            .unionByName(steps(_keyword_items(t, RESTOCK_KEYWORD), 4, (F.col("quantity") + 1, False)))
            .unionByName(steps(t.sale_line_item.join(old, "sale_id", "left_semi"), 5, (none, True), (F.lit(0), False))))


def replayed_changes(t: Tables) -> DataFrame:
    return changes.replay_item_changes(t.sale_line_item, change_log(t), ("step", "product_upc"))[1]


def items_after_changes(t: Tables) -> DataFrame:
    return changes.replay_item_changes(t.sale_line_item, change_log(t), ("step", "product_upc"))[0]


def _keyword_items(t: Tables, keyword: str) -> DataFrame:
    hit = t.product.filter(text_match("name", keyword)).select("product_upc")
    return t.sale_line_item.join(hit, "product_upc", "left_semi")


def recall_deletes(t: Tables) -> DataFrame:
    """Delete every line item of a recalled product; last items are kept."""
    dels = _keyword_items(t, RECALL_KEYWORD).select("sale_id", "product_upc")
    _, decisions = changes.guard_delete_items(t.sale_line_item, dels)
    return decisions


def quantity_updates(t: Tables) -> DataFrame:
    """Zero the recalled product's items, add one unit to restocked ones."""
    recalled = _keyword_items(t, RECALL_KEYWORD)
    zero = recalled.select("sale_id", "product_upc", F.lit(0).alias("new_quantity"))
    plus = (_keyword_items(t, RESTOCK_KEYWORD)
            .join(recalled.select("sale_id", "product_upc"), ["sale_id", "product_upc"],
                  "left_anti")
            .select("sale_id", "product_upc", (F.col("quantity") + 1).alias("new_quantity")))
    _, decisions = changes.guard_update_items(t.sale_line_item, zero.unionByName(plus))
    return decisions


def archive_old_sales(t: Tables) -> DataFrame:
    """Delete sales before ``ARCHIVE_BEFORE``; their items go by cascade."""
    old = t.sale.filter(F.col("date_time") < F.lit(ARCHIVE_BEFORE).cast("timestamp_ntz"))
    new_tables, _ = changes.cascade_delete({n: t[n] for n in SPECS}, "sale",
                                           old.select("sale_id"))
    return new_tables["sale_line_item"]


def vendor_delete_decisions(t: Tables) -> DataFrame:
    """Try to delete every vendor: those still supplying a product are blocked."""
    allowed, blocked = changes.restrict_delete({n: t[n] for n in SPECS}, "vendor",
                                               t.vendor.select("vendor_id"))
    return (allowed.select("vendor_id", F.lit("ALLOWED").alias("decision"),
                           F.lit(None).cast("string").alias("blocked_by"))
            .unionByName(blocked.select("vendor_id", F.lit("BLOCKED").alias("decision"),
                                        "blocked_by")))


def renumber_customers(t: Tables) -> DataFrame:
    """Customer ids change sign; sale_customer follows by ON UPDATE CASCADE."""
    mapping = t.customer.select(F.col("customer_id").alias("old_id"),
                                (-F.col("customer_id")).alias("new_id"))
    new_tables, _ = changes.cascade_update({n: t[n] for n in SPECS}, "customer", mapping)
    return new_tables["sale_customer"]


def renumber_stores_blocked(t: Tables) -> DataFrame:
    """Store ids shift by 100; stock (no update action) blocks the change."""
    mapping = t.store.select(F.col("store_id").alias("old_id"),
                             (F.col("store_id") + 100).alias("new_id"))
    _, blocked = changes.cascade_update({n: t[n] for n in SPECS}, "store", mapping)
    return blocked


# the history is replayed in at least four micro-batches at every size
CHUNKS = 4
# a micro-batch rewrites the pages of its keys: with chunks of a million events most pages of a large stock table, for each
# chunk again, so a chunk has an event for every fourth stock key, however many those are: else the work would grow with the
# square of the tables. Only where one owner of keys might get more than LARGEST_CHUNK events at a time chunks have no more
KEYS_PER_EVENT = 4
LARGEST_CHUNK = 4_000_000
EVENT_ORDER = ("date_time", "step", "sale_id")
CORRECTED_AT = "1998-01-01"  # stock rows without a threshold are counted again at this time


def _receipt_lines(t: Tables) -> DataFrame:
    """Each item with its sale's store and time, as a point of sale emits it."""
    return _items_with_order(t).join(t.sale.select("sale_id", "store_id", "date_time"), "sale_id", "left")


def _rows_per_chunk(events: DataFrame, stock: DataFrame) -> int:
    from storeline.streaming.arrivals import ROWS_PER_CHUNK
    from storeline.streaming.stock_stream import default_buckets, state_bucket

    rows = max(1, min(max(ROWS_PER_CHUNK, stock.count() // KEYS_PER_EVENT), -(-events.count() // CHUNKS)))
    if rows > LARGEST_CHUNK:
        owned = events.groupBy(state_bucket(default_buckets(stock))).count()
        if owned.agg(F.max("count")).first()[0] > LARGEST_CHUNK:
            return LARGEST_CHUNK
    return rows


def _replayed(t: Tables, events: DataFrame, order_by):
    from storeline.streaming.stock_stream import replay

    ensure_checkpoint_dir(events.sparkSession)
    events = events.checkpoint(eager=True)  # joined once: they are counted, sampled and staged
    return replay(events, t.stock, order_by, rows_per_chunk=_rows_per_chunk(events, t.stock))


def stream_decisions(t: Tables) -> DataFrame:
    """Every sold item through the streaming deduction job (drained)."""
    return _replayed(t, _receipt_lines(t), ARRIVAL_ORDER).decisions().select(
        "sale_id", "product_upc", "store_id", "quantity", "decision")


def stream_low_stock(t: Tables) -> DataFrame:
    """Reorder alerts raised by the stream (level left below threshold)."""
    return _replayed(t, _receipt_lines(t), ARRIVAL_ORDER).alerts().select(
        "sale_id", "product_upc", "store_id", "level_after", "reorder_threshold")


def stock_events(t: Tables) -> DataFrame:
    """Receipt lines and changes of stock as one history, ordered by time and step.

    Every order of ``order_list`` arrives as a delivery (RESTOCK); a product that a store orders without
    having a stock row for it is listed at its first order, with a threshold of 10; stock rows without
    a threshold are set to their reorder quantity, with a threshold of 5, at CORRECTED_AT.
    """
    none = F.lit(None)
    lines = _receipt_lines(t).select(F.lit("LINE").alias("kind"), F.lit(2).alias("step"), "sale_id", "product_upc", "store_id",
                                     "quantity", none.cast("int").alias("reorder_threshold"), "date_time")
    orders = t.order_list.select(F.lit("RESTOCK").alias("kind"), F.lit(1).alias("step"), F.col("order_id").alias("sale_id"),
                                 "product_upc", "store_id", F.col("order_quantity").alias("quantity"),
                                 none.cast("int").alias("reorder_threshold"), F.col("order_datetime").alias("date_time"))
    listed = (t.order_list.join(t.stock.select("product_upc", "store_id"), ["product_upc", "store_id"], "left_anti")
              .groupBy("product_upc", "store_id").agg(F.min("order_datetime").alias("date_time"))
              .select(F.lit("STOCK").alias("kind"), F.lit(0).alias("step"), none.cast("long").alias("sale_id"), "product_upc",
                      "store_id", F.lit(0).alias("quantity"), F.lit(10).alias("reorder_threshold"), "date_time"))
    counted = (t.stock.filter(F.col("reorder_threshold").isNull())
               .select(F.lit("STOCK").alias("kind"), F.lit(0).alias("step"), none.cast("long").alias("sale_id"), "product_upc",
                       "store_id", F.col("reorder_quantity").alias("quantity"), F.lit(5).alias("reorder_threshold"),
                       F.lit(CORRECTED_AT).cast("timestamp_ntz").alias("date_time")))
    return lines.unionByName(orders).unionByName(listed).unionByName(counted)


def stream_restock(t: Tables) -> DataFrame:
    """Sales, deliveries, listings and corrections through the stream: each event's decision and the level it left."""
    return _replayed(t, stock_events(t), EVENT_ORDER).decisions().select(
        "kind", "sale_id", "product_upc", "store_id", "quantity", "decision", "level_after", "reorder_threshold", "low")
