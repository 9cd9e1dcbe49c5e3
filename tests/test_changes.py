"""Receipt guards, referential actions, the stream and the scan/sink round trip."""

import contextlib
import io
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from storeline.operators import changes
from storeline.operators.deduction import deduct_stock_rows
from storeline.plans import queries as Q
from storeline.schemas import SPECS
from storeline.sources.tables import read_tables, write_tables
from storeline.streaming.stock_stream import run_to_completion
from tests.fixtures import chain

KEYS = "sale_id long, product_upc long"


@pytest.fixture(scope="module")
def t(spark):
    return chain(spark)


def decisions(df):
    return {(r.sale_id, r.product_upc): r.decision for r in df.collect()}


def test_delete_guard(spark, t):
    dels = spark.createDataFrame([(4, 1003), (1, 1001), (1, 1002), (2, 1001), (2, 1004),
                                  (9, 1001)], KEYS)
    kept, dec = changes.guard_delete_items(t.sale_line_item, dels)
    assert decisions(dec) == {(4, 1003): "LAST_ITEM", (1, 1001): "ACCEPTED",
                              (1, 1002): "ACCEPTED", (2, 1001): "LAST_ITEM",
                              (2, 1004): "LAST_ITEM", (9, 1001): "NO_SUCH_ROW"}
    assert kept.count() == 13 - 2
    assert kept.filter("sale_id = 1").count() == 1


def test_delete_guard_atomic(spark, t):
    dels = spark.createDataFrame([(4, 1003), (1, 1001)], KEYS)
    kept, dec = changes.guard_delete_items(t.sale_line_item, dels, atomic=True)
    assert decisions(dec) == {(4, 1003): "LAST_ITEM", (1, 1001): "ROLLED_BACK"}
    assert kept.count() == 13


def test_update_guard(spark, t):
    upd = spark.createDataFrame([(4, 1003, 0), (1, 1001, 0), (1, 1002, 5), (9, 1, 1),
                                 (3, 1006, None)],
                                "sale_id long, product_upc long, new_quantity int")
    new, dec = changes.guard_update_items(t.sale_line_item, upd)
    assert decisions(dec) == {(4, 1003): "LAST_ITEM_ZERO", (1, 1001): "CHECK_QUANTITY",
                              (1, 1002): "ACCEPTED", (9, 1): "NO_SUCH_ROW",
                              (3, 1006): "NOT_NULL"}
    q = {(r.sale_id, r.product_upc): r.quantity for r in new.collect()}
    assert q[(1, 1002)] == 5 and q[(4, 1003)] == 4 and q[(1, 1001)] == 2


def test_cascade_delete_of_sale(spark, t):
    out, blocked = changes.cascade_delete(dict(t), "sale", spark.createDataFrame([(1,)], "sale_id long"))
    assert blocked.count() == 0
    assert out["sale"].count() == 6
    assert out["sale_line_item"].count() == 10
    assert out["sale_customer"].count() == 4


def test_cascade_delete_of_stock_takes_orders(spark, t):
    keys = spark.createDataFrame([(1001, 1)], "product_upc long, store_id int")
    out, blocked = changes.cascade_delete(dict(t), "stock", keys)
    assert blocked.count() == 0
    assert out["stock"].count() == 9 and out["order_list"].count() == 1


def test_restrict_delete(spark, t):
    stores = spark.createDataFrame([(2,), (4,)], "store_id int")
    allowed, blocked = changes.restrict_delete(dict(t), "store", stores)
    assert [r.store_id for r in allowed.collect()] == [4]
    assert [(r.store_id, r.blocked_by) for r in blocked.collect()] == [(2, "sale,stock")]
    vendors = spark.createDataFrame([(1,), (3,)], "vendor_id int")
    allowed, blocked = changes.restrict_delete(dict(t), "vendor", vendors)
    assert [r.vendor_id for r in allowed.collect()] == [3]
    assert [(r.vendor_id, r.blocked_by) for r in blocked.collect()] == [(1, "product")]


def test_cascade_update(spark, t):
    m = spark.createDataFrame([(1, 100), (2, 3)], "old_id int, new_id int")
    out, blocked = changes.cascade_update(dict(t), "customer", m)
    assert [(r.old_id, r.reason) for r in blocked.collect()] == [(2, "DUPLICATE_KEY")]
    sc = sorted(tuple(r) for r in out["sale_customer"].collect())
    assert sc == [(1, 100), (2, 3), (3, 2), (5, 4), (7, 100)]
    assert sorted(r.customer_id for r in out["customer"].collect()) == [2, 3, 4, 5, 100]
    m = spark.createDataFrame([(1, 10), (4, 40)], "old_id int, new_id int")
    out, blocked = changes.cascade_update(dict(t), "store", m)
    assert [(r.old_id, r.reason) for r in blocked.collect()] == [(1, "RESTRICTED:stock")]
    assert sorted(r.store_id for r in out["store"].collect()) == [1, 2, 3, 40]


def test_stream_matches_batch_fold_across_micro_batches(spark):
    stock = spark.createDataFrame([(1, 10, 10, 5, 1), (2, 10, 3, 1, 1)], SPECS["stock"].schema)
    sale = spark.createDataFrame([(i, 10, i) for i in range(1, 8)], "sale_id long, store_id int, seq long")
    base = tempfile.mkdtemp(prefix="stream-in-", dir="/tmp")
    batches = [[(1, 1, 6)], [(2, 1, 7), (3, 1, 4)], [(4, 2, 3), (5, 2, 1), (6, 9, 1), (7, 1, 0)]]
    schema = "sale_id long, product_upc long, quantity int"
    for i, b in enumerate(batches):   # one file per micro-batch, written in order
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(os.path.join(base, f"b{i}"))
        os.utime(os.path.join(base, f"b{i}"))
    files = sorted(os.path.join(root, f) for root, _, fs in os.walk(base) for f in fs
                   if f.endswith(".parquet"))
    flat = tempfile.mkdtemp(prefix="stream-flat-", dir="/tmp")
    for i, f in enumerate(files):
        os.link(f, os.path.join(flat, f"part-{i}.parquet"))
    out = run_to_completion(flat, schema, stock, sale, order_by=["seq"], files_per_batch=1,
                            n_buckets=4)
    got = {(r.sale_id, r.product_upc): (r.decision, r.level_after) for r in out.collect()}
    assert got == {(1, 1): ("OK", 4), (2, 1): ("SHORT", 4), (3, 1): ("OK", 0),
                   (4, 2): ("OK", 0), (5, 2): ("SHORT", 0), (6, 9): ("NO_STOCK_ROW", None),
                   (7, 1): ("CHECK_QUANTITY", 0)}
    items = spark.createDataFrame([x for b in batches for x in b], schema)
    _, batch = deduct_stock_rows(stock, sale, items, order_by=["seq"])
    assert {k: v[0] for k, v in got.items()} == decisions(batch)


def test_write_and_typed_read_round_trip(spark, t):
    root = tempfile.mkdtemp(prefix="tables-", dir="/tmp")
    write_tables(t, root, files_per_table=3)
    back = read_tables(spark, root)
    for n in SPECS:
        assert back[n].count() == t[n].count(), n
        assert list(back[n].schema)[:len(SPECS[n].columns)] == list(SPECS[n].schema), n
    assert "sale_month" in back.sale.columns
    months = sorted(d for d in os.listdir(os.path.join(root, "sale")) if d.startswith("sale_month="))
    assert months == ["sale_month=2025-03-01", "sale_month=2025-05-01", "sale_month=2025-06-01"]


def test_stored_layout_prunes_months_and_keeps_results(spark, t):
    root = tempfile.mkdtemp(prefix="tables-", dir="/tmp")
    write_tables(t, root, files_per_table=2)
    back = read_tables(spark, root)
    for as_of in ("2025-06-13", "2025-03-15", "2025-07-20"):
        assert Q.top_selling_past_month(back, as_of).collect() == \
            Q.top_selling_past_month(t, as_of).collect()
        assert Q.best_store_this_quarter(back, as_of).collect() == \
            Q.best_store_this_quarter(t, as_of).collect()
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        Q.best_store_this_quarter(back, "2025-06-13").explain("formatted")
    assert "PartitionFilters: [isnotnull(sale_month" in plan.getvalue()


def test_manual_cases_of_the_original(spark, t):
    """The four hand-run checks: sell 1 of 40, oversell, delete / zero the last item."""
    stock = t.stock.unionByName(spark.createDataFrame([(1007, 1, 40, 5, 10)], t.stock.schema))
    sale = t.sale
    one = spark.createDataFrame([(1, 1007, 1, 1)], "sale_id long, product_upc long, quantity int, seq long")
    new, dec = deduct_stock_rows(stock, sale, one, order_by=["seq"])
    assert decisions(dec) == {(1, 1007): "OK"}
    assert new.filter("product_upc = 1007 AND store_id = 1").first().inventory_level == 39
    big = spark.createDataFrame([(1, 1007, 9999, 1)], "sale_id long, product_upc long, quantity int, seq long")
    new, dec = deduct_stock_rows(stock, sale, big, order_by=["seq"])
    assert decisions(dec) == {(1, 1007): "SHORT"}
    assert new.filter("product_upc = 1007 AND store_id = 1").first().inventory_level == 40
    _, dec = changes.guard_delete_items(t.sale_line_item, spark.createDataFrame([(4, 1003)], KEYS))
    assert decisions(dec) == {(4, 1003): "LAST_ITEM"}
    _, dec = changes.guard_update_items(t.sale_line_item, spark.createDataFrame(
        [(4, 1003, 0)], "sale_id long, product_upc long, new_quantity int"))
    assert decisions(dec) == {(4, 1003): "LAST_ITEM_ZERO"}


def test_update_guard_repeated_and_conflicting_requests(spark, t):
    upd = spark.createDataFrame([(1, 1002, 5), (1, 1002, 5), (3, 1004, 1), (3, 1004, 2)],
                                "sale_id long, product_upc long, new_quantity int")
    new, dec = changes.guard_update_items(t.sale_line_item, upd)
    assert sorted((r.sale_id, r.product_upc, r.new_quantity, r.decision) for r in dec.collect()) == [
        (1, 1002, 5, "ACCEPTED"), (3, 1004, 1, "CONFLICTING_UPDATE"),
        (3, 1004, 2, "CONFLICTING_UPDATE")]
    assert new.count() == 13
    q = {(r.sale_id, r.product_upc): r.quantity for r in new.collect()}
    assert q[(1, 1002)] == 5 and q[(3, 1004)] == 2


def test_stream_restart_resumes_from_checkpoint(spark):
    """Stop after the first files, restart on the same checkpoint: the state
    (remaining levels) carries over and no input is processed twice."""
    stock = spark.createDataFrame([(1, 10, 10, 5, 1)], SPECS["stock"].schema)
    sale = spark.createDataFrame([(i, 10, i) for i in range(1, 6)], "sale_id long, store_id int, seq long")
    schema = "sale_id long, product_upc long, quantity int"
    src = tempfile.mkdtemp(prefix="stream-src-", dir="/tmp")
    sink = tempfile.mkdtemp(prefix="stream-sink-", dir="/tmp")
    ckpt = tempfile.mkdtemp(prefix="stream-ckpt-", dir="/tmp")
    spark.createDataFrame([(1, 1, 6), (2, 1, 7)], schema).coalesce(1).write.mode("append").parquet(src)
    first = run_to_completion(src, schema, stock, sale, order_by=["seq"], sink_dir=sink,
                              checkpoint_dir=ckpt, n_buckets=4)
    assert {r.sale_id: r.decision for r in first.collect()} == {1: "OK", 2: "SHORT"}
    spark.createDataFrame([(3, 1, 4), (4, 1, 1)], schema).coalesce(1).write.mode("append").parquet(src)
    both = run_to_completion(src, schema, stock, sale, order_by=["seq"], sink_dir=sink,
                             checkpoint_dir=ckpt, n_buckets=4)
    got = sorted((r.sale_id, r.decision, r.level_after) for r in both.collect())
    assert got == [(1, "OK", 4), (2, "SHORT", 4), (3, "OK", 0), (4, "SHORT", 0)]


def test_history_replayed_in_arrival_chunks(spark):
    """A history staged as several time-ordered chunks (one micro-batch each)
    gives the batch fold's decisions."""
    import datetime as dt
    import random

    from storeline.streaming.arrivals import stage_by_arrival
    from storeline.streaming.stock_stream import as_events, replay

    rnd = random.Random(3)
    stock = spark.createDataFrame([(1, 10, 30, 5, 1), (2, 10, 12, 5, 1)], SPECS["stock"].schema)
    rows = []
    for i in range(120):
        t0 = dt.datetime(2025, 1, 1) + dt.timedelta(hours=rnd.randint(0, 500))
        rows.append((i, 1 + i % 2, rnd.randint(1, 6), 10, t0))
    rows += [(900, 1, 2, None, None), (901, 2, 1, None, None)]   # unknown sales: no time
    lines = spark.createDataFrame(rows, "sale_id long, product_upc long, quantity int, "
                                        "store_id int, date_time timestamp_ntz")
    order = ("date_time", "sale_id")
    folder, k = stage_by_arrival(as_events(lines), order, rows_per_chunk=25)
    assert k >= 4
    # a chunk holds nothing that arrives after the next one begins
    spans = (spark.read.parquet(folder).groupBy("chunk").agg(F.min(F.struct(*order)).alias("a"), F.max(F.struct(*order)).alias("b"))
             .orderBy("chunk").collect())
    key = lambda r: (r.date_time is not None, r.date_time or dt.datetime.min, r.sale_id)
    assert len(spans) == k and all(key(x.b) < key(y.a) for x, y in zip(spans, spans[1:]))
    out = replay(lines, stock, order, staged=(folder, k), n_buckets=2).decisions()
    _, batch = deduct_stock_rows(stock, None, lines, order_by=("date_time", "sale_id"))
    assert decisions(out) == decisions(batch)
    assert decisions(out)[(900, 1)] == "NO_STOCK_ROW" and len(decisions(out)) == 122


def test_key_change_conflicts(spark, t):
    ids = sorted(r[0] for r in t.customer.select("customer_id").collect())
    a, b, c = ids[:3]
    mapping = spark.createDataFrame(
        [(a, 9001), (b, 9001), (c, 9002), (c, 9003), (a, a), (77777, 9004), (ids[3], None)],
        "old_id long, new_id long")
    out, blocked = changes.cascade_update(t.as_dict() if hasattr(t, "as_dict") else t, "customer", mapping)
    got = {(r.old_id, r.new_id): r.reason for r in blocked.collect()}
    assert got == {(a, 9001): "DUPLICATE_KEY", (b, 9001): "DUPLICATE_KEY", (c, 9002): "CONFLICTING_UPDATE",
                   (c, 9003): "CONFLICTING_UPDATE", (77777, 9004): "NO_SUCH_ROW", (ids[3], None): "NOT_NULL"}
    assert sorted(r[0] for r in out["customer"].select("customer_id").collect()) == ids


def test_key_change_identity_is_no_change(spark, t):
    a = t.customer.first().customer_id
    mapping = spark.createDataFrame([(a, a)], "old_id long, new_id long")
    out, blocked = changes.cascade_update(t.as_dict() if hasattr(t, "as_dict") else t, "customer", mapping)
    assert blocked.count() == 0 and out["customer"].count() == t.customer.count()


def test_stream_bucket_count_survives_growth(spark, tmp_path):
    from storeline.streaming.stock_stream import kept_buckets

    path = f"file://{tmp_path}/ckpt"
    small = spark.range(10)
    first = kept_buckets(small, path, None)
    assert kept_buckets(spark.range(10_000_000), path, None) == first
    with pytest.raises(ValueError):
        kept_buckets(small, path, first + 1)


def test_referential_actions_are_all_or_nothing_when_atomic(t):
    tables = {n: t[n] for n in SPECS}
    keys = t.vendor.select("vendor_id")
    allowed, blocked = changes.restrict_delete(tables, "vendor", keys)
    assert allowed.count() and blocked.count()
    assert changes.restrict_delete(tables, "vendor", keys, atomic=True)[0].count() == 0
    new, refused = changes.cascade_delete(tables, "vendor", keys, atomic=True)
    assert new["vendor"].count() == keys.count() and refused.count() == blocked.count()
    fine = changes.cascade_delete(tables, "vendor", allowed, atomic=True)[0]
    assert fine["vendor"].count() == keys.count() - allowed.count()
    ids = [r.customer_id for r in t.customer.select("customer_id").collect()]
    mapping = t.customer.sparkSession.createDataFrame(
        [(ids[0], 9001), (10**6, 9002)], "old_id int, new_id int")
    for atomic, want in ((False, 1), (True, 0)):
        new, refused = changes.cascade_update(tables, "customer", mapping, atomic=atomic)
        assert [r.reason for r in refused.collect()] == ["NO_SUCH_ROW"]
        assert new["customer"].filter("customer_id = 9001").count() == want


def test_restrict_delete_neither_sorts_nor_joins_the_references(spark):
    """Requested and referenced keys meet in one aggregate, also where nothing is small enough to be broadcast."""
    from storeline.schemas import SPECS

    rows = {"product": [(u, "p", None, None, None, None, 1) for u in (1, 2, 3, 4)],
            "stock": [(1, 10, 5, None, 1), (2, 10, 5, None, 1), (1, 11, 5, None, 1)],
            "sale_line_item": [(1, 2, 1), (2, 2, 1), (2, 3, 1), (3, 9, 1), (4, None, 1)]}
    tables = {n: spark.createDataFrame(r, SPECS[n].schema) for n, r in rows.items()}
    asked = spark.createDataFrame([(1,), (2,), (2,), (4,), (None,)], "product_upc long")
    allowed, blocked = changes.restrict_delete(tables, "product", asked)
    assert {r.product_upc for r in allowed.collect()} == {4, None}
    assert {tuple(r) for r in blocked.collect()} == {(1, "stock"), (2, "sale_line_item,stock")}
    for frame in (allowed, blocked):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan and "Sort" not in plan


def test_quantity_updates_are_shuffled_by_item_once(spark):
    """Repeats, conflicts and the join with the items share one shuffle of the requests."""
    items = spark.createDataFrame([(1, 10, 2), (1, 11, 2), (2, 10, 1)], SPECS["sale_line_item"].schema)
    news = spark.createDataFrame([(1, 10, 5), (1, 10, 5), (1, 11, 3), (1, 11, 4), (2, 10, 0), (3, 10, 1), (None, 10, 1), (1, 10, 5)],
                                 "sale_id long, product_upc long, new_quantity int")
    decisions = changes.guard_update_items(items, news)[1]
    assert sorted((r.sale_id or 0, r.product_upc, r.new_quantity, r.decision) for r in decisions.collect()) == [
        (0, 10, 1, "NO_SUCH_ROW"), (1, 10, 5, "ACCEPTED"), (1, 11, 3, "CONFLICTING_UPDATE"), (1, 11, 4, "CONFLICTING_UPDATE"),
        (2, 10, 0, "LAST_ITEM_ZERO"), (3, 10, 1, "NO_SUCH_ROW")]
    joins = decisions._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins == 3  # with the items, and the sizes of the receipts asked for
