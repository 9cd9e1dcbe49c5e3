"""Insert of line items and row-by-row changes against plain loops."""

import random

import pytest

from storeline.operators.changes import replay_item_changes
from storeline.operators.inserts import insert_line_items

STOCK = "product_upc long, store_id int, inventory_level int, reorder_threshold int, reorder_quantity int"
SALE = "sale_id long, store_id int"
ITEM = "sale_id long, product_upc long, quantity int"
BATCH = ITEM + ", seq long"


def loop_insert(stored, levels, store_of, batch, known=None):
    left, have, out = dict(levels), {(s, p) for s, p, _ in stored}, {}
    for sid, upc, q, seq in sorted(batch, key=lambda r: r[3]):
        k = (upc, store_of.get(sid))
        if k not in left:
            out[seq] = "NO_STOCK_ROW"
        elif q is None:
            out[seq] = "NOT_NULL"
        elif left[k] < q:
            out[seq] = "SHORT"
        elif q <= 0:
            out[seq] = "CHECK_QUANTITY"
        elif (sid, upc) in have:
            out[seq] = "DUPLICATE_KEY"
        elif known is not None and upc not in known:
            out[seq] = "FOREIGN_KEY"
        else:
            out[seq] = "OK"
            left[k] -= q
            have.add((sid, upc))
    return out, left, have


def run(spark, stored, stock, sale, batch, known=None, **settings):
    product = spark.createDataFrame([(u,) for u in known], "product_upc long") if known is not None else None
    items, new_stock, dec = insert_line_items(
        spark.createDataFrame(stored, ITEM), spark.createDataFrame(stock, STOCK), spark.createDataFrame(sale, SALE),
        spark.createDataFrame(batch, BATCH), order_by=["seq"], product=product, **settings)
    rows = items.collect()
    assert len(rows) == len({(r.sale_id, r.product_upc) for r in rows})
    return ({r.seq: r.decision for r in dec.collect()},
            {(r.product_upc, r.store_id): r.inventory_level for r in new_stock.collect()},
            {(r.sale_id, r.product_upc) for r in rows})


def test_repeated_key_takes_nothing(spark):
    stock, sale = [(1, 10, 10, 0, 1)], [(100, 10), (101, 10)]
    batch = [(100, 1, 6, 1), (100, 1, 2, 2), (101, 1, 4, 3)]
    d, s, have = run(spark, [], stock, sale, batch)
    assert d == {1: "OK", 2: "DUPLICATE_KEY", 3: "OK"} and s == {(1, 10): 0} and have == {(100, 1), (101, 1)}
    d, s, have = run(spark, [], stock, sale, batch, atomic=True)
    assert d == {1: "ROLLED_BACK", 2: "DUPLICATE_KEY", 3: "ROLLED_BACK"} and s == {(1, 10): 10} and have == set()


def test_reasons_in_the_order_of_the_trigger_and_the_rules(spark):
    stock, sale = [(1, 10, 5, 0, 1), (2, 10, 3, 0, 1), (9, 10, 4, 0, 1)], [(100, 10), (101, 10)]
    stored = [(100, 2, 1)]
    batch = [(100, 1, None, 1), (100, 1, 0, 2), (100, 1, 6, 3), (100, 1, 5, 4), (100, 1, 1, 5), (100, 2, 1, 6),
             (100, 2, 4, 7), (777, 1, 1, 8), (100, 3, 1, 9), (101, 9, 1, 10), (None, 1, 1, 11)]
    want = loop_insert(stored, {(1, 10): 5, (2, 10): 3, (9, 10): 4}, dict(sale), batch, {1, 2, 3})
    got = run(spark, stored, stock, sale, batch, known=[1, 2, 3])
    assert got == want
    assert got[0] == {1: "NOT_NULL", 2: "CHECK_QUANTITY", 3: "SHORT", 4: "OK", 5: "SHORT", 6: "DUPLICATE_KEY", 7: "SHORT",
                      8: "NO_STOCK_ROW", 9: "NO_STOCK_ROW", 10: "FOREIGN_KEY", 11: "NO_STOCK_ROW"}


def test_a_smaller_repeat_is_taken_when_the_first_did_not_fit(spark):
    # receipt 2's first line doesn't fit, its second does, and changes what is left for receipt 3
    stock, sale = [(1, 10, 10, 0, 1)], [(i, 10) for i in range(1, 6)]
    batch = [(1, 1, 6, 1), (2, 1, 7, 2), (2, 1, 3, 3), (3, 1, 2, 4), (3, 1, 1, 5), (4, 1, 1, 6)]
    want = loop_insert([], {(1, 10): 10}, dict(sale), batch)
    assert want[0] == {1: "OK", 2: "SHORT", 3: "OK", 4: "SHORT", 5: "OK", 6: "SHORT"}
    for settings in ({}, {"key_rows": 0, "segments": 3}, {"key_rows": 0, "segments": 3, "max_broadcast": 0}):
        assert run(spark, [], stock, sale, batch, **settings) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches_with_repeats_match_the_loop(spark, seed):
    rnd = random.Random(seed)
    stock = [(u, 10 + u % 2, rnd.randint(0, 60), 0, 1) for u in range(1, 9)]
    sale = [(i, rnd.choice([10, 11])) for i in range(120)]
    stored = [(i, u, 1) for i in range(0, 120, 9) for u in (1, 2)]
    # receipts come again and again with other quantities, half of the lines for one product
    batch = [(rnd.randint(0, 130), 1 if rnd.random() < .5 else rnd.randint(1, 10),
              rnd.choice([None, 0, -2]) if rnd.random() < .03 else rnd.randint(1, 12), seq) for seq in range(900)]
    rnd.shuffle(batch)
    levels = {(u, st): lv for u, st, lv, _, _ in stock}
    want = loop_insert(stored, levels, dict(sale), batch)
    for settings in ({"key_rows": 5, "segments": 6}, {"key_rows": 10_000}):
        assert run(spark, stored, stock, sale, batch, **settings) == want


def test_empty_batch(spark):
    assert run(spark, [(1, 1, 1)], [(1, 10, 5, 0, 1)], [(1, 10)], []) == ({}, {(1, 10): 5}, {(1, 1)})


# row-by-row guards ---------------------------------------------------------

LOG = "sale_id long, product_upc long, new_quantity int, delete boolean, seq long"


def loop_replay(items, log):
    have, out = {(s, p): q for s, p, q in items}, {}
    for sid, upc, q, delete, seq in sorted(log, key=lambda r: r[4]):
        n = sum(1 for s, _ in have if s == sid)
        if (sid, upc) not in have:
            out[seq] = "NO_SUCH_ROW"
        elif delete:
            out[seq] = "LAST_ITEM" if n == 1 else "ACCEPTED"
            if n > 1:
                del have[sid, upc]
        elif q is None:
            out[seq] = "NOT_NULL"
        elif q <= 0:
            out[seq] = "LAST_ITEM_ZERO" if n == 1 else "CHECK_QUANTITY"
        else:
            out[seq] = "ACCEPTED"
            have[sid, upc] = q
    return out, have


def replay(spark, items, log):
    new, dec = replay_item_changes(spark.createDataFrame(items, ITEM), spark.createDataFrame(log, LOG), ["seq"])
    return {r.seq: r.decision for r in dec.collect()}, {(r.sale_id, r.product_upc): r.quantity for r in new.collect()}


def test_delete_then_zero_on_a_receipt_of_two(spark):
    items = [(1, 1, 2), (1, 2, 3)]
    log = [(1, 2, 0, False, 1), (1, 1, None, True, 2), (1, 2, 0, False, 3), (1, 2, None, True, 4), (1, 1, None, True, 5),
           (1, 2, 7, False, 6)]
    got = replay(spark, items, log)
    assert got == loop_replay(items, log)
    assert got == ({1: "CHECK_QUANTITY", 2: "ACCEPTED", 3: "LAST_ITEM_ZERO", 4: "LAST_ITEM", 5: "NO_SUCH_ROW",
                    6: "ACCEPTED"}, {(1, 2): 7})


def test_deleting_a_whole_receipt_leaves_its_last_item(spark):
    items = [(1, p, 1) for p in range(5)] + [(2, 1, 1)]
    log = [(1, p, None, True, p) for p in range(5)] + [(2, 1, None, True, 9)]
    d, have = replay(spark, items, log)
    assert [d[i] for i in range(5)] == ["ACCEPTED"] * 4 + ["LAST_ITEM"] and d[9] == "LAST_ITEM"
    assert have == {(1, 4): 1, (2, 1): 1}


def test_random_logs_match_the_loop(spark):
    rnd = random.Random(3)
    items = [(s, p, rnd.randint(1, 5)) for s in range(40) for p in range(rnd.randint(1, 5))]
    log = [(rnd.randint(0, 42), rnd.randint(0, 5), rnd.choice([None, -1, 0, 0, 3, 4]), rnd.random() < .5, i) for i in range(600)]
    rnd.shuffle(log)
    assert replay(spark, items, log) == loop_replay(items, log)
