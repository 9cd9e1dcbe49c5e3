"""Q1-Q7, counts and flags on the hand-made chain."""

from decimal import Decimal as D

import pytest

from storeline.plans import queries as Q
from tests.fixtures import chain

AS_OF = "2025-06-13"


@pytest.fixture(scope="module")
def t(spark):
    return chain(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_q1_name_match_case_insensitive(t):
    got = sorted(rows(Q.product_availability(t, "cold")))
    assert got == [(1, "Gangnam", 1001, "Cold Brew Latte", 10),
                   (1, "Gangnam", 1002, "Cold Brew Black", 2),
                   (2, "Hongdae", 1001, "Cold Brew Latte", 0),
                   (3, "Jamsil", 1002, "Cold Brew Black", 4)]


def test_q1_brand_match_skips_null_brand(t):
    got = {(r[0], r[2]) for r in rows(Q.product_availability(t, "blue bean"))}
    assert got == {(1, 1001), (2, 1001), (2, 1006)}


def test_q1_upc_key_and_non_numeric(t):
    assert [(r[0], r[2]) for r in rows(Q.product_availability(t, " 1005 "))] == [(3, 1005)]
    assert rows(Q.product_availability(t, "12x")) == []


def test_q1_empty_key_and_wildcards(t):
    assert len(rows(Q.product_availability(t, ""))) == 10
    assert len(rows(Q.product_availability(t, "%"))) == 10
    assert rows(Q.product_availability(t, "%", literal=True)) == []


def test_q1_accent_insensitive(spark, t):
    prod = t.product.unionByName(spark.createDataFrame(
        [(1008, "Café Mocha", None, None, None, D("3.00"), 2)], t.product.schema))
    stock = t.stock.unionByName(spark.createDataFrame([(1008, 3, 2, 1, 1)], t.stock.schema))
    t2 = t.replace(product=prod, stock=stock)
    assert rows(Q.product_availability(t2, "cafe")) == []
    got = rows(Q.product_availability(t2, "cafe", accent_insensitive=True))
    assert got == [(3, "Jamsil", 1008, "Café Mocha", 2)]


def test_q2_best_seller_past_month_tie_goes_to_smaller_upc(t):
    got = rows(Q.top_selling_past_month(t, as_of=AS_OF))
    assert got == [(1, "Gangnam", 1003, "Choco Pie", "12.60"),
                   (2, "Hongdae", 1004, "Potato Chips", "3.60"),
                   (3, "Jamsil", 1005, "Water 500ml", "3.00")]


def test_q2_top_n_per_store(t):
    got = rows(Q.top_selling_past_month(t, as_of=AS_OF, n=2))
    assert got == [(1, "Gangnam", 1003, "Choco Pie", "12.60", 1),
                   (1, "Gangnam", 1004, "Potato Chips", "10.80", 2),
                   (2, "Hongdae", 1004, "Potato Chips", "3.60", 1),
                   (2, "Hongdae", 1006, "Americano", "3.60", 2),
                   (3, "Jamsil", 1005, "Water 500ml", "3.00", 1),
                   (3, "Jamsil", 1002, "Cold Brew Black", "2.00", 2)]


def test_q2_month_window_bound_is_midnight(t):
    # 2025-07-20 minus one month -> 2025-06-20 00:00: sale 7 (08:00 that day) counts
    got = rows(Q.top_selling_past_month(t, as_of="2025-07-20"))
    assert got == [(1, "Gangnam", 1001, "Cold Brew Latte", "2.50")]
    # 2025-07-31 minus one month is clamped to 2025-06-30: nothing left
    assert rows(Q.top_selling_past_month(t, as_of="2025-07-31")) == []


def test_q3_best_store_and_other_quarter(t):
    assert rows(Q.best_store_this_quarter(t, as_of=AS_OF)) == [(1, "Gangnam", D("35.40"))]
    assert rows(Q.best_store_this_quarter(t, as_of="2025-03-15")) == [(3, "Jamsil", D("1.00"))]
    assert rows(Q.best_store_this_quarter(t, as_of="2024-06-13")) == []


def test_q3_keeps_ties(spark, t):
    # store 2 has 24.00 in the quarter; a new receipt adds 2 x 4.20 + 3 x 1.00 = 11.40
    sale = t.sale.unionByName(spark.createDataFrame(
        [(8, t.sale.filter("sale_id = 3").first().date_time, "CARD", 2)], t.sale.schema))
    items = t.sale_line_item.unionByName(spark.createDataFrame(
        [(8, 1003, 2), (8, 1005, 3)], t.sale_line_item.schema))
    t2 = t.replace(sale=sale, sale_line_item=items)
    got = sorted(rows(Q.best_store_this_quarter(t2, as_of=AS_OF)))
    assert got == [(1, "Gangnam", D("35.40")), (2, "Hongdae", D("35.40"))]


def test_q4_vendor_stats(t):
    got = rows(Q.vendor_stats(t))
    assert got == [(2, "Blue Bean", 4, 8), (1, "Acme Foods", 3, 19), (3, "Empty Vendor", 0, 0)]


def test_q4_q7_distinct_counts_on_duplicate_keys(spark, t):
    # an unvalidated duplicate stock row / product row: only distinct=True ignores it
    stock = t.stock.unionByName(spark.createDataFrame([(1001, 3, 1, 0, 1), (1001, 3, 1, 0, 1)],
                                                      t.stock.schema))
    t2 = t.replace(stock=stock)
    got = dict(((r.ownership_type, r.store_id), r.kinds)
               for r in Q.variety_by_ownership(t2, distinct=True).collect())
    assert got == {("CORPORATE", 2): 4, ("FRANCHISE", 1): 4}
    # the keyed count sees the duplicate twice: store 3 reaches 4 and ties store 1
    keyed = dict(((r.ownership_type, r.store_id), r.kinds)
                 for r in Q.variety_by_ownership(t2).collect())
    assert keyed == {("CORPORATE", 2): 4, ("FRANCHISE", 1): 4, ("FRANCHISE", 3): 4}
    prod = t.product.unionByName(t.product.filter("product_upc = 1007"))
    got = {r.vendor_id: r.product_types for r in Q.vendor_stats(t.replace(product=prod),
                                                                 distinct=True).collect()}
    assert got[2] == 4


def test_q5_reorder_alert(t):
    got = rows(Q.reorder_alert(t))
    assert got == [(1, "Gangnam", "Cold Brew Black", 2, 3),
                   (2, "Hongdae", "Cold Brew Latte", 0, 1)]


def test_q6_bag_semantics_count_receipt_per_match(t):
    got = rows(Q.loyalty_bundle(t, "cold brew"))
    assert got == [("Choco Pie", 6), ("Water 500ml", 3), ("Potato Chips", 1)]


def test_q6_set_semantics_and_tie_break(t):
    got = rows(Q.loyalty_bundle(t, "cold brew", dedupe=True))
    assert got == [("Choco Pie", 3), ("Water 500ml", 3), ("Potato Chips", 1)]


def test_q6_empty_keyword_and_no_match(t):
    assert rows(Q.loyalty_bundle(t, "")) == []
    assert rows(Q.loyalty_bundle(t, "blue bean")) == []   # brand, not name


def test_q7_variety_by_ownership(t):
    got = sorted(rows(Q.variety_by_ownership(t)))
    assert got == [("CORPORATE", 2, 4), ("FRANCHISE", 1, 4)]


def test_table_counts_order(t):
    got = rows(Q.table_counts(t))
    assert got == [("store", 4), ("product", 7), ("vendor", 3), ("customer", 5), ("sale", 7),
                   ("sale_line_item", 13), ("stock", 10), ("order_list", 2)]


def test_member_flag_and_always_open(t):
    non = sorted(r.sale_id for r in Q.sale_member_flag(t).collect() if not r.is_member)
    assert non == [4, 6]
    flags = {r.store_id: r.always_open for r in Q.store_always_open(t).collect()}
    assert flags == {1: True, 2: False, 3: False, 4: None}


def test_sql_over_registered_views(spark, t):
    t.register_views(prefix="chain_")
    got = spark.sql("""
        SELECT st.store_id, st.name AS store, p.name AS product,
               sk.inventory_level, sk.reorder_threshold
        FROM chain_stock sk
        JOIN chain_store st ON st.store_id = sk.store_id
        JOIN chain_product p ON p.product_upc = sk.product_upc
        WHERE sk.inventory_level < sk.reorder_threshold
        ORDER BY st.store_id""").collect()
    assert [tuple(r) for r in got] == rows(Q.reorder_alert(t))


def test_command_line(spark, t, tmp_path, capsys):
    from storeline.__main__ import main
    from storeline.sources.tables import write_tables

    write_tables(t, str(tmp_path / "chain"), files_per_table=1)
    assert main(["--tables", str(tmp_path / "chain"), "q5"], spark=spark) == 0
    out = capsys.readouterr().out
    assert "Cold Brew Black" in out and "Cold Brew Latte" in out
    main(["--tables", str(tmp_path / "chain"), "q2", "--as-of", "2025-06-13"], spark=spark)
    assert "12.60" in capsys.readouterr().out
