"""Integrity checks and the validated loader."""

import datetime as dt
import os
import shutil
from decimal import Decimal as D

import pytest

from storeline.operators import checks
from storeline.schemas import SPECS
from storeline.sources.loader import load_positional, load_validated
from tests.fixtures import chain


@pytest.fixture(scope="module")
def t(spark):
    return chain(spark)


def triples(df):
    return sorted((r.table_name, r.rule, r.key) for r in df.collect())


def test_clean_chain_has_no_violations(t):
    v = checks.check_all(dict(t))
    assert v.count() == 0


def test_primary_key_duplicates_and_nulls(spark, t):
    items = t.sale_line_item.unionByName(spark.createDataFrame(
        [(1, 1001, 1), (1, 1001, 2), (None, 1002, 1)], SPECS["sale_line_item"].schema))
    got = triples(checks.check_primary_key({"sale_line_item": items}))
    assert got == [("sale_line_item", "PRIMARY_KEY_DUPLICATE", "1|1001"),
                   ("sale_line_item", "PRIMARY_KEY_NULL", "NULL|1002")]
    dup = checks.check_primary_key({"sale_line_item": items}).filter("rule = 'PRIMARY_KEY_DUPLICATE'")
    assert dup.first().detail == "rows=3"


def test_unique_ignores_nulls(spark, t):
    cust = t.customer.unionByName(spark.createDataFrame(
        [(6, "Dup", None, "kim@example.com", "VIP"), (7, "NoMail", None, None, "NONE")],
        SPECS["customer"].schema))
    got = triples(checks.check_unique({"customer": cust}))
    assert got == [("customer", "UNIQUE", "kim@example.com")]


def test_not_null_range_domain_width(spark, t):
    bad_products = spark.createDataFrame(
        [(2001, None, None, None, None, D("-1.00"), 1),
         (2002, "x" * 81, None, None, None, D("1.00"), None)], SPECS["product"].schema)
    stores = spark.createDataFrame([(9, "Nine", None, "KIOSK", 0, 90000)], SPECS["store"].schema)
    frames = {"product": bad_products, "store": stores}
    assert triples(checks.check_not_null(frames)) == [
        ("product", "NOT_NULL", "2001"), ("product", "NOT_NULL", "2002")]
    assert triples(checks.check_range(frames)) == [
        ("product", "CHECK", "2001"), ("store", "CHECK", "9")]
    assert triples(checks.check_domain(frames)) == [("store", "DOMAIN", "9")]
    assert triples(checks.check_width(frames)) == [("product", "WIDTH", "2002")]


def test_foreign_keys_including_composite(spark, t):
    orders = t.order_list.unionByName(spark.createDataFrame(
        [(3, 1005, 1, dt.datetime(2025, 6, 1), 4)], SPECS["order_list"].schema))
    items = t.sale_line_item.unionByName(spark.createDataFrame(
        [(99, 1001, 1), (1, 9999, 1)], SPECS["sale_line_item"].schema))
    frames = dict(t)
    frames.update(order_list=orders, sale_line_item=items)
    got = triples(checks.check_foreign_key(frames))
    # (1005, store 1) has no stock row; sale 99 and product 9999 do not exist
    assert got == [("order_list", "FOREIGN_KEY", "3|1005|1"),
                   ("sale_line_item", "FOREIGN_KEY", "1|9999"),
                   ("sale_line_item", "FOREIGN_KEY", "99|1001")]


def test_sale_without_items(spark, t):
    sale = t.sale.unionByName(spark.createDataFrame(
        [(50, dt.datetime(2025, 6, 1), "CARD", 1)], SPECS["sale"].schema))
    got = triples(checks.check_sale_has_items({"sale": sale, "sale_line_item": t.sale_line_item}))
    assert got == [("sale", "TOTAL_PARTICIPATION", "50")]


def test_load_validated_refuses_each_broken_rule(spark, t):
    raw = spark.createDataFrame(
        [("3001", "Ok Item", "2.00", "1"),
         ("3002", "Bad Price", "-2.00", "1"),
         ("3003", "Bad Type", "abc", "1"),
         ("3004", "No Vendor", "1.00", "77"),
         ("3005", "y" * 81, "1.00", "1"),
         ("3006", None, "1.00", "1"),
         ("3007", "Dup A", "1.00", "1"),
         ("3007", "Dup B", "1.00", "1")],
        "product_upc string, name string, price string, vendor_id string")
    valid, bad = load_validated(raw, "product", parents={"vendor": t.vendor})
    assert [tuple(r) for r in valid.collect()] == [(3001, "Ok Item", None, None, None, D("2.00"), 1)]
    got = sorted((r.key, r.rule, r.detail) for r in bad.collect())
    assert got == [("3002", "CHECK", "price"),
                   ("3003", "NOT_NULL", "price"),
                   ("3003", "TYPE", "price"),
                   ("3004", "FOREIGN_KEY", "vendor_id->vendor"),
                   ("3005", "WIDTH", "name"),
                   ("3006", "NOT_NULL", "name"),
                   ("3007", "PRIMARY_KEY_DUPLICATE", ""),
                   ("3007", "PRIMARY_KEY_DUPLICATE", "")]


def test_load_default_only_for_omitted_column(spark):
    omitted = spark.createDataFrame([(1, "A")], "customer_id int, name string")
    valid, bad = load_validated(omitted, "customer")
    assert valid.first().loyalty_status == "NONE" and bad.count() == 0
    explicit = spark.createDataFrame([(1, "A", None)], "customer_id int, name string, loyalty_status string")
    valid, _ = load_validated(explicit, "customer")
    assert valid.first().loyalty_status is None


def test_load_atomic_refuses_all(spark, t):
    raw = spark.createDataFrame([(1, 1001, 2), (2, 1001, 0)], "sale_id long, product_upc long, quantity int")
    valid, bad = load_validated(raw, "sale_line_item", atomic=True)
    assert valid.count() == 0 and bad.count() == 1
    valid, _ = load_validated(raw, "sale_line_item", atomic=False)
    assert valid.count() == 1


def test_load_positional(spark, t):
    raw = spark.createDataFrame([(7, 1001, 2, dt.datetime(2025, 6, 1), 3)],
                                "a long, b long, c int, d timestamp_ntz, e int")
    valid, bad = load_positional(raw, "order_list", parents={"stock": t.stock})
    assert bad.count() == 0
    assert valid.columns == SPECS["order_list"].columns
    assert tuple(valid.first()) == (7, 1001, 2, dt.datetime(2025, 6, 1), 3)
    with pytest.raises(ValueError):
        load_positional(raw.select("a", "b"), "order_list")


def test_store_times_as_text_including_24_00(spark):
    from storeline.plans.queries import store_always_open
    from storeline.sources.tables import Tables

    raw = spark.createDataFrame(
        [(1, "A", "FRANCHISE", "00:00", "00:00"), (2, "B", "CORPORATE", "06:00", "24:00"),
         (3, "C", "CORPORATE", "07:00", "02:00"), (4, "D", "FRANCHISE", "25:00", "02:00"),
         (5, "E", "FRANCHISE", None, None)],
        "store_id int, name string, ownership_type string, open_time string, close_time string")
    valid, bad = load_validated(raw, "store")
    assert sorted((r.store_id, r.open_s, r.close_s) for r in valid.collect()) == [
        (1, 0, 0), (2, 21600, 86400), (3, 25200, 7200), (5, None, None)]
    assert [(r.key, r.rule, r.detail) for r in bad.collect()] == [("4", "TYPE", "open_time")]
    flags = {r.store_id: r.always_open for r in store_always_open(Tables({"store": valid})).collect()}
    assert flags == {1: True, 2: False, 3: False, 5: None}


def test_checks_find_nothing_after_a_validated_load(spark, t):
    raw = spark.createDataFrame(
        [(1, 1001, 2), (1, 1001, 3), (2, 1004, -1), (99, 1001, 1), (3, 9999, 1), (5, 1007, 4)],
        "sale_id long, product_upc long, quantity int")
    valid, bad = load_validated(raw, "sale_line_item",
                                parents={"sale": t.sale, "product": t.product})
    assert [tuple(r) for r in valid.collect()] == [(5, 1007, 4)]
    assert bad.count() == 5
    frames = dict(t)
    frames["sale_line_item"] = t.sale_line_item.unionByName(valid)
    assert checks.check_all(frames).count() == 0


def test_load_csv_file(spark, tmp_path):
    from storeline.sources.loader import load_file

    p = tmp_path / "stores.csv"
    p.write_text("store_id,name,address,ownership_type,open_time,close_time\n"
                 "101,Gangnam,Seoul 1,FRANCHISE,00:00,00:00\n"
                 "103,Jamsil,Seoul 3,FRANCHISE,06:00,24:00\n"
                 "x7,Broken,Nowhere,CORPORATE,07:00,02:00\n"
                 "104,Jongno,Seoul 4,KIOSK,00:00,00:00\n")
    valid, bad = load_file(spark, str(p), "store")
    assert sorted((r.store_id, r.open_s, r.close_s) for r in valid.collect()) == [
        (101, 0, 0), (103, 21600, 86400)]
    assert sorted((r.rule, r.detail) for r in bad.collect()) == [
        ("DOMAIN", "ownership_type"), ("PRIMARY_KEY_NULL", "store_id"), ("TYPE", "store_id")]


def test_precision_and_unsigned(spark):
    # an unvalidated frame with a wider price type and a negative UPC
    raw = spark.createDataFrame(
        [(-5, "Neg", None, None, None, D("1.00"), 1),
         (7, "Big", None, None, None, D("12345678901.00"), 1),
         (8, "Ok", None, None, None, D("3.50"), 1)],
        "product_upc long, name string, brand string, size string, package_type string, "
        "price decimal(14,2), vendor_id int")
    got = sorted((r.rule, r.key, r.detail) for r in checks.check_width({"product": raw}).collect())
    assert got == [("PRECISION", "7", "price decimal(9,2)"), ("UNSIGNED", "-5", "product_upc")]


def test_row_checks_treat_absent_columns_as_null(spark):
    partial = spark.createDataFrame([(-1, "x" * 90)], "product_upc long, name string")
    got = sorted((r.rule, r.key) for r in checks.check_width({"product": partial}).collect())
    assert got == [("UNSIGNED", "-1"), ("WIDTH", "-1")]
    assert checks.check_range({"product": partial}).count() == 0
    # price and vendor_id are NOT NULL and absent: NULL in every row
    got = sorted((r.rule, r.detail) for r in checks.check_not_null({"product": partial}).collect())
    assert got == [("NOT_NULL", "price"), ("NOT_NULL", "vendor_id")]


def test_checks_ask_only_for_the_tables_that_their_rules_name(spark, tmp_path):
    from storeline.plans import workloads as W
    from storeline.sources import driver
    shutil.copytree("/root/testdata/sf0.001", tmp_path / "sf")
    sf = str(tmp_path / "sf")
    t = driver.stored_driver_tables(spark, sf)
    assert W.run_check(t, driver.raw_line_items(spark, sf), "check_domain").count() == 0
    assert set(t._cache) - {W.RAW_ITEMS} <= {"store", "customer", "sale"}
    (root, _, written), = [v for k, v in driver._STORED.items() if k[1] == sf]
    assert written == {"store", "customer", "sale"} == set(os.listdir(root.removeprefix("file:")))
