"""A small hand-made chain: every edge case the queries and rules care about.

Expected values in the tests are worked out by hand from these rows.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from storeline.schemas import SPECS
from storeline.sources.tables import Tables


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


VENDOR = [
    (1, "Acme Foods", "02-100-1000", "Seoul 1"),
    (2, "Blue Bean", None, None),
    (3, "Empty Vendor", None, None),          # supplies nothing
]

PRODUCT = [
    (1001, "Cold Brew Latte", "Blue Bean", "300ml", "CAN", D("2.50"), 2),
    (1002, "Cold Brew Black", None, "300ml", "CAN", D("2.00"), 2),   # NULL brand
    (1003, "Choco Pie", "Acme", "12ea", "BOX", D("4.20"), 1),
    (1004, "Potato Chips", "Acme", "66g", "BAG", D("1.80"), 1),
    (1005, "Water 500ml", "Acme", "500ml", "PET", D("1.00"), 1),
    (1006, "Americano", "Blue Bean", "250ml", "CUP", D("1.80"), 2),  # ties 1004 in store 2
    (1007, "Green Tea", "Blue Bean", "500ml", "PET", D("1.50"), 2),  # never sold
]

STORE = [
    (1, "Gangnam", "Seoul A", "FRANCHISE", 0, 0),              # 24 hours
    (2, "Hongdae", "Seoul B", "CORPORATE", 7 * 3600, 2 * 3600),
    (3, "Jamsil", "Seoul C", "FRANCHISE", 6 * 3600, 86400),    # closes 24:00
    (4, "Jongno", None, "CORPORATE", None, None),              # no stock, no sales
]

CUSTOMER = [
    (1, "Kim", "010-1", "kim@example.com", "VIP"),
    (2, "Lee", "010-2", "lee@example.com", "GOLD"),
    (3, "Park", None, "park@example.com", "NONE"),
    (4, "Choi", None, None, "SILVER"),
    (5, None, None, None, "NONE"),
]

SALE = [
    (1, ts("2025-06-01 10:00"), "CARD", 1),
    (2, ts("2025-06-02 11:00"), "CASH", 1),
    (3, ts("2025-06-03 12:00"), "CARD", 2),
    (4, ts("2025-05-01 09:00"), "ETC", 2),     # in the quarter, before the month window
    (5, ts("2025-06-10 09:00"), "CARD", 3),
    (6, ts("2025-03-30 09:00"), "CARD", 3),    # previous quarter
    (7, ts("2025-06-20 08:00"), "CARD", 1),    # after as_of: still counted (lower bound only)
]

SALE_CUSTOMER = [(1, 1), (2, 3), (3, 2), (5, 4), (7, 1)]   # 4 and 6 are non-member sales

SALE_LINE_ITEM = [
    (1, 1001, 2), (1, 1002, 1), (1, 1003, 3),   # two 'cold brew' matches + a third item
    (2, 1001, 1), (2, 1004, 5),                 # non-member (status NONE)
    (3, 1006, 2), (3, 1004, 2),
    (4, 1003, 4),                               # only item of its receipt
    (5, 1002, 1), (5, 1005, 3),
    (6, 1005, 1),
    (7, 1001, 1), (7, 1004, 1),
]

STOCK = [
    (1001, 1, 10, 5, 10),
    (1002, 1, 2, 3, 5),        # below threshold
    (1003, 1, 8, 8, 4),        # equal: no alert
    (1004, 1, 20, None, None), # NULL threshold: never alerts
    (1001, 2, 0, 1, 2),        # level 0, still stocked
    (1004, 2, 9, 2, 5),
    (1006, 2, 5, 1, 1),
    (1003, 2, 7, 0, 1),
    (1002, 3, 4, 2, 2),
    (1005, 3, 6, 2, 2),
]

ORDER_LIST = [
    (1, 1001, 1, ts("2025-05-20 09:00"), 10),
    (2, 1002, 1, ts("2025-06-02 14:30"), 5),
]

ROWS = {
    "vendor": VENDOR, "product": PRODUCT, "store": STORE, "customer": CUSTOMER,
    "sale": SALE, "sale_customer": SALE_CUSTOMER, "sale_line_item": SALE_LINE_ITEM,
    "stock": STOCK, "order_list": ORDER_LIST,
}


def chain(spark) -> Tables:
    return Tables({n: spark.createDataFrame(rows, SPECS[n].schema) for n, rows in ROWS.items()})
