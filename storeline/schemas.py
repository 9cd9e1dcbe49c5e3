"""The nine domain tables as data: schema, keys and every declared rule.

One ``TableSpec`` per table. The integrity checks (``operators.checks``)
and the validated loader (``sources.loader.load_validated``) read these
specs; nothing else hard-codes a rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "RESTRICT"   # RESTRICT | CASCADE
    on_update: str = "RESTRICT"   # RESTRICT | CASCADE


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    # column -> SQL predicate that must not be FALSE (NULL passes, as a CHECK)
    ranges: dict[str, str] = field(default_factory=dict)
    # column -> allowed values (ENUM)
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    # column -> max characters (VARCHAR(n))
    widths: dict[str, int] = field(default_factory=dict)
    # column -> (precision, scale) (DECIMAL(p,s))
    decimals: dict[str, tuple[int, int]] = field(default_factory=dict)
    # columns declared unsigned
    unsigned: tuple[str, ...] = ()
    # column -> default used when the column is omitted on load
    defaults: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [f.name for f in self.schema.fields]


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


INT, LONG, STR = T.IntegerType(), T.LongType(), T.StringType()
TS = T.TimestampNTZType()
PRICE = T.DecimalType(9, 2)

# The ENUM domains of the original schema.
OWNERSHIP_TYPES = ("FRANCHISE", "CORPORATE")
LOYALTY_STATUSES = ("NONE", "SILVER", "GOLD", "VIP")
PAYMENT_METHODS = ("CASH", "CARD", "ETC")
# Loyalty levels that count as members in the bundle query.
MEMBER_LEVELS = ("VIP", "GOLD", "SILVER")
SECONDS_PER_DAY = 86400

VENDOR = TableSpec(
    "vendor",
    _s(("vendor_id", INT), ("vendor_name", STR), ("phone", STR), ("address", STR)),
    primary_key=("vendor_id",),
    not_null=("vendor_name",),
    unique=("vendor_name",),
    widths={"vendor_name": 60, "phone": 20, "address": 120},
)

PRODUCT = TableSpec(
    "product",
    _s(("product_upc", LONG), ("name", STR), ("brand", STR), ("size", STR),
       ("package_type", STR), ("price", PRICE), ("vendor_id", INT)),
    primary_key=("product_upc",),
    not_null=("name", "price", "vendor_id"),
    foreign_keys=(ForeignKey(("vendor_id",), "vendor", ("vendor_id",)),),
    ranges={"price": "price > 0"},
    widths={"name": 80, "brand": 40, "size": 30, "package_type": 30},
    decimals={"price": (9, 2)},
    unsigned=("product_upc",),
)

STORE = TableSpec(
    "store",
    _s(("store_id", INT), ("name", STR), ("address", STR), ("ownership_type", STR),
       ("open_s", INT), ("close_s", INT)),
    primary_key=("store_id",),
    not_null=("name", "ownership_type"),
    unique=("name",),
    ranges={"open_s": f"open_s BETWEEN 0 AND {SECONDS_PER_DAY}",
            "close_s": f"close_s BETWEEN 0 AND {SECONDS_PER_DAY}"},
    domains={"ownership_type": OWNERSHIP_TYPES},
    widths={"name": 60, "address": 120},
)

CUSTOMER = TableSpec(
    "customer",
    _s(("customer_id", INT), ("name", STR), ("phone", STR), ("email", STR),
       ("loyalty_status", STR)),
    primary_key=("customer_id",),
    unique=("email",),
    domains={"loyalty_status": LOYALTY_STATUSES},
    widths={"name": 60, "phone": 20, "email": 80},
    defaults={"loyalty_status": "NONE"},
)

SALE = TableSpec(
    "sale",
    _s(("sale_id", LONG), ("date_time", TS), ("payment_method", STR), ("store_id", INT)),
    primary_key=("sale_id",),
    not_null=("date_time", "payment_method", "store_id"),
    foreign_keys=(ForeignKey(("store_id",), "store", ("store_id",),
                             on_delete="RESTRICT", on_update="CASCADE"),),
    domains={"payment_method": PAYMENT_METHODS},
)

SALE_CUSTOMER = TableSpec(
    "sale_customer",
    _s(("sale_id", LONG), ("customer_id", INT)),
    primary_key=("sale_id",),
    not_null=("customer_id",),
    foreign_keys=(
        ForeignKey(("sale_id",), "sale", ("sale_id",), on_delete="CASCADE"),
        ForeignKey(("customer_id",), "customer", ("customer_id",),
                   on_delete="RESTRICT", on_update="CASCADE"),
    ),
)

STOCK = TableSpec(
    "stock",
    _s(("product_upc", LONG), ("store_id", INT), ("inventory_level", INT),
       ("reorder_threshold", INT), ("reorder_quantity", INT)),
    primary_key=("product_upc", "store_id"),
    not_null=("inventory_level",),
    foreign_keys=(
        ForeignKey(("product_upc",), "product", ("product_upc",)),
        ForeignKey(("store_id",), "store", ("store_id",)),
    ),
    ranges={"inventory_level": "inventory_level >= 0",
            "reorder_threshold": "reorder_threshold >= 0",
            "reorder_quantity": "reorder_quantity > 0"},
    unsigned=("product_upc",),
)

ORDER_LIST = TableSpec(
    "order_list",
    _s(("order_id", LONG), ("product_upc", LONG), ("store_id", INT),
       ("order_datetime", TS), ("order_quantity", INT)),
    primary_key=("order_id", "product_upc", "store_id"),
    not_null=("order_datetime", "order_quantity"),
    foreign_keys=(ForeignKey(("product_upc", "store_id"), "stock",
                             ("product_upc", "store_id"), on_delete="CASCADE"),),
    ranges={"order_quantity": "order_quantity > 0"},
    unsigned=("product_upc",),
)

SALE_LINE_ITEM = TableSpec(
    "sale_line_item",
    _s(("sale_id", LONG), ("product_upc", LONG), ("quantity", INT)),
    primary_key=("sale_id", "product_upc"),
    not_null=("quantity",),
    foreign_keys=(
        ForeignKey(("sale_id",), "sale", ("sale_id",), on_delete="CASCADE"),
        ForeignKey(("product_upc",), "product", ("product_upc",)),
    ),
    ranges={"quantity": "quantity > 0"},
    unsigned=("product_upc",),
)

SPECS: dict[str, TableSpec] = {
    s.name: s for s in (VENDOR, PRODUCT, STORE, CUSTOMER, SALE, SALE_CUSTOMER,
                        STOCK, ORDER_LIST, SALE_LINE_ITEM)
}

# Tables in the order of the start-up row-count summary (sale_customer is
# not part of it).
COUNT_ORDER = ("store", "product", "vendor", "customer", "sale",
               "sale_line_item", "stock", "order_list")

VIOLATION_SCHEMA = _s(("table_name", STR), ("rule", STR), ("key", STR), ("detail", STR))
