"""Rule checks on raw columns that break them, and further edges of the referential actions.

The stored domain tables are clean by construction; here source columns are taken as domain
columns as they are, so that each rule has something to find. All rows are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storeline.operators import changes, checks
from storeline.plans import queries as Q
from storeline.plans.workloads import ARCHIVE_BEFORE
from storeline.schemas import SPECS
from storeline.sources.loader import load_validated
from storeline.sources.tables import Tables

LOW_LEVEL = 20  # stock rows below this level are delisted


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir, "documents").select(F.col("doc_id").alias("vendor_id"), F.col("text").alias("vendor_name"))


def accounts_as_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances as prices, and their whole units as product codes: some are negative."""
    return _raw(spark, sf_dir, "customer").select(
        F.floor("c_acctbal").cast("long").alias("product_upc"), F.col("c_name").alias("name"),
        F.col("c_acctbal").cast("decimal(9,2)").alias("price"), F.col("c_nationkey").cast("int").alias("vendor_id"))


def raw_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several documents have, as names that must be unique."""
    return checks.check_unique({"vendor": documents_as_vendors(spark, sf_dir)})


def raw_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, as sales whose member is missing."""
    labels = _raw(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("customer_id"))
    rows = _raw(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return checks.check_not_null({"sale_customer": rows.withColumnRenamed("doc_id", "sale_id")})


def raw_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances that are no price."""
    return checks.check_range({"product": accounts_as_products(spark, sf_dir)})


def raw_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as loyalty levels, order priorities as payment methods."""
    customer = _raw(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("loyalty_status"))
    sale = _raw(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("sale_id"), F.col("o_orderpriority").alias("payment_method"))
    return checks.check_domain({"customer": customer, "sale": sale})


def raw_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as vendor names, negative numbers as product codes."""
    return checks.check_width({"vendor": documents_as_vendors(spark, sf_dir),
                               "product": accounts_as_products(spark, sf_dir)})


def load_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers loaded without a loyalty level: all get the declared default."""
    raw = _raw(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("email"))
    return load_validated(raw, "customer")[0]


def archived_members(t: Tables) -> DataFrame:
    """Old sales deleted; the member links of the others stay."""
    old = t.sale.filter(F.col("date_time") < F.lit(ARCHIVE_BEFORE).cast("timestamp_ntz"))
    return changes.cascade_delete({n: t[n] for n in SPECS}, "sale", old.select("sale_id"))[0]["sale_customer"]


def delisted_orders(t: Tables) -> DataFrame:
    """Stock rows of a low level deleted; replenishment orders go by cascade."""
    low = t.stock.filter(F.col("inventory_level") < LOW_LEVEL).select("product_upc", "store_id")
    return changes.cascade_delete({n: t[n] for n in SPECS}, "stock", low)[0]["order_list"]


def delete_decisions(t: Tables, table: str, key: str) -> DataFrame:
    """Try to delete every row of ``table``: those still referenced are blocked."""
    allowed, blocked = changes.restrict_delete({n: t[n] for n in SPECS}, table, t[table].select(key))
    return (allowed.select(key, F.lit(None).cast("string").alias("blocked_by"))
            .unionByName(blocked.select(key, "blocked_by")))


def restored_sales(t: Tables) -> DataFrame:
    """Store ids shift by 100 where only sales refer to them; the sales follow."""
    mapping = t.store.select(F.col("store_id").alias("old_id"), (F.col("store_id") + 100).alias("new_id"))
    sale = changes.cascade_update({"store": t.store, "sale": t.sale}, "store", mapping)[0]["sale"]
    return sale.select(*SPECS["sale"].schema.names)


def conflicting_renumbering(t: Tables) -> DataFrame:
    """Pairs of customers are to get one new id: refused, but for a customer that has one alone."""
    mapping = t.customer.select(F.col("customer_id").alias("old_id"), F.expr("-(customer_id div 2)").alias("new_id"))
    return changes.cascade_update({n: t[n] for n in SPECS}, "customer", mapping)[1]


# Collation: the same checks and the search on texts that differ in case and accents only.

def _accented(name):
    """The name in capitals where the part's size is even, with é for e where it is divisible by 3."""
    name = F.when(F.col("p_size") % 2 == 0, F.upper(name)).otherwise(name)
    return F.when(F.col("p_size") % 3 == 0, F.translate(name, "eE", "éÉ")).otherwise(name)


def collated_unique(spark, sf_dir: str) -> DataFrame:
    """Part names as vendor names: equal but for case and accents is equal."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return checks.check_unique({"vendor": part.select(F.col("p_partkey").alias("vendor_id"),
                                                      _accented(F.col("p_name")).alias("vendor_name"))})


def collated_domain(spark, sf_dir: str) -> DataFrame:
    """Statuses written in small letters or with an accent are in the domain, other words are not."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    seg = F.col("c_mktsegment")
    status = (F.when(seg == "AUTOMOBILE", "vip").when(seg == "BUILDING", "Góld").when(seg == "FURNITURE", "silver")
              .otherwise(F.lower(seg)))
    return checks.check_domain({"customer": c.select(F.col("c_custkey").alias("customer_id"), status.alias("loyalty_status"))})


def product_availability_accent(t, spark, sf_dir: str, key: str) -> DataFrame:
    """Q1 on names with accents, for a key with another accent and a wildcard."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("product_upc"),
                                                              _accented(F.col("p_name")).alias("accented"))
    product = t.product.join(part, "product_upc").withColumn("name", F.col("accented")).drop("accented")
    return Q.product_availability(t.replace(product=product), key, accent_insensitive=True)
