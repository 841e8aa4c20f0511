"""Source tables and the mapping of the retail schema onto them.

``Tables`` is the bundle ``T`` every operator receives.  Raw driver tables are
read with an explicit schema; the retail tables (category, product, app_user,
order_items, sales_orders, discount_rules) are projections of them, so column
pruning and filter pushdown reach the Parquet scan through every operator.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import os
from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.plans.broadcast import BroadcastBoundExceeded, bounded_broadcast
from tillwise.plans.lineage import cut_lineage
from tillwise.sources import seeds

MONEY = T.DecimalType(12, 2)
MAX_CATEGORY_ROWS = 100_000
ORDER_STATUSES = ("completed", "pending", "cancelled")

RAW_SCHEMAS = {
    "part": T.StructType([
        T.StructField("p_partkey", T.LongType()),
        T.StructField("p_name", T.StringType()),
        T.StructField("p_brand", T.StringType()),
        T.StructField("p_type", T.StringType()),
        T.StructField("p_size", T.IntegerType()),
        T.StructField("p_retailprice", T.DoubleType()),
    ]),
    "customer": T.StructType([
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]),
    "orders": T.StructType([
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]),
    "lineitem": T.StructType([
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_discount", T.DoubleType()),
        T.StructField("l_tax", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]),
    "events": T.StructType([
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]),
}

# --- fixed values: fixture mapping (see FIXTURES.md) -------------------------
FIXTURE_EXPIRY_BASE = dt.date(2001, 8, 1)
WARNING_LABELS = {0: "Prescription Required", 1: "Refrigerate After Opening"}


def money(c: Column) -> Column:
    return c.cast(MONEY)


def ntz(value: dt.datetime | dt.date) -> Column:
    """A TIMESTAMP_NTZ literal (wall-clock time, no zone conversion)."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


class Tables:
    """Lazy bundle of source DataFrames for one data directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    @classmethod
    def from_dir(cls, spark: SparkSession, root: str) -> "Tables":
        return cls(spark, root)

    @classmethod
    def from_frames(cls, spark: SparkSession, root: str | None = None, raw: dict | None = None,
                    **frames: DataFrame) -> "Tables":
        """A bundle whose retail tables (and optionally raw tables) are given
        DataFrames, e.g. inline fixtures in tests; the rest derive as usual."""
        t = cls(spark, root or "")
        t._raw_overrides = dict(raw or {})
        t._given = frozenset(frames)
        for name, df in frames.items():
            t.__dict__[name] = df  # pre-fills the cached_property slot
        if "product" in frames and "product_base" not in frames:
            t.__dict__["product_base"] = frames["product"].drop("category_id")
        return t

    def is_given(self, name: str) -> bool:
        """Whether retail table ``name`` was handed in (see from_frames)."""
        return name in getattr(self, "_given", ())

    def is_stored(self) -> bool:
        """Whether every table comes from the directory."""
        return bool(self.root) and not getattr(self, "_given", ()) and not getattr(self, "_raw_overrides", {})

    def version(self, names: Sequence[str]) -> str:
        """A digest of the files of the named raw tables (path, size, time of
        change): it changes whenever a file is written, added or removed."""
        files = [self.raw(name).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("n"),
                                       F.col("_metadata.file_modification_time").cast("double").alias("t"))
                 for name in names]
        found = reduce(DataFrame.unionByName, files).distinct()
        # an empty table still has its folder's path
        row = found.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("p", "n", "t")), F.sum("n")).first()
        path = hashlib.sha256(os.path.normpath(self.root).encode()).hexdigest()[:16]
        return f"{path}-{row[0]}-{(row[1] or 0) & (1 << 64) - 1:016x}-{row[2] or 0}"

    # -- raw driver tables ---------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        overrides = getattr(self, "_raw_overrides", {})
        if name in overrides:
            return overrides[name]
        path = os.path.join(self.root, f"{name}.parquet")
        schema = RAW_SCHEMAS.get(name)
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(path)

    # -- retail schema -------------------------------------------------------
    @cached_property
    def category(self) -> DataFrame:
        """One row per distinct product type; ids dense-ranked by name.

        The ranking window runs over the *distinct* types only (a dimension
        domain), after a partial/final aggregation of the part scan."""
        types = self.raw("part").select(F.col("p_type").alias("category_name")).distinct()
        return types.select(
            F.dense_rank().over(Window.orderBy("category_name")).cast("bigint").alias("category_id"),
            "category_name")

    @cached_property
    def category_lookup(self) -> DataFrame:
        """The category dimension for joins, written once per bundle and
        broadcast once its size is checked (it is a small domain), so product
        rows are never shuffled to meet it; past the bound, a plain join."""
        category = cut_lineage(self.category)
        try:
            return bounded_broadcast(category, MAX_CATEGORY_ROWS)
        except BroadcastBoundExceeded:
            return category

    @cached_property
    def product_named(self) -> DataFrame:
        """Products with category id and name: one scan, one small join.  A
        filter on the name reaches the scan."""
        cat = self.category_lookup
        if self.is_given("product"):
            return self.product.join(cat, "category_id")
        prod = self._product_rows()
        return (prod.join(cat, prod["_type"] == cat["category_name"])
                .select("product_id", "barcode", "name", "price", "stock_qty",
                        "reorder_level", "expiry_date", "warning_label",
                        "category_id", "is_active", prod["_type"].alias("category_name")))

    @cached_property
    def product(self) -> DataFrame:
        """Products with their category id (every product type is a category)."""
        return self.product_named.drop("category_name")

    @cached_property
    def product_typed(self) -> DataFrame:
        """Products with their category name, for operators that never show
        the id: the name stands in the product row, so nothing is joined."""
        if self.is_given("product"):
            return self.product_named.drop("category_id")
        return self._product_rows().withColumnRenamed("_type", "category_name")

    @cached_property
    def product_base(self) -> DataFrame:
        """Product columns without the category id, for operators that never
        look at the category: no category join at all."""
        return self._product_rows().drop("_type")

    def _product_rows(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        label = F.when(k % 9 == 0, F.lit(WARNING_LABELS[0])).when(k % 9 == 1, F.lit(WARNING_LABELS[1]))
        prod = p.select(
            k.alias("product_id"),
            F.when(k % 7 == 0, F.lit(None).cast("string"))
             .otherwise(F.lpad(k.cast("string"), 13, "0")).alias("barcode"),
            F.col("p_name").alias("name"),
            money(F.col("p_retailprice")).alias("price"),
            F.when(k % 13 == 0, F.lit(0)).otherwise(F.col("p_size")).cast("int").alias("stock_qty"),
            F.lit(10).cast("int").alias("reorder_level"),
            F.when(k % 5 == 0, F.lit(None).cast("date"))
             .otherwise(F.date_add(F.lit(FIXTURE_EXPIRY_BASE), ((k * 7) % 120 - 20).cast("int")))
             .alias("expiry_date"),
            label.alias("warning_label"),
            F.col("p_type").alias("_type"),
            (k % 11 != 0).alias("is_active"),
        )
        return prod

    @cached_property
    def app_user(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        customers = c.select(
            k.alias("user_id"),
            F.concat(F.lit("cust_"), k.cast("string")).alias("username"),
            F.lit("customer").alias("role"),
            F.col("c_name").alias("full_name"),
            F.when(k % 4 == 0, F.lit(None).cast("string"))
             .otherwise(F.lpad(k.cast("string"), 10, "9")).alias("phone_no"),
            (k % 10 != 0).alias("is_active"),
        )
        staff = seeds.staff_users(self.spark).select(
            "user_id", "username", "role", "full_name",
            F.lit(None).cast("string").alias("phone_no"), F.lit(True).alias("is_active"))
        return customers.unionByName(staff)

    @cached_property
    def order_items(self) -> DataFrame:
        li = self.raw("lineitem")
        qty = F.col("l_quantity").cast("bigint")
        cents = (money(F.col("l_extendedprice")) * 100).cast("bigint")
        unit_cents = ((cents - cents % qty) / qty).cast("bigint")
        return li.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_quantity").cast("int").alias("qty_sold"),
            (unit_cents * F.lit(0.01).cast(T.DecimalType(3, 2))).cast(MONEY).alias("unit_price"),
            money(F.col("l_extendedprice")).alias("line_total"),
        )

    @cached_property
    def sales_orders(self) -> DataFrame:
        return self._orders_from(self.raw("orders"))

    def orders_in_status(self, *statuses: str) -> DataFrame:
        """Orders restricted to the given statuses, with the restriction
        stated on the raw status code so Parquet can skip row groups."""
        unknown = set(statuses) - set(ORDER_STATUSES)
        if unknown or not statuses:
            raise ValueError(f"order status must be one of {ORDER_STATUSES}, not {sorted(unknown)}")
        if self.is_given("sales_orders"):
            return self.sales_orders.filter(F.col("status").isin(*statuses))
        codes = {"completed": ["F"], "pending": ["O"]}
        raw = self.raw("orders")
        code = F.col("o_orderstatus")
        cond = None
        for st in statuses:
            if st in codes:
                c = code.isin(codes[st])
            else:  # cancelled: every other code
                c = code.isNull() | ~code.isin("F", "O")
            cond = c if cond is None else cond | c
        return self._orders_from(raw.filter(cond))

    def _orders_from(self, o: DataFrame) -> DataFrame:
        k = F.col("o_orderkey")
        pay = F.when(F.col("o_orderpriority") == "1-URGENT", "cash") \
               .when(F.col("o_orderpriority") == "2-HIGH", "card") \
               .when(F.col("o_orderpriority") == "3-MEDIUM", "upi").otherwise("other")
        status = F.when(F.col("o_orderstatus") == "F", "completed") \
                  .when(F.col("o_orderstatus") == "O", "pending").otherwise("cancelled")
        base = o.select(
            k.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            (F.lit(-1) - k % 4).alias("cashier_id"),
            F.col("o_orderdate").alias("order_date"),
            money(F.col("o_totalprice")).alias("subtotal"),
            money(k % 50).alias("discount"),
            pay.alias("payment_mode"),
            status.alias("status"),
        )
        net = F.col("subtotal") - F.col("discount")
        tax = F.round(net * F.lit(0.18).cast(T.DecimalType(3, 2)), 2)
        return base.select(
            "order_id", "customer_id", "cashier_id", "order_date", "subtotal", "discount",
            tax.cast(MONEY).alias("tax_amount"),
            (net + tax).cast(MONEY).alias("total_bill"),
            "payment_mode", "status")

    @cached_property
    def discount_rules(self) -> DataFrame:
        return seeds.discount_rules(self.spark)

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")
