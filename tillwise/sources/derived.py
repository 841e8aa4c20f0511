"""Inputs derived from the driver tables (FIXTURES.md, "Derived inputs").

Carts, restock requests, change feeds, read events and registration requests
are all computed from the tables with Spark, so they grow with the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.plans.broadcast import BroadcastBoundExceeded, bounded_broadcast
from tillwise.plans.lineage import cut_lineage
from tillwise.plans.running import chunked_running_sum
from tillwise.sources.tables import MONEY, Tables, ntz

# --- fixed values: derived-input rules ---------------------------------------
OPENING_STOCK_FACTOR = 20          # opening stock = p_size * 20
LEDGER_START = dt.datetime(1994, 12, 31)
RESTOCK_EPOCH = dt.date(1995, 1, 1)
RESTOCK_EVERY_DAYS = 90            # restock rows every 90 days ...
RESTOCK_MODULUS = 3                # ... for product_id % 3 = 0
RESTOCK_FACTOR = 10                # restock qty = p_size * 10 ...
RESTOCK_ZERO_MODULUS = 21          # ... except product_id % 21 = 0 (qty 0)
RESTOCK_UNKNOWN_MODULUS = 300      # a request for product_id + 1e6 (unknown)
RESTOCK_BY = -5                    # the manager account
UNKNOWN_OFFSET = 1_000_000


def restock_count(as_of: dt.date) -> int:
    return (as_of - RESTOCK_EPOCH).days // RESTOCK_EVERY_DAYS


# Carts are positioned and serialised in bounded pieces so that one huge
# order never lands whole in one task.
CART_RANK_BLOCK = 1024   # products per ranking chunk inside one (order, line)
CART_PIECE = 1000        # items per JSON cart piece
MAX_LARGE_ORDERS = 100_000  # larger orders' numbers are broadcast up to so many
BROKEN_MODULUS = 500     # fixed value: every 500th order has a broken upload too


def cart_demand(t: Tables) -> DataFrame:
    """Cart lines without positions: demand summed per (order, product) and
    the product's first line number.  Cart order is (first_line,
    product_id); checks that only need the order use this (one aggregate)."""
    return _demand(t.order_items)


def _demand(items: DataFrame) -> DataFrame:
    return (items.groupBy("order_id", "product_id")
            .agg(F.sum("qty_sold").cast("int").alias("qty"), F.min("line_no").alias("first_line")))


def cart_lines(t: Tables) -> DataFrame:
    """Cart lines with ``pos``, the 0-based cart position in (first line,
    product id) order (line numbers repeat within an order in the source).
    An order of at most CART_PIECE lines is shuffled once, whole, and numbered
    there; a larger one is never in one task: its position is a running count
    chunked by (first line, product-id block)."""
    items = t.order_items.filter(F.col("order_id").isNotNull())
    large = items.groupBy("order_id").count().filter(F.col("count") > CART_PIECE).select("order_id")
    try:
        large = bounded_broadcast(cut_lineage(large), MAX_LARGE_ORDERS)
        small = items.join(large, "order_id", "left_anti")
        items = items.join(large, "order_id", "left_semi")
    except BroadcastBoundExceeded:
        small = items.filter("false")
    agg = _demand(items)
    chunk = F.struct(F.col("first_line"), F.floor(F.col("product_id") / CART_RANK_BLOCK))
    ranked = chunked_running_sum(agg, "order_id", chunk, [F.col("first_line"), F.col("product_id")],
                                 {"_before": F.lit(1).cast("bigint")}, inclusive=False)
    order = Window.partitionBy("order_id").orderBy("first_line", "product_id")
    numbered = _demand(small.repartition("order_id")).withColumn("_before", F.row_number().over(order) - 1)
    cols = ["order_id", "product_id", "qty", "first_line", F.col("_before").cast("int").alias("pos")]
    return numbered.select(*cols).unionByName(ranked.select(*cols))


def cart_headers(t: Tables) -> DataFrame:
    return t.sales_orders.select("order_id", "customer_id", "cashier_id", "order_date",
                                 "payment_mode", "discount")


def cart_json(t: Tables) -> DataFrame:
    """JSON carts in the checkout argument's format
    ``[{"product_id":1,"qty":2}, ...]``, in cart order, cut into pieces of
    at most CART_PIECE items: one row per (order_id, piece).  An order
    without lines has an empty cart, and every 500th order has a second,
    broken upload under the number ``-1 - order_id``."""
    orders = t.sales_orders.select("order_id")
    empty = orders.join(t.order_items.select("order_id").distinct(), "order_id", "left_anti").select(
        "order_id", F.lit(0).alias("piece"), F.lit("[]").alias("items_json"))
    broken = orders.filter(F.col("order_id") % BROKEN_MODULUS == 0).select(
        (-1 - F.col("order_id")).alias("order_id"), F.lit(0).alias("piece"), F.lit('[{"product_id":').alias("items_json"))
    lines = cart_lines(t).withColumn("piece", F.floor(F.col("pos") / CART_PIECE).cast("int"))
    items = F.sort_array(F.collect_list(F.struct("pos", "product_id", "qty")))
    full = lines.groupBy("order_id", "piece").agg(
        F.to_json(F.transform(items, lambda x: F.struct(x["product_id"].alias("product_id"),
                                                        x["qty"].alias("qty")))).alias("items_json"))
    return full.unionByName(empty).unionByName(broken)


def _sized(t: Tables) -> DataFrame:
    """Products with the size that stock quantities derive from; of given
    products, their stock."""
    if t.is_given("product"):
        return t.product.select(F.col("product_id").alias("pid"), F.col("stock_qty").alias("p_size"))
    return t.raw("part").select(F.col("p_partkey").alias("pid"), "p_size")


def opening_stock(t: Tables) -> DataFrame:
    return _sized(t).select(F.col("pid").alias("product_id"),
                            (F.col("p_size") * OPENING_STOCK_FACTOR).cast("int").alias("opening_qty"))


# --- fixed values: shelf counts -----------------------------------------------
MISCOUNT_MODULUS = 97      # one unit is missing from the count of every 97th product


def shelf_counts(stock: DataFrame) -> DataFrame:
    """A stock take: the given stock, with planted miscounts."""
    lost = F.when(F.col("product_id") % MISCOUNT_MODULUS == 0, F.lit(1)).otherwise(F.lit(0))
    return stock.select("product_id", (F.col("stock_qty") - lost).cast("bigint").alias("stock_qty"))


def restock_requests(t: Tables, as_of: dt.date) -> DataFrame:
    """Scheduled restocks of every product: each third one every 90 days,
    the others in one of those slots; plus one request for an unknown product
    id per 300 products."""
    p, n = _sized(t), restock_count(as_of)
    slots = F.when(F.col("pid") % RESTOCK_MODULUS == 0, F.sequence(F.lit(1), F.lit(n))).otherwise(
        F.array((F.col("pid") % n + 1).cast("int")))
    sched = p.select("pid", "p_size", F.explode(slots).alias("k"))
    sched = sched.select(
        F.col("pid").alias("product_id"),
        F.when(F.col("pid") % RESTOCK_ZERO_MODULUS == 0, F.lit(0))
         .otherwise(F.col("p_size") * RESTOCK_FACTOR).cast("int").alias("qty"),
        F.date_add(F.lit(RESTOCK_EPOCH), F.col("k") * RESTOCK_EVERY_DAYS).cast("timestamp_ntz")
         .alias("request_ts"))
    unknown = p.filter(F.col("pid") % RESTOCK_UNKNOWN_MODULUS == 0).select(
        (F.col("pid") + UNKNOWN_OFFSET).alias("product_id"),
        (F.col("p_size") * RESTOCK_FACTOR).cast("int").alias("qty"),
        ntz(RESTOCK_EPOCH).alias("request_ts"))
    return sched.unionByName(unknown).select(
        "product_id", "qty", F.lit(RESTOCK_BY).cast("bigint").alias("performed_by"),
        "request_ts", F.lit("scheduled restock").alias("notes"))


# --- fixed values: change-feed rules ------------------------------------------
CHANGE_MODULUS = 10        # products with product_id % 10 = 0 get two versions
NEW_PRODUCT_MODULUS = 500  # one new product per 500 (id + 1e6),
NEW_EXPIRING = 50          # and one per 50, some of which expire soon
GIVEN_STOCK = 77           # stated for known products, which must not take it
PRICE_UP = "1.10"


def product_changes(t: Tables, as_of: dt.date) -> DataFrame:
    """Change feed: version 1 raises the price 10 %, version 2 deactivates;
    new products arrive as full rows.  A NULL field means "keep".  Every row
    of a known product states a stock, which such a product must not take;
    every third new product states none."""
    p = t.product
    ts = dt.datetime.combine(as_of, dt.time(9, 0))
    base = p.filter(F.col("product_id") % CHANGE_MODULUS == 0)
    nulls = {
        "name": F.lit(None).cast("string"), "price": F.lit(None).cast(MONEY),
        "reorder_level": F.lit(None).cast("int"), "expiry_date": F.lit(None).cast("date"),
        "warning_label": F.lit(None).cast("string"), "category_id": F.lit(None).cast("bigint"),
        "barcode": F.lit(None).cast("string"), "is_active": F.lit(None).cast("boolean"),
    }
    order = list(nulls)

    def row(src, version, hours, **over):
        cols = dict(nulls, **over)
        return src.select("product_id", F.lit(GIVEN_STOCK).alias("stock_qty"), F.lit(version).alias("version"),
                          ntz(ts + dt.timedelta(hours=hours)).alias("changed_at"),
                          *[cols[c].alias(c) for c in order])

    v1 = row(base, 1, 0, price=F.round(F.col("price") * F.lit(PRICE_UP).cast("decimal(3,2)"), 2).cast(MONEY))
    v2 = row(base, 2, 1, is_active=F.lit(False))
    fresh = p.filter((F.col("product_id") % NEW_PRODUCT_MODULUS == 0)
                     | (F.col("product_id") % NEW_EXPIRING == 1)).select(
        (F.col("product_id") + UNKNOWN_OFFSET).alias("product_id"),
        F.when(F.col("product_id") % 3 != 0, F.col("product_id") % 37).cast("int").alias("stock_qty"),
        F.lit(1).alias("version"), ntz(ts).alias("changed_at"),
        F.concat(F.lit("new "), F.col("name")).alias("name"), F.col("price"),
        F.lit(None).cast("int").alias("reorder_level"), F.col("expiry_date"),
        F.lit(None).cast("string").alias("warning_label"), F.col("category_id"),
        F.lit(None).cast("string").alias("barcode"), F.lit(None).cast("boolean").alias("is_active"))
    return v1.unionByName(v2).unionByName(fresh)


# --- fixed values: registration requests --------------------------------------
REG_MODULUS = 50   # customers with key % 50 = 0 re-register (taken), = 1 new


def registration_requests(t: Tables) -> DataFrame:
    """One or two requests of every customer, by the key's residue: a taken
    name, a new name twice, a bad phone, else a new member."""
    if t.is_given("app_user"):
        c = t.app_user.filter("role = 'customer'").select(F.col("user_id").alias("k"), "full_name")
    else:
        c = t.raw("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("full_name"))
    taken = c.filter(F.col("k") % REG_MODULUS == 0).select(
        (F.col("k") * 10).alias("request_id"),
        F.concat(F.lit("CUST_"), F.col("k").cast("string")).alias("username"), "full_name",
        F.lpad(F.col("k").cast("string"), 10, "8").alias("phone_no"))
    new = c.filter(F.col("k") % REG_MODULUS == 1)
    first = new.select((F.col("k") * 10 + 1).alias("request_id"),
                       F.concat(F.lit("new_"), F.col("k").cast("string")).alias("username"), "full_name",
                       F.lpad(F.col("k").cast("string"), 10, "7").alias("phone_no"))
    again = new.select((F.col("k") * 10 + 2).alias("request_id"),
                       F.concat(F.lit(" NEW_"), F.col("k").cast("string")).alias("username"), "full_name",
                       F.lit(None).cast("string").alias("phone_no"))
    bad_phone = c.filter(F.col("k") % REG_MODULUS == 2).select(
        (F.col("k") * 10 + 3).alias("request_id"),
        F.concat(F.lit("shop_"), F.col("k").cast("string")).alias("username"), "full_name",
        F.concat(F.lit("+91"), F.col("k").cast("string")).alias("phone_no"))
    member = c.filter(F.col("k") % REG_MODULUS > 2).select(
        (F.col("k") * 10 + 4).alias("request_id"),
        F.concat(F.lit("member_"), F.col("k").cast("string")).alias("username"), "full_name",
        F.lpad(F.col("k").cast("string"), 10, "6").alias("phone_no"))
    return taken.unionByName(first).unionByName(again).unionByName(bad_phone).unionByName(member)
