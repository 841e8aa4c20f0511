"""Sales reports: star joins, per-product and per-category aggregates, top-k.

Aggregates are taken on the fact side *before* joining dimensions
(eager aggregation by product), so the product join sees one row per sold
product instead of one per line, however many lines the input holds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions import scalar as S
from tillwise.plans.lineage import cut_lineage
from tillwise.plans.lookup import MAX_LOOKUP_ROWS, lookup_join
from tillwise.plans.running import assign_range_chunks, chunked_running_sum
from tillwise.sources.tables import MONEY, Tables

SUM_MONEY = T.DecimalType(22, 2)


def _completed_orders(t: Tables, from_date=None, to_date=None, month_of=None) -> DataFrame:
    o = t.orders_in_status("completed")
    return _date_window(o, from_date, to_date, month_of).select("order_id")


def _date_window(o: DataFrame, from_date=None, to_date=None, month_of=None) -> DataFrame:
    d = F.to_date("order_date")
    if from_date is not None:
        o = o.filter(d >= F.lit(from_date))
    if to_date is not None:
        o = o.filter(d <= F.lit(to_date))
    if month_of is not None:
        start = dt.date(month_of.year, month_of.month, 1)
        nxt = dt.date(start.year + (start.month // 12), start.month % 12 + 1, 1)
        o = o.filter((F.col("order_date") >= F.lit(start)) & (F.col("order_date") < F.lit(nxt)))
    return o


def _sales_by_product(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id").agg(
        F.sum("qty_sold").alias("units"),
        S.sum_money(F.col("line_total")).alias("revenue"))


def _by_category(t: Tables, per_product: DataFrame) -> DataFrame:
    prod = t.product_typed.select("product_id", "category_name")
    return (per_product.join(prod, "product_id")
            .groupBy("category_name")
            .agg(F.sum("units").cast("bigint").alias("units"),
                 S.sum_money(F.col("revenue")).alias("revenue")))


def revenue_by_category(t: Tables) -> DataFrame:
    """Units and revenue per category over completed orders, by revenue."""
    items = t.order_items.select("order_id", "product_id", "qty_sold", "line_total")
    sold = items.join(_completed_orders(t), "order_id", "left_semi")
    return _by_category(t, _sales_by_product(sold)).orderBy(
        F.col("revenue").desc(), F.col("category_name"))


def category_report(t: Tables, from_date: dt.date, to_date: dt.date) -> DataFrame:
    """Revenue by category for completed orders dated inside [from, to]."""
    items = t.order_items.select("order_id", "product_id", "qty_sold", "line_total")
    sold = items.join(_completed_orders(t, from_date, to_date), "order_id", "left_semi")
    return (_by_category(t, _sales_by_product(sold))
            .select("category_name", F.col("units").alias("units_sold"), "revenue")
            .orderBy(F.col("revenue").desc(), F.col("category_name")))


def category_revenue_month(t: Tables, as_of: dt.date) -> DataFrame:
    """Revenue by category for the calendar month of ``as_of``, any status."""
    o = _date_window(t.sales_orders, month_of=as_of).select("order_id")
    items = t.order_items.select("order_id", "product_id", "qty_sold", "line_total")
    sold = items.join(o, "order_id", "left_semi")
    return (_by_category(t, _sales_by_product(sold)).select("category_name", "revenue")
            .orderBy(F.col("revenue").desc(), F.col("category_name")))


# -- per-product summaries ---------------------------------------------------

def _item_totals(t: Tables, with_orders: bool = False) -> DataFrame:
    """Σ units / revenue (and distinct orders) per product over all lines."""
    items = t.order_items
    aggs = [F.sum("qty_sold").alias("units"), S.sum_money(F.col("line_total")).alias("revenue")]
    if with_orders:
        aggs.append(F.count_distinct("order_id").alias("orders"))
    return items.groupBy("product_id").agg(*aggs)


def product_sales_summary(t: Tables) -> DataFrame:
    """Every product with lifetime units, revenue and distinct orders
    (unsold products report zeros), by revenue."""
    p = t.product_typed.select(
        "product_id", F.col("name").alias("product_name"), "category_name",
        F.col("price").alias("current_price"), F.col("stock_qty").alias("current_stock"))
    out = p.join(_item_totals(t, with_orders=True), "product_id", "left").select(
        "product_id", "product_name", "category_name", "current_price", "current_stock",
        F.coalesce(F.col("units"), F.lit(0)).cast("bigint").alias("total_units_sold"),
        F.coalesce(F.col("revenue"), F.lit(0)).cast(SUM_MONEY).alias("total_revenue"),
        F.coalesce(F.col("orders"), F.lit(0)).cast("bigint").alias("order_count"))
    return out.orderBy(F.col("total_revenue").desc(), "product_id")


def highest_ticket_items(t: Tables) -> DataFrame:
    """Units, revenue and ticket value (current price x units) per product."""
    p = t.product_base.select("product_id", "name", "price")
    units = F.coalesce(F.col("units"), F.lit(0)).cast("bigint")
    out = p.join(_item_totals(t), "product_id", "left").select(
        "product_id", "name", "price", units.alias("units_sold"),
        F.coalesce(F.col("revenue"), F.lit(0)).cast(SUM_MONEY).alias("total_revenue"),
        (F.col("price") * units).cast(SUM_MONEY).alias("ticket_value"))
    return out.orderBy(F.col("ticket_value").desc(), "product_id")


def top_ticket_items(t: Tables, n: int = 5) -> DataFrame:
    return highest_ticket_items(t).limit(n)


def top_products_ranked(t: Tables, n: int = 5) -> DataFrame:
    """Top ``n`` by ticket value with a 1-based rank label; the window runs
    over the ``n`` rows left after the top-k, not over the products."""
    top = top_ticket_items(t, n)
    w = Window.orderBy(F.col("ticket_value").desc(), F.col("product_id"))
    return top.select(F.row_number().over(w).alias("rank"), "product_id", "name",
                      "total_revenue", "ticket_value")


# -- order-header reports ------------------------------------------------------

def daily_summary(t: Tables, as_of: dt.date) -> DataFrame:
    """One row for the day ``as_of``: completed orders, revenue, tax,
    discount and distinct customers (zeros on an empty day)."""
    o = t.orders_in_status("completed").filter(F.to_date("order_date") == F.lit(as_of))
    zero = F.lit(0).cast(MONEY)
    return o.agg(
        F.count(F.lit(1)).alias("orders_today"),  # order_id is the key
        F.coalesce(S.sum_money(F.col("total_bill")), zero).cast(SUM_MONEY).alias("revenue_today"),
        F.coalesce(S.sum_money(F.col("tax_amount")), zero).cast(SUM_MONEY).alias("tax_today"),
        F.coalesce(S.sum_money(F.col("discount")), zero).cast(SUM_MONEY).alias("discount_today"),
        F.count_distinct("customer_id").alias("unique_customers_today"))


def monthly_sales(t: Tables, as_of: dt.date, months: int = 6) -> DataFrame:
    """Completed revenue and order count per calendar month since
    ``as_of`` minus ``months`` months."""
    since = S.add_months(as_of, -months)
    o = t.orders_in_status("completed").filter(F.col("order_date") >= F.lit(since))
    return (o.groupBy(F.date_format("order_date", "yyyy-MM").alias("month"))
            .agg(S.sum_money(F.col("total_bill")).alias("revenue"),
                 F.count(F.lit(1)).alias("orders"))
            .orderBy("month"))


def monthly_sales_scaled(t: Tables, as_of: dt.date, months: int = 6) -> DataFrame:
    """Monthly sales with each month's share of the best month (bar height).
    The unpartitioned window sees at most months + 1 aggregated rows."""
    m = monthly_sales(t, as_of, months)
    share = F.col("revenue").cast("double") / F.max(F.col("revenue").cast("double")).over(Window.partitionBy())
    return m.select("month", S.month_label(F.col("month")).alias("label"), "revenue", "orders",
                    share.alias("share"),
                    F.greatest(F.lit(16.0), share * 140).alias("bar_px")).orderBy("month")


def customer_summary(t: Tables) -> DataFrame:
    """Total spent, purchase count and last visit per customer, all orders."""
    return t.sales_orders.groupBy("customer_id").agg(
        S.sum_money(F.col("total_bill")).alias("total_spent"),
        F.count(F.lit(1)).alias("purchases"),
        F.max("order_date").alias("last_visit"))


def _named_orders(t: Tables, o: DataFrame, phone: bool = False) -> DataFrame:
    u = t.app_user
    cu_cols = [F.col("user_id").alias("customer_id"), F.col("full_name").alias("customer_name")]
    if phone:
        cu_cols.append(F.col("phone_no").alias("customer_phone"))
    cu = u.select(*cu_cols)
    ca = u.select(F.col("user_id").alias("cashier_id"), F.col("full_name").alias("cashier_name"))
    # Few cashiers serve all orders: broadcast the used ones, no shuffle by cashier.
    return lookup_join(o.join(cu, "customer_id"), "cashier_id", ca, "cashier_id", ["cashier_name"],
                       probe=o)


ORDER_COLS = ["order_id", "customer_id", "cashier_id", "order_date", "subtotal", "discount",
              "tax_amount", "total_bill", "payment_mode", "status"]


def customer_history(t: Tables) -> DataFrame:
    """Every order with the customer's and the cashier's names."""
    return _named_orders(t, t.sales_orders).select(
        "order_id", "customer_id", "customer_name", "order_date", "subtotal", "discount",
        "tax_amount", "total_bill", "payment_mode", "status", "cashier_name")


def orders_list(t: Tables, customer_id=None, cashier_id=None, n: int = 100) -> DataFrame:
    """Newest ``n`` orders (optionally one customer's / one cashier's) with
    names and a line count.  The ``n`` orders are taken first, from one scan,
    and written once; names and line counts are looked up for them alone.
    (Every order has its customer and cashier, which DQ-6 checks.)"""
    newest = [F.col("order_date").desc(), F.col("order_id").desc()]
    o = t.sales_orders
    if customer_id is not None:
        o = o.filter(F.col("customer_id") == F.lit(customer_id))
    if cashier_id is not None:
        o = o.filter(F.col("cashier_id") == F.lit(cashier_id))
    top = cut_lineage(o.select(*ORDER_COLS).orderBy(*newest).limit(n))
    ids = top.select("order_id")
    if n <= MAX_LOOKUP_ROWS:
        ids = F.broadcast(ids)
    counts = (t.order_items.select("order_id").join(ids, "order_id", "left_semi")
              .groupBy("order_id").agg(F.count(F.lit(1)).alias("item_count")))
    named = _named_orders(t, top).select(*ORDER_COLS, "customer_name", "cashier_name")
    return (named.join(counts, "order_id", "left")
            .withColumn("item_count", F.coalesce(F.col("item_count"), F.lit(0)).cast("bigint"))
            .orderBy(*newest))


def recent_orders(t: Tables, n: int = 5) -> DataFrame:
    """The ``n`` most recent orders of every customer.  Spark plans a partial
    WindowGroupLimit before the shuffle, so a customer with a huge history
    ships at most ``n`` rows per map task."""
    w = Window.partitionBy("customer_id").orderBy(F.col("order_date").desc(), F.col("order_id").desc())
    return (t.sales_orders.select("customer_id", "order_id", "order_date", "total_bill", "status")
            .withColumn("recency", F.row_number().over(w))
            .filter(F.col("recency") <= n))


def receipts(t: Tables, order_ids: DataFrame | int | None = None) -> DataFrame:
    """Receipt lines: order header, customer and cashier, product name and
    the line's snapshot price; one row per line (flat form).  ``order_ids``:
    one id, a DataFrame of ids, or None for every order."""
    o = t.sales_orders
    items = t.order_items
    if isinstance(order_ids, int):
        o = o.filter(F.col("order_id") == F.lit(order_ids))
        items = items.filter(F.col("order_id") == F.lit(order_ids))
    elif order_ids is not None:
        ids = order_ids.select("order_id").distinct()
        o = o.join(ids, "order_id", "left_semi")
        items = items.join(ids, "order_id", "left_semi")
    head = _named_orders(t, o, phone=True)
    lines = items.join(t.product_base.select("product_id", F.col("name").alias("product_name")), "product_id")
    return head.join(lines, "order_id").select(
        *ORDER_COLS, "customer_name", "customer_phone", "cashier_name",
        "line_no", "product_id", "product_name", "qty_sold", "unit_price", "line_total")


def nested_receipts(t: Tables, order_ids: DataFrame | int | None = None, piece_lines: int = 1000) -> DataFrame:
    """Receipts with their lines nested: order header, names, ``piece`` and
    ``lines`` (array of structs by line number).  A piece holds at most
    ``piece_lines`` lines, so an order of any size stays in bounded values;
    almost every order is one piece.  Places in an order come from range
    chunks of (order, line), so a huge order is numbered by many tasks."""
    cols = ["line_no", "product_id", "product_name", "qty_sold", "unit_price", "line_total"]
    order = [F.col(c).asc_nulls_first() for c in cols]
    flat = receipts(t, order_ids)
    head = [c for c in flat.columns if c not in cols]
    tagged = assign_range_chunks(flat, "order_id", order)
    numbered = chunked_running_sum(tagged, "order_id", F.col("_rchunk"), order, {"line_seq": F.lit(1)})
    piece = F.floor((F.col("line_seq") - 1) / F.lit(piece_lines)).cast("int")
    line = F.struct(F.col("line_seq").cast("int").alias("line_seq"), *cols)
    return (numbered.groupBy("order_id", piece.alias("piece"))
            .agg(F.sort_array(F.collect_list(line)).alias("lines"),
                 # an order's header is the same on all of its lines
                 *[F.first(c).alias(c) for c in head if c != "order_id"])
            .select(*head, "piece", "lines"))


def clearance_candidates(t: Tables, as_of: dt.date, days: int = 30, n: int | None = 50) -> DataFrame:
    """Active in-stock products with no sale in the last ``days`` days,
    earliest expiry first (no expiry first of all)."""
    since = as_of - dt.timedelta(days=days)
    recent_orders_ = t.sales_orders.filter(F.col("order_date") >= F.lit(since)).select("order_id")
    sold = t.order_items.select("order_id", "product_id").join(recent_orders_, "order_id", "left_semi")
    p = (t.product_typed.filter(F.col("stock_qty") > 0).filter(F.col("is_active"))
         # distinct: the anti join then shuffles sold product ids, not lines
         .join(sold.select("product_id").distinct(), "product_id", "left_anti")
         .select("product_id", "name", "stock_qty", "price", "expiry_date", "category_name")
         .orderBy(F.col("expiry_date").asc_nulls_first(), "product_id"))
    return p if n is None else p.limit(n)
