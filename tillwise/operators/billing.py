"""Billing: cart ingest, pricing, validation, discount rules and restocks.

The reference runs one cart per transaction; here every operator takes a
whole batch of carts (or requests) and decides all of them in one job.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions import scalar as S
from tillwise.plans.broadcast import met_by_shuffle
from tillwise.plans.thresholds import with_best
from tillwise.sources import derived as D
from tillwise.sources.seeds import MAX_RULES
from tillwise.sources.tables import MONEY, Tables

SUM_MONEY = T.DecimalType(22, 2)
CART_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("qty", T.IntegerType()),
]))


def split_status(df: DataFrame, ok: str = "accepted", col: str = "status") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected-with-reason) from an action result carrying a
    status column, the shape of the reference's OUT-status procedures."""
    return df.filter(F.col(col) == ok), df.filter(F.col(col) != ok)


def parse_carts(carts_json: DataFrame, piece_size: int = D.CART_PIECE) -> DataFrame:
    """JSON cart pieces -> one row per item with its 0-based cart position
    and the cart's item count (summed over pieces by an aggregate).  A null
    or empty piece gives one row with reason ``missing_input``, one that is
    not a JSON array a row with ``malformed``; no piece vanishes."""
    length = F.json_array_length("items_json")
    reason = F.when(F.col("items_json").isNull() | (length == 0), "missing_input").when(length.isNull(), "malformed")
    parsed = carts_json.select(
        "order_id", "piece", reason.alias("reason"),
        F.posexplode_outer(F.when(reason.isNull(), F.from_json("items_json", CART_SCHEMA)))
        .alias("local_pos", "item"))
    sizes = carts_json.groupBy("order_id").agg(F.sum(F.coalesce(length, F.lit(0))).cast("int").alias("n_items"))
    return parsed.join(sizes, "order_id").select(
        "order_id", "n_items", (F.col("piece") * piece_size + F.col("local_pos")).cast("int").alias("pos"),
        F.col("item.product_id").alias("product_id"), F.col("item.qty").alias("qty"), "reason")


def price_carts(t: Tables, lines: DataFrame, headers: DataFrame, tax_rate: str = "0.18") -> DataFrame:
    """Price every cart at current product prices: subtotal, discount,
    tax rounded to the cent, total; payment mode defaults to cash.  A cart
    without lines (``missing_input``) or with a product that has no price
    (``unknown_product``) is rejected and gets no total."""
    priced = lines.join(met_by_shuffle(t.product_base.select("product_id", "price")), "product_id", "left")
    per_order = priced.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("price").isNull()).alias("_unknown"),
        S.sum_money(F.col("price") * F.col("qty")).alias("_subtotal"))
    h = headers.select("order_id", "customer_id",
                       F.coalesce(F.col("discount"), F.lit(0).cast(MONEY)).alias("discount"),
                       F.coalesce(F.col("payment_mode"), F.lit("cash")).alias("payment_mode"))
    reason = F.when(F.col("n_lines").isNull(), "missing_input").when(F.col("_unknown") > 0, "unknown_product")
    j = h.join(met_by_shuffle(per_order), "order_id", "left").withColumn("reason", reason).withColumn(
        "subtotal", F.when(reason.isNull(), F.col("_subtotal")))
    net = F.col("subtotal") - F.col("discount")
    tax = F.round(net * F.lit(tax_rate).cast("decimal(4,2)"), 2)
    return j.select(
        "order_id", "customer_id", F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"), "subtotal",
        "discount", tax.cast(SUM_MONEY).alias("tax_amount"), (net + tax).cast(SUM_MONEY).alias("total_bill"),
        "payment_mode", F.when(F.col("reason").isNull(), "ok").otherwise("rejected").alias("status"), "reason")


def line_checks(t: Tables, lines: DataFrame, as_of, check_stock: bool = True) -> DataFrame:
    """Per cart line, the first failing check: unknown product, expired,
    short stock against the shelf ``stock_qty``.  ``as_of`` is a date, or a
    column (e.g. each order's own date) present on ``lines``."""
    p = t.product_base.select("product_id", "expiry_date", "stock_qty").withColumn("_known", F.lit(True))
    j = lines.join(met_by_shuffle(p), "product_id", "left")
    ref = as_of if isinstance(as_of, Column) else F.lit(as_of)
    reason = (F.when(F.col("_known").isNull(), "unknown_product")
               .when(F.col("expiry_date") < ref, "expired"))
    if check_stock:
        reason = reason.when(F.coalesce(F.col("stock_qty"), F.lit(0)) < F.col("qty"), "short_stock")
    return j.withColumn("line_reason", reason)


def validate_carts(t: Tables, lines: DataFrame, headers: DataFrame, as_of: dt.date | None,
                   check_stock: bool = True) -> DataFrame:
    """Validate each cart alone; the first failing reason wins: missing
    input, no such customer, then the first bad line in cart order.
    ``as_of=None`` checks expiry against each order's own date."""
    customers = t.app_user.filter(F.col("role") == "customer").select(
        F.col("user_id").alias("customer_id"), F.lit(True).alias("_cust"))
    # Cart order: ``pos`` when the lines carry it, else (first_line, product_id).
    cart_order = F.struct(*[F.col(c) for c in ("pos", "first_line", "product_id") if c in lines.columns])
    first_bad = F.min_by(F.struct(F.col("line_reason").alias("r"), F.col("product_id").alias("p")),
                         F.when(F.col("line_reason").isNotNull(), cart_order)).alias("first_bad")
    if as_of is None:
        # lines stored by the order meet its date where they lie; of those that have
        # met the products, only the failing ones go back to their order
        days = headers.select("order_id", F.to_date("order_date").alias("_day"))
        dated = lines.join(met_by_shuffle(days), "order_id")
        bad = line_checks(t, dated, F.col("_day"), check_stock).filter(F.col("line_reason").isNotNull())
        per_order = lines.select("order_id").distinct().withColumn("_has", F.lit(True)).join(
            met_by_shuffle(bad.groupBy("order_id").agg(first_bad)), "order_id", "left")
    else:
        # one pass over the lines: the order has lines, and its first failing one
        per_order = line_checks(t, lines, as_of, check_stock).groupBy("order_id").agg(first_bad, F.lit(True).alias("_has"))
    h = (headers.select("order_id", "customer_id")
         .join(met_by_shuffle(customers), "customer_id", "left")
         .join(met_by_shuffle(per_order), "order_id", "left"))
    reason = (F.when(F.col("customer_id").isNull() | F.col("_has").isNull(), "missing_input")
               .when(F.col("_cust").isNull(), "no_customer")
               .otherwise(F.col("first_bad.r")))
    failing = F.when(reason.isin("missing_input", "no_customer"), F.lit(None).cast("bigint")) \
               .otherwise(F.col("first_bad.p"))
    return h.select("order_id", F.when(reason.isNull(), "ok").otherwise("rejected").alias("status"),
                    reason.alias("reason"), failing.alias("failing_product_id"))


def applicable_rules(t: Tables, as_of: dt.date) -> DataFrame:
    r = t.discount_rules
    return (r.filter(F.col("is_active"))
            .filter(F.col("valid_from").isNull() | (F.col("valid_from") <= F.lit(as_of)))
            .filter(F.col("valid_to").isNull() | (F.col("valid_to") >= F.lit(as_of)))
            .select("min_qty", "min_amount", "discount_pct"))


def best_rule_pct(o: DataFrame, rules: DataFrame, max_rules: int = MAX_RULES) -> DataFrame:
    """Per order (``order_id``, ``units``, ``subtotal``): the largest
    ``discount_pct`` among matching rules, 0 when none matches.  Each order is
    looked up in the rules' staircases, so no order is ever joined to a rule."""
    cents = (F.col("subtotal") * 100).cast("bigint")
    r = rules.select(F.col("min_qty").cast("bigint").alias("a"), (F.col("min_amount") * 100).cast("bigint").alias("b"),
                     (F.col("discount_pct") * 100).cast("bigint").alias("value"))
    found = with_best(o, F.col("units"), cents, r, max_rules, "_pct")
    pct = (F.coalesce(F.col("_pct"), F.lit(0)).cast("decimal(7,0)") * F.lit("0.01").cast("decimal(3,2)"))
    return found.select("order_id", "units", "subtotal", pct.cast("decimal(5,2)").alias("discount_pct"))


def discount_for_order(t: Tables, as_of: dt.date, max_rules: int = MAX_RULES) -> DataFrame:
    """Best applicable rule per order: qty = units in the order, amount =
    subtotal; no rule -> 0 %."""
    units = t.order_items.groupBy("order_id").agg(F.sum("qty_sold").alias("units"))
    o = (t.sales_orders.select("order_id", "subtotal")
         .join(units, "order_id", "left")
         .withColumn("units", F.coalesce(F.col("units"), F.lit(0)).cast("bigint")))
    best = best_rule_pct(o, applicable_rules(t, as_of), max_rules)
    return best.select(
        "order_id", "units", "subtotal", "discount_pct",
        F.round(F.col("subtotal") * F.col("discount_pct") * F.lit("0.01").cast("decimal(3,2)"), 2)
        .cast(MONEY).alias("discount_amount"))


def apply_restocks(t: Tables, requests: DataFrame) -> DataFrame:
    """Accept restock requests for existing active products with qty > 0;
    rejected requests keep their reason (product check first)."""
    active = t.product_base.filter(F.col("is_active")).select("product_id", F.lit(True).alias("_ok"))
    j = requests.join(met_by_shuffle(active), "product_id", "left")
    reason = F.when(F.col("_ok").isNull(), "not_found").when(F.col("qty") <= 0, "bad_qty")
    return j.select(*requests.columns,
                    F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"),
                    reason.alias("reason"))


def accepted_restocks(t: Tables, as_of: dt.date) -> DataFrame:
    return apply_restocks(t, D.restock_requests(t, as_of)).filter(F.col("status") == "accepted")
