"""Carts that cannot be billed keep a row with a reason; given tables win over stored ones."""

import datetime as dt
from decimal import Decimal

import pytest

from tillwise.operators import billing, sales
from tillwise.sources import Tables

HEADS = ("order_id long, customer_id long, cashier_id long, order_date timestamp_ntz, payment_mode string, "
         "discount decimal(12,2)")


def test_parse_carts_keeps_every_cart(spark):
    carts = spark.createDataFrame(
        [(1, 0, '[{"product_id":5,"qty":2}]'), (2, 0, "[]"), (3, 0, "{broken"), (4, 0, None)],
        "order_id long, piece int, items_json string")
    got = {r.order_id: (r.n_items, r.pos, r.product_id, r.qty, r.reason) for r in billing.parse_carts(carts).collect()}
    assert got == {1: (1, 0, 5, 2, None), 2: (0, None, None, None, "missing_input"),
                   3: (0, None, None, None, "malformed"), 4: (0, None, None, None, "missing_input")}


def test_price_carts_rejects_what_has_no_price(spark):
    products = spark.createDataFrame([(1, Decimal("2.50"))], "product_id long, price decimal(12,2)").selectExpr(
        "*", "1L as category_id")
    t = Tables.from_frames(spark, product=products)
    lines = spark.createDataFrame([(1, 1, 2), (2, 1, 1), (2, 99, 1), (3, 99, 1)], "order_id long, product_id long, qty int")
    heads = spark.createDataFrame([(o, 7, -1, dt.datetime(2001, 1, 1), None, None) for o in (1, 2, 3, 4)], HEADS)
    got = {r.order_id: r for r in billing.price_carts(t, lines, heads).collect()}
    assert (got[1].status, got[1].subtotal, got[1].total_bill, got[1].payment_mode) == (
        "ok", Decimal("5.00"), Decimal("5.90"), "cash")
    assert [(got[o].n_lines, got[o].total_bill, got[o].reason) for o in (2, 3, 4)] == [
        (2, None, "unknown_product"), (1, None, "unknown_product"), (0, None, "missing_input")]


def test_given_orders_replace_the_stored_ones(spark):
    stored = Tables.from_dir(spark, "/root/testdata/sf0.001")
    t = Tables.from_frames(spark, root="/root/testdata/sf0.001", sales_orders=stored.sales_orders.limit(0))
    assert sales.revenue_by_category(t).count() == 0
    assert sales.monthly_sales(t, dt.date(2001, 8, 1)).count() == 0


def test_unknown_status_raises(spark):
    with pytest.raises(ValueError, match="refunded"):
        Tables.from_dir(spark, "/root/testdata/sf0.001").orders_in_status("refunded")
