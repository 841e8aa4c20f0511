"""Boundary cases from SURVEY section 5, on small inline tables."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillwise.operators import billing, catalog, ledger, sales
from tillwise.sources import Tables

AS_OF = dt.date(2001, 8, 1)
D = Decimal

PRODUCT_SCHEMA = ("product_id long, barcode string, name string, price decimal(12,2), stock_qty int, "
                  "reorder_level int, expiry_date date, warning_label string, category_id long, "
                  "is_active boolean")


def product_row(pid, stock=5, expiry=None, active=True, price="10.00", reorder=10):
    return (pid, None, f"p{pid}", D(price), stock, reorder, expiry, None, 1, active)


@pytest.fixture
def cats(spark):
    return spark.createDataFrame([(1, "Dairy")], "category_id long, category_name string")


def bundle(spark, cats, products, **kw):
    prod = spark.createDataFrame(products, PRODUCT_SCHEMA)
    return Tables.from_frames(spark, product=prod, category=cats, **kw)


def test_expiry_boundaries(spark, cats):
    rows = [product_row(1, expiry=AS_OF), product_row(2, expiry=AS_OF - dt.timedelta(days=1)),
            product_row(3, expiry=AS_OF + dt.timedelta(days=30)),
            product_row(4, expiry=AS_OF + dt.timedelta(days=31)), product_row(5, expiry=None)]
    t = bundle(spark, cats, rows)
    sellable = {r.product_id for r in catalog.sellable_products(t, AS_OF).collect()}
    assert sellable == {1, 3, 4, 5}  # expiring today is still sellable
    alerts = {r.product_id: r.days_remaining for r in catalog.expiry_alerts(t, AS_OF).collect()}
    assert alerts == {1: 0, 3: 30}
    expiring = {r.product_id for r in catalog.expiring_products(t, AS_OF).collect()}
    assert expiring == {1, 3}
    status = {r.product_id: r.expiry_status for r in catalog.expiry_status(t, AS_OF).collect()}
    assert status == {1: "danger", 2: "danger", 3: "warn", 4: None}


def test_stock_badges(spark, cats):
    t = bundle(spark, cats, [product_row(1, stock=0), product_row(2, stock=10), product_row(3, stock=11)])
    got = {r.product_id: r.stock_status for r in catalog.stock_status(t).collect()}
    assert got == {1: "out", 2: "low", 3: "ok"}


def _orders(spark, rows):
    return spark.createDataFrame(rows, "order_id long, customer_id long, cashier_id long, "
                                       "order_date timestamp_ntz, subtotal decimal(12,2), "
                                       "discount decimal(12,2), tax_amount decimal(12,2), "
                                       "total_bill decimal(12,2), payment_mode string, status string")


def _items(spark, rows):
    return spark.createDataFrame(rows, "order_id long, product_id long, line_no int, qty_sold int, "
                                       "unit_price decimal(12,2), line_total decimal(12,2)")


def test_unsold_product_reports_zero(spark, cats):
    t = bundle(spark, cats, [product_row(1), product_row(2)],
               order_items=_items(spark, [(7, 1, 1, 3, D("10.00"), D("30.00"))]))
    got = {r.product_id: (r.total_units_sold, r.total_revenue, r.order_count)
           for r in sales.product_sales_summary(t).collect()}
    assert got == {1: (3, D("30.00"), 1), 2: (0, D("0.00"), 0)}


def test_empty_day_gives_one_zero_row(spark, cats):
    day = dt.datetime(2001, 7, 30)
    o = _orders(spark, [(1, 5, -1, day, D("100.00"), D("0.00"), D("18.00"), D("118.00"), "cash", "completed")])
    t = bundle(spark, cats, [product_row(1)], sales_orders=o)
    t.orders_in_status = lambda *s: o.filter(F.col("status").isin(*s))
    rows = sales.daily_summary(t, dt.date(2001, 7, 31)).collect()
    assert len(rows) == 1 and rows[0].orders_today == 0 and rows[0].revenue_today == D("0.00")


def test_discount_rule_exactly_at_threshold(spark, cats):
    o = _orders(spark, [
        (1, 5, -1, dt.datetime(2001, 7, 1), D("50000.00"), D("0"), D("0"), D("0"), "cash", "completed"),
        (2, 5, -1, dt.datetime(2001, 7, 1), D("49999.99"), D("0"), D("0"), D("0"), "cash", "completed")])
    items = _items(spark, [(1, 1, 1, 9, D("1.00"), D("9.00")), (2, 1, 1, 10, D("1.00"), D("10.00"))])
    t = bundle(spark, cats, [product_row(1)], sales_orders=o, order_items=items)
    got = {r.order_id: r.discount_pct for r in billing.discount_for_order(t, AS_OF).collect()}
    # order 1: amount exactly 50000 -> 'big' 10 %; order 2: exactly 10 units -> 'bulk' 5 %
    assert got == {1: D("10.00"), 2: D("5.00")}


def test_discount_larger_than_subtotal_goes_negative(spark, cats):
    t = bundle(spark, cats, [product_row(1, price="10.00")])
    lines = spark.createDataFrame([(1, 1, 2, 0)], "order_id long, product_id long, qty int, pos int")
    heads = spark.createDataFrame([(1, 5, D("50.00"), None)],
                                  "order_id long, customer_id long, discount decimal(12,2), payment_mode string")
    r = billing.price_carts(t, lines, heads).collect()[0]
    assert r.subtotal == D("20.00") and r.tax_amount == D("-5.40") and r.total_bill == D("-35.40")
    assert r.payment_mode == "cash"


def test_same_product_twice_sums_demand(spark, cats):
    users = spark.createDataFrame([(5, "c5", "customer", "C", None, True)],
                                  "user_id long, username string, role string, full_name string, "
                                  "phone_no string, is_active boolean")
    t = bundle(spark, cats, [product_row(1, stock=5)], app_user=users)
    items = _items(spark, [(1, 1, 1, 3, D("1"), D("3")), (1, 1, 2, 3, D("1"), D("3"))])
    t.__dict__["order_items"] = items
    from tillwise.sources import derived
    lines = derived.cart_lines(t)
    heads = spark.createDataFrame([(1, 5)], "order_id long, customer_id long")
    r = billing.validate_carts(t, lines, heads, AS_OF).collect()[0]
    assert (r.status, r.reason, r.failing_product_id) == ("rejected", "short_stock", 1)


def _ledger(spark, rows):
    return spark.createDataFrame(rows, "product_id long, change_qty int, reason string, reference_id long, "
                                       "performed_by long, log_time timestamp_ntz, notes string, kind int, "
                                       "line_no int")


def test_low_stock_alert_only_on_crossing(spark, cats):
    ts = dt.datetime(2000, 1, 1)
    led = _ledger(spark, [
        (1, 12, "restock", None, None, ts, None, 0, 0),                       # created at 12
        (1, -2, "sale", 1, -1, ts + dt.timedelta(days=1), None, 2, 1),        # 10: crosses
        (1, -1, "sale", 2, -1, ts + dt.timedelta(days=2), None, 2, 1),        # 9: stays below
        (2, 5, "restock", None, None, ts, None, 0, 0),                        # created low: no alert
        (2, -1, "sale", 3, -1, ts + dt.timedelta(days=1), None, 2, 1),        # 4: already below
    ])
    t = bundle(spark, cats, [product_row(1), product_row(2)])
    run = ledger.running_stock(t, AS_OF, led)
    alerts = ledger.low_stock_alerts(t, AS_OF, run).collect()
    assert [(a.product_id, a.reference_id) for a in alerts] == [(1, 1)]
    assert alerts[0].message == 'Low stock alert: "p1" has only 10 units left. Reorder level: 10'


def test_single_id_lookups_and_status_split(spark, tables_small):
    p = catalog.product_by_id(tables_small, 42).collect()
    assert len(p) == 1 and p[0].product_id == 42 and p[0].category_name
    lines = sales.receipts(tables_small, 3).collect()
    assert lines and {r.order_id for r in lines} == {3}
    from tillwise.sources import derived
    acc, rej = billing.split_status(billing.apply_restocks(tables_small,
                                                           derived.restock_requests(tables_small, AS_OF)))
    assert acc.count() > 0 and rej.filter(F.col("reason").isNull()).count() == 0


def test_search_ignores_case_and_accents(spark, cats):
    prod = spark.createDataFrame(
        [(i, None, n, D("1.00"), 5, 10, None, None, 1, True)
         for i, n in enumerate(["Caf\u00e9 au lait", "CAFE noir", "cafe\u0301 latte", "tea 100%", "tea 1000", "a_b", "axb"])],
        PRODUCT_SCHEMA)
    t = Tables.from_frames(spark, product=prod, category=cats)
    found = lambda q: {r.product_id for r in catalog.product_catalog(t, AS_OF, search=q).collect()}
    assert found("cafe") == found("CAF\u00c9") == {0, 1, 2}
    assert found("100%") == {3} and found("a_b") == {5}   # wildcards are text


def test_nested_receipts_in_bounded_pieces(spark, tables_small):
    flat = [r.asDict() for r in sales.receipts(tables_small).collect()]
    cols = ["line_no", "product_id", "product_name", "qty_sold", "unit_price", "line_total"]
    want = {}
    for r in flat:
        want.setdefault(r["order_id"], []).append(tuple(r[c] for c in cols))
    got = {}
    for r in sorted(sales.nested_receipts(tables_small, piece_lines=2).collect(), key=lambda r: (r.order_id, r.piece)):
        assert 1 <= len(r.lines) <= 2
        got.setdefault(r.order_id, []).extend(r.lines)
    assert {k: sorted(v) for k, v in want.items()} == {k: [tuple(x[c] for c in cols) for x in v] for k, v in got.items()}
    assert all([x.line_seq for x in v] == list(range(1, len(v) + 1)) for v in got.values())
