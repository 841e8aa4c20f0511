"""Every data-quality rule finds the violations planted for it, and no others."""

import datetime as dt
from decimal import Decimal

from tillwise.operators import quality
from tillwise.sources import Tables

AS_OF = dt.date(2001, 8, 1)
DAY = dt.datetime(2001, 7, 1)
#: Rules on tables that the library itself writes: nothing can be planted.
OWN_OUTPUT = {"stock_log.reason domain", "notification.type domain", "stock_log -> product", "notification -> product"}


def dirty_tables(spark):
    category = spark.createDataFrame(
        [(1, "Food"), (2, " FOOD "), (3, None), (4, "x" * 101)], "category_id long, category_name string")
    users = [(1, "ann", "customer", "Ann", "1234567890", True), (2, "ANN ", "customer", "Ann Two", None, True),
             (3, None, "customer", "No Name", None, True), (4, "u" * 51, "ghost", None, "12ab", True),
             (5, "long", "cashier", "f" * 101, "1" * 16, True)]
    user = spark.createDataFrame(users, "user_id long, username string, role string, full_name string, "
                                        "phone_no string, is_active boolean")
    ok = ("c", Decimal("1.00"), 50, 10, None, None, 1, True)
    products = [(1, "b1", "good", Decimal("1.00"), 50, 10, None, None, 1, True),
                (2, "B1 ", None, Decimal("-1.00"), -5, 10, None, None, 1, True),
                (3, "b" * 51, "n" * 151, None, *ok[2:6], None, True), (4, None, "orphan", *ok[1:6], 99, True)]
    product = spark.createDataFrame(
        products, "product_id long, barcode string, name string, price decimal(12,2), stock_qty int, "
                  "reorder_level int, expiry_date date, warning_label string, category_id long, is_active boolean")
    money = [Decimal("5.00")] * 4
    orders = [(1, 1, 5, DAY, *money, "cash", "completed"), (2, None, None, DAY, *money, "gold", "lost"),
              (3, 77, 5, DAY, Decimal("5.00"), Decimal("9.00"), *money[:2], "card", "pending"),
              (4, 1, 88, DAY, *money, None, None)]
    order = spark.createDataFrame(
        orders, "order_id long, customer_id long, cashier_id long, order_date timestamp_ntz, subtotal decimal(12,2), "
                "discount decimal(12,2), tax_amount decimal(12,2), total_bill decimal(12,2), payment_mode string, "
                "status string")
    items = [(1, 1, 1, 2), (2, 1, 1, 0), (3, 66, 1, 1), (55, 1, 1, -1)]
    rows = [(*i, Decimal("1.00"), Decimal("1.00")) for i in items] + [(56, 1, 2, None, None, None)]
    rules = spark.createDataFrame(
        [(1, "ok", 1, Decimal("1.00"), Decimal("1.00"), True, None, None),
         (2, None, 1, Decimal("1.00"), None, True, None, None),
         (3, "r" * 101, 1, Decimal("1.00"), Decimal("1.00"), False, None, None)],
        "rule_id int, rule_name string, min_qty int, min_amount decimal(12,2), discount_pct decimal(5,2), "
        "is_active boolean, valid_from date, valid_to date")
    item = spark.createDataFrame(
        rows,
        "order_id long, product_id long, line_no int, qty_sold int, unit_price decimal(12,2), line_total decimal(12,2)")
    return Tables.from_frames(spark, category=category, app_user=user, product=product, sales_orders=order,
                              order_items=item, discount_rules=rules)


def test_planted_violations_are_counted(spark):
    got = {r.check_name: r.violations for r in quality.data_quality(dirty_tables(spark), AS_OF).collect()}
    want = {
        "product.price >= 0": 1, "product.stock_qty >= 0": 1, "product.name not null": 1, "product.name length": 1,
        "product.barcode length": 1, "product.category_id not null": 1, "user.phone_no ten digits": 2,
        "user.role domain": 1, "user.username not null": 1, "user.username length": 1, "user.full_name not null": 1,
        "user.full_name length": 1, "user.phone_no length": 1, "orders.payment_mode domain": 2,
        "orders.status domain": 2, "orders.discount <= subtotal": 1, "orders.customer_id present": 1,
        "order_items.qty_sold > 0": 2, "category.name not null": 1, "category.name length": 1,
        "category.name unique": 1, "user.username unique": 1, "product.barcode unique": 1, "product -> category": 1,
        "orders -> customer": 1, "orders -> cashier": 1, "order_items -> orders": 2, "order_items -> product": 1,
        "orders have items": 1, "product.price not null": 1, "product.name present": 1, "user.username present": 1,
        "user.full_name present": 1, "orders.cashier_id not null": 1, "order_items.qty_sold not null": 1,
        "order_items.unit_price not null": 1, "rule.name not null": 1, "rule.name length": 1,
        "rule.discount_pct not null": 1}
    assert {n: v for n, v in got.items() if n not in OWN_OUTPUT} == want
    assert set(got) == set(want) | OWN_OUTPUT and all(got[n] == 0 for n in OWN_OUTPUT)


def test_all_checks_are_read_off_one_aggregate(spark, monkeypatch):
    """No check reads a table of its own: no join, and two exchanges in all
    beyond those that make the ledger, the alerts and the categories."""
    t = dirty_tables(spark)
    empty = spark.createDataFrame([], "product_id long, reason string, type string")
    monkeypatch.setattr(quality.ledger, "stock_ledger", lambda *a: empty)
    monkeypatch.setattr(quality.ledger, "running_stock", lambda *a: empty)
    monkeypatch.setattr(quality.ledger, "all_alerts", lambda *a: empty)
    plan = quality.data_quality(t, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
