import datetime as dt

from tillwise.operators import ledger
from tillwise.session import scratch_path
from tillwise.sources import sinks
from tillwise.sources.views import register_views

AS_OF = dt.date(2001, 8, 1)


def test_append_facts_partitions_by_month_and_appends(spark, tables_small):
    path = scratch_path(spark, "facts")
    led = ledger.stock_ledger(tables_small, AS_OF)
    sinks.append_facts(led, path, "log_time", sort_by="product_id")
    sinks.append_facts(led, path, "log_time", sort_by="product_id")
    back = spark.read.parquet(path)
    assert back.count() == 2 * led.count()
    assert "month" in back.columns
    pruned = back.filter("month = '2001-07'")
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2001-07" in plan


def test_snapshots_are_versioned(spark, tables_small):
    base = scratch_path(spark, "snap")
    p = tables_small.product
    sinks.write_snapshot(p, base, 1)
    sinks.write_snapshot(p.limit(3), base, 2)
    assert sinks.read_snapshot(spark, base, 1).count() == p.count()
    assert sinks.read_snapshot(spark, base, 2).count() == 3


def test_views_answer_sql(spark, tables_small):
    names = register_views(tables_small, AS_OF, dt.date(2001, 7, 31))
    assert "vw_cashier_products" in names
    n = spark.sql("SELECT count(*) FROM vw_cashier_products WHERE days_to_expiry IS NULL").first()[0]
    assert n > 0
    top = spark.sql("SELECT name FROM vw_highest_ticket_items LIMIT 10").count()
    assert top == 10


def test_report_views_equal_their_operators(spark, tables_small):
    from tillwise.operators import catalog, sales
    day = dt.date(2001, 7, 31)
    register_views(tables_small, AS_OF, day)
    pairs = {
        "vw_cashier_products": catalog.sellable_products(tables_small, AS_OF),
        "vw_product_sales_summary": sales.product_sales_summary(tables_small),
        "vw_expiry_alerts": catalog.expiry_alerts(tables_small, AS_OF),
        "vw_daily_summary": sales.daily_summary(tables_small, day),
        "vw_highest_ticket_items": sales.highest_ticket_items(tables_small),
        "vw_customer_history": sales.customer_history(tables_small),
    }
    for view, df in pairs.items():
        via_sql = spark.sql(f"SELECT * FROM {view}")
        assert via_sql.columns == df.columns, view
        assert sorted(via_sql.collect()) == sorted(df.collect()), view


def test_sql_functions_equal_the_operators(spark, tables_small):
    from tillwise.operators import sales
    from tillwise.sources.views import register_functions
    assert register_functions(tables_small, AS_OF) == ["category_report", "best_discount"]
    a, b = dt.date(2000, 1, 1), dt.date(2000, 12, 31)
    via_sql = spark.sql("SELECT * FROM category_report(DATE'2000-01-01', DATE'2000-12-31')")
    want = sales.category_report(tables_small, a, b)
    assert via_sql.columns == want.columns and via_sql.dtypes == want.dtypes
    assert sorted(via_sql.collect()) == sorted(want.collect()) and want.count() > 0
    got = spark.sql("SELECT best_discount(10, 5), best_discount(1, 50000), best_discount(1, 49999.99), "
                    "best_discount(12, 200000), best_discount(0, 0)").first()
    assert [str(v) for v in got] == ["5.00", "10.00", "0.00", "15.00", "0.00"]
