"""Lines lie where checks, rounds and running sums need them."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillwise.operators import admission, ledger
from tillwise.plans.lineage import deal_out, drop_tables
from tillwise.plans.running import chunked_running_sum, hot_keys, mark_cold
from tillwise.sources import Tables


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_rounds_first_sums_move_no_line(spark, tmp_path):
    lines = spark.range(4000).selectExpr(
        "id as order_id", "id % 50 as product_id", "-1 as _rchunk", "1 as qty", "5L as supply", "'U' as state",
        "timestamp_ntz'2001-01-01' + make_interval(0, 0, 0, cast(id % 300 as int)) as order_date")
    tables = []
    dealt = deal_out(lines, str(tmp_path / "lines"), ["product_id", "_rchunk"], tables)
    got = admission._open_lines(dealt, [F.col("order_date"), F.col("order_id")], whole=True)
    assert "Exchange" not in _plan(got)
    upto = Window.partitionBy("product_id").orderBy("order_date", "order_id").rowsBetween(Window.unboundedPreceding, -1)
    want = lines.withColumn("upper", F.coalesce(F.sum("qty").over(upto), F.lit(0)))
    assert got.select("order_id", "upper").exceptAll(want.select("order_id", "upper")).count() == 0
    drop_tables(spark, tables)
    assert not spark.catalog.tableExists(tables[0])


def test_cold_products_take_one_shuffle(spark):
    rows = spark.range(8000).selectExpr("id % 900 as k", "id as seq", "id % 13 as v")
    hot = hot_keys(rows.select("k"), "k")
    assert hot.count() == 0
    run = chunked_running_sum(mark_cold(rows, "k", hot), "k", F.col("_rchunk"), [F.col("seq")], {"run": F.col("v")}, whole=True)
    assert _plan(run).count("Exchange hashpartitioning") == 1


def test_running_stock_cuts_hot_products_only(spark, monkeypatch):
    cut, plain = [], ledger.assign_range_chunks

    def spy(df, *args, **kw):
        cut.append({r.product_id for r in df.select("product_id").distinct().collect()})
        return plain(df, *args, **kw)

    monkeypatch.setattr(ledger, "assign_range_chunks", spy)
    led = spark.range(9000).selectExpr(
        "if(id % 3 = 0, 1L, if(id = 5, null, id % 700 + 2)) as product_id", "cast(id % 11 - 4 as int) as change_qty",
        "timestamp_ntz'2001-01-01' + make_interval(0, 0, 0, cast(id % 40 as int)) as log_time",
        "cast(id % 3 as int) as kind", "id as reference_id", "0 as line_no")
    got = ledger.running_stock(Tables.from_frames(spark), dt.date(2001, 8, 1), led)
    assert cut == [{1}]
    order = Window.partitionBy("product_id").orderBy(*[F.col(c).asc_nulls_first() for c in ledger.LEDGER_ORDER]).rowsBetween(
        Window.unboundedPreceding, 0)
    want = led.filter("product_id is not null").withColumn("stock_after", F.sum("change_qty").over(order))
    cols = ["product_id", "reference_id", "stock_after"]
    assert got.count() == want.count() == 8999
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_products_of_both_kinds_are_admitted_like_a_replay(spark):
    """Hot product 1 lies in ranges, the others whole; each order has a line of both."""
    n = 600
    lines = spark.range(2 * n).selectExpr("id div 2 as order_id", "if(id % 2 = 0, 1L, id div 2 % 150 + 2) as product_id",
                                          "1 as qty", "id % 2 as first_line", "cast(id % 2 as int) as pos")
    heads = spark.range(n).selectExpr("id as order_id", "1L as customer_id", "timestamp_ntz'2001-01-01' + "
                                      "make_interval(0, 0, 0, cast(id as int)) as order_date")
    product = spark.range(1, 152).selectExpr("id as product_id", "'p' as name", "1.00 as price", "0 as stock_qty",
                                             "cast(null as date) as expiry_date", "true as is_active", "1L as category_id")
    users = spark.sql("select 1L as user_id, 'customer' as role")
    opening = product.selectExpr("product_id", "if(product_id = 1, 250L, 2L) as opening_qty")
    restocks = spark.sql("select 1L as product_id, 20 as qty, timestamp_ntz'2001-10-01' as request_ts")
    t = Tables.from_frames(spark, product=product, app_user=users)
    got = {r.order_id: r for r in admission.bill_batch(t, lines.localCheckpoint(), heads, opening, restocks).collect()}
    left = {r.product_id: r.opening_qty for r in opening.collect()}
    for o in range(n):
        if dt.date(2001, 1, 1) + dt.timedelta(days=o) == dt.date(2001, 10, 1):
            left[1] += 20
        short = [p for p in (1, o % 150 + 2) if left[p] < 1]
        assert got[o].decision == ("rejected" if short else "accepted")
        if short:
            assert (got[o].failing_product_id, got[o].available) == (short[0], left[short[0]])
        else:
            left[1] -= 1
            left[o % 150 + 2] -= 1
