"""Property tests and stream = batch (5.5)."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillwise.operators import admission, billing, ledger, sales
from tillwise.plans.running import chunked_running_sum
from tillwise.sources import Tables
from tillwise.streaming import reports

AS_OF = dt.date(2001, 8, 1)
CENT = Decimal("0.01")
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

PRODUCT_SCHEMA = ("product_id long, barcode string, name string, price decimal(12,2), stock_qty int, "
                  "reorder_level int, expiry_date date, warning_label string, category_id long, "
                  "is_active boolean")
USER_SCHEMA = "user_id long, username string, role string, full_name string, phone_no string, is_active boolean"
PRICES = [Decimal("1.99"), Decimal("10.00"), Decimal("0.05"), Decimal("333.33"), Decimal("7.50")]

line_st = st.tuples(st.integers(1, 6), st.integers(1, 5), st.integers(1, 40))  # order, product, qty
disc_st = st.decimals(min_value=0, max_value=500, places=2, allow_nan=False, allow_infinity=False)


def _products(spark, stock=None):
    rows = [(p, None, f"p{p}", PRICES[p - 1], (stock or {}).get(p, 0), 10, None, None, 1, True)
            for p in range(1, 6)]
    return spark.createDataFrame(rows, PRODUCT_SCHEMA)


@SETTINGS
@given(lines=st.lists(line_st, min_size=1, max_size=25), discounts=st.lists(disc_st, min_size=6, max_size=6))
def test_bill_total_identity(spark, lines, discounts):
    t = Tables.from_frames(spark, product=_products(spark))
    merged = {}
    for o, p, q in lines:
        merged[(o, p)] = merged.get((o, p), 0) + q
    ldf = spark.createDataFrame([(o, p, q, i) for i, ((o, p), q) in enumerate(sorted(merged.items()))],
                                "order_id long, product_id long, qty int, pos int")
    heads = spark.createDataFrame([(o, 100 + o, discounts[o - 1], None) for o in range(1, 7)],
                                  "order_id long, customer_id long, discount decimal(12,2), payment_mode string")
    got = {r.order_id: r for r in billing.price_carts(t, ldf, heads).collect()}
    for o in {o for o, _ in merged}:
        sub = sum(PRICES[p - 1] * q for (oo, p), q in merged.items() if oo == o)
        net = sub - discounts[o - 1]
        tax = (net * Decimal("0.18")).quantize(CENT, rounding=ROUND_HALF_UP)
        r = got[o]
        assert r.subtotal == sub and r.tax_amount == tax and r.total_bill == net + tax
        assert r.total_bill == r.subtotal - r.discount + r.tax_amount


def _replay(orders, lines, opening):
    stock = dict(opening)
    out = {}
    for o in sorted(orders, key=lambda k: (orders[k], k)):
        items = [(p, q) for (oo, p), q in lines.items() if oo == o]
        if all(stock.get(p, 0) >= q for p, q in items):
            for p, q in items:
                stock[p] -= q
                assert stock[p] >= 0
            out[o] = "accepted"
        else:
            out[o] = "rejected"
    return out


@SETTINGS
@given(lines=st.lists(line_st, min_size=1, max_size=30),
       days=st.lists(st.integers(0, 3), min_size=6, max_size=6),
       opening=st.lists(st.integers(0, 60), min_size=5, max_size=5))
def test_admission_equals_replay_on_random_batches(spark, lines, days, opening):
    users = spark.createDataFrame([(100 + o, f"c{o}", "customer", f"C{o}", None, True) for o in range(1, 7)],
                                  USER_SCHEMA)
    t = Tables.from_frames(spark, product=_products(spark), app_user=users)
    merged = {}
    for o, p, q in lines:
        merged[(o, p)] = merged.get((o, p), 0) + q
    orders = {o: dt.datetime(2001, 7, 1) + dt.timedelta(days=days[o - 1]) for o, _ in merged}
    ldf = spark.createDataFrame([(o, p, q, i) for i, ((o, p), q) in enumerate(sorted(merged.items()))],
                                "order_id long, product_id long, qty int, pos int")
    heads = spark.createDataFrame([(o, 100 + o, -1, orders[o], "cash", Decimal(0)) for o in orders],
                                  "order_id long, customer_id long, cashier_id long, order_date timestamp_ntz, "
                                  "payment_mode string, discount decimal(12,2)")
    open_df = spark.createDataFrame([(p, opening[p - 1]) for p in range(1, 6)], "product_id long, opening_qty int")
    no_restocks = spark.createDataFrame([], "product_id long, qty int, request_ts timestamp_ntz")
    got = {r.order_id: r.decision for r in admission.bill_batch(t, ldf, heads, open_df, no_restocks).collect()}
    assert got == _replay(orders, merged, {p: opening[p - 1] for p in range(1, 6)})


def test_running_sum_with_one_hot_key_equals_plain_window(spark):
    # product 1 holds ~90 % of the rows, spread over 60 days
    rows = spark.range(0, 20000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7 + 2).otherwise(1).alias("product_id"),
        (F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz")
         + F.make_dt_interval(F.col("id") % 60, F.col("id") % 24)).alias("ts"),
        F.col("id").alias("seq"), ((F.col("id") * 7919) % 13 - 6).alias("v"))
    got = chunked_running_sum(rows, "product_id", F.to_date("ts"), [F.col("ts"), F.col("seq")],
                              {"run": F.col("v")})
    w = Window.partitionBy("product_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("run", F.sum("v").over(w))
    cols = ["product_id", "seq", "run"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert want.select(cols).exceptAll(got.select(cols)).count() == 0


def test_ledger_final_stock_equals_ledger_sum(spark, tables_small):
    run = ledger.running_stock(tables_small, AS_OF)
    last = (run.groupBy("product_id").agg(
        F.max_by("stock_after", F.struct("log_time", "kind", "reference_id", "line_no", "change_qty")).alias("last")))
    rec = ledger.ledger_reconcile(tables_small, AS_OF).select("product_id", "ledger_qty")
    bad = last.join(rec, "product_id").filter(F.col("last") != F.col("ledger_qty"))
    assert bad.count() == 0


def test_stream_low_stock_equals_batch_when_rows_come_late(spark):
    products = _products(spark)
    t = Tables.from_frames(spark, product=products)
    day = dt.datetime(1996, 1, 1)
    late = dt.datetime(2001, 6, 1)
    rows = [(1, 20, day, 1, None, 0, day), (1, -9, day + dt.timedelta(days=9), 2, 7, 0, day + dt.timedelta(days=400)),
            (1, -5, day + dt.timedelta(days=20), 2, 8, 0, day + dt.timedelta(days=800)),
            (2, 30, day, 1, None, 0, day), (2, -12, day + dt.timedelta(days=5), 2, 9, 0, day + dt.timedelta(days=5)),
            (2, -9, day + dt.timedelta(days=6), 2, 10, 1, day + dt.timedelta(days=1200)),
            # arrive last, belong early: they move and undo crossings
            (1, -2, day + dt.timedelta(days=1), 2, 6, 0, late), (2, 50, day + dt.timedelta(days=2), 1, None, 0, late)]
    led = spark.createDataFrame(
        rows, "product_id long, change_qty int, log_time timestamp_ntz, kind int, reference_id long, line_no int, "
              "arrival timestamp_ntz")
    got = reports.stream_low_stock(t, AS_OF, led, "arrival")
    want = ledger.low_stock_alerts(t, AS_OF, ledger.running_stock(t, AS_OF, led))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) != []


def test_stream_low_stock_equals_batch(spark, tables_small):
    s = reports.stream_low_stock(tables_small, AS_OF)
    b = ledger.low_stock_alerts(tables_small, AS_OF)
    assert s.count() == b.count() > 0
    assert s.exceptAll(b.select(s.columns)).count() == 0


def test_stream_category_revenue_equals_batch(spark, tables_small):
    from tillwise.operators import sales
    s = reports.stream_category_revenue(tables_small)
    b = sales.revenue_by_category(tables_small)
    assert sorted(s.collect()) == sorted(b.select(s.columns).collect())


def test_hot_cart_round_trips_through_bounded_pieces(spark):
    from tillwise.sources import derived
    n = 2500  # one order far larger than a JSON piece
    items = spark.range(0, n).select(
        F.lit(7).cast("long").alias("order_id"), (F.col("id") * 3 + 1).alias("product_id"),
        (F.col("id") % 4 + 1).cast("int").alias("line_no"), F.lit(2).alias("qty_sold"),
        F.lit(Decimal("1.00")).alias("unit_price"), F.lit(Decimal("2.00")).alias("line_total"))
    orders = spark.createDataFrame([(7,)], "order_id long")
    t = Tables.from_frames(spark, order_items=items, sales_orders=orders)
    js = derived.cart_json(t)
    assert js.count() == -(-n // derived.CART_PIECE)
    parsed = {(r.pos, r.product_id) for r in billing.parse_carts(js).collect()}
    lines = {(r.pos, r.product_id) for r in derived.cart_lines(t).collect()}
    assert parsed == lines and len(lines) == n
    assert sorted(p for p, _ in lines) == list(range(n))


def test_daily_watermark_drops_late_orders(spark):
    from tillwise.session import scratch_path
    from tillwise.streaming.feed import batch_sink, run_as_feed
    base = dt.datetime(2001, 1, 1)
    rows = [(i, 1, base + dt.timedelta(days=i), Decimal("10.00"), Decimal("1.00"), Decimal("0.00"), "completed")
            for i in range(6)]
    rows.append((99, 2, base, Decimal("5.00"), Decimal("0.50"), Decimal("0.00"), "completed"))  # late
    cols = ("order_id long, customer_id long, order_date timestamp_ntz, total_bill decimal(12,2), "
            "tax_amount decimal(12,2), discount decimal(12,2), status string")
    df = spark.createDataFrame(rows, cols).withColumn(
        "arrival", F.when(F.col("order_id") == 99, F.lit(dt.datetime(2001, 2, 1)))
                    .otherwise(F.col("order_date")).cast("timestamp_ntz"))
    sink = scratch_path(spark, "late-sink")
    run_as_feed(spark, df, "arrival",
                lambda s: reports.daily_sales_stream(s.drop("arrival")).writeStream.outputMode("update")
                .foreachBatch(batch_sink(sink)), "late", bounds=[dt.datetime(2001, 1, 20)])
    out = spark.read.parquet(sink)
    assert out.filter(F.col("customer_id") == 2).count() == 0      # dropped: older than watermark
    assert out.select("day").distinct().count() == 6


def test_daily_counts_late_and_timeless_orders(spark):
    base, arrived = dt.datetime(1998, 6, 1), dt.datetime(2001, 2, 1)
    money = (Decimal("10.00"), Decimal("1.00"), Decimal("0.00"))
    rows = [(i, 1, base + dt.timedelta(days=i), *money, "completed", base + dt.timedelta(days=i)) for i in range(6)]
    rows += [(99, 2, base, *money, "completed", arrived), (98, 2, base, *money, "pending", arrived)]
    rows += [(100 + i, 3, None, *money, "completed", None if i else arrived) for i in range(2)]
    orders = spark.createDataFrame(rows, "order_id long, customer_id long, order_date timestamp_ntz, "
                                         "total_bill decimal(12,2), tax_amount decimal(12,2), discount decimal(12,2), "
                                         "status string, arrival timestamp_ntz")
    t = Tables.from_frames(spark, sales_orders=orders)
    got = reports.stream_daily_counts(t, "arrival").first().asDict()
    assert got == {"rows_in": 9, "counted": 6, "late": 1, "without_time": 2}
    assert reports.stream_daily_sales(t, "arrival").agg(F.sum("orders_today")).first()[0] == 6


def test_streams_keep_rows_without_a_time(spark):
    orders = Tables.from_dir(spark, SF_SMALL).raw("orders")
    orders = orders.withColumn("o_orderdate", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")))
    t = Tables.from_frames(spark, root=SF_SMALL, raw={"orders": orders})
    stream, batch = reports.stream_category_revenue(t), sales.revenue_by_category(t)
    assert sorted(stream.select("category_name", "units").collect()) == sorted(batch.select("category_name", "units").collect())
    rows = [(1, 30, None, 0, None, 0), (1, -15, None, 2, 5, 0), (1, -6, dt.datetime(2000, 1, 1), 2, 6, 0),
            (1, 20, dt.datetime(2000, 5, 1), 1, None, 0), (1, -25, dt.datetime(2000, 5, 2), 2, 7, 0)]
    led = spark.createDataFrame(rows, "product_id long, change_qty int, log_time timestamp_ntz, kind int, "
                                      "reference_id long, line_no int")
    products = spark.createDataFrame([(1, "p", 10)], "product_id long, name string, reorder_level int")
    one = Tables.from_frames(spark, product_base=products)
    from tillwise.operators import ledger as L
    want = L.low_stock_alerts(one, AS_OF, L.running_stock(one, AS_OF, led))
    got = reports.stream_low_stock(one, AS_OF, led)
    assert sorted(got.collect()) == sorted(want.select(got.columns).collect()) and got.count() == 2


def test_range_chunks_split_a_hot_key_day(spark):
    from tillwise.plans.running import assign_range_chunks
    # product 1 holds ~90 % of the rows, all at the same instant
    rows = spark.range(0, 20000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 7 + 2).otherwise(1).alias("product_id"),
        F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("seq"), ((F.col("id") * 7919) % 13 - 6).alias("v"))
    order = [F.col("ts"), F.col("seq")]
    tagged = assign_range_chunks(rows, "product_id", order, partitions=8)
    hot_chunks = tagged.filter("product_id = 1").select("_rchunk").distinct().count()
    assert hot_chunks >= 4
    got = chunked_running_sum(tagged, "product_id", F.col("_rchunk"), order, {"run": F.col("v")})
    w = Window.partitionBy("product_id").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    want = rows.withColumn("run", F.sum("v").over(w))
    cols = ["product_id", "seq", "run"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert got.count() == want.count()


def test_day_windows_do_not_depend_on_session_time_zone(spark):
    from tillwise.functions.scalar import instant_day, wall_clock_instant
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ["UTC", "America/New_York", "Asia/Kolkata"]:
            spark.conf.set("spark.sql.session.timeZone", tz)
            df = spark.createDataFrame([("2001-01-05 00:00:00",), ("2001-01-05 23:59:59",)], "s string") \
                      .select(F.col("s").cast("timestamp_ntz").alias("ts"))
            w = df.select(F.window(wall_clock_instant(F.col("ts")), "1 day").alias("w"))
            days = {r.d for r in w.select(instant_day(F.col("w.start")).alias("d")).collect()}
            assert days == {dt.date(2001, 1, 5)}, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)


def test_chained_daily_rows_come_once_and_whole(spark):
    """The chained stream closes every day once: late orders and orders without
    a time are in none, and the row that closes the feed makes no day."""
    base, arrived = dt.datetime(1998, 6, 1, 23, 59), dt.datetime(2001, 2, 1)
    money = (Decimal("10.00"), Decimal("1.00"), Decimal("0.50"))
    rows = [(10 * i + k, 1 + k % 2, base + dt.timedelta(days=2 * i), *money, "completed", base + dt.timedelta(days=2 * i))
            for i in range(6) for k in range(3)]
    rows += [(99, 9, base, *money, "completed", arrived), (98, 9, base, *money, "pending", arrived),
             (97, None, base + dt.timedelta(days=10), *money, "completed", arrived), (96, 3, None, *money, "completed", None)]
    orders = spark.createDataFrame(rows, "order_id long, customer_id long, order_date timestamp_ntz, "
                                         "total_bill decimal(12,2), tax_amount decimal(12,2), discount decimal(12,2), "
                                         "status string, arrival timestamp_ntz")
    got = reports.stream_daily_rows(Tables.from_frames(spark, sales_orders=orders), "arrival").collect()
    days = [(base + dt.timedelta(days=2 * i)).date() for i in range(6)]
    assert sorted(r.day for r in got) == days
    # the last day also has an order without a customer
    assert {r.day: (r.orders_today, r.revenue_today, r.unique_customers_today) for r in got} == {
        d: (3 + (d == days[-1]), Decimal("30.00") + 10 * (d == days[-1]), 2) for d in days}
    none = Tables.from_frames(spark, sales_orders=orders.filter("false"))
    assert reports.stream_daily_rows(none).count() == 0
