"""B-3 sequential admission: the set-based fixpoint equals a plain replay.

The replay below is the test oracle only (one order at a time, in time
order); the engine never runs it.
"""

import datetime as dt

import pytest

from tillwise import oracle as O
from tillwise.operators import admission
from tillwise.sources import Tables


def replay(con):
    lines = con.sql(O.sql("SELECT order_id, product_id, qty, pos FROM cart_lines", "carts")).fetchall()
    heads = con.sql(O.sql("SELECT order_id, customer_id, order_date FROM sales_orders")).fetchall()
    prods = dict(con.sql(O.sql("SELECT product_id, expiry_date FROM product")).fetchall())
    custs = {r[0] for r in con.sql(O.sql("SELECT user_id FROM app_user WHERE role = 'customer'")).fetchall()}
    stock = dict(con.sql(O.sql("SELECT product_id, opening_qty FROM opening_stock", "ledger")).fetchall())
    rest = sorted(con.sql(O.sql("SELECT request_ts, product_id, qty FROM restocks_checked "
                                "WHERE status = 'accepted'", "ledger")).fetchall())
    by_order = {}
    for o, p, q, pos in lines:
        by_order.setdefault(o, []).append((pos, p, q))
    out, ri = {}, 0
    for o, cust, day in sorted(heads, key=lambda h: (h[2], h[0])):
        while ri < len(rest) and rest[ri][0] <= day:
            stock[rest[ri][1]] = stock.get(rest[ri][1], 0) + rest[ri][2]
            ri += 1
        items = sorted(by_order.get(o, []))
        if cust is None or not items:
            out[o] = ("rejected", "missing_input")
            continue
        if cust not in custs:
            out[o] = ("rejected", "no_customer")
            continue
        reason = None
        for _, p, q in items:
            if p not in prods:
                reason = "unknown_product"
            elif prods[p] is not None and prods[p] < day.date():
                reason = "expired"
            if reason:
                break
        if reason is None and any(stock.get(p, 0) < q for _, p, q in items):
            reason = "short_stock"
        if reason:
            out[o] = ("rejected", reason)
            continue
        for _, p, q in items:
            stock[p] -= q
        out[o] = ("accepted", None)
    return out


@pytest.mark.parametrize("sf,few", [("/root/testdata/sf0.001", 400_000), ("/root/testdata/sf0.001", 1500),
                                    ("/root/testdata/sf0.01", 20_000)])
def test_bill_batch_equals_sequential_replay(spark, sf, few, monkeypatch):
    """With the residue replayed at once, and with rounds until few lines are left."""
    from tests.oracle_compare import duck
    monkeypatch.setattr(admission, "REPLAY_LINES", few)
    expected = replay(duck(sf))
    t = Tables.from_dir(spark, sf)
    got = {r.order_id: (r.decision, r.reason)
           for r in admission.bill_fixture_batch(t, dt.date(2001, 8, 1)).collect()}
    assert len(got) == len(expected)
    diff = [(o, got[o], expected[o]) for o in expected if got.get(o) != expected[o]]
    assert not diff, diff[:10]
    accepted = sum(1 for v in expected.values() if v[0] == "accepted")
    assert 0 < accepted < len(expected)


def test_admitted_ledger_never_goes_negative(spark):
    from pyspark.sql import functions as F

    from tillwise.operators import ledger
    t = Tables.from_dir(spark, "/root/testdata/sf0.001")
    out = admission.bill_batch_outputs(t, dt.date(2001, 8, 1))
    run = ledger.running_stock(t, dt.date(2001, 8, 1), out["ledger"])
    assert run.filter(F.col("stock_after") < 0).count() == 0
    sales = out["ledger"].filter(F.col("reason") == "sale").agg(F.sum("change_qty")).first()[0]
    sold = out["items"].agg(F.sum("qty_sold")).first()[0]
    assert sales == -sold
    n_acc = out["orders"].count()
    assert n_acc > 0 and n_acc + out["rejected"].count() == 1500


def test_commit_outputs_can_be_repeated(spark):
    from tillwise.session import scratch_path
    t = Tables.from_dir(spark, "/root/testdata/sf0.001")
    out = admission.bill_batch_outputs(t, dt.date(2001, 8, 1))
    root = scratch_path(spark, "commit")
    admission.commit_outputs(out, root, batch_id=7)
    paths = admission.commit_outputs(out, root, batch_id=7)  # a retry
    for name in ("orders", "items", "ledger", "rejected"):
        back = spark.read.parquet(paths[name])
        assert ("month" in back.columns) == (name != "rejected")
        assert back.count() == out[name].count()
    admission.commit_outputs({n: x.limit(1) for n, x in out.items()}, root, batch_id=8)
    assert spark.read.parquet(paths["orders"]).count() == out["orders"].count() + 1


def test_chain_of_orders_equals_replay(spark):
    """Each order shares one product with the next: one decision a round."""
    from decimal import Decimal

    n = 6
    users = spark.createDataFrame([(100 + o, f"c{o}", "customer", f"C{o}", None, True) for o in range(n)],
                                  "user_id long, username string, role string, full_name string, phone_no string, "
                                  "is_active boolean")
    products = spark.createDataFrame([(p, None) for p in range(n + 1)], "product_id long, expiry_date date").selectExpr(
        "*", "'p' as name", "0 as stock_qty", "1L as category_id")
    t = Tables.from_frames(spark, product=products, app_user=users)
    lines = spark.createDataFrame([(o, o + k, 6, k) for o in range(n) for k in (0, 1)],
                                  "order_id long, product_id long, qty int, pos int")
    heads = spark.createDataFrame([(o, 100 + o, -1, dt.datetime(2001, 1, 1 + o), "cash", Decimal(0)) for o in range(n)],
                                  "order_id long, customer_id long, cashier_id long, order_date timestamp_ntz, "
                                  "payment_mode string, discount decimal(12,2)")
    opening = spark.createDataFrame([(p, 10) for p in range(n + 1)], "product_id long, opening_qty int")
    none = spark.createDataFrame([], "product_id long, qty int, request_ts timestamp_ntz")
    got = {r.order_id: r for r in admission.bill_batch(t, lines, heads, opening, none).collect()}
    # 0 takes products 0 and 1; 1 finds 4 of product 1 left; 2 is free again, and so on
    assert [got[o].decision for o in range(n)] == ["accepted", "rejected"] * (n // 2)
    assert [(got[o].failing_product_id, got[o].available) for o in (1, 3, 5)] == [(1, 4), (3, 4), (5, 4)]


def chains(spark, n_chains, length):
    """Chains of orders, each sharing one product with the next: a round
    decides one order of each chain."""
    from decimal import Decimal
    orders = [(c * length + i, c * (length + 1) + i) for c in range(n_chains) for i in range(length)]
    n = len(orders)
    users = spark.range(n).selectExpr("id as user_id", "concat('c', id) as username", "'customer' as role",
                                      "'C' as full_name", "cast(null as string) as phone_no", "true as is_active")
    products = spark.range(n_chains * (length + 1)).selectExpr(
        "id as product_id", "cast(null as date) as expiry_date", "'p' as name", "0 as stock_qty", "1L as category_id")
    t = Tables.from_frames(spark, product=products, app_user=users)
    lines = spark.createDataFrame([(o, p + k, 6, k) for o, p in orders for k in (0, 1)],
                                  "order_id long, product_id long, qty int, pos int")
    start = dt.datetime(2001, 1, 1)
    heads = spark.createDataFrame([(o, o, -1, start + dt.timedelta(minutes=o % length), "cash", Decimal(0)) for o, _ in orders],
                                  "order_id long, customer_id long, cashier_id long, order_date timestamp_ntz, "
                                  "payment_mode string, discount decimal(12,2)")
    opening = spark.range(n_chains * (length + 1)).selectExpr("id as product_id", "10 as opening_qty")
    none = spark.createDataFrame([], "product_id long, qty int, request_ts timestamp_ntz")
    return {r.order_id: r for r in admission.bill_batch(t, lines, heads, opening, none).collect()}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """40 chains of 30 orders, more lines than one task may replay: label
    spreading closes every chain, and the chains are replayed side by side."""
    monkeypatch.setattr(admission, "REPLAY_LINES", 100)
    got = chains(spark, 40, 30)
    assert [got[o].decision for o in range(1200)] == ["accepted", "rejected"] * 600
    assert max(r.decided_round for r in got.values()) <= 4


def test_a_changed_table_is_decided_anew(spark, tmp_path):
    """The stored outcome belongs to the files' version: the same session
    gives new answers once a table is written again."""
    from tillwise.operators import ledger
    day, root = dt.date(2001, 8, 1), str(tmp_path / "sf")
    raw = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in admission.BATCH_TABLES}
    for name, frame in raw.items():
        frame.write.parquet(f"{root}/{name}.parquet")
    sale = "reason = 'sale'"
    first = ledger.stock_ledger(Tables.from_dir(spark, root), day).filter(sale).count()
    again = admission.store_batch(Tables.from_dir(spark, root), day)
    assert again == admission.store_batch(Tables.from_dir(spark, root), day)
    raw["lineitem"].filter("l_orderkey % 4 = 0").write.mode("overwrite").parquet(f"{root}/lineitem.parquet")
    later = ledger.stock_ledger(Tables.from_dir(spark, root), day).filter(sale)
    assert 0 < later.count() < first / 2
    assert later.filter("reference_id % 4 <> 0").count() == 0
    assert admission.store_batch(Tables.from_dir(spark, root), day) != again


def test_hot_product_is_spread_over_tasks(spark):
    """A product with 90 % of the lines lies in many chunks, and the round
    neither joins nor windows by the product alone over its lines."""
    lines = spark.range(20_000).selectExpr(
        "id as order_id", "if(id % 10 = 0, id % 7 + 2, 1) as product_id", "1 as qty", "id as _cart",
        "timestamp_ntz'2001-01-01' + make_interval(0, 0, 0, cast(id % 300 as int)) as order_date", "5L as supply",
        "'U' as state", "cast(null as int) as decided_round")
    from pyspark.sql import functions as F

    from tillwise.plans.running import assign_range_chunks
    seq = [F.col("order_date"), F.col("order_id")]
    work = assign_range_chunks(lines, "product_id", seq)
    assert work.filter("product_id = 1").select("_rchunk").distinct().count() >= 6
    plan = admission._open_lines(work.repartition("product_id", "_rchunk"), seq)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
