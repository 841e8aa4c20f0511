"""The checkout from batch to batch: batches cut along the time equal one run."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tillwise.operators import admission, carry
from tillwise.session import scratch_path
from tillwise.sources import Tables, sinks

DAY = dt.datetime(2001, 1, 1)
HEAD = ("order_id long, customer_id long, cashier_id long, order_date timestamp_ntz, payment_mode string, "
        "discount decimal(12,2)")
RESTOCK = "product_id long, qty int, request_ts timestamp_ntz"


def shop(spark, orders, lines, opening, restocks):
    """``orders``: (id, hour or None); ``lines``: (order, product, qty); ``restocks``: (product, qty, hour)."""
    def at(hour):
        return None if hour is None else DAY + dt.timedelta(hours=hour)
    users = spark.range(1, 2).selectExpr("id as user_id", "'c' as username", "'customer' as role", "'C' as full_name",
                                         "cast(null as string) as phone_no", "true as is_active")
    products = spark.range(20).selectExpr("id as product_id", "cast(null as date) as expiry_date", "'p' as name",
                                          "0 as stock_qty", "1L as category_id")
    t = Tables.from_frames(spark, product=products, app_user=users)
    pos = {}
    rows = [(o, p, q, pos.setdefault(o, []).append(p) or len(pos[o]) - 1) for o, p, q in lines]
    return (t, spark.createDataFrame(rows, "order_id long, product_id long, qty int, pos int"),
            spark.createDataFrame([(o, 1, -1, at(h), "cash", Decimal(0)) for o, h in orders], HEAD),
            spark.createDataFrame(list(opening.items()), "product_id long, opening_qty int"),
            spark.createDataFrame([(p, q, at(h)) for p, q, h in restocks], RESTOCK))


def decided(frame):
    return {r.order_id: (r.decision, r.reason, r.failing_product_id, r.available) for r in frame.collect()}


def in_batches(t, base, lines, heads, opening, restocks, cuts):
    edges = [None, *[DAY + dt.timedelta(hours=h) for h in cuts], None]
    for batch, (lo, hi) in enumerate(zip(edges, edges[1:])):
        def part(df, time):
            low = "true" if lo is None else f"{time} >= timestamp_ntz'{lo}'"
            high = "true" if hi is None else f"{time} < timestamp_ntz'{hi}'"
            return df.filter(f"{low} and {high}")
        own = part(heads, "order_date")
        carry.commit_batch(t, base, batch, lines.join(own.select("order_id"), "order_id", "left_semi"), own, opening,
                           part(restocks, "request_ts"))


@pytest.mark.parametrize("seed,cuts", [(1, [30]), (2, [10, 10, 47])])
def test_batches_equal_one_run(spark, seed, cuts):
    """Orders and restocks at the same instants, an empty batch among them."""
    rng = random.Random(seed)
    orders = [(o, rng.randrange(60)) for o in range(150)]
    lines = [(o, p, rng.randint(1, 6)) for o, _ in orders for p in rng.sample(range(12), rng.randint(1, 3))]
    restocks = [(rng.randrange(12), rng.randint(1, 20), rng.randrange(70)) for _ in range(25)]
    t, *frames = shop(spark, orders, lines, {p: 15 for p in range(12)}, restocks)
    one = decided(admission.bill_batch(t, *frames))
    base = scratch_path(spark, "carry-test")
    in_batches(t, base, *frames, cuts)
    assert decided(carry.all_decisions(spark, base)) == one
    assert {d[0] for d in one.values()} == {"accepted", "rejected"}
    left = {p: 15 for p in range(12)}
    for p, q, _ in restocks:
        left[p] += q
    for o, p, q in lines:
        left[p] -= q if one[o][0] == "accepted" else 0
    assert {r.product_id: r.stock_qty for r in carry.stock_on_hand(spark, base).collect()} == left


def test_a_failed_batch_shows_nothing_and_is_retried(spark, monkeypatch):
    t, lines, heads, opening, none = shop(spark, [(1, 1), (2, 5)], [(1, 0, 6), (2, 0, 6)], {0: 10}, [])
    base = scratch_path(spark, "carry-test")
    first, second = heads.filter("order_id = 1"), heads.filter("order_id = 2")

    def commit(batch, own):
        carry.commit_batch(t, base, batch, lines.join(own.select("order_id"), "order_id", "left_semi"), own, opening, none)

    commit(0, first)
    write = sinks.write_snapshot
    with monkeypatch.context() as m:
        def fail(df, path, version):
            if path.endswith(carry.PENDING):
                raise OSError("lost")
            return write(df, path, version)
        m.setattr(sinks, "write_snapshot", fail)
        with pytest.raises(OSError):
            commit(1, second)
    assert sinks.published_versions(spark, base) == [0]
    assert decided(carry.all_decisions(spark, base)) == {1: ("accepted", None, None, None)}
    with pytest.raises(ValueError):
        commit(2, second)
    for _ in range(2):  # the second time nothing is left to do
        commit(1, second)
    assert decided(carry.all_decisions(spark, base))[2] == ("rejected", "short_stock", 0, 4)
    assert [r.stock_qty for r in carry.stock_on_hand(spark, base).collect()] == [4]


def test_late_orders_new_products_and_missing_times(spark):
    t, lines, heads, opening, restocks = shop(
        spark, [(1, 10), (2, 3), (3, None), (4, 20)], [(1, 0, 4), (2, 0, 4), (3, 0, 2), (4, 0, 3), (4, 5, 1)],
        {0: 8, 5: 1}, [(0, 3, 15)])
    base = scratch_path(spark, "carry-test")

    def commit(batch, ids, stock, came):
        own = heads.filter(heads.order_id.isin(ids))
        carry.commit_batch(t, base, batch, lines.join(own.select("order_id"), "order_id", "left_semi"), own, stock, came)

    commit(0, [1], opening.filter("product_id = 0"), restocks)
    # the order without a time comes first, then the late one finds 2; product 5 brings its own stock
    commit(1, [2, 3, 4], opening, restocks.limit(0))
    got = decided(carry.all_decisions(spark, base))
    assert got == {1: ("accepted", None, None, None), 3: ("accepted", None, None, None),
                   2: ("rejected", "short_stock", 0, 2), 4: ("accepted", None, None, None)}
    assert {r.product_id: r.stock_qty for r in carry.stock_on_hand(spark, base).collect()} == {0: 2, 5: 0}
