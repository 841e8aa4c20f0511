"""Nothing that grows with the data is broadcast because compressed files look small."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.operators import admission, billing, ledger
from tillwise.sources import derived as D
from tillwise.streaming import reports

AS_OF = dt.date(2001, 8, 1)
THRESHOLD = "spark.sql.autoBroadcastJoinThreshold"


def _hash_joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


@pytest.fixture
def each_threshold(spark):
    """Calls a function with the planner's own broadcasts off and on."""
    def call(f):
        was, out = spark.conf.get(THRESHOLD), []
        try:
            for value in ("-1", "10m"):
                spark.conf.set(THRESHOLD, value)
                out.append(f())
        finally:
            spark.conf.set(THRESHOLD, was)
        return out
    return call


def test_the_checkout_broadcasts_nothing_by_an_estimate(tables_small, monkeypatch, each_threshold):
    plans = {}

    def spied(name, plain, where):
        def spy(df, *args, **kw):
            plans.setdefault(where, []).append(_hash_joins(df))
            return plain(df, *args, **kw)
        monkeypatch.setattr(admission, name, spy)

    monkeypatch.setattr(admission, "SLICE_LINES", 2000)
    monkeypatch.setattr(admission, "REPLAY_LINES", 1500)
    monkeypatch.setattr(admission, "SLOW_ROUND", 1.0)

    def decide():
        plans.clear()
        rows = admission.bill_fixture_batch(tables_small, AS_OF).collect()
        return {k: list(v) for k, v in plans.items()}, sorted(rows, key=lambda r: r.order_id)

    for name in ("_store", "deal_out", "cut_lineage"):
        spied(name, getattr(admission, name), name)
    (off, rows), (on, same_rows) = each_threshold(decide)
    assert off == on and rows == same_rows
    assert len(off["_store"]) > 10 and off["cut_lineage"]


@pytest.mark.parametrize("name, build", [
    ("validate_carts", lambda t: billing.validate_carts(t, D.cart_demand(t), D.cart_headers(t), None, check_stock=False)),
    ("apply_restocks", lambda t: billing.apply_restocks(t, D.restock_requests(t, AS_OF))),
    ("admitted_items", lambda t: admission.admitted_items(t, AS_OF)),
    ("admitted_orders", lambda t: admission.admitted_orders(t, AS_OF)),
    ("product_stock", lambda t: admission.product_stock(t, AS_OF)),
    ("running_stock", lambda t: ledger.running_stock(t, AS_OF)),
    ("alert_severity", lambda t: ledger.alert_severity(t, AS_OF)),
    ("apply_alert_reads", lambda t: ledger.apply_alert_reads(t, AS_OF, ledger.manager_reads(t, AS_OF))),
    ("alerts_feed", lambda t: ledger.alerts_feed(t, AS_OF)),
])
def test_readers_broadcast_nothing_by_an_estimate(tables_small, each_threshold, name, build):
    def joins():
        tables_small.__dict__.pop("_running_stock", None)
        return _hash_joins(build(tables_small))

    off, on = each_threshold(joins)
    assert off == on


class _State:
    """The state of one group of a stream."""

    def __init__(self):
        self.exists, self.get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_the_low_stock_state_takes_a_quarter_of_its_numbers():
    day = 86_400_000_000
    frame = pd.DataFrame([
        {"product_id": 64 + p, "micros": (9_000 + (p * 7 + i * 31) % 2_400) * day, "kind": 2, "no_ref": False,
         "reference_id": 1_000_000 + (p * 7919 + i * 104_729) % 9_000_000, "line_no": i % 7 + 1,
         "change_qty": -(i % 50) - 1, "reorder_level": 10} for p in range(64) for i in range(30)])
    state, advance = _State(), reports.stock_state()
    halves = [frame.iloc[::2], frame.iloc[1::2]]
    got = [pd.concat(advance((1,), [f], state)) for f in halves]
    assert len(state.get[0]) < len(frame) * 7 * 8 / 4
    whole = _State()
    want = pd.concat(advance((1,), [frame], whole))
    pd.testing.assert_frame_equal(got[1].reset_index(drop=True), want.reset_index(drop=True))


def test_packed_rows_come_back():
    import numpy as np

    pack, unpack = reports.packing()
    rows = np.array([[1, reports.NO_TIME, 0, 1, 0, 0, 5], [2, -1, 2, 0, (1 << 63) - 1, 3, -(1 << 63)]], dtype="<i8")
    for n in (0, 1, 2):
        assert np.array_equal(unpack(pack(rows[:n])), rows[:n])
