import math

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.oracle_compare import duck
from tillwise.llm import hard_negatives as H
from tillwise.llm import queries

SCHEMA = "vec_id bigint, label int, embedding array<double>"
RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, positives=5, negatives=10):
    good = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in v) < 1 << 55:
            good.append((i, label, v))
    out = []
    for i, label, a in sorted({r for r in good if is_anchor(r[0])}):
        def near(same):
            return sorted((-sum(x * y for x, y in zip(a, v)), j) for j, other, v in good
                          if j != i and len(v) == len(a) and (other == label) == same)
        for p, j in near(True)[:positives]:
            window = [(s, n) for s, n in near(False) if -30 * p <= -100 * s <= -90 * p][:negatives]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n) in enumerate(window)]
    return sorted(out)


def test_query_equals_oracle(spark):
    query, sql = queries.QUERIES["op11_hard_negatives"]
    got, want = query(spark, SF_MID), duck(SF_MID).sql(sql)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows and rows == sorted(want.fetchall())


def test_ties_odd_rows_and_windows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 4), (rng.standard_normal(9) / 3 + 0.2).tolist()) for i in range(300)]
    rows += [(i, i % 3, rows[0][2]) for i in range(400, 450)]              # one vector many times
    rows += [rows[100], (None, 1, rows[1][2]), (501, None, rows[1][2]), (502, 1, None), (503, 1, [None] * 9),
             (504, 1, [math.nan] * 9), (600, 1, [math.inf] * 9), (700, 1, [1e300] * 9), (800, 1, [3e5] * 9),
             (801, 2, [1e5] * 9), (802, 1, [2e5] * 9), (900, 1, []), (901, 1, []), (902, 2, []), (1000, 1, [0.0] * 9),
             (1100, 9, [-1.0, 2.0]), (1101, 9, [1.0, 2.0]), (1102, 8, [0.5, 0.9]), (1200, 7, [1.0])]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as anchor", "2 as block", "3 as rank", "'x' as raw")
    got = H.mine(frame, F.col("vec_id") % 100 == 0)
    assert got.columns == RESULT
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 100 == 0)
    assert H.mine(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_BYTES", 1 << 10)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), rng.standard_normal(6).tolist()) for i in range(500)]
    got = H.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, 3, 4)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 50 == 0, 3, 4)


def test_cells_come_by_falling_bound_and_the_search_stops_early():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32)) * 100
    x = (np.repeat(centres, 200, axis=0) + rng.standard_normal((8000, 32)) * 5).astype(np.int64)
    ids, labels = np.arange(8000), rng.integers(0, 10, 8000)
    block = H.Block.build(ids, labels, x)
    again = H.Block.unpacked({"d": 32} | block.packed(8))
    assert (again.x == block.x).all() and (again.key == block.key).all()
    anchor, seen, last = x[123], 0, np.inf
    true = block.x @ anchor
    for cells, bound in block.visit(anchor):
        rows = np.array([r for c in cells for r in range(block.begin[c], block.begin[c + 1])], dtype=np.int64)
        assert (true[rows] <= last).all()
        seen, last = seen + len(rows), bound
    assert seen == len(x)  # every row is in a cell, every cell is visited
    visited = []
    whole = block.visit
    block.visit = lambda a: (visited.append(len(c)) or (c, b) for c, b in whole(a))
    found, scores = block.positives(anchor, 123, int(labels[123]), 5)
    want = sorted((-int(x[i] @ anchor), i) for i in range(8000) if labels[i] == labels[123] and i != 123)[:5]
    assert list(zip((-scores).tolist(), found.tolist())) == want
    assert sum(visited) < 0.7 * (np.diff(block.begin) > 0).sum()
