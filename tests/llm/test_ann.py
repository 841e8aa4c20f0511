import math

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.oracle_compare import duck
from tillwise.llm import ann, queries

SCHEMA = "vec_id bigint, embedding array<float>"


def product(a, b):
    total = 0.0  # in order: sum() would compensate
    for x, y in zip(a.tolist(), b.tolist()):
        total += x * y
    return total


def brute(rows, is_query, k):
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for i, q in {(i, q.tobytes()): (i, q) for i, q in good if is_query(i)}.values():
        near = sorted((-product(q, x), j) for j, x in good if j != i and len(x) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


def floats(v):
    return [float(np.float32(x)) for x in v]


def test_query_equals_oracle(spark):
    query, sql = queries.QUERIES["op3_nearest_neighbours"]
    got, want = query(spark, SF_MID), duck(SF_MID).sql(sql)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_ties_odd_vectors_and_few_candidates(spark):
    rng = np.random.default_rng(8)
    rows = [(i, floats(rng.standard_normal(8))) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(200, 260)] + [(40, rows[40][1])]  # copies; a repeated query row
    rows += [(300, None), (320, []), (340, floats([0] * 8)), (360, [1.0] * 7 + [float("nan")]),
             (380, [1.0] * 7 + [float("inf")]), (400, [1.0] * 7 + [None]), (None, floats([9] * 8)),
             (420, floats([1, 2, 3])), (421, floats([1, 2, 4])), (440, floats([5]))]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rank", "2 as block", "3 as query_id")
    got = sorted(map(tuple, ann.search(frame, F.col("vec_id") % 20 == 0, k=20).collect()))
    assert got == brute(rows, lambda i: i % 20 == 0, 20)
    assert ann.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 64)) / 8 + 0.05
    q = rng.standard_normal((50, 64))
    centre, turn = x.mean(axis=0), ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    est, err = ann.estimates(q, *ann.encode(x, centre, turn), centre, turn)
    true = q @ x.T
    assert (np.abs(est - true) <= err).mean() > 0.9999
    # informative: the estimates follow the products
    assert np.corrcoef(est.ravel(), true.ravel())[0, 1] > 0.7


def test_several_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(2)
    rows = [(i, floats(rng.standard_normal(16))) for i in range(400)]
    got = sorted(map(tuple, ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, k=5).collect()))
    assert got == brute(rows, lambda i: i % 20 == 0, 5)
