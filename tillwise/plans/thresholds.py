"""The largest value among rules with two lower thresholds, one lookup a row.

A rule ``(a, b, value)`` holds for a row whose ``x >= a`` and ``y >= b``.  A
join on that condition makes a row per pair; here every row is answered in
place.  Few rules become one ``greatest`` expression.  More become a tree that
is broadcast after a check of its size: the distinct ``a`` are ranked, level
``k`` holds blocks of ``2**k`` ranks, and a block keeps its rules by ``b`` with
the running maximum of their values (its staircase).  The ranks at or below
``x`` are at most one block of each level, and a binary search finds the stair
of ``y`` in each, for a whole Arrow batch at a time.  A tree of ``n`` rules
takes about ``16 n log2(n)`` bytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# up to so many rules are one expression of generated code
FEW_RULES = 32


def staircases(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> dict:
    """The tree over rules given as int64 arrays of equal length (one rule or more)."""
    ranks_a, at = np.unique(a, return_inverse=True)
    ranks_b, bt = np.unique(b, return_inverse=True)
    low = int(value.min())
    span = int(value.max()) - low + 1
    stride = len(ranks_b) + 1
    levels = []
    for k in range(len(ranks_a).bit_length()):
        block = at >> k
        order = np.lexsort((bt, block))
        block = block[order].astype(np.int64)
        # one running maximum over all blocks: a later block starts above all earlier ones
        best = np.maximum.accumulate(block * span + (value[order] - low)) - block * span
        levels.append((block * stride + bt[order], block, best))
    return {"a": ranks_a, "b": ranks_b, "low": low, "stride": stride, "levels": levels}


def best_of(tree: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per row the largest value above ``tree['low']`` less it, or -1 where no rule holds."""
    upto = np.searchsorted(tree["a"], x, side="right")
    stairs = np.searchsorted(tree["b"], y, side="right")
    best = np.full(len(x), -1, dtype=np.int64)
    for k, (keys, blocks, values) in enumerate(tree["levels"]):
        rows = np.flatnonzero((upto >> k) & 1)
        block = (upto[rows] >> k) - 1
        last = np.searchsorted(keys, block * tree["stride"] + stairs[rows], side="left") - 1
        inside = (last >= 0) & (blocks[last] == block)
        rows = rows[inside]
        best[rows] = np.maximum(best[rows], values[last[inside]])
    return best


def _by_expression(rules: list, x: Column, y: Column) -> Column:
    none = F.lit(None).cast("bigint")
    return F.greatest(none, none, *[F.when((x >= F.lit(a)) & (y >= F.lit(b)), F.lit(v).cast("bigint"))
                                    for a, b, v in rules])


def _by_tree(spark, rules: list, x: Column, y: Column) -> Column:
    a, b, v = (np.array(c, dtype=np.int64) for c in zip(*rules))
    tree = staircases(a, b, v)
    low = tree["low"]
    sent = spark.sparkContext.broadcast(tree)

    @F.pandas_udf("bigint")
    def look(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series(best_of(sent.value, xs.to_numpy(np.int64), ys.to_numpy(np.int64)))

    zero = F.lit(0).cast("bigint")
    found = look(F.coalesce(x, zero), F.coalesce(y, zero))
    return F.when(x.isNotNull() & y.isNotNull() & (found >= 0), found + F.lit(low))


def with_best(df: DataFrame, x: Column, y: Column, rules: DataFrame, max_rules: int, name: str) -> DataFrame:
    """``df`` with ``name``: the largest ``value`` of ``rules`` (``a``, ``b``,
    ``value``: bigint) that hold for the row's ``x`` and ``y`` (bigint), null
    if none does.  A rule or a row with a null threshold matches nothing.

    Equal thresholds keep their largest value first.  Rules past ``max_rules``
    are cut into hash slices that each pass the bound; every slice is a lookup
    of its own in the same pass over the rows, and the largest answer stays."""
    spark = df.sparkSession
    kept = (rules.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("value").isNotNull())
            .groupBy("a", "b").agg(F.max("value").alias("value")))
    n = kept.count()
    slices = max(1, -(-n // max_rules))
    part = F.lit(0)
    while n > max_rules:
        part = F.pmod(F.xxhash64("a", "b"), F.lit(slices))
        if kept.groupBy(part.alias("s")).count().agg(F.max("count")).first()[0] <= max_rules:
            break
        slices *= 2
    out, names = df, []
    for i in range(slices):
        # at most max_rules rows come to the driver
        rows = [tuple(r) for r in kept.filter(part == i).select("a", "b", "value").collect()]
        if rows:
            found = (_by_expression(rows, x, y) if len(rows) <= FEW_RULES else _by_tree(spark, rows, x, y))
            names.append(f"_best_{i}")
            out = out.withColumn(names[-1], found)
    none = F.lit(None).cast("bigint")
    return out.withColumn(name, F.greatest(none, none, *[F.col(c) for c in names])).drop(*names)
