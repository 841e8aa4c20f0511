"""Inline seed rows (the reference's INSERT ... VALUES blocks).

These are fixed values that must equal the test fixture mapping: the staff
accounts laid over the customer table and the discount rule set whose
thresholds are scaled to the driver's order totals.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values: staff accounts (user_id, username, role, full_name) ------
STAFF_ROWS = [
    (-1, "till_1", "cashier", "Till One"),
    (-2, "till_2", "cashier", "Till Two"),
    (-3, "till_3", "cashier", "Till Three"),
    (-4, "till_4", "cashier", "Till Four"),
    (-5, "boss_1", "manager", "Boss One"),
    (-6, "own_1", "admin", "Owner One"),
]

# --- fixed values: discount rules -------------------------------------------
# (rule_id, rule_name, min_qty, min_amount, discount_pct, is_active,
#  valid_from, valid_to)
RULE_ROWS = [
    (1, "bulk", 10, 0, 5, True, None, None),
    (2, "big", 1, 50000, 10, True, None, None),
    (3, "mega", 1, 200000, 15, True, None, "2001-08-01"),
    (4, "ended", 1, 0, 40, True, None, "2000-01-01"),
    (5, "off", 1, 0, 50, False, None, None),
]

STAFF_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("username", T.StringType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("full_name", T.StringType(), False),
])

RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.IntegerType(), False),
    T.StructField("rule_name", T.StringType(), False),
    T.StructField("min_qty", T.IntegerType(), True),
    T.StructField("min_amount", T.DecimalType(12, 2), True),
    T.StructField("discount_pct", T.DecimalType(5, 2), False),
    T.StructField("is_active", T.BooleanType(), True),
    T.StructField("valid_from", T.DateType(), True),
    T.StructField("valid_to", T.DateType(), True),
])

# Upper bound on rule rows that may be broadcast to every task (see
# tillwise.plans.broadcast).  A rule table is configuration, not data.
MAX_RULES = 100_000


def _date(s):
    return None if s is None else dt.date.fromisoformat(s)


def staff_users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STAFF_ROWS, STAFF_SCHEMA)


def discount_rules(spark: SparkSession) -> DataFrame:
    rows = [(rid, name, mq, Decimal(ma).quantize(Decimal("0.01")),
             Decimal(pct).quantize(Decimal("0.01")), act, _date(vf), _date(vt))
            for rid, name, mq, ma, pct, act, vf, vt in RULE_ROWS]
    return spark.createDataFrame(rows, RULE_SCHEMA)
