"""Scalar column functions used across operators.

All helpers build Catalyst expressions, so they stay inside whole-stage
codegen.  The badge and severity rules are the client-side display rules of
the retail app, moved to columns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "sum_money", "wall_clock_instant", "instant_day",
    "ROLE_RANK", "alert_severity", "category_icon", "contains_ci", "days_until",
    "display_date", "escape_like", "expiring_soon", "expiry_status",
    "first_token", "month_label", "role_rank", "stock_status", "add_months",
]

# --- fixed values: enum declaration order of user roles ---------------------
ROLE_RANK = {"admin": 1, "manager": 2, "cashier": 3, "customer": 4}

# --- fixed values: category icons, with the default for unknown names -------
CATEGORY_ICONS = {
    "Groceries": "\U0001F6D2",
    "Beverages": "\U0001F964",
    "Medicines": "\U0001F48A",
    "Personal Care": "\U0001F9F4",
    "Snacks": "\U0001F36A",
    "Dairy": "\U0001F95B",
}
DEFAULT_ICON = "\U0001F4E6"


_MICROS_PER_DAY = 86_400_000_000

SEARCH_COLLATION = "UNICODE_CI_AI"


def wall_clock_instant(c: Column) -> Column:
    """TIMESTAMP_NTZ -> TIMESTAMP with the same wall clock read as UTC.

    Event-time operators (watermarks) need TIMESTAMP; a plain cast would
    read the wall clock in the session time zone and shift day windows."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, c))


def instant_day(c: Column) -> Column:
    """The UTC calendar day of a TIMESTAMP (inverse of wall_clock_instant)."""
    return F.date_from_unix_date(F.floor(F.unix_micros(c) / _MICROS_PER_DAY).cast("int"))


def sum_money(c: Column) -> Column:
    """Exact sum of a money column (scale <= 2) as DECIMAL(22,2).

    Sums integer cents in a ``bigint`` buffer (primitive arithmetic in
    generated code, overflow checked under ANSI) instead of a wide decimal
    buffer, which Spark keeps as BigDecimal once precision exceeds 18."""
    cents = F.sum((c * 100).cast("bigint"))
    return (cents.cast("decimal(22,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(22,2)")


def escape_like(q: str) -> str:
    """Escape LIKE wildcards so user text matches literally."""
    return q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(c: Column, q: str) -> Column:
    """Substring test that ignores case and accents (the database's _ci
    collation); the text of ``q`` is taken literally."""
    return F.contains(F.collate(c, SEARCH_COLLATION), F.collate(F.lit(q), SEARCH_COLLATION))


def days_until(d: Column, as_of: dt.date) -> Column:
    return F.datediff(d, F.lit(as_of))


def stock_status(stock: Column, reorder: Column) -> Column:
    return (F.when(stock <= 0, "out").when(stock <= reorder, "low").otherwise("ok"))


def expiry_status(days: Column) -> Column:
    """danger at 7 days or fewer (expired included), warn up to 30."""
    return F.when(days <= 7, "danger").when(days <= 30, "warn").otherwise(F.lit(None))


def expiring_soon(days: Column) -> Column:
    return F.coalesce((days >= 0) & (days <= 7), F.lit(False))


def alert_severity(kind: Column) -> Column:
    return (F.when(kind == "low_stock", "warn")
             .when(kind.contains("expir"), "danger").otherwise("info"))


def role_rank(role: Column) -> Column:
    expr = None
    for name, rank in ROLE_RANK.items():
        expr = F.when(role == name, rank) if expr is None else expr.when(role == name, rank)
    return expr.otherwise(len(ROLE_RANK) + 1)


def category_icon(name: Column) -> Column:
    pairs = []
    for k, v in CATEGORY_ICONS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.coalesce(F.create_map(*pairs)[name], F.lit(DEFAULT_ICON))


def first_token(s: Column) -> Column:
    return F.split_part(s, F.lit(" "), F.lit(1))


def display_date(d: Column) -> Column:
    return F.date_format(d, "dd MMM yyyy")


def month_label(month: Column) -> Column:
    """'yyyy-MM' -> 'MM/yy' (the real year, not a constant)."""
    return F.concat(F.substring(month, 6, 2), F.lit("/"), F.substring(month, 3, 2))


def add_months(d: dt.date, months: int) -> dt.date:
    """Calendar month shift clamped to the month end (SQL add_months)."""
    import calendar
    y, m = divmod(d.month - 1 + months, 12)
    y += d.year
    m += 1
    return dt.date(y, m, min(d.day, calendar.monthrange(y, m)[1]))
