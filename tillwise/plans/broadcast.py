"""Broadcast only behind a checked size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BroadcastBoundExceeded(ValueError):
    pass


def met_by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast, as its rows grow
    with the data.  The planner would go by the size of compressed files; the
    driver has to hold the rows, which can take forty times as much."""
    return df.hint("merge")


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Return ``broadcast(df)`` after proving it holds at most ``max_rows``
    rows (a plain count: partial counts are all that is sent to one task).  Callers that have
    an exact shuffle-based alternative catch :class:`BroadcastBoundExceeded`
    and take it."""
    n = df.count()
    if n > max_rows:
        raise BroadcastBoundExceeded(f"{n} rows exceed broadcast bound {max_rows}")
    return F.broadcast(df)
