"""Plan-shaping helpers: bounded broadcasts, skew-safe running sums,
lineage cuts."""

from tillwise.plans.broadcast import bounded_broadcast
from tillwise.plans.lineage import cut_lineage
from tillwise.plans.running import chunked_running_sum

__all__ = ["bounded_broadcast", "chunked_running_sum", "cut_lineage"]
