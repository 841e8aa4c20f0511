"""tillwise: retail inventory and billing analytics as Spark DataFrame jobs.

Every operator is a plain function over a :class:`tillwise.sources.Tables`
bundle (plus explicit parameters such as ``as_of``) that returns a lazy
DataFrame.  Nothing reads the wall clock and nothing collects rows to the
driver; Catalyst and AQE choose the physical plan.
"""

from tillwise.session import build_session, scratch_path
from tillwise.sources.tables import Tables

__all__ = ["Tables", "build_session", "scratch_path"]
