"""Column-level helpers (JVM-side expressions only; no Python UDFs)."""

from tillwise.functions.scalar import *  # noqa: F401,F403
