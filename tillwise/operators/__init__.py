"""Relational operators of the retail engine, one module per area."""
