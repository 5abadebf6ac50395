"""Registered queries: each operator on the driver's tables, and the same in SQL."""
