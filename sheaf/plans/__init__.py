"""Registered queries: each binds operators to the driver tables."""
