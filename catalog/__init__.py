"""Registered queries: one Spark query and, where SQL can state it, one oracle."""
