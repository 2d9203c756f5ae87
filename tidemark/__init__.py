"""Incremental analytics on Spark: retained steps, keyed fan-out, folds and their ledger."""
