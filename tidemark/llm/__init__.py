"""Training-data operators: search, extraction, joins, scans, scoring, packing.

Nothing outside this folder imports it; the registry lives in ``queries``.
"""
