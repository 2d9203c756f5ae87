"""Paged traversal, live counters and the operation state machine over Structured Streaming."""
