"""Declared steps, the durable ledger, and the resolution that reuses or runs them."""
