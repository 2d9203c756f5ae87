"""Relational operators over ledger, member and usage tables."""
