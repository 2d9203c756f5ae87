"""Connectors: validated fixtures, rosters, paged and date-bisected readers, row store."""
