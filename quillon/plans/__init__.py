"""Workflows around the data: synchronisation, calendar, freshness gate, audit, pruning."""
