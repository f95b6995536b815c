"""Relational operators over ledger tables."""
