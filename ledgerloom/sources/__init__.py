"""Where ledger rows and statement text come from."""
