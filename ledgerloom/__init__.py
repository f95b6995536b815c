"""Account-statement and ledger analytics as Spark plans."""
