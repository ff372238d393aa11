"""Payment-ledger analytics on Spark."""
