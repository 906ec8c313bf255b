"""Ledgerloom: portfolio and ledger analytics as Spark DataFrame plans."""
