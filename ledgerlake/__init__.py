"""Evidence-ledger analytics as plain Spark DataFrame transformations."""
