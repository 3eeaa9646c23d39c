"""Column expressions: keyed hashes, sample sizes, guards."""
