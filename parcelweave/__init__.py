"""Property-network analytics expressed as Spark plans."""
