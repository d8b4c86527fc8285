"""Part of pairweave."""
