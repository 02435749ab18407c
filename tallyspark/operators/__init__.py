"""Relational operators: consensus, registry checks, duplicates and state."""
