"""Spark-first evaluation analytics: stake-weighted scoring, registry checks and operational state."""
