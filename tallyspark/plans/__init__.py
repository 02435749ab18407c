"""Query plans: operators applied to concrete tables."""
