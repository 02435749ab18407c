"""Names of all queries over the engine's own operators, with their DuckDB SQL."""

from __future__ import annotations

from tallyspark.plans import more, streams
from tallyspark.plans.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "more", "streams"]
