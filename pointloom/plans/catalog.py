"""All registered queries of the point-cloud side, with their SQL twins."""

from __future__ import annotations

from pointloom.plans import alignment, cloud, features, maps, streams  # noqa: F401  they register their queries
from pointloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
FLAGSHIP = "tile_summary_first"
