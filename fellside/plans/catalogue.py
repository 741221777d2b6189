"""All queries of the library proper."""

from __future__ import annotations

from . import augment_queries, detect_queries, mask_queries, metric_queries, raster_queries, region_queries, route_queries, settings_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
