"""All registered queries of the terrain engine, and their SQL."""

from __future__ import annotations

from orograph.plans import events, previews, raster, scalar, scenes, style, views  # noqa: F401
from orograph.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
