"""The queries of the library by name, and their SQL in DuckDB's dialect."""

from __future__ import annotations

from tilewright.plans import areas, assembly, catalogue, composites, extras, grids, ground, lines, meshwork, polygons, runways, selections, shaping, streams, tiling

FLAGSHIP = "texture_cells"
_PLANS = (tiling, lines, grids, assembly, catalogue, streams, selections, areas, meshwork, composites, extras, polygons, ground, shaping, runways)
QUERIES: dict = {name: f for plan in _PLANS for name, f in plan.QUERIES.items()}
SQL: dict = {name: text for plan in _PLANS for name, text in plan.SQL.items()}
