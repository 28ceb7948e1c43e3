"""Land and sea polygons of a tile from coastline chains, and runways from their parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def perimeter_place(x: float, y: float) -> float:
    """Where along the unit square's sides, clockwise from (0, 0), the nearest point of them lies."""
    sides = ((abs(x), y), (abs(1 - y), 1 + x), (abs(1 - x), 3 - y), (abs(y), 4 - x))
    return min((d, s % 4) for d, s in sides)[1]


_CORNERS = ((1.0, (0.0, 1.0)), (2.0, (1.0, 1.0)), (3.0, (1.0, 0.0)), (4.0, (0.0, 0.0)))


def stitch(chains: list[np.ndarray]) -> list[np.ndarray]:
    """Closed rings from chains of points in the unit square.

    Closed chains are rings already. An open chain runs from side to side; from its end the ring
    follows the sides clockwise to the next chain's start, and so on until it is closed. Where an open
    chain begins or ends inside the square, its data are broken, and there are no rings at all.
    """
    ends = [p for c in chains if not (c[0] == c[-1]).all() for p in (c[0], c[-1])]
    if any(min(abs(v - round(v)) for v in p) > 1e-5 for p in ends):
        return []
    rings = [c for c in chains if (c[0] == c[-1]).all()]
    rest = [c for c in chains if not (c[0] == c[-1]).all()]
    starts = [(perimeter_place(*c[0]), i) for i, c in enumerate(rest)]
    left = set(range(len(rest)))
    while left:
        first = at = min(left)
        ring: list = []
        while True:
            left.discard(at)
            ring += [tuple(p) for p in rest[at]]
            end = perimeter_place(*rest[at][-1])
            # the next start that lies ahead; the ring's own start closes it
            ahead = [((s - end) % 4, i) for s, i in starts if i in left or i == first]
            step, nxt = min(ahead)
            for at_corner, p in sorted(((c - end) % 4, p) for c, p in _CORNERS):
                if 0 < at_corner < step:
                    ring.append(p)
            if nxt == first:
                break
            at = nxt
        ring.append(ring[0])
        rings.append(np.array(ring))
    return rings


def coast_polygons(chains: DataFrame, tile: str) -> DataFrame:
    """tile, ring, points from rows (tile, chain, points); points are array<struct<x, y>>."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chain")
        found = stitch([np.array([(p["x"], p["y"]) for p in c]) for c in rows["points"]])
        points = [[{"x": float(x), "y": float(y)} for x, y in r] for r in found]
        return pd.DataFrame({tile: [rows[tile].iloc[0]] * len(points), "ring": range(len(points)), "points": pd.Series(points, dtype=object)})

    kind = chains.schema[tile].dataType.simpleString()
    return chains.select(tile, "chain", "points").groupBy(tile).applyInPandas(run, f"{tile} {kind}, ring int, points array<struct<x:double,y:double>>")


def merge_parts(parts: list[np.ndarray], turn: float = 0.2) -> list[np.ndarray]:
    """Lines joined end to end where they share an end and go on in nearly the same direction."""
    lines = [np.asarray(p) for p in parts]
    direction = lambda a, b: np.arctan2(b[1] - a[1], b[0] - a[0])
    joined = True
    while joined:
        joined = False
        for i in range(len(lines)):
            for j in range(i + 1, len(lines)):
                for a in (lines[i], lines[i][::-1]):
                    for b in (lines[j], lines[j][::-1]):
                        if (a[-1] == b[0]).all():
                            bend = abs(direction(a[-2], a[-1]) - direction(b[0], b[1])) % (2 * np.pi)
                            if min(bend, 2 * np.pi - bend) < turn:
                                lines[i] = np.concatenate([a, b[1:]])
                                del lines[j]
                                joined = True
                                break
                    if joined:
                        break
                if joined:
                    break
            if joined:
                break
    return lines


def runways(parts: DataFrame, airport: str) -> DataFrame:
    """airport, runway, points from rows (airport, part, points)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        found = merge_parts([np.array([(p["x"], p["y"]) for p in c]) for c in rows["points"]])
        points = [[{"x": float(x), "y": float(y)} for x, y in r] for r in found]
        return pd.DataFrame({airport: [rows[airport].iloc[0]] * len(points), "runway": range(len(points)), "points": points})

    kind = parts.schema[airport].dataType.simpleString()
    return parts.select(airport, "part", "points").groupBy(airport).applyInPandas(run, f"{airport} {kind}, runway int, points array<struct<x:double,y:double>>")
