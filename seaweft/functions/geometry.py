"""Planar geometry in degrees: hulls, areas, polygons, distances."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = Sequence[Sequence[float]]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull in counter-clockwise order, the first not repeated; fewer than three if it has no area."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq: np.ndarray) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def area_centroid(ring: np.ndarray) -> tuple[float, float, float]:
    """Area and centroid of a simple polygon, computed relative to its first corner."""
    rel = ring - ring[0]
    nxt = np.roll(rel, -1, axis=0)
    cross = rel[:, 0] * nxt[:, 1] - nxt[:, 0] * rel[:, 1]
    twice = cross.sum()
    if twice == 0:
        return 0.0, *map(float, ring.mean(0))
    cx, cy = ((rel + nxt) * cross[:, None]).sum(0) / (3 * twice)
    return abs(float(twice)) / 2, float(cx + ring[0, 0]), float(cy + ring[0, 1])


def segment_offsets(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each point is off the segment a-b along both axes; a segment without length is a point.

    Every step is rounded on its own, relative to a, as SQL does it: dot products may fuse or reorder them, and then
    points at equal distances are so no more.
    """
    (x, y), (dx, dy) = (p - a).T, b - a
    length = dx * dx + dy * dy
    if length <= 1e-20:
        return x, y
    t = np.clip((x * dx + y * dy) / length, 0.0, 1.0)
    return x - dx * t, y - dy * t


def segment_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each point from the segment a-b."""
    x, y = segment_offsets(p, a, b)
    return np.sqrt(x * x + y * y)


def farthest(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """The point farthest from the segment a-b, the first of equal ones, and its distance.

    The squares of those in question are taken by pow of the C library, as SQL does: one in about 1,200 of them isn't
    x * x to the last bit.
    """
    x, y = segment_offsets(p, a, b)
    d = np.sqrt(x * x + y * y)
    at = int(d.argmax())
    dx, dy = b - a
    if dx * dx + dy * dy <= 1e-20 or not math.isfinite(d[at]):
        return at, float(d[at])
    near = np.flatnonzero(d >= d[at] * (1 - 1e-14))
    exact = [math.sqrt(math.pow(x[i], 2.0) + math.pow(y[i], 2.0)) for i in near]
    best = max(exact)
    return int(near[exact.index(best)]), best


def rings_of(geojson: dict | str) -> list[list[list[float]]]:
    """Rings of a GeoJSON Polygon, a Feature, or the first feature of a FeatureCollection."""
    g = json.loads(geojson) if isinstance(geojson, str) else geojson
    if g.get("type") == "FeatureCollection":
        g = g["features"][0]
    g = g.get("geometry", g)
    if g["type"] != "Polygon":
        raise ValueError(f"a Polygon is needed, not {g['type']}")
    return g["coordinates"]


def _edges(rings: Sequence[Ring]) -> Column:
    out = []
    for ring in rings:
        closed = [*ring, ring[0]] if list(ring[0]) != list(ring[-1]) else list(ring)
        out += [F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*a[:2], *b[:2])))) for a, b in zip(closed, closed[1:])]
    return F.array(*out)


def _box(rings: Sequence[Ring], lon: Column, lat: Column) -> Column:
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    return lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys))


def on_edge(rings: Sequence[Ring], lon: Column, lat: Column) -> Column:
    """Whether a point lies on the boundary."""
    def hit(e: Column) -> Column:
        turn = (e.x2 - e.x1) * (lat - e.y1) - (e.y2 - e.y1) * (lon - e.x1)
        return (turn == 0) & lon.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & lat.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))
    return F.exists(_edges(rings), hit)


def _inside(rings: Sequence[Ring], lon: Column, lat: Column) -> Column:
    """Even-odd rule: a ray to the right crosses an odd number of edges."""
    def crosses(e: Column) -> Column:
        spans = (e.y1 > lat) != (e.y2 > lat)
        return spans & (lon < (e.x2 - e.x1) * (lat - e.y1) / F.nullif(e.y2 - e.y1, F.lit(0.0)) + e.x1)
    return F.size(F.filter(_edges(rings), crosses)) % 2 == 1


def within(rings: Sequence[Ring], lon: Column, lat: Column) -> Column:
    """Strictly inside: a bounding box first, which reaches the scan, then the ray; the boundary doesn't count."""
    return _box(rings, lon, lat) & _inside(rings, lon, lat) & ~on_edge(rings, lon, lat)


def intersects(rings: Sequence[Ring], lon: Column, lat: Column) -> Column:
    """Inside or on the boundary."""
    return _box(rings, lon, lat) & (_inside(rings, lon, lat) | on_edge(rings, lon, lat))
