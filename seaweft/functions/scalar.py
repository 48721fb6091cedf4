"""Column expressions of the feature job, scores and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius in km, reference place.
EARTH_KM, REFERENCE = 6371.0, (32.0, -77.0)
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def haversine_km(lat: Column, lon: Column, lat0: float = REFERENCE[0], lon0: float = REFERENCE[1]) -> Column:
    dlat, dlon = F.radians(lat - F.lit(lat0)), F.radians(lon - F.lit(lon0))
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(F.lit(lat0))) * F.cos(F.radians(lat)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def time_of_day(hour: Column) -> Column:
    return F.when(hour.between(6, 11), "Morning").when(hour.between(12, 17), "Afternoon").when(hour.between(18, 23), "Evening").otherwise("Night")


def speed_category(sog: Column) -> Column:
    """0 to 5 Stationary, above 5 to 15 Slow, above 15 to 25 Medium, above 25 to 100 Fast; else null."""
    return F.when(sog.between(0, 5), "Stationary").when((sog > 5) & (sog <= 15), "Slow").when((sog > 15) & (sog <= 25), "Medium").when((sog > 25) & (sog <= 100), "Fast")


def course_change(cog: Column, before: Column) -> Column:
    """Smaller angle between two courses; 0 without one before."""
    d = F.abs(cog - before)
    return F.coalesce(F.least(d, 360.0 - d), F.lit(0.0))


def alignment(value: Column, low: float | None, high: float | None) -> Column:
    """1 inside the expected range, falling off with the distance from it; 0.5 without one."""
    if low is None and high is None:
        return F.lit(0.5)
    low, high = (low if low is not None else high), (high if high is not None else low)
    low, high = min(low, high), max(low, high)
    gap = F.when(value < low, low - value).when(value > high, value - high).otherwise(0.0)
    return F.exp(-gap / F.lit(max(10.0, float(high - low))))


def gamma_token(gamma: float) -> str:
    return f"{gamma:g}".replace(".", "p")


def method_id(k: int, r: float, mode: int) -> str:
    return f"k{int(k)}_r{r}_n{int(mode)}".replace(".", "p")


#: Colours from which scores are mixed (worst, best), of ranks, and of edges.
WORST, BEST = (255, 59, 59), (34, 197, 94)
RANK_COLOURS, EDGE_COLOURS = ("#ef4444", "#f59e0b", "#22c55e"), ("#3b82f6", "#f59e0b", "#ef4444")


def score_colour(score: Column, low: Column, high: Column) -> Column:
    """Colour between the worst and the best score as rgba; empty if all scores are the same."""
    t = (score - low) / F.nullif(high - low, F.lit(0.0))
    mix = [F.floor(F.lit(float(a)) + t * (b - a)).cast("string") for a, b in zip(WORST, BEST)]
    return F.when(high > low, F.concat(F.lit("rgba("), F.concat_ws(",", *mix), F.lit(",0.25)"))).otherwise("")


def rank_colour(rank0: Column, total: Column) -> Column:
    """By the share of nodes that rank before: under a tenth, under two fifths, the rest."""
    share = rank0 / F.greatest(total, F.lit(1))
    return F.when(share < 0.1, RANK_COLOURS[0]).when(share < 0.4, RANK_COLOURS[1]).otherwise(RANK_COLOURS[2])


def node_radius(points: Column, most: Column, least: float = 5.0, greatest: float = 22.0) -> Column:
    """Radius that grows with the square root of a node's share of the busiest one."""
    return F.lit(least) + (greatest - least) * F.sqrt(F.greatest(points, F.lit(1)) / most)


def edge_width(count: Column, most: Column, least: float = 1.0, greatest: float = 8.0) -> Column:
    return F.lit(least) + (greatest - least) * (count / most)


def edge_colour(share: Column) -> Column:
    return F.when(share < 0.33, EDGE_COLOURS[0]).when(share < 0.66, EDGE_COLOURS[1]).otherwise(EDGE_COLOURS[2])


def compass(cog: Column) -> Column:
    """Eight directions of 45 degrees, north around 0; without a course, north."""
    part = F.floor(F.pmod(cog + 22.5, F.lit(360.0)) / 45.0).cast("int")
    return F.when(cog.isNull() | (cog < 22.5) | (cog >= 337.5), "N").otherwise(F.element_at(F.array(*map(F.lit, COMPASS)), part + 1))


#: Zone, latitudes and longitudes between which it lies.
ZONES = (
    ("Gulf of Mexico", 24, 31, -87, -80), ("Northeast Coast", 39, 45, -76, -70),
    ("Mid-Atlantic", 33, 36, -79, -75), ("Pacific Northwest", 47, 50, -125, -120),
)


def maritime_zone(lat: Column, lon: Column) -> Column:
    """First zone that a place lies strictly inside of."""
    out = F.lit("Other")
    for name, a, b, c, d in reversed(ZONES):
        out = F.when((lat > a) & (lat < b) & (lon > c) & (lon < d), name).otherwise(out)
    return out
