"""Measures and filters of features, and set operations in cell space."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Smallest polygon (square metres) and line (metres) worth keeping.
LEAST_AREA, LEAST_LENGTH = 1500.0, 60.0
#: Ellipsoid of the world's geodetic system, and the scale of the transverse projection.
_A, _F, _K0 = 6378137.0, 1 / 298.257223563, 0.9996


def ring_area(ring: Column) -> Column:
    """Area of a ring of points x, y (its sign is its direction's)."""
    pairs = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(ring) > 2, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / 2).otherwise(0.0)


def line_length(line: Column) -> Column:
    """Length of a line of points x, y."""
    pairs = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.when(F.size(line) > 1, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def large_enough(features: DataFrame) -> DataFrame:
    """Features whose area (polygons, holes taken off by their direction) or length (lines) is worth keeping; points all are."""
    area = F.abs(F.aggregate(F.transform("rings", ring_area), F.lit(0.0), lambda s, x: s + x))
    length = F.aggregate(F.transform("rings", line_length), F.lit(0.0), lambda s, x: s + x)
    polygon, line = F.col("geom_type").contains("Polygon"), F.col("geom_type").contains("Line")
    return features.where(F.when(polygon, area >= LEAST_AREA).when(line, length >= LEAST_LENGTH).otherwise(True))


def clipped(cells: DataFrame, area: DataFrame) -> DataFrame:
    """Burned cells inside an area's cells."""
    return cells.join(area.select("r", "c").distinct(), ["r", "c"], "left_semi")


def without(cells: DataFrame, others: DataFrame) -> DataFrame:
    """Burned cells that others don't hold."""
    return cells.join(others.select("r", "c").distinct(), ["r", "c"], "left_anti")


def bounds(edges: DataFrame) -> DataFrame:
    """xmin, ymin, xmax, ymax of edges x0, y0, x1, y1."""
    return edges.agg(F.min(F.least("x0", "x1")).alias("xmin"), F.min(F.least("y0", "y1")).alias("ymin"), F.max(F.greatest("x0", "x1")).alias("xmax"), F.max(F.greatest("y0", "y1")).alias("ymax"))


def south_west_north_east(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The axes' order of map queries."""
    return F.struct(ymin.alias("south"), xmin.alias("west"), ymax.alias("north"), xmax.alias("east"))


def overlaps(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Whether two boxes (xmin, ymin, xmax, ymax) meet."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def utm_epsg(lon: Column, lat: Column) -> Column:
    """Code of the transverse projection's zone at a place."""
    zone = F.floor((lon + 180) / 6) % 60 + 1
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def to_utm(lon: Column, lat: Column) -> Column:
    """Struct x, y of a place in its own zone, by the projection's series (to about a millimetre within a zone)."""
    n = _F / (2 - _F)
    radius = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    centre = (F.floor((lon + 180) / 6) % 60) * 6 - 177
    phi, lam = F.radians(lat), F.radians(lon - centre)
    sine = F.sin(phi)
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500000 + _K0 * radius * x).alias("x"), (_K0 * radius * y + F.when(lat < 0, 1e7).otherwise(0.0)).alias("y"))


def hull_candidates(points: DataFrame, slices: int = 64) -> DataFrame:
    """x, y of a superset of a convex hull's corners, few whatever the input: the extremes in each of ``slices`` directions."""
    turns = [2 * math.pi * i / slices for i in range(slices)]
    ends = points.agg(*[F.max_by(F.struct("x", "y"), F.col("x") * math.cos(a) + F.col("y") * math.sin(a)).alias(f"p{i}") for i, a in enumerate(turns)])
    return ends.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(slices)])).alias("p")).select("p.*").distinct()


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of a convex hull's corners, against the clock from the lowest of the leftmost; points on its sides left out."""
    order = np.lexsort((y, x))
    keep = np.ones(len(order), bool)
    keep[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    order = order[keep]
    if len(order) < 3:
        return order
    sides = []
    for way in (order, order[::-1]):
        chain: list[int] = []
        for p in way:
            while len(chain) > 1:
                a, b = chain[-2:]
                if (x[b] - x[a]) * (y[p] - y[a]) > (y[b] - y[a]) * (x[p] - x[a]):
                    break
                chain.pop()
            chain.append(p)
        sides += chain[:-1]
    return np.array(sides)


def convex_hull(points: DataFrame) -> DataFrame:
    """ord, x, y: the corners of the convex hull of all points x, y, against the clock. Null places are left out; no points is no rows.

    Each task keeps the hull of its own points, so that only hulls, which have few corners, meet in the one task that joins them."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = pd.DataFrame({"x": [], "y": []}, dtype=float)
        for batch in batches:
            both = pd.concat([own, batch])
            own = both.iloc[_hull(both["x"].to_numpy(), both["y"].to_numpy())]
        yield own

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        at = _hull(rows["x"].to_numpy(), rows["y"].to_numpy())
        return pd.DataFrame({"ord": np.arange(len(at)), "x": rows["x"].to_numpy()[at], "y": rows["y"].to_numpy()[at]})

    places = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return places.mapInPandas(part, "x double, y double").groupBy(F.lit(0).alias("all")).applyInPandas(whole, "ord int, x double, y double")


def buffered_hull(points: DataFrame, width: float, quarter: int = 16) -> DataFrame:
    """``convex_hull`` widened on all sides, round corners as ``quarter`` sides for each right angle."""
    turns = [math.pi / 2 * i / quarter for i in range(4 * quarter)]
    around = F.explode(F.array(*[F.struct((F.col("x") + width * math.cos(a)).alias("x"), (F.col("y") + width * math.sin(a)).alias("y")) for a in turns]))
    return convex_hull(convex_hull(points).select(around.alias("p")).select("p.*"))


def _thinned(x: np.ndarray, y: np.ndarray, within: float, least: int) -> np.ndarray:
    """Positions of a line's points that stay: the farthest from each chord as long as it is farther than ``within``."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    spans = [(0, len(x) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        square = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / square, 0, 1) if square else np.zeros(len(px))
        far = np.hypot(px - t * dx, py - t * dy)
        m = int(far.argmax())
        if far[m] > within or keep.sum() < least:
            keep[a + 1 + m] = True
            spans += [(a, a + 1 + m), (a + 1 + m, b)]
    return np.flatnonzero(keep)


def simplified(features: DataFrame, within: float = 6.0) -> DataFrame:
    """``features`` with thinner ``rings``: no point left out lies farther than ``within`` from the line that stays. Closed rings keep
    four points at least. A small step for each feature; the rest of the row passes through."""
    names = features.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["rings"] = [None if rings is None else [_ring(r) for r in rings] for rings in batch["rings"]]
            yield batch[names]

    def _ring(points):
        if len(points) < 3:
            return points
        x, y = np.array([p["x"] for p in points], float), np.array([p["y"] for p in points], float)
        closed = x[0] == x[-1] and y[0] == y[-1]
        return [points[i] for i in _thinned(x, y, within, 4 if closed else 2)]

    return features.mapInPandas(work, features.schema)
