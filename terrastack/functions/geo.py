"""Zones, grids, tiles, projections and polygons, in plain numpy on the driver or as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]

# WGS84, fixed values.
SEMI_MAJOR, FLATTENING, UTM_SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
#: A zone's strip narrower than this many degrees joins its neighbour.
LEAST_STRIP = 1.0


# ---------------------------------------------------------------- UTM (Krueger series to third order)


def _series() -> tuple[float, list[float], list[float], list[float]]:
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    inverse = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return radius, forward, inverse, latitude


def zone_number(epsg: int) -> int:
    return epsg % 100


def zone_band(number: int) -> tuple[float, float]:
    """Western and eastern edge of a UTM zone."""
    west = -180.0 + 6 * (number - 1)
    return west, west + 6


def to_utm(epsg: int, lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    radius, forward, _, _ = _series()
    n = FLATTENING / (2 - FLATTENING)
    phi, lam = np.radians(lat), np.radians(np.asarray(lon) - (zone_band(zone_number(epsg))[0] + 3))
    e = 2 * math.sqrt(n) / (1 + n)
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(lam)), np.arctanh(np.sin(lam) / np.sqrt(1 + t**2))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(forward, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(forward, 1))
    return FALSE_EAST + UTM_SCALE * radius * x, UTM_SCALE * radius * y + (FALSE_NORTH if epsg // 100 == 327 else 0)


def from_utm(epsg: int, east: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    radius, _, inverse, latitude = _series()
    xi = (np.asarray(north) - (FALSE_NORTH if epsg // 100 == 327 else 0)) / (UTM_SCALE * radius)
    eta = (np.asarray(east) - FALSE_EAST) / (UTM_SCALE * radius)
    x = xi - sum(b * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, b in enumerate(inverse, 1))
    y = eta - sum(b * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, b in enumerate(inverse, 1))
    chi = np.arcsin(np.sin(x) / np.cosh(y))
    phi = chi + sum(d * np.sin(2 * j * chi) for j, d in enumerate(latitude, 1))
    return zone_band(zone_number(epsg))[0] + 3 + np.degrees(np.arctan2(np.sinh(y), np.cos(x))), np.degrees(phi)


# ---------------------------------------------------------------- zones


def zone_extents(aoi: Box) -> dict[int, tuple[float, float]]:
    """Zone numbers of an area with the longitudes each takes; thin end strips join their neighbours."""
    west, _, east, _ = aoi
    strips = [[n, max(west, zone_band(n)[0]), min(east, zone_band(n)[1])] for n in range(1, 61) if zone_band(n)[0] < east and zone_band(n)[1] > west]
    while len(strips) > 1:
        first, last = strips[0][2] - strips[0][1], strips[-1][2] - strips[-1][1]
        if min(first, last) >= LEAST_STRIP:
            break
        if first <= last:
            thin = strips.pop(0)
            strips[0][1] = thin[1]
        else:
            thin = strips.pop()
            strips[-1][2] = thin[2]
    return {n: (w, e) for n, w, e in strips}


def zones(spark: SparkSession, aoi: Box) -> DataFrame:
    """``(epsg, zone, west, south, east, north)``; an area across the equator has both hemispheres' zones, both in full."""
    _, south, _, north = aoi
    bases = [32600] * (north > 0) + [32700] * (south < 0)
    rows = [(b + n, n, float(w), float(south), float(e), float(north)) for n, (w, e) in sorted(zone_extents(aoi).items()) for b in bases]
    return spark.createDataFrame(rows, "epsg int, zone int, west double, south double, east double, north double")


# ---------------------------------------------------------------- grids


@dataclass(frozen=True)
class Grid:
    """A north-up pixel grid."""

    epsg: int
    left: float
    top: float
    resolution: float
    height: int
    width: int

    def window(self, y0: int, y1: int, x0: int, x1: int) -> Box:
        return self.left + x0 * self.resolution, self.top - y1 * self.resolution, self.left + x1 * self.resolution, self.top - y0 * self.resolution

    def lonlat(self, box: Box) -> Box:
        """Bounds in degrees of a window in metres, by its densified edge."""
        x, y = edge(box)
        lon, lat = from_utm(self.epsg, x, y)
        return float(lon.min()), float(lat.min()), float(lon.max()), float(lat.max())


def edge(box: Box, steps: int = 21) -> tuple[np.ndarray, np.ndarray]:
    a, b, t = np.array(box[:2]), np.array(box[2:]), np.linspace(0, 1, steps)
    xs, ys = a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t
    return np.concatenate((xs, np.full(steps, b[0]), xs[::-1], np.full(steps, a[0]))), np.concatenate((np.full(steps, a[1]), ys, np.full(steps, b[1]), ys[::-1]))


def zone_grid(epsg: int, box: Box, resolution: float) -> Grid:
    """A zone's share of an area as pixels, snapped outwards to the resolution."""
    x, y = to_utm(epsg, *edge(box))
    left, right = math.floor(x.min() / resolution), math.ceil(x.max() / resolution)
    bottom, top = math.floor(y.min() / resolution), math.ceil(y.max() / resolution)
    return Grid(epsg, left * resolution, top * resolution, resolution, top - bottom, right - left)


def layout(chunk: int | None = None, shard_factor: int | None = None, brick_factor: int | None = None) -> tuple[int, int, int]:
    """Sides of a chunk, of a processing brick and of a shard in pixels; a brick must divide its shard."""
    chunk, shard_factor, brick_factor = chunk or 256, shard_factor or 32, brick_factor or 4
    if shard_factor % brick_factor:
        raise ValueError(f"{brick_factor} chunks a brick don't divide {shard_factor} chunks a shard")
    return chunk, chunk * brick_factor, chunk * shard_factor


def shard_grid(spark: SparkSession, height: int, width: int, unit: int) -> DataFrame:
    """``(shard_y, shard_x, y0, y1, x0, x1)``: units row by row, the last ones cut at the edge. Made by the executors."""
    ys = spark.range(-(-height // unit)).select(F.col("id").cast("int").alias("shard_y"))
    xs = F.explode(F.sequence(F.lit(0), F.lit(-(-width // unit) - 1))).alias("shard_x")
    cut = lambda i, n: F.least((F.col(i) + 1) * unit, F.lit(n)).cast("int")
    return ys.select("shard_y", xs).select("shard_y", "shard_x", (F.col("shard_y") * unit).cast("int").alias("y0"), cut("shard_y", height).alias("y1"), (F.col("shard_x") * unit).cast("int").alias("x0"), cut("shard_x", width).alias("x1"))


def mask_grid(height: int, width: int, pixel: float, target: float = 20.0) -> tuple[int, int, int]:
    """Averaging factor to ``target`` metres, and the shape after it."""
    factor = target / abs(pixel)
    return round(factor), round(height / factor), round(width / factor)


# ---------------------------------------------------------------- tiles


def geodesic(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """Length in metres on the ellipsoid (Vincenty's inverse formula)."""
    if (lon1, lat1) == (lon2, lat2):
        return 0.0
    b = SEMI_MAJOR * (1 - FLATTENING)
    u1, u2 = (math.atan((1 - FLATTENING) * math.tan(math.radians(x))) for x in (lat1, lat2))
    span = lam = math.radians(lon2 - lon1)
    for _ in range(200):
        s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(s, c)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / s if s else 0.0
        cos2 = 1 - sin_a**2
        mid = c - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 > 1e-15 else 0.0
        k = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
        new = span + (1 - k) * FLATTENING * sin_a * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
        if abs(new - lam) < 1e-12:
            break
        lam = new
    u = cos2 * (SEMI_MAJOR**2 - b**2) / b**2
    p = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
    q = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
    change = q * s * (mid + q / 4 * (c * (2 * mid**2 - 1) - q / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
    return b * p * (sigma - change)


def tile_counts(box: Box, most: float = 50_000.0) -> tuple[int, int]:
    """Columns and rows of even tiles no side of which is longer than ``most`` metres."""
    west, south, east, north = box
    widest = 0.0 if south <= 0 <= north else min(south, north, key=abs)
    width, height = geodesic(west, widest, east, widest), geodesic(west, south, west, north)
    return max(1, math.ceil(width / most)), max(1, math.ceil(height / most))


def tiles(spark: SparkSession, box: Box, most: float = 50_000.0) -> DataFrame:
    """``(j, i, min_lon, min_lat, max_lon, max_lat)``: rows of tiles from the south-west; the outer edges are exact."""
    nx, ny = tile_counts(box, most)
    west, south, east, north = map(float, box)
    at = lambda i, n, lo, hi: F.when(i == 0, lo).when(i == n, hi).otherwise(F.lit(lo) + (hi - lo) * i / n)
    grid = spark.range(ny).select(F.col("id").cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("i"))
    i, j = F.col("i"), F.col("j")
    return grid.select("j", "i", at(i, nx, west, east).alias("min_lon"), at(j, ny, south, north).alias("min_lat"), at(i + 1, nx, west, east).alias("max_lon"), at(j + 1, ny, south, north).alias("max_lat"))


# ---------------------------------------------------------------- polygons

#: A ring of points, or an outer ring with its holes.
Polygon = Sequence


def rings_of(polygon: Polygon) -> list[np.ndarray]:
    """The rings of a polygon, of which the first is the outer one."""
    single = len(polygon) > 0 and np.ndim(polygon[0]) == 1
    return [np.asarray(r, float) for r in ([polygon] if single else polygon)]


def bounds(polygons: Sequence[Polygon]) -> Box:
    points = np.concatenate([rings_of(p)[0] for p in polygons])
    return (*points.min(axis=0).tolist(), *points.max(axis=0).tolist())  # type: ignore[return-value]


def intersects(polygons: Sequence[Polygon], boxes: np.ndarray) -> np.ndarray:
    """Whether each box (rows of west, south, east, north) meets any polygon; touching counts, lying in a hole doesn't."""
    out = np.zeros(len(boxes), bool)
    w, s, e, n = boxes.T
    for polygon in polygons:
        inside = np.zeros(len(boxes), int)
        for pts in rings_of(polygon):
            a, b = pts, np.roll(pts, -1, axis=0)
            # an edge meets the box: clipped by Liang and Barsky's four half-planes
            d = b - a
            t0, t1 = np.zeros((len(boxes), len(a))), np.ones((len(boxes), len(a)))
            ok = np.ones_like(t0, bool)
            for p, q in ((-d[:, 0], a[:, 0] - w[:, None]), (d[:, 0], e[:, None] - a[:, 0]), (-d[:, 1], a[:, 1] - s[:, None]), (d[:, 1], n[:, None] - a[:, 1])):
                p = np.broadcast_to(p, q.shape)
                with np.errstate(divide="ignore", invalid="ignore"):
                    r = q / p
                t0 = np.where(p < 0, np.maximum(t0, r), t0)
                t1 = np.where(p > 0, np.minimum(t1, r), t1)
                ok &= (p != 0) | (q >= 0)
            out |= (ok & (t0 <= t1)).any(axis=1)
            # or the box lies within the polygon: its corner does, counted over all rings
            crossing = (a[:, 1] > s[:, None]) != (b[:, 1] > s[:, None])
            with np.errstate(divide="ignore", invalid="ignore"):
                x = a[:, 0] + (s[:, None] - a[:, 1]) * d[:, 0] / d[:, 1]
            inside += (crossing & (w[:, None] < x)).sum(axis=1)
        out |= inside % 2 == 1
    return out


def near(polygons: Sequence[Polygon], west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether boxes meet the polygons' bounds: comparisons only, so a scan can skip files and row groups by it."""
    w, s, e, n = bounds(polygons)
    return (west <= e) & (east >= w) & (south <= n) & (north >= s)


def meets(polygons: Sequence[Polygon], west: Column, south: Column, east: Column, north: Column) -> Column:
    """``intersects`` as a Column, an Arrow function; filters put ``near`` before it, so it sees what is left."""
    kept = [rings_of(p) for p in polygons]

    @F.pandas_udf("boolean")
    def exact(a, b, c, d):
        import pandas as pd

        return pd.Series(intersects(kept, np.column_stack((a, b, c, d))))

    return exact(west, south, east, north)


def meeting(df: DataFrame, polygons: Sequence[Polygon], west: str, south: str, east: str, north: str) -> DataFrame:
    """Rows whose boxes meet the polygons: by bounds first, then exactly."""
    box = [F.col(c) for c in (west, south, east, north)]
    return df.where(near(polygons, *box)).where(meets(polygons, *box))


def geometry_meets(geometry: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Whether each row's own GeoJSON geometry meets its box; a null geometry does (its bounds decide alone)."""

    @F.pandas_udf("boolean")
    def exact(g, a, b, c, d):
        import json

        import pandas as pd

        boxes, out = np.column_stack((a, b, c, d)), np.ones(len(g), bool)
        for text, at in g.dropna().groupby(g.dropna()).groups.items():  # a footprint is read once for all its boxes
            shape = json.loads(text)
            parts = [shape["coordinates"]] if shape["type"] == "Polygon" else shape["coordinates"] if shape["type"] == "MultiPolygon" else None
            if parts is not None:
                rows = g.index.get_indexer(at)
                out[rows] = intersects([[[p[:2] for p in ring] for ring in polygon] for polygon in parts], boxes[rows])
        return pd.Series(out)

    return exact(geometry, west, south, east, north)
