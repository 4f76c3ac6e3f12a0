"""Lidar footprints: tiles that own each point once, quality, percentiles of heights, union."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the quality rules and of default columns.
MOST_SOLAR_ELEVATION, LEAST_SENSITIVITY, RH98 = 0.0, 0.9, (0.0, 80.0)
PERCENTILES = (0, 2, 25, 50, 75, 95, 98, 100)
HEIGHT_FIELDS, BIOMASS_FIELDS = ("elevation_lm", "elevation_hr"), ("agbd", "elevation")


def tiled(points: DataFrame, tiles: DataFrame, box: tuple[float, float, float, float], nx: int, ny: int) -> DataFrame:
    """Points of a box with the tile that owns them: half-open tiles, closed on the box's own edges.

    The tiles are even, so a point's tile is computed and joined by index; the borders then decide with the tiles' exact
    edges whether it belongs one further. Points outside go, and those of tiles that aren't in ``tiles``.
    """
    w, s, e, n = box
    inside = points.where((F.col("lon") >= w) & (F.col("lon") <= e) & (F.col("lat") >= s) & (F.col("lat") <= n))

    def index(c: str, lo: float, hi: float, k: int) -> Column:
        edge = lambda i: F.when(i == 0, lo).when(i == k, hi).otherwise(F.lit(lo) + (hi - lo) * i / k)
        raw = F.least(F.greatest(F.floor((F.col(c) - lo) / ((hi - lo) / k)).cast("int"), F.lit(0)), F.lit(k - 1))
        return F.when((F.col(c) < edge(raw)) & (raw > 0), raw - 1).when((F.col(c) >= edge(raw + 1)) & (raw < k - 1), raw + 1).otherwise(raw)

    return inside.withColumn("i", index("lon", w, e, nx)).withColumn("j", index("lat", s, n, ny)).join(tiles.select("j", "i"), ["j", "i"])


def good_heights(shots: DataFrame) -> DataFrame:
    """Night, sensitive, plausible canopy; flags of the granule where they are given."""
    rh98 = F.get("rh", F.lit(98))
    ok = (F.col("solar_elevation") <= MOST_SOLAR_ELEVATION) & (F.col("sensitivity") >= LEAST_SENSITIVITY) & rh98.between(*RH98)
    return _flags(shots, "quality_flag").where(ok)


def good_biomass(shots: DataFrame) -> DataFrame:
    return _flags(shots, "l4_quality_flag").where(F.col("sensitivity") >= LEAST_SENSITIVITY)


def _flags(shots: DataFrame, quality: str) -> DataFrame:
    for name, value in ((quality, 1), ("degrade_flag", 0)):
        if name in shots.columns:
            shots = shots.where(F.col(name) == value)
    return shots


def expand_heights(shots: DataFrame, percentiles: Iterable[int] = PERCENTILES, column: str = "rh") -> DataFrame:
    """A column ``rh<p>`` for each percentile, in place of the array."""
    return shots.withColumns({f"rh{p}": F.get(column, F.lit(p)) for p in percentiles}).drop(column)


def fields(wanted: Iterable[str], extra: Iterable[str] = (), percentiles: Iterable[int] | None = None) -> list[str]:
    """Columns in order, each once; the raw array only if it is asked for and not expanded."""
    names = list(dict.fromkeys([*wanted, *extra, *(f"rh{p}" for p in percentiles or ())]))
    return [n for n in names if n != "rh" or not percentiles]


def selected(shots: DataFrame, keep: list[str]) -> DataFrame:
    """Columns in order with time and place. A missing one is an error, or an empty column if there are no rows."""
    missing = [c for c in keep if c not in shots.columns]
    if missing and not shots.isEmpty():
        raise KeyError(missing[0])
    shots = shots.withColumns({c: F.lit(None).cast("float") for c in missing}) if missing else shots
    return shots.select("time", *keep, "lon", "lat")


def united(parts: list[DataFrame]) -> DataFrame:
    """All tiles in order of time."""
    return reduce(DataFrame.unionByName, parts).orderBy("time")


def heights(shots: DataFrame, wanted: Iterable[str] = HEIGHT_FIELDS, extra: Iterable[str] = (), percentiles: Iterable[int] | None = PERCENTILES, quality: bool = True) -> DataFrame:
    """Filter, expand, select."""
    shots = good_heights(shots) if quality else shots
    return selected(expand_heights(shots, percentiles) if percentiles else shots, fields(wanted, extra, percentiles))


def biomass(shots: DataFrame, wanted: Iterable[str] = BIOMASS_FIELDS, extra: Iterable[str] = (), quality: bool = True) -> DataFrame:
    return selected(good_biomass(shots) if quality else shots, fields(wanted, extra))
