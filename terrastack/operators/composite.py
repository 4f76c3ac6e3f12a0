"""Temporal composites over observations in long form: one row a pixel and item, one column a band."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastack.operators.catalog import ORBIT_STATES, REFLECTANCE, shift

PIXEL = ("epsg", "y", "x")

# Classes that a scene classification marks as unusable, and those of the alternative mask.
SCENE_MASK = (0, 1, 3, 7, 8, 9, 10)
ALTERNATIVE_MASK = (1, 2, 3, 255)

REDUCTIONS: dict[str, Callable[[Column], Column]] = {
    "median": F.median,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "prod": lambda c: F.coalesce(F.product(c), F.lit(1.0)),
    "count": F.count,
}


def reduction(name: str) -> Callable[[Column], Column]:
    try:
        return REDUCTIONS[name]
    except KeyError:
        raise ValueError(f"no reduction {name!r}; there are {sorted(REDUCTIONS)}") from None


def register(name: str, how: Callable[[Column], Column]) -> None:
    """Add a reduction, a built-in expression or a grouped-aggregate pandas function."""
    REDUCTIONS[name] = how


def missing_to_null(obs: DataFrame, nodata: dict[str, float], exclude: Iterable[str] = ()) -> DataFrame:
    """A band's nodata value, and NaN, become null; excluded (mask) bands stay."""
    skip = set(exclude)
    kinds = dict(obs.dtypes)
    new = {}
    for band, value in nodata.items():
        if band not in skip:
            c = F.nullif(F.col(band), F.lit(value).cast(kinds[band]))
            new[band] = F.when(~F.isnan(c), c) if kinds[band] in ("double", "float") else c
    return obs.withColumns(new) if new else obs


def mask_classes(obs: DataFrame, bands: list[str], mask: str | None, out: Iterable[int]) -> DataFrame:
    """Bands null where the mask band is one of ``out``; a missing class is usable. The mask band goes."""
    if mask is None:
        return obs
    usable = ~F.coalesce(F.col(mask).isin(*out), F.lit(False))
    return obs.withColumns({b: F.when(usable, F.col(b)) for b in bands if b != mask}).drop(mask)


def harmonised(obs: DataFrame, bands: list[str], offset: str = "dn_offset") -> DataFrame:
    """Reflectance bands shifted to the common encoding, item by item; others keep theirs."""
    return obs.withColumns({b: F.col(b) + shift(F.col(offset)) for b in bands if b in REFLECTANCE})


def fused(obs: DataFrame, bands: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """Items of one solar day as one step: for each band the first valid value in the items' order.

    ``extra`` keys (encoding, orbit state) keep groups apart as time steps of their own.
    """
    keys = [*PIXEL, "solar_day", *extra]
    return obs.groupBy(*keys).agg(*(F.min_by(b, F.when(F.col(b).isNotNull(), F.col("pos"))).alias(b) for b in bands))


def composite(obs: DataFrame, bands: list[str], method: str = "median", keys: Iterable[str] = PIXEL) -> DataFrame:
    """One row a pixel; null where no observation is valid. Groups hold one pixel's time steps, so none grows large."""
    how = reduction(method)
    return obs.groupBy(*keys).agg(*(how(F.col(b)).alias(b) for b in bands))


def composite_by_orbit(obs: DataFrame, bands: list[str], method: str = "median", keys: Iterable[str] = PIXEL) -> DataFrame:
    """``band_state`` columns, band by band: both states in one aggregation, no join. Other states fail."""
    how = reduction(method)
    state = F.when(F.col("orbit_state").isin(*ORBIT_STATES), F.col("orbit_state")).otherwise(F.raise_error(F.concat(F.lit("no orbit state: "), F.coalesce("orbit_state", F.lit("null")))))
    return obs.withColumn("_state", state).groupBy(*keys).agg(*(how(F.when(F.col("_state") == s, F.col(b))).alias(f"{b}_{s}") for b in bands for s in ORBIT_STATES))


def variables(bands: list[str], by_orbit: bool) -> list[str]:
    return [f"{b}_{s}" for b in bands for s in ORBIT_STATES] if by_orbit else list(bands)


def mosaic(obs: DataFrame, bands: list[str], nodata: dict[str, float] | None = None, mask: str | None = None, mask_out: Iterable[int] = (), method: str = "median", by_orbit: bool = False, fuse: bool = True) -> DataFrame:
    """The whole chain: missing values, encoding, fusion, mask, reduction.

    Values shift after missing ones became null, so 0 stays missing; the mask band is neither shifted nor nulled; the
    fused class masks the fused values. ``bands`` must not name the mask band.
    """
    if mask is not None and mask in bands:
        raise ValueError(f"{mask} is the mask band and is dropped by masking")
    reduction(method)
    used = [*bands, *([mask] if mask else [])]
    obs = missing_to_null(obs, {b: v for b, v in (nodata or {}).items() if b in used}, [mask] if mask else [])
    has = set(obs.columns)
    if "dn_offset" in has:
        obs = harmonised(obs, bands)
    if fuse:
        # dealt by pixel once: fusion and reduction both group by it and need no exchange of their own
        obs = obs.repartition(*PIXEL)
        obs = fused(obs, used, tuple(c for c in ("dn_offset", "orbit_state") if c in has))
    obs = mask_classes(obs, bands, mask, mask_out)
    return (composite_by_orbit if by_orbit else composite)(obs, bands, method)


def stacked(mosaic_: DataFrame, names: list[str], keys: Iterable[str] = PIXEL) -> DataFrame:
    """Long form ``(.., band, value)`` in order of ``names``, as 32-bit floats."""
    pairs = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(b).alias("band"), F.col(b).cast("float").alias("value")) for i, b in enumerate(names)))
    return mosaic_.select(*keys, F.explode(pairs).alias("_x")).select(*keys, "_x.*")


def bricks(obs: DataFrame, bands: list[str], side: int = 64, method: str = "median") -> DataFrame:
    """The same composite brick by brick, for scenes with many time steps a pixel: Arrow tables, no row leaves numpy.

    Rows of one brick meet in one task and are sorted by pixel and value at once; a group is bounded by the brick's
    pixels times its time steps. Every pixel that has a row comes out, null if nothing is valid.
    """
    import numpy as np
    import pyarrow as pa

    if method not in ("median", "mean", "min", "max", "std", "var"):
        raise ValueError(f"no reduction {method!r} over bricks")

    def reduce(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        y, x = rows.column("y").to_numpy(), rows.column("x").to_numpy()
        pixel, place = np.unique(y.astype(np.int64) % side * side + x % side, return_inverse=True)
        out = []
        for b in bands:
            v = rows.column(b).to_numpy().astype(float)
            valid = ~np.isnan(v)
            at, v = place[valid], v[valid]
            n = np.bincount(at, minlength=len(pixel))
            some = n > 0
            if method in ("median", "min", "max"):
                v = v[np.lexsort((v, at))]
                first = (np.cumsum(n) - n)[some]
                m = n[some]
                got = {"min": lambda: v[first], "max": lambda: v[first + m - 1], "median": lambda: (v[first + (m - 1) // 2] + v[first + m // 2]) / 2}[method]()
            else:
                mean = np.bincount(at, weights=v, minlength=len(pixel))[some] / n[some]
                if method != "mean":
                    whole = np.zeros(len(pixel))
                    whole[some] = mean
                    var = np.bincount(at, weights=(v - whole[at]) ** 2, minlength=len(pixel))[some] / n[some]
                got = mean if method == "mean" else var if method == "var" else np.sqrt(var)
            full = np.full(len(pixel), np.nan)
            full[some] = got
            out.append(pa.array(full, from_pandas=True))
        epsg, by, bx = (k.as_py() for k in key)
        return pa.Table.from_arrays([pa.array(np.full(len(pixel), epsg, np.int32)), pa.array((by * side + pixel // side).astype(np.int32)), pa.array((bx * side + pixel % side).astype(np.int32)), *out], names=["epsg", "y", "x", *bands])

    keyed = obs.select(*PIXEL, *(F.col(b).cast("double").alias(b) for b in bands), F.floor(F.col("y") / side).alias("_by"), F.floor(F.col("x") / side).alias("_bx"))
    schema = "epsg int, y int, x int, " + ", ".join(f"{b} double" for b in bands)
    return keyed.groupBy("epsg", "_by", "_bx").applyInArrow(reduce, schema)
