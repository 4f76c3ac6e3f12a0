"""Pixel arithmetic: averaging, saturation, resampling, mask classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Class of pixels that a mask can't be computed for.
MASK_NODATA = 255


def saturating_shift(value: Column, by: Column | int, most: int = 65535) -> Column:
    """Valid values (above 0) shifted and held at the largest of their type; 0 stays 0."""
    return F.when(value > 0, F.least(value + by, F.lit(most))).otherwise(F.lit(0))


def block_average(pixels: DataFrame, bands: list[str], factor: int, keys: tuple[str, ...] = ("epsg",)) -> DataFrame:
    """Means over blocks of ``factor`` by ``factor`` pixels."""
    y, x = F.expr(f"y div {factor}").alias("y"), F.expr(f"x div {factor}").alias("x")
    return pixels.select(*keys, y, x, *bands).groupBy(*keys, "y", "x").agg(*(F.avg(b).alias(b) for b in bands))


def subsampled(pixels: DataFrame, factor: int) -> DataFrame:
    """Every ``factor``-th pixel each way: nearest-neighbour reading of a coarser level."""
    return pixels.where((F.col("y") % factor == 0) & (F.col("x") % factor == 0))


def resampled(pixels: DataFrame, bands: list[str], scale: float, methods: dict[str, str] | None = None, mask: str | None = None, keys: tuple[str, ...] = ("epsg",)) -> DataFrame:
    """Pixels on a grid ``scale`` times coarser: by band ``nearest``, ``average``, ``bilinear`` or ``cubic``; ``*`` sets the default.

    A mask band is always ``nearest``: classes aren't averaged. Nearest takes the block's centre pixel, the first
    valid towards it from the lower side. Bilinear weighs the four pixels around the block's centre, cubic the sixteen
    by convolution with a = -1/2; of these the null ones don't count, nor those beyond the edge.
    """
    methods = methods or {}
    how = lambda b: "nearest" if b == mask else methods.get(b, methods.get("*", "nearest"))
    ty, tx = F.floor(F.col("y") / scale).cast("int"), F.floor(F.col("x") / scale).cast("int")
    off = F.abs(F.col("y") + 0.5 - (ty + 0.5) * scale) + F.abs(F.col("x") + 0.5 - (tx + 0.5) * scale)
    placed = pixels.select(*keys, ty.alias("ty"), tx.alias("tx"), F.struct(off, F.col("y"), F.col("x")).alias("_off"), *bands)
    unknown = {how(b) for b in bands} - {"nearest", "average", *KERNELS}
    if unknown:
        raise ValueError(f"no resampling {sorted(unknown)}")
    smooth = [b for b in bands if how(b) in KERNELS]
    aggs = [(F.avg(b) if how(b) == "average" else F.min_by(b, "_off")).alias(b) for b in bands if b not in smooth]
    out = placed.groupBy(*keys, "ty", "tx").agg(F.count(F.lit(1)).alias("_n"), *aggs).drop("_n")
    for kernel in KERNELS:
        if some := [b for b in smooth if how(b) == kernel]:
            out = out.join(_convolved(pixels, some, scale, keys, kernel), [*keys, "ty", "tx"], "left")
    return out.select(*keys, F.col("ty").alias("y"), F.col("tx").alias("x"), *bands)


def _linear(d: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - d)


def _cubic(d: Column) -> Column:
    return F.when(d <= 1, 1.5 * d * d * d - 2.5 * d * d + 1).when(d < 2, -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2).otherwise(0.0)


#: Weight of a pixel by its distance along one axis, and how far it reaches.
KERNELS = {"bilinear": (_linear, 1), "cubic": (_cubic, 2)}


def _convolved(pixels: DataFrame, bands: list[str], scale: float, keys: tuple[str, ...], kernel: str) -> DataFrame:
    """Each pixel goes to the coarse pixels whose centre is in its reach, with its weight."""
    weight, reach = KERNELS[kernel]

    def reached(c: str) -> Column:
        lo, hi = F.ceil((F.col(c) + 0.5 - reach) / scale - 0.5), F.floor((F.col(c) + 0.5 + reach) / scale - 0.5)
        return F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.array().cast("array<int>"))

    near = lambda c, t: weight(F.abs(F.col(c) - ((F.col(t) + 0.5) * scale - 0.5)))
    each = pixels.select(*keys, "y", "x", *bands, F.explode(reached("y")).alias("ty")).select("*", F.explode(reached("x")).alias("tx"))
    weighed = each.withColumn("_w", near("y", "ty") * near("x", "tx")).where("_w <> 0")
    valid = lambda b: F.sum(F.when(F.col(b).isNotNull(), F.col("_w")))
    return weighed.groupBy(*keys, "ty", "tx").agg(*((F.sum(F.col("_w") * F.col(b)) / F.nullif(valid(b), F.lit(0.0))).alias(b) for b in bands))


def mask_input(pixels: DataFrame, factor: int, shift_by: Column | int = 0, bands: tuple[str, ...] = ("red", "green", "nir"), keys: tuple[str, ...] = ("epsg",)) -> DataFrame:
    """Bands for a cloud mask: averaged to its grid, valid values brought to the common encoding."""
    coarse = block_average(pixels, list(bands), factor, keys)
    return coarse.withColumns({b: saturating_shift(F.col(b), shift_by) for b in bands})


class Lazy:
    """A model that ``load`` makes in each worker at its first batch; only ``load`` travels, not the model."""

    def __init__(self, load: Callable[[], Callable]) -> None:
        self.load, self.model = load, None

    def __call__(self, rows):
        if self.model is None:
            self.model = self.load()
        return self.model(rows)

    def __getstate__(self) -> dict:
        return {"load": self.load, "model": None}


def predict_mask(pixels: DataFrame, predict, bands: tuple[str, ...] = ("red", "green", "nir"), out: str = "ocm") -> DataFrame:
    """A class for each pixel from ``predict(array of rows x bands) -> classes``; 255 where any band is 0.

    ``predict`` runs on Arrow batches; a model loads once for each worker if it loads lazily.
    """
    import numpy as np
    import pandas as pd

    @F.pandas_udf("int")
    def classes(*columns):
        return pd.Series(np.asarray(predict(np.column_stack(columns))).astype(np.int32))

    empty = F.lit(False)
    for b in bands:
        empty = empty | (F.col(b) == 0) | F.col(b).isNull()
    return pixels.withColumn(out, F.when(empty, MASK_NODATA).otherwise(classes(*(F.coalesce(F.col(b).cast("double"), F.lit(0.0)) for b in bands))))


def with_mask(obs: DataFrame, masks: DataFrame, band: str = "ocm", factor: int = 1) -> DataFrame:
    """Observations with their item's mask class by pixel; an item without a mask is an error.

    A mask pixel covers ``factor`` by ``factor`` pixels of the observations.
    """
    lacking = obs.select("item_id").distinct().join(masks.select("item_id").distinct(), "item_id", "left_anti").limit(1).collect()
    if lacking:
        raise ValueError(f"item {lacking[0][0]!r} has no mask")
    at = masks.select("item_id", "epsg", F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"), band)
    return obs.withColumns({"_y": F.expr(f"y div {factor}"), "_x": F.expr(f"x div {factor}")}).join(at, ["item_id", "epsg", "_y", "_x"], "left").drop("_y", "_x")
