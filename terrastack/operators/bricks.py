"""Composites over dense bricks: one row a brick and time step, each band a binary of its pixels.

The long form (one row a pixel) is the ground truth and what Catalyst optimises; this form is for scenes where nearly every
pixel has every step. A brick of 256 by 256 pixels travels as 128 kB instead of 65,536 rows, and steps of one brick
are reduced together as an array (time, pixel). Rows of a brick are one group: side * side * steps values, whatever the
area, so groups stay small and even.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("epsg", "by", "bx")


def network(n: int) -> list[tuple[int, int]]:
    """Compare-exchange steps that sort n lanes (Batcher's odd-even merge sort for any n)."""
    steps, p = [], 1
    while p < n:
        k = p
        while k >= 1:
            for j in range(k % p, n - k, 2 * k):
                for i in range(min(k, n - j - k)):
                    if (i + j) // (2 * p) == (i + j + k) // (2 * p):
                        steps.append((i + j, i + j + k))
            k //= 2
        p *= 2
    return steps


def sorted_lanes(values: np.ndarray) -> np.ndarray:
    """Columns of (time, pixel) sorted: whole lanes are compared at once, in blocks that stay in cache."""
    steps = network(len(values))
    for a in range(0, values.shape[1], 4096):
        block = values[:, a : a + 4096]
        low = np.empty(block.shape[1], block.dtype)
        for i, j in steps:
            np.minimum(block[i], block[j], out=low)
            np.maximum(block[i], block[j], out=block[j])
            block[i] = low
    return values


def reduce_steps(values: np.ndarray, valid: np.ndarray, method: str) -> np.ndarray:
    """(time, pixel) to float32 a pixel over the valid steps; NaN where there is none."""
    n = valid.sum(axis=0)
    none = n == 0
    with np.errstate(invalid="ignore", divide="ignore"):
        if method == "median":
            lanes = sorted_lanes(np.where(valid, values, np.float32(np.inf)).astype(np.float32))
            cols = np.arange(lanes.shape[1])
            out = (lanes[np.maximum(n - 1, 0) // 2, cols] + lanes[np.minimum(n // 2, len(lanes) - 1), cols]) / 2
        elif method == "mean":
            out = np.where(valid, values, 0).sum(axis=0, dtype=np.float64) / n
        elif method in ("min", "max"):
            end = np.float32(np.inf if method == "min" else -np.inf)
            out = getattr(np, method)(np.where(valid, values, end), axis=0)
        else:
            raise ValueError(f"no reduction {method!r} over bricks")
    return np.where(none, np.float32(np.nan), out).astype(np.float32)


def composite(bricks: DataFrame, bands: list[str], mask: str | None = None, mask_out: Iterable[int] = (), nodata: int | None = 0, method: str = "median", dtype: str = "uint16") -> DataFrame:
    """``(epsg, by, bx, band ..)`` with float32 pixels from ``bricks(epsg, by, bx, pos, band .., mask)``.

    ``mask`` holds uint8 classes. One exchange by brick, none if the rows are laid out by brick already.
    """
    bad = np.zeros(256, bool)
    bad[list(mask_out)] = True

    def reduce(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        used = [mask] if mask else []
        read = {c: np.stack([np.frombuffer(v, np.uint8 if c == mask else dtype) for v in rows.column(c).to_pylist()]) for c in [*bands, *used]}
        clear = ~bad[read[mask]] if mask else None
        out = []
        for b in bands:
            valid = read[b] != nodata if nodata is not None else np.ones(read[b].shape, bool)
            out.append(reduce_steps(read[b], valid if clear is None else valid & clear, method).tobytes())
        return pa.Table.from_arrays([*(pa.array([k.as_py()], pa.int32()) for k in key), *(pa.array([o], pa.binary()) for o in out)], names=[*KEYS, *bands])

    schema = "epsg int, by int, bx int, " + ", ".join(f"{b} binary" for b in bands)
    return bricks.select(*KEYS, *bands, *([mask] if mask else [])).groupBy(*KEYS).applyInArrow(reduce, schema)


def to_pixels(composites: DataFrame, bands: list[str], side: int) -> DataFrame:
    """Float32 bricks as rows ``(epsg, y, x, band ..)``, null for NaN."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = np.arange(side * side, dtype=np.int32)
                columns = [pa.array(np.frombuffer(r[b], np.float32), from_pandas=True) for b in bands]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(side * side, r["epsg"], np.int32)), pa.array(r["by"] * side + at // side), pa.array(r["bx"] * side + at % side), *columns], names=["epsg", "y", "x", *bands])

    return composites.select(*KEYS, *bands).mapInArrow(spread, "epsg int, y int, x int, " + ", ".join(f"{b} float" for b in bands))


def from_pixels(obs: DataFrame, bands: list[str], mask: str | None, side: int, dtype: str = "uint16") -> DataFrame:
    """Rows ``(epsg, y, x, pos, band .., mask)`` as bricks, one for each step ``pos``; pixels without a row are 0."""

    def gather(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        at = rows.column("y").to_numpy() % side * side + rows.column("x").to_numpy() % side
        out = []
        for c in [*bands, *([mask] if mask else [])]:
            pixels = np.zeros(side * side, np.uint8 if c == mask else dtype)
            pixels[at] = np.nan_to_num(rows.column(c).to_numpy())
            out.append(pa.array([pixels.tobytes()], pa.binary()))
        return pa.Table.from_arrays([*(pa.array([k.as_py()], t) for k, t in zip(key, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))), *out], names=[*KEYS, "pos", *bands, *([mask] if mask else [])])

    cols = [*bands, *([mask] if mask else [])]
    placed = obs.select("epsg", F.expr(f"cast(y div {side} as int)").alias("by"), F.expr(f"cast(x div {side} as int)").alias("bx"), F.col("pos").cast("long").alias("pos"), "y", "x", *cols)
    return placed.groupBy(*KEYS, "pos").applyInArrow(gather, "epsg int, by int, bx int, pos long, " + ", ".join(f"{c} binary" for c in cols))
