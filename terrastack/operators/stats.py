"""Statistics of downloads and loads, comparison of metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def percentiles(column: str, shares: Sequence[float]):
    """Inclusive, linearly interpolated percentiles, exact."""
    return F.percentile(column, F.array(*(F.lit(float(s)) for s in shares)))


def download_summary(downloads: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Files, bytes, seconds, throughput and percentiles of time and speed of ``downloads(name, seconds, n_bytes, error)``."""
    done = downloads.where("error is null").withColumn("speed", F.col("n_bytes") / F.col("seconds"))
    return done.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("n_bytes").alias("n_bytes"),
        (F.sum("n_bytes") / F.sum("seconds")).alias("throughput"),
        percentiles("seconds", (0.1, 0.5, 0.9, 0.99)).alias("seconds_p"),
        percentiles("speed", (0.01, 0.1, 0.5, 0.9)).alias("speed_p"),
        F.min("seconds").alias("fastest"),
        F.max("seconds").alias("slowest"),
    )


def slowest(downloads: DataFrame, n: int = 5) -> DataFrame:
    return downloads.where("error is null").orderBy(F.col("seconds").desc(), "name").limit(n)


def errors(downloads: DataFrame) -> DataFrame:
    return downloads.where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "error")


def missing_assets(failures: DataFrame, assets: DataFrame) -> DataFrame:
    """``(item_id, keys)`` of items all of whose failures are 404s of known assets; null keys where not.

    ``failures(item_id, url, status)``, ``assets(item_id, key, href)``; queries and fragments of links don't count.
    """
    plain = lambda c: F.regexp_replace(c, r"[?#].*$", "")
    told = failures.withColumn("_link", plain("url")).join(assets.select("item_id", "key", plain("href").alias("_link")), ["item_id", "_link"], "left")
    sure = F.every((F.col("status") == 404) & F.col("key").isNotNull())
    return told.groupBy("item_id").agg(F.when(sure, F.sort_array(F.collect_set("key"))).alias("keys"))


def metadata_diff(want: DataFrame, have: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """``(key, state)`` of entries that are missing, unexpected or different."""
    a, b = want.select(key, F.col(value).alias("_want"), F.lit(True).alias("_in_want")), have.select(key, F.col(value).alias("_have"), F.lit(True).alias("_in_have"))
    state = F.when(F.col("_in_have").isNull(), "missing").when(F.col("_in_want").isNull(), "unexpected").when(~F.col("_want").eqNullSafe(F.col("_have")), "differs")
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state is not null")


def load_footprint(obs: DataFrame, side: int, n_bands: int, workers: int = 1, item_bytes: int = 4) -> DataFrame:
    """``(steps, n_bytes, units)``: what the largest units take while they are reduced, all workers together, and how many share that shape.

    A unit holds its solar days, each ``side`` by ``side`` pixels of every band.
    """
    units = obs.groupBy("epsg", F.expr(f"y div {side}"), F.expr(f"x div {side}")).agg(F.count_distinct("solar_day").alias("steps"))
    shapes = units.groupBy("steps").agg(F.count(F.lit(1)).alias("units"))
    most = shapes.agg(F.max(F.struct("steps", "units")).alias("m")).select("m.*").where("steps is not null")
    return most.select("steps", (F.col("steps") * (side * side * n_bands * item_bytes * workers)).alias("n_bytes"), "units")


def observed(df: DataFrame, told: Observation, bands: Sequence[str]) -> DataFrame:
    """``df``, which tells ``told`` its rows and each band's valid values while it is read; no pass of its own."""
    return df.observe(told, F.count(F.lit(1)).alias("rows"), *(F.count(b).alias(f"valid_{b}") for b in bands))
