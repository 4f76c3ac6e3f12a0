"""How many items and time steps each shard has, before any pixel is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.functions.times import item_instant, solar_day
from terrastack.operators.catalog import ORBIT_STATES
from terrastack.operators.spatial import item_shards


def coverage(items: DataFrame, shards: DataFrame, side: float, by_orbit: bool = False) -> DataFrame:
    """``shards`` with ``n_items, n_timesteps`` (distinct solar days at the shard's centre), and items by orbit state.

    ``items(item_id, pos, dt, start_dt, end_dt, minx, .., orbit_state)``; shards without items count 0; skipped
    shards stay, flagged.
    """
    # a set of days a shard (thousands at most) instead of a distinct count: one exchange less
    pairs = item_shards(items, shards, side)
    keys = ["epsg", "shard_y", "shard_x"]
    instant = item_instant(F.col("dt"), F.col("start_dt"), F.col("end_dt"))
    day = solar_day(F.when(instant.isNull(), F.raise_error(F.lit("an item has no time"))).otherwise(instant), F.col("lon"))
    counts = [F.count("item_id").alias("n_items"), F.size(F.collect_set(day)).cast("long").alias("n_timesteps")]
    if by_orbit:
        counts += [F.count_if(F.col("orbit_state") == s).alias(f"n_{s}") for s in ORBIT_STATES]
    told = pairs.groupBy(*keys).agg(*counts)
    names = [c for c in told.columns if c not in keys]
    return shards.join(told, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})
