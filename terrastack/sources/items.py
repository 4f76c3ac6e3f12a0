"""Catalogue items: reading and writing them, fetching them page by page, copying assets."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = (
    "item_id string, pos long, source string, collection string, dt timestamp, start_dt timestamp, end_dt timestamp, minx double, miny double, maxx double, maxy double, geometry string, "
    "cloud_cover double, orbit_state string, grid_code string, mgrs_tile string, baseline string, offset_applied boolean, dn_offset int, dn_offset_from string, assets map<string, string>"
)


def flattened(features: DataFrame, source: str | None = None) -> DataFrame:
    """Items from ``features(pos, feature string)``: one GeoJSON feature a row, known properties typed."""
    f = F.col("feature")
    get = lambda p: F.get_json_object(f, p)
    bbox = F.from_json(get("$.bbox"), "array<double>")
    prop = lambda n: get(f"$.properties['{n}']")
    assets = F.transform_values(F.from_json(get("$.assets"), "map<string, string>"), lambda _, v: F.get_json_object(v, "$.href"))
    return features.select(
        get("$.id").alias("item_id"), F.col("pos").cast("long").alias("pos"), F.lit(source).alias("source"), get("$.collection").alias("collection"),
        prop("datetime").cast("timestamp").alias("dt"), prop("start_datetime").cast("timestamp").alias("start_dt"), prop("end_datetime").cast("timestamp").alias("end_dt"),
        F.get(bbox, F.lit(0)).alias("minx"), F.get(bbox, F.lit(1)).alias("miny"), F.get(bbox, F.lit(2)).alias("maxx"), F.get(bbox, F.lit(3)).alias("maxy"), get("$.geometry").alias("geometry"),
        prop("eo:cloud_cover").cast("double").alias("cloud_cover"), prop("sat:orbit_state").alias("orbit_state"), prop("grid:code").alias("grid_code"), prop("s2:mgrs_tile").alias("mgrs_tile"), prop("s2:processing_baseline").alias("baseline"),
        prop("earthsearch:boa_offset_applied").cast("boolean").alias("offset_applied"), F.lit(None).cast("int").alias("dn_offset"), F.lit(None).cast("string").alias("dn_offset_from"), assets.alias("assets"),
    )


def read_collection(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Items of a GeoJSON feature collection, in its order."""
    text = spark.read.text(path, wholetext=True)
    features = text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("pos", "feature"))
    return flattened(features, source)


def write_items(items: DataFrame, path: str) -> bool:
    """Hand items to the next step; nothing happens if they are there already."""
    from terrastack.sources.files import exists

    if exists(items.sparkSession, path + "/_SUCCESS"):
        return False
    items.write.mode("overwrite").parquet(path)
    return True


class PageReader(DataSourceReader):
    """One partition for each month of the range, so a long search is fetched by many tasks."""

    def __init__(self, options: dict[str, str], fetch: Callable[[dict[str, str]], Iterator[dict]]) -> None:
        self.options, self.fetch = dict(options), fetch

    def partitions(self) -> list[InputPartition]:
        import datetime as dt

        days = self.options.get("datetime", "")
        if "/" not in days or ".." in days:
            return [InputPartition((0, days))]
        first, last = (dt.date.fromisoformat(d[:10]) for d in days.split("/"))
        out = []
        while first <= last:
            end = min(last, (first.replace(day=1) + dt.timedelta(days=32)).replace(day=1) - dt.timedelta(days=1))
            out.append(InputPartition((len(out), f"{first}/{end}")))
            first = end + dt.timedelta(days=1)
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        month, days = partition.value
        for i, feature in enumerate(self.fetch(self.options | {"datetime": days})):
            yield (month << 40) + i, json.dumps(feature)  # one order over all months


def catalogue_source(fetch: Callable[[dict[str, str]], Iterator[dict]], name: str = "stac") -> type[DataSource]:
    """A data source named ``name``: ``spark.read.format(name).option(..)`` over a function that fetches features.

    ``fetch(options)`` yields GeoJSON features for collection, bbox, datetime and limit; register with
    ``spark.dataSource.register``. The network stays outside, so tests pass a fake.
    """

    class Catalogue(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "pos long, feature string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return PageReader(dict(self.options), fetch)

    return Catalogue


def retrying(copy: Callable[[str, str], int], attempts: int = 4, wait: float = 1.0, give_up: Callable[[Exception], bool] = lambda e: False) -> Callable[[str, str], int]:
    """``copy`` tried again after an error, waiting twice as long each time, unless ``give_up`` says it is of no use."""

    def again(href: str, target: str) -> int:
        import time

        for left in range(attempts - 1, -1, -1):
            try:
                return copy(href, target)
            except Exception as e:  # noqa: BLE001  the last one is raised
                if not left or give_up(e):
                    raise
                time.sleep(wait * 2 ** (attempts - 1 - left))
        raise ValueError("no attempt")

    return again


def copy_assets(items: DataFrame, cache: str, keys: list[str], copy: Callable[[str, str], int], done: DataFrame | None = None) -> DataFrame:
    """``downloads(name, item_id, key, href, seconds, n_bytes, error, status)`` of assets copied to ``cache/<item>/<key><suffix>``.

    ``copy(href, target)`` returns the bytes; it must write a temporary file and rename it. What ``done(item_id, key)``
    holds is skipped, items lacking a key just lack it, and an error is a row, not a failure of the job.
    """
    import time

    import pandas as pd

    from terrastack.functions.strings import suffix_of

    wanted = items.select("item_id", F.explode("assets").alias("key", "href")).where(F.col("key").isin(keys))
    if done is not None:
        wanted = wanted.join(done.select("item_id", "key"), ["item_id", "key"], "left_anti")
    wanted = wanted.withColumn("target", F.concat(F.lit(cache + "/"), "item_id", F.lit("/"), "key", suffix_of(F.col("href"))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                start, n, error, status = time.monotonic(), None, None, None
                try:
                    n = copy(r.href, r.target)
                except Exception as e:  # noqa: BLE001  reported as a row
                    error, status = f"{type(e).__name__}: {e}", getattr(e, "code", None)
                rows.append((f"{r.item_id}/{r.key}", r.item_id, r.key, r.href, time.monotonic() - start, n, error, status))
            yield pd.DataFrame(rows, columns=["name", "item_id", "key", "href", "seconds", "n_bytes", "error", "status"])

    return wanted.mapInPandas(run, "name string, item_id string, key string, href string, seconds double, n_bytes long, error string, status long")


def patched(items: DataFrame, patch: Callable[[str], str]) -> DataFrame:
    """Items with each link of their assets replaced by ``patch(link)``, a signer for instance; it travels to the executors."""

    @F.pandas_udf("array<string>")
    def links(column):
        return column.map(lambda hrefs: None if hrefs is None else [None if h is None else patch(h) for h in hrefs])

    return items.withColumn("assets", F.map_from_arrays(F.map_keys("assets"), links(F.map_values("assets"))))


def kept_items(items: DataFrame, missing: DataFrame) -> DataFrame:
    """Items without the assets that turned out missing; an item left without any goes. ``missing(item_id, keys)``."""
    out = items.join(missing.where("keys is not null"), "item_id", "left")
    assets = F.map_filter("assets", lambda k, _: ~F.coalesce(F.array_contains("keys", k), F.lit(False)))
    return out.withColumn("assets", assets).where(F.size("assets") > 0).select(*items.columns)
