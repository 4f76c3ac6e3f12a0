"""Queries over the test tables, by name, with their SQL for DuckDB.

The tables stand in for catalogues, observations and footprints; places are derived from keys by arithmetic that
both engines do alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import terrastack.packaging  # noqa: F401  functions travel by value
from terrastack.functions import geo, strings, times
from terrastack.operators import catalog, composite, coverage, footprints, raster, spatial, stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lon(key: Column) -> Column:
    return (key * 37 % 3600) / 10.0 - 180


def lat(key: Column) -> Column:
    return (key * 53 % 1600) / 10.0 - 80


LON, LAT = "(({0} * 37 % 3600) / 10.0::DOUBLE - 180)", "(({0} * 53 % 1600) / 10.0::DOUBLE - 80)"

# ---------------------------------------------------------------- composites


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: a user is a pixel, the kind of event its class."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 2 * 100 + 32636).cast("int").alias("epsg"), (F.col("user_id") % 100).cast("int").alias("y"), F.expr("user_id div 100").cast("int").alias("x"), F.col("event_id").alias("pos"), F.col("ts").alias("dt"),
        times.solar_day(F.col("ts"), lon(F.col("user_id"))).alias("solar_day"), "value", F.when(F.col("event_type") == "error", 9).otherwise(4).alias("scl"), (F.when(F.col("event_id") % 3 == 0, 0).otherwise(1000)).alias("dn_offset"),
        F.when(F.col("event_id") % 2 == 0, "ascending").otherwise("descending").alias("orbit_state"), F.col("event_id").cast("string").alias("item_id"),
    )


OBS = """obs AS (SELECT CAST(user_id % 2 * 100 + 32636 AS INTEGER) AS epsg, CAST(user_id % 100 AS INTEGER) AS y, CAST(user_id // 100 AS INTEGER) AS x, event_id AS pos, ts AS dt,
  CAST(ts + to_hours(CAST(trunc(((user_id * 37 % 3600) / 10.0::DOUBLE - 180) / 15) AS INTEGER)) AS DATE) AS solar_day, value,
  CASE WHEN event_type = 'error' THEN 9 ELSE 4 END AS scl, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1000 END AS dn_offset,
  CASE WHEN event_id % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit_state FROM events)"""


@query(f"WITH {OBS} SELECT epsg, y, x, median(CASE WHEN scl NOT IN (0, 1, 3, 7, 8, 9, 10) THEN value END) AS value FROM obs GROUP BY epsg, y, x")
def masked_median_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.mosaic(observations(spark, sf_dir).drop("dn_offset"), ["value"], mask="scl", mask_out=composite.SCENE_MASK, fuse=False)


def _reductions(method: str, sql: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = composite.mosaic(observations(spark, sf_dir).drop("dn_offset"), ["value"], mask="scl", mask_out=composite.SCENE_MASK, method=method, fuse=False)
        return out.withColumn("value", F.round(F.col("value").cast("double"), 5))

    f.__name__ = f"composite_{method}"
    query(f"WITH {OBS}, clear AS (SELECT epsg, y, x, CASE WHEN scl NOT IN (0, 1, 3, 7, 8, 9, 10) THEN value END AS value FROM obs) SELECT epsg, y, x, round(CAST({sql} AS DOUBLE), 5) AS value FROM clear GROUP BY epsg, y, x")(f)


for _method, _sql in (("mean", "avg(value)"), ("min", "min(value)"), ("max", "max(value)"), ("std", "stddev_pop(value)"), ("var", "var_pop(value)"), ("sum", "coalesce(sum(value), 0)"), ("count", "count(value)")):
    _reductions(_method, _sql)


@query("SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount, nullif(l_tax, 0) AS l_tax, l_quantity FROM lineitem")
def nodata_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    return composite.missing_to_null(rows, {"l_discount": 0.0, "l_tax": 0.0, "l_quantity": 1.0}, exclude=["l_quantity"])


@query(f"WITH {OBS} SELECT epsg, y, x, solar_day, arg_min(value, pos) FILTER (value IS NOT NULL) AS value FROM obs GROUP BY epsg, y, x, solar_day")
def solar_day_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.fused(observations(spark, sf_dir), ["value"])


@query(f"WITH {OBS} SELECT epsg, y, x, median(value) FILTER (orbit_state = 'ascending') AS value_ascending, median(value) FILTER (orbit_state = 'descending') AS value_descending FROM obs GROUP BY epsg, y, x")
def orbit_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.composite_by_orbit(observations(spark, sf_dir), ["value"])


@query(
    f"""WITH {OBS}, fused AS (SELECT epsg, y, x, solar_day, dn_offset, orbit_state, arg_min(value + 1000 - dn_offset, pos) FILTER (value IS NOT NULL) AS value, arg_min(scl, pos) AS scl
  FROM obs GROUP BY epsg, y, x, solar_day, dn_offset, orbit_state)
  SELECT epsg, y, x, round(median(CASE WHEN scl NOT IN (0, 1, 3, 7, 8, 9, 10) THEN value END), 6) AS red FROM fused GROUP BY epsg, y, x"""
)
def full_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = composite.mosaic(observations(spark, sf_dir).withColumnRenamed("value", "red"), ["red"], mask="scl", mask_out=composite.SCENE_MASK)
    return out.withColumn("red", F.round("red", 6))


@query("WITH shifted AS (SELECT o_custkey, o_totalprice + CASE WHEN o_orderpriority = '1-URGENT' THEN 1000 ELSE 0 END AS red FROM orders) SELECT o_custkey, round(min(red), 4) AS red FROM shifted GROUP BY o_custkey")
def dn_harmonized_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("red"), F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1000).alias("dn_offset"))
    return composite.composite(composite.harmonised(rows, ["red"]), ["red"], "min", ["o_custkey"]).withColumn("red", F.round("red", 4))


@query(f"WITH {OBS} SELECT epsg, y, x, median(value) AS value FROM obs GROUP BY epsg, y, x")
def brick_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.bricks(observations(spark, sf_dir), ["value"], side=32)


@query(
    """SELECT l_orderkey, l_linenumber, place, band, value FROM (
  SELECT l_orderkey, l_linenumber, CAST(0 AS INTEGER) AS place, 'l_quantity' AS band, CAST(l_quantity AS REAL) AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 1, 'l_discount', CAST(l_discount AS REAL) FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 2, 'l_tax', CAST(l_tax AS REAL) FROM lineitem)"""
)
def band_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composite.stacked(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- catalogue


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scenes."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    x, y = lon(key), lat(key)
    return o.select(
        key.cast("string").alias("item_id"), key.alias("pos"), F.when(key % 2 == 0, "earthsearch").otherwise("planetary-computer").alias("source"),
        F.when(key % 4 == 0, "sentinel-2-c1-l2a").otherwise("sentinel-2-l2a").alias("collection"), F.col("o_orderdate").alias("dt"), F.lit(None).cast("timestamp_ntz").alias("start_dt"), F.lit(None).cast("timestamp_ntz").alias("end_dt"),
        x.alias("minx"), y.alias("miny"), (x + 0.5).alias("maxx"), (y + 0.5).alias("maxy"), (key * 7 % 100).cast("double").alias("cloud_cover"),
        F.when(key % 3 == 0, "ascending").otherwise("descending").alias("orbit_state"), F.when(key % 5 > 0, F.concat(F.lit("MGRS-"), (F.col("o_custkey") % 500).cast("string"))).alias("grid_code"),
        F.when(key % 5 == 0, (F.col("o_custkey") % 500).cast("string")).alias("mgrs_tile"), F.when(key % 7 > 0, F.concat(F.lit("0"), F.substring("o_orderpriority", 1, 1), F.lit(".00"))).alias("baseline"),
        (key % 3 == 1).alias("offset_applied"), F.col("o_totalprice").alias("price"),
    )


ITEMS = f"""items AS (SELECT CAST(o_orderkey AS VARCHAR) AS item_id, o_orderkey AS pos, CASE WHEN o_orderkey % 2 = 0 THEN 'earthsearch' ELSE 'planetary-computer' END AS source,
  CASE WHEN o_orderkey % 4 = 0 THEN 'sentinel-2-c1-l2a' ELSE 'sentinel-2-l2a' END AS collection, o_orderdate AS dt,
  {LON.format('o_orderkey')} AS minx, {LAT.format('o_orderkey')} AS miny, {LON.format('o_orderkey')} + 0.5 AS maxx, {LAT.format('o_orderkey')} + 0.5 AS maxy,
  CAST(o_orderkey * 7 % 100 AS DOUBLE) AS cloud_cover, CASE WHEN o_orderkey % 3 = 0 THEN 'ascending' ELSE 'descending' END AS orbit_state,
  CASE WHEN o_orderkey % 5 > 0 THEN 'MGRS-' || (o_custkey % 500) END AS grid_code, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey % 500 AS VARCHAR) END AS mgrs_tile,
  CASE WHEN o_orderkey % 7 > 0 THEN '0' || substr(o_orderpriority, 1, 1) || '.00' END AS baseline, o_orderkey % 3 = 1 AS offset_applied FROM orders)"""


@query(
    f"""WITH {ITEMS} SELECT item_id, dt, cloud_cover, orbit_state FROM items WHERE collection = 'sentinel-2-l2a' AND minx <= 60 AND maxx >= -60 AND miny <= 40 AND maxy >= -40
  AND CAST(dt AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1997-06-30' AND cloud_cover < 20 AND orbit_state = 'ascending'"""
)
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.search(items(spark, sf_dir), "sentinel-2-l2a", (-60, -40, 60, 40), "1995-01-01/1997-06-30", 20, "ascending")
    return found.select("item_id", "dt", "cloud_cover", "orbit_state")


@query(f"WITH {ITEMS} SELECT item_id, baseline FROM items QUALIFY row_number() OVER (PARTITION BY coalesce(grid_code, 'MGRS-' || mgrs_tile, item_id), CAST(dt AS DATE) ORDER BY coalesce(baseline, '0') DESC, pos) = 1")
def baseline_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.best_versions(items(spark, sf_dir)).select("item_id", "baseline")


def shifted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes with dates around the unclear window of 2022."""
    return items(spark, sf_dir).withColumn("dt", F.expr("timestamp_ntz'2022-01-01 00:00:00' + make_dt_interval(cast(pos % 90 as int))"))


RULES = """CASE WHEN source = 'earthsearch' AND collection = 'sentinel-2-c1-l2a' THEN 1000
  WHEN source = 'earthsearch' AND collection = 'sentinel-2-l2a' THEN CASE WHEN unclear THEN {pixels} ELSE 0 END
  WHEN source = 'planetary-computer' AND collection = 'sentinel-2-l2a' THEN CASE WHEN coalesce(baseline, '00.00') >= '04.00' THEN 1000 ELSE 0 END END"""
SHIFTED = f"""{ITEMS}, shifted AS (SELECT * REPLACE (TIMESTAMP '2022-01-01' + to_days(CAST(pos % 90 AS INTEGER)) AS dt) FROM items),
  flagged AS (SELECT *, coalesce(offset_applied = false AND coalesce(baseline, '00.00') >= '04.00' AND CAST(dt AS DATE) BETWEEN DATE '2022-01-25' AND DATE '2022-02-27', false) AS unclear FROM shifted)"""


@query(
    f"""WITH {SHIFTED} SELECT item_id, CAST({RULES.format(pixels='1000')} AS INTEGER) AS dn_offset,
  CASE WHEN source = 'earthsearch' AND collection = 'sentinel-2-l2a' AND unclear THEN 'date' WHEN ({RULES.format(pixels='1000')}) IS NOT NULL THEN 'metadata' END AS dn_offset_from FROM flagged"""
)
def dn_offset_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_offsets(shifted_items(spark, sf_dir)).select("item_id", "dn_offset", "dn_offset_from")


PIXELS = "pixels AS (SELECT l_suppkey, CAST(l_quantity * 100 AS INTEGER) AS blue, CAST(l_linenumber + 2 AS INTEGER) AS scl FROM lineitem WHERE l_quantity > 0)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity > 0").select("l_suppkey", (F.col("l_quantity") * 100).cast("int").alias("blue"), (F.col("l_linenumber") + 2).cast("int").alias("scl"))


@query(
    f"""WITH {PIXELS}, stats AS (SELECT l_suppkey, count(*) AS n_dark, avg(CASE WHEN blue < 1000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share FROM pixels WHERE scl IN (4, 6) AND blue > 0 GROUP BY l_suppkey)
  SELECT l_suppkey, n_dark, round(share, 9) AS share_below, CAST(CASE WHEN n_dark < 20 THEN NULL WHEN share <= 0.02 THEN 1000 WHEN share >= 0.5 THEN 0 END AS INTEGER) AS dn_offset FROM stats"""
)
def dark_pixel_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.offset_from_pixels(pixels(spark, sf_dir), item="l_suppkey", least=20).withColumn("share_below", F.round("share_below", 9))


@query(
    """WITH ranges AS (SELECT o_orderkey, 'earthsearch' AS source, CASE WHEN o_orderkey % 2 = 0 THEN 'sentinel-2-c1-l2a' ELSE 'sentinel-2-l2a' END AS collection,
    CAST(CAST(DATE '2014-01-01' + CAST(o_orderkey % 4000 AS INTEGER) AS DATE) AS DATE) AS first, CAST(DATE '2014-01-01' + CAST(o_orderkey % 4000 + o_custkey % 200 AS INTEGER) AS DATE) AS last FROM orders),
  gaps(source, collection, s, e, fallback, confirm) AS (VALUES ('earthsearch', 'sentinel-2-c1-l2a', DATE '2015-06-23', DATE '2019-03-21', 'sentinel-2-l2a', true), ('earthsearch', 'sentinel-2-c1-l2a', DATE '2022-01-01', DATE '2022-12-05', 'sentinel-2-l2a', false)),
  told AS (SELECT r.*, g.s, g.fallback, CASE WHEN g.s IS NULL THEN 'kept' WHEN NOT (r.first >= g.s AND r.last <= g.e) THEN 'refused' WHEN g.confirm THEN 'needs acceptance' ELSE 'fallback' END AS outcome
    FROM ranges r LEFT JOIN gaps g ON r.source = g.source AND r.collection = g.collection AND r.last >= g.s AND r.first <= g.e)
  SELECT o_orderkey, source, collection, first, last, CASE WHEN outcome = 'kept' THEN collection WHEN outcome <> 'refused' THEN fallback END AS routed, outcome FROM told
  QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY s NULLS FIRST) = 1"""
)
def gap_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start = F.date_add(F.lit("2014-01-01").cast("date"), (F.col("o_orderkey") % 4000).cast("int"))
    ranges = o.select("o_orderkey", F.lit("earthsearch").alias("source"), F.when(F.col("o_orderkey") % 2 == 0, "sentinel-2-c1-l2a").otherwise("sentinel-2-l2a").alias("collection"), start.alias("first"), F.date_add(start, (F.col("o_custkey") % 200).cast("int")).alias("last"))
    return catalog.route(ranges, catalog.gap_table(spark))


@query(
    """SELECT event_id, list_aggregate(list_sort([CASE event_type WHEN 'click' THEN 'red' WHEN 'error' THEN 'scl' ELSE event_type END, 'visual']), 'string_agg', ',') AS keys FROM events"""
)
def asset_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    assets = F.create_map("event_type", F.lit("a"), F.lit("visual"), F.lit("b"))
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(catalog.renamed_assets(assets, {"click": "red", "error": "scl"}))), ",").alias("keys"))


@query(
    f"""SELECT c_custkey, substr(sha1(concat_ws('_', printf('%.6f', {LON.format('c_custkey')}), printf('%.6f', {LAT.format('c_custkey')}), printf('%.6f', {LON.format('c_custkey')} + 0.25), printf('%.6f', {LAT.format('c_custkey')} + 0.25))), 1, 12) AS tile_key FROM customer"""
)
def tile_key_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", strings.tile_key(lon(key), lat(key), lon(key) + 0.25, lat(key) + 0.25).alias("tile_key"))


@query(
    """SELECT c_custkey, 'https://' || c_mktsegment || '.s3.amazonaws.com/' || c_custkey || '/a.tif' AS link, '.tif' AS suffix FROM customer"""
)
def asset_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    href = F.concat(F.lit("s3://"), F.col("c_mktsegment"), F.lit("/"), F.col("c_custkey").cast("string"), F.lit("/a.tif?sig=1"))
    link = strings.without_query(strings.public_link(href))
    return table(spark, sf_dir, "customer").select("c_custkey", link.alias("link"), strings.suffix_of(href).alias("suffix"))


# ---------------------------------------------------------------- grids and joins


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.cast("string").alias("item_id"), key.alias("pos"), lon(key).alias("minx"), lat(key).alias("miny"), (lon(key) + 2).alias("maxx"), (lat(key) + 1).alias("maxy"), F.lit("2024-02-29 23:30:00").cast("timestamp_ntz").alias("dt"), F.lit(None).cast("timestamp_ntz").alias("start_dt"), F.lit(None).cast("timestamp_ntz").alias("end_dt"), F.when(key % 3 == 0, "ascending").otherwise("descending").alias("orbit_state"))


BOXES = f"boxes AS (SELECT c_custkey, {LON.format('c_custkey')} AS minx, {LAT.format('c_custkey')} AS miny, {LON.format('c_custkey')} + 2 AS maxx, {LAT.format('c_custkey')} + 1 AS maxy FROM customer)"
AOI = (-30.0, -20.0, 45.0, 30.0)
ZONES = """zones AS (SELECT CAST(b + n AS INTEGER) AS epsg, greatest(-30.0, -186.0 + 6 * n) AS west, least(45.0, -180.0 + 6 * n) AS east, -20.0 AS south, 30.0 AS north
  FROM generate_series(1, 60) t(n), (VALUES (32600), (32700)) v(b) WHERE -186 + 6 * n < 45 AND -180 + 6 * n > -30)"""


@query(f"WITH {BOXES}, {ZONES} SELECT CAST(c_custkey AS VARCHAR) AS item_id, epsg FROM boxes JOIN zones ON minx < east AND maxx > west AND miny < north AND maxy > south")
def utm_zone_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.by_zone(boxes(spark, sf_dir), geo.zones(spark, AOI)).select("item_id", "epsg")


@query("SELECT * FROM (VALUES (CAST(32633 AS INTEGER), CAST(33 AS INTEGER), 11.4::DOUBLE, 18.0::DOUBLE), (32634, 34, 18.0, 22.5)) t(epsg, zone, west, east)")
def zone_extent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.zones(spark, (11.4, 41.0, 22.5, 49.0)).select("epsg", "zone", "west", "east")


@query(
    """SELECT CAST(j AS INTEGER) AS shard_y, CAST(i AS INTEGER) AS shard_x, CAST(j * 64 AS INTEGER) AS y0, CAST(least((j + 1) * 64, 1000) AS INTEGER) AS y1, CAST(i * 64 AS INTEGER) AS x0, CAST(least((i + 1) * 64, 1500) AS INTEGER) AS x1
  FROM generate_series(0, 15) a(j), generate_series(0, 23) b(i)"""
)
def shard_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.shard_grid(spark, 1000, 1500, 64)


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as shards of 3 by 3 degrees."""
    key = F.col("s_suppkey")
    x, y = lon(key * 11), lat(key * 7)
    return table(spark, sf_dir, "supplier").select(F.lit(32636).alias("epsg"), key.cast("int").alias("shard_y"), F.lit(0).alias("shard_x"), x.alias("sminx"), y.alias("sminy"), (x + 3).alias("smaxx"), (y + 3).alias("smaxy"), (x + 1.5).alias("lon"), (key % 10 == 0).alias("skipped"))


_X, _Y = LON.format("(s_suppkey * 11)"), LAT.format("(s_suppkey * 7)")
SHARDS = f"shards AS (SELECT CAST(s_suppkey AS INTEGER) AS shard_y, {_X} AS sminx, {_Y} AS sminy, {_X} + 3 AS smaxx, {_Y} + 3 AS smaxy, {_X} + 1.5 AS lon, s_suppkey % 10 = 0 AS skipped FROM supplier)"
MEET = "minx <= smaxx AND maxx >= sminx AND miny <= smaxy AND maxy >= sminy"


@query(f"WITH {BOXES}, {SHARDS} SELECT CAST(c_custkey AS VARCHAR) AS item_id, shard_y FROM boxes JOIN shards ON {MEET}")
def item_shard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.item_shards(boxes(spark, sf_dir), shards(spark, sf_dir), 3.0).select("item_id", "shard_y")


@query(
    f"""WITH {BOXES}, {SHARDS} SELECT shard_y, skipped, count(c_custkey) AS n_items, count(DISTINCT CASE WHEN c_custkey IS NOT NULL THEN CAST(TIMESTAMP '2024-02-29 23:30:00' + to_hours(CAST(trunc(lon / 15) AS INTEGER)) AS DATE) END) AS n_timesteps,
  count(CASE WHEN c_custkey % 3 = 0 THEN 1 END) AS n_ascending, count(CASE WHEN c_custkey % 3 <> 0 THEN 1 END) AS n_descending FROM shards LEFT JOIN boxes ON {MEET} GROUP BY shard_y, skipped"""
)
def shard_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.coverage(boxes(spark, sf_dir), shards(spark, sf_dir), 3.0, by_orbit=True)
    return out.select("shard_y", "skipped", "n_items", "n_timesteps", "n_ascending", "n_descending")


@query(
    """SELECT CAST(j AS INTEGER) AS shard_y, CAST(i AS INTEGER) AS shard_x FROM generate_series(0, 15) a(j), generate_series(0, 23) b(i) WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 16 = j AND n_regionkey * 4 = i)"""
)
def skip_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    skips = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 16).cast("int").alias("shard_y"), (F.col("n_regionkey") * 4).cast("int").alias("shard_x"))
    return spatial.pending(geo.shard_grid(spark, 1000, 1500, 64), skips, ["shard_y", "shard_x"]).select("shard_y", "shard_x")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < TIMESTAMP '1995-06-01')")
def pending_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_shipdate < timestamp_ntz'1995-06-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return spatial.pending(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("SELECT o_orderstatus, bool_and(EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS complete, count(*) AS units FROM orders GROUP BY o_orderstatus")
def store_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("done", F.lit(True))
    plan = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(done, "o_orderkey", "left")
    return plan.groupBy("o_orderstatus").agg(F.every(F.coalesce("done", F.lit(False))).alias("complete"), F.count(F.lit(1)).alias("units"))


@query(
    """WITH old AS (SELECT j, i, (j * 7 + i * 3) % 4 <> 0 AS skipped FROM generate_series(0, 15) a(j), generate_series(0, 23) b(i)),
  new AS (SELECT j, i, j * 96 AS y0, least((j + 1) * 96, 1000) AS y1, i * 96 AS x0, least((i + 1) * 96, 1500) AS x1 FROM generate_series(0, 10) a(j), generate_series(0, 15) b(i))
  SELECT CAST(new.j AS INTEGER) AS shard_y, CAST(new.i AS INTEGER) AS shard_x, bool_and(old.skipped) AS skipped FROM new JOIN old ON old.j BETWEEN y0 // 64 AND (y1 - 1) // 64 AND old.i BETWEEN x0 // 64 AND (x1 - 1) // 64 GROUP BY new.j, new.i"""
)
def rechunk_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = geo.shard_grid(spark, 1000, 1500, 64).withColumn("skipped", (F.col("shard_y") * 7 + F.col("shard_x") * 3) % 4 != 0)
    return spatial.carried_skips(geo.shard_grid(spark, 1000, 1500, 96), old, 64).select("shard_y", "shard_x", "skipped")


@query("SELECT o_orderkey FROM orders WHERE ((o_orderkey % 7) + 7) % 7 = 3")
def random_task_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.share(table(spark, sf_dir, "orders").select("o_orderkey"), 3, 7, "o_orderkey")


# ---------------------------------------------------------------- footprints

FOOT_BOX, FOOT_N = (-90.0, -40.0, 90.0, 40.0), (9, 4)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", lon(key).alias("lon"), lat(key).alias("lat"))


def even_tiles(spark: SparkSession) -> DataFrame:
    return spark.range(FOOT_N[1]).select(F.col("id").cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(FOOT_N[0] - 1))).alias("i"))


@query(
    f"""WITH points AS (SELECT c_custkey, {LON.format('c_custkey')} AS lon, {LAT.format('c_custkey')} AS lat FROM customer),
  tiles AS (SELECT j, i, -90.0 + 20 * i AS w, -70.0 + 20 * i AS e, -40.0 + 20 * j AS s, -20.0 + 20 * j AS n FROM generate_series(0, 3) a(j), generate_series(0, 8) b(i))
  SELECT c_custkey, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i FROM points JOIN tiles ON lon >= w AND (lon < e OR (e = 90 AND lon = e)) AND lat >= s AND (lat < n OR (n = 40 AND lat = n))"""
)
def footprint_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprints.tiled(points(spark, sf_dir), even_tiles(spark), FOOT_BOX, *FOOT_N).select("c_custkey", "j", "i")


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as footprints: the vector, longer by itself, is the array of heights."""
    e = table(spark, sf_dir, "embeddings")
    key = F.col("vec_id")
    return e.select("vec_id", F.timestamp_seconds(key * 1000 % 7919).alias("time"), lon(key).alias("lon"), lat(key).alias("lat"), (key % 20 - 10).cast("double").alias("solar_elevation"), (key % 10 / 10.0 + 0.05).alias("sensitivity"), F.concat("embedding", "embedding").alias("rh"))


SHOTS = f"shots AS (SELECT vec_id, {LON.format('vec_id')} AS lon, {LAT.format('vec_id')} AS lat, CAST(vec_id % 20 - 10 AS DOUBLE) AS solar_elevation, vec_id % 10 / 10.0::DOUBLE + 0.05 AS sensitivity, list_concat(embedding, embedding) AS rh FROM embeddings)"


@query(f"WITH {SHOTS} SELECT vec_id, solar_elevation, sensitivity FROM shots WHERE solar_elevation <= 0 AND sensitivity >= 0.9 AND rh[99] BETWEEN 0 AND 80")
def footprint_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprints.good_heights(shots(spark, sf_dir)).select("vec_id", "solar_elevation", "sensitivity")


@query(f"WITH {SHOTS} SELECT vec_id FROM shots WHERE sensitivity >= 0.9")
def biomass_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprints.good_biomass(shots(spark, sf_dir)).select("vec_id")


@query(f"WITH {SHOTS} SELECT vec_id, rh[1] AS rh0, rh[51] AS rh50, rh[101] AS rh100, rh[201] AS rh200 FROM shots")
def expand_rh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footprints.expand_heights(shots(spark, sf_dir), (0, 50, 100, 200)).select("vec_id", "rh0", "rh50", "rh100", "rh200")


@query(f"WITH {SHOTS} SELECT vec_id, sensitivity FROM shots WHERE lon < 0 UNION ALL SELECT vec_id, sensitivity FROM shots WHERE lon >= 0")
def footprints_sorted_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir).select("time", "vec_id", "sensitivity", "lon")
    return footprints.united([s.where("lon < 0"), s.where("lon >= 0")]).select("vec_id", "sensitivity")


# ---------------------------------------------------------------- statistics and pixels


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value > 0")
    return e.select("event_type", F.col("event_id").cast("string").alias("name"), F.col("value").alias("seconds"), (F.col("event_id") % 1000 + 1).alias("n_bytes"), F.when(F.col("event_type") == "error", F.concat(F.lit("status "), (F.col("event_id") % 5).cast("string"))).alias("error"))


@query(
    """WITH d AS (SELECT event_type, value AS seconds, event_id % 1000 + 1 AS n_bytes FROM events WHERE value > 0 AND event_type <> 'error')
  SELECT event_type, count(*) AS files, CAST(sum(n_bytes) AS BIGINT) AS n_bytes, round(sum(n_bytes) / sum(seconds), 6) AS throughput, round(quantile_cont(seconds, 0.5), 6) AS p50, round(quantile_cont(seconds, 0.99), 6) AS p99,
  round(quantile_cont(n_bytes / seconds, 0.01), 6) AS slow, min(seconds) AS fastest, max(seconds) AS slowest FROM d GROUP BY event_type"""
)
def download_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.download_summary(downloads(spark, sf_dir), ["event_type"])
    return out.select("event_type", "files", "n_bytes", F.round("throughput", 6).alias("throughput"), F.round(F.col("seconds_p")[1], 6).alias("p50"), F.round(F.col("seconds_p")[3], 6).alias("p99"), F.round(F.col("speed_p")[0], 6).alias("slow"), "fastest", "slowest")


@query("SELECT CAST(event_id AS VARCHAR) AS name, value AS seconds FROM events WHERE value > 0 AND event_type <> 'error' ORDER BY value DESC, CAST(event_id AS VARCHAR) LIMIT 5")
def slowest_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.slowest(downloads(spark, sf_dir)).select("name", "seconds")


@query("SELECT 'status ' || (event_id % 5) AS error, count(*) AS n FROM events WHERE value > 0 AND event_type = 'error' GROUP BY 1")
def download_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.errors(downloads(spark, sf_dir))


@query(
    """WITH f AS (SELECT o_custkey AS item_id, 'k' || (o_orderkey % 5) AS key, CASE WHEN o_orderkey % 11 = 0 THEN 500 ELSE 404 END AS status FROM orders)
  SELECT item_id, CASE WHEN bool_and(status = 404 AND key <> 'k4') THEN string_agg(DISTINCT key, ',' ORDER BY key) END AS keys FROM f GROUP BY item_id"""
)
def missing_asset_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    url = F.concat(F.lit("https://x/"), F.col("o_custkey").cast("string"), F.lit("/k"), (F.col("o_orderkey") % 5).cast("string"))
    failures = o.select(F.col("o_custkey").alias("item_id"), F.concat(url, F.lit("?t=1")).alias("url"), F.when(F.col("o_orderkey") % 11 == 0, 500).otherwise(404).alias("status"))
    known = o.where("o_orderkey % 5 < 4").select(F.col("o_custkey").alias("item_id"), F.concat(F.lit("k"), (F.col("o_orderkey") % 5).cast("string")).alias("key"), url.alias("href")).distinct()
    return stats.missing_assets(failures, known).select("item_id", F.array_join("keys", ",").alias("keys"))


@query(
    """WITH a AS (SELECT n_nationkey AS key, n_name AS value FROM nation WHERE n_nationkey < 20), b AS (SELECT n_nationkey AS key, CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) ELSE n_name END AS value FROM nation WHERE n_nationkey > 3)
  SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'missing' WHEN a.key IS NULL THEN 'unexpected' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.key = b.key WHERE a.value IS DISTINCT FROM b.value"""
)
def metadata_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    other = n.where("key > 3").withColumn("value", F.when(F.col("key") % 4 == 0, F.lower("value")).otherwise(F.col("value")))
    return stats.metadata_diff(n.where("key < 20"), other)


@query("SELECT p_partkey, CASE WHEN p_size > 0 THEN least(p_size + 30, 60) ELSE 0 END AS p_size FROM part")
def saturating_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", raster.saturating_shift(F.col("p_size"), 30, 60).alias("p_size"))


GRIDDED = "g AS (SELECT CAST(32636 AS INTEGER) AS epsg, CAST(l_orderkey % 300 AS INTEGER) AS y, CAST(l_partkey % 200 AS INTEGER) AS x, l_quantity AS red, CAST(l_linenumber AS INTEGER) AS scl FROM lineitem)"


def gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.lit(32636).alias("epsg"), (F.col("l_orderkey") % 300).cast("int").alias("y"), (F.col("l_partkey") % 200).cast("int").alias("x"), F.col("l_quantity").alias("red"), F.col("l_linenumber").cast("int").alias("scl"))


@query(f"WITH {GRIDDED} SELECT epsg, CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, round(avg(red), 6) AS red FROM g GROUP BY ALL")
def block_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.block_average(gridded(spark, sf_dir), ["red"], 2).withColumn("red", F.round("red", 6))


@query(f"WITH {GRIDDED} SELECT epsg, y, x, red FROM g WHERE y % 4 = 0 AND x % 4 = 0")
def nearest_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.subsampled(gridded(spark, sf_dir), 4).select("epsg", "y", "x", "red")


@query(f"WITH {GRIDDED} SELECT epsg, y, x, CAST(CASE WHEN red = 0 OR scl = 0 OR x = 0 THEN 255 WHEN red > 25 THEN 1 ELSE 0 END AS INTEGER) AS ocm FROM g")
def mask_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = gridded(spark, sf_dir).withColumns({"green": F.col("scl").cast("double"), "nir": F.col("x").cast("double")})
    return raster.predict_mask(p, lambda v: (v[:, 0] > 25).astype(int)).select("epsg", "y", "x", "ocm")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type || ',visual' ELSE 'visual' END AS keys FROM events")
def kept_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = F.create_map("event_type", F.lit("a"), F.lit("visual"), F.lit("b"))
    kept = catalog.kept_assets(assets, ["click", "view", "visual"])
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"))


@query(
    f"""WITH {ITEMS} SELECT item_id, CAST(dt AS DATE) AS day, substr(tile, 6) AS tile FROM (SELECT *, coalesce(grid_code, 'MGRS-' || mgrs_tile, item_id) AS tile FROM items)
  WHERE CAST(dt AS DATE) >= DATE '1996-03-01'"""
)
def open_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.search(items(spark, sf_dir), days="1996-03-01/..")
    tile = strings.tile_of(F.col("grid_code"), F.col("mgrs_tile"), F.col("item_id"))
    return found.select("item_id", F.to_date("dt").alias("day"), F.substring(tile, 6, 100).alias("tile"))


@query(
    """SELECT CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, 30.0::DOUBLE + 2.0::DOUBLE * i / 5 AS min_lon, CASE WHEN j = 30 THEN 2.0::DOUBLE ELSE -12.0::DOUBLE + 14.0::DOUBLE * (j + 1) / 31 END AS max_lat
  FROM generate_series(0, 30) a(j), generate_series(0, 4) b(i)"""
)
def footprint_tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.tiles(spark, (30, -12, 32, 2), 50_000).select("j", "i", "min_lon", "max_lat")


@query(f"WITH {GRIDDED} SELECT epsg, CAST(floor(y / 3.0) AS INTEGER) AS y, CAST(floor(x / 3.0) AS INTEGER) AS x, round(avg(red), 6) AS red FROM g GROUP BY ALL")
def resample_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.resampled(gridded(spark, sf_dir), ["red"], 3.0, {"*": "average"}).withColumn("red", F.round("red", 6))


@query(
    f"""WITH {GRIDDED}, one AS (SELECT epsg, y, x, max(scl) AS scl FROM g GROUP BY ALL)
  SELECT epsg, CAST(y // 3 AS INTEGER) AS y, CAST(x // 3 AS INTEGER) AS x, arg_min(scl, abs(y % 3 - 1) * 1000000 + abs(x % 3 - 1) * 1000000 + y * 1000 + x) AS scl FROM one GROUP BY epsg, y // 3, x // 3"""
)
def resample_mask_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = gridded(spark, sf_dir).groupBy("epsg", "y", "x").agg(F.max("scl").alias("scl"))
    return raster.resampled(one, ["scl"], 3.0, {"*": "average"}, mask="scl")


@query(
    f"""WITH {GRIDDED}, one AS (SELECT epsg, y, x, max(red) AS red FROM g GROUP BY ALL),
  wide AS (SELECT DISTINCT epsg, CAST(floor(y / 2.5) AS INTEGER) AS ty, CAST(floor(x / 2.5) AS INTEGER) AS tx FROM one),
  pairs AS (SELECT w.*, red, (1 - abs(y - ((ty + 0.5) * 2.5 - 0.5))) * (1 - abs(x - ((tx + 0.5) * 2.5 - 0.5))) AS weight FROM wide w JOIN one o ON o.epsg = w.epsg AND abs(y - ((ty + 0.5) * 2.5 - 0.5)) < 1 AND abs(x - ((tx + 0.5) * 2.5 - 0.5)) < 1)
  SELECT w.epsg, w.ty AS y, w.tx AS x, round(CAST(sum(weight * red) / sum(CASE WHEN red IS NOT NULL THEN weight END) AS DOUBLE), 6) AS red FROM wide w LEFT JOIN pairs p ON p.epsg = w.epsg AND p.ty = w.ty AND p.tx = w.tx GROUP BY ALL"""
)
def resample_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = gridded(spark, sf_dir).groupBy("epsg", "y", "x").agg(F.max("red").alias("red"))
    return raster.resampled(one, ["red"], 2.5, {"red": "bilinear"}).withColumn("red", F.round("red", 6))


@query(
    f"""WITH {GRIDDED}, c AS (SELECT epsg, y // 2 AS y, x // 2 AS x, avg(red) AS red FROM g GROUP BY ALL)
  SELECT epsg, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, round(CASE WHEN red > 0 THEN least(red + 20, 65535) ELSE 0 END, 6) AS red FROM c"""
)
def mask_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.mask_input(gridded(spark, sf_dir), 2, 20, ("red",)).withColumn("red", F.round("red", 6))


@query(f"WITH {BOXES}, {SHARDS} SELECT CAST(c_custkey AS VARCHAR) AS item_id, shard_y FROM boxes, shards")
def unlocated_items_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nowhere = boxes(spark, sf_dir).withColumns({c: F.lit(None).cast("double") for c in ("minx", "miny", "maxx", "maxy")})
    return spatial.item_shards(nowhere, shards(spark, sf_dir), 3.0).select("item_id", "shard_y")


#: Shards of which every other lies beyond all items.
FAR = "SELECT shard_y, sminx + far AS sminx, smaxx + far AS smaxx, sminy, smaxy FROM (SELECT *, CASE WHEN shard_y % 2 = 0 THEN 1000 ELSE 0 END AS far FROM shards)"


@query(f"WITH {BOXES}, {SHARDS}, spread AS ({FAR}) SELECT shard_y, CAST(c_custkey AS VARCHAR) AS item_id FROM spread LEFT JOIN boxes ON {MEET}")
def empty_shards_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.when(F.col("shard_y") % 2 == 0, 1000).otherwise(0)
    spread = shards(spark, sf_dir).withColumns({"sminx": F.col("sminx") + far, "smaxx": F.col("smaxx") + far})
    return spatial.item_shards(boxes(spark, sf_dir), spread, 3.0, keep_empty=True).select("shard_y", "item_id")


#: A box meets the triangle at a box's lower left if its own lower left corner, moved into the box, does.
IN_TRIANGLE = "(greatest(minx, sminx) - minx) / 2 + (greatest(miny, sminy) - miny) <= 1"


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with the triangle of their lower left half as geometry."""
    point = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(point("minx", "miny"), point("maxx", "miny"), point("minx", "maxy"), point("minx", "miny"))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return boxes(spark, sf_dir).withColumn("geometry", F.to_json(shape))


@query(f"WITH {BOXES}, {SHARDS} SELECT CAST(c_custkey AS VARCHAR) AS item_id, shard_y FROM boxes JOIN shards ON {MEET} AND {IN_TRIANGLE}")
def item_shard_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.item_shards(triangles(spark, sf_dir), shards(spark, sf_dir), 3.0).select("item_id", "shard_y")


#: The diamond |x| / 40 + |y| / 30 <= 1 without its inner half; a box meets it if its nearest point does and its farthest isn't inside the hole.
DIAMOND = "greatest(minx, -maxx, 0) / 40 + greatest(miny, -maxy, 0) / 30 <= 1 AND greatest(abs(minx), abs(maxx)) / 20 + greatest(abs(miny), abs(maxy)) / 15 >= 1"


@query(f"WITH {BOXES} SELECT CAST(c_custkey AS VARCHAR) AS item_id FROM boxes WHERE {DIAMOND}")
def polygon_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = lambda x, y: [(-x, 0.0), (0.0, -y), (x, 0.0), (0.0, y)]
    return geo.meeting(boxes(spark, sf_dir), [[ring(40.0, 30.0), ring(20.0, 15.0)]], "minx", "miny", "maxx", "maxy").select("item_id")


@query(
    f"""WITH {ITEMS}, up AS (SELECT item_id, dn_offset FROM (SELECT item_id, source, pos % 3 AS k, CASE WHEN source = 'earthsearch' THEN 'x' END AS e, CASE WHEN pos % 3 = 0 THEN 0 WHEN pos % 3 = 1 THEN 1000 END AS dn_offset FROM items))
  SELECT item_id, CAST(coalesce(1000 - dn_offset, 0) AS INTEGER) AS shift FROM up"""
)
def encoding_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    offset = F.when(F.col("pos") % 3 == 0, 0).when(F.col("pos") % 3 == 1, 1000)
    return items(spark, sf_dir).select("item_id", catalog.shift(offset).cast("int").alias("shift"))
