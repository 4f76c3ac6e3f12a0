"""Queries through stores, files and settings, with their SQL for DuckDB.

What they write lies in the folder that the session shares with its executors, under a new name for each call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastack.functions import geo, strings, times
from terrastack.operators import catalog, composite, footprints, raster, spatial, stats
from terrastack.plans.catalogue import BOXES, DIAMOND, GRIDDED, ITEMS, LAT, LON, OBS, SHOTS, boxes, even_tiles, gridded, items, observations, points, query, shots, table
from terrastack.sources import files, registry, store
from terrastack.sources import items as scenes

# ---------------------------------------------------------------- stores

#: 300 by 200 pixels in units of 100, of which the one in the middle of the second column is left out.
GRID, SKIPPED = geo.Grid(32636, 300_000.0, 5_000_000.0, 10.0, 300, 200), ((1, 1),)
PIXELS = "p AS (SELECT y, x, max(red) AS red FROM g GROUP BY y, x)"
PLACES = "places AS (SELECT CAST(j AS INTEGER) AS y, CAST(i AS INTEGER) AS x FROM generate_series(0, 299) a(j), generate_series(0, 199) b(i))"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridded(spark, sf_dir).groupBy("y", "x").agg(F.max("red").alias("red"))


def new_store(spark: SparkSession) -> str:
    path = files.scratch(spark, "store")
    store.prepare(spark, path, store.planned(GRID, 25, 100, ["red"], SKIPPED))
    return path


def half_written(spark: SparkSession, sf_dir: str) -> str:
    path = new_store(spark)
    store.write_units(pixels(spark, sf_dir), path, spatial.share(store.open_units(spark, path), 0, 2), dense=True)
    return path


def whole(spark: SparkSession, sf_dir: str) -> str:
    """A store written by two runs."""
    path = half_written(spark, sf_dir)
    store.write_units(pixels(spark, sf_dir), path, dense=True)
    return path


def _read(spark: SparkSession, path: str) -> DataFrame:
    return store.read(spark, path).withColumn("red", F.col("red").cast("double"))


@query(
    f"""WITH {GRIDDED}, {PIXELS}, {PLACES} SELECT y, x, CAST(red AS DOUBLE) AS red, CAST(y // 100 AS INTEGER) AS shard_y, CAST(x // 100 AS INTEGER) AS shard_x
  FROM places LEFT JOIN p USING (y, x) WHERE NOT (y // 100 = 1 AND x // 100 = 1)"""
)
def store_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, whole(spark, sf_dir))


@query(
    f"""WITH {GRIDDED}, {PIXELS}, {PLACES} SELECT y, x, CAST(red AS DOUBLE) AS red, CAST(y // 50 AS INTEGER) AS shard_y, CAST(x // 50 AS INTEGER) AS shard_x
  FROM places LEFT JOIN p USING (y, x) WHERE NOT (y // 100 = 1 AND x // 100 = 1)"""
)
def store_rechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, store.rechunk(spark, whole(spark, sf_dir), 10, 50))


@query("SELECT CAST(j AS INTEGER) AS shard_y, CAST(i AS INTEGER) AS shard_x, CAST(100 * j AS INTEGER) AS y0, CAST(100 * i AS INTEGER) AS x0 FROM generate_series(0, 2) a(j), generate_series(0, 1) b(i) WHERE (2 * j + i) % 2 = 1 AND NOT (j = 1 AND i = 1)")
def store_open_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.open_units(spark, half_written(spark, sf_dir)).select("shard_y", "shard_x", "y0", "x0")


@query("SELECT CAST(j AS INTEGER) AS shard_y, CAST(i AS INTEGER) AS shard_x, j = 1 AND i = 1 AS skipped, CAST(2 * j + i AS INTEGER) AS ordinal FROM generate_series(0, 2) a(j), generate_series(0, 1) b(i)")
def store_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.units(spark, store.planned(GRID, 25, 100, ["red"], SKIPPED)).select("shard_y", "shard_x", "skipped", "ordinal")


@query("SELECT * FROM (VALUES ('half', false), ('whole', true)) t(written, complete)")
def store_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = [("half", store.complete(spark, half_written(spark, sf_dir))), ("whole", store.complete(spark, whole(spark, sf_dir)))]
    return spark.createDataFrame(told, "written string, complete boolean")


@query(
    """SELECT * FROM (VALUES ('layout exists', true), ('layout is readable', true), ('band order', true), ('chunk size', true), ('shard size', false), ('georeferenced', true),
  ('skipped units lie on the grid', true), ('columns', true), ('completely written', false)) t(name, ok)"""
)
def store_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.check(spark, half_written(spark, sf_dir), chunk=25, shard=50, bands=["red"]).select("name", "ok")


@query(
    f"""WITH {GRIDDED}, a AS (SELECT y, x, max(red) AS red FROM g WHERE scl % 2 = 0 GROUP BY ALL), b AS (SELECT y, x, max(scl) AS scl FROM g WHERE scl % 3 = 0 GROUP BY ALL)
  SELECT y, x, red, scl FROM a FULL JOIN b USING (y, x)"""
)
def band_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, paths = gridded(spark, sf_dir), {}
    for band, part in (("red", g.where("scl % 2 = 0")), ("scl", g.where("scl % 3 = 0"))):
        paths[band] = files.scratch(spark, band)
        part.groupBy("y", "x").agg(F.max(band).alias("value")).write.parquet(paths[band])
    return store.per_band(spark, paths)


@query(
    """SELECT '<VRTDataset rasterXSize="200" rasterYSize="300">|<SRS>EPSG:32636</SRS>|<GeoTransform>300000.0, 10.0, 0.0, 5000000.0, 0.0, -10.0</GeoTransform>|' || string_agg('<VRTRasterBand dataType="Float32" band="' || n || '" blockXSize="25" blockYSize="25">|<Description>' || band ||
  '</Description>|<NoDataValue>nan</NoDataValue>|<SimpleSource><SourceFilename relativeToVRT="1">place</SourceFilename><SourceBand>' || n || '</SourceBand></SimpleSource>|</VRTRasterBand>|', '' ORDER BY n) || '</VRTDataset>|' AS xml
  FROM (VALUES (1, 'red'), (2, 'a&amp;b')) t(n, band)"""
)
def store_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = store.descriptor(store.planned(GRID, 25, 100, ["red", "a&b"]), "place")
    return spark.createDataFrame([("|".join(line.strip() for line in text.split("\n")),)], "xml string")


@query(
    f"""WITH points AS (SELECT c_custkey, {LON.format('c_custkey')} AS lon, {LAT.format('c_custkey')} AS lat FROM customer), own AS (SELECT CAST(least(floor((lat + 40) / 20), 3) AS INTEGER) || '_' || CAST(least(floor((lon + 90) / 20), 8) AS INTEGER) AS tile
  FROM points WHERE lon BETWEEN -90 AND 90 AND lat BETWEEN -40 AND 40 AND c_custkey % 3 = 0 AND lon < 50)
  SELECT j || '_' || i AS tile, count(own.tile) AS n FROM generate_series(0, 3) a(j) CROSS JOIN generate_series(0, 8) b(i) LEFT JOIN own ON own.tile = j || '_' || i GROUP BY ALL"""
)
def footprint_tiles_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tile is noted as done, those without footprints too."""
    tile = F.concat_ws("_", "j", "i")
    owned = footprints.tiled(points(spark, sf_dir), even_tiles(spark), (-90.0, -40.0, 90.0, 40.0), 9, 4).where("c_custkey % 3 = 0 and lon < 50")
    folder = files.scratch(spark, "tiles")
    store.write_tiles(owned.select("c_custkey", tile.alias("tile")), folder, [f"{j}_{i}" for j in range(4) for i in range(9)])
    done = spark.createDataFrame([(t,) for t in store.done_tiles(spark, folder)], "tile string")
    found = spark.read.schema("c_custkey long, tile string").parquet(folder)
    return done.join(found, "tile", "left").groupBy("tile").agg(F.count("c_custkey").alias("n"))


# ---------------------------------------------------------------- masks


@query(
    f"""WITH {GRIDDED}, o AS (SELECT epsg, y, x, red, CAST(scl % 2 AS VARCHAR) AS item_id FROM g), c AS (SELECT item_id, epsg, y // 2 AS y, x // 2 AS x, avg(red) AS red FROM o GROUP BY ALL)
  SELECT o.item_id, o.epsg, o.y, o.x, o.red, CAST(CASE WHEN c.red > 25 THEN 1 ELSE 0 END AS INTEGER) AS ocm FROM o JOIN c ON o.item_id = c.item_id AND o.epsg = c.epsg AND o.y // 2 = c.y AND o.x // 2 = c.x"""
)
def masks_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of coarser pixels, written item by item in two runs, beside the observations."""
    obs = gridded(spark, sf_dir).withColumn("item_id", (F.col("scl") % 2).cast("string")).drop("scl")
    folder = files.scratch(spark, "masks")
    for part in (obs.where("item_id = '1'"), obs):
        store.write_masks(raster.mask_input(part, 2, 0, ("red",), ("item_id", "epsg")), folder, lambda v: (v[:, 0] > 25).astype(int), ("red",))
    return raster.with_mask(obs, store.read_masks(spark, folder), factor=2).select("item_id", "epsg", "y", "x", "red", "ocm")


@query(f"WITH {OBS} SELECT epsg, y, x, median(CASE WHEN scl <> 9 THEN value END) AS value FROM obs GROUP BY ALL")
def job_mask_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings' own mask band and classes come before those of the satellite."""
    job = registry.Job({"start": "2024-01-01", "end": "2024-12-31"}, "out", aoi={"left": 0, "bottom": 0, "right": 1, "top": 1}, cloud_mask_band="scl", cloud_mask_out=[9]).check()
    mask, out = job.mask()
    return composite.mosaic(observations(spark, sf_dir).drop("dn_offset"), ["value"], mask=mask, mask_out=out, fuse=False)


@query(f"WITH {OBS} SELECT epsg, y, x, product(CASE WHEN scl <> 9 THEN CASE pos % 3 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 1.0 ELSE -1.0 END ELSE 1.0 END) AS value FROM obs GROUP BY ALL")
def composite_prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors are powers of two, so that the order of multiplication doesn't matter; nothing multiplied is one."""
    obs = observations(spark, sf_dir).drop("dn_offset").withColumn("value", F.when(F.col("pos") % 3 == 0, 2.0).when(F.col("pos") % 3 == 1, 1.0).otherwise(-1.0))
    return composite.mosaic(obs, ["value"], mask="scl", mask_out=(9,), method="prod", fuse=False)


#: Weight of a pixel by its distance along an axis.
CUBIC = "CASE WHEN {0} <= 1 THEN 1.5 * {0} * {0} * {0} - 2.5 * {0} * {0} + 1 WHEN {0} < 2 THEN -0.5 * {0} * {0} * {0} + 2.5 * {0} * {0} - 4 * {0} + 2 ELSE 0 END"


@query(
    f"""WITH {GRIDDED}, one AS (SELECT epsg, y % 30 AS y, x % 20 AS x, CAST(max(red) AS DOUBLE) AS red FROM g GROUP BY ALL), wide AS (SELECT DISTINCT epsg, CAST(floor(y / 2.5) AS INTEGER) AS ty, CAST(floor(x / 2.5) AS INTEGER) AS tx FROM one),
  far AS (SELECT w.*, red, CAST(abs(y - ((ty + 0.5) * 2.5 - 0.5)) AS DOUBLE) AS dy, CAST(abs(x - ((tx + 0.5) * 2.5 - 0.5)) AS DOUBLE) AS dx FROM wide w JOIN one o ON o.epsg = w.epsg AND abs(y - ((ty + 0.5) * 2.5 - 0.5)) < 2 AND abs(x - ((tx + 0.5) * 2.5 - 0.5)) < 2),
  pairs AS (SELECT epsg, ty, tx, red, ({CUBIC.format("dy")}) * ({CUBIC.format("dx")}) AS weight FROM far)
  SELECT epsg, ty AS y, tx AS x, round(sum(weight * red) / sum(weight), 6) AS red FROM pairs GROUP BY ALL"""
)
def resample_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a grid so small that hardly a pixel is missing: where most are, the weights of the rest may cancel."""
    small = gridded(spark, sf_dir).groupBy("epsg", (F.col("y") % 30).alias("y"), (F.col("x") % 20).alias("x")).agg(F.max("red").cast("double").alias("red"))
    return raster.resampled(small, ["red"], 2.5, {"*": "cubic"}).withColumn("red", F.round("red", 6))


@query(f"WITH {OBS}, units AS (SELECT epsg, y // 10 AS j, x // 10 AS i, count(DISTINCT solar_day) AS steps FROM obs GROUP BY ALL), top AS (SELECT max(steps) AS steps FROM units) SELECT top.steps, top.steps * 10 * 10 * 3 * 4 * 8 AS n_bytes, count(*) AS units FROM units JOIN top USING (steps) GROUP BY ALL")
def load_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.load_footprint(observations(spark, sf_dir), 10, 3, workers=8)


# ---------------------------------------------------------------- items and areas


@query(f"WITH {ITEMS} SELECT item_id, pos, 'earthsearch' AS source, collection, dt, minx, miny, maxx, maxy, cloud_cover, orbit_state, grid_code, mgrs_tile, baseline, offset_applied, 's3://b/' || item_id AS href FROM items")
def items_handed_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes as features of a catalogue, flattened, written and read by the next step."""
    i = items(spark, sf_dir)
    properties = F.struct(
        F.date_format("dt", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime"), F.col("cloud_cover").alias("eo:cloud_cover"), F.col("orbit_state").alias("sat:orbit_state"), F.col("grid_code").alias("grid:code"),
        F.col("mgrs_tile").alias("s2:mgrs_tile"), F.col("baseline").alias("s2:processing_baseline"), F.col("offset_applied").alias("earthsearch:boa_offset_applied"),
    )
    assets = F.struct(F.struct(F.concat(F.lit("s3://b/"), "item_id").alias("href")).alias("red"))
    feature = F.struct(F.col("item_id").alias("id"), "collection", F.array("minx", "miny", "maxx", "maxy").alias("bbox"), properties.alias("properties"), assets.alias("assets"))
    path = files.scratch(spark, "items")
    scenes.write_items(scenes.flattened(i.select("pos", F.to_json(feature).alias("feature")), "earthsearch"), path)
    names = ["item_id", "pos", "source", "collection", "minx", "miny", "maxx", "maxy", "cloud_cover", "orbit_state", "grid_code", "mgrs_tile", "baseline", "offset_applied"]
    return spark.read.parquet(path).select(*names, F.col("dt").cast("timestamp_ntz").alias("dt"), F.col("assets")["red"].alias("href"))


@query("SELECT least(count(*), 100) AS n FROM orders WHERE o_orderkey % 4 <> 0")
def search_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items a limit keeps isn't fixed, only how many."""
    return catalog.search(items(spark, sf_dir), "sentinel-2-l2a", most=100).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'a' WHEN c_custkey % 4 = 1 THEN 'a,b' WHEN c_custkey % 4 = 2 THEN 'b' END AS keys FROM customer WHERE c_custkey % 4 < 3")
def kept_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items without the assets that don't exist; an item left without any goes."""
    key = F.col("c_custkey")
    have = table(spark, sf_dir, "customer").select("c_custkey", key.alias("item_id"), F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y")).alias("assets"))
    lacking = F.when(key % 4 == 0, F.array(F.lit("b"))).when(key % 4 == 2, F.array(F.lit("a"))).when(key % 4 == 3, F.array(F.lit("a"), F.lit("b")))
    out = scenes.kept_items(have, have.select("item_id", lacking.alias("keys")))
    return out.select("c_custkey", F.array_join(F.array_sort(F.map_keys("assets")), ",").alias("keys"))


@query(f"WITH {ITEMS} SELECT item_id, 'https://x/' || item_id || '?sig=' || length(item_id) AS href FROM items")
def patched_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets = F.create_map(F.lit("red"), F.concat(F.lit("https://x/"), "item_id"))
    out = scenes.patched(items(spark, sf_dir).withColumn("assets", assets), lambda href: f"{href}?sig={len(href) - 10}")
    return out.select("item_id", F.col("assets")["red"].alias("href"))


BORDERS = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "properties": {"name": "Ring"}, "geometry": {"type": "Polygon", "coordinates": [[[-100, -50], [-20, -50], [-20, 30], [-100, 30]], [[-80, -30], [-40, -30], [-40, 10], [-80, 10]]]}},
        {"type": "Feature", "properties": {"name": "Isles"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[20, 0], [40, 0], [40, 20], [20, 20]]], [[[60, 40], [90, 40], [90, 60], [60, 60]]]]}},
        {"type": "Feature", "properties": {"name": "Elsewhere"}, "geometry": {"type": "Polygon", "coordinates": [[[100, -60], [170, -60], [170, 60], [100, 60]]]}},
    ],
}
RING = "minx <= -20 AND maxx >= -100 AND miny <= 30 AND maxy >= -50 AND NOT (minx > -80 AND maxx < -40 AND miny > -30 AND maxy < 10)"
ISLES = "(minx <= 40 AND maxx >= 20 AND miny <= 20 AND maxy >= 0) OR (minx <= 90 AND maxx >= 60 AND miny <= 60 AND maxy >= 40)"


@query(f"WITH {BOXES} SELECT CAST(c_custkey AS VARCHAR) AS item_id FROM boxes WHERE ({RING}) OR {ISLES}")
def country_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two countries; one has a hole, the other two parts."""
    return geo.meeting(boxes(spark, sf_dir), registry.country_polygons(["Ring", "Isles"], BORDERS), "minx", "miny", "maxx", "maxy").select("item_id")


@query(f"WITH {BOXES} SELECT CAST(c_custkey AS VARCHAR) AS item_id FROM boxes WHERE minx <= 90 AND maxx >= -100 AND miny <= 60 AND maxy >= -50")
def area_bounds_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that meet the bounds of all polygons of an area."""
    return catalog.search(boxes(spark, sf_dir), box=geo.bounds(registry.country_polygons(["Ring", "Isles"], BORDERS))).select("item_id")


@query(
    f"""WITH tiles AS (SELECT j, i, -90.0::DOUBLE + 5 * i AS minx, -85.0::DOUBLE + 5 * i AS maxx, -40.0::DOUBLE + 5 * j AS miny, -35.0::DOUBLE + 5 * j AS maxy FROM generate_series(0, 15) a(j), generate_series(0, 35) b(i))
  SELECT CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i FROM tiles WHERE {DIAMOND}"""
)
def tiles_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that meet an area with a hole."""
    ring = lambda x, y: [(-x, 0.0), (0.0, -y), (x, 0.0), (0.0, y)]
    grid = geo.shard_grid(spark, 16, 36, 1).select(F.col("shard_y").alias("j"), F.col("shard_x").alias("i"), (F.col("shard_x") * 5 - 90.0).alias("w"), (F.col("shard_x") * 5 - 85.0).alias("e"), (F.col("shard_y") * 5 - 40.0).alias("s"), (F.col("shard_y") * 5 - 35.0).alias("n"))
    return geo.meeting(grid, [[ring(40.0, 30.0), ring(20.0, 15.0)]], "w", "s", "e", "n").select("j", "i")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'acct' || c_custkey % 7 END AS account, CASE WHEN c_custkey % 3 = 0 THEN 'box' || c_custkey % 5 END AS container FROM customer"""
)
def blob_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    host = F.when(key % 3 == 0, F.concat(F.lit("acct"), text(key % 7), F.lit(".blob.core.windows.net"))).otherwise(F.lit("example.org"))
    account, container = strings.blob_account(F.concat(F.lit("https://"), host, F.lit("/box"), text(key % 5), F.lit("/a/b.tif?x=1")))
    return table(spark, sf_dir, "customer").select("c_custkey", account.alias("account"), container.alias("container"))


# ---------------------------------------------------------------- footprints


@query(f"WITH {SHOTS} SELECT TIMESTAMP '1970-01-01' + to_seconds(vec_id * 1000 % 7919) AS time, sensitivity, vec_id, rh[51] AS rh50, rh[99] AS rh98, lon, lat FROM shots WHERE solar_elevation <= 0 AND sensitivity >= 0.9 AND rh[99] BETWEEN 0 AND 80")
def footprint_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in order, each once, without the raw array."""
    out = footprints.heights(shots(spark, sf_dir), ["sensitivity", "vec_id"], ["vec_id", "rh"], (50, 98))
    return out.withColumn("time", F.col("time").cast("timestamp_ntz"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '2100-01-01 23:59:59'")
def request_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = times.request_range("1996-03-01", None)
    assert span is not None
    first, last = (F.to_timestamp_ntz(F.lit(t[:-1]), F.lit("yyyy-MM-dd'T'HH:mm:ss")) for t in span)
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate").between(first, last)).select("o_orderkey")
