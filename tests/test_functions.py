"""Scalar functions, grids and tables against values worked out by hand."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrastack.functions import geo, strings, times
from terrastack.operators import catalog, composite, footprints, raster, spatial, stats


def test_ranges():
    day = dt.date
    assert times.parse_range("2020-01-01/2020-02-01") == (day(2020, 1, 1), day(2020, 2, 1))
    assert times.parse_range("../2020-02-01T10:00:00Z") == (None, day(2020, 2, 1))
    assert times.parse_range("2020-01-01/") == (day(2020, 1, 1), None)
    assert times.parse_range("2020-01-05") == (day(2020, 1, 5), day(2020, 1, 5))
    assert times.request_range(None, None) is None
    assert times.request_range("2020-01-01", None) == ("2020-01-01T00:00:00Z", "2100-01-01T23:59:59Z")


def test_solar_day(spark):
    rows = [("2024-03-01 23:30:00", 20.0), ("2024-03-01 23:30:00", 10.0), ("2024-03-01 00:30:00", -20.0), ("2024-03-01 00:30:00", -10.0)]
    got = spark.createDataFrame(rows, "t string, lon double").select(times.solar_day(F.col("t").cast("timestamp"), F.col("lon"))).collect()
    assert [str(r[0]) for r in got] == ["2024-03-02", "2024-03-01", "2024-02-29", "2024-03-01"]


def test_zones():
    assert geo.zone_extents((11.4, 41, 22.5, 49)) == {33: (11.4, 18.0), 34: (18.0, 22.5)}  # a strip joins its neighbour
    assert geo.zone_extents((11.7, 45, 12.2, 46)) == {32: (11.7, 12.2)}
    assert set(geo.zone_extents((10, 45, 20, 46))) == {32, 33, 34}


def test_zones_of_both_hemispheres(spark):
    assert {r["epsg"] for r in geo.zones(spark, (12.0, -2, 15, 3)).collect()} == {32633, 32733}


def test_zone_join_is_strict(spark):
    items = spark.createDataFrame([("a", 29.5, -6.0, 29.6, -5.9), ("b", 39.0, -6.0, 39.1, -5.9), ("both", 28.0, -6.0, 32.0, -5.0), ("touches", 30.0, -6.0, 30.5, -5.9), ("none", None, None, None, None)], "item_id string, minx double, miny double, maxx double, maxy double")
    got = spatial.by_zone(items, geo.zones(spark, (28, -6.5, 40, -5.5))).groupBy("epsg").agg(F.sort_array(F.collect_list("item_id")).alias("ids")).collect()
    assert {r["epsg"]: r["ids"] for r in got} == {32735: ["a", "both"], 32736: ["both", "touches"], 32737: ["b"]}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.floats(-3, 3), st.floats(-80, 84))
def test_utm_round_trip(zone, off, lat):
    epsg = (32600 if lat >= 0 else 32700) + zone
    lon = geo.zone_band(zone)[0] + 3 + off
    x, y = geo.to_utm(epsg, np.array([lon]), np.array([lat]))
    back = geo.from_utm(epsg, x, y)
    assert abs(back[0][0] - lon) < 1e-8 and abs(back[1][0] - lat) < 1e-8  # a millimetre: the series stops at the third order


def test_utm_known_point():
    x, y = geo.to_utm(32631, np.array([3.0]), np.array([0.0]))
    assert abs(x[0] - 500000) < 1e-6 and abs(y[0]) < 1e-6
    _, y = geo.to_utm(32631, np.array([3.0]), np.array([45.0]))
    assert abs(y[0] - 0.9996 * 4984944.378) < 0.01  # the meridian arc to 45 degrees


def test_geodesic():
    assert abs(geo.geodesic(0, 0, 1, 0) - 111319.491) < 0.01
    assert abs(geo.geodesic(2, 48, 2, 49) - 111200) < 100


def test_tiles_cover_exactly(spark):
    for box in ((2, 48, 3, 49), (30, -12, 32, 2)):
        got = geo.tiles(spark, box, 10_000).collect()
        assert min(r["min_lon"] for r in got) == box[0] and max(r["max_lon"] for r in got) == box[2]
        assert min(r["min_lat"] for r in got) == box[1] and max(r["max_lat"] for r in got) == box[3]
        assert all(geo.geodesic(r["min_lon"], r["min_lat"], r["max_lon"], r["min_lat"]) <= 10_001 for r in got[:50])


def test_polygons():
    triangle = [[(2.0, 48.0), (2.2, 48.0), (2.0, 48.2)]]
    boxes = np.array([[2.01, 48.01, 2.02, 48.02], [2.15, 48.15, 2.2, 48.2], [2.19, 47.9, 2.3, 48.0], [1, 47, 3, 49], [5, 5, 6, 6]], float)
    assert geo.intersects(triangle, boxes).tolist() == [True, False, True, True, False]


def test_holes_are_outside():
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    boxes = np.array([[4, 4, 5, 5], [1, 1, 1.5, 1.5], [2, 2, 4, 4], [11, 11, 12, 12], [20, 20, 21, 21]], float)
    assert geo.intersects([[square(0.0, 10.0), square(3.0, 7.0)], square(10.5, 13.0)], boxes).tolist() == [False, True, True, True, False]
    assert geo.bounds([[square(0.0, 10.0), square(3.0, 7.0)]]) == (0.0, 0.0, 10.0, 10.0)


def test_items_meet_units_by_their_own_geometry(spark):
    """A slanted footprint; one without a geometry; one that spans the world, whose cells are larger."""
    slant = '{"type": "Polygon", "coordinates": [[[0, 0], [10, 10], [10, 9], [1, 0], [0, 0]]]}'
    rows = [("slant", 0.0, 0.0, 10.0, 10.0, slant), ("box", 0.0, 0.0, 10.0, 10.0, None), ("world", -180.0, -90.0, 180.0, 90.0, None), ("nowhere", None, None, None, None, None)]
    items = spark.createDataFrame(rows, "item_id string, minx double, miny double, maxx double, maxy double, geometry string")
    units = spark.createDataFrame([(0, 5.0, 5.0, 5.5, 5.5), (1, 1.0, 8.0, 1.5, 8.5), (2, 100.0, 50.0, 101.0, 51.0)], "shard_y int, sminx double, sminy double, smaxx double, smaxy double")
    got = {(r.item_id, r.shard_y) for r in spatial.item_shards(items, units, 0.5).collect()}
    assert got == {("slant", 0), ("box", 0), ("box", 1), *((i, s) for i in ("world", "nowhere") for s in range(3))}
    assert spatial.item_shards(items, units, 0.5).count() == len(got)


def test_items_without_bounds_meet_all_units_in_many_tasks(spark, monkeypatch):
    items = spark.range(40).select(F.col("id").alias("item_id"), *(F.lit(None).cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy")), F.create_map(F.lit("a"), F.lit("b")).alias("assets"))
    units = spark.range(70).select(F.lit(32636).alias("epsg"), F.col("id").alias("shard_y"), F.lit(0).alias("shard_x"), *(F.lit(float(x)).alias(c) for x, c in enumerate(("sminx", "sminy", "smaxx", "smaxy"))), F.lit("é" * 9).alias("name"))
    want = sorted((i, j) for i in range(40) for j in range(70))
    monkeypatch.setattr(spatial, "TASK_PAIRS", 100)
    few = spatial.item_shards(items, units, 3.0).select("item_id", "shard_y")
    assert few.rdd.getNumPartitions() == 28 and max(few.rdd.glom().map(len).collect()) <= 210
    assert sorted(map(tuple, few.collect())) == want
    monkeypatch.setattr(spatial, "UNITS_BYTES", 70 * (32 + 7 * 16 + 32 + 18) - 1)  # one byte less than they have: by shuffle
    many = spatial.item_shards(items, units, 3.0).select("item_id", "shard_y")
    assert "BroadcastNestedLoop" not in many._jdf.queryExecution().toString() and sorted(map(tuple, many.collect())) == want
    assert spatial.item_shards(items.where("item_id < 0"), units, 3.0).count() == 0


def test_pairs_of_items_without_bounds_are_written_small(spark, tmp_path):
    items = spark.range(200).select(F.col("id").cast("string").alias("item_id"), *(F.lit(None).cast("double").alias(c) for c in ("minx", "miny", "maxx", "maxy")))
    units = spark.range(8000).select(F.col("id").cast("int").alias("shard_y"), *(F.lit(0.0).alias(c) for c in ("sminx", "sminy", "smaxx", "smaxy")))
    spatial.item_shards(items, units, 3.0).select("item_id", "shard_y").write.parquet(path := str(tmp_path / "pairs"))
    assert spark.read.parquet(path).agg(F.count(F.lit(1)), F.countDistinct("item_id", "shard_y")).first() == (1_600_000, 1_600_000)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 400_000  # item by item a shard takes 13 bits


def test_blob_links(spark):
    links = ["https://acc.blob.core.windows.net/box/a/b.tif?sig=1", "https://example.org/box/a", "nothing"]
    df = spark.createDataFrame([(x,) for x in links], "href string")
    account, container = strings.blob_account(F.col("href"))
    assert [tuple(r) for r in df.select(account, container).collect()] == [("acc", "box"), (None, None), (None, None)]


def test_masks_are_joined_by_pixel(spark):
    obs = spark.createDataFrame([("a", 1, 0, 0, 5.0), ("a", 1, 0, 1, 6.0)], "item_id string, epsg int, y int, x int, red double")
    masks = spark.createDataFrame([("a", 1, 0, 0, 2)], "item_id string, epsg int, y int, x int, ocm int")
    assert sorted((r.x, r.ocm) for r in raster.with_mask(obs, masks).collect()) == [(0, 2), (1, None)]
    with pytest.raises(ValueError, match="'b' has no mask"):
        raster.with_mask(obs.withColumn("item_id", F.lit("b")), masks)


def test_request_ranges():
    assert times.request_range(None, None) is None
    assert times.request_range("2020-01-02", None) == ("2020-01-02T00:00:00Z", "2100-01-01T23:59:59Z")
    assert times.request_range(None, "2020-01-02") == ("1900-01-01T00:00:00Z", "2020-01-02T23:59:59Z")


def test_layout():
    assert geo.layout() == (256, 1024, 8192)
    assert geo.layout(4, 2, 1) == (4, 4, 8)
    with pytest.raises(ValueError):
        geo.layout(256, 1)


def test_names(spark):
    assert strings.suggestion("tanzania", ["United Republic of Tanzania", "Kenya"]) == "United Republic of Tanzania"
    assert strings.suggestion("Kenia", ["Kenya", "Chad"]) == "Kenya"
    assert strings.nodata_text(float("nan")) == "nan" and strings.nodata_text(None) is None
    one = spark.range(1)
    key = one.select(strings.tile_key(*(F.lit(x) for x in (2.0, 48.0, 2.2, 48.2)))).first()[0]
    import hashlib

    assert key == hashlib.sha1(b"2.000000_48.000000_2.200000_48.200000").hexdigest()[:12]


def test_gaps(spark):
    day = dt.date
    c1 = ("earthsearch", "sentinel-2-c1-l2a")
    assert catalog.resolve_collection(*c1, day(2022, 2, 1), day(2022, 3, 1)) == "sentinel-2-l2a"
    with pytest.raises(catalog.NeedsAcceptance):
        catalog.resolve_collection(*c1, day(2016, 1, 1), day(2017, 1, 1))
    assert catalog.resolve_collection(*c1, day(2016, 1, 1), day(2017, 1, 1), accept=True) == "sentinel-2-l2a"
    for first, last in ((day(2021, 12, 1), day(2022, 2, 1)), (None, day(2022, 2, 1)), (day(2022, 6, 1), None), (day(2018, 1, 1), day(2020, 1, 1))):
        with pytest.raises(ValueError):
            catalog.resolve_collection(*c1, first, last)
    assert catalog.resolve_collection("planetary-computer", "sentinel-2-l2a", None, None) == "sentinel-2-l2a"
    assert catalog.resolve_collection(*c1, day(2020, 1, 1), day(2021, 1, 1)) == "sentinel-2-c1-l2a"


def test_best_versions(spark):
    rows = [("a", 0, "MGRS-1", None, "02.14"), ("b", 1, "MGRS-1", None, "05.00"), ("c", 2, None, "1", "05.00"), ("d", 3, None, "2", None)]
    df = spark.createDataFrame(rows, "item_id string, pos long, grid_code string, mgrs_tile string, baseline string").withColumn("dt", F.lit("2020-06-06").cast("timestamp"))
    assert sorted(r["item_id"] for r in catalog.best_versions(df).collect()) == ["b", "d"]


def test_renames(spark):
    df = spark.createDataFrame([({"B04": "r", "B8A": "n", "visual": "v"},)], "assets map<string,string>")
    names = catalog.ASSET_NAMES["planetary-computer", "sentinel-2-l2a"]
    assert df.select(catalog.renamed_assets(F.col("assets"), names)).first()[0] == {"red": "r", "nir08": "n", "visual": "v"}
    clash = spark.createDataFrame([({"B04": "r", "red": "x"},)], "assets map<string,string>")
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        clash.select(catalog.renamed_assets(F.col("assets"), names)).collect()


def test_offsets(spark):
    rows = [
        ("c1", "earthsearch", "sentinel-2-c1-l2a", "2020-01-01", None, "05.00"),
        ("old", "earthsearch", "sentinel-2-l2a", "2022-03-01", False, "04.00"),
        ("dark", "earthsearch", "sentinel-2-l2a", "2022-02-01", False, "04.00"),
        ("few", "earthsearch", "sentinel-2-l2a", "2022-01-25", False, "04.00"),
        ("noflag", "earthsearch", "sentinel-2-l2a", "2022-02-01", None, "04.00"),
        ("pc4", "planetary-computer", "sentinel-2-l2a", "2022-02-01", None, "04.00"),
        ("pc2", "planetary-computer", "sentinel-2-l2a", "2020-02-01", None, "02.14"),
        ("x", "custom", "other", "2020-02-01", None, None),
    ]
    items = spark.createDataFrame(rows, "item_id string, source string, collection string, d string, offset_applied boolean, baseline string").withColumn("dt", F.col("d").cast("timestamp"))
    pixels = spark.range(3000).select(F.lit("dark").alias("item_id"), F.lit(300).alias("blue"), F.lit(4).alias("scl")).union(spark.range(10).select(F.lit("few"), F.lit(300), F.lit(4)))
    got = {r["item_id"]: (r["dn_offset"], r["dn_offset_from"]) for r in catalog.with_offsets(items, pixels).collect()}
    assert got == {"c1": (1000, "metadata"), "old": (0, "metadata"), "dark": (0, "pixels"), "few": (1000, "date"), "noflag": (0, "metadata"), "pc4": (1000, "metadata"), "pc2": (0, "metadata"), "x": (None, None)}


def test_nodata_and_median(spark):
    rows = [(0, 0, 0), (1, 0, 10), (1, 0, 30), (0, 0, 0)]
    df = spark.createDataFrame(rows, "x int, y int, vv int").withColumn("epsg", F.lit(1))
    got = {r["x"]: r["vv"] for r in composite.mosaic(df, ["vv"], {"vv": 0}, fuse=False).collect()}
    assert got == {0: None, 1: 20.0}


def test_missing_class_is_usable_and_mask_band_refused(spark):
    df = spark.createDataFrame([(5.0, None), (7.0, 9)], "red double, scl int")
    assert sorted(r["red"] or 0 for r in composite.mask_classes(df, ["red"], "scl", composite.SCENE_MASK).collect()) == [0, 5.0]
    with pytest.raises(ValueError):
        composite.mosaic(df, ["red", "scl"], mask="scl")


def test_orbit_pivot(spark):
    df = spark.createDataFrame([(0, 0, 1, "ascending", 1.0), (0, 0, 1, "descending", 2.0), (0, 0, 1, "ascending", 3.0)], "y int, x int, epsg int, orbit_state string, vh double")
    assert composite.composite_by_orbit(df, ["vh"]).select("vh_ascending", "vh_descending").first() == (2.0, 2.0)
    bad = df.withColumn("orbit_state", F.lit("sideways"))
    with pytest.raises(Exception, match="no orbit state"):
        composite.composite_by_orbit(bad, ["vh"]).collect()


def test_harmonised_min(spark):
    df = spark.createDataFrame([(0, 0, 1, o, 300.0 + o) for o in (1000, 0, 1000)], "y int, x int, epsg int, dn_offset int, red double")
    assert composite.composite(composite.harmonised(df, ["red"]), ["red"], "min").first()["red"] == 1300


def test_pruning_items_does_not_change_the_composite(spark):
    obs = spark.range(2000).select(F.lit(1).alias("epsg"), (F.col("id") % 10).cast("int").alias("y"), (F.col("id") % 7).cast("int").alias("x"), F.rand(0).alias("red"))
    near = obs.where("y < 5")
    whole = composite.composite(obs, ["red"]).where("y < 5")
    assert sorted(map(tuple, composite.composite(near, ["red"]).collect())) == sorted(map(tuple, whole.collect()))


def test_bricks_equal_long_form(spark):
    obs = spark.range(3000).select(F.lit(1).alias("epsg"), (F.col("id") % 40).cast("int").alias("y"), (F.col("id") % 33).cast("int").alias("x"), F.when(F.rand(1) > 0.3, F.rand(0)).alias("red"))
    for method in ("median", "mean", "min", "max", "std", "var"):
        a = {(r.y, r.x): r.red for r in composite.composite(obs, ["red"], method).collect()}
        b = {(r.y, r.x): r.red for r in composite.bricks(obs, ["red"], 16, method).collect()}
        assert a.keys() == b.keys() and all(a[k] == b[k] or abs(a[k] - b[k]) < 1e-9 for k in a), method


def test_dense_bricks_equal_long_form(spark):
    from terrastack.operators import bricks

    obs = spark.range(40 * 33 * 5).select(F.lit(1).alias("epsg"), F.expr("cast(id div 5 div 33 as int)").alias("y"), F.expr("cast(id div 5 % 33 as int)").alias("x"), (F.col("id") % 5).alias("pos"), F.expr("cast(hash(id) & 2047 as int)").alias("red"), F.when(F.expr("hash(id, 1) % 10") < 0, 9).otherwise(4).alias("scl"))
    for method in ("median", "mean", "min", "max"):
        dense = bricks.composite(bricks.from_pixels(obs, ["red"], "scl", 16), ["red"], "scl", composite.SCENE_MASK, method=method)
        got = {(r.y, r.x): r.red for r in bricks.to_pixels(dense, ["red"], 16).where("y < 40 and x < 33").collect()}
        want = composite.mosaic(obs, ["red"], {"red": 0}, "scl", composite.SCENE_MASK, method, fuse=False).collect()
        assert len(got) == 40 * 33
        for r in want:
            assert (got[r.y, r.x] is None) == (r.red is None) and (r.red is None or abs(got[r.y, r.x] - r.red) < 1e-3)


def test_network_sorts():
    from terrastack.operators import bricks

    rng = np.random.default_rng(0)
    for n in range(1, 40):
        v = rng.integers(0, 9, (n, 70)).astype(np.float32)
        assert (bricks.sorted_lanes(v.copy()) == np.sort(v, axis=0)).all()


def test_footprints(spark):
    rows = [("good", 0.0, 0.95, 49.0), ("sun", 5.0, 0.95, 49.0), ("dull", -10.0, 0.5, 49.0), ("tall", -10.0, 0.95, 81.0)]
    shots = spark.createDataFrame(rows, "id string, solar_elevation double, sensitivity double, h double").withColumn("rh", F.array_repeat("h", 101))
    assert [r["id"] for r in footprints.good_heights(shots).collect()] == ["good"]
    rh = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: i.cast("float")).alias("rh"))
    assert footprints.expand_heights(rh, (0, 50, 100)).first().asDict() == {"rh0": 0.0, "rh50": 50.0, "rh100": 100.0}
    assert footprints.fields(["a"], ["rh", "a", "b"], (98,)) == ["a", "b", "rh98"]
    with pytest.raises(KeyError):
        footprints.selected(shots.withColumns({"time": F.lit(0), "lon": F.lit(0.0), "lat": F.lit(0.0)}), ["typo_field"])
    empty = shots.withColumns({"time": F.lit(0), "lon": F.lit(0.0), "lat": F.lit(0.0)}).limit(0)
    assert footprints.selected(empty, ["typo_field"]).columns == ["time", "typo_field", "lon", "lat"]


def test_edge_points_are_owned_once(spark):
    box = (2.0, 48.0, 2.2, 48.2)
    nx, ny = geo.tile_counts(box, 10_000)
    tiles = geo.tiles(spark, box, 10_000)
    edges = sorted({r["min_lon"] for r in tiles.collect()}) + [2.2]
    pts = spark.createDataFrame([(float(x), float(y)) for x in edges for y in (48.0, 48.1, 48.2)], "lon double, lat double")
    assert footprints.tiled(pts, tiles, box, nx, ny).count() == pts.count()


def test_saturation_and_mask_input(spark):
    df = spark.range(64).select(F.lit(1).alias("epsg"), F.expr("cast(id div 8 as int)").alias("y"), F.expr("cast(id % 8 as int)").alias("x"), F.lit(300).alias("red"), F.lit(300).alias("green"))
    df = df.withColumn("nir", F.when((F.col("y") < 2) & (F.col("x") < 2), 0).otherwise(300))
    got = raster.predict_mask(raster.mask_input(df, 2, 1000), lambda v: np.full(len(v), 2)).collect()
    assert len(got) == 16 and sorted(r["ocm"] for r in got) == [2] * 15 + [255]
    assert {r["red"] for r in got} == {1300}


def test_task_split(spark):
    df = spark.range(10).withColumnRenamed("id", "ordinal")
    parts = [spatial.share(df, i, 3).count() for i in range(3)]
    assert parts == [4, 3, 3]
