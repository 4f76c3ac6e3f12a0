"""Stores: layout, resume, skipped units, re-layout, checks; settings; sources."""

import json

import pytest
from pyspark.sql import functions as F

from terrastack import cli
from terrastack.functions.geo import Grid
from terrastack.sources import files, items, registry, store


@pytest.fixture
def pixels(spark):
    return spark.range(40 * 36).select(F.expr("cast(id div 36 as int)").alias("y"), F.expr("cast(id % 36 as int)").alias("x"), F.rand(0).cast("float").alias("red"), F.when(F.col("id") > 300, F.rand(1)).cast("float").alias("green"))


GRID = Grid(32736, 500000.0, 9000000.0, 10.0, 40, 36)


def made(spark, path, pixels, skipped=()):
    store.prepare(spark, path, store.planned(GRID, 4, 16, ["red", "green"], skipped))
    store.write_units(pixels, path)
    return path


def test_round_trip_and_resume(spark, tmp_path, pixels):
    path = made(spark, str(tmp_path / "a"), pixels)
    back = store.read(spark, path)
    key = lambda df: sorted(map(tuple, df.select("y", "x", "red", "green").collect()), key=str)
    assert key(back) == key(pixels) and store.complete(spark, path)
    files.delete(spark, path + "/shard_y=1/shard_x=2")
    assert [tuple(r) for r in store.open_units(spark, path).select("shard_y", "shard_x").collect()] == [(1, 2)]
    store.write_units(pixels, path)
    assert key(store.read(spark, path)) == key(pixels)


def test_skipped_units_stay_unwritten(spark, tmp_path, pixels):
    path = made(spark, str(tmp_path / "b"), pixels, [(0, 1), (1, 1)])
    assert store.complete(spark, path)
    assert store.read(spark, path).where("shard_x = 1 and shard_y < 2").isEmpty()


def test_layout_mismatch(spark, tmp_path, pixels):
    path = made(spark, str(tmp_path / "c"), pixels)
    with pytest.raises(ValueError):
        store.prepare(spark, path, store.planned(GRID, 4, 16, ["green", "red"]))
    with pytest.raises(ValueError):
        store.planned(GRID, 5, 16, ["red"])


def test_rechunk_equals_direct(spark, tmp_path, pixels):
    path = made(spark, str(tmp_path / "d"), pixels, [(0, 1), (1, 1), (2, 1)])
    direct = store.read(spark, path).select("y", "x", "red", "green").collect()
    assert store.rechunk(spark, path, 4, 8, ["green", "red"]) == path
    again = store.read(spark, path)
    assert sorted(map(str, again.select("y", "x", "red", "green").collect())) == sorted(map(str, direct))
    layout = store.read_layout(spark, path)
    assert layout.bands == ("green", "red") and set(layout.skipped) == {(y, x) for y in range(5) for x in (2, 3)}
    assert store.rechunk(spark, path, 4, 8, ["green", "red"]) == path
    with pytest.raises(ValueError):
        store.rechunk(spark, path, 4, 16, ["green", "blue"])
    assert not files.exists(spark, path + ".old")


def test_check(spark, tmp_path, pixels):
    path = made(spark, str(tmp_path / "e"), pixels)
    assert all(r.ok for r in store.check(spark, path, 4, 16, ["red", "green"]).collect())
    files.delete(spark, path + "/shard_y=0/shard_x=0")
    bad = {r.name: r.ok for r in store.check(spark, path, 4, 32).collect()}
    assert not bad["completely written"] and not bad["shard size"]
    assert not store.check(spark, str(tmp_path / "none")).first().ok
    assert "<SRS>EPSG:32736</SRS>" in store.descriptor(store.read_layout(spark, path), "e")


def test_remove_cache_needs_complete_stores(spark, tmp_path, pixels):
    path = made(spark, str(tmp_path / "f"), pixels)
    (tmp_path / "cache").mkdir()
    with pytest.raises(ValueError):
        store.remove_cache(spark, str(tmp_path / "cache"), str(tmp_path / "m"), [])
    store.remove_cache(spark, str(tmp_path / "cache"), str(tmp_path / "m"), [path])
    assert not (tmp_path / "cache").exists()


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("aoi: {left: 1, bottom: 2, right: 3, top: 4}\ntime_range: {start: '2020-01-01', end: '2020-02-01'}\noutput_dir: /o\nlater: 1\ns2: {orbit_state: as_bands}\ncustom:\n  mine: {collection: c, bands: [a]}\n")
    job = registry.load(path, "s2")
    assert job.output_dir == "/o/s2" and job.mask()[0] == "scl" and job.resolved_source() == "earthsearch"
    assert job.output_variables()[:2] == ["red_ascending", "red_descending"]
    assert registry.load(path, "mine").resolved_bands() == ["a"] and registry.load(path, "mine").mask() == (None, ())
    with pytest.raises(ValueError):
        registry.load(path, "other")
    path.write_text(path.read_text().replace("orbit_state", "orbit_stat"))
    with pytest.raises(ValueError):
        registry.load(path, "s2")
    registry.write_template(tmp_path / "t.yaml")
    with pytest.raises(FileExistsError):
        registry.write_template(tmp_path / "t.yaml")


def test_signer():
    import datetime as dt

    asked = []
    sign = registry.Signer(lambda a, c: (asked.append((a, c)), ("sig=1", dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=1)))[1])
    for h in ("https://x.blob.core.windows.net/c1/a", "https://x.blob.core.windows.net/c1/b", "https://x.blob.core.windows.net/c2/a"):
        assert sign(h) == h + "?sig=1"
    assert asked == [("x", "c1"), ("x", "c2")] and sign("https://other/a") == "https://other/a"


FEATURE = {"id": "S2A", "collection": "sentinel-2-l2a", "geometry": None, "bbox": [1, 2, 3, 4], "properties": {"datetime": "2020-06-06T10:00:00Z", "eo:cloud_cover": 5, "grid:code": "MGRS-1", "s2:processing_baseline": "05.00"}, "assets": {"red": {"href": "s3://b/k.tif"}}}


def test_items(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [FEATURE, FEATURE | {"id": "S2B"}]}))
    df = items.read_collection(spark, str(path), "earthsearch")
    row = df.orderBy("pos").first()
    assert (row.item_id, row.minx, row.cloud_cover, row.assets) == ("S2A", 1.0, 5.0, {"red": "s3://b/k.tif"})
    assert items.write_items(df, str(tmp_path / "out")) and not items.write_items(df, str(tmp_path / "out"))


def test_catalogue_source(spark):
    feature = dict(FEATURE)

    def fetch(options):
        yield feature | {"id": options["datetime"]}

    spark.dataSource.register(items.catalogue_source(fetch))
    df = spark.read.format("stac").option("datetime", "2020-01-15/2020-03-02").load()
    assert sorted(r.item_id for r in items.flattened(df).collect()) == ["2020-01-15/2020-01-31", "2020-02-01/2020-02-29", "2020-03-01/2020-03-02"]


def test_pages_keep_one_order(spark):
    spark.dataSource.register(items.catalogue_source(lambda options: iter([FEATURE | {"id": options["datetime"][:7] + x} for x in "ab"]), "ordered"))
    df = spark.read.format("ordered").option("datetime", "2020-01-15/2020-03-02").load()
    got = [r.item_id for r in items.flattened(df).orderBy("pos").collect()]
    assert got == [m + x for m in ("2020-01", "2020-02", "2020-03") for x in "ab"]


def test_downloads_resume_and_leave_out_what_does_not_exist(spark, tmp_path):
    df = spark.createDataFrame([("a", {"red": "x/r.tif", "scl": "x/s.tif"}), ("b", {"red": "gone.tif", "scl": "x/t.tif"}), ("c", {"red": "gone.tif"})], "item_id string, assets map<string,string>")
    j, calls = job(tmp_path / "o"), str(tmp_path / "calls")

    class Answer(OSError):
        def __init__(self, code):
            super().__init__(f"HTTP {code}")
            self.code = code

    def copy(href, target):
        with open(calls, "a") as f:
            f.write(href + "\n")
        if href.startswith("gone"):
            raise Answer(404)
        return len(href)

    got = cli.download(spark, j, df, ["red", "scl"], copy)
    assert {r.item_id: r.assets for r in got.collect()} == {"a": {"red": "x/r.tif", "scl": "x/s.tif"}, "b": {"scl": "x/t.tif"}}
    first = open(calls).read().split()
    assert sorted(first) == ["gone.tif", "gone.tif", "x/r.tif", "x/s.tif", "x/t.tif"]  # what doesn't exist isn't tried again
    cli.download(spark, j, df, ["red", "scl"], copy)
    assert open(calls).read().split()[len(first) :] == ["gone.tif", "gone.tif"]

    def refused(href, target):
        raise Answer(403)

    with pytest.raises(OSError, match="not copied"):
        cli.download(spark, job(tmp_path / "p"), df, ["red"], items.retrying(refused, 1))


def test_retries():
    seen = []

    def flaky(href, target):
        seen.append(href)
        if len(seen) < 3:
            raise OSError("again")
        return 7

    assert items.retrying(flaky, wait=0.001)("x", "y") == 7 and len(seen) == 3
    seen.clear()
    with pytest.raises(OSError):
        items.retrying(flaky, wait=0.001, give_up=lambda e: True)("x", "y")
    assert len(seen) == 1


def test_of_two_writers_one_wins_whole(spark, tmp_path):
    path = str(tmp_path / "t.json")
    assert files.write_new(spark, path, "first") and not files.write_new(spark, path, "second")
    assert files.read_text(spark, path) == "first"
    files.write_text(spark, path, "third")
    assert files.read_text(spark, path) == "third" and [n for n in files.listed(spark, str(tmp_path)) if not n.startswith(".")] == ["t.json"]


def test_areas_have_holes_and_degrees(tmp_path):
    ring = lambda a, b: [[a, a], [b, a], [b, b], [a, b], [a, a]]
    shape = {"type": "Polygon", "coordinates": [ring(0, 10), ring(3, 7)]}
    assert [len(p) for p in registry.polygons_of({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": shape}]})] == [2]
    named = lambda n: shape | {"crs": {"type": "name", "properties": {"name": n}}}
    assert registry.polygons_of(named("urn:ogc:def:crs:OGC:1.3:CRS84"))
    with pytest.raises(ValueError, match="32736"):
        registry.polygons_of(named("urn:ogc:def:crs:EPSG::32736"))


def test_countries(tmp_path):
    box = lambda n, x: {"type": "Feature", "properties": {"name": n}, "geometry": {"type": "Polygon", "coordinates": [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 1]]]}}
    borders, fetched = {"type": "FeatureCollection", "features": [box("Northland", 0), box("Southland", 5)]}, []

    def fetch():
        fetched.append(1)
        return json.dumps(borders).encode()

    for _ in range(2):
        known = registry.cached_borders(tmp_path / "c" / "borders.json", fetch)
    assert len(fetched) == 1 and len(registry.country_polygons(["Southland", "Northland"], known)) == 2
    with pytest.raises(ValueError, match="Northland"):
        registry.country_polygons(["north"], known)


def test_copy_assets(spark, tmp_path):
    df = spark.createDataFrame([("a", {"red": "x/r.tif", "scl": "x/s.tif"}), ("b", {"red": "bad.tif"})], "item_id string, assets map<string,string>")

    def copy(href, target):
        if href.startswith("bad"):
            raise OSError("404")
        return len(href)

    got = items.copy_assets(df, str(tmp_path), ["red", "scl", "nir"], copy).collect()
    assert sorted((r.name, r.n_bytes, r.error) for r in got) == [("a/red", 7, None), ("a/scl", 7, None), ("b/red", None, "OSError: 404")]
    gone = spark.createDataFrame([("b", ["red"])], "item_id string, keys array<string>")
    assert [r.item_id for r in items.kept_items(df, gone).collect()] == ["a"]


def job(tmp_path, **more):
    return registry.Job(time_range={"start": "2020-01-01", "end": "2020-02-01"}, output_dir=str(tmp_path), aoi={"left": 33.0, "bottom": -6.0, "right": 33.002, "top": -5.998}, bands=["red"], chunks={"x": 4}, shard_factor=2, compute_chunk_factor=1, cloud_mask_band="scl", cloud_mask_out=[9], **more)


def observations(spark, height, width):
    return spark.range(height * width * 3).select(F.lit(32736).alias("epsg"), F.expr(f"cast(id div 3 div {width} as int)").alias("y"), F.expr(f"cast(id div 3 % {width} as int)").alias("x"), F.col("id").alias("pos"), F.expr("date_add(date'2020-01-01', cast(id % 3 as int))").alias("solar_day"), (F.col("id") % 3 * 10.0).alias("red"), F.lit(4).alias("scl"))


def test_mosaic_job_resumes_and_splits(spark, tmp_path):
    j = job(tmp_path)
    grid = cli.grids(j, spark)[0]
    obs = observations(spark, grid.height, grid.width)
    for task in (0, 1):
        paths = cli.mosaic(spark, j, obs, task, 2)
    path = paths[32736]
    assert store.complete(spark, path)
    assert {r.red for r in store.read(spark, path).collect()} == {10.0} and store.read(spark, path).count() == grid.height * grid.width


def test_polygon_skips_units(spark, tmp_path):
    ring = {"type": "Polygon", "coordinates": [[[33.0, -6.0], [33.0004, -6.0], [33.0, -5.9996], [33.0, -6.0]]]}
    (tmp_path / "a.json").write_text(json.dumps(ring))
    j = job(tmp_path / "o")
    j.aoi, j.geofile_aoi_path = None, str(tmp_path / "a.json")
    path = next(iter(cli.plan_stores(spark, j).values()))
    assert len(store.read_layout(spark, path).skipped) < store.units(spark, store.read_layout(spark, path)).count()


def test_stream(spark, tmp_path, pixels):
    from terrastack.streaming import ingest

    path = str(tmp_path / "s")
    store.prepare(spark, path, store.planned(GRID, 4, 16, ["red", "green"]))
    spark.createDataFrame([("a", 0, 0), ("b", 1, 2)], "item_id string, shard_y int, shard_x int").withColumn("dt", F.lit("2020-01-01").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = ingest.new_items(spark, str(tmp_path / "in"), "item_id string, shard_y int, shard_x int, dt timestamp")
    every = store.units(spark, store.read_layout(spark, path))
    q = ingest.keep_up(stream, path, str(tmp_path / "cp"), lambda f: every.join(f.select("shard_y", "shard_x"), store.KEYS, "left_semi"), lambda u: pixels)
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in store.written(spark, path).collect()) == [(0, 0), (1, 2)]


def test_gedi_job(spark, tmp_path):
    shots = spark.range(400).select(F.timestamp_seconds(1_600_000_000 + F.col("id") * 7 % 1000).alias("time"), (2 + F.col("id") % 20 * 0.01).alias("lon"), (48 + F.col("id") / 20 * 0.01).alias("lat"), F.lit(-10.0).alias("solar_elevation"), F.when(F.col("id") % 10 == 0, 0.5).otherwise(0.95).alias("sensitivity"), F.array_repeat(F.lit(0.4), 101).alias("rh"), F.col("id").cast("float").alias("elevation_lm"), F.lit(1.0).alias("elevation_hr"))
    j = registry.FootprintJob(str(tmp_path / "out.parquet"), aoi={"left": 2.0, "bottom": 48.0, "right": 2.19, "top": 48.2}, max_tile_size_m=5000.0, rh_percentiles=[50])
    assert cli.gedi(spark, j, "l2a", shots) and not cli.gedi(spark, j, "l2a", shots)
    out = spark.read.parquet(j.output)
    assert out.columns == ["time", "elevation_lm", "elevation_hr", "rh50", "lon", "lat"] and out.count() == 360
    notes = lambda: store.done_tiles(spark, str(tmp_path / "tiles"))
    frame = spark.createDataFrame([("x", 1), ("z", 3)], "tile string, v int")
    store.write_tiles(frame.where("tile = 'x'"), str(tmp_path / "tiles"), ["x", "y"])  # y is empty, and done
    assert notes() == ["x", "y"]
    frame.where("tile = 'z'").write.partitionBy("tile").mode("append").parquet(str(tmp_path / "tiles"))  # a job lost before its note
    assert notes() == ["x", "y"]
    store.write_tiles(frame.where("tile = 'z'"), str(tmp_path / "tiles"), ["z"])
    assert notes() == ["x", "y", "z"] and spark.read.parquet(str(tmp_path / "tiles")).count() == 2
    store.guard(spark, str(tmp_path / "t"), '{"a": 1}')
    with pytest.raises(ValueError):
        store.guard(spark, str(tmp_path / "t"), '{"a": 2}')


def bright(folder):
    """A model for the tests: bright pixels are clouds."""
    return lambda rows: (rows[:, 0] > 100).astype(int)


def test_cloud_masks_are_written_once_and_used(spark, tmp_path):
    j = job(tmp_path)
    j.ocm, j.bands = True, ["red", "green", "nir"]
    grid = cli.grids(j, spark)[0]
    obs = observations(spark, grid.height, grid.width).drop("scl")
    value = F.when(F.col("item_id") == "b", 200.0).otherwise(10.0)
    both = obs.withColumn("item_id", F.lit("a")).unionByName(obs.withColumns({"item_id": F.lit("b"), "pos": F.col("pos") + 1})).withColumns({b: value for b in j.bands})
    folder = cli.masks(spark, j, both.where("item_id = 'a'"), bright)
    assert store.masked_items(spark, folder) == ["a"]

    def never(_):
        raise AssertionError("item a has a mask")

    cli.masks(spark, j, both.where("item_id = 'a'"), lambda f: never)
    with pytest.raises(ValueError, match="'b' has no mask"):
        cli.mosaic(spark, j, both)
    cli.masks(spark, j, both, bright)
    assert {(r.item_id, r.ocm) for r in store.read_masks(spark, folder).distinct().collect()} >= {("a", 0), ("b", 1)}
    path = cli.mosaic(spark, j, both)[32736]
    assert {r.red for r in store.read(spark, path).collect()} == {10.0}
    j.ocm = False
    with pytest.raises(ValueError, match="isn't asked for"):
        cli.masks(spark, j, both, bright)


def test_a_lazy_model_travels_without_its_weights():
    import pickle

    from terrastack.operators.raster import Lazy

    made = []
    model = Lazy(lambda: made.append(1) or len)
    assert [model([1, 2]), model([1])] == [2, 1] and len(made) == 1
    assert Lazy(dict.copy).__getstate__()["model"] is None and pickle.loads(pickle.dumps(Lazy(dict))).model is None


def test_commands(spark, tmp_path, capsys):
    config = tmp_path / "job.yaml"
    assert cli.main(["init", str(config)]) == 0
    with pytest.raises(FileExistsError):
        cli.main(["init", str(config)])
    config.write_text(config.read_text().replace("./output", str(tmp_path / "out")).replace("2020-07-01", "2021-12-31"))
    feature = lambda i, x, cloud: json.dumps({"id": i, "collection": "sentinel-2-c1-l2a", "bbox": [x, 46, x + 1, 47], "properties": {"datetime": "2021-05-01T10:00:00Z", "eo:cloud_cover": cloud, "grid:code": i}, "assets": {"red": {"href": "x"}}})
    told = spark.createDataFrame([(0, feature("A", 6, 5)), (1, feature("B", 6, 50)), (2, feature("C", 40, 5))], "pos long, feature string")
    catalogue = str(tmp_path / "catalogue")
    assert items.write_items(items.flattened(told), catalogue)
    assert cli.main(["search", "s2", str(config), "--items", catalogue]) == 0
    found = spark.read.parquet(str(tmp_path / "out" / "s2" / "items"))
    assert [r.item_id for r in found.collect()] == ["A"]
    assert cli.main(["check", str(tmp_path / "nothing")]) == 1
    assert "FAIL layout exists" in capsys.readouterr().out


def test_observations_are_seen_as_they_load(spark, tmp_path):
    from pyspark.sql import Observation

    from terrastack.operators import stats

    j = job(tmp_path)
    grid = cli.grids(j, spark)[0]
    obs, told = observations(spark, grid.height, grid.width), Observation("loaded")
    cli.mosaic(spark, j, obs, on_load=lambda df: stats.observed(df, told, ["red"]))
    assert told.get == {"rows": obs.count(), "valid_red": obs.count()}


def test_links_are_signed_when_they_are_read(spark, tmp_path):
    found = spark.createDataFrame([("a", {"red": "x/red.tif"}), ("b", {"red": None})], "item_id string, assets map<string,string>")
    assert [r.assets for r in items.patched(found, lambda h: h + "?s").orderBy("item_id").collect()] == [{"red": "x/red.tif?s"}, {"red": None}]
    kept = cli.download(spark, job(tmp_path), found.where("item_id = 'a'"), ["red"], lambda href, target: 1 if href.endswith("?s") else 1 / 0, patch=lambda h: h + "?s")
    assert [r.assets for r in kept.collect()] == [{"red": "x/red.tif"}]
