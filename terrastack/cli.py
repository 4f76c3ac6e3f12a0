"""Commands: ``python -m terrastack.cli``: init, search, download, ocm, coverage, mosaic, vrt, clean, gedi, rechunk, check."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
from collections.abc import Callable
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastack.functions import geo, times
from terrastack.functions.strings import store_name, tile_key
from terrastack.operators import catalog, composite, coverage, footprints, raster, spatial, stats
from terrastack.sources import files, items, registry, store

#: Footprint tiles of one job: what a lost driver has to do again at most.
TILES = 256


def copied(href: str, target: str) -> int:
    """Copy a file or link to a path that the executors reach as a file, whole or not at all."""
    from urllib.request import urlopen

    path = Path(target.removeprefix("file://"))
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    with urlopen(href if "://" in href else Path(href).resolve().as_uri()) as source, part.open("wb") as out:  # noqa: S310
        shutil.copyfileobj(source, out)
    part.replace(path)
    return path.stat().st_size


def session() -> SparkSession:
    return SparkSession.builder.appName("terrastack").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def search(spark: SparkSession, job: registry.Job, items_in: DataFrame, borders: dict | None = None, accept: bool = False) -> bool:
    """Items of a job's source, area, days and properties, renamed, best versions, with offsets; False if already there."""
    target = f"{job.output_dir}/items"
    if files.exists(spark, target + "/_SUCCESS"):
        return False
    source = job.resolved_source()
    name = job.collection or registry.collection(source, job.satellite)
    first, last = times.parse_range(job.days)
    name = catalog.resolve_collection(source, name, first, last, accept)
    box, rings = registry.area(job, borders)
    found = catalog.search(items_in, name, box, job.days, job.max_cloud_cover, job.orbit_state)
    if rings is not None:
        found = geo.meeting(found, rings, "minx", "miny", "maxx", "maxy")
    found = found.withColumn("assets", catalog.renamed_assets(F.col("assets"), registry.asset_names(source, name)))
    if job.satellite == "sentinel-2":
        found = catalog.with_offsets(catalog.best_versions(found))
    return items.write_items(found.select(*items_in.columns), target)


def grids(job: registry.Job, spark: SparkSession, borders: dict | None = None) -> list[geo.Grid]:
    box, _ = registry.area(job, borders)
    rows = geo.zones(spark, box).collect()  # at most 120
    return [geo.zone_grid(r["epsg"], (r["west"], r["south"], r["east"], r["north"]), job.resolution) for r in rows]


def located(units: DataFrame, grid: geo.Grid) -> DataFrame:
    """Units with their bounds in degrees, padded, and the longitude of their centre."""
    import numpy as np
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = [grid.lonlat(grid.window(r.y0 - spatial.PAD, r.y1 + spatial.PAD, r.x0 - spatial.PAD, r.x1 + spatial.PAD)) for r in f.itertuples()]
            at = np.array(rows, float).reshape(-1, 4)
            yield pd.concat([f.reset_index(drop=True), pd.DataFrame(at, columns=["sminx", "sminy", "smaxx", "smaxy"])], axis=1)

    schema = ", ".join(f"{n} {t}" for n, t in units.dtypes) + ", sminx double, sminy double, smaxx double, smaxy double"
    return units.mapInPandas(run, schema).withColumn("lon", (F.col("sminx") + F.col("smaxx")) / 2).withColumn("epsg", F.lit(grid.epsg))


def outside(units: DataFrame, rings: registry.Polygons | None) -> list[tuple[int, int]]:
    """Units that no polygon meets; if none is met at all they are all outside."""
    if rings is None:
        return []
    missed = units.where(~geo.meets(rings, F.col("sminx"), F.col("sminy"), F.col("smaxx"), F.col("smaxy")))
    return [(r[0], r[1]) for r in missed.select("shard_y", "shard_x").collect()]


def plan_stores(spark: SparkSession, job: registry.Job, borders: dict | None = None) -> dict[int, str]:
    """Layouts of all zones' stores, written once."""
    _, rings = registry.area(job, borders)
    chunk, _, shard = geo.layout((job.chunks or {}).get("x"), job.shard_factor, job.compute_chunk_factor)
    out = {}
    for grid in grids(job, spark, borders):
        path = f"{job.output_dir}/{store_name(grid.epsg)}"
        bare = store.planned(grid, chunk, shard, job.output_variables())
        if not store.initialised(spark, path):
            skips = outside(located(store.units(spark, bare), grid), rings)
            bare = store.planned(grid, chunk, shard, job.output_variables(), skips)
            store.prepare(spark, path, bare)
        else:
            store.validate(store.read_layout(spark, path), bare)
        out[grid.epsg] = path
    return out


def masks_folder(job: registry.Job) -> str:
    return f"{job.output_dir}/masks"


def mask_factor(job: registry.Job) -> int:
    return max(1, geo.mask_grid(1, 1, job.resolution)[0])


def masks(spark: SparkSession, job: registry.Job, obs: DataFrame, load: Callable[[str | None], Callable]) -> str:
    """Cloud masks of all items that have none yet, by a model that ``load(model folder)`` makes in each worker.

    Observations ``(item_id, epsg, y, x, red, green, nir)`` are averaged to the mask's grid; if they have ``dn_offset``
    they are brought to the common encoding first.
    """
    if not job.ocm:
        raise ValueError("ocm isn't asked for in the settings")
    folder = job.ocm_model_dir
    keys = ("item_id", "epsg", "dn_offset") if "dn_offset" in obs.columns else ("item_id", "epsg")
    by = catalog.shift(F.col("dn_offset")) if "dn_offset" in obs.columns else 0
    store.write_masks(raster.mask_input(obs, mask_factor(job), by, keys=keys), masks_folder(job), raster.Lazy(lambda: load(folder)))
    return masks_folder(job)


def mosaic(spark: SparkSession, job: registry.Job, obs: DataFrame, task: int = 0, tasks: int = 1, borders: dict | None = None, method: str = "median", on_load: Callable[[DataFrame], DataFrame] | None = None) -> dict[int, str]:
    """Composites of all open units of all zones from observations ``(epsg, y, x, item_id, pos, solar_day, .., bands)``.

    ``on_load`` sees each zone's observations before they are reduced and returns them, observed or changed.
    """
    mask, out = job.mask()
    if job.ocm and "ocm" not in obs.columns:
        obs = raster.with_mask(obs, store.read_masks(spark, masks_folder(job)), factor=mask_factor(job))
    paths = plan_stores(spark, job, borders)
    for epsg, path in paths.items():
        todo = spatial.share(store.open_units(spark, path), task, tasks)
        own = store.with_units(obs.where(F.col("epsg") == epsg), store.read_layout(spark, path)).join(F.broadcast(todo.select(*store.KEYS)), store.KEYS, "left_semi").drop(*store.KEYS)
        own = own if on_load is None else on_load(own)
        made = composite.mosaic(own, job.resolved_bands(), None, mask, out, method, by_orbit=job.orbit_state == "as_bands")
        store.write_units(made.drop("epsg"), path, todo, dense=True)
    return paths


def download(spark: SparkSession, job: registry.Job, found: DataFrame, keys: list[str], copy: Callable[[str, str], int], patch: Callable[[str], str] | None = None) -> DataFrame:
    """Copy the assets that aren't copied yet; returns the items with what they have, without assets that don't exist.

    What was copied is a table next to the cache, appended to when a run ends, so runs resume. An asset that the server
    says isn't there (404) is left out of its item; any other error stops the job after the rest is copied. ``patch`` makes the link that is
    read (a signed one) of the item's at each attempt.
    """
    log, cache = f"{job.output_dir}/downloads", f"{job.output_dir}/cache"
    done = spark.read.parquet(log).where("error is null") if files.exists(spark, log) else None
    gone = lambda e: getattr(e, "code", None) == 404
    signed = copy if patch is None else lambda href, target: copy(patch(href), target)
    items.copy_assets(found, cache, keys, items.retrying(signed, give_up=gone), done).write.mode("append").parquet(log)
    told = spark.read.parquet(log)
    open_ = told.where("error is not null").join(told.where("error is null").select("item_id", "key"), ["item_id", "key"], "left_anti")
    assets = found.select("item_id", F.explode("assets").alias("key", "href"))
    missing = stats.missing_assets(open_.select("item_id", F.col("href").alias("url"), "status"), assets)
    bad = missing.where("keys is null").select("item_id").limit(5).collect()
    if bad:
        raise OSError(f"not copied: {', '.join(r[0] for r in bad)}; see {log}")
    return items.kept_items(found, missing)


def report(spark: SparkSession, job: registry.Job, found: DataFrame, borders: dict | None = None) -> DataFrame:
    """Coverage of every shard of every zone."""
    chunk, _, shard = geo.layout((job.chunks or {}).get("x"), job.shard_factor, job.compute_chunk_factor)
    _, rings = registry.area(job, borders)
    out = None
    for grid in grids(job, spark, borders):
        units = located(store.units(spark, store.planned(grid, chunk, shard, ["b"])).drop("skipped"), grid)
        kept = F.lit(False) if rings is None else ~geo.meets(rings, F.col("sminx"), F.col("sminy"), F.col("smaxx"), F.col("smaxy"))
        side = max(0.1, shard * job.resolution / 100_000)
        part = coverage.coverage(found, units.withColumn("skipped", kept), side, job.orbit_state == "as_bands")
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def gedi(spark: SparkSession, job: registry.FootprintJob, product: str, shots: DataFrame, borders: dict | None = None) -> bool:
    """Footprints of an area, tile by tile, into one table; tiles that are there already are read back."""
    if files.exists(spark, job.output):
        return False
    box, rings = registry.area(job, borders)
    nx, ny = geo.tile_counts(box, job.max_tile_size_m)
    tiles = geo.tiles(spark, box, job.max_tile_size_m)
    if rings is not None:
        tiles = geo.meeting(tiles, rings, "min_lon", "min_lat", "max_lon", "max_lat")
    if tiles.isEmpty():
        raise ValueError("no tile meets the area")
    tiles = tiles.withColumn("key", tile_key(F.col("min_lon"), F.col("min_lat"), F.col("max_lon"), F.col("max_lat")))
    span = times.request_range(*((job.time_range or {}).get(k) for k in ("start", "end")))
    if span is not None:
        shots = shots.where((F.col("time") >= F.lit(span[0]).cast("timestamp")) & (F.col("time") <= F.lit(span[1]).cast("timestamp")))
    names = {k: getattr(job, k) for k in ("fields", "anc_fields", "rh_percentiles", "quality_filter", "time_range", "max_tile_size_m")}
    folder = job.output + ".tiles"
    store.guard(spark, folder, json.dumps(names | {"product": product, "box": box}))
    done = spark.createDataFrame([(t,) for t in store.done_tiles(spark, folder)], "tile string")
    todo = tiles.withColumnRenamed("key", "tile").join(F.broadcast(done), "tile", "left_anti")
    owned = footprints.tiled(shots, tiles.select("j", "i"), box, nx, ny).join(todo.select("j", "i", "tile"), ["j", "i"])
    if product == "l2a":
        percentiles = job.rh_percentiles or footprints.PERCENTILES
        kept = footprints.good_heights(owned) if job.quality_filter else owned
        columns = footprints.fields(job.fields or footprints.HEIGHT_FIELDS, job.anc_fields, percentiles)
        made = footprints.selected(footprints.expand_heights(kept, percentiles), [*columns, "tile"])
    else:
        kept = footprints.good_biomass(owned) if job.quality_filter else owned
        made = footprints.selected(kept, [*footprints.fields(job.fields or footprints.BIOMASS_FIELDS, job.anc_fields), "tile"])
    left = sorted(r["tile"] for r in todo.select("tile").collect())  # tiles of an area, named by their corners
    for at in range(0, len(left), TILES):
        batch = left[at : at + TILES]
        store.write_tiles(made.where(F.col("tile").isin(batch)), folder, batch)
    spark.read.schema(made.schema).parquet(folder).drop("tile").orderBy("time").write.parquet(job.output)
    files.delete(spark, folder)
    return True


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="terrastack", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("init", help="write a template of settings")
    c.add_argument("output"), c.add_argument("--force", action="store_true")
    for name in ("search", "coverage", "mosaic", "vrt", "clean"):
        c = sub.add_parser(name)
        c.add_argument("section", help="s1, s2 or a custom section"), c.add_argument("config"), c.add_argument("--items"), c.add_argument("--observations"), c.add_argument("--borders")
        c.add_argument("--task-id", type=int, default=0), c.add_argument("--n-tasks", type=int, default=1), c.add_argument("--accept-heterogeneous-baselines", action="store_true"), c.add_argument("--output")
    c = sub.add_parser("download", help="copy assets of the items found")
    c.add_argument("section"), c.add_argument("config"), c.add_argument("--items"), c.add_argument("--assets", nargs="*"), c.add_argument("--output")
    c = sub.add_parser("ocm", help="write cloud masks of the items observed")
    c.add_argument("section"), c.add_argument("config"), c.add_argument("--observations", required=True), c.add_argument("--model", required=True, help="module:function that makes a model from its folder")
    c = sub.add_parser("gedi")
    c.add_argument("product", choices=["l2a", "l4a"]), c.add_argument("config"), c.add_argument("--footprints", required=True), c.add_argument("--borders")
    c = sub.add_parser("rechunk")
    c.add_argument("store"), c.add_argument("--chunk", type=int, default=256), c.add_argument("--shard", type=int, default=8192), c.add_argument("--bands", nargs="*"), c.add_argument("--output"), c.add_argument("--task-id", type=int, default=0), c.add_argument("--n-tasks", type=int, default=1)
    c = sub.add_parser("check")
    c.add_argument("store"), c.add_argument("--chunk", type=int), c.add_argument("--shard", type=int), c.add_argument("--bands", nargs="*")
    a = p.parse_args(argv)
    if a.command == "init":
        registry.write_template(a.output, a.force)
        return 0
    spark = session()
    if a.command == "rechunk":
        print(store.rechunk(spark, a.store, a.chunk, a.shard, a.bands or None, a.output, a.task_id, a.n_tasks))
        return 0
    if a.command == "check":
        rows = store.check(spark, a.store, a.chunk, a.shard, a.bands or None).collect()
        print("\n".join(f"{'ok  ' if r.ok else 'FAIL'} {r.name}: {r.detail}" for r in rows))
        return int(not all(r.ok for r in rows))
    borders = json.loads(Path(a.borders).read_text()) if a.borders else None
    if a.command == "gedi":
        gedi(spark, registry.load_footprints(a.config, a.product), a.product, spark.read.parquet(a.footprints), borders)
        return 0
    job = registry.load(a.config, a.section)
    found = lambda: spark.read.parquet(a.items or f"{job.output_dir}/items")
    if a.command == "ocm":
        module, _, name = a.model.partition(":")
        print(masks(spark, job, spark.read.parquet(a.observations), getattr(import_module(module), name)))
    elif a.command == "download":
        download(spark, job, found(), a.assets or job.resolved_bands(), copied).write.parquet(a.output or f"{job.output_dir}/cached_items")
    elif a.command == "search":
        search(spark, job, found(), borders, a.accept_heterogeneous_baselines)
    elif a.command == "coverage":
        report(spark, job, found(), borders).write.mode("overwrite").parquet(a.output or f"{job.output_dir}/coverage")
    elif a.command == "mosaic":
        mosaic(spark, job, spark.read.parquet(a.observations), a.task_id, a.n_tasks, borders)
    elif a.command == "vrt":
        for path in plan_stores(spark, job, borders).values():
            print(store.write_descriptor(spark, path))
    else:
        store.remove_cache(spark, f"{job.output_dir}/cache", f"{job.output_dir}/cached_items", list(plan_stores(spark, job, borders).values()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
