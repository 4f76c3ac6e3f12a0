"""Composite stores: partitioned Parquet with a layout, written unit by unit, resumable, checked, re-laid out."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from urllib.parse import unquote
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastack.functions.geo import Grid, shard_grid
from terrastack.functions.strings import nodata_text
from terrastack.operators.raster import predict_mask
from terrastack.operators.spatial import carried_skips, pending
from terrastack.sources import files

LAYOUT = "_layout.json"
KEYS = ["shard_y", "shard_x"]


@dataclass(frozen=True)
class Layout:
    """Grid, sides of chunks and shards in pixels, bands in order, and units left out for good."""

    epsg: int
    left: float
    top: float
    resolution: float
    height: int
    width: int
    chunk: int
    shard: int
    bands: tuple[str, ...]
    skipped: tuple[tuple[int, int], ...] = ()

    @property
    def grid(self) -> Grid:
        return Grid(self.epsg, self.left, self.top, self.resolution, self.height, self.width)

    def json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def of(text: str) -> Layout:
        raw = json.loads(text)
        return Layout(**{**raw, "bands": tuple(raw["bands"]), "skipped": tuple(tuple(x) for x in raw["skipped"])})


def planned(grid: Grid, chunk: int, shard: int, bands: Iterable[str], skipped: Iterable[tuple[int, int]] = ()) -> Layout:
    if shard % chunk:
        raise ValueError(f"chunks of {chunk} don't divide shards of {shard}")
    return Layout(grid.epsg, grid.left, grid.top, grid.resolution, grid.height, grid.width, chunk, shard, tuple(bands), tuple(sorted(skipped)))


def initialised(spark: SparkSession, path: str) -> bool:
    return files.exists(spark, f"{path}/{LAYOUT}")


def read_layout(spark: SparkSession, path: str) -> Layout:
    return Layout.of(files.read_text(spark, f"{path}/{LAYOUT}"))


def prepare(spark: SparkSession, path: str, layout: Layout) -> Layout:
    """Write the layout once; an existing one stays and must fit. Of two writers one wins, whole."""
    if not initialised(spark, path):
        files.write_new(spark, f"{path}/{LAYOUT}", layout.json())
    have = read_layout(spark, path)
    validate(have, layout)
    return have


def validate(have: Layout, want: Layout) -> None:
    """Sizes and bands must be equal, and the grids' corners within a thousandth of a pixel."""
    for name in ("epsg", "chunk", "shard", "bands", "height", "width"):
        if getattr(have, name) != getattr(want, name):
            raise ValueError(f"{name}: the store has {getattr(have, name)}, not {getattr(want, name)}")
    near = 1e-3 * want.resolution
    for a, b in ((have.left, want.left), (have.top, want.top), (have.left + have.width * have.resolution, want.left + want.width * want.resolution), (have.top - have.height * have.resolution, want.top - want.height * want.resolution)):
        if abs(a - b) > near:
            raise ValueError(f"the store's grid isn't at {b}")


def units(spark: SparkSession, layout: Layout) -> DataFrame:
    """All units with ``skipped`` and ``ordinal``, row by row."""
    grid = shard_grid(spark, layout.height, layout.width, layout.shard)
    skips = spark.createDataFrame([(int(y), int(x), True) for y, x in layout.skipped], "shard_y int, shard_x int, skipped boolean")
    across = -(-layout.width // layout.shard)
    return grid.join(F.broadcast(skips), KEYS, "left").withColumn("skipped", F.coalesce("skipped", F.lit(False))).withColumn("ordinal", F.col("shard_y") * across + F.col("shard_x"))


def written(spark: SparkSession, path: str) -> DataFrame:
    """Units whose partition is there: from folder names, no data is read."""
    rows = [(int(y[8:]), int(x[8:])) for y in files.listed(spark, path) if y.startswith("shard_y=") for x in files.listed(spark, f"{path}/{y}") if x.startswith("shard_x=")]
    return spark.createDataFrame(rows, "shard_y int, shard_x int")


def open_units(spark: SparkSession, path: str) -> DataFrame:
    """Units to write: neither skipped nor written."""
    return pending(units(spark, read_layout(spark, path)).where("not skipped"), written(spark, path), KEYS)


def complete(spark: SparkSession, path: str) -> bool:
    return initialised(spark, path) and open_units(spark, path).isEmpty()


def with_units(pixels: DataFrame, layout: Layout) -> DataFrame:
    return pixels.withColumns({"shard_y": F.expr(f"y div {layout.shard}").cast("int"), "shard_x": F.expr(f"x div {layout.shard}").cast("int")})


def full(pixels: DataFrame, todo: DataFrame) -> DataFrame:
    """Every pixel of the units to write, null where the composite has no row."""
    grid = todo.select(*KEYS, F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1").select(*KEYS, "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
    return grid.join(pixels.drop(*KEYS), ["y", "x"], "left")


def write_units(pixels: DataFrame, path: str, todo: DataFrame | None = None, dense: bool = False) -> None:
    """Write composites ``(y, x, band ..)`` into their units, replacing those units whole; other units stay.

    One shuffle brings a unit's rows together, so it is one file, sorted by pixel for tight statistics.
    """
    spark = pixels.sparkSession
    layout = read_layout(spark, path)
    todo = open_units(spark, path) if todo is None else todo
    rows = with_units(pixels, layout)
    rows = full(rows, todo) if dense else rows.join(F.broadcast(todo.select(*KEYS)), KEYS, "left_semi")
    out = rows.select(*KEYS, "y", "x", *(F.col(b).cast("float").alias(b) for b in layout.bands))
    (out.repartition(*KEYS).sortWithinPartitions(*KEYS, "y", "x").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    layout = read_layout(spark, path)
    schema = "y int, x int, " + ", ".join(f"`{b}` float" for b in layout.bands) + ", shard_y int, shard_x int"
    return spark.read.schema(schema).parquet(path)


def per_band(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Stores of one value column each (``y, x, value``) as one table of bands."""
    out = None
    for band, p in paths.items():
        part = spark.read.parquet(p).select("y", "x", F.col("value").alias(band))
        out = part if out is None else out.join(part, ["y", "x"], "full_outer")
    assert out is not None
    return out


def rechunk(spark: SparkSession, path: str, chunk: int, shard: int, bands: Iterable[str] | None = None, output: str | None = None, task: int = 0, tasks: int = 1) -> str:
    """A complete store in another layout or band order; in place unless ``output`` is given. Returns where it is.

    Skipped units are carried: a new unit is skipped if all old ones it overlaps are. Resumable, and shared by
    ``tasks`` jobs; the last to finish swaps. Nothing happens if the layout is the same already.
    """
    old = read_layout(spark, path)
    names = tuple(bands or old.bands)
    if set(names) != set(old.bands):
        raise ValueError(f"bands {names} aren't {old.bands}")
    if (chunk, shard, names) == (old.chunk, old.shard, old.bands):
        return path
    if not complete(spark, path):
        raise ValueError(f"{path} isn't complete")
    target = output or path + ".rechunk"
    bare = planned(old.grid, chunk, shard, names)
    told = carried_skips(units(spark, bare).drop("skipped"), units(spark, old), old.shard)
    skipped = [(r[0], r[1]) for r in told.where("skipped").select(*KEYS).collect()]
    prepare(spark, target, planned(old.grid, chunk, shard, names, skipped))
    todo = open_units(spark, target).where(F.pmod("ordinal", F.lit(tasks)) == task)
    write_units(read(spark, path).select("y", "x", *names), target, todo)
    if output is None and complete(spark, target):
        swap(spark, path, target)
        return path
    return target


def swap(spark: SparkSession, path: str, new: str) -> None:
    """Replace ``path`` by ``new`` in two renames; an interrupted swap is finished by the next one."""
    old = path + ".old"
    if files.exists(spark, path) and files.exists(spark, new):
        files.rename(spark, path, old)
    if files.exists(spark, new) and not files.exists(spark, path):
        files.rename(spark, new, path)
    files.delete(spark, old)


def check(spark: SparkSession, path: str, chunk: int | None = None, shard: int | None = None, bands: Iterable[str] | None = None) -> DataFrame:
    """``(name, ok, detail)`` in order; later checks that depend on a failed one are left out."""
    rows: list[tuple[str, bool, str]] = []

    def say(name: str, ok: bool, detail: str = "") -> bool:
        rows.append((name, bool(ok), detail))
        return bool(ok)

    def run() -> None:
        if not say("layout exists", initialised(spark, path), path):
            return
        try:
            have = read_layout(spark, path)
        except (ValueError, KeyError, TypeError) as e:
            say("layout is readable", False, str(e))
            return
        say("layout is readable", True)
        if bands is not None:
            say("band order", tuple(bands) == have.bands, str(have.bands))
        say("chunk size", have.chunk == (chunk or have.chunk) and have.shard % have.chunk == 0, str(have.chunk))
        say("shard size", have.shard == (shard or have.shard), str(have.shard))
        say("georeferenced", have.epsg > 0 and have.resolution > 0, str(have.epsg))
        ny, nx = -(-have.height // have.shard), -(-have.width // have.shard)
        if not say("skipped units lie on the grid", all(0 <= y < ny and 0 <= x < nx for y, x in have.skipped)):
            return
        done = written(spark, path)
        if not done.isEmpty():
            columns = set(spark.read.parquet(path).columns)
            if not say("columns", columns == {"y", "x", *have.bands, *KEYS}, str(sorted(columns))):
                return
        left = open_units(spark, path).count()
        say("completely written", left == 0, f"{left} units left")

    run()
    return spark.createDataFrame(rows, "name string, ok boolean, detail string")


_GDAL_TYPES = {"tinyint": "Int8", "smallint": "Int16", "int": "Int32", "bigint": "Int64", "float": "Float32", "double": "Float64"}


def descriptor(layout: Layout, path: str, nodata: float | None = float("nan"), dtype: str = "float", wkt: str | None = None) -> str:
    """An XML descriptor of a store: size, reference system, transform, and each band's name, nodata, source and block."""
    if layout.epsg <= 0:
        raise ValueError("the store has no reference system")
    if dtype not in _GDAL_TYPES:
        raise ValueError(f"no raster type for {dtype}")
    lines = [f'<VRTDataset rasterXSize="{layout.width}" rasterYSize="{layout.height}">', f"  <SRS>{escape(wkt or f'EPSG:{layout.epsg}')}</SRS>", f"  <GeoTransform>{layout.left}, {layout.resolution}, 0.0, {layout.top}, 0.0, {-layout.resolution}</GeoTransform>"]
    text = nodata_text(nodata)
    for i, band in enumerate(layout.bands, 1):
        lines.append(f'  <VRTRasterBand dataType="{_GDAL_TYPES[dtype]}" band="{i}" blockXSize="{layout.chunk}" blockYSize="{layout.chunk}">')
        lines.append(f"    <Description>{escape(band)}</Description>")
        if text is not None:
            lines.append(f"    <NoDataValue>{text}</NoDataValue>")
        lines.append(f'    <SimpleSource><SourceFilename relativeToVRT="1">{escape(path)}</SourceFilename><SourceBand>{i}</SourceBand></SimpleSource>')
        lines.append("  </VRTRasterBand>")
    return "\n".join([*lines, "</VRTDataset>", ""])


def write_descriptor(spark: SparkSession, path: str) -> str:
    target = path.rstrip("/") + ".vrt"
    files.write_text(spark, target, descriptor(read_layout(spark, path), path.rstrip("/").rsplit("/", 1)[-1]))
    return target


def remove_cache(spark: SparkSession, cache: str, manifest: str, stores: list[str]) -> None:
    """Delete copied assets once all stores are complete; the manifest goes first."""
    left = [s for s in stores if not complete(spark, s)]
    if not stores or left:
        raise ValueError(f"stores aren't complete: {left or 'there are none'}")
    files.delete(spark, manifest)
    files.delete(spark, cache)


def guard(spark: SparkSession, folder: str, params: str) -> None:
    """Refuse a folder of tiles that was made with other parameters."""
    path, canonical = f"{folder}/params.json", json.dumps(json.loads(params), sort_keys=True)
    if not files.exists(spark, path):
        files.write_new(spark, path, canonical)
    if json.loads(files.read_text(spark, path)) != json.loads(canonical):
        raise ValueError(f"{folder} was made with other parameters")


def write_tiles(frame: DataFrame, folder: str, tiles: Iterable[str]) -> None:
    """Footprints with their ``tile``, one folder each, and a note that ``tiles`` are done, empty ones included.

    The note is written after the tiles are committed: what a lost job has left is overwritten by the next one, and
    what it has noted isn't done again.
    """
    frame.repartition("tile").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile").parquet(folder)
    names = sorted(tiles)
    digest = hashlib.sha256("\n".join(names).encode()).hexdigest()[:16]
    files.write_text(frame.sparkSession, f"{folder}/_done/{digest}", "\n".join(names))


def done_tiles(spark: SparkSession, folder: str) -> list[str]:
    notes = [files.read_text(spark, f"{folder}/_done/{f}") for f in files.listed(spark, f"{folder}/_done") if "." not in f]
    return sorted({t for n in notes for t in n.split("\n") if t})


#: Rows of mask pixels that one task writes of an item.
MASK_ROWS = 1024


def write_masks(pixels: DataFrame, folder: str, predict: Callable, bands: tuple[str, ...] = ("red", "green", "nir"), band: str = "ocm") -> None:
    """Mask classes of ``(item_id, epsg, y, x, bands ..)``, one folder for each item; items that are there are left out.

    A run commits all of its items at once. Items are dealt by stretches of rows, so a large one is written by several
    tasks. An item without pixels has no mask.
    """
    done = pixels.sparkSession.createDataFrame([(i,) for i in masked_items(pixels.sparkSession, folder)], "item_id string")
    todo = pixels.join(done, "item_id", "left_anti")
    made = predict_mask(todo, predict, bands, band).select("item_id", "epsg", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), band)
    dealt = made.repartition("item_id", "epsg", F.expr(f"y div {MASK_ROWS}")).sortWithinPartitions("item_id", "epsg", "y", "x")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("item_id").parquet(folder)


def masked_items(spark: SparkSession, folder: str) -> list[str]:
    """Items whose masks are there, from folder names."""
    return [unquote(f[len("item_id=") :]) for f in files.listed(spark, folder) if f.startswith("item_id=")]


def read_masks(spark: SparkSession, folder: str, band: str = "ocm") -> DataFrame:
    return spark.read.schema(f"epsg int, y int, x int, `{band}` int, item_id string").parquet(folder)
