"""Catalogue rows: predicates, renames, the best version of a scene, pixel encodings, gaps of collections."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrastack.functions.strings import tile_of
from terrastack.functions.times import within

ORBIT_STATES = ("ascending", "descending")

# Collections and the names of assets as sources publish them.
COLLECTIONS = {
    "sentinel-2": {"earthsearch": "sentinel-2-c1-l2a", "planetary-computer": "sentinel-2-l2a"},
    "sentinel-1": {"earthsearch": "sentinel-1-grd", "planetary-computer": "sentinel-1-rtc"},
}
ASSET_NAMES = {
    ("planetary-computer", "sentinel-2-l2a"): {
        "B01": "coastal", "B02": "blue", "B03": "green", "B04": "red", "B05": "rededge1", "B06": "rededge2", "B07": "rededge3", "B08": "nir",
        "B8A": "nir08", "B09": "nir09", "B11": "swir16", "B12": "swir22", "SCL": "scl", "AOT": "aot", "WVP": "wvp",
    }
}
REFLECTANCE = ("coastal", "blue", "green", "red", "rededge1", "rededge2", "rededge3", "nir", "nir08", "nir09", "swir16", "swir22")
OFFSET = 1000
#: Days within which only pixels tell whether an item carries the offset.
UNCLEAR_FROM, UNCLEAR_TO = dt.date(2022, 1, 25), dt.date(2022, 2, 27)
DARK_CLASSES, LEAST_DARK, WITH_OFFSET_MOST, WITHOUT_OFFSET_LEAST = (4, 6), 2000, 0.02, 0.5


@dataclass(frozen=True)
class Gap:
    source: str
    collection: str
    first: dt.date
    last: dt.date
    fallback: str | None
    confirm: bool


# Days a collection is known to lack, and what stands in.
GAPS = (
    Gap("earthsearch", "sentinel-2-c1-l2a", dt.date(2015, 6, 23), dt.date(2019, 3, 21), "sentinel-2-l2a", True),
    Gap("earthsearch", "sentinel-2-c1-l2a", dt.date(2022, 1, 1), dt.date(2022, 12, 5), "sentinel-2-l2a", False),
)


#: Collections with known gaps up to this number (about 1 MB) are broadcast.
BROADCAST_COLLECTIONS = 10_000


class NeedsAcceptance(ValueError):
    """A range lies in a gap whose stand-in mixes versions and must be accepted."""


def search(items: DataFrame, collection: str | None = None, box: tuple[float, float, float, float] | None = None, days: str | None = None, cloud_below: float | None = None, orbit_state: str | None = None, most: int | None = None) -> DataFrame:
    """Items that satisfy all given predicates; every one of them can be pushed to the scan.

    Cloud cover is strictly below its limit; a box meets an item's bounds inclusively; the orbit state is one of two,
    or ``as_bands`` for both.
    """
    out = items
    if collection is not None:
        out = out.where(F.col("collection") == collection)
    if box is not None:
        w, s, e, n = box
        out = out.where((F.col("minx") <= e) & (F.col("maxx") >= w) & (F.col("miny") <= n) & (F.col("maxy") >= s))
    if days is not None:
        out = out.where(within(F.col("dt"), days))
    if cloud_below is not None:
        out = out.where(F.col("cloud_cover") < cloud_below)
    if orbit_state not in (None, "as_bands"):
        if orbit_state not in ORBIT_STATES:
            raise ValueError(f"no orbit state {orbit_state!r}")
        out = out.where(F.col("orbit_state") == orbit_state)
    return out if most is None else out.limit(most)


def resolve_collection(source: str, collection: str, first: dt.date | None, last: dt.date | None, accept: bool = False) -> str:
    """The collection to search for a range of days: the stand-in of a gap that holds it whole, an error if a gap cuts it."""
    for gap in GAPS:
        if (gap.source, gap.collection) != (source, collection):
            continue
        if (last is not None and last < gap.first) or (first is not None and first > gap.last):
            continue
        inside = first is not None and last is not None and gap.first <= first and last <= gap.last
        if not inside or gap.fallback is None:
            raise ValueError(f"{collection} lacks {gap.first} to {gap.last}")
        if gap.confirm and not accept:
            raise NeedsAcceptance(f"{gap.fallback} stands in for {gap.first} to {gap.last}")
        return gap.fallback
    return collection


def route(ranges: DataFrame, gaps: DataFrame) -> DataFrame:
    """``ranges(.., source, collection, first, last)`` with ``routed`` and ``outcome``.

    The same rule over tables: the few gaps of a collection are one array beside each range, so ranges aren't shuffled
    and repeated ones stay. The first gap by day that a range overlaps decides.
    """
    known = gaps.groupBy("source", "collection").agg(F.sort_array(F.collect_list(F.struct("gap_start", "gap_end", "fallback", "confirm"))).alias("_gaps"))
    small = known.limit(BROADCAST_COLLECTIONS + 1).count() <= BROADCAST_COLLECTIONS
    joined = ranges.join(F.broadcast(known) if small else known, ["source", "collection"], "left")
    first, last = F.col("first"), F.col("last")
    overlaps = lambda g: F.coalesce(last >= g["gap_start"], F.lit(True)) & F.coalesce(first <= g["gap_end"], F.lit(True))
    hit = joined.withColumn("_gap", F.get(F.filter("_gaps", overlaps), F.lit(0)))
    gap = F.col("_gap")
    inside = F.coalesce((first >= gap["gap_start"]) & (last <= gap["gap_end"]) & gap["fallback"].isNotNull(), F.lit(False))
    outcome = F.when(gap.isNull(), "kept").when(~inside, "refused").when(gap["confirm"], "needs acceptance").otherwise("fallback")
    routed = F.when(outcome == "kept", F.col("collection")).when(outcome != "refused", gap["fallback"])
    return hit.select(*ranges.columns, routed.alias("routed"), outcome.alias("outcome"))


def gap_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g.source, g.collection, g.first, g.last, g.fallback, g.confirm) for g in GAPS], "source string, collection string, gap_start date, gap_end date, fallback string, confirm boolean")


def renamed_assets(assets: Column, names: dict[str, str]) -> Column:
    """Keys of an asset map renamed; unknown keys stay. Two keys of one name fail (Spark refuses duplicate map keys)."""
    if not names:
        return assets
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.transform_keys(assets, lambda k, _: F.coalesce(F.try_element_at(table, k), k))


def kept_assets(assets: Column, keys: list[str]) -> Column:
    return F.map_filter(assets, lambda k, _: k.isin(keys))


def best_versions(items: DataFrame) -> DataFrame:
    """One item for each tile and UTC day: the highest baseline as text (none counts as "0"), the first in order on ties.

    ``items(item_id, pos, dt, grid_code, mgrs_tile, baseline, ..)``; the rank is cut to one before the shuffle.
    """
    tile = tile_of(F.col("grid_code"), F.col("mgrs_tile"), F.col("item_id"))
    order = Window.partitionBy(tile, F.to_date("dt")).orderBy(F.coalesce("baseline", F.lit("0")).desc(), F.col("pos"))
    return items.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def unclear(day: Column, applied: Column, baseline: Column) -> Column:
    """Whether only pixels can tell an item's offset; a missing flag isn't false."""
    return F.coalesce(applied.eqNullSafe(F.lit(False)) & (F.coalesce(baseline, F.lit("00.00")) >= "04.00") & day.between(F.lit(UNCLEAR_FROM), F.lit(UNCLEAR_TO)), F.lit(False))


def offset_from_metadata(source: Column, collection: Column, day: Column, applied: Column, baseline: Column) -> Column:
    """0, 1000, or null where pixels must tell or the collection isn't known."""
    late = F.coalesce(baseline, F.lit("00.00")) >= "04.00"
    return (
        F.when((source == "earthsearch") & (collection == "sentinel-2-c1-l2a"), OFFSET)
        .when((source == "earthsearch") & (collection == "sentinel-2-l2a"), F.when(~unclear(day, applied, baseline), 0))
        .when((source == "planetary-computer") & (collection == "sentinel-2-l2a"), F.when(late, OFFSET).otherwise(0))
    )


def offset_from_pixels(pixels: DataFrame, item: str = "item_id", blue: str = "blue", classes: str = "scl", least: int = LEAST_DARK) -> DataFrame:
    """``(item, n_dark, share_below, dn_offset)``: dark clear pixels lie below 1000 unless they carry the offset."""
    dark = pixels.where(F.col(classes).isin(*DARK_CLASSES) & (F.col(blue) > 0))
    stats = dark.groupBy(item).agg(F.count(F.lit(1)).alias("n_dark"), F.avg((F.col(blue) < OFFSET).cast("double")).alias("share_below"))
    rule = F.when(F.col("n_dark") < least, None).when(F.col("share_below") <= WITH_OFFSET_MOST, OFFSET).when(F.col("share_below") >= WITHOUT_OFFSET_LEAST, 0)
    return stats.withColumn("dn_offset", rule.cast("int"))


def with_offsets(items: DataFrame, pixels: DataFrame | None = None) -> DataFrame:
    """Items with ``dn_offset`` and ``dn_offset_from``; pixels are read for unclear items only."""
    known = offset_from_metadata(F.col("source"), F.col("collection"), F.to_date("dt"), F.col("offset_applied"), F.col("baseline"))
    open_ = (F.col("source") == "earthsearch") & (F.col("collection") == "sentinel-2-l2a") & unclear(F.to_date("dt"), F.col("offset_applied"), F.col("baseline"))
    out = items.drop("dn_offset", "dn_offset_from").withColumn("_meta", known).withColumn("_open", F.coalesce(open_, F.lit(False)))
    if pixels is None:
        tested = out.withColumn("_pixels", F.lit(None).cast("int"))
    else:
        needed = out.where("_open").select("item_id").distinct()
        told = offset_from_pixels(pixels.join(needed, "item_id", "left_semi")).select("item_id", F.col("dn_offset").alias("_pixels"))
        tested = out.join(told, "item_id", "left")
    offset = F.when(F.col("_open"), F.coalesce("_pixels", F.lit(OFFSET))).otherwise(F.col("_meta"))
    origin = F.when(F.col("_open"), F.when(F.col("_pixels").isNotNull(), "pixels").otherwise("date")).when(F.col("_meta").isNotNull(), "metadata")
    return tested.withColumn("dn_offset", offset.cast("int")).withColumn("dn_offset_from", origin).drop("_meta", "_open", "_pixels")


def shift(offset: Column) -> Column:
    """What to add to an item's values to bring them to the common encoding."""
    return F.coalesce(F.lit(OFFSET) - offset, F.lit(0))
