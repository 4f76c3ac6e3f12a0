"""Cutting lineage in the folder that all executors share, and what follows from staged tables: sizes and ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType

#: Bytes of a table up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Parts that each key of a table beyond that is dealt in, against keys that very many rows share.
SALT = 16
_PLACE = (1 << 33) - 1
#: Spark's setting by which a query's shuffle files go when it ends.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one for a local master only (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Unlike ``localCheckpoint`` the files outlive any executor. The folder is the cluster's to expire. Files of the
    shuffles that led here are removed as soon as the table is written, not when the driver collects its garbage.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_FREED, None)
    conf.set(_FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            conf.unset(_FREED)
        else:
            conf.set(_FREED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, most: int | None = None) -> bool:
    """Whether a (staged) table has at most ``most`` bytes in memory: measured, not estimated from its rows."""
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    lists = [F.lit(32) * F.greatest(F.size(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, (ArrayType, MapType))]
    row = F.lit(32 + 16 * len(df.columns))
    for c in [*long, *lists]:
        row = row + c
    return (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= (BROADCAST_BYTES if most is None else most)


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it (case doesn't matter to Spark)."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """``rows`` left-joined with a staged ``table`` that has one row for each value of ``keys``.

    Broadcast if it fits; else by shuffle, each key in parts by the hash of columns ``spread`` of ``rows``.
    """
    if fits(table):
        return rows.join(F.broadcast(table), keys, "left")
    salt = unused([*rows.columns, *table.columns], "salt")
    dealt = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(SALT)).cast("int")).join(dealt, [*keys, salt], "left").drop(salt)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``rank``, from 0 without gaps, staged; ``rank`` must be no column of ``df``.

    A range partitioning and one offset for each partition: no task holds more than its range. Rows that are equal in
    ``order`` are spread as well (by their place in the input), so repeated rows overload no range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie, part, place = (unused(df.columns, x) for x in ("tie", "part", "place"))
    keys = [*order, F.col(tie)]
    runs = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop(tie)
    placed = staged(runs.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))), name)
    before = F.coalesce(F.sum("rows").over(Window.partitionBy().orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition: no more than there are tasks
    first = placed.groupBy(part).agg(F.count(F.lit(1)).alias("rows")).select(part, before.alias("rank"))
    return placed.join(F.broadcast(first), part).withColumn("rank", F.col("rank") + F.col(place)).drop(part, place)
