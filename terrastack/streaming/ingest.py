"""New scenes as a stream: composites of the units they touch are brought up to date batch by batch.

The operators are batch operators; this is an addition for catalogues that grow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from terrastack.sources import store


def new_items(spark: SparkSession, folder: str, schema: str, late: str = "30 days") -> DataFrame:
    """Items from files as they arrive, each id once within the watermark."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark("dt", late).dropDuplicatesWithinWatermark(["item_id"])


def keep_up(items: DataFrame, path: str, checkpoint: str, units_of: Callable[[DataFrame], DataFrame], compose: Callable[[DataFrame], DataFrame], once: bool = True) -> StreamingQuery:
    """Rewrite, for each batch of items, the units they touch.

    ``units_of(items)`` gives (shard_y, shard_x, y0, ..); ``compose(units)`` their composite from all observations. Units
    are replaced whole, so a batch that runs again leaves the same store.
    """

    def batch(frame: DataFrame, _: int) -> None:
        units = units_of(frame).distinct()
        if not units.isEmpty():
            store.write_units(compose(units), path, units)

    writer = items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
