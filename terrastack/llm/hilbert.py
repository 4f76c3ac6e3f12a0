"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrastack.llm.staging import fits, ranked


def with_curve(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """``df`` with ``curve``: the Hilbert index of integer columns ``dims`` below 2**bits.

    Skilling's transform ("Programming the Hilbert curve", 2004): inverse undo from the top bit down, Gray encoding,
    then the bits are interleaved. Each step is a projection of columns of its own, so expressions don't grow.
    """
    n = len(dims)
    names = [f"_axis{i}" for i in range(n)]
    df = df.select("*", *(F.col(d).cast("int").alias(a) for d, a in zip(dims, names)))

    def step(df: DataFrame, new: dict[str, Column]) -> DataFrame:
        return df.withColumns(new)

    for level in range(bits - 1, 0, -1):
        q, p = 1 << level, (1 << level) - 1
        for i in range(n):
            x, first = F.col(names[i]), F.col(names[0])
            high = x.bitwiseAND(q) != 0
            swap = first.bitwiseXOR(x).bitwiseAND(p)
            if i == 0:
                df = step(df, {names[0]: F.when(high, first.bitwiseXOR(p)).otherwise(first)})
            else:
                df = step(df, {names[0]: F.when(high, first.bitwiseXOR(p)).otherwise(first.bitwiseXOR(swap)), names[i]: F.when(high, x).otherwise(x.bitwiseXOR(swap))})
    for i in range(1, n):
        df = step(df, {names[i]: F.col(names[i]).bitwiseXOR(F.col(names[i - 1]))})
    t = F.lit(0)
    for level in range(bits - 1, 0, -1):
        t = F.when(F.col(names[-1]).bitwiseAND(1 << level) != 0, t.bitwiseXOR((1 << level) - 1)).otherwise(t) if level < bits - 1 else F.when(F.col(names[-1]).bitwiseAND(1 << level) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0))
        df = step(df, {"_t": t})
        t = F.col("_t")
    df = step(df, {a: F.col(a).bitwiseXOR(t) for a in names})
    curve = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for a in names:
            curve = F.shiftleft(curve, 1).bitwiseOR(F.shiftright(F.col(a), level).bitwiseAND(1).cast("long"))
    return df.withColumn("curve", curve).drop(*names, "_t")


def ranked_values(df: DataFrame, column: str, bits: int) -> DataFrame:
    """``df`` with ``_<column>``: the rank of its value among the distinct ones (null last), scaled below 2**bits."""
    values = ranked(df.select(F.col(column).alias("_value")).distinct(), [F.col("_value").asc_nulls_last()], "values")
    n = max(values.count(), 1)
    scaled = values.select("_value", F.floor(F.col("rank") * (1 << bits) / n).cast("int").alias(f"_{column}"))
    if fits(scaled):
        return df.join(F.broadcast(scaled), F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")
    # a value may hold a third of all rows: each is dealt in 16 parts
    dealt = scaled.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(15))))
    parts = df.withColumn("_own", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(16)).cast("int"))
    return parts.join(dealt, F.col(column).eqNullSafe(F.col("_value")) & (F.col("_own") == F.col("_part")), "left").drop("_value", "_part", "_own")


def _placed(docs: DataFrame, shards: int, bits: int, carry: bool) -> DataFrame:
    """Columns of ``sharded`` for every row, with the row itself as struct ``_row`` if ``carry``."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if carry else []
    meta = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", size.alias("size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), *row)
    meta = ranked_values(ranked_values(meta, "lang", bits), "source", bits)
    meta = meta.withColumn("_size", F.least(F.floor(F.log2("size") * (1 << bits) / 32), F.lit((1 << bits) - 1)).cast("int"))
    curve = with_curve(meta, ["_lang", "_source", "_size"], bits).select("doc_id", "size", "text_crc32", "curve", *(["_row"] if carry else []))
    placed = ranked(curve, [F.col(c) for c in ("curve", "text_crc32", "size", "doc_id")], "runs")
    total = placed.count()
    out = placed.withColumn("shard", F.expr(f"rank * {shards} div {max(total, 1)}").cast("int"))
    first = F.expr(f"(shard * {total}L + {shards - 1}) div {shards}")
    return out.withColumns({"law": F.lit("rows"), "slot": (F.col("rank") - first).cast("long"), "grown_shard": F.lit(None).cast("int")})


_NEW = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def sharded(docs: DataFrame, shards: int = 24, bits: int = 6, carry: bool = False) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve)`` for every row of ``docs``.

    Language, source and the logarithm of the size are quantised to ``bits`` bits each, rows are sorted by their
    Hilbert index (equal texts of one language and source together, by checksum), and the order is cut into runs: the
    law is ``rows``, counts of shards differ by one at most. A group of equal texts is cut only where a
    shard ends within it; its members of other languages or sources lie elsewhere on the curve. ``slot`` is the
    place in the shard, from 0 without gaps. Size is the UTF-8 bytes of the text (null: none) plus 8. Null languages and
    sources rank last; repeated rows, rows with a null id and other ties take places of their own, in any order among
    themselves; fewer rows than shards leave some shards empty; an empty table stays empty; very long texts matter by
    size and checksum only. Texts are not shuffled: only what is returned is sorted.

    With ``carry`` the columns of ``docs`` come along, texts included, each row exactly once; the new columns
    replace those of ``docs`` with their names, but for doc_id.
    """
    placed = _placed(docs, shards, bits, carry)
    old = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in _NEW] if carry else [F.col("doc_id")]
    return placed.select(*old, *_NEW)


def write_shards(docs: DataFrame, path: str, shards: int = 24, bits: int = 6, rows: int = 1_000_000) -> None:
    """Documents as one folder a shard (``shard=<n>``), each file a run of at most ``rows`` rows of the curve in order.

    Readers prune files by language, source or size. Every row is written exactly once, with the columns of ``docs`` as
    they are and its ``slot``: rows carry what they hold to their places, so repeated rows and null ids need no
    key. Only columns of ``docs`` named ``shard`` and ``slot`` are replaced.
    """
    own = [F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    runs = _placed(docs, shards, bits, True).select(*own, "shard", "slot")
    runs.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", rows).partitionBy("shard").parquet(path)
