"""Mixing sources to target weights: repetition rates, and hash-seeded copies of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastack.llm.staging import fits, ranked, staged, unused

#: Weights by place of a source in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated at most this often.
MOST = 3
#: Parts that each source is dealt in where the sources are too many to broadcast.
SALT = 16

_WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``.

    Sources by code point, null last, weigh 5, 2, 1, repeating, and share all sizes; a target stops at 3 times its
    source's size and the excess is shared anew by weight. That ends at the water level ``l`` at which the sum of
    ``least(3 * size, l * weight)`` is the total. The level rises from the plain share: what is full at one
    level is left out of the next, until no more is; each step is one aggregate over the sources, however many.
    """
    placed = ranked(sizes, [F.col("source").asc_nulls_last()], "sources")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long")
    weighed = placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * MOST).alias("cap"))
    total, level, full = weighed.agg(F.sum("source_size")).first()[0] or 0, None, -1
    while True:
        below = F.lit(False) if level is None else F.col("cap") / F.col("weight") < level
        n, caps, rest = weighed.agg(F.count(F.when(below, 1)), F.sum(F.when(below, F.col("cap"))), F.sum(F.when(~below, F.col("weight")))).first()
        if n == full:
            break
        full, level = n, (total - (caps or 0)) / rest if rest else 0.0
    return weighed.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def draw(docs: DataFrame, seed: str) -> Column:
    """A number below 2**32 made from the md5 of seed and doc_id (of the text where the id is null)."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), name)), 1, 8), 16, 10).cast("long")


def plans(sized: DataFrame) -> DataFrame:
    """``(source, source_size, target, times, cut)`` from ``sized(source, size, u)``.

    A source's rate is target / size: each of its documents is taken ``times`` = floor(rate) times, and once more if its
    number ``u`` is ``cut`` or less. The cut is at the fraction of the rate, but carried on to where the words taken
    along the order of ``u`` come nearest to the target. It is found in four steps of 8 bits: the words of each of the
    256 ranges of a source, then of the ranges within the one that holds the cut. So a source never has more than 256
    rows in a window, however many documents it has.
    """
    sums = staged(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    times = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    wanted = sums.withColumn("times", times).withColumn("need", F.when(F.col("times") < MOST, F.col("target") - F.col("times") * F.col("source_size")).otherwise(0.0))
    at = wanted.where("need > 0").select(F.col("source").alias("of"), F.lit(0).cast("long").alias("within"), F.lit(0).cast("long").alias("start"), "need")
    for shift in (24, 16, 8, 0):
        rows = sized.select("source", F.shiftright("u", shift).alias("range"), "size")
        same = F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("range", 8) == F.col("within"))
        if fits(at):
            met = rows.join(F.broadcast(at), same)
        else:
            dealt = at.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
            met = rows.join(dealt, same & (F.pmod("range", F.lit(SALT)) == F.col("salt")))
        words = met.groupBy("of", "range", "start", "need").agg(F.sum("size").alias("words"))
        upto = F.col("start") + F.sum("words").over(Window.partitionBy("of").orderBy("range"))
        crossed = words.withColumn("upto", upto).where("upto > need and upto - words <= need")
        first = crossed.groupBy("of").agg(F.min(F.struct("range", "words", "upto", "need")).alias("x")).select("of", "x.*")
        at = staged(first.select("of", F.col("range").alias("within"), (F.col("upto") - F.col("words")).alias("start"), "need", "words"), "cuts")
    # the number at which the target is passed is taken if that is nearer; where none passes it, all are
    cuts = at.select("of", F.when(2 * F.col("start") + F.col("words") <= 2 * F.col("need"), F.col("within")).otherwise(F.col("within") - 1).alias("u"))
    cut = F.when(F.col("need") > 0, F.coalesce("u", F.lit((1 << 32) - 1))).otherwise(-1)
    met = wanted.join(F.broadcast(cuts) if fits(at) else cuts, F.col("source").eqNullSafe(F.col("of")), "left")
    return staged(met.select("source", "source_size", "target", "times", cut.alias("cut")), "plans")


def _planned(rows: DataFrame, plan: DataFrame, number: Column, name: str) -> DataFrame:
    """``rows`` with the struct ``name``: source_size, target and copies of the row's source and ``number``."""
    own, salt = unused(rows.columns, "own"), unused(rows.columns, "salt")
    kept = F.struct("source", "source_size", "target", "times", "cut").alias(own)
    if fits(plan):
        joined = rows.join(F.broadcast(plan.select(kept)), F.col("source").eqNullSafe(F.col(f"{own}.source")), "left")
    else:  # a source may hold a third of all rows
        dealt = plan.select(kept, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias(salt))
        joined = rows.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text") if "text" in rows.columns else F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
        joined = joined.withColumnRenamed(salt, salt + "_row").join(dealt, (F.col("source").eqNullSafe(F.col(f"{own}.source"))) & (F.col(salt) == F.col(salt + "_row")), "left").drop(salt, salt + "_row")
    copies = F.col(f"{own}.times") + F.when(number <= F.col(f"{own}.cut"), 1).otherwise(0)
    return joined.withColumn(name, F.struct(F.col(f"{own}.source_size").alias("source_size"), F.col(f"{own}.target").alias("target"), copies.cast("long").alias("copies"))).drop(own)


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")
    return staged(docs.select("doc_id", "source", size.alias("size"), draw(docs, seed).alias("u")), "sizes")


def taken(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``(doc_id, size, source_size, target, copies)`` for every row of ``docs(doc_id, text, source)``.

    The text is read once. A source's rate is target / size. Each document is taken floor(rate) times, and once more if
    a number made from the md5 of seed and doc_id lies below the fraction of the rate - exactly: below the place near it
    at which the source's words come nearest to its target, within half a document. Reruns agree, and no document is
    taken more than 3 times. Null texts have size 0; very long texts are counted whole; a null source is a source; rows
    that repeat a doc_id fall alike, rows with a null doc_id by their texts; of sources equal in ``3 * size / weight``
    none has precedence; an empty table stays empty; other columns are ignored.
    """
    sized = _sized(docs, seed)
    out = _planned(sized, plans(sized), F.col("u"), "mix")
    return out.select("doc_id", "size", "mix.source_size", "mix.target", "mix.copies")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Each document as often as the mix (``taken``) takes it, with the columns of ``docs`` as they are, whatever their names.

    Null texts, null ids, ties, repeated rows, very long texts and empty tables are as in ``taken``.
    """
    name, copy = unused(docs.columns, "mix"), unused(docs.columns, "copy")
    out = _planned(docs, plans(_sized(docs, seed)), draw(docs, seed), name)
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(f"{name}.copies").cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))


#: The same mix for DuckDB: doc_id, size, source_size, target, taken.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 8) AS BIGINT) AS u FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS BIGINT) AS weight,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS place, source_size * 3 AS cap FROM sums
), levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
            / CAST(sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level,
         row_number() OVER (ORDER BY cap / weight, place) AS turn FROM weighed
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM levels WHERE level <= cap / weight ORDER BY turn LIMIT 1) * weight) AS target FROM levels
), wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(least(3, floor(target / source_size)) AS BIGINT) ELSE 0 END AS times FROM targets
), needs AS (
  SELECT *, CASE WHEN times < 3 THEN target - times * source_size ELSE 0.0::DOUBLE END AS need FROM wanted
), numbers AS (
  SELECT source, u, CAST(sum(size) AS BIGINT) AS words, CAST(sum(sum(size)) OVER (PARTITION BY source ORDER BY u) AS BIGINT) AS upto FROM sized GROUP BY source, u
)
SELECT d.doc_id, d.size, t.source_size, t.target, CAST(d.size * (t.times + CASE WHEN t.need > 0 AND 2 * n.upto - n.words <= 2 * t.need THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN needs t ON d.source IS NOT DISTINCT FROM t.source JOIN numbers n ON d.source IS NOT DISTINCT FROM n.source AND d.u = n.u
"""
