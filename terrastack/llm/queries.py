"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import terrastack.packaging  # noqa: F401  functions travel by value
from terrastack.llm.mixing import SQL as MIXING_SQL
from terrastack.llm.url_filter import SQL as URL_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are dated by their id and the list is made from their hosts: the tables hold neither."""
    from terrastack.llm.url_filter import filtered, sample_list

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    return filtered(pages.withColumn("fetched", fetched), sample_list(pages))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrastack.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, tau=4)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrastack.llm.suffix_dedup import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_itq(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrastack.llm.itq import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), least=0.93)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrastack.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), least=0.3)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrastack.llm.pii import digest, personal_data

    return digest(personal_data(_table(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrastack.llm.decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrastack.llm.mixing import taken

    out = taken(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrastack.llm.hilbert import sharded

    return sharded(_table(spark, sf_dir, "documents"), shards=24)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrastack.llm.html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_decontaminate": op2_decontaminate,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mixing": op4_mixing,
    "op5_html": op5_html,
    "op6_hilbert": op6_hilbert,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_itq": op10_itq,
}
ORACLES: dict[str, str] = {"op1_url_filter": URL_SQL, "op4_mixing": MIXING_SQL}
