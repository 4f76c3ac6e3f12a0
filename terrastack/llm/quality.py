"""Quality scores by gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.llm.gbt import Trees, fit
from terrastack.llm.textkit import buffer, mixed, runs_of_rows, word_hashes, words

NAMES = ["log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "stop", "comma", "line", "high", "marked_words", "short_words", "long_words", "same_as_before", "distinct_words", "distinct_pairs", "words_a_line", "sentence_length"]

#: Kinds of bytes: 1 upper case, 2 digits, 3 symbols, 4 sentence ends, 5 commas and the like, 6 line ends, 7 beyond ASCII.
KIND = np.zeros(256, np.uint8)
KIND[ord("A") : ord("Z") + 1] = 1
KIND[ord("0") : ord("9") + 1] = 2
KIND[list(b"#$%&*+/<=>@\\^_`{|}~[]!")] = 3
KIND[list(b".?")] = 4
KIND[list(b",;:-'\"()")] = 5
KIND[ord("\n")] = 6
KIND[0x80:] = 7


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text of a buffer."""
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)
    kind = KIND[data]

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return (total[off[1:]] - total[off[:-1]]).astype(np.float64)

    kinds = [per_text(kind == k) for k in range(1, 8)]
    start, end, row = words(data, off)
    count = np.bincount(row, minlength=n).astype(np.float64)
    h = word_hashes(data, start, end)
    length = end - start
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind == 3, out=marks[1:])
    marked = marks[end] > marks[start]
    by_word = lambda mask: np.bincount(row[mask], minlength=n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    pair, pair_row = mixed(h[:-1] * np.uint64(3) + h[1:]), row[:-1]
    inside = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)

    def distinct(v: np.ndarray, r: np.ndarray) -> np.ndarray:
        order = np.argsort(v ^ mixed(r.astype(np.uint64) + np.uint64(1)))
        v, r = v[order], r[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[new], minlength=n)

    c, b = np.maximum(count, 1), np.maximum(size, 1)
    pairs = np.bincount(pair_row[inside], minlength=n)
    upper, digit, symbol, stop, comma, line, high = kinds
    return np.stack(
        [np.log1p(size), np.log1p(count), np.bincount(row, weights=length, minlength=n) / c, upper / b, digit / b, symbol / b, stop / c, comma / c, line / c, high / b, by_word(marked) / c, by_word(length <= 3) / c, by_word(length > 20) / c, by_word(same) / c, distinct(h, row) / c, distinct(pair[inside], pair_row[inside]) / np.maximum(pairs, 1), count / (line + 1), count / (stop + 1)],
        axis=1,
    )


def _over_texts(batch: pa.RecordBatch, column: int) -> np.ndarray:
    data, off = buffer(batch.column(column))
    parts = [statistics(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in runs_of_rows(off, 1 << 21)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def held_out(doc_id: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Trees:
    """Fit on about ``most`` labelled rows that aren't held out, those with the smallest hashes of their ids; at most twice as many.

    Only statistics of the texts are inputs. Of several labels of a document the mean decides (0.5 counts as 1); null
    labels are left out. The sampled labels are the only table that is broadcast: ``most`` bounds it (16 bytes a row).
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    n = known.count()
    taken = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < most)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(taken), "doc_id").select("label", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _over_texts(batch, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    # ids that repeat in docs would multiply the rows of a label: the bound holds whatever they do
    got = rows.mapInArrow(of, "label double, x array<double>").orderBy(F.xxhash64("x", "label"), "label").limit(2 * most).toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    x = np.stack(got.column("x").to_pylist())
    y = got.column("label").to_numpy()
    order = np.lexsort((y, *x.T))  # the result doesn't depend on the order of tasks
    return fit(x[order], y[order])


def scored(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` (doc_id, text) to ``(doc_id, score)``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.score(_over_texts(batch, 1)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(of, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, least: float = 0.3, most: int = 20_000) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``; score 0 to 1, higher is better.

    Whole texts are scored, null as empty. Without usable labels every score is 0.5. Rows with a null doc_id are
    scored and not held out; repeated rows are scored alike; a score of exactly ``least`` is predicted 1; very long texts
    are counted whole; an empty table gives an empty result. Other columns, language and source are ignored.
    """
    out = scored(docs, train(docs, labels, most))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, most: int = 20_000) -> DataFrame:
    """Rows of ``docs``, with all their columns, that score ``least`` or more: one pass, no join back.

    Nulls, repeated rows, very long texts, ties and empty tables are as in ``quality``.
    """
    trees = train(docs, labels, most)
    at = docs.columns.index("text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(trees.score(_over_texts(batch, at)) >= least))

    return docs.mapInArrow(of, docs.schema)
