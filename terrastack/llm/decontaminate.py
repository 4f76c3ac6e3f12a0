"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.llm.staging import fits, staged
from terrastack.llm.textkit import buffer, ngrams, runs_of_rows, word_hashes, words

#: Bytes of test items that are broadcast at a time; a larger benchmark is searched in several passes.
ITEM_BYTES = 16 << 20
MISMATCH, GAP = -0.5, -0.5
#: Pairs of equal n-grams that are held at a time.
PAIRS = 1 << 22

#: Everything but ASCII letters and digits and bytes of longer UTF-8 sequences separates words here: punctuation is no evidence.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-cased texts, and the row of each."""
    plain = np.where(_SEPARATOR[data], np.uint8(32), data)
    start, end, row = words(plain, off)
    return word_hashes(plain, start, end), row


@dataclass
class Items:
    """Test items of one pass: words, and their n-grams in order of hash."""

    ids: np.ndarray
    first: np.ndarray  # of each item in ``word``, with the end
    word: np.ndarray
    gram: np.ndarray
    item: np.ndarray
    at: np.ndarray

    @staticmethod
    def of(table: pa.Table, n: int) -> Items:
        table = table.combine_chunks()
        data, off = buffer(table.column("text").combine_chunks())
        word, row = tokens(data, off)
        ids = table.column("item_id").to_numpy().astype(np.int64)
        first = np.searchsorted(row, np.arange(len(ids) + 1))
        gram, at = ngrams(word, row, n)
        order = np.argsort(gram, kind="stable")
        return Items(ids, first, word, gram[order], row[at][order], (at - first[row[at]])[order])

    def keep(self, mask: np.ndarray) -> Items:
        return Items(self.ids, self.first, self.word, self.gram[mask], self.item[mask], self.at[mask])

    def hits(self, gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index into ``gram``, index into the item n-grams) of equal hashes, about ``PAIRS`` at a time."""
        lo, hi = np.searchsorted(self.gram, gram, "left"), np.searchsorted(self.gram, gram, "right")
        some = np.flatnonzero(hi > lo)
        for a, b in runs_of_rows(np.concatenate(([0], np.cumsum((hi - lo)[some]))), PAIRS):
            part = some[a:b]
            n = (hi - lo)[part]
            start = np.repeat(lo[part] - np.concatenate(([0], np.cumsum(n)[:-1])), n)
            yield np.repeat(part, n), start + np.arange(len(start))

    def whole(self, fewest: int) -> dict[int, dict[int, list[int]]]:
        """Items of fewer than ``fewest`` words: by length and hash of all their words."""
        out: dict[int, dict[int, list[int]]] = {}
        size = np.diff(self.first)
        for i in np.flatnonzero((size > 0) & (size < fewest)).tolist():
            words_ = self.word[self.first[i] : self.first[i + 1]]
            h, _ = ngrams(words_, np.zeros(len(words_), np.int64), len(words_))
            out.setdefault(len(words_), {}).setdefault(int(h[0]), []).append(i)
        return out


def align(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Best local alignment score of ``item`` with each row of ``windows`` (words as hashes): match 1, linear gaps."""
    columns = np.arange(windows.shape[1] + 1, dtype=np.float32) * -GAP
    row = np.zeros((len(windows), windows.shape[1] + 1), np.float32)
    best = np.zeros(len(windows), np.float32)
    for w in item:
        step = np.where(windows == w, np.float32(1), np.float32(MISMATCH))
        new = np.zeros_like(row)
        new[:, 1:] = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] + np.float32(GAP)), 0)
        row = np.maximum.accumulate(new + columns, axis=1) - columns  # gaps along the row, at once
        best = np.maximum(best, row.max(axis=1))
    return best


def shared(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Words that ``item`` and each row of ``windows`` have in common, with repeats: no alignment scores more."""
    known, count = np.unique(item, return_counts=True)
    place = np.minimum(np.searchsorted(known, windows), len(known) - 1)
    row, column = np.nonzero(known[place] == windows)
    seen = np.bincount(row * len(known) + place[row, column], minlength=len(windows) * len(known))
    return np.minimum(seen.reshape(len(windows), len(known)), count).sum(axis=1)


def matches(word: np.ndarray, row: np.ndarray, rows: int, items: Items, n: int, least: float) -> list[tuple[int, int, float, int]]:
    """(row, item, share of the item's words that align, first word of the window) for texts given as words."""
    gram, at = ngrams(word, row, n)
    begin = np.searchsorted(row, np.arange(rows + 1))
    places = []
    for which, seed in items.hits(gram):
        item, place = items.item[seed], at[which]
        text = row[place]
        block = (place - items.at[seed] - begin[text]) // (items.first[item + 1] - items.first[item])  # the diagonal, in lengths of the item
        places.append(np.unique(np.stack((item, text, block), axis=1), axis=0))
    if not places:
        return []
    found = places[0] if len(places) == 1 else np.unique(np.concatenate(places), axis=0)
    out = []
    for mine in np.split(found, np.flatnonzero(np.diff(found[:, 0])) + 1):
        i = int(mine[0, 0])
        own = items.word[items.first[i] : items.first[i + 1]]
        m, width = len(own), 4 * len(own)  # an alignment of half the words or more strays by less than m on either side
        step = max(1, (1 << 21) // width)
        for a in range(0, len(mine), step):
            part = mine[a : a + step]
            start = begin[part[:, 1]] + (part[:, 2] - 1) * m
            index = start[:, None] + np.arange(width)
            inside = (index >= begin[part[:, 1]][:, None]) & (index < begin[part[:, 1] + 1][:, None])
            windows = np.where(inside, word[np.clip(index, 0, len(word) - 1)], np.uint64(0))
            able = shared(own, windows) >= least * m
            part, start, windows = part[able], start[able], windows[able]
            score = align(own, windows)
            ok = score >= least * m
            first = np.maximum(start - begin[part[:, 1]], 0)
            out += [(r, i, float(x) / m, f) for r, x, f in zip(part[ok, 1].tolist(), score[ok].tolist(), first[ok].tolist())]
    return out


def copies(word: np.ndarray, row: np.ndarray, rows: int, whole: dict[int, dict[int, list[int]]]) -> list[tuple[int, int, float, int]]:
    """Like ``matches``, for short items: whole copies only."""
    begin, out = np.searchsorted(row, np.arange(rows + 1)), []
    for m, known in whole.items():
        gram, at = ngrams(word, row, m)
        for j in np.flatnonzero(np.isin(gram, np.fromiter(known, np.uint64, len(known)))).tolist():
            r = int(row[at[j]])
            out += [(r, i, 1.0, int(at[j] - begin[r])) for i in known[int(gram[j])]]
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, least: float = 0.5, fewest: int = 8) -> DataFrame:
    """``(doc_id, item_id, score, start_word)``: documents that hold a test item, edited ones included.

    Words are runs of letters and digits, lower-cased. Every n-gram of an item is a seed, however common. Around every
    seed shared with a document the item is aligned with the document's words, unless the words there have too few in
    common with the item for the least score; ``score`` is the best alignment score as a share of the item's words,
    ``least`` or more; of equal scores the first window counts. Items of fewer than ``fewest`` words are too
    short for edited copies to be evidence: they match where all their words follow each other (score 1).

    Whole texts are searched, very long ones too. Null or empty items match nothing; null texts hold nothing. One row per
    row of ``docs`` and item_id; rows that repeat a doc_id may each report; items of one id are all searched. Empty
    tables give an empty result; other columns are ignored.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(total // ITEM_BYTES) + 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).where("text is not null")
    out = None
    for b in range(blocks):  # a stated query set, in blocks of bounded size
        table = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow()
        part = _search(texts, Items.of(table, n), n, least, fewest)
        out = part if out is None else out.unionByName(part)
    return out


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = buffer(batch.column(1))
    for a, b in runs_of_rows(off, 1 << 21):
        yield a, b, *tokens(data[off[a] : off[b]], off[a : b + 1] - off[a])


def _search(texts: DataFrame, items: Items, n: int, least: float, fewest: int) -> DataFrame:
    context = texts.sparkSession.sparkContext
    chosen = items.keep(np.diff(items.first)[items.item] >= fewest)
    sent = context.broadcast((chosen.ids, chosen.first, chosen.word, chosen.gram, chosen.item, chosen.at))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Items(*sent.value)
        whole = seeds.whole(fewest)
        for batch in batches:
            ids, best = batch.column(0).to_pylist(), {}
            for a, b, word, row in _texts(batch):
                for r, i, score, start in matches(word, row, b - a, seeds, n, least) + copies(word, row, b - a, whole):
                    key = a + r, int(seeds.ids[i])
                    if key not in best or (score, -start) > best[key]:
                        best[key] = score, -start
            rows = sorted(best)
            columns = [ids[r] for r, _ in rows], [i for _, i in rows], [best[k][0] for k in rows], [-best[k][1] for k in rows]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64())], names=["doc_id", "item_id", "score", "start_word"])

    return texts.mapInArrow(find, "doc_id long, item_id long, score double, start_word long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a test item; those with a null doc_id stay.

    Of rows that repeat a doc_id all go if one holds an item. Nulls, ties, very long texts and empty tables are as in
    ``contaminated``; all columns of ``docs`` are kept as they are.
    """
    found = staged(contaminated(docs, benchmark, **options).select("doc_id").distinct(), "leaks")
    return docs.join(F.broadcast(found) if fits(found) else found, "doc_id", "left_anti").select(*docs.columns)
