"""Removal of repeated byte strings by blockwise suffix sorting over a cover sample.

Sorting all suffixes would move every byte position of the corpus. Blockwise construction needs less: precompute
ranks for a *cover sample* of suffixes, then sort one bucket of suffixes at a time and settle ties beyond a short
prefix by the ranks of sampled suffixes at a common offset. A difference cover of residues gives every two
positions such an offset at a density of |D|/v (14 % for v = 64). Here the cover is chosen by content instead: of the
51 substrings of 50 bytes in each 100-byte window, the one with the smallest hash, leftmost on ties, is sampled. Equal
windows then have their sample at the same offset - the property of a difference cover - at a density of 2/52.

* Pass 1 gives each sampled suffix its rank (the class of its 50 bytes) and the hash of the *block* of bytes that all
  windows of this sample cover. A bucket holds the suffixes of one class. Equal blocks settle all their windows at
  once; a class with one block only has nothing else to settle.
* Pass 2 sorts the remaining windows, those of first blocks in classes with several, by rank and content to depth 100.

Only positions are shuffled, never bytes, until the texts meet their spans. Each task folds its repeats before the
shuffle, so a passage that every document holds sends one row per task, and no bucket grows with a passage's copies.
Strings are compared by two polynomial hashes of 64 bits each, of independent bases and byte weights: a block is known by
both of all its bytes besides its class, a window by both of its 100 bytes. A task sorts one bucket at a time, the
number of tasks and of buckets follows from the bytes of the corpus, and beyond ``MOST_PARTS`` tasks the
classes are done in rounds, so neither memory nor shuffle grows with the corpus beyond what is set here.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.llm.staging import staged
from terrastack.llm.textkit import BASE, WEIGHT, buffer, mixed, powers, runs_of_rows

#: Bytes of text hashed at a time; positions within fit into 20 bits.
BLOCK = 1 << 20
#: Sampled suffixes or windows that a task folds before it sends them on.
FOLD = 500_000
#: Open blocks up to this number are found again by a bitmap of 16 bits each (8 MB at most); more by a join on documents.
FILTER_BLOCKS = 1 << 22
#: Bytes of text for each task and for each bucket it sorts at a time, and tasks of one round.
PART_BYTES, BUCKET_BYTES, MOST_PARTS = 256 << 20, 4 << 20, 20_000

CLASS, SEVERAL, FIRST, REPEAT, OPEN = range(5)
PACKED = "bucket int, packed binary"
SPANS = "doc long, s long, e long, kind int, mark long"


@dataclass
class Rows:
    """Columns of suffixes (or spans, or windows): key, two more hashes, document, start, number and kind."""

    key: np.ndarray
    block: np.ndarray
    also: np.ndarray
    doc: np.ndarray
    s: np.ndarray
    n: np.ndarray
    kind: np.ndarray

    @staticmethod
    def of(key: np.ndarray, block: np.ndarray, also: np.ndarray, doc: np.ndarray, s: np.ndarray, n: np.ndarray, kind: int | np.ndarray) -> Rows:
        return Rows(key.astype(np.uint64), block.astype(np.uint64), also.astype(np.uint64), doc, s, n, np.broadcast_to(np.asarray(kind, np.uint8), key.shape))

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        if not parts:
            none = np.zeros(0, np.int64)
            return Rows.of(none, none, none, none, none, none, 0)
        return Rows(*(np.concatenate([getattr(p, f) for p in parts]) for f in Rows.__dataclass_fields__))

    def at(self, index: np.ndarray) -> Rows:
        return Rows(*(getattr(self, f)[index] for f in Rows.__dataclass_fields__))

    def __len__(self) -> int:
        return len(self.key)


def planes(values: np.ndarray) -> bytes:
    """The bytes of fixed-width numbers, first bytes first: the zero bytes of small numbers lie together."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplanes(raw: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8)[: n * size].reshape(size, n).T).view(kind).ravel()


_WIDTHS = (np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint8)


def packed(rows: Rows, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows by ranges of their keys, one binary for each of ``buckets``: in order of keys, as differences, compressed.

    About 19 bytes a row reach the shuffle instead of 49 of a row of longs.
    """
    if not len(rows):
        return
    rows = rows.at(np.argsort(rows.key, kind="stable"))
    part = (rows.key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    ids, blobs = [], []
    for a, b in zip(cut, np.append(cut[1:], len(part))):
        doc = rows.doc[a:b]
        columns = (np.diff(rows.key[a:b], prepend=np.uint64(0)), rows.block[a:b], rows.also[a:b], doc - doc.min(), rows.s[a:b], rows.n[a:b], rows.kind[a:b])
        raw = b"".join(planes(np.ascontiguousarray(c, w)) for c, w in zip(columns, _WIDTHS))
        blobs.append(np.array([b - a, doc.min(), len(raw)], np.int64).tobytes() + pa.compress(raw, codec="zstd", asbytes=True))
        ids.append(int(part[a]))
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])


def unpacked(blob: bytes) -> Rows:
    n, low, size = np.frombuffer(blob, np.int64, 3).tolist()
    raw, columns, at = pa.decompress(memoryview(blob)[24:], decompressed_size=size, codec="zstd", asbytes=True), [], 0
    for w in _WIDTHS:
        columns.append(unplanes(raw[at : at + n * np.dtype(w).itemsize], n, w))
        at += n * np.dtype(w).itemsize
    return Rows(np.cumsum(columns[0], dtype=np.uint64), columns[1], columns[2], columns[3] + low, *columns[4:])


def buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """The rows of each bucket of a task, one bucket at a time; a bucket is a range of keys of the whole corpus."""
    bucket, found = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            if b != bucket and found:
                yield Rows.joined(found)
                found = []
            bucket = b
            found.append(unpacked(blob.as_py()))
    if found:
        yield Rows.joined(found)


class Hashed:
    """Rolling hashes of a stretch of bytes with the bounds of its documents."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int) -> None:
        n, self.length = len(data), length
        self.up, self.down = powers(n + 1)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.total[1:])
        self.data_len, self.ends = n, ends
        self.other_up, self.other_down = powers(n + 1, other=True)
        self.other_total = np.zeros(n + 1, np.uint64)
        np.cumsum(WEIGHT[data] * self.other_up[:n], out=self.other_total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.total[end] - self.total[start]) * self.down[start])

    def other(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash that is independent of the first."""
        return mixed((self.other_total[end] - self.other_total[start]) * self.other_down[start])

    def sample(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sampled suffixes: class hash, two block hashes, first window, number of windows."""
        length, k, n = self.length, self.length // 2, self.data_len
        none = np.zeros(0, np.int64)
        empty = none.view(np.uint64), none.view(np.uint64), none.view(np.uint64), none, none
        if n < length:
            return empty
        h = mixed((self.total[k:] - self.total[:-k]) * self.down[: n - k + 1])
        low = np.uint64(BLOCK - 1)
        least, width, have = (h & ~low) | np.arange(len(h), dtype=np.uint64), length - k + 1, 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        at = np.arange(n - length + 1)
        inside = np.flatnonzero(np.repeat(self.ends, np.diff(self.ends, prepend=0))[: len(at)] >= at + length)
        if not len(inside):
            return empty
        chosen = (least[inside] & low).astype(np.int64)
        new = np.concatenate(([True], (np.diff(chosen) != 0) | (np.diff(inside) != 1)))
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(chosen)))
        start, p = inside[first], chosen[first]
        end = start + count + length - 1
        shape = ((p - start) * (1 << 20) + count).astype(np.uint64)
        # the smallest of many hashes lie near zero: mixed anew, their ranges are even
        return mixed(h[p] * BASE), mixed(self.of(start, end) * BASE + shape), mixed(self.other(start, end) * BASE + shape), start, count


def stretches(batch: pa.RecordBatch, length: int) -> Iterator[tuple[Hashed, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed stretches of a batch of (doc, text), in order of documents; with each stretch's ends, ids and offsets."""
    order = pc.sort_indices(batch.column(0))
    batch = batch.take(order)
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    data, off = buffer(batch.column(1))
    for a, b in runs_of_rows(off, BLOCK):
        if off[b] - off[a] <= BLOCK:
            ends = off[a + 1 : b + 1] - off[a]
            yield Hashed(data[off[a] : off[b]], ends, length), ends, ids[a:b], np.zeros(b - a, np.int64)
            continue
        for lo in range(int(off[a]), max(int(off[a]) + 1, int(off[b]) - length + 1), BLOCK - length + 1):  # one long document, windows dealt over overlapping stretches
            part = data[lo : min(lo + BLOCK, int(off[b]))]
            yield Hashed(part, np.array([len(part)]), length), np.array([len(part)]), ids[a : a + 1], np.array([lo - off[a]])


def located(start: np.ndarray, ends: np.ndarray, ids: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and position within it, of positions within a stretch."""
    row = np.searchsorted(ends, start, side="right")
    begins = np.concatenate(([0], ends[:-1]))
    return ids[row], start - begins[row] + shift[row]


def spans_of(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans merged where they touch or overlap."""
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    if not len(doc):
        return doc, s, e
    new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    reach = np.concatenate([np.maximum.accumulate(x) for x in np.split(e, new[1:])])
    cut = np.concatenate(([True], (doc[1:] != doc[:-1]) | (s[1:] > reach[:-1])))
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], s[first], reach[last]


def firsts(keys: list[np.ndarray], doc: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Order by keys (most significant first), then document and position.

    Returns the order, for each key where it or a key before it changes, and what repeats an earlier position.
    """
    order = np.lexsort((s, doc, *reversed(keys)))
    change, changes = np.zeros(len(order), bool), []
    change[:1] = True
    for k in keys:
        k = k[order]
        change = change.copy()
        change[1:] |= k[1:] != k[:-1]
        changes.append(change)
    at = np.maximum.accumulate(np.where(change, np.arange(len(order)), 0))
    d, p = doc[order], s[order]
    return order, changes, (d != d[at]) | (p != p[at])


def marks(doc: np.ndarray, s: np.ndarray) -> np.ndarray:
    return mixed(doc.astype(np.uint64) * BASE + s.astype(np.uint64))


def repeats(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> Rows:
    doc, s, e = spans_of(doc, s, e)
    none = np.zeros(len(doc))
    return Rows.of(marks(doc, s), none, none, doc, s, e - s, REPEAT)


def folded(rows: list[Rows], length: int) -> Rows:
    """Of a task's sampled suffixes: one for each block of a class with one block; of a class with several, a mark for
    the class and each block's first (by block, so they spread); and the spans that repeat."""
    all_ = Rows.joined(rows)
    order, (new_key, _, new_block), again = firsts([all_.key, all_.block, all_.also], all_.doc, all_.s)
    r = all_.at(order)
    group = np.cumsum(new_key) - 1
    several = np.bincount(group, weights=new_block)[group] > 1 if len(r) else new_key
    one, mark, first = r.at(new_block & ~several), r.at(new_key & several), r.at(new_block & several)
    mark.kind, first.kind = np.full(len(mark), SEVERAL, np.uint8), np.full(len(first), FIRST, np.uint8)
    first.key = mixed(first.key * BASE + first.block)
    return Rows.joined([one, mark, first, repeats(r.doc[again], r.s[again], r.s[again] + r.n[again] + length - 1)])


def spans_batch(doc: np.ndarray, s: np.ndarray, e: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(doc), 50_000):
        b = slice(a, a + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(doc[b]), pa.array(s[b]), pa.array(e[b]), pa.array(np.full(len(doc[b]), kind, np.int32)), pa.array(marks(doc[b], s[b]).view(np.int64))], names=["doc", "s", "e", "kind", "mark"])


def settled(length: int):
    """Of each bucket of classes: spans that repeat, and the first blocks of classes with several, still open."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in buckets_of(batches):
            yield from bucket(rows)

    def bucket(rows: Rows) -> Iterator[pa.RecordBatch]:
        known = rows.at(rows.kind == REPEAT)
        yield from spans_batch(known.doc, known.s, known.s + known.n, REPEAT)
        firsts_ = rows.at(rows.kind == FIRST)
        order, (_, _, new), again = firsts([firsts_.key, firsts_.block, firsts_.also], firsts_.doc, firsts_.s)
        firsts_ = firsts_.at(order)
        rows = rows.at((rows.kind == CLASS) | (rows.kind == SEVERAL))
        order, (new_key, _, _, new_block), more = firsts([rows.key, rows.kind, rows.block, rows.also], rows.doc, rows.s)
        rows = rows.at(order)
        group = np.cumsum(new_key) - 1
        several = ((np.bincount(group, weights=new_block) > 1) | (np.bincount(group, weights=rows.kind == SEVERAL) > 0))[group] if len(rows) else new_key
        blocks = rows.kind == CLASS
        left = Rows.joined([firsts_.at(new), rows.at(new_block & several & blocks)])
        yield from spans_batch(left.doc, left.s, left.s + left.n, OPEN)
        done = Rows.joined([firsts_.at(again), rows.at(more & blocks)])
        yield from spans_batch(*spans_of(done.doc, done.s, done.s + done.n + length - 1), REPEAT)

    return of


def block_filter(open_blocks: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """A bitmap over the top bits of marks, of at least 16 bits for each of ``n`` open blocks."""
    bits = max(16, int(np.ceil(np.log2(16 * max(n, 1)))))
    placed = open_blocks.select(F.shiftrightunsigned("mark", 64 - bits).alias("place")).select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    got = placed.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return bits, words


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """Spans ``(doc, s, e)`` of bytes that strings of ``length`` bytes cover which also start earlier; they may overlap.

    ``docs(doc_id, text)``. Earlier is a smaller doc_id, or an earlier start in the same document.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    all_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rounds = -(-all_parts // MOST_PARTS)
    parts = -(-all_parts // rounds)
    each = max(1, -(-size // (BUCKET_BYTES * parts * rounds)))  # buckets of a task
    found = None
    for r in range(rounds):
        part = _round(source, length, parts, each, r, rounds)
        found = part if found is None else found.unionByName(part)
    return found


def _round(source: DataFrame, length: int, parts: int, each: int, turn: int, turns: int) -> DataFrame:
    """``repeated_spans`` by the classes whose hash modulo ``turns`` is ``turn``."""

    def folding(batches: Iterator[pa.RecordBatch], pick, fold) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            look = pick(batch)
            for stretch in stretches(batch, length):
                found = look(*stretch)
                rows.append(found)
                n += len(found)
                if n >= FOLD:
                    yield from packed(fold(rows), parts * each)
                    rows, n = [], 0
        yield from packed(fold(rows), parts * each)

    def dealt(rows: DataFrame, of) -> DataFrame:
        return rows.repartitionById(parts, F.floor(F.col("bucket") / each).cast("int")).sortWithinPartitions("bucket").mapInArrow(of, SPANS)

    def mine(hashed: Hashed) -> tuple[np.ndarray, ...]:
        found = hashed.sample()
        if turns == 1:
            return found
        own = found[0] % np.uint64(turns) == turn
        return tuple(x[own] for x in found)

    def sampled(_: pa.RecordBatch):
        def of(hashed: Hashed, ends: np.ndarray, ids: np.ndarray, shift: np.ndarray) -> Rows:
            key, block, also, start, count = mine(hashed)
            return Rows.of(key, block, also, *located(start, ends, ids, shift), count, CLASS)

        return of

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from folding(batches, sampled, lambda rows: folded(rows, length))

    first = staged(dealt(source.mapInArrow(rank, PACKED), settled(length)), "classes")
    open_blocks = first.where(F.col("kind") == OPEN)
    n = open_blocks.count()
    if n <= FILTER_BLOCKS:
        bits, bitmap = block_filter(open_blocks.select("mark"), n)
        held = source.sparkSession.sparkContext.broadcast(bitmap)
        looked = source

        def opened(_: pa.RecordBatch):
            filter_words = held.value

            def hit(mark: np.ndarray) -> np.ndarray:
                place = mark >> np.uint64(64 - bits)
                return (filter_words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1

            return lambda *stretch: windows_of(hit, *stretch)
    else:
        lists = open_blocks.groupBy("doc").agg(F.collect_list("mark").alias("marks"))
        looked = source.join(lists, "doc").select("doc", "text", "marks")

        def opened(batch: pa.RecordBatch):
            known = np.unique(batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            return lambda *stretch: windows_of(lambda mark: np.isin(mark, known), *stretch)

    def windows_of(hit, hashed: Hashed, ends: np.ndarray, ids: np.ndarray, shift: np.ndarray) -> Rows:
        _, _, _, start, count = mine(hashed)
        chosen = hit(marks(*located(start, ends, ids, shift)))
        start, count = start[chosen], count[chosen]
        at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        return Rows.of(hashed.of(at, at + length), hashed.other(at, at + length), np.zeros(len(at)), *located(at, ends, ids, shift), np.full(len(at), length), OPEN)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fold(rows: list[Rows]) -> Rows:
            r = Rows.joined(rows)
            order, (_, new), again = firsts([r.key, r.block], r.doc, r.s)
            r = r.at(order)
            return Rows.joined([r.at(new), repeats(r.doc[again], r.s[again], r.s[again] + length)])

        yield from folding(batches, opened, fold)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in buckets_of(batches):
            known, rows = rows.at(rows.kind == REPEAT), rows.at(rows.kind == OPEN)
            order, _, again = firsts([rows.key, rows.block], rows.doc, rows.s)
            rows = rows.at(order).at(again)
            yield from spans_batch(*spans_of(*(np.concatenate(x) for x in zip((known.doc, known.s, known.s + known.n), (rows.doc, rows.s, rows.s + rows.n)))), REPEAT)

    second = staged(dealt(looked.mapInArrow(windows, PACKED), compared), "windows")
    return first.where(F.col("kind") == REPEAT).select("doc", "s", "e").unionByName(second.select("doc", "s", "e"))


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Each document without the bytes that earlier equal strings of ``length`` bytes cover.

    Returns ``doc_id, n_bytes, n_removed, n_spans, spans (s << 32 | e), kept (binary)`` for every row of ``docs``;
    other columns are ignored. Texts are UTF-8 bytes; null is empty. Strings are judged on the input, overlaps count,
    and never cross documents. Rows that repeat a doc_id are the same document: neither repeats the other. A row
    with a null doc_id is left whole. A text shorter than ``length`` is left whole. A very long text is hashed in
    overlapping stretches. An empty table stays empty.
    """
    spans = repeated_spans(docs, length).groupBy("doc").agg(F.collect_list(F.expr("shiftleft(s, 32) | e")).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = rows.where("doc_id is not null").join(spans.withColumnRenamed("doc", "doc_id"), "doc_id", "left")
    joined = joined.unionByName(rows.where("doc_id is null").withColumn("spans", F.lit(None).cast("array<long>")))  # these meet no span

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffer(batch.column(1))
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            raw, removed, count, merged, kept = data.tobytes(), [], [], [], []
            for i in range(batch.num_rows):
                text, mine = raw[off[i] : off[i + 1]], values[ends[i] - sizes[i] : ends[i]]
                if not len(mine):
                    removed.append(0), count.append(0), merged.append([]), kept.append(text)
                    continue
                s, e = mine >> 32, np.minimum(mine & 0xFFFFFFFF, len(text))
                _, s, e = spans_of(np.zeros(len(s), np.int64), s, e)
                removed.append(int((e - s).sum())), count.append(len(s)), merged.append((s << 32 | e).tolist())
                gaps = zip([0, *e.tolist()], [*s.tolist(), len(text)])
                kept.append(b"".join(text[a:b] for a, b in gaps))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(merged, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary")
