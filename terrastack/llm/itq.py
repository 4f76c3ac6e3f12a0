"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Rotations learnt on a bounded sample balance the signs of the principal components (Gong and Lazebnik's
iterative quantisation), so that close vectors agree in most bits of their codes. Every vector is then indexed in
tables by pieces of its code; vectors that share a piece meet, and their cosine is computed from the original
vectors in double precision.

The width of a piece follows from the rows: about log2 of those of the largest label over ``BUCKET``, so a bucket holds
about that many vectors however many there are. Wider pieces agree more rarely, so there are more tables then, over the
codes of several rotations: as many as it takes for pairs at the very threshold, made from the sample in random
directions, to meet with a share of ``RECALL``. Closer pairs meet more often.

Nothing is emitted per pair: a bucket yields one row for each vector with links - their number, counting a pair in the
first table where it meets only, and the smallest vector of its part of the bucket. A bucket of more than ``chunk``
vectors is dealt in chunks, each pair of chunks to a task of its own. Equal vectors are one node with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.llm.components import connected_components, local_components
from terrastack.llm.staging import fits, looked_up, staged

#: Vectors of a bucket to aim at, and the narrowest and widest pieces.
BUCKET, NARROWEST, WIDEST = 64, 6, 30
#: Share of the pairs at the threshold that must meet, and the tables at which no more are added.
RECALL, MOST_TABLES = 0.96, 512


def fit_rotation(sample: np.ndarray, rounds: int = 40, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (d x bits, bits = min(d, 64)) of unit vectors, learnt by iterative quantisation."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    bits = min(sample.shape[1], 64)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    basis = vectors[:, ::-1][:, :bits]
    v = centred @ basis
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, basis @ r


class Tables:
    """The pieces of a vector's codes, one for each table."""

    def __init__(self, sample: np.ndarray, n: int, least: float, seed: int = 0) -> None:
        """For ``n`` vectors at most in a label, fitted on a sample of unit vectors."""
        self.width = int(np.clip(np.ceil(np.log2(max(n, 1) / BUCKET)), NARROWEST, WIDEST))
        self.mean, self.projections, self.tables = sample.mean(axis=0), [], 1
        rng = np.random.default_rng(seed)
        x = sample[:2048]
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        long = np.linalg.norm(away, axis=1, keepdims=True)
        y = np.where(long > 1e-9, least * x + np.sqrt(max(0.0, 1 - least * least)) * away / np.maximum(long, 1e-9), x)
        met, a, b = np.zeros(len(x), bool), np.zeros((len(x), 0), bool), np.zeros((len(x), 0), bool)
        while True:
            while a.shape[1] < self.tables * self.width:
                _, projection = fit_rotation(sample, seed=seed + len(self.projections))
                self.projections.append(projection)
                a, b = (np.concatenate((old, (v - self.mean) @ projection >= 0), axis=1) for old, v in ((a, x), (b, y)))
            own = slice((self.tables - 1) * self.width, self.tables * self.width)
            met |= (a[:, own] == b[:, own]).all(axis=1)
            if not len(x) or met.mean() >= RECALL or self.tables >= MOST_TABLES:
                break
            self.tables += 1

    def pieces(self, unit: np.ndarray) -> np.ndarray:
        """Rows x tables."""
        bits = np.concatenate([(unit - self.mean) @ p >= 0 for p in self.projections], axis=1)[:, : self.tables * self.width]
        return bits.reshape(len(unit), self.tables, self.width) @ (1 << np.arange(self.width))


def unit_vectors(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def close_pairs(starts: np.ndarray, ends: np.ndarray, x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (u < v) of rows of one bucket with cosine of ``least`` or more; rows of a bucket lie from start to end."""
    us, vs, size = [], [], ends - starts
    end_of = np.repeat(ends, size)
    at = np.flatnonzero(np.repeat((size > 1) & (size <= 48), size))
    for d in range(1, 48):  # small buckets together: rows d apart
        at = at[at + d < end_of[at]]
        if not len(at):
            break
        near = np.einsum("ij,ij->i", x[at], x[at + d]) >= least
        us.append(at[near]), vs.append(at[near] + d)
    for s, e in zip(starts[size > 48], ends[size > 48]):
        for a in range(s, e, 1024):
            u, v = np.nonzero(x[a : min(a + 1024, e)] @ x[s:e].T >= least)
            u, v = u + a, v + s
            us.append(u[u < v]), vs.append(v[u < v])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(us or none), np.concatenate(vs or none)


def near_vectors(vectors: DataFrame, least: float = 0.93, sample: int = 8192, chunk: int = 256) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``.

    Rows link when labels are equal and not null and the cosine is ``least`` or more. A row whose vector or label is
    null, or whose vector is empty, zero or holds a null or non-finite component, links with nothing: 0 links, its own
    component. Only vectors of one length compare. Repeated rows are vectors of their own and link with each other;
    of vectors that tie as the smallest id of a component all are kept. A null vec_id links and is never a component's
    name where another id is. Other columns are ignored, very long ones too; an empty table gives an empty result. The
    rotations are fitted on ``sample`` distinct vectors of each length, those of the smallest hashes; every vector is
    indexed.
    """
    e = F.col("embedding")
    sound = F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), (e if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else e.cast("array<double>")).alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"))
    rows = rows.withColumn("h1", F.xxhash64("label", "embedding")).withColumn("h2", F.hash("embedding", "label"))
    nodes = rows.where("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("label", "embedding")).alias("x")).select("h1", "h2", "node", "copies", F.col("x.label").alias("label"), F.col("x.embedding").alias("embedding"))
    nodes = staged(nodes, "vectors")
    sizes = [r[0] for r in nodes.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()]
    found = None
    for size in sizes:
        part = _links(nodes.where(F.size("embedding") == size), size, least, sample, chunk)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = staged(found, "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    parents = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = nodes.select("h1", "h2", "node", "copies").join(counts, "node", "left").join(parents, "node", "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("component"))
    joined = looked_up(rows.where("sound").drop("embedding", "label"), staged(known, "known"), ["h1", "h2"], ["vec_id"])
    out = joined.select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    out = out.unionByName(rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(nodes: DataFrame, size: int, least: float, sample: int, chunk: int) -> DataFrame:
    """``(node, n, root)``: links counted in one bucket, and the smallest node of its part there."""
    taken = nodes.orderBy("h1", "h2").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
    most = nodes.groupBy("label").count().agg(F.max("count")).first()[0]
    index = Tables(unit_vectors(taken, size), most, least)
    kind = nodes.schema["embedding"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                code = index.pieces(unit_vectors(part.column(3), size)).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(len(code) + 1, dtype=np.int32) * index.tables, pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["node", "copies", "label", "embedding", "code"])

    coded = staged(nodes.select("node", "copies", "label", "embedding").mapInArrow(encode, f"node long, copies long, label long, embedding {kind}, code array<int>"), "codes")
    bucket = F.xxhash64("label", "slot", "piece").alias("bucket")
    sizes = coded.select("label", F.posexplode("code").alias("slot", "piece")).groupBy(bucket).agg(F.count(F.lit(1)).alias("rows"))
    large = staged(sizes.where(F.col("rows") > chunk).select("bucket", F.ceil(F.col("rows") / chunk).cast("int").alias("chunks")), "large")
    slots = coded.select("node", "copies", "label", "embedding", "code", F.posexplode("code").alias("slot", "piece")).withColumn("bucket", bucket)
    dealt = slots.join(F.broadcast(large) if fits(large) else large, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "slot", "own", F.when(F.col("own") == F.col("other"), 0).otherwise(1).alias("crossed"), "node", "copies", "label", "embedding", "code")

    tables = index.tables

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            rows += [unit_vectors(batch.column(7), size), batch.column(8).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, tables)]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [x[last:] for x in rows]
            yield from found([x[:last] for x in rows])
        if held is not None:
            yield from found(held)

    def found(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, slot, own, crossed, node, copies, label, x, code = rows
        if not len(key):
            return
        cut = np.flatnonzero(np.diff(key)) + 1
        u, v = close_pairs(np.append(0, cut), np.append(cut, len(key)), x, least)
        # a key is a hash of label, table and piece; across chunks only rows of different chunks are new
        ok = (label[u] == label[v]) & (slot[u] == slot[v]) & (code[u, slot[u]] == code[v, slot[u]]) & ((crossed[u] == 0) | (own[u] != own[v]))
        for t in range(tables):  # counted in the first table where they meet
            ok &= (t >= slot[u]) | (code[u, t] != code[v, t])
        u, v = u[ok], v[ok]
        n = np.bincount(u, weights=copies[v], minlength=len(key)) + np.bincount(v, weights=copies[u], minlength=len(key))
        has = np.flatnonzero(n)
        if len(has):
            order = np.argsort(node, kind="stable")  # components are named by their smallest node
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            root = order[local_components(len(key), place[u], place[v])[place]]
            yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(n[has].astype(np.int64)), pa.array(node[root[has]])], names=["node", "n", "root"])

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(link, "node long, n long, root long")
