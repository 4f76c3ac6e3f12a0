"""SimHash fingerprints and near-duplicate groups by the generalised pigeonhole principle.

The 64 bits are dealt into partitions with thresholds of their own. If the thresholds t_i of m partitions sum to
``tau - m + 1``, two fingerprints that differ in at most tau bits differ in at most t_i bits within some partition
i, so probing every partition within its threshold loses no pair. Correlated bits are put together (they differ
together, so the other partitions keep their power to separate), and the thresholds are set by dynamic programming on
the number of candidates each choice would cost. A threshold of -1 leaves a partition out; 0 probes its value;
2 meets at values that both sides reach by flipping up to one bit.

Equal fingerprints are one node, so groups of copies cost one row. Rows of a bucket are linked in the task that
holds it; only a spanning forest leaves the task, never all pairs. Buckets of more than ``CHUNK`` rows, known
by the keys of a share of all nodes, are dealt in chunks, and each pair of chunks is a task's work of its own: no task holds
a bucket that grows with the corpus, and no pair is left out.

Groups by the similarity of shingle sets (``similar_groups``) don't probe bits, which meet ever more unlike texts as a
corpus grows, but prefixes of the sets, and look at the fingerprints where these meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastack.llm.components import connected_components, local_components
from terrastack.llm.staging import fits, looked_up, staged
from terrastack.llm.textkit import buffer

SEED = 42
#: Rows of a bucket beyond which it is dealt, and the share of nodes (one in so many) by which buckets are measured.
CHUNK, MEASURED = 1024, 8
#: Rows of a task that links buckets.
TASK_ROWS = 1_000_000
#: Texts by which common shingles are known, how many of them hold one, and how many are listed at most.
SAMPLED, OFTEN, LISTED = 10_000, 4, 1 << 18


def shingles_of(text: bytes, shingle: int) -> list[bytes]:
    """Shingles of a lower-cased text in order, repeats included; none without words."""
    tokens = text.lower().split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle, len(tokens))
    spans = zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist())
    return [joined[a:b] for a, b in spans]


def fingerprint(text: bytes, shingle: int, count: int) -> list[int]:
    """``count`` 64-bit fingerprints of a text: the first is of XXH64 (seed 42), the next of seeds 43 and up."""
    shingles = shingles_of(text, shingle)
    return [majority(hashed(shingles, seed)) for seed in range(SEED, SEED + count)] if shingles else [0] * count


def hashed(shingles: list[bytes], seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in shingles], dtype="<u8")


def majority(h: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        part = h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, count: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, f0, f1, ...)``: signed 64-bit longs holding the bits. Null and blank texts have fingerprint zero."""
    names = [f"f{i}" for i in range(count)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffer(batch.column(1))
            raw, values = data.tobytes(), np.zeros((batch.num_rows, count), np.uint64)
            for i in range(batch.num_rows):
                values[i] = fingerprint(raw[off[i] : off[i + 1]], shingle, count)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values[:, j].astype(np.int64)) for j in range(count))], names=[id_col, *names])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(of, f"{id_col} long, " + ", ".join(f"{n} long" for n in names))


# ---------------------------------------------------------------- partitions and thresholds


def co_occurrence(prints: DataFrame, name: str = "f0") -> tuple[int, np.ndarray]:
    """Number of rows and how often each two bits are both set, over all rows of a fingerprint; 64 sums per task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total, n = total + bits.T @ bits, n + len(f)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(64)), pa.array([float(n)] * 64), pa.array(list(total))], names=["bit", "n", "together"])

    parts = prints.select(name).mapInArrow(of, "bit long, n double, together array<double>")
    rows = parts.groupBy("bit").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("together")[j]) for j in range(64))).alias("together")).collect()
    together = np.zeros((64, 64))
    for r in rows:
        together[r["bit"]] = r["together"]
    return (int(rows[0]["n"]) if rows else 0), together


def group_bits(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """Deal the 64 bits into m partitions of nearly equal width, each time adding the bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    cor = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(cor, 0)
    left, parts = set(range(64)), []
    for i in range(m):
        width = (64 - sum(map(len, parts))) // (m - i)
        first = max(sorted(left), key=lambda b: cor[b, sorted(left)].sum())
        part = [first]
        left.discard(first)
        while len(part) < width:
            part.append(max(sorted(left), key=lambda b: cor[b, part].sum()))
            left.discard(part[-1])
        parts.append(sorted(part))
    return parts


def agreement(n: int, together: np.ndarray, part: list[int]) -> float:
    """Estimated probability that two rows agree in all bits of ``part``.

    Counted over all rows for every two bits; a whole part follows along the tree of its strongest dependencies (each
    bit given the one before it that tells most about it), so bits that go together aren't taken for independent.
    """
    p11 = together / max(n, 1)
    p = np.diag(p11)
    p10 = p[:, None] - p11
    p01 = p[None, :] - p11
    both = p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2  # two rows agree in bits i and j
    one = np.diag(both)
    out = float(one[part[0]])
    for i, b in enumerate(part[1:], 1):
        out *= float(min(1.0, (both[b, part[:i]] / one[part[:i]]).max()))
    return out


def thresholds(tau: int, agree: list[float], widths: list[int], n: int) -> list[int]:
    """Thresholds in -1, 0 and 2 that sum to tau - m + 1 or more, at the least estimated candidates and rows."""
    m, need = len(agree), tau - len(agree) + 1

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        reach = 1 if t == 0 else 1 + widths[i]
        return reach * reach * agree[i] * n * n / 2 + 50.0 * reach * n  # pairs to compare, and rows to move

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (c, chosen) in best.items():
            for t in (-1, 0, 2):
                new = (c + cost(i, t), [*chosen, t])
                if total + t not in step or new < step[total + t]:
                    step[total + t] = new
        best = step
    options = [v for total, v in best.items() if total >= need]
    return min(options)[1] if options else []


def plan(tau: int, n: int, together: np.ndarray) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, over all numbers of partitions that can reach tau."""
    best = None
    for m in range(1, 13):
        parts = group_bits(n, together, m)
        agree = [max(agreement(n, together, p), 2.0 ** -len(p)) for p in parts]
        chosen = thresholds(tau, agree, [len(p) for p in parts], max(n, 2))
        if not chosen:
            continue
        total = sum((1 if t == 0 else (1 + len(p)) ** 2) * a * n * n / 2 + 50.0 * (1 if t == 0 else 1 + len(p)) * n for p, a, t in zip(parts, agree, chosen) if t >= 0)
        if best is None or total < best[0]:
            best = (total, [(p, t) for p, t in zip(parts, chosen) if t >= 0])
    assert best, "some number of partitions reaches any tau below 24"
    return best[1]


# ---------------------------------------------------------------- probing


def keys_of(f: np.ndarray, parts: list[tuple[list[int], int]], first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of fingerprints: for each partition its value, and with one bit flipped where the threshold is 2."""
    keys, index = [], []
    for number, (bits, t) in enumerate(parts, first):
        value = np.zeros(len(f), np.uint64)
        for place, b in enumerate(bits):
            value |= ((f >> np.uint64(b)) & np.uint64(1)) << np.uint64(place)
        flips = [np.uint64(0)] + ([np.uint64(1 << place) for place in range(len(bits))] if t == 2 else [])
        for flip in flips:
            keys.append(mix_key(value ^ flip, number))
            index.append(np.arange(len(f)))
    return np.concatenate(keys), np.concatenate(index)


def mix_key(value: np.ndarray, number: int) -> np.ndarray:
    """Partition number in the top bits; values have fewer than 59 bits unless there is one partition only."""
    return value ^ (np.uint64(number) << np.uint64(59))


def apart(f: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Differing bits of each word (rows x words)."""
    return np.bitwise_count(f ^ x)


def forest(f: np.ndarray, tau: int, most: int | None = None, word: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (from, to as indices) of the links among the fingerprints (rows x words) of one bucket.

    A link is within ``tau`` in ``word`` and within ``most`` over all words. Breadth first; what has been reached is
    compared no more, so a tight group of g costs about g comparisons.
    """
    todo = np.arange(len(f))
    a, b = [], []
    while len(todo):
        frontier, todo = todo[:1], todo[1:]
        while len(frontier) and len(todo):
            fresh = []
            for x in frontier:
                if not len(todo):
                    break
                near = np.bitwise_count(f[todo, word] ^ f[x, word]) <= tau
                if most is not None and near.any():
                    near &= apart(f[todo], f[x]).sum(axis=1, dtype=np.int64) <= most
                if near.any():
                    hit = todo[near]
                    a.append(np.full(len(hit), x))
                    b.append(hit)
                    fresh.append(hit)
                    todo = todo[~near]
            frontier = np.concatenate(fresh) if fresh else todo[:0]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def dense(f: np.ndarray, tau: int, most: int | None = None, word: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The links of a bucket as stars of its components: all pairs as matrices, some rows at a time."""
    us, vs = [], []
    for at in range(0, len(f), 256):
        x, y = f[at : at + 256], f[at:]
        u, v = np.nonzero(np.triu(np.bitwise_count(x[:, word][:, None] ^ y[:, word]) <= tau, 1))
        if most is not None and len(u):
            ok = apart(x[u], y[v]).sum(axis=1, dtype=np.int64) <= most
            u, v = u[ok], v[ok]
        if len(u) > len(f):  # of many links a tree is enough
            root = local_components(len(y), u, v)
            v = np.flatnonzero(root != np.arange(len(y)))
            u = root[v]
        us.append(u + at)
        vs.append(v + at)
    u, v = np.concatenate(us), np.concatenate(vs)
    if not len(u):
        return u, v
    root = local_components(len(f), u, v)
    member = np.flatnonzero(root != np.arange(len(f)))
    return root[member], member


def fingerprint_groups(nodes: DataFrame, tau: int, count: int = 1, most: int | None = None, probed: int | None = None) -> DataFrame:
    """``(node, component)`` for every row of ``nodes(node, f0, ..)``, fingerprints distinct.

    A link is within ``tau`` bits in one of the first ``probed`` of ``count`` fingerprints (all by default) and, with
    ``most``, within so many bits of all together. One fingerprint is probed after the other, between the groups that
    the ones before have found: a tight group is joined once, not by the buckets of each.
    """
    names = [f"f{i}" for i in range(count)]
    known = nodes.select("node", F.col("node").alias("component"), *names)
    for word in range(probed or count):
        parents = connected_components(linked_by(known, word, tau, count, most))
        moves = staged(parents.select(F.col("node").alias("component"), F.col("component").alias("root")), "moves")
        known = staged(looked_up(known, moves, ["component"], names).select("node", F.coalesce("root", "component").alias("component"), *names), "groups")
    return known.select("node", "component")


def linked_by(nodes: DataFrame, word: int, tau: int, count: int, most: int | None) -> DataFrame:
    """Edges ``(a, b)`` that connect all components of ``nodes(node, component, f0, ..)`` with a link in one fingerprint."""
    names = [f"f{i}" for i in range(count)]
    n, together = co_occurrence(nodes, names[word])
    parts = plan(tau, n, together)
    probes = n * sum(1 if t == 0 else 1 + len(bits) for bits, t in parts)
    tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-probes // TASK_ROWS))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                cols = [part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(part.num_columns)]
                keys, index = keys_of(cols[1 + word].view(np.uint64), parts)
                none = np.full(len(keys), -1, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(cols[0][index]), pa.array(none), *(pa.array(c[index]) for c in cols[1:])], names=["key", "component", "side", *names])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in probe(batches):
            yield batch.select(["key"])

    schema = "key long, component long, side int, " + ", ".join(f"{x} long" for x in names)
    measured = nodes.where(F.pmod(F.xxhash64("node", *names), F.lit(MEASURED)) == 0).select("component", *names).mapInArrow(measure, "key long")
    sizes = measured.groupBy("key").agg((F.count(F.lit(1)) * MEASURED).alias("rows"))
    return bucket_links(nodes.select("component", *names).mapInArrow(probe, schema), sizes, tasks, names, word, tau, most)


def bucket_links(rows: DataFrame, sizes: DataFrame, tasks: int, names: list[str], word: int, tau: int, most: int | None) -> DataFrame:
    """Edges ``(a, b)`` that connect all linked components of ``rows(key, component, side, f0, ..)`` with an equal key.

    ``sizes(key, rows)`` tells the buckets that are dealt in chunks; ``side`` is -1.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the last bucket
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns)], axis=1)
            if not len(rows):
                continue
            if held and rows[0, 0] != held[0][0, 0]:
                yield from buckets(np.concatenate(held))
                held = []
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if last:
                yield from buckets(np.concatenate([*held, rows[:last]]))
                held = []
            held.append(rows[last:])
        if held:
            yield from buckets(np.concatenate(held))

    def buckets(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.diff(rows[:, 0])) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(rows)]))
        side, f = rows[:, 2], np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
        a, b = [], []
        # small buckets together, all their pairs: rows d apart
        size = ends - starts
        end_of, at = np.repeat(ends, size), np.flatnonzero(np.repeat((size > 1) & (size <= 16), size))
        for d in range(1, 16):
            at = at[at + d < end_of[at]]
            if not len(at):
                break
            near = np.bitwise_count(f[at, word] ^ f[at + d, word]) <= tau
            u = at[near]
            if most is not None and len(u):
                u = u[apart(f[u], f[u + d]).sum(axis=1, dtype=np.int64) <= most]
            a.append(u)
            b.append(u + d)

        def linked(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            u, v = (dense if len(index) <= 4 * CHUNK else forest)(f[index], tau, most, word)
            return index[u], index[v]

        known = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for i in np.flatnonzero(size > 16):
            index = np.arange(starts[i], ends[i])
            u, v = linked(index)
            a.append(u)
            b.append(v)
            if len(u) and side[starts[i]] >= 0:  # of two chunks: each has told what it holds itself in a task of its own
                known += [linked(index[side[index] == x]) for x in np.unique(side[index])]
        if sum(map(len, a)):
            same = np.flatnonzero((rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1]))
            # rows of a bucket are in order of components: the buckets of a group mostly name the same smallest one
            root = local_components(len(rows), np.concatenate([*a, same]), np.concatenate([*b, same + 1]))
            told = local_components(len(rows), *(np.concatenate([*x, y]) for x, y in zip(zip(*known), (same, same + 1))))
            member = np.flatnonzero((rows[root, 1] != rows[:, 1]) & (told == np.arange(len(rows))))
            edges = np.unique(rows[:, 1][np.stack((root[member], member), axis=1)], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    large = sizes.where(F.col("rows") > CHUNK).select("key", F.ceil(F.col("rows") / CHUNK).cast("int").alias("chunks"))
    large = staged(large, "large")
    if large.isEmpty():
        return rows.repartition(tasks, "key").sortWithinPartitions("key", "component").mapInArrow(link, "a long, b long")
    # by the key a bucket would be hot itself: what isn't broadcast is joined in parts
    dealt = looked_up(rows, large, ["key"], names).withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(*names), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pair = F.when(F.col("chunks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    dealt = dealt.select(pair.alias("key"), "component", F.when(F.col("own") == F.col("other"), -1).otherwise(F.col("own")).alias("side"), *names)
    return dealt.repartition(tasks, "key").sortWithinPartitions("key", "component").mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, tau: int = 4, count: int = 1, most: int | None = None, probed: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row.

    Words are maximal runs without ASCII white space, A-Z lower-cased; shingles are ``shingle`` words joined by one
    space (a shorter text is one shingle; one without words, or null, has fingerprint zero and links like any other).
    Fingerprints that differ in at most ``tau`` bits link; ``component_id`` is the smallest id reachable, itself
    included. With ``count`` > 1 the first ``probed`` of that many fingerprints are probed, and a link differs in ``most``
    bits of all together. Repeated rows give repeated results; an empty table an empty one; a null id takes part but is
    never the smallest of a group with other ids. Very long texts are counted whole, in pieces; a bit that is
    set in half of the hashes is 0. Other columns of ``docs`` are ignored.
    """
    names = [f"f{i}" for i in range(count)]
    prints = staged(fingerprints(docs, shingle, count, id_col, text_col), "prints")
    nodes = staged(prints.groupBy(*names).agg(F.min(id_col).alias("node")).where("node is not null"), "nodes")
    groups = fingerprint_groups(nodes, tau, count, most, probed)
    known = staged(nodes.join(groups, "node").select(*names, F.col("component").alias("component_id")), "known")
    return looked_up(prints, known, names, [id_col]).select(id_col, F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- exact similarity of candidates


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (from, to as indices) of the sets (distinct hashes each) of Jaccard ``similarity`` or more.

    Breadth first as ``forest``: what has been reached is compared no more. Two empty sets are equal.
    """
    size = np.array([len(x) for x in sets], np.int64)
    values, place = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True)
    off = np.concatenate(([0], np.cumsum(size)))
    full = np.flatnonzero(size)
    mark, todo = np.zeros(len(values), np.int32), np.arange(len(sets))
    a, b = [], []
    while len(todo):
        frontier, todo = [int(todo[0])], todo[1:]
        while frontier and len(todo):
            x = frontier.pop()
            own = place[off[x] : off[x + 1]]
            both = np.zeros(len(sets), np.int64)
            if len(own):
                mark[own] = 1
                both[full] = np.add.reduceat(mark[place], off[full])
                mark[own] = 0
            near = both[todo] >= similarity * (size[x] + size[todo] - both[todo]) - 1e-9
            hit = todo[near]
            a += [x] * len(hit)
            b += hit.tolist()
            frontier += hit.tolist()
            todo = todo[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def verified(texts: DataFrame, members: DataFrame, shingle: int, similarity: float, chunk: int = 128, most_bytes: int = 16 << 20) -> DataFrame:
    """Edges ``(a, b)`` that connect all pairs of Jaccard ``similarity`` or more inside candidate components.

    ``texts(doc_id, text, same)`` holds the text of each node of ``members(node, same, component, bytes)``. Every pair
    of a component is compared by the whole sets of its shingles. A component of more than ``chunk`` nodes or
    ``most_bytes`` bytes is dealt in chunks, each pair of chunks to a task of its own.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("rows"), F.sum("bytes").alias("bytes"))
    large = sizes.where((F.col("rows") > chunk) | (F.col("bytes") > most_bytes)).select("component", F.greatest(F.ceil(F.col("rows") / chunk), F.ceil(F.col("bytes") / most_bytes)).cast("int").alias("chunks"))
    dealt = looked_up(members, staged(large, "large"), ["component"], ["node"]).withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node", "same"), F.col("chunks")).cast("int"))
    dealt = staged(dealt.select("node", "same", "component", "chunks", "own"), "members")
    named = texts.join(F.broadcast(dealt) if fits(dealt) else dealt, (F.col("doc_id") == F.col("node")) & (texts["same"] == dealt["same"])).select("node", "component", "chunks", "own", "text")
    named = named.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = named.select(F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "text")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []
        for batch in batches:
            data, off = buffer(batch.column(2))
            for i, (k, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if k != key and nodes:
                    yield edges(nodes, sets)
                    nodes, sets = [], []
                key = k
                nodes.append(node)
                sets.append(np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles_of(data[off[i] : off[i + 1]].tobytes(), shingle)], dtype=np.uint64)))
        if nodes:
            yield edges(nodes, sets)

    def edges(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        a, b = similar(sets, similarity)
        own = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long")


def prefix(shingles: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """Of the hashes of a text's shingles the first of the set, so many that it shares one with any set of ``similarity``.

    One order holds for all sets: the hashes in ``common`` (sorted) last, else by value. The first shingle that two
    sets share has all the others that they share, at least ``similarity`` of either set, behind it. Sets without shingles share
    key zero.
    """
    values = np.unique(shingles)
    if not len(values):
        return np.zeros(1, np.uint64)
    often = np.searchsorted(common, values, side="right") > np.searchsorted(common, values)
    most = len(values) - int(np.ceil(similarity * len(values) - 1e-6)) + 1
    return values[np.argsort(often, kind="stable")][:most]


def common_shingles(rows: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that ``OFTEN`` or more of about ``SAMPLED`` texts hold, sorted; the ``LISTED`` most frequent at most.

    They only come last in the order of ``prefix``, which is right whatever they are: the sample costs no pair.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffer(batch.column(0))
            raw = data.tobytes()
            held = [np.unique(hashed(shingles_of(raw[off[i] : off[i + 1]], shingle))) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*held, np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    share = max(1, rows.count() // SAMPLED)
    held = rows.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").mapInArrow(of, "h long")
    often = held.groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(LISTED).collect()
    return np.sort(np.array([r["h"] for r in often], np.int64).view(np.uint64))


def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of their first column those whose value occurs twice or more."""
    last, told = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        same = key[1:] == key[:-1]
        keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if last is not None and last.column(0)[0].as_py() == key[0]:
            keep[0] = True
            if not told:
                yield last
        yield batch.filter(pa.array(keep))
        last, told = batch.slice(batch.num_rows - 1), bool(keep[-1])


def prefix_links(nodes: DataFrame, names: list[str], most: int) -> DataFrame:
    """Edges ``(a, b)`` that connect all pairs of ``nodes(node, keys, f0, ..)`` that share a key and differ in ``most`` bits.

    Most keys are one text's own: keys and nodes alone are dealt first, and fingerprints only go where keys meet.
    """
    total = nodes.agg(F.sum(F.size("keys"))).first()[0] or 0
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = nodes.select(F.explode("keys").alias("key"), "node").repartition(max(parts, -(-total // TASK_ROWS)), "key")
    met = staged(rows.sortWithinPartitions("key").mapInArrow(repeated, "key long, node long"), "met")
    tasks = max(parts, -(-met.count() // TASK_ROWS))
    probes = met.join(nodes.select("node", *names), "node").select("key", F.col("node").alias("component"), F.lit(-1).alias("side"), *names)
    return bucket_links(probes, met.groupBy("key").agg(F.count(F.lit(1)).alias("rows")), tasks, names, 0, 64, most)


def similar_groups(docs: DataFrame, shingle: int, similarity: float, count: int, most: int) -> DataFrame:
    """``(doc_id, component_id)`` for every row: groups linked by Jaccard ``similarity`` or more of shingle sets.

    Candidates are distinct texts that share a shingle of their prefixes, as all pairs of ``similarity`` do, and whose
    ``count`` fingerprints differ in ``most`` bits together; each is then compared exactly (``verified``).
    """
    names = [f"f{i}" for i in range(count)]
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(F.coalesce(text, F.lit(""))).alias("same"))
    common = common_shingles(rows, shingle)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffer(batch.column(1))
            raw, values, keys = data.tobytes(), np.zeros((batch.num_rows, count), np.uint64), []
            for i in range(batch.num_rows):
                shingles = shingles_of(raw[off[i] : off[i + 1]], shingle)
                first = hashed(shingles)
                keys.append(prefix(first, common, similarity))
                if shingles:
                    values[i] = [majority(first), *(majority(hashed(shingles, SEED + j)) for j in range(1, count))]
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(off)), lists, *(pa.array(values[:, j].astype(np.int64)) for j in range(count))], names=["doc_id", "same", "bytes", "keys", *names])

    prints = staged(rows.mapInArrow(of, "doc_id long, same string, bytes long, keys array<long>, " + ", ".join(f"{x} long" for x in names)), "prints")
    nodes = prints.groupBy("same").agg(F.min("doc_id").alias("node"), F.max("bytes").alias("bytes"), F.first("keys").alias("keys"), *(F.max(x).alias(x) for x in names))
    nodes = staged(nodes.where("node is not null"), "nodes")
    shared = connected_components(prefix_links(nodes, names, most))
    members = staged(nodes.select("node", "same", "bytes").join(shared, "node"), "shared")
    parents = connected_components(verified(rows, members, shingle, similarity))
    known = staged(nodes.select("node", "same").join(parents, "node", "left").select("same", F.coalesce("component", "node").alias("component_id")), "known")
    return looked_up(prints.select("doc_id", "same"), known, ["same"], ["doc_id"]).select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, count: int = 3) -> DataFrame:
    """``docs`` with one row (the smallest doc_id) of each group of near-duplicates.

    Texts whose shingle sets have ``similarity`` share a shingle of their prefixes; those that do are looked at over the
    bits of three fingerprints of independent hashes: shingle sets of Jaccard similarity j have angle arccos(2j / (1 + j)),
    so the share of differing bits estimates j. A candidate may look less similar than ``similarity`` by three and a half standard
    deviations, so that hardly any pair is lost here; it is a duplicate only if the whole shingle sets have ``similarity`` or more, exactly.
    Groups are closed transitively. Null texts and texts without words are equal. Of rows that repeat a doc_id one
    stays; rows with a null doc_id all stay. Very long texts are compared whole; an empty table stays empty; all
    columns of ``docs`` are kept as they are.
    """
    bits = 64 * count
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    most = int(bits * share + 3.5 * np.sqrt(bits * share * (1 - share)))
    found = staged(similar_groups(docs, shingle, similarity, count, most), "groups")
    gone = staged(found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct(), "gone")
    twice = staged(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    left = docs.join(F.broadcast(gone) if fits(gone) else gone, "doc_id", "left_anti")
    if not twice.isEmpty():
        left = left.join(twice, "doc_id", "left_anti").unionByName(left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return left.select(*docs.columns)
