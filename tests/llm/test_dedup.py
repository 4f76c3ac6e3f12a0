"""Near-duplicate groups and repeated strings against brute force."""

import hashlib
import re

import numpy as np
import xxhash

from terrastack.llm import simhash, suffix_dedup
from terrastack.llm.components import connected_components


def brute_fingerprint(text, k=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(n, links):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_simhash_is_exact(docs, texts):
    prints = [brute_fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    label = brute_components(len(prints), links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{p:016x}", label[i]) for i, p in enumerate(prints)}
    assert sum(label[i] != i for i in range(len(label))) >= 8


def test_simhash_with_buckets_in_chunks(docs, texts, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    monkeypatch.setattr(simhash, "MEASURED", 1)
    prints = [brute_fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 9]
    for most in (1 << 24, -1):
        from terrastack.llm import staging

        monkeypatch.setattr(staging, "BROADCAST_BYTES", most)
        got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, tau=9).collect()}
        assert got == dict(enumerate(brute_components(len(prints), links)))


def test_agreement_counts_correlation():
    rng = np.random.default_rng(3)
    bits = rng.random((4000, 64)) < 0.5
    bits[:, 1:12] = bits[:, :1] ^ (rng.random((4000, 11)) < 0.05)
    together = bits.T.astype(float) @ bits
    for part in (list(range(12)), list(range(20, 28))):
        values = bits[:, part] @ (1 << np.arange(len(part)))
        true = ((np.unique(values, return_counts=True)[1] / 4000) ** 2).sum()
        assert 0.5 < simhash.agreement(4000, together, part) / true < 2


def test_simhash_edges(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (None, "other words stand here now"), (2, None)], "doc_id long, text string")
    got = sorted(map(str, [(r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()]))
    assert got == sorted(map(str, [(4, 4), (4, 4), (None, 4), (None, None), (2, 2)]))


def test_any_tau_is_lossless():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    near = base.copy()
    for _ in range(9):
        near ^= np.uint64(1) << rng.integers(0, 64, 50, dtype=np.uint64)
    f = np.concatenate((base, near))
    bits = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    for tau in (0, 1, 4, 9, 12):
        parts = simhash.plan(tau, len(f), bits.T @ bits)
        keys, index = simhash.keys_of(f, parts)
        meet = {}
        for k, i in zip(keys.tolist(), index.tolist()):
            meet.setdefault(k, set()).add(i)
        pairs = {(a, b) for g in meet.values() for a in g for b in g if a < b}
        for a in range(len(f)):
            for b in range(a + 1, len(f)):
                if int(f[a] ^ f[b]).bit_count() <= tau:
                    assert (a, b) in pairs


def test_forest_spans_the_links():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 20, 300, dtype=np.uint64)
    links = [(a, b) for a in range(300) for b in range(a) if int(f[a] ^ f[b]).bit_count() <= 3]
    u, v = simhash.forest(f[:, None], 3)
    assert brute_components(300, links) == brute_components(300, list(zip(u.tolist(), v.tolist())))
    u, v = simhash.dense(f[:, None], 3)
    assert brute_components(300, links) == brute_components(300, list(zip(u.tolist(), v.tolist()))) and len(u) < 300


def test_keep_one_of_each(spark, docs, texts, empty):
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    near = [i for i, t in enumerate(texts) if t and "changed" in t]
    assert len(ids & set(near)) == 1 and {69, 68} & ids == set() and set(range(60)) <= ids
    assert simhash.keep_one_of_each(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "x"), (None, "x")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in simhash.keep_one_of_each(twice).collect()) == ["1", "None", "None"]


def shingle_sets(texts, k=5):
    out = []
    for t in texts:
        words = t.lower().split()
        out.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))})
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(rng, words, share):
    """Words of a text with some replaced, so that its shingle set has about that similarity to the original's."""
    w = list(words)
    for i in rng.permutation(len(w) // 6 - 2)[: round(len(w) * (1 - share) / (1 + share) / 5)]:
        w[6 * i + 6] = f"new{rng.integers(1 << 40)}"
    return w


def test_near_dedup_keeps_what_is_less_similar(spark):
    """Pairs of similarity 0.7 to 0.78 look like 0.8 to the fingerprints now and then; none may lose a document."""
    rng = np.random.default_rng(6)
    texts = []
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 300)]
        texts += [" ".join(words), " ".join(edited(rng, words, 0.7 + 0.08 * i / 150))]
    sets = shingle_sets(texts)
    assert all(0.66 < jaccard(sets[i], sets[i + 1]) < 0.8 for i in range(0, 300, 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one_of_each(docs).count() == 300


def test_near_dedup_finds_pairs_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    texts = []
    for _ in range(300):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 274)]
        texts += [" ".join(words), " ".join(edited(rng, words, 0.8))]
    sets = shingle_sets(texts)
    near = [i for i in range(0, 600, 2) if jaccard(sets[i], sets[i + 1]) == 0.8]
    assert len(near) == 300
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one_of_each(docs).count() == 300


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(12)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n - int(rng.integers(0, n // 5 + 1))], rng.integers(0, 1 << 63, n // 6).astype(np.uint64)])
        common = np.sort(rng.choice(a, int(rng.integers(0, n + 1)), replace=False))
        p, q = simhash.prefix(np.concatenate([a, a]), common, 0.8), simhash.prefix(b, common, 0.8)
        assert len(p) <= 0.2 * n + 1.001
        assert jaccard(set(a.tolist()), set(b.tolist())) < 0.8 or set(p.tolist()) & set(q.tolist())
    assert simhash.prefix(np.zeros(0, np.uint64), common, 0.8).tolist() == [0]


def test_rows_with_repeated_keys():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for most in (1, 2, 7):
        key = np.sort(rng.integers(0, 60, 80))
        cuts = np.cumsum(rng.integers(0, most + 1, 200))
        batches = [pa.RecordBatch.from_arrays([pa.array(key[a:b]), pa.array(np.arange(a, min(b, 80)))], names=["key", "node"]) for a, b in zip([0, *cuts], [*cuts, 80]) if a <= 80]
        got = [x for batch in simhash.repeated(iter(batches)) for x in batch.column(1).to_pylist()]
        assert got == [i for i, k in enumerate(key) if (key == k).sum() > 1]


def test_unlike_texts_meet_in_no_bucket(spark, monkeypatch):
    """However many texts there are: what is moved and compared doesn't grow with the square of the corpus."""
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 30))) for i in range(2000)], "doc_id long, text string")
    moved, staged = {}, simhash.staged

    def noted(df, name):
        moved.setdefault(name, []).append((out := staged(df, name)).count())
        return out

    monkeypatch.setattr(simhash, "staged", noted)
    monkeypatch.setattr(simhash, "CHUNK", 2)
    assert simhash.keep_one_of_each(docs).count() == 2000
    assert sum(moved["large"]) == 0 and sum(moved["met"]) == 0


def test_common_shingles_and_dealt_buckets(spark, monkeypatch):
    """One line in every text, groups of near copies around it, buckets dealt in chunks: as brute force."""
    rng = np.random.default_rng(4)
    line = [f"line{i}" for i in range(12)]
    texts = []
    for g in range(12):
        base = [f"w{x}" for x in rng.integers(0, 1 << 40, 120)]
        texts += [" ".join([*edited(rng, base, s), *line]) for s in [1, *rng.uniform(0.86, 1, 30 if g == 3 else 3)]]
    texts += [" ".join(line), " ".join(line[:9]), " ".join(line + line), "", " ", "x", "x ", "X"]
    sets = shingle_sets(texts)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    want = brute_components(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    common = simhash.common_shingles(docs, 5)
    assert 0 < len(common) and len(simhash.prefix(simhash.hashed(simhash.shingles_of(" ".join(line).encode(), 5)), common, 0.8))
    for chunk in (5, 1024):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs, 5, 0.8, 3, 46).collect()}
        assert [got[i] for i in range(len(texts))] == [want[i] for i in range(len(texts))]


def test_shuffles_go_when_their_table_is_written(spark):
    from time import sleep

    from terrastack.llm.staging import staged

    files = lambda: {f.getName() for f in (x for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())) if f.getName().startswith("shuffle_")}
    before = files()
    out = staged(spark.range(1000).repartition(3, "id"), "freed")
    sleep(1)  # they are removed in the background, but long before the driver collects its garbage
    assert not files() - before and out.count() == 1000


def test_exact_check_in_chunks(spark):
    """Every pair of a component is compared, also across chunks, by shingle sets without repeats."""
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 200)]
    texts = [" ".join(edited(rng, base, s)) for s in rng.uniform(0.75, 1, 60)] + ["", " ", "a b", "A  b", " ".join(base * 3)]
    sets = shingle_sets(texts)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    rows = spark.createDataFrame([(i, t, str(i)) for i, t in enumerate(texts)], "doc_id long, text string, same string")
    members = spark.createDataFrame([(i, str(i), 0, len(t)) for i, t in enumerate(texts)], "node long, same string, component long, bytes long")
    for chunk in (7, 100):
        got = [tuple(r) for r in simhash.verified(rows, members, 5, 0.8, chunk).collect()]
        assert brute_components(len(texts), got) == brute_components(len(texts), links)
        assert all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in got)


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 640)] + [(700, 700)]
    label = brute_components(701, pairs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    touched = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {i: label[i] for i in touched}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(rows, length):
    seen, out = set(), {}
    for doc, text in rows:
        b = (text or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                mark[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mark) if not m)
        runs = sum(1 for i in range(len(mark)) if mark[i] and not (i and mark[i - 1]))
        out[doc] = (len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest())
    return out


def told(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()}


def test_repeats_are_exact(docs, texts):
    want = brute_removed(list(enumerate(texts)), 100)
    assert told(suffix_dedup.remove_repeats(docs)) == want
    assert sum(v[1] > 0 for v in want.values()) > 8


def test_repeats_with_small_blocks_and_folds(docs, texts, monkeypatch):
    """Stretches of long documents overlap, and what tasks fold apart meets again."""
    monkeypatch.setattr(suffix_dedup, "FOLD", 50)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 11)
    for length in (40, 101):
        assert told(suffix_dedup.remove_repeats(docs, length)) == brute_removed(list(enumerate(texts)), length)


def test_repeats_in_rounds_many_buckets_and_by_join(docs, texts, monkeypatch):
    want = brute_removed(list(enumerate(texts)), 100)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1 << 10)
    monkeypatch.setattr(suffix_dedup, "MOST_PARTS", 3)
    assert told(suffix_dedup.remove_repeats(docs)) == want
    monkeypatch.setattr(suffix_dedup, "FILTER_BLOCKS", -1)
    assert told(suffix_dedup.remove_repeats(docs)) == want


def test_many_texts_around_one_line(spark):
    """Blocks of one class, all different: no short hash may take two for equal."""
    rng = np.random.default_rng(3)
    letters = rng.integers(97, 123, (300_000, 50), np.uint8)
    line = "".join(chr(97 + i * i % 25) for i in range(60)).encode()
    rows = [(i, (x[:25].tobytes() + line + x[25:].tobytes()).decode()) for i, x in enumerate(letters)]
    rows[77] = (77, rows[5][1][:104] + "!" * 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {k: v for k, v in brute_removed(rows, 100).items() if v[1]}
    assert told(suffix_dedup.remove_repeats(df).where("n_removed > 0")) == want and 77 in want


def test_a_long_text_with_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    text = "".join(map(chr, rng.integers(97, 123, 1_500_000)))
    text += text[700_000:700_400] + "".join(map(chr, rng.integers(97, 123, 1_500_000))) + text[3:150]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 14)
    rows = [(1, text), (2, "x" + text[1_000_000:1_000_300])]
    assert told(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_removed(rows, 100)


def test_repeats_edges(spark, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    long = "q" * 50 + "".join(chr(97 + i % 26) + str(i) for i in range(80))
    df = spark.createDataFrame([(5, long), (5, long), (None, long), (3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.remove_repeats(df).collect())
    assert got == [("3", 0), ("5", 0), ("5", 0), ("None", 0)]
