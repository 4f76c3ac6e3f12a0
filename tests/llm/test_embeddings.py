"""Embedding near-duplicates against brute force: recall at the threshold, and no wrong link."""

import numpy as np
import pytest

from terrastack.llm import itq


def brute(x, label, least=0.93):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= least) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    return near


def frame(spark, ids, x, label):
    return spark.createDataFrame([(int(i), [float(v) for v in r], int(c)) for i, r, c in zip(ids, x, label)], "vec_id long, embedding array<float>, label int")


def test_recall_close_to_the_threshold(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 64))
    parts = [base]
    for noise in (0.1, 0.2, 0.3, 0.38):
        parts.append(base + noise * rng.normal(size=base.shape))
    x = np.concatenate(parts).astype(np.float32)
    label = np.tile(np.arange(150) % 3, 5)
    near = brute(x.astype(float), label)
    got = {r.vec_id: r for r in itq.near_vectors(frame(spark, range(len(x)), x, label)).collect()}
    found, want = sum(r.n_links for r in got.values()), int(near.sum())
    assert all(got[i].n_links <= near[i].sum() for i in got) and found >= 0.93 * want


@pytest.mark.parametrize("d, offset", [(16, 0.0), (32, 0.0), (64, 0.0), (64, 0.5), (200, 0.0)])
def test_recall_by_dimension(spark, d, offset):
    """Pairs close to the threshold, also where all vectors have much in common."""
    rng = np.random.default_rng(d)
    base = rng.normal(size=(700, d)) + offset
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    away = rng.normal(size=base.shape)
    away -= (away * base).sum(axis=1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    cosine = rng.uniform(0.9301, 0.95, (700, 1))
    x = np.concatenate((base, cosine * base + np.sqrt(1 - cosine**2) * away)).astype(np.float32)
    label = np.tile(np.arange(700) % 2, 2)
    near = brute(x.astype(float), label)
    got = {r.vec_id: r.n_links for r in itq.near_vectors(frame(spark, range(len(x)), x, label)).collect()}
    assert all(got[i] <= near[i].sum() for i in got) and sum(got.values()) >= 0.9 * near.sum() > 0


def test_candidates_stay_few_as_rows_grow():
    """A hundred times the rows: pieces get wider, and a vector meets hardly more others."""
    rng = np.random.default_rng(1)
    met, recall = [], []
    for n in (4_000, 400_000):
        x = rng.normal(size=(n, 64)).astype(np.float32)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        index = itq.Tables(x[:4096].astype(float), n, 0.93)
        away = rng.normal(size=(2000, 64))
        away -= (away * x[:2000]).sum(axis=1, keepdims=True) * x[:2000]
        y = 0.93 * x[:2000] + np.sqrt(1 - 0.93**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
        recall.append((index.pieces(x[:2000]) == index.pieces(y)).any(axis=1).mean())
        codes = np.concatenate([index.pieces(x[a : a + 20_000]).astype(np.int32) for a in range(0, n, 20_000)])
        met.append(sum((np.bincount(codes[:, t], minlength=1).astype(float) ** 2).sum() for t in range(index.tables)) / n)
    assert min(recall) > 0.93 and met[1] < 4 * met[0], (met, recall)


def test_hot_group_in_chunks(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(size=64) + 0.05 * rng.normal(size=(300, 64)), rng.normal(size=(100, 64)))).astype(np.float32)
    x[10] = x[11]
    label = np.ones(len(x), int)
    near = brute(x.astype(float), label)
    got = {r.vec_id: r for r in itq.near_vectors(frame(spark, range(len(x)), x, label), chunk=64).collect()}
    assert [got[i].n_links for i in range(len(x))] == near.sum(axis=1).tolist()
    assert all(got[i].component_id == 0 and got[i].kept == (i == 0) for i in range(300))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [], 1), (9, [1.0, None], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (12, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.near_vectors(df).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (12, 3, 1, False), (12, 3, 1, False), *alone])
    assert itq.near_vectors(df.limit(0)).count() == 0
