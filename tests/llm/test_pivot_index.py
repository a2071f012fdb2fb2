"""The index of embeddings against brute force, and odd vectors."""

import numpy as np
import pyarrow as pa
import pytest

from lithomesh.llm import pivot_index


def brute(x):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    return near


def clustered(rng, groups, size, noise, dim=32):
    centres = rng.normal(size=(groups, dim))
    return np.concatenate([c + noise * rng.normal(size=(size, dim)) for c in centres]).astype(np.float32)


@pytest.mark.parametrize("block", [64, 2048])
def test_recall_and_precision(spark, monkeypatch, block):
    monkeypatch.setattr(pivot_index, "BLOCK", block)
    rng = np.random.default_rng(4)
    x = np.concatenate([clustered(rng, 40, 12, 0.18), clustered(rng, 1, 200, 0.15), rng.normal(size=(500, 32)).astype(np.float32)])
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, vec int")
    found = pivot_index.near_vectors(frame).toPandas().sort_values("vec_id")
    near = brute(x.astype(float))
    assert (found["n_links"].to_numpy() <= near.sum(1)).all()
    assert found["n_links"].sum() >= 0.9 * near.sum()
    assert ((found["component_id"] == found["vec_id"]) == found["kept"]).all()


@pytest.mark.parametrize("noise", [0.05, 0.18, 0.33])
def test_recall_in_a_hot_group_with_many_pivots(spark, monkeypatch, noise):
    monkeypatch.setattr(pivot_index, "LEAST_PIVOTS", 512)
    rng = np.random.default_rng(5)
    n = 6000
    x = np.concatenate([clustered(rng, 1, n // 3, noise), rng.normal(size=(n - n // 3, 32)).astype(np.float32)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = pivot_index.near_vectors(rows).toPandas().sort_values("vec_id")
    near = brute(x.astype(float)).sum(1)
    assert (found["n_links"].to_numpy() <= near).all()
    assert found["n_links"].sum() >= 0.99 * near.sum()


def test_pivots_are_ordered_and_far_apart():
    rng = np.random.default_rng(6)
    x = pivot_index._unit(np.concatenate([clustered(rng, 1, 500, 0.18), rng.normal(size=(500, 32))]).astype(float))
    pivots = pivot_index._far_apart(x[rng.permutation(1000)], 256, 0.9)
    assert len(pivots) == 256 and (pivots @ pivots.T - np.eye(256)).max() < 0.8
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist())], names=["vec"])
    (out,) = pivot_index._describe({32: (7, pivots)})([batch])
    first = np.array(out.column("pivots").to_pylist())
    assert (first - 7 == np.argsort(-(x @ pivots.T), axis=1)[:, : pivot_index.PREFIX]).all()


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 0.0]), (6, None), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, []), (None, [1.0, 0.0]), (11, [1e-30, 1e-31]), (12, [1.0])]
    found = pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    got = {}
    for r in found:
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(4, 1, True)] and got[2] == [(4, 1, False)] * 2 and got[3] == [(4, 1, False)] and got[11] == [(4, 1, False)]
    for i in (4, 5, 6, 7, 8, 9, 10, 12, None):  # 12 is of another length
        assert got[i] == [(0, i, True)]
    assert pivot_index.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("few", [8, 512])
def test_lengths_are_indexed_apart(spark, monkeypatch, few):
    monkeypatch.setattr(pivot_index, "FEW", few)
    rng = np.random.default_rng(8)
    groups = [clustered(rng, 6, 15, 0.15, dim) for dim in (2, 3, 16, 17)] + [rng.normal(size=(n, 40 + n)).astype(np.float32) for n in (1, 1, 2)]
    rows = [(i, v.tolist()) for i, v in enumerate(v for g in groups for v in g)]
    found = pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas().sort_values("vec_id")
    near = np.concatenate([brute(g.astype(float)).sum(1) for g in groups])
    assert (found["n_links"].to_numpy() <= near).all()
    assert found["n_links"].sum() >= (0.95 if few == 8 else 1) * near.sum()


def test_registered_query(spark, tmp_path):
    """Few enough vectors that the index compares all: the query equals brute force."""
    rng = np.random.default_rng(9)
    x = np.concatenate([clustered(rng, 20, 10, 0.2, 64), rng.normal(size=(100, 64)).astype(np.float32)])
    near = brute(x.astype(float))
    label = np.arange(len(x))
    while (low := np.where(near, label[None], len(x)).min(1).clip(max=label)).tolist() != label.tolist():
        label = low
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = pivot_index.op9_pivot_index(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(i, int(near[i].sum()), int(label[i]), label[i] == i) for i in range(len(x))]


@pytest.mark.parametrize("count", [512, 1024, 2048])
def test_recall_of_pairs_at_the_threshold(count):
    """Retrieval alone: pairs of vectors at a cosine of 0.9, with no group around them."""
    rng = np.random.default_rng(31)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for dim in (16, 64):
        pivots = pivot_index._far_apart(unit(rng.normal(size=(pivot_index.SAMPLE * count, dim))), count, 0.9)
        x = unit(rng.normal(size=(2000, dim)))
        away = rng.normal(size=x.shape)
        away = unit(away - (away * x).sum(1, keepdims=True) * x)
        near = [np.argsort(-(v @ pivots.T), axis=1)[:, : pivot_index.PREFIX] for v in (x, 0.9 * x + np.sqrt(1 - 0.81) * away)]
        home = [(a[:, :1] == b).any(1) for a, b in (near, near[::-1])]
        shared = (near[0][:, :, None] == near[1][:, None]).sum((1, 2))
        found = (home[0] | home[1]) & (shared >= pivot_index.SHARED)
        assert found.mean() >= 0.95, (dim, found.mean())
