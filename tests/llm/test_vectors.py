import numpy as np
import pandas as pd
import pytest

from lacuna.llm import crosspolytope, rp_forest


def _table(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = frame.orderBy("vec_id").collect()
    return frame, np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def _close(spark, groups=12, size=30):
    """Groups of vectors whose cosines lie around 0.95."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((groups, 24)), size, axis=0) + 0.22 * rng.standard_normal((groups * size, 24))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), x.astype(np.float32).astype(float)


def test_links_of_dense_groups(spark):
    frame, x = _close(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    rows = rp_forest.linked(frame, leaf=64).toPandas().sort_values("vec_id")
    got = rows.n_links.to_numpy()
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() and want.sum() > 500
    assert (rows.kept == (rows.component_id == rows.vec_id)).all()


def test_trees_below_a_sample(spark):
    frame, x = _close(spark)
    got = {r.vec_id: r.n_links for r in rp_forest.linked(frame, leaf=64, sample=100).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert sum(got.values()) >= 0.97 * ((u @ u.T >= 0.95).sum() - len(x))


def test_links_of_one_large_dense_group(spark):
    n = 20_000
    rng = np.random.default_rng(6)
    c = rng.standard_normal(64)
    x = (c / np.linalg.norm(c) + 0.195 / 8 * rng.standard_normal((n, 64))).astype(np.float32)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = np.concatenate([(u[at : at + 2000] @ u.T >= 0.95).sum(1) - 1 for at in range(0, n, 2000)])
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    rows = rp_forest.linked(frame).toPandas().sort_values("vec_id")
    got = rows.n_links.to_numpy()
    assert want.mean() > 0.5 * n and (got <= want).all() and got.sum() >= 0.99 * want.sum()
    assert rows.component_id.nunique() == 1 and rows.kept.sum() == 1


def test_dense_group_among_others(spark):
    """Split trees, leaves in blocks, copies: no link is counted twice."""
    rng = np.random.default_rng(7)
    c = rng.standard_normal(32)
    x = np.concatenate([c + 0.15 * rng.standard_normal((700, 32)), rng.standard_normal((1500, 32))]).astype(np.float32)
    x = np.concatenate([x, x[:50]])
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = rp_forest.linked(frame, leaf=64, block=100).toPandas().sort_values("vec_id").n_links.to_numpy()
    assert (got <= want).all() and got.sum() >= 0.999 * want.sum() and want.sum() > 300_000


def _grouped(n, share, seed):
    """Random unit vectors, ``share`` of them around one centre with cosines near 0.96."""
    rng = np.random.default_rng(seed)
    g = int(n * share)
    c = rng.standard_normal(64)
    x = np.concatenate([c / np.linalg.norm(c) + 0.195 / 8 * rng.standard_normal((g, 64)), rng.standard_normal((n - g, 64))])
    return x / np.linalg.norm(x, axis=1, keepdims=True), g


@pytest.mark.parametrize("share", [0.2, 0.3, 0.34, 0.4, 0.5])
def test_a_dense_group_does_not_stop_the_trees(share):
    """A group that holds up to half of all vectors ends in leaves of its own; the others go on being split."""
    n = 20_000
    for seed in range(3):
        x, g = _grouped(n, share, seed)
        forest = rp_forest.forest_of(x, 8, 1024, float(np.sqrt(0.1)))
        trees = [(t, b) for t, b in enumerate(forest) if b is not None]
        assert len(trees) == 8
        for t, b in trees:
            sizes = [len(rows) for _, rows in rp_forest.route(x, t, b)]
            assert max(sizes) <= 1.05 * g + 1024
            # Pairs compared beside those of the group itself.
            assert sum(k * k for k in sizes) - max(sizes) ** 2 <= 0.12 * n * n


def test_links_where_a_group_holds_two_fifths(spark):
    x, _ = _grouped(6000, 0.4, 5)
    x = x.astype(np.float32)
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(6000), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = rp_forest.linked(frame, leaf=256, block=500).toPandas().sort_values("vec_id").n_links.to_numpy()
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() and want.sum() > 1_000_000


def test_trees_that_cannot_split_are_replaced():
    x, _ = _grouped(3000, 1.0, 1)
    assert rp_forest.forest_of(x, 8, 256, float(np.sqrt(0.1))) == [{}]
    assert rp_forest.forest_of(x[:100], 8, 256, float(np.sqrt(0.1))) == [{}]


def test_forest_on_odd_vectors(spark, vectors):
    rows = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in rp_forest.linked(vectors).collect()]
    assert len(rows) == vectors.count()
    by = {r[0]: r for r in rows}
    assert by[0] == (0, 3, 0, True) and by[1] == (1, 3, 0, False) and by[2] == (2, 3, 0, False) and by[3] == (3, 3, 0, False)
    assert by[4] == (4, 2, 4, True) and rows.count((20, 2, 4, False)) == 2
    assert all(by[k] == (k, 0, k, True) for k in (5, 6, 7, 8, 9, 21, None))
    assert by[22] == (22, 1, 22, True) and by[40] == (40, 1, 22, False)
    assert rp_forest.linked(vectors.limit(0)).count() == 0


def test_recall_of_search(spark, sf):
    frame, ids, x = _table(spark, sf)
    rows = crosspolytope.search(frame).toPandas()
    query = ids % 20 == 0
    s = x[query] @ x.T
    s[np.arange(query.sum()), np.flatnonzero(query)] = -np.inf
    want = {(q, ids[k]) for q, row in zip(ids[query], np.argsort(-s, axis=1, kind="stable")[:, :20], strict=True) for k in row}
    got = set(zip(rows.query_id, rows.vec_id, strict=True))
    assert len(rows) == 20 * query.sum() and len(got & want) >= 0.9 * len(want)
    place = {v: i for i, v in enumerate(ids)}
    assert np.allclose(rows.score, [(x[place[q]] * x[place[v]]).sum() for q, v in zip(rows.query_id, rows.vec_id, strict=True)], rtol=0, atol=1e-12)
    for _, own in rows.sort_values("rank").groupby("query_id"):
        assert own["rank"].tolist() == list(range(1, 21))
        assert own.sort_values(["score", "vec_id"], ascending=[False, True]).vec_id.tolist() == own.vec_id.tolist()


@pytest.mark.parametrize("lengths", ["unit", "outlier", "sigma 0.3", "sigma 1"])
def test_recall_with_skewed_lengths(spark, lengths):
    n = 20_000
    rng = np.random.default_rng(8)
    x = rng.standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if lengths == "outlier":
        x[11] *= 10
    elif lengths != "unit":
        x *= np.exp(float(lengths.split()[1]) * rng.standard_normal((n, 1)))
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    rows = crosspolytope.search(frame, every=67).toPandas()
    asked = np.arange(0, n, 67)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    got = {q: set(own) for q, own in rows.groupby("query_id").vec_id}
    share = np.array([len(got[q] & set(np.argsort(-row)[:20])) / 20 for q, row in zip(asked, s, strict=True)])
    print(lengths, share.mean(), share.min())
    assert len(rows) == 20 * len(asked) and not rows.duplicated(["query_id", "vec_id"]).any()
    assert share.mean() >= 0.97 and share.min() >= 0.75


def test_large_buckets_are_dealt_out(spark, sf):
    frame, _, _ = _table(spark, sf)
    a = crosspolytope.search(frame, block=20).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    b = crosspolytope.search(frame).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    assert a.equals(b)


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 13))
    r = crosspolytope.rotate(x, 2, 7)
    assert r.shape == (5, 16) and np.allclose(r @ r.T, x @ x.T)


def test_search_on_odd_vectors(vectors):
    rows = [(r.query_id, r["rank"], r.vec_id) for r in crosspolytope.search(vectors, k=3).orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, 2), (0, 2, 1), (0, 3, 3), (20, 1, 4), (20, 2, 3), (20, 3, 0), (40, 1, 22)]
    assert crosspolytope.search(vectors.limit(0)).count() == 0
