import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import gnat as G

SCHEMA = "vec_id long, label int, embedding array<float>"


def _brute(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    """Rows of the contract from (vec_id, label, embedding)."""
    use = set()
    for i, label, e in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            use.add((i, label, tuple(math.floor(scale * float(np.float32(x))) for x in e)))
    out = set()
    for i, label, e in (r for r in use if r[0] % every == 0):
        others = sorted({(-sum(a * b for a, b in zip(e, f, strict=True)), j, m == label) for j, m, f in use if j != i and len(f) == len(e)})
        for s, j, _ in [o for o in others if o[2]][:positives]:
            hard = [o for o in others if not o[2] and low * -s <= 100 * -o[0] <= high * -s][:negatives]
            out |= {(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(hard, 1)}
    return out


def _mined(frame, **options):
    rows = [tuple(r) for r in G.mine(frame, F.col("vec_id") % 100 == 0, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def _clusters(n, dim=24, groups=40, noise=0.35, seed=1):
    rng = np.random.default_rng(seed)
    at = rng.integers(0, groups, n)
    x = rng.standard_normal((groups, dim))[at] + noise * rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.where(rng.random(n) < 0.7, at % 7, rng.integers(0, 7, n))
    return [(i, int(m), v.astype(np.float32).tolist()) for i, (m, v) in enumerate(zip(label, x, strict=True))]


def test_equals_brute_force(spark):
    rows = _clusters(3000)
    got = _mined(spark.createDataFrame(rows, SCHEMA), leaf=40)
    assert got == _brute(rows) and len(got) > 500


def test_blocks_chunks_and_a_small_sample(spark):
    rows = _clusters(1500, seed=2)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert _mined(frame, leaf=60, sample=200, block=25) == _brute(rows)
    index = G.build_index(frame, leaf=60, block=25)
    asks = index.rows.filter("vec_id % 20 = 0").select(
        "dim", F.col("vec_id").alias("qid"), "vec_id", "label", "vec", F.array(F.lit(G.LEAST)).alias("lows"), F.array(F.lit(G.MOST)).alias("highs"))
    a, b = (sorted(map(tuple, G.search(index, asks, 3, same=True, chunk=c).collect())) for c in (4096, 7))
    assert a == b and len(a) == 3 * 75


def test_a_third_of_all_rows_is_one_vector(spark):
    rows = _clusters(900, seed=3)
    rows += [(i, 3, rows[0][2]) for i in range(900, 1350)]
    assert _mined(spark.createDataFrame(rows, SCHEMA).repartition(6), leaf=30, block=64) == _brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.5]), (2, 2, [0.5, 0.5]), (2, 2, [0.5, 0.25]), (3, 1, [0.9, 0.1]), (4, 3, [0.0, 0.0]), (100, 1, [0.0, 0.0]),
        (5, None, [1.0, 1.0]), (6, 1, None), (7, 1, [nan, 1.0]), (8, 2, [inf, 1.0]), (9, 2, [None, 1.0]), (None, 2, [0.5, 0.5]), (200, 4, [1.0]), (201, 4, [2.0]), (202, 5, [1.0]),
        (300, 6, []), (301, 6, []), (302, 7, []), (400, 1, [-1.0, 0.2]), (400, 1, [-1.0, 0.2]), (400, 2, [-1.0, 0.3]), (401, 2, [-0.4, 0.1]), (402, 2, [-0.4, 0.1]),
        (500, 8, [3e30, 1.0, 0.0]), (501, 8, [2.0, 3.0, 0.0]), (502, 9, [1.0, 1.0, 1.0]),
    ]
    frame = spark.createDataFrame([(*r, 1, "x", 3, 4) for r in rows], SCHEMA + ", dim int, leaf string, w int, block int")
    small = [r for r in rows if r[0] not in (500, 501, 502)]
    got = _mined(frame)
    assert {r for r in got if r[0] != 500} == _brute(small)
    assert _mined(frame.filter("vec_id IS NULL OR vec_id < 500"), leaf=2) == _brute(small)


def test_nothing_to_search(spark):
    assert _mined(spark.createDataFrame([], SCHEMA)) == set()
    assert _mined(spark.createDataFrame([(0, 1, [1.0])], SCHEMA)) == set()


def test_given_table(spark, sf):
    frame = G.moved_label(spark.read.parquet(f"{sf}/embeddings.parquet"))
    rows = [(r.vec_id, r.label, r.embedding) for r in frame.collect()]
    assert _mined(frame) == _brute(rows)


@pytest.mark.parametrize("seed", range(4))
def test_no_leaf_with_a_fitting_row_is_left_out(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(100 * rng.standard_normal((800, 6)) * rng.lognormal(0, 0.5, (800, 1)))
    tree = G.fit(x[::3], 20, fanout=6)
    G.widen(tree, x)
    leaf = G.descend(tree, x)
    a = x[:50]
    s = a @ x.T
    lows = np.quantile(s, [0.6, 0.9], axis=1).T
    highs = lows + 2000
    alive, _ = G.reachable(tree, a, lows, highs)
    fits = ((s[:, :, None] >= lows[:, None]) & (s[:, :, None] <= highs[:, None])).any(2)
    for i, j in zip(*np.nonzero(fits), strict=True):
        assert alive[i, leaf[j]]
    # A window that no row can reach is left out at the root.
    assert not G.reachable(tree, a, np.full((50, 1), 1e9), np.full((50, 1), 2e9))[0].any()


def test_ranges_leave_out_far_siblings():
    """Tight groups far apart: almost all leaves are left out for a window near the asking vector."""
    rng = np.random.default_rng(9)
    x = np.floor(np.repeat(1000 * rng.standard_normal((30, 8)), 40, axis=0) + 20 * rng.standard_normal((1200, 8)))
    tree = G.fit(x, 50, fanout=8)
    G.widen(tree, x)
    size = G.lengths(x)[::40]
    alive, _ = G.reachable(tree, x[::40], size[:, None] * 0.98, size[:, None] * 1.05)
    assert tree.leaves >= 25 and alive.mean() < 0.35


def test_best_counts_a_row_once():
    score = np.array([5, 9, 9, 9, 9, 9, 9, 1, 7])
    ids = np.array([1, 4, 4, 4, 4, 4, 3, 8, 9])
    assert [(score[i], ids[i]) for i in G.best(score, ids, 3)] == [(9, 3), (9, 4), (7, 9)]
    assert len(G.best(np.empty(0, int), np.empty(0, int), 3)) == 0


def test_scores_beyond_double_precision():
    a, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**40, 1.0], [-(2.0**40), 0.0]])
    assert G.scores(a, x).tolist() == [[2**60 + 3, G.MOST, G.LEAST]]
    assert G.decode(__import__("pyarrow").array(G.encode(x), "binary"), 2).tolist() == x.tolist()
