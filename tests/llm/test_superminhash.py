from collections import defaultdict

import numpy as np

from lacuna.llm import superminhash


def brute(rows, width, percent=80):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {}
    for d, text in rows:
        w = (text or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 100 >= max(len(x), len(y)) * percent and 100 * (k := len(x & y)) >= percent * (len(x) + len(y) - k):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_equals_brute_force(docs):
    rows = docs.select("doc_id", "text").collect()
    for width in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_duplicates(docs, width=width).collect()}
        assert got == brute(rows, width)


def test_chains_in_one_group(spark):
    """Variants of one text: some link only by others, some with none."""
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for d in range(150):
        own = list(base)
        for at in rng.choice(80, rng.integers(0, 12), replace=False):
            own[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((d, " ".join(own)))
    got = superminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    want = brute(rows, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 2


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    shared, slots = rng.integers(0, 2**63, 600).astype(np.uint64), 2048
    a, b = np.r_[shared, rng.integers(0, 2**63, 200).astype(np.uint64)], np.r_[shared, rng.integers(0, 2**63, 200).astype(np.uint64)]
    s = superminhash.signatures(np.r_[a, b], np.array([len(a), len(b)]), slots)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.04
    one = superminhash.signatures(a[:1], np.array([1]), 64)
    assert sorted((one[0] >> np.uint64(32)).tolist()) == list(range(64))  # one element visits each slot once


def test_odd_and_empty(odd, none):
    got = defaultdict(list)
    for r in superminhash.near_duplicates(odd).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[6] == [(0, 6, True)]
    assert got[3] == [(1, 3, True)] * 2 and got[7] == [(1, 3, False)]
    assert got[None] == [(1, None, True)] * 2
    assert superminhash.near_duplicates(none).count() == 0
    kept = superminhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "5", "6", "8", "9", "-4", "None", "None"])
    assert superminhash.one_of_each(none).count() == 0
