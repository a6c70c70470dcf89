import random

import numpy as np
import pytest

from lacuna.llm import cotraining, toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    """Invented prose; some documents hold insults, some are junk."""
    rng = random.Random(7)
    syllables = ["ka", "lo", "mi", "ren", "tas", "vu", "ber", "non", "sil", "dor"]
    plain = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(800)]
    insults = ["grubnix", "flotzer", "schmaggel"]
    docs, labels = [], []
    for d in range(900):
        words = [rng.choice(plain) for _ in range(rng.randint(40, 160))]
        words = [w + "." if rng.random() < 0.1 else w for w in words]
        toxic, good = rng.random() < 0.25, rng.random() < 0.8
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(insults))
        text = " ".join(words) if good else " ".join(w.upper() + rng.choice(["!!", "###", "$$"]) for w in words)
        docs.append((d, text, rng.choice(["en", "de"]), f"s{d % 5}", len(text)))
        if d % 10 < 7:
            labels.append((d, int(good), int(toxic)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    truth = {d: (q, t) for d, q, t in labels}
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_toxicity_of_held_out_rows(corpus):
    docs, labels, truth = corpus
    model = toxicity.fit(docs, labels)
    assert {"grubnix", "flotzer", "schmaggel"} <= set(model.kernel.landmarks)
    rows = toxicity.score(docs, model).collect()
    held = [(r.predicted, truth[r.doc_id][1]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and np.mean([p == t for p, t in held]) > 0.95
    clean = "lorenka mitas vuber lo non dorsil."
    for insult in ("grubnix", "gruxbnix", "grubbnix", "grub-nix", "g r u b n i x", "GRUBNIX"):
        text = f"{clean} kalo {insult} silren. mitas {insult} {clean}"
        assert model.score(toxicity.Reader(model.kernel).sentences([text])[0]) >= 0.3, insult
    assert model.score(toxicity.Reader(model.kernel).sentences([clean * 20])[0]) < 0.3
    left = toxicity.accepted(docs, model)
    assert left.columns == docs.columns and left.count() == sum(r.predicted == 0 for r in rows)


def test_kernel_equals_its_definition():
    def features(word, decay):
        out = {}
        for i in range(len(word)):
            for j in range(i + 1, len(word)):
                for k in range(j + 1, min(len(word), i + toxicity.SPAN)):
                    s = word[i] + word[j] + word[k]
                    out[s] = out.get(s, 0) + decay ** (k - i + 1)
        return out

    words = ["banana", "bandana", "cab", "abcabc", "ünïcode", "zzz", "bananabanana"]
    kernel = toxicity.Kernel(["banana", "cabana", "code"], floor=0.0, power=1)
    for w, got in zip(words, kernel.values(words), strict=True):
        f = features(w, 0.8)
        for j, landmark in enumerate(kernel.landmarks):
            g = features(landmark, 0.8)
            want = sum(v * g.get(s, 0) for s, v in f.items()) / np.sqrt(sum(v * v for v in f.values()) * sum(v * v for v in g.values()))
            assert abs((0 if got is None else got[j]) - want) < 1e-5


def test_quality_of_rows_not_learnt_from(corpus, spark):
    docs, labels, truth = corpus
    known = labels.filter("doc_id % 3 <> 0")
    model = cotraining.fit(docs, known, step=40)
    assert sum(model.exchanged) > 0
    rows = cotraining.score(docs, model).collect()
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in rows if r.doc_id in truth and r.doc_id % 3 == 0]) > 0.95
    left = cotraining.accepted(docs, model)
    assert left.columns == docs.columns and left.count() == sum(r.predicted for r in rows)


def test_odd_and_empty(corpus, odd, none):
    docs, labels, _ = corpus
    for module, name in ((toxicity, "toxic"), (cotraining, "quality")):
        model = module.fit(docs, labels)
        rows = module.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        assert module.accepted(odd, model).columns == odd.columns
        assert module.score(none, model).count() == 0
        for empty in (module.fit(none, labels), module.fit(docs, labels.limit(0)), module.fit(docs, labels.filter(f"{name} = 1"))):
            assert {0 <= r.score <= 1 for r in module.score(odd, empty).collect()} == {True}


def _plain_cotraining(x, quality, aside, rounds=3, step=0.08, sure=4.0):
    """Co-training on arrays: the rounds of the operator without Spark."""
    def settle(models, taught, penalty, steps):
        ways = [cotraining._Descent(m, penalty) for m in models]
        for _ in range(steps):
            for way, (a, y) in zip(ways, taught, strict=True):
                way.take(*way.model.sums(a, y))
            if all(w.done for w in ways):
                break
        return [w.model if w.done else w.model.at(w.best) for w in ways]

    known, free = quality >= 0, quality < 0
    teach = known & ~aside
    rate = quality[known].mean()
    low, high = (max(1, round(step * free.sum() * s)) for s in (1 - rate, rate))
    y = [np.where(teach, quality, -1), np.where(teach, quality, -1)]
    models = [cotraining.Linear.zero(teach.sum(), x[teach][:, p].astype(float).sum(0), (x[teach][:, p].astype(float) ** 2).sum(0)) for p in cotraining.VIEWS]
    models = settle(models, [(x[teach][:, p], quality[teach]) for p in cotraining.VIEWS], 3.0, 10)
    for _ in range(rounds):
        took = np.zeros(len(x), bool)
        for k, part in enumerate(cotraining.VIEWS):
            margin = models[k].margin(x[:, part])
            histogram = np.zeros(2 * cotraining.ENDS * cotraining.FINE + 1, int)
            np.add.at(histogram, cotraining._bins(margin[free]), 1)
            below, above = cotraining.cuts(histogram, low, high, sure)
            picked = free & ((margin <= below) | (margin >= above))
            y[1 - k][picked] = margin[picked] > 0
            took |= picked
        free = free & ~took
        if not took.any():
            break
        models = settle(models, [(x[t >= 0][:, p], t[t >= 0]) for t, p in zip(y, cotraining.VIEWS, strict=True)], 3.0, 5)
    m = np.column_stack([v.margin(x[:, p]) for v, p in zip(models, cotraining.VIEWS, strict=True)])
    a, q = m[aside], quality[aside]
    ends = [cotraining.Linear.zero(len(a), a[:, s].sum(0), (a[:, s] ** 2).sum(0)) for s in (slice(0, 1), slice(1, 2), slice(0, 2))]
    combined = settle(ends, [(a[:, :1], q), (a[:, 1:], q), (a, q)], 0.1, 12)[2]
    return cotraining.probability(combined.margin(m))


def test_equals_plain_cotraining(corpus):
    import zlib

    docs, labels, truth = corpus
    rows = docs.orderBy("doc_id").collect()
    x = np.stack([cotraining.features(r.text, r.lang, r.source, r.n_chars) for r in rows]).astype(np.float32)
    quality = np.array([truth.get(r.doc_id, (-1, 0))[0] for r in rows])
    aside = (quality >= 0) & np.array([zlib.crc32(str(r.doc_id).encode()) % 4 == 0 for r in rows])
    want = _plain_cotraining(x, quality, aside)
    model = cotraining.fit(docs.repartition(7), labels)
    got = np.array([r.score for r in cotraining.score(docs, model).orderBy("doc_id").collect()])
    assert sum(model.exchanged) > 0 and np.abs(got - want).max() < 1e-3


def test_cuts_take_whole_bins():
    counts = np.zeros(2 * cotraining.ENDS * cotraining.FINE + 1, int)
    at = lambda m: int(cotraining._bins(np.array([m]))[0])
    counts[at(-9.0)], counts[at(-8.0)], counts[at(-5.0)], counts[at(1.0)], counts[at(7.0)] = 3, 4, 50, 9, 200
    low, high = cotraining.cuts(counts, 8, 5, 4.0)
    assert -8.0 <= low < -5.0 and 1.0 < high <= 7.0  # 3 + 4 rows, then one whole bin
    assert cotraining.cuts(counts * 0, 8, 5, 4.0) == (np.nextafter(-4.0, -np.inf), 4.0)
