import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lacuna.llm import brown


def _words(docs):
    return {r.doc_id: (r.text or "").encode().lower().split() + [brown.END] for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("counted", [200, 262_144])
def test_base_score_and_held_out_gain(docs, counted):
    rows = brown.score(docs, classes=16, clustered=min(150, counted), counted=counted).toPandas().set_index("doc_id")
    words = _words(docs)
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in words}
    seen = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    tokens, types = sum(seen.values()), len(seen)
    for d, ws in words.items():
        r = rows.loc[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(w in seen for w in ws), tokens)
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + 1) / (tokens + types + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.perplexity, 10 ** (-r.score / len(ws)), rel_tol=1e-9)
    out = rows[rows.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_is_a_distribution(docs):
    training = brown._training(docs)
    words = brown.count_words(training).cache()
    vocab, least = brown.vocabulary(words, 100, 300)
    klass, table = brown.exchange(brown.count_bigrams(training, vocab), vocab, 8, 2)
    model = brown.build(vocab, klass, table, 8)
    assert np.allclose((10**model.transition).sum(1), 1)
    mass = np.bincount(model.klass, 10**model.emission, len(table))
    rare = Counter()
    for r in words.filter(F.col("n") < least).collect():
        rare[brown.shape(bytes(r.word))] += r.n - vocab.discount
    for c in range(9):
        assert abs(mass[c] - 1) < 1e-9 or not (klass == c).any()
    for s in range(brown.SHAPES):
        unseen = vocab.rest_types[s] * vocab.discount + 1
        assert abs(mass[9 + s] + (rare[s] + unseen) / (vocab.rest_tokens[s] + 1) - 1) < 1e-9


def test_exchange_raises_the_likelihood(docs):
    training = brown._training(docs)
    vocab, _ = brown.vocabulary(brown.count_words(training), 100, 300)
    bigrams = brown.count_bigrams(training, vocab).cache()

    def likelihood(table):
        return brown._xlogx(table).sum() - brown._xlogx(table.sum(0)).sum() - brown._xlogx(table.sum(1)).sum()

    values = [likelihood(brown.exchange(bigrams, vocab, 8, rounds)[1]) for rounds in (0, 2, 4)]
    assert values[0] < values[1] < values[2]


def test_hash_is_the_one_of_spark(spark):
    words = [b"", b"a", b"hello world", "ñandú".encode(), b"x" * 100]
    got = [r.h for r in spark.createDataFrame([(w,) for w in words], "word binary").select(F.xxhash64("word").alias("h")).collect()]
    assert [h % (1 << 64) for h in got] == [xxhash.xxh64_intdigest(w, 42) for w in words]


def test_odd_and_empty(odd, none, spark):
    rows = brown.score(odd, classes=4, clustered=50, counted=100).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == by[2].n_tokens == by[6].n_tokens == 1 and by[None].held_out is None
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert brown.score(none).count() == 0
    alone = spark.createDataFrame([(next(d for d in range(99) if zlib.crc32(str(d).encode()) % 7 == 2), "never seen")], "doc_id long, text string")
    r = brown.score(alone).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)
