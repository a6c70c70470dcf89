import random
import zlib

import numpy as np
import pytest

from lacuna.llm import vector_pack
from lacuna.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def _pieces(docs, tokens=2048):
    rows = docs.select("doc_id", "text").collect()
    ids = [e.ids + [0] for e in vector_pack.load(PATH).encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    return sorted(
        (str(r.doc_id), k, at, len(x[at : at + tokens]), zlib.crc32(np.array(x[at : at + tokens], "<u4").tobytes()))
        for r, x in zip(rows, ids, strict=True) for k, at in enumerate(range(0, len(x), tokens))
    )


def _check(rows, tokens=2048, documents=None, attention=None):
    order = rows.sort_values(["sequence_id", "offset"])
    by = order.groupby("sequence_id")
    assert (by.length.sum() <= tokens).all() and (by.offset.min() == 0).all()
    follow = by.offset.shift(-1)
    assert (follow.isna() | (follow == order.offset + order.length)).all()
    if documents:
        assert (by.size() <= documents).all()
    if attention:
        assert (order.assign(c=order.length**2).groupby("sequence_id").c.sum() <= attention).all()


def test_packs_all_documents(docs):
    rows = vector_pack.pack(docs, PATH).toPandas()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples()) == _pieces(docs)
    _check(rows)
    assert rows.sequence_id.nunique() <= np.ceil(rows.length.sum() / 2048) * 1.02 + 1


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_every_capacity_holds(docs, measure):
    rows = vector_pack.pack(docs, PATH, tokens=1024, documents=3, attention=1024 * 700 + 1024**2, measure=measure, rows_per_task=100, chunk=30).toPandas()
    _check(rows, 1024, 3, 1024 * 700 + 1024**2)
    assert rows.length.sum() == sum(n for *_, n, _ in _pieces(docs, 1024))


def test_one_piece_over_a_capacity():
    with pytest.raises(ValueError):
        vector_pack.Packer((10, 10, 50)).pack(np.array([9]))


def test_words_encode_on_their_own():
    ids, tokenizer, rng = vector_pack.WordIds(PATH, remembered=50), vector_pack.load(PATH), random.Random(3)
    alphabet = [*"aB'sé ñÑİßſǅΣς́Å²³½٣一 \t\n  \x1c\x85<|>._-0🙂µªº", "<|endoftext|>", "'re", "it's", "'S"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        assert ids.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_odd_and_empty(odd, none):
    rows = vector_pack.pack(odd, PATH).toPandas()
    assert sorted(("None" if np.isnan(r.doc_id) else str(int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples()) == _pieces(odd)
    _check(rows)
    assert vector_pack.pack(none, PATH).count() == 0
