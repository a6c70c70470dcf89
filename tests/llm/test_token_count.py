import random

from lacuna.llm import token_count
from lacuna.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


def test_equals_the_library(docs):
    model, whole = token_count.load(PATH)
    assert len(whole) > 10_000 and all(len(model.encode(w)) == 1 for w in random.Random(0).sample(sorted(whole), 500))
    for r in token_count.count_tokens(docs, PATH).join(docs.select("doc_id", "text"), "doc_id").collect():
        n = len(model.encode(r.text or ""))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 4096)


def test_any_text():
    counter, model, rng = token_count.Counter(PATH, remembered=100), token_count.load(PATH)[0], random.Random(1)
    parts = [" ", "  ", "\n", "\t", "▁", "a", "the", "<s>", "é", "\0", "日", "hello", "123", "</s>", "　", "\xa0", "🙂", "<unk>", "<0x0A>"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert counter.count(text) == len(model.encode(text)), repr(text)


def test_odd_and_empty(odd, none):
    rows = token_count.count_tokens(odd, PATH).collect()
    assert len(rows) == odd.count()
    assert {(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (1, 2)} == {(0, 0)}
    assert token_count.count_tokens(none, PATH).count() == 0
