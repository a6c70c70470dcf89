"""Token counts of a piece vocabulary by the whole-token shortcut.

The vocabulary marks a word start by U+2581, which also stands for every space. No piece
holds that mark behind another character (checked when the model is loaded), so no merge
ever joins the end of a word to the space behind it: a text falls into segments of the
form "marks, then other characters" that encode independently of one another.

Offline, each piece is encoded alone; those that come back as themselves are proven
whole tokens. While counting, a segment that is a proven piece counts 1 at once, and only
the others are merged by the library (their counts are remembered up to a bound).
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lacuna.llm.common import DEFAULT_TOKENIZERS, rows_of

MARK = "▁"


@lru_cache(maxsize=2)
def load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for i, p in enumerate(pieces) if not model.is_byte(i)):
        raise ValueError("a piece spans two words: segments would not be independent")
    return model, proven(model, pieces)


def proven(model, pieces: list[str]) -> frozenset[str]:
    """Words (without their mark) that the model encodes as exactly one token."""
    words = [(i, p[1:]) for i, p in enumerate(pieces) if p.startswith(MARK) and MARK not in p[1:] and len(p) > 1]
    ids = model.encode([w for _, w in words], num_threads=1)
    return frozenset(w for (i, w), got in zip(words, ids, strict=True) if got == [i])


class Counter:
    """Tokens of whole texts. ``remembered`` bounds the memo of merged segments."""

    def __init__(self, path: str, remembered: int = 300_000):
        self.model, whole = load(path)
        self.remembered, self.merged = remembered, {}
        self.known = dict.fromkeys(whole, 1)

    def segment(self, text: str) -> int:
        n = self.merged.get(text)
        if n is None:
            n = len(self.model.encode(text))
            if len(self.merged) < self.remembered:
                self.merged[text] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, spaces, known, segment = 0, 0, self.known.get, self.segment
        for part in text.replace(MARK, " ").split(" "):
            if not part:
                spaces += 1
            elif spaces:
                total += segment(" " * spaces + part)
                spaces = 0
            else:
                total += known(part) or segment(part)
        # The model puts one mark in front of a text, which split() shows as no empty part.
        return total + (segment(" " * (spaces - 1)) if spaces > 1 else 1 if spaces else 0)


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str = f"{DEFAULT_TOKENIZERS}/piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    Null and empty texts have 0 bytes and 0 tokens; a null doc_id and repeated rows stay;
    other columns are not read. One pass over the texts without a shuffle.
    """

    def counted(batches):
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(path))
        for batch in batches:
            ids, sizes, tokens = [], [], []
            for doc_id, text in rows_of([batch], "doc_id", "text"):
                ids.append(doc_id)
                sizes.append(len(text.encode("utf-8", "replace")) if text else 0)
                tokens.append(counter.count(text))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()),
                "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
            })

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(
        counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
