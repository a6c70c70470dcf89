"""Packing documents into sequences by vector best-fit.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared
piece lengths, which is what block-diagonal attention pays). A piece goes into the open
sequence that has room for it under every capacity and is left with the smallest weighted
residual norm, or has the largest weighted dot product of residual and demand; a new
sequence is opened only where none has room. Weights are the mean demand of each
capacity, so one that does not bind does not steer.

Spark deals the pieces out in random order to tasks of bounded size; a task packs them in
chunks, long pieces first, and carries its open sequences from chunk to chunk, so only
the last sequences of a task stay partly empty. No group of rows is ever collected.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import DEFAULT_TOKENIZERS, rows_of, spread, stored

@lru_cache(maxsize=2)
def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The tokenizer's own split; letters below U+0180 are their own normal form and lower-case one by one.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE = "\u0180"
#: White space and control characters, on which libraries differ, and the start of a special token.
ODD = r"[\x00-\x1f\x7f-\xa0]|<\|"


class WordIds:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer maps runs of white space to a space, drops it, and lower-cases and
    splits character by character, so words between ASCII white space encode on their
    own. A word of plain letters is split here and its parts go straight to the merges;
    any other word goes through the whole tokenizer. Ids of up to ``remembered`` words
    and as many parts are kept.
    """

    def __init__(self, path: str, remembered: int = 300_000):
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.remembered = load(path), remembered
        self.model = self.tokenizer.model
        self.split, self.odd = regex.compile(PRETOKENS).findall, regex.compile(ODD).search
        self.byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.letters: dict[str, str] = {}

    def encode(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8", "replace").split()
        known = self.words.get
        out = list(map(known, words))
        if None in out:
            out = [self._word(w) if i is None else i for w, i in zip(words, out, strict=True)]
        return b"".join(out)

    def _word(self, word: bytes) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            text = word.decode()
            if max(text) < SIMPLE and not self.odd(text):
                ids = b"".join([self.parts.get(p) or self._part(p) for p in self.split(text.lower())])
            else:
                ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            if len(self.words) < self.remembered:
                self.words[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() else "".join([self.letters.get(c) or self._letter(c) for c in part])
        ids = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        if len(self.parts) < self.remembered:
            self.parts[part] = ids
        return ids

    def _letter(self, c: str) -> str:
        return self.letters.setdefault(c, self.byte_level.pre_tokenize_str(c)[0][0])


_WORD_IDS: dict[str, WordIds] = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ARROW = {"long": pa.int64(), "int": pa.int32()}


def _batch(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = [f.rsplit(" ", 1) for f in schema.split(", ")]
    return pa.RecordBatch.from_pydict({n: pa.array(columns[n], ARROW[k]) for n, k in kinds})


def cut(docs: DataFrame, path: str, tokens: int) -> DataFrame:
    """Pieces of every document: its ids, then id 0, cut only where longer than ``tokens``."""

    def pieces(batches):
        encoder = _WORD_IDS.get(path) or _WORD_IDS.setdefault(path, WordIds(path))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encoder.encode(text) + b"\0\0\0\0"
                    for k, start in enumerate(range(0, len(ids) // 4, tokens)):
                        own = ids[4 * start : 4 * (start + tokens)]
                        for name, value in zip(out, (doc_id, k, start, len(own) // 4, zlib.crc32(own)), strict=True):
                            out[name].append(value)
                yield _batch(out, PIECES)

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(pieces, PIECES)


class Packer:
    """Open sequences of one task. ``measure``: "norm" or "dot".

    At most ``open_bins`` sequences, those with the most room, stay open between chunks.
    """

    def __init__(self, capacity: tuple[int, int, int], measure: str = "norm", open_bins: int = 1024):
        self.capacity = np.array(capacity, float)
        self.measure, self.open_bins = measure, open_bins
        self.room = np.zeros((3, 0))  # residual tokens, documents, attention cost
        self.number = np.zeros(0, np.int64)
        self.opened = 0
        self.demand = np.zeros(3)

    def pack(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence number and offset of each piece."""
        demand = np.vstack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2])
        if (demand > self.capacity[:, None]).any():
            raise ValueError("a piece exceeds a capacity on its own")
        self.demand += (demand / self.capacity[:, None]).sum(1)
        scale = (self.demand / max(self.demand.max(), 1e-300)) ** 2 / self.capacity**2
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        full = lengths == self.capacity[0]
        sequence[full] = self.opened + np.arange(full.sum())
        self.opened += int(full.sum())
        rest = np.flatnonzero(~full)
        room = np.hstack([self.room, np.zeros((3, len(rest)))])
        number = np.concatenate([self.number, np.zeros(len(rest), np.int64)])
        n = self.room.shape[1]
        for i in rest[np.argsort(-lengths[rest], kind="stable")]:
            need = demand[:, i]
            fits = np.flatnonzero(room[0, :n] >= need[0])
            if len(fits):
                left = room[:, fits] - need[:, None]
                cost = scale @ left**2 if self.measure == "norm" else -((scale * need) @ room[:, fits])
                cost[(left[1] < 0) | (left[2] < 0)] = np.inf
                best = int(np.argmin(cost))
                k = int(fits[best]) if cost[best] < np.inf else n
            else:
                k = n
            if k == n:
                room[:, n], number[n] = self.capacity, self.opened
                n, self.opened = n + 1, self.opened + 1
            sequence[i], offset[i] = number[k], self.capacity[0] - room[0, k]
            room[:, k] -= need
        keep = np.flatnonzero(room[:, :n].min(0) >= 1)
        if len(keep) > self.open_bins:
            keep = keep[np.argsort(-room[0, keep], kind="stable")[: self.open_bins]]
        self.room, self.number = room[:, keep].copy(), number[keep].copy()
        return sequence, offset


def pack(
    docs: DataFrame, path: str = f"{DEFAULT_TOKENIZERS}/word_bpe_49k.json", tokens: int = 2048, documents: int | None = None,
    attention: int | None = None, measure: str = "norm", rows_per_task: int = 65_536, chunk: int = 8192,
) -> DataFrame:
    """Pack all documents: one row per piece with its sequence and place.

    Capacities of documents and attention cost default to what ``tokens`` implies, so
    that they do not cost sequences. Null and empty texts are one piece of length 1;
    a null doc_id and repeated rows are packed like any other; an empty table gives no
    rows; other columns are not read.
    """
    capacity = (tokens, documents or tokens, attention or tokens**2)
    pieces = stored(cut(docs, path, tokens), "pieces")
    tasks = spread(docs.sparkSession, pieces.count(), rows_per_task)
    schema = PIECES + ", sequence_id long, offset long"

    def packed(batches):
        from pyspark import TaskContext

        packer, first = Packer(capacity, measure), TaskContext.get().partitionId() << 36
        names = [f.split()[0] for f in PIECES.split(", ")]
        for batch in _chunks(batches, chunk):
            sequence, offset = packer.pack(batch.column("length").to_numpy())
            columns = [batch.column(n).combine_chunks() for n in names]
            yield from pa.table([*columns, pa.array(first + sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]).to_batches()

    return pieces.repartition(tasks).mapInArrow(packed, schema)


def _chunks(batches, rows: int):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= rows:
            whole = pa.Table.from_batches(held)
            yield whole.slice(0, rows)
            rest = whole.slice(rows).to_batches()
            held, n = rest, sum(b.num_rows for b in rest)
    if n:
        yield pa.Table.from_batches(held)
