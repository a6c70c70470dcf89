"""Document scores by a class-based bigram model (Brown classes).

P(w | v) = P(class(w) | class(v)) * P(w | class(w)). The most frequent words are assigned
to classes by exchange clustering: each word moves to the class that raises the likelihood of
the class bigrams most, given where all other words are. Words beyond these belong to
fixed classes by their shape (length, letters only or not), so that a word's class never
needs a look-up across machines; the end of a text is a class of its own and also the
context of a text's first word.

Everything is counted over all training texts: words, and bigrams of word numbers. A round
of the exchange sums the bigrams into context counts of a word per class in Spark and
decides for the words of one half at a time, so that words which would swap places do not
chase each other; the driver holds the class of each clustered word and the table of
class pairs only. Class transitions are smoothed towards the class shares; the words of a
shape class give an absolute discount to a word never seen, which is one word per shape.

Counts of the ``counted`` most frequent words at most travel with the tasks. Rarer words
of a text are looked up by a join on their 64-bit hashes.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import rows_of, stored, word_bytes

END = b"\n"  # no word holds white space
SHAPES = 16


def shape(word: bytes) -> int:
    return min(len(word) - 1, 15) // 2 * 2 + (not word.isalpha())


@dataclass
class Vocabulary:
    words: list[bytes]  # by falling count; the first ``clustered`` ones get classes
    counts: np.ndarray
    clustered: int
    tokens: int  # N
    types: int  # V
    discount: float
    rest_tokens: np.ndarray  # per shape: tokens and types that are not clustered
    rest_types: np.ndarray
    number: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"number": {}}

    def numbers(self) -> dict[bytes, int]:
        if not self.number:
            self.number.update((w, i) for i, w in enumerate(self.words))
        return self.number


def _training(docs: DataFrame) -> DataFrame:
    return docs.filter(F.crc32(F.col("doc_id").cast("string")) % 7 != 2).select(F.col("text").cast("string").alias("text"))


def count_words(training: DataFrame, flush: int = 400_000) -> DataFrame:
    """(word, n): every word of the training texts, the end of a text among them."""

    def counted(batches):
        def batch(c):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for (text,) in rows_of(batches, "text"):
            seen.update(word_bytes(text))
            seen[END] += 1
            if len(seen) > flush:
                yield batch(seen)
                seen.clear()
        if seen:
            yield batch(seen)

    return training.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(words: DataFrame, clustered: int, counted: int) -> tuple[Vocabulary, int]:
    """The frequent words, and the count from which a word is one of them."""
    of = words.groupBy("n").agg(F.count("*").alias("types")).orderBy(F.col("n").desc()).collect()
    types, tokens = sum(r.types for r in of), sum(r.n * r.types for r in of)
    least, held = (of[0].n + 1 if of else 1), 0
    for r in of:
        if held + r.types > counted:
            break
        least, held = r.n, held + r.types
    end = F.col("word") == F.lit(END)
    got = words.filter((F.col("n") >= least) | end).toArrow()
    pairs = sorted(zip(got.column("n").to_pylist(), got.column("word").to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    frequent, counts = [w for _, w in pairs], np.array([n for n, _ in pairs], np.int64)
    clustered = min(clustered, len(frequent))
    # The end of a text is always one of the clustered words.
    if END in frequent[clustered:]:
        at = frequent.index(END)
        frequent[clustered - 1], frequent[at] = frequent[at], frequent[clustered - 1]
        counts[[clustered - 1, at]] = counts[[at, clustered - 1]]
    letters = F.col("word").cast("string").rlike("^[A-Za-z]+$")
    kind = (F.floor(F.least(F.octet_length("word") - 1, F.lit(15)) / 2) * 2 + F.when(letters, 0).otherwise(1)).cast("int")
    rest_tokens, rest_types = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in words.filter((F.col("n") < least) & ~end).groupBy(kind.alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        rest_tokens[r.s], rest_types[r.s] = r.n, r.v
    for w, n in zip(frequent[clustered:], counts[clustered:], strict=True):
        rest_tokens[shape(w)] += n
        rest_types[shape(w)] += 1
    ones, twos = (next((r.types for r in of if r.n == k), 0) for k in (1, 2))
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    return Vocabulary(frequent, counts, clustered, tokens, types, discount, rest_tokens, rest_types), least


def count_bigrams(training: DataFrame, vocab: Vocabulary, flush: int = 3_000_000) -> DataFrame:
    """(l, r, n) over word numbers: clustered words as they are, others as ``clustered`` + shape."""
    size, hot = vocab.clustered + SHAPES, vocab.clustered
    words = vocab.words[:hot]

    def paired(batches):
        number = {w: i for i, w in enumerate(words)}
        end = number[END]
        held, n = [], 0

        def batch():
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((codes // size).astype(np.int32)), pa.array((codes % size).astype(np.int32)), pa.array(counts)], names=["l", "r", "n"])

        for (text,) in rows_of(batches, "text"):
            own = word_bytes(text)
            ids = [number[w] if w in number else hot + shape(w) for w in own]
            ids = np.array([end, *ids, end], np.int64)
            held.append(ids[:-1] * size + ids[1:])
            n += len(ids)
            if n >= flush:
                yield batch()
                held, n = [], 0
        if held:
            yield batch()

    return training.mapInArrow(paired, "l int, r int, n long").groupBy("l", "r").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def best_classes(right: np.ndarray, left: np.ndarray, own: np.ndarray, table: np.ndarray, movable: int) -> tuple[np.ndarray, np.ndarray]:
    """Best class of each word and its gain over staying.

    ``right`` and ``left``: rows of a word's counts by the class behind and before it;
    ``own``: its class; ``table``: counts of class pairs.
    """
    best, gain = own.copy(), np.zeros(len(own))
    for i, (r, l, a) in enumerate(zip(right, left, own, strict=True)):
        base = table.copy()
        base[a, :] -= r
        base[:, a] -= l
        np.maximum(base, 0, out=base)
        rows, cols = base[:movable], base[:, :movable]
        total = r.sum()
        value = (_xlogx(rows + r) - _xlogx(rows)).sum(1) + (_xlogx(cols + l[:, None]) - _xlogx(cols)).sum(0)
        before, behind = rows.sum(1), cols.sum(0)
        value -= _xlogx(before + total) - _xlogx(before) + _xlogx(behind + l.sum()) - _xlogx(behind)
        best[i] = int(np.argmax(value))
        gain[i] = value[best[i]] - value[a]
    return best, gain


def _contexts(bigrams: DataFrame, klass: np.ndarray, classes: int) -> DataFrame:
    """(w, side, c, n): counts of each word by the class behind (0) and before it (1)."""

    def summed(batches):
        for batch in batches:
            l, r, n = (batch.column(c).to_numpy() for c in ("l", "r", "n"))
            code = np.concatenate([(l.astype(np.int64) * 2) * classes + klass[r], (r.astype(np.int64) * 2 + 1) * classes + klass[l]])
            keys, at = np.unique(code, return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array((keys // (2 * classes)).astype(np.int32)), pa.array((keys // classes % 2).astype(np.int32)), pa.array((keys % classes).astype(np.int32)),
                 pa.array(np.bincount(at, np.concatenate([n, n])).astype(np.int64))],
                names=["w", "side", "c", "n"],
            )

    return bigrams.mapInArrow(summed, "w int, side int, c int, n long").groupBy("w", "side", "c").agg(F.sum("n").alias("n"))


def _table(contexts: DataFrame, klass: np.ndarray, classes: int) -> np.ndarray:
    """Counts of class pairs: at most classes * classes rows reach the driver."""
    own = contexts.sparkSession.createDataFrame(pd.DataFrame({"w": np.arange(len(klass), dtype=np.int32), "k": klass.astype(np.int32)}))
    out = np.zeros((classes, classes))
    for r in contexts.filter("side = 0").join(F.broadcast(own), "w").groupBy("k", "c").agg(F.sum("n").alias("n")).collect():
        out[r.k, r.c] = r.n
    return out


def exchange(bigrams: DataFrame, vocab: Vocabulary, classes: int, rounds: int, blocks: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Class of each word number, and the counts of class pairs.

    Classes 0 to ``classes`` - 1 are exchanged; then come the end of a text and the shapes.
    """
    hot = vocab.clustered
    total = classes + 1 + SHAPES
    klass = np.r_[np.arange(hot) % classes, classes + 1 + np.arange(SHAPES)].astype(np.int64)
    end = vocab.words.index(END) if hot else None
    if end is not None:
        klass[end] = classes
    for turn in range(rounds):
        contexts = stored(_contexts(bigrams, klass, total), "contexts")
        table = _table(contexts, klass, total)
        now = klass.copy()

        def decide(pdf: pd.DataFrame) -> pd.DataFrame:
            words, at = np.unique(pdf["w"].to_numpy(), return_inverse=True)
            both = np.zeros((2, len(words), total))
            both[pdf["side"].to_numpy(), at, pdf["c"].to_numpy()] = pdf["n"].to_numpy()
            best, gain = best_classes(both[0], both[1], now[words], table, classes)
            return pd.DataFrame({"w": words, "c": best, "gain": gain})

        half = contexts.filter((F.col("w") < hot) & (F.col("w") != F.lit(-1 if end is None else end)) & (F.pmod(F.xxhash64("w"), F.lit(2)) == turn % 2))
        moves = half.groupBy((F.col("w") % blocks).alias("block")).applyInPandas(decide, "w int, c int, gain double")
        for r in moves.filter("gain > 1e-9").collect():  # at most the clustered words
            klass[r.w] = r.c
    return klass, _table(_contexts(bigrams, klass, total), klass, total)


@dataclass
class Model:
    vocab: Vocabulary
    klass: np.ndarray  # of each known word
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # log10 P(word | class) of the known words
    base: np.ndarray  # log10 base probability of the known words


def build(vocab: Vocabulary, klass: np.ndarray, table: np.ndarray, classes: int, weight: float = 20.0) -> Model:
    """``weight``: how many counts the class shares stand for in a transition."""
    total = len(table)
    share = (table.sum(0) + 0.5) / (table.sum() + 0.5 * total)
    transition = np.log10((table + weight * share) / (table.sum(1, keepdims=True) + weight))
    hot = vocab.clustered
    of_word = np.r_[klass[:hot], [classes + 1 + shape(w) for w in vocab.words[hot:]]].astype(np.int64)
    mass = np.bincount(klass[:hot], vocab.counts[:hot], total)
    counts = vocab.counts.astype(float)
    emission = np.empty(len(counts))
    emission[:hot] = np.log10(counts[:hot] / mass[of_word[:hot]])
    rest = of_word[hot:] - classes - 1
    emission[hot:] = np.log10((counts[hot:] - vocab.discount) / (vocab.rest_tokens[rest] + 1))
    return Model(vocab, of_word, transition, emission, np.log10((counts + 1) / (vocab.tokens + vocab.types + 1)))


HEAD = "key long, doc_id long, n_tokens long, known long, base double, model double, h array<long>, m array<int>"


def _heads(docs: DataFrame, model: Model, classes: int) -> DataFrame:
    """Per text: what the known words and the class transitions give, and its rarer words."""

    def scored(batches):
        import xxhash

        number = model.vocab.numbers().get
        start = classes
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: dict[str, list] = {n: [] for n in ("n_tokens", "known", "base", "model", "h", "m")}
                for text in part.column("text").to_pylist():
                    words = word_bytes(text)
                    words.append(END)
                    found = list(map(number, words))
                    rare: Counter = Counter()
                    if None in found:
                        rare = Counter([w for w, i in zip(words, found, strict=True) if i is None])
                        found = [-1 - shape(w) if i is None else i for w, i in zip(words, found, strict=True)]
                    ids = np.array(found, np.int64)
                    seen = ids[ids >= 0]
                    k = classes - ids  # -1 - shape becomes classes + 1 + shape
                    k[ids >= 0] = model.klass[seen]
                    path = model.transition[np.r_[start, k[:-1]], k].sum()
                    out["n_tokens"].append(len(ids))
                    out["known"].append(len(seen))
                    out["base"].append(model.base[seen].sum())
                    out["model"].append(path + model.emission[seen].sum())
                    out["h"].append([xxhash.xxh64_intdigest(w, 42) - (1 << 64) * (xxhash.xxh64_intdigest(w, 42) >> 63) for w in rare])
                    out["m"].append([min(n, (1 << 26) - 1) * 32 + shape(w) for w, n in rare.items()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("doc_id"), pa.array(out["n_tokens"], pa.int64()), pa.array(out["known"], pa.int64()), pa.array(out["base"], pa.float64()),
                     pa.array(out["model"], pa.float64()), pa.array(out["h"], pa.list_(pa.int64())), pa.array(out["m"], pa.list_(pa.int32()))],
                    names=[f.split()[0] for f in HEAD.split(", ")],
                )

    own = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(scored, HEAD)


def score(docs: DataFrame, classes: int = 64, clustered: int = 8192, counted: int = 262_144, rounds: int = 4) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    A null text is an empty one: its only token is the end. A null doc_id is neither
    learnt from nor held out (held_out is null). Repeated rows are learnt from and scored
    each. Without training texts every word is unseen. Other columns are not read.
    """
    training = _training(docs)
    words = stored(count_words(training), "words")
    vocab, least = vocabulary(words, clustered, counted)
    if vocab.clustered:
        bigrams = stored(count_bigrams(training, vocab), "bigrams")
        klass, table = exchange(bigrams, vocab, classes, rounds)
    else:
        klass, table = classes + 1 + np.arange(SHAPES), np.zeros((classes + 1 + SHAPES,) * 2)
    if not vocab.words:
        # The end of a text must have a number; it was never seen.
        vocab.words, vocab.counts, vocab.clustered = [END], np.array([0]), 1
        model = Model(vocab, np.array([classes]), build_uniform(classes), np.zeros(1), np.zeros(1))
    else:
        model = build(vocab, klass, table, classes)
    heads = stored(_heads(docs, model, classes), "heads")

    tail = heads.select("key", F.explode(F.arrays_zip("h", "m")).alias("x")).select("key", F.col("x.h").alias("h"), F.floor(F.col("x.m") / 32).alias("k"), (F.col("x.m") % 32).alias("s"))
    rare = words.filter(F.col("n") < least).select(F.xxhash64("word").alias("h"), F.col("n").alias("c"))
    room = F.element_at(F.array(*[F.lit(float(x) + 1) for x in vocab.rest_tokens]), (F.col("s") + 1).cast("int"))
    unseen = F.element_at(F.array(*[F.lit(float(x) * vocab.discount + 1) for x in vocab.rest_types]), (F.col("s") + 1).cast("int"))
    weight = F.log10(F.coalesce(F.col("c") - F.lit(vocab.discount), unseen) / room)
    sums = tail.join(rare, "h", "left").groupBy("key").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("t_known"),
        F.sum(F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(vocab.tokens + vocab.types + 1)))).alias("t_base"),
        F.sum(F.col("k") * weight).alias("t_model"),
    )
    out = heads.drop("h", "m").join(sums, "key", "left")
    total = F.col("model") + F.coalesce("t_model", F.lit(0.0))
    known = F.col("known") + F.coalesce("t_known", F.lit(0))
    if not vocab.tokens:
        known = F.lit(0)
    return out.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 7 == 2).alias("held_out"), "n_tokens", known.cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("t_base", F.lit(0.0))).alias("base_score"), total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )


def build_uniform(classes: int) -> np.ndarray:
    total = classes + 1 + SHAPES
    return np.full((total, total), -np.log10(total))
