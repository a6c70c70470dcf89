"""Toxicity by a subsequence string kernel and a support vector machine on Nyström landmarks.

The kernel of two words sums, over their common three-letter subsequences, the decay to
the power of the span in either word, scaled to 1 for a word with itself. A gapped or
inserted letter lengthens a span and so lowers the value without losing the match. Values
under ``floor`` count as 0, the others are raised to ``power``. The kernel of a sentence
and a landmark is that of the sentence's best word.

Landmarks are words that labelled toxic documents favour beyond chance. The Nyström map of the landmarks makes the kernel an inner product, on which a
linear machine with a squared hinge is trained over labelled sentences: those of clean
documents, and of a toxic document the one that is toxic under the machine of the round
before. A document's score calibrates its two highest sentences.

Fitting uses a bounded sample of labelled documents; scoring reads every word of every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import remainder, rows_of

WINDOW, STEP, SPAN = 16, 8, 7
#: What an inserted letter leaves of a kernel value to the power of 2.
GAPPED = 0.55
INNER = re.compile(r"[\W_]+")


def core(token: str) -> str:
    """Letters and digits of a token: marks between them are dropped."""
    return token if token.isalnum() else INNER.sub("", token)


def windows(word: str) -> list[str]:
    """The word, or overlapping windows of a very long one."""
    if len(word) <= WINDOW:
        return [word]
    return [word[at : at + WINDOW] for at in range(0, len(word) - WINDOW + STEP, STEP)]


def _places(n: int) -> np.ndarray:
    """Places of the three-letter subsequences of a word of ``n`` letters."""
    return np.array([c for c in combinations(range(n), 3) if c[2] - c[0] < SPAN], int).reshape(-1, 3)


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(words, f"U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


def _norms(words: list[str], decay: float) -> np.ndarray:
    """Square root of each word's kernel with itself; the words have one length."""
    at, letters = _places(len(words[0])), _letters(words).astype(np.int64)
    codes = letters[:, at[:, 0]] << 42 | letters[:, at[:, 1]] << 21 | letters[:, at[:, 2]]
    weights = decay ** (at[:, 2] - at[:, 0] + 1.0)
    out = np.empty(len(codes))
    for i, row in enumerate(codes):
        _, inverse = np.unique(row, return_inverse=True)
        out[i] = np.sqrt((np.bincount(inverse, weights) ** 2).sum())
    return out


@dataclass(eq=False)
class Kernel:
    """Kernel values of words with all landmarks.

    Letters of the landmarks are numbered, so that a subsequence of three is a place in a
    small cube, which tells the landmarks that have it.
    """

    landmarks: list[str]
    decay: float = 0.8
    floor: float = 0.5
    power: int = 2

    def __post_init__(self):
        self.landmarks = [w for w in self.landmarks if 3 <= len(w) <= WINDOW]
        letters = sorted({c for w in self.landmarks for c in w})
        self.base = len(letters) + 1
        self.number = np.zeros(max([ord(c) for c in letters], default=0) + 2, np.int32)  # 0: in no landmark
        for i, c in enumerate(letters):
            self.number[ord(c)] = i + 1
        cells: dict[int, dict[int, float]] = {}
        for j, word in enumerate(self.landmarks):
            norm = _norms([word], self.decay)[0]
            at = _places(len(word))
            for code, w in zip(self._codes([word], at)[0].tolist(), self.decay ** (at[:, 2] - at[:, 0] + 1.0), strict=True):
                own = cells.setdefault(code, {})
                own[j] = own.get(j, 0.0) + w / norm
        self.feature = np.full(self.base**3, -1, np.int32)
        self.highest = np.zeros(self.base**3, np.float32)
        self.first = np.zeros(len(cells) + 1, np.int64)
        for f, (code, own) in enumerate(cells.items()):
            self.feature[code], self.highest[code] = f, max(own.values())
            self.first[f + 1] = self.first[f] + len(own)
        self.landmark = np.array([j for own in cells.values() for j in own], np.int64)
        self.value = np.array([v for own in cells.values() for v in own.values()])

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Kernel) and (self.landmarks, self.decay, self.floor, self.power) == (other.landmarks, other.decay, other.floor, other.power)

    def _codes(self, words: list[str], at: np.ndarray) -> np.ndarray:
        """Place in the cube of every subsequence; one with a letter of no landmark is at a place with a 0."""
        letters = self.number[np.minimum(_letters(words), len(self.number) - 1)]
        return (letters[:, at[:, 0]] * self.base + letters[:, at[:, 1]]) * self.base + letters[:, at[:, 2]]

    def values(self, words: list[str]) -> list[np.ndarray | None]:
        """A vector of kernel values per word, None where all are under the floor."""
        out: list[np.ndarray | None] = [None] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if 3 <= len(w) <= WINDOW:
                by_length.setdefault(len(w), []).append(i)
            elif len(w) > WINDOW:
                parts = [v for v in self.values(windows(w)) if v is not None]
                out[i] = np.max(parts, axis=0) if parts else None
        if not self.landmarks:
            return out
        for n, rows in by_length.items():
            at = _places(n)
            weights = self.decay ** (at[:, 2] - at[:, 0] + 1.0)
            # A word's norm is at least that of its weights, so these are upper bounds:
            # first of all landmarks at once, then of each.
            least = self.floor * np.sqrt((weights**2).sum())
            for k in range(0, len(rows), 2048):
                part = rows[k : k + 2048]
                codes = self._codes([words[i] for i in part], at)
                some = np.flatnonzero(self.highest[codes] @ weights.astype(np.float32) >= least * 0.999)
                if not len(some):
                    continue
                found = self.feature[codes[some]]
                r, c = np.nonzero(found >= 0)
                f = found[r, c]
                many = self.first[f + 1] - self.first[f]
                # Every hit once per landmark that has the subsequence.
                each = np.repeat(np.arange(len(f)), many)
                cell = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + self.first[f[each]]
                width = len(self.landmarks)
                sums = np.bincount(r[each] * width + self.landmark[cell], self.value[cell] * weights[c[each]], len(some) * width).reshape(-1, width)
                near = np.flatnonzero(sums.max(1) >= least)
                if not len(near):
                    continue
                which = [part[i] for i in some[near]]
                exact = sums[near] / _norms([words[i] for i in which], self.decay)[:, None]
                for i, v in zip(which, exact, strict=True):
                    if v.max() >= self.floor:
                        out[i] = (np.where(v >= self.floor, v, 0.0) ** self.power).astype(np.float32)
        return out


class Reader:
    """Active sentences of texts: per sentence the best kernel value of each landmark."""

    def __init__(self, kernel: Kernel, remembered: int = 400_000):
        self.kernel, self.remembered = kernel, remembered
        self.known: dict[str, int] = {}  # -1: no value; else a row of vectors
        self.vectors: list[np.ndarray] = []

    def sentences(self, texts: list[str | None]) -> list[np.ndarray]:
        """One array (sentences with a value, landmarks) per text."""
        split = [(t or "").lower().split() for t in texts]
        spelled = [_spelled(ws) for ws in split]
        known = self.known.get
        rows = [list(map(known, ws)) for ws in split]
        new = list({w for ws, own in zip(split, rows, strict=True) if None in own for w, i in zip(ws, own, strict=True) if i is None} | {w for s in spelled for w in s.values() if w not in self.known})
        fresh: dict[str, int] = {}
        kept = len(self.vectors)
        for w, v in zip(new, self.kernel.values([core(w) for w in new]), strict=True):
            fresh[w] = -1 if v is None else len(self.vectors)
            if v is not None:
                self.vectors.append(v)
        out = []
        for ws, own, letters in zip(split, rows, spelled, strict=True):
            if None in own:
                own = [fresh[w] if i is None else i for w, i in zip(ws, own, strict=True)]
            place = np.fromiter(own, np.int64, len(own))
            hits = np.flatnonzero(place >= 0)
            place = place[hits]
            for i, w in letters.items():
                k = self.known[w] if w in self.known else fresh[w]
                if k >= 0:
                    hits, place = np.r_[hits, i], np.r_[place, k]
            best = np.zeros((0, len(self.kernel.landmarks)), np.float32)
            if len(hits):
                ends = np.flatnonzero([w[-1] in ".!?" for w in ws])
                own_sentence, where = np.unique(np.searchsorted(ends, hits), return_inverse=True)
                best = np.zeros((len(own_sentence), best.shape[1]), np.float32)
                for s, k in zip(where.tolist(), place.tolist(), strict=True):
                    np.maximum(best[s], self.vectors[k], out=best[s])
            out.append(best)
        if len(self.known) + len(fresh) <= self.remembered:
            self.known.update(fresh)
        else:
            del self.vectors[kept:]
        return out


_READER: list[Reader] = []


def reader_of(kernel: Kernel) -> Reader:
    """A worker's reader: what it remembers of words serves its next tasks."""
    if not _READER or _READER[0].kernel != kernel:
        _READER[:] = [Reader(kernel)]
    return _READER[0]


def _spelled(words: list[str]) -> dict[int, str]:
    """Words spelled out letter by letter, by the place of their first letter."""
    out: dict[int, str] = {}
    if len(words) < 3:
        return out
    single = [i for i, w in enumerate(words) if len(w) == 1 and w.isalnum()]
    at = 0
    while at < len(single):
        end = at
        while end + 1 < len(single) and single[end + 1] == single[end] + 1:
            end += 1
        if end - at >= 2:
            out[single[at]] = "".join(words[i] for i in single[at : end + 1])
        at = end + 1
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 30) -> np.ndarray:
    """Linear machine (last coefficient: intercept) by Newton steps on its active rows."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w, before = np.zeros(x.shape[1]), None
    for _ in range(steps):
        active = y * (x @ w) < 1
        if before is not None and (active == before).all():
            break
        a = x[active] * weight[active][:, None]
        w = np.linalg.solve(a.T @ x[active] + np.diag(ridge), a.T @ y[active])
        before = active
    return w


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 40) -> np.ndarray:
    """Logistic regression (last coefficient: intercept) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    kernel: Kernel
    beta: np.ndarray  # on kernel values with the landmarks
    bias: float
    platt: np.ndarray  # of the two highest sentences
    rate: float  # score without a model

    def summary(self, sentences: np.ndarray) -> tuple[float, float]:
        # A sentence beyond the margin is no surer: else it would push the calibration away from the margin.
        f = np.sort(np.minimum(1.0, np.r_[self.bias, self.bias, sentences @ self.beta + self.bias]))[::-1]
        return float(f[0]), float(f[1])

    def score(self, sentences: np.ndarray) -> float:
        if not len(self.beta):
            return self.rate
        a, b = self.summary(sentences)
        return float(1 / (1 + np.exp(-np.clip(self.platt @ [a, b, 1.0], -30, 30))))


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic, fold) of at most ``sample`` labelled rows that may be learnt from."""
    fold = F.crc32(F.col("doc_id").cast("string"))
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold % 4 != 2).dropDuplicates(["doc_id"])
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most ``sample`` rows of two numbers.
    return text.join(F.broadcast(own), "doc_id").select("text", "toxic", (F.xxhash64("doc_id") % 4 == 0).alias("aside"))


def _choose(learn: DataFrame, landmarks: int, least: float) -> tuple[list[str], int, int]:
    """Landmark words, and the numbers of clean and toxic documents."""
    totals = {r.toxic: r["count"] for r in learn.groupBy("toxic").count().collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)

    def words(batches):
        for text, label in rows_of(batches, "text", "toxic"):
            own = {core(w) for w in (text or "").lower().split()} | {core(w) for w in _spelled((text or "").lower().split()).values()}
            own = [w for w in own if 3 <= len(w) <= WINDOW]
            if own:
                yield pa.RecordBatch.from_pydict({"word": own, "toxic": pa.array([label] * len(own), pa.int32())})

    seen = learn.mapInArrow(words, "word string, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    # Twice the log likelihood ratio of one share for both kinds against a share for each.
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    share = (t + c) / (clean + toxic)

    def term(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    gain = 2 * (term(t, share * toxic) + term(c, share * clean) + term(toxic - t, (1 - share) * toxic) + term(clean - c, (1 - share) * clean))
    bad = seen.withColumn("gain", gain).filter((t * clean > c * toxic) & (F.col("gain") >= least)).orderBy(F.col("gain").desc(), "word").limit(landmarks)
    return [r.word for r in bad.select("word").collect()], clean, toxic


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000, landmarks: int = 256, least: float = 20.0, rounds: int = 3, kept: int = 3, penalty: float = 1.0) -> Model:
    """Fit on at most ``sample`` labelled documents, with ``kept`` sentences of each.

    At most ``landmarks`` words are landmarks, with a likelihood ratio of at least ``least``.

    Without labels of both kinds every score is the share of toxic labels (0 without any).
    """
    learn = _labelled(docs, labels, sample)
    words, clean, toxic = _choose(learn, landmarks, least)
    rate = toxic / (clean + toxic) if clean + toxic else 0.0
    kernel = Kernel(words)
    words = kernel.landmarks
    if not clean or not toxic or not words:
        return Model(kernel, np.zeros(0), 0.0, np.zeros(3), rate)
    width = len(words)

    def features(batches):
        reader = reader_of(kernel)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                own = [s[np.argsort(-s.max(1), kind="stable")[:kept]] for s in reader.sentences(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_pydict({
                    "toxic": part.column("toxic"), "aside": part.column("aside"), "sentences": pa.array([s.astype("<f4").tobytes() for s in own], pa.binary()),
                })

    got = learn.select("text", "toxic", "aside").mapInArrow(features, "toxic int, aside boolean, sentences binary").collect()
    got.sort(key=lambda r: (r.toxic, r.aside, bytes(r.sentences)))  # the sums of the fit then never differ
    sets = [np.frombuffer(r.sentences, "<f4").reshape(-1, width).astype(float) for r in got]
    label, aside = np.array([r.toxic for r in got]), np.array([r.aside for r in got])
    values = kernel.values(words)
    own = np.array([np.zeros(width) if v is None else v for v in values])
    own = (own + own.T) / 2
    root, axes = np.linalg.eigh(own)
    keep = root > 1e-3 * root.max()
    nystrom = axes[:, keep] / np.sqrt(root[keep])
    calm = np.vstack([np.zeros((1, width)), *[s for s, t, a in zip(sets, label, aside, strict=True) if not t and not a]])
    witness = [s for s, t, a in zip(sets, label, aside, strict=True) if t and not a and len(s)]
    if not witness:
        return Model(kernel, np.zeros(0), 0.0, np.zeros(3), rate)
    bad = [s[np.argmax(s.max(1))] for s in witness]
    for _ in range(rounds):
        # Each toxic sentence is also shown as if a letter were inserted into its insult.
        x = np.vstack([calm, bad, GAPPED * np.array(bad)]) @ nystrom
        y = np.r_[-np.ones(len(calm)), np.ones(2 * len(bad))]
        w = squared_hinge(x, y, np.where(y > 0, len(calm) / len(bad) / 2, 1.0), penalty)
        beta, bias = nystrom @ w[:-1], float(w[-1])
        bad = [s[np.argmax(s @ beta)] for s in witness]
    model = Model(kernel, beta, bias, np.zeros(3), rate)
    rows = aside if len(set(label[aside])) == 2 and aside.sum() >= 200 else np.ones(len(label), bool)
    tops = np.array([model.summary(s) for s in sets])
    model.platt = logistic(tops[rows], label[rows].astype(float))
    return model


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts are scored as texts without a match. held_out is null for a null
    doc_id. Repeated rows get equal scores. Other columns are not read.
    """

    def scored(batches):
        reader = reader_of(model.kernel)
        for batch in batches:
            ids, scores = batch.column("doc_id").to_pylist(), []
            for at in range(0, batch.num_rows, 256):
                scores += [model.score(s) for s in reader.sentences(batch.column("text").slice(at, 256).to_pylist())]
            held = [None if i is None else remainder(i, 4) == 2 for i in ids]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "score": pa.array(scores, pa.float64()),
                "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32()),
            })

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(scored, SCORED)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with their columns, whose score is below the threshold."""
    at = docs.columns.index("text")

    def passed(batches):
        reader = reader_of(model.kernel)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                calm = [model.score(s) < threshold for s in reader.sentences(part.column(at).to_pylist())]
                yield part.filter(pa.array(calm, pa.bool_()))

    return docs.mapInArrow(passed, docs.schema)
