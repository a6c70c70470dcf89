"""Document quality by co-training two views.

The content view reads the text: a hashed histogram of its byte pairs, the shares of
capitals, digits, marks and spaces, and how its words repeat. The page view reads what is
known of the page without its words: language, source, recorded and stored length, and the layout of
its lines. A classifier per view is trained on labelled rows; in every round each one
labels the unlabelled rows it is surest of, in the proportion of the known labels, and
hands them to the other. At the end each view is calibrated on rows kept aside, a logistic regression on
them combines the two, and every document is scored.

All labelled and all unlabelled rows take part. Features are computed once and stored; a
round is a number of passes over them in which every task adds up what a Newton step needs,
gradient and matrix of second derivatives, and Spark adds the tasks' sums. The driver holds
these sums alone. Which rows a view has handed over is never stored: it follows from a row's
features and the models and cuts of the rounds before, so a lost task only computes it again.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import discard, stored

BUCKETS, NAMES = 512, 16


#: Byte classes: capitals, small letters, digits, spaces, marks, bytes above ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[:] = 4
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 3


def content(data: bytes) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs, and measures of the words."""
    pairs = np.zeros(BUCKETS, np.float32)
    if len(data) > 1:
        b = np.frombuffer(data, np.uint8).astype(np.uint32)
        pair = (b[:-1] << 8 | b[1:]) * np.uint32(2654435761) >> np.uint32(23)
        counts = np.bincount(pair, minlength=BUCKETS)
        pairs = np.sqrt(counts / counts.sum()).astype(np.float32)
    words = data.split()
    size, n = max(1, len(data)), max(1, len(words))
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=6) / size
    seen = Counter(words)
    top = max(seen.values()) / n if seen else 0.0
    ends = sum(w[-1:] in b".!?" for w in words) / n
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n
    measures = [*kinds, size / n / 10, len(seen) / n, len(seen) / np.sqrt(n) / 10, top, ends, marked, float(not words)]
    return np.concatenate([pairs, np.array(measures, np.float32)])


CONTENT = BUCKETS + 13


def page(data: bytes, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed language and source, lengths, and the layout of the lines."""
    names = np.zeros(2 * NAMES, np.float32)
    names[zlib.crc32(repr(lang).encode()) % NAMES] = 1
    names[NAMES + zlib.crc32(repr(source).encode()) % NAMES] = 1
    size = len(data)
    lines = data.split(b"\n")
    recorded = max(0, n_chars if n_chars is not None else size)
    widths = np.array([len(x) for x in lines], float)
    measures = [
        np.log1p(size), np.log1p(recorded), np.log1p(size) - np.log1p(recorded), np.log1p(len(lines)), np.log1p(size / len(lines)), np.log1p(widths.max()),
        widths.std() / (1 + widths.mean()), (widths == 0).mean(), len(set(lines)) / len(lines), float(n_chars is None), float(lang is None), float(source is None),
    ]
    return np.concatenate([np.array(measures, np.float32), names])


def features(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Both views of a row, content first, in half precision."""
    data = (text or "").encode("utf-8", "replace")
    return np.concatenate([content(data), page(data, lang, source, n_chars)]).astype(np.float16)


VIEWS = (slice(0, CONTENT), slice(CONTENT, None))


@dataclass
class Linear:
    """Logistic regression on standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def zero(cls, count: float, total: np.ndarray, squares: np.ndarray) -> Linear:
        """Weights of 0 for columns with these sums; columns that hardly vary keep no influence."""
        mean = total / max(count, 1)
        scale = np.sqrt(np.maximum(squares / max(count, 1) - mean**2, 0))
        return cls(mean, np.where(scale > 1e-6, scale, np.inf), np.zeros(len(total) + 1))

    def standard(self, x: np.ndarray) -> np.ndarray:
        """Columns in standard deviations; a rare value far out counts as ten of them."""
        return np.clip((x - self.mean) / self.scale, -10, 10)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights[:-1] + self.weights[-1]

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log loss over the rows, its gradient and second derivatives."""
        z = np.ones((len(x), len(self.weights)), np.float32)
        # Single precision and one array: a task's share of memory is a few of these.
        np.clip((x - self.mean.astype(np.float32)) / self.scale.astype(np.float32), -10, 10, out=z[:, :-1])
        margin = (z @ self.weights.astype(np.float32)).astype(float)
        p = probability(margin)
        loss = np.logaddexp(0, np.where(y > 0, -margin, margin)).sum()
        gradient = z.T @ (p - y).astype(np.float32)
        return loss, gradient.astype(float), (z * (p * (1 - p) + 1e-9)[:, None].astype(np.float32)).T @ z

    def at(self, weights: np.ndarray) -> Linear:
        return Linear(self.mean, self.scale, weights)


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


class Round(NamedTuple):
    """Both views as they were, and the margins at or beyond which each handed rows to the other."""

    views: tuple[Linear, Linear]
    low: tuple[float, float]
    high: tuple[float, float]


@dataclass
class Model:
    views: tuple[Linear, ...]
    calibration: tuple[Linear, ...]
    combined: Linear | None
    rate: float  # share of good labels: the score without a model
    exchanged: tuple[int, ...] = ()

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: combined, by content, by page."""
        if self.combined is None:
            return (np.full(len(x), self.rate),) * 3
        margins = [v.margin(x[:, part]) for v, part in zip(self.views, VIEWS, strict=True)]
        both = self.combined.margin(np.column_stack(margins))
        return probability(both), *(probability(c.margin(m[:, None])) for c, m in zip(self.calibration, margins, strict=True))


def handed(x: np.ndarray, known: np.ndarray, past: list[Round]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows that no view has labelled yet, label that each view was handed, -1 for none)."""
    free = ~known
    target = [np.full(len(x), -1), np.full(len(x), -1)]
    for r in past:
        margins = [v.margin(x[:, part]) for v, part in zip(r.views, VIEWS, strict=True)]
        picked = [free & ((m <= low) | (m >= high)) for m, low, high in zip(margins, r.low, r.high, strict=True)]
        for k in (0, 1):
            target[1 - k][picked[k]] = margins[k][picked[k]] > 0
        free &= ~(picked[0] | picked[1])
    return free, target


#: Histogram of margins, to find the surest rows: bins of 1/64 from -30 to 30.
FINE, ENDS = 64, 30


def _bins(margin: np.ndarray) -> np.ndarray:
    return np.floor((np.clip(margin, -ENDS, ENDS) + ENDS) * FINE).astype(int)


def cuts(counts: np.ndarray, low: int, high: int, sure: float) -> tuple[float, float]:
    """Margins that take about ``low`` rows from the bottom and ``high`` from the top, none nearer to 0 than ``sure``.

    Whole bins are taken, at least the first that holds a row, so that equal rows share a fate.
    """
    edges = np.arange(len(counts) + 1) / FINE - ENDS

    def first(values: np.ndarray, quota: int) -> int:
        total = values.cumsum()
        return max(int((total <= quota).sum()), int((total == 0).sum()) + 1)

    down, up = first(counts, low), first(counts[::-1], high)
    # The open end of the last bin taken from below belongs to the next one.
    lowest, highest = np.nextafter(edges[min(down, len(counts))], -np.inf), edges[max(len(counts) - up, 0)]
    return min(lowest, np.nextafter(-sure, -np.inf)), max(highest, sure)


#: Numbers in a row of a sent array.
ROW = 8192


def summed(rows: DataFrame, work: Callable[[pa.RecordBatch], Iterable[tuple[str, np.ndarray]]], single: str = "") -> dict[str, np.ndarray]:
    """Sums of named one-dimensional arrays over all batches of all tasks.

    There are as many tasks as the cluster runs at once, so that what is sent does not grow with the
    rows. A task sends its sums in rows of ``ROW`` numbers, arrays whose name begins with
    ``single`` in single precision; the rows of one place are added in a stream. The driver
    gets one copy of the arrays.
    """
    schema = "name string, place int, value binary"
    kind = lambda name: np.float32 if single and name.startswith(single) else np.float64

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for name, value in work(batch.slice(at, 1024)):
                    total[name] = total.get(name, 0) + np.asarray(value, float)
        for name, value in total.items():
            parts = [value[at : at + ROW].astype(kind(name)).tobytes() for at in range(0, len(value), ROW)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["name", "place", "value"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, key = 0.0, None
        for batch in batches:
            key = key or (batch.column("name")[0], batch.column("place")[0])
            for value in batch.column("value"):
                total = total + np.frombuffer(value.as_buffer(), kind(key[0].as_py()))
        if key:
            yield pa.RecordBatch.from_arrays([
                pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([np.asarray(total, float).tobytes()], pa.binary())
            ], ["name", "place", "value"])

    few = rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))
    out: dict[str, list] = {}
    for r in few.mapInArrow(run, schema).groupBy("name", "place").applyInArrow(add, schema).collect():
        out.setdefault(r.name, []).append((r.place, np.frombuffer(r.value)))
    return {name: np.concatenate([v for _, v in sorted(values, key=lambda p: p[0])]) for name, values in out.items()}


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features and quality (-1: not labelled) of stored rows."""
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float16).reshape(batch.num_rows, -1).astype(np.float32)
    return x, np.array([-1 if q is None else q for q in batch.column("quality").to_pylist()], int)


class _Descent:
    """Newton steps of one model, halved where a step made the loss larger."""

    def __init__(self, model: Linear, penalty: float) -> None:
        self.model, self.ridge = model, np.full(len(model.weights), penalty)
        self.ridge[-1] = 1e-3
        self.best, self.loss, self.move, self.done = model.weights, np.inf, None, False

    def take(self, loss: float, gradient: np.ndarray, matrix: np.ndarray) -> None:
        w = self.model.weights
        loss += float(self.ridge @ w**2) / 2
        if loss <= self.loss * (1 + 1e-9):
            self.best, self.loss = w, loss
            self.move = np.linalg.solve(matrix + np.diag(self.ridge), gradient + self.ridge * w)
        else:
            self.move = self.move / 2
        self.done = np.abs(self.move).max() < 1e-3
        self.model = self.model.at(self.best - self.move)


def newton(rows: DataFrame, models: list[Linear], taught: Callable[[pa.RecordBatch], list[tuple[np.ndarray, np.ndarray]]], penalty: float, steps: int) -> list[Linear]:
    """The models after at most ``steps`` passes; ``taught`` gives each model's rows and labels of a batch."""
    ways = [_Descent(m, penalty) for m in models]
    for _ in range(steps):
        now = [w.model for w in ways]

        def work(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
            for k, (x, y) in enumerate(taught(batch)):
                loss, gradient, matrix = now[k].sums(x, y)  # noqa: B023
                yield f"l{k}", np.array([loss])
                yield f"g{k}", gradient
                yield f"h{k}", matrix[np.triu_indices(len(matrix))]

        # The second derivatives only steer the step, the gradient decides where it ends.
        got = summed(rows, work, single="h")
        for k, way in enumerate(ways):
            matrix = np.zeros((len(now[k].weights),) * 2)
            matrix[np.triu_indices(len(matrix))] = got[f"h{k}"]
            way.take(got[f"l{k}"][0], got[f"g{k}"], matrix + np.triu(matrix, 1).T)
        if all(w.done for w in ways):
            break
    # The last move was not tried: keep the weights whose loss is known.
    return [m.model if m.done else m.model.at(m.best) for m in ways]


COLUMNS = ("text", "lang", "source", "n_chars")


def _read(docs: DataFrame) -> DataFrame:
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[(F.col(c) if c in docs.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])


def _vectors(batch: pa.RecordBatch, names: Iterable[str] = COLUMNS) -> np.ndarray:
    return np.stack([features(*r) for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True)])


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id and both views of every row, stored: fitting and scoring read them many times."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([r.tobytes() for r in _vectors(part)], pa.binary())], ["doc_id", "x"])

    return stored(_read(docs).mapInArrow(run, "doc_id long, x binary"), "views")


def fit(docs: DataFrame, labels: DataFrame, rounds: int = 3, step: float = 0.08, sure: float = 4.0) -> Model:
    """Co-train on all rows of ``docs``; see :func:`fit_prepared`."""
    return fit_prepared(prepared(docs), labels, rounds, step, sure)


def fit_prepared(views: DataFrame, labels: DataFrame, rounds: int = 3, step: float = 0.08, sure: float = 4.0) -> Model:
    """Co-train on :func:`prepared` rows. In a round each view labels about ``step`` of the
    unlabelled rows (a share below 1, else a number of rows) whose margin is at least ``sure``.

    Of labelled rows a quarter, by a hash of the doc_id, is kept aside for calibration. Labels
    other than 0 and 1, and labels of no document, teach nothing; a doc_id with several labels has its
    smallest. Rows without a doc_id are unlabelled. Without labels of
    both kinds every score is the share of good labels (0 without any).
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    # Written first, so that the planner knows its size before it decides whether the features must move.
    own = stored(own.filter("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality")), "labels")
    aside = F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0)
    rows = stored(views.join(own, "doc_id", "left").select("x", "quality", F.coalesce(aside, F.lit(False)).alias("aside")), "taught")
    kinds = {(r.aside, r.quality): r["count"] for r in rows.groupBy("aside", "quality").count().collect()}
    good, bad = (sum(kinds.get((a, q), 0) for a in (True, False)) for q in (1, 0))
    rate = good / max(good + bad, 1)
    if not all(kinds.get((a, q)) for a in (True, False) for q in (0, 1)):
        discard(rows)
        return Model((), (), None, rate)
    quota = step * kinds.get((False, None), 0) if step < 1 else step
    low, high = max(1, round(quota * (1 - rate))), max(1, round(quota * rate))
    teaching, kept = rows.filter("NOT aside AND quality IS NOT NULL"), rows.filter("aside")

    def moments(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        x = _unpacked(batch)[0].astype(float)
        yield "n", np.array([len(x)])
        yield "s", x.sum(0)
        yield "q", (x**2).sum(0)

    got = summed(teaching, moments)
    models = [Linear.zero(got["n"][0], got["s"][part], got["q"][part]) for part in VIEWS]

    def known(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        x, y = _unpacked(batch)
        return [(x[:, part], y) for part in VIEWS]

    models = newton(teaching, models, known, 3.0, 10)
    past: list[Round] = []
    exchanged = []
    for _ in range(rounds if kinds.get((False, None)) else 0):
        now = tuple(models)
        done = list(past)

        def margins(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
            x, y = _unpacked(batch)
            free = handed(x, y >= 0, done)[0]  # noqa: B023
            for k, part in enumerate(VIEWS):
                yield f"m{k}", np.bincount(_bins(now[k].margin(x[free][:, part])), minlength=2 * ENDS * FINE + 1)  # noqa: B023

        counts = summed(rows.filter("quality IS NULL"), margins)
        ends = [cuts(counts[f"m{k}"], low, high, sure) for k in (0, 1)]
        past = [*past, Round(now, (ends[0][0], ends[1][0]), (ends[0][1], ends[1][1]))]
        bounds = [(_bins(np.array([e]))[0]) for pair in ends for e in pair]
        exchanged.append(int(sum(counts[f"m{k}"][: bounds[2 * k] + 1].sum() + counts[f"m{k}"][bounds[2 * k + 1] :].sum() for k in (0, 1))))
        if not exchanged[-1]:
            break
        seen = list(past)

        def taught(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
            x, y = _unpacked(batch)
            own_rows = y >= 0
            out = []
            for part, got_ in zip(VIEWS, handed(x, own_rows, seen)[1], strict=True):  # noqa: B023
                label = np.where(own_rows, y, got_)
                use = label >= 0
                out.append((x[use][:, part], label[use]))
            return out

        models = newton(rows.filter("NOT aside"), models, taught, 3.0, 5)

    views_ = tuple(models)

    def both(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x, y = _unpacked(batch)
        return np.column_stack([v.margin(x[:, part]) for v, part in zip(views_, VIEWS, strict=True)]), y

    def spread(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
        m = both(batch)[0]
        yield "n", np.array([len(m)])
        yield "s", m.sum(0)
        yield "q", (m**2).sum(0)

    def calibrating(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        m, y = both(batch)
        return [(m[:, :1], y), (m[:, 1:], y), (m, y)]

    got = summed(kept, spread)
    ends_ = [Linear.zero(got["n"][0], got["s"][part], got["q"][part]) for part in (slice(0, 1), slice(1, 2), slice(0, 2))]
    first, second, combined = newton(kept, ends_, calibrating, 0.1, 12)
    discard(rows)
    return Model(views_, (first, second), combined, rate, tuple(exchanged))


SCORED = "doc_id long, content double, page double, score double, predicted int"


def _scored(rows: DataFrame, model: Model, threshold: float, vectors: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both, a, b = model.score(vectors(part).astype(np.float32))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "content": a, "page": b, "score": both, "predicted": (both >= threshold).astype(np.int32)})

    return rows.mapInArrow(run, SCORED)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, content, page, score (probabilities of good quality), predicted (1: good) of every row.

    Null columns are features of their own, a null text is read as an empty one; repeated
    rows get equal scores; an empty table gives no rows; other columns are not read.
    """
    return _scored(_read(docs), model, threshold, _vectors)


def score_prepared(views: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """As :func:`score`, of :func:`prepared` rows."""
    return _scored(views, model, threshold, lambda part: np.frombuffer(b"".join(part.column("x").to_pylist()), np.float16).reshape(part.num_rows, -1))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with their columns, whose score reaches the threshold.

    A null or empty text is scored like any other, by its language, source and lengths; repeated
    rows stay or go together; rows without a doc_id are judged too. An empty table gives no rows.
    """
    at = {c: docs.columns.index(c) for c in COLUMNS if c in docs.columns}

    def passed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                view = {c: part.column(i).to_pylist() for c, i in at.items()}
                x = np.stack([features(*(view[c][i] if c in view else None for c in COLUMNS)) for i in range(part.num_rows)])
                yield part.filter(pa.array(model.score(x.astype(np.float32))[0] >= threshold))

    return docs.mapInArrow(passed, docs.schema)
