"""Mixing sources to target weights by balanced (cube) sampling.

A source's target over its size is the mean number of times each of its documents is
taken: a whole part that all of them get, and a fraction that becomes the inclusion
probability of one more take. The fractions move through the null space of the balancing
constraints (document total and token total of the source): the flight holds a few units,
moves one more of them than there are constraints along a null vector until a
probability hits 0 or 1, and replaces the decided unit by the next row. Units of like size
move against each other, so that a move is far and what stays undecided is a mixture of long and short
ones. Each task needs a handful of numbers and leaves as many units undecided as there are
constraints. These few go on to a flight over fewer tasks until one is left, or until the
undecided units of any one source fit a task: then each source is one task's. There the
constraints are dropped one by one, and where a long document leaves the tokens off by more than half a
percent, units decided last, some of every size, change places. That is the landing.
"""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import n_words, spread, stored

EPS = 1e-9
#: Decided units of each power of two that may still change places, and how often they do.
HELD, TURNS = 16, 6


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size) -> target of each source.

    Sources in code point order, null last, get the weights in turn. The total of all
    sizes is shared by weight; a target stops at ``most`` times its source's size and
    what is above is shared again by weight. With the sources in order of most * size /
    weight, those that stop come first: a source stops if its bound lies below its
    share of what the ones before it leave. One row per source, so windows over all
    sources are small.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    bound = F.lit(most) * F.col("source_size")
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double"))
    order = [bound / F.col("weight"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(bound).over(before), F.lit(0.0))
    level = left / F.sum("weight").over(onward)
    shared = weighed.withColumn("level", level).withColumn("stops", bound <= F.col("level") * F.col("weight"))
    # Past the first source that does not stop, the level only falls: that one's is the largest.
    final = F.max(F.when(~F.col("stops"), F.col("level"))).over(whole)
    return shared.select("source", "source_size", F.when(F.col("stops"), bound).otherwise(F.coalesce(final, F.lit(0.0)) * F.col("weight")).alias("target"))


def null_vector(columns: list[tuple[float, ...]]) -> list[float]:
    """A vector u, not all zero, with sum(u[k] * columns[k]) = 0; one column more than rows."""
    rows, n = [list(r) for r in zip(*columns, strict=True)], len(columns)
    pivots: list[int] = []
    at = 0
    for c in range(n):
        best = max(range(at, len(rows)), key=lambda r: abs(rows[r][c]), default=None) if at < len(rows) else None
        if best is None or abs(rows[best][c]) <= 1e-12 * max(1.0, max(map(abs, rows[best]))):
            free = c
            u = [0.0] * n
            u[free] = 1.0
            for r, p in enumerate(pivots):
                u[p] = -rows[r][free]
            return u
        rows[at], rows[best] = rows[best], rows[at]
        top = [x / rows[at][c] for x in rows[at]]
        rows[at] = top
        for r in range(len(rows)):
            if r != at and rows[r][c]:
                f = rows[r][c]
                rows[r] = [x - f * y for x, y in zip(rows[r], top, strict=True)]
        pivots.append(c)
        at += 1
    raise ArithmeticError("no free column")


def _power(size: float) -> int:
    return int(size).bit_length()


class Flight:
    """Flight phase over a stream of units (payload, probability, balancing values).

    ``pool`` undecided units are held. Each move takes one more of them than there are
    constraints, those next to each other in the first balancing value whose values are
    most alike, out of the power of two that holds most units: they decide each other by small moves.
    """

    def __init__(self, seed: str, pool: int = 24):
        self.random = random.Random(int.from_bytes(hashlib.blake2b(seed.encode(), digest_size=8).digest(), "big"))
        self.pool, self.active, self.held = pool, [], {}
        #: Promised less given, of every balancing value; the first promise.
        self.owed, self.total = None, 0.0

    def push(self, payload, p: float, values: tuple[float, ...]) -> list[tuple]:
        """Units decided for good by this one: (payload, 0 or 1)."""
        self.active.append([payload, p, values])
        self.total += p * values[0]
        self.owed = [o + p * v for o, v in zip(self.owed or [0.0] * len(values), values, strict=True)]
        return self._move(len(values)) if len(self.active) > max(self.pool, len(values)) else []

    def settle(self) -> list[tuple]:
        """Move until no more units than constraints are undecided."""
        out: list[tuple] = []
        while self.active and len(self.active) > len(self.active[0][2]):
            out += self._move(len(self.active[0][2]))
        return out + self._free()

    def _free(self) -> list[tuple]:
        out = [(payload, s) for own in self.held.values() for payload, s, _ in own]
        self.held = {}
        return out

    def _decide(self, payload, s: int, values: tuple[float, ...]) -> list[tuple]:
        """Hold a decided unit; the one held longest of its power of two goes where there are too many."""
        self.owed = [o - s * v for o, v in zip(self.owed, values, strict=True)]
        own = self.held.setdefault((_power(values[0]), s), [])
        own.append((payload, s, values))
        return [own.pop(0)[:2]] if len(own) > HELD // 2 else []

    def _move(self, constraints: int) -> list[tuple]:
        self.active.sort(key=lambda x: x[2])
        held = Counter(_power(x[2][0]) for x in self.active)
        # Most units of one power of two first; then the most alike, one of those drawn.
        windows = [(-held[_power(a[2][0])] if _power(a[2][0]) == _power(b[2][0]) else 0, (b[2][0] + 1) / (a[2][0] + 1)) for a, b in zip(self.active, self.active[constraints:], strict=False)]
        crowd, alike = min(windows)
        at = self.random.choice([i for i, (c, r) in enumerate(windows) if c == crowd and r <= 1.1 * alike])
        own = self.active[at : at + constraints + 1]
        u = null_vector([x[2][:constraints] for x in own]) if constraints else [1.0]
        moving = [(x, d) for x, d in zip(own, u, strict=True) if abs(d) > 1e-14]
        up = min((1 - x[1]) / d if d > 0 else -x[1] / d for x, d in moving)
        down = min(x[1] / d if d > 0 else (x[1] - 1) / d for x, d in moving)
        step = up if self.random.random() * (up + down) < down else -down
        for x, d in moving:
            x[1] += step * d
        done = [x for x in own if x[1] < EPS or x[1] > 1 - EPS]
        self.active = [x for x in self.active if EPS <= x[1] <= 1 - EPS]
        return [unit for payload, p, values in done for unit in self._decide(payload, int(p > 0.5), values)]

    def land(self) -> list[tuple]:
        """Decide all: move on, drop the last constraint, move, and so on; then changes of places."""
        out: list[tuple] = []
        while self.active:
            out += self._move(min(len(self.active) - 1, len(self.active[0][2])))
        self._change_places()
        return out + self._free()

    def _change_places(self) -> None:
        """While the first value is owed or overdrawn by more than half a percent: exchange a taken unit for one
        that is not, or turn one, so that it comes near, or as near as it can; of all that do, one is drawn."""
        units = [u for own in self.held.values() for u in own]
        if not units:
            return
        size, taken = np.array([u[2][0] for u in units]), np.array([u[1] for u in units])
        near = self.total / 200
        for _ in range(TURNS):
            owed = self.owed[0]
            if abs(owed) <= near:
                break
            ins, outs = np.flatnonzero(taken == 0), np.flatnonzero(taken == 1)
            # An exchange leaves the number of units; a turn is tried where no exchange comes near.
            miss = np.abs(owed - (size[ins][:, None] - size[outs]))
            alone = np.abs(owed - (1 - 2 * taken) * size)
            if miss.size and miss.min() <= max(near, alone.min()):
                i, j = np.nonzero(miss <= max(near, miss.min()))
                k = self.random.randrange(len(i))
                missed, turned = miss[i[k], j[k]], (ins[i[k]], outs[j[k]])
            else:
                turned = (self.random.choice(np.flatnonzero(alone <= max(near, alone.min())).tolist()),)
                missed = alone[turned[0]]
            if missed >= abs(owed) - EPS:
                break
            for k in turned:
                sign = 1 - 2 * int(taken[k])
                self.owed = [o - sign * v for o, v in zip(self.owed, units[k][2], strict=True)]
                taken[k] = 1 - taken[k]
        self.held = {}
        for (payload, _, values), s in zip(units, taken.tolist(), strict=True):
            self.held.setdefault((_power(values[0]), s), []).append((payload, s, values))


UNIT = "doc_id long, size long, source string, n long, source_size long, target double, p double, taken int"


def _level(units: DataFrame, tasks: int, last: bool, seed: str, key: str = "h") -> DataFrame:
    """One flight over ``tasks`` tasks, dealt by ``key``; ``taken`` stays null where a unit is undecided."""

    def fly(batches):
        flight, source, began = None, None, False
        out: list[tuple] = []

        def leave():
            if flight is None:
                return
            if last:
                out.extend((*r[:6], 1.0 * s, s) for r, s in flight.land())
            else:
                out.extend((*r[:6], 1.0 * s, s) for r, s in flight.settle())
                out.extend((*r[:6], p, None) for r, p, _ in flight.active)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not began or row[2] != source:
                    leave()
                    source, began = row[2], True
                    flight = Flight(f"{seed}|{source}|{row[0]}|{row[1]}")
                # Balancing values: documents first, tokens second; the landing drops the last first.
                out.extend((*r[:6], 1.0 * s, s) for r, s in flight.push(row, row[6], (float(row[1] * row[3]), float(row[3]))))
            if out:
                yield _units(out)
                out.clear()
        leave()
        if out:
            yield _units(out)

    dealt = units.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "source"))
    dealt = dealt.repartition(tasks, key).sortWithinPartitions("source", F.floor(F.log2(F.col("size") + 1)).desc(), "h", "doc_id", "size")
    return dealt.select("doc_id", "size", "source", "n", "source_size", "target", "p").mapInArrow(fly, UNIT)


def _units(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32())
    names = [f.split()[0] for f in UNIT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def shares(docs: DataFrame, seed: str = "mix", rows_per_task: int = 50_000, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(doc_id, size, source, n, source_size, target, copies): how often each document is taken.

    Rows that agree in doc_id, source and size are one unit of ``n`` rows with one
    decision. A null text has size 0, a null source is a source of its own. The result
    depends on the rows and ``seed`` alone, so that reruns agree.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words("text").alias("size"), F.col("source").cast("string").alias("source"))
    sized = stored(sized.groupBy("doc_id", "size", "source").agg(F.count("*").alias("n")), "sized")
    aims = stored(targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most), "aims")
    units = sized.join(aims.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.withColumn("rate", rate).withColumn("base", F.floor(F.col("rate") + EPS).cast("int"))
    units = units.withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    fixed = F.col("p") < EPS
    done = [units.filter(fixed).withColumn("taken", F.lit(0))]
    left = units.filter(~fixed)
    rows, level, whole = sized.count(), 0, False
    while True:
        tasks = spread(docs.sparkSession, rows, rows_per_task)
        last = whole or tasks == 1
        flown = stored(_level(left, tasks, last, f"{seed}{level}", "source" if whole else "h"), "flight")
        done.append(flown.filter("taken IS NOT NULL"))
        if last:
            break
        left, level = flown.filter("taken IS NULL"), level + 1
        before = rows
        rows, largest = left.groupBy("source").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
        # With many sources each keeps its two units a task, so that no number of levels would leave one task.
        whole = largest <= rows_per_task or rows >= before
    names = ["doc_id", "size", "source", "n", "source_size", "target", "taken"]
    out = done[0].select(*names)
    for d in done[1:]:
        out = out.union(d.select(*names))
    base = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) + EPS)
    return out.select(*names[:-1], (base + F.col("taken")).cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (its source's), copies, taken (words).

    Empty tables give no rows; other columns are not read.
    """
    units = shares(docs, **options)
    rows = units.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns."""
    units = shares(docs, **options).filter("copies > 0")
    d = docs.withColumns({"__size": n_words("text")})
    flat = units.select(F.col("doc_id").alias("__d"), F.col("size").alias("__n"), F.col("source").alias("__s"), F.col("copies").alias("__copies"))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.col("__size") == F.col("__n")) & F.col("source").cast("string").eqNullSafe(F.col("__s"))
    return d.join(flat, match).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)
