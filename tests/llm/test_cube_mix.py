import random

import pytest
from pyspark.sql import functions as F

from lacuna.llm import cube_mix


def _filled(sizes, weights=(1, 2, 3), most=3.0):
    """Targets by sharing the excess again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 50, None: 400, "d": 0}, {"a": 5}, {"x": 1, "y": 1, "z": 100000}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in cube_mix.targets(frame).collect()}
    want = _filled(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_null_vector():
    rng = random.Random(1)
    for rows in (1, 2, 3):
        columns = [tuple(rng.choice([0.0, 1.0, rng.uniform(0, 900)]) for _ in range(rows)) for _ in range(rows + 1)]
        u = cube_mix.null_vector(columns)
        assert any(u) and all(abs(sum(x * c[r] for x, c in zip(u, columns, strict=True))) < 1e-6 * max(map(abs, u)) * 1000 for r in range(rows))


def test_flight_is_balanced_and_unbiased():
    rng = random.Random(2)
    sizes = [rng.choice([1, 5, 30, 400, 3000]) for _ in range(300)]
    taken = [0] * 300
    for run in range(200):
        flight = cube_mix.Flight(str(run))
        done = []
        for i, n in enumerate(sizes):
            done += flight.push(i, 0.3, (float(n), 1.0))
        done += flight.land()
        assert sorted(i for i, _ in done) == list(range(300))
        assert abs(sum(s for _, s in done) - 90) <= 2
        for i, s in done:
            taken[i] += s
    assert abs(sum(taken) / 200 / 300 - 0.3) < 0.01
    assert max(abs(t / 200 - 0.3) for t in taken) < 0.15


def test_mix_of_all_documents(docs):
    rows = cube_mix.mix(docs).toPandas()
    assert len(rows) == docs.count()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.select("doc_id", "text").collect()}
    assert dict(zip(rows.doc_id, rows["size"], strict=True)) == words
    assert (rows.taken <= 3 * rows["size"]).all() and (rows.taken == rows.copies * rows["size"]).all()
    for _, own in rows.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()
    again = cube_mix.mix(docs).toPandas()
    order = ["doc_id", "taken"]
    assert rows.sort_values(order)[order].reset_index(drop=True).equals(again.sort_values(order)[order].reset_index(drop=True))


def test_many_tasks_land_together(docs):
    rows = cube_mix.mix(docs, rows_per_task=40).toPandas()
    for _, own in rows.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()


def test_more_sources_than_a_task_has_rows(spark):
    """Every source keeps undecided units at each level: the levels end all the same."""
    rng = random.Random(3)
    rows = [(d, "w " * rng.randint(1, 40), f"site{d % 90:02}") for d in range(360)]
    got = cube_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows_per_task=40).toPandas()
    assert sorted(got.doc_id) == list(range(360))
    for _, own in got.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= own["size"].max()


def test_mixed_repeats_rows(docs, odd, none):
    copies = {r.doc_id: r.copies for r in cube_mix.mix(docs).collect()}
    got = {r.doc_id: r["count"] for r in cube_mix.mixed(docs).groupBy("doc_id").count().collect()}
    assert got == {d: c for d, c in copies.items() if c}
    assert cube_mix.mix(odd).count() == odd.count()
    assert cube_mix.mixed(odd).columns == odd.columns
    assert cube_mix.mixed(odd).count() == cube_mix.mix(odd).agg(F.sum("copies")).first()[0]
    assert cube_mix.mix(none).count() == 0 and cube_mix.mixed(none).count() == 0


def test_taken_words_come_near_every_target(spark):
    """A source may hold a document of a third of its words: units of every size then change places."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = cube_mix.mix(docs).toPandas()
    for _, own in rows.groupby("source"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= max(0.01 * own.target.iloc[0], own["size"].min())


def test_a_long_document_is_made_up_for():
    sizes = [4000, *range(20, 420, 4)]
    for run in range(30):
        flight, done = cube_mix.Flight(str(run)), []
        for i, n in enumerate(sizes):
            done += flight.push(i, 0.4, (float(n), 1.0))
        done += flight.land()
        assert sorted(i for i, _ in done) == list(range(len(sizes)))
        assert abs(sum(sizes[i] * s for i, s in done) - 0.4 * sum(sizes)) <= 0.01 * 0.4 * sum(sizes)
        assert abs(sum(s for _, s in done) - 0.4 * len(sizes)) <= 12
