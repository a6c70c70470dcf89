import corpus_pipeline
from lacuna.llm import queries
from lacuna.llm.common import components, stored
from tests_llm_helpers import reached


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"  # large enough to learn the toxic words from its labels
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        before, frame = frame, stored(stage(spark, frame, sf), "stage")
        held[name] = frame.count()
        if name != "pack":
            assert frame.columns == docs.columns and dict(frame.dtypes) == dict(docs.dtypes)
        if name in ("quality", "toxicity", "near duplicates"):
            assert 0.5 * before.count() < held[name] < before.count()
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() == held["pack"]
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)


def test_empty_documents(spark, none, sf):
    frame = none
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf)
        assert frame.count() == 0


def test_every_operator_is_registered():
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 11)] == [1] * 10


def test_components(spark):
    links = [(1, 2), (2, 3), (4, 5), (9, 9), (6, 5), (3, 1), *((100, k) for k in range(101, 160)), *((k, k + 1) for k in range(200, 230))]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == reached(links)
