"""Shared helpers: tables, stored intermediates, words, components."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.session import fresh_path

DEFAULT_TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` frame that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def word_bytes(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; none for null."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def n_words(text: Column | str) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.filter(F.split(c, "[ \\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def remainder(doc_id: int | None, modulus: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a few hundred made at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def spread(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows``, at least one."""
    return max(1, -(-rows // per_task))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as rows (a, b).

    Alternates large-star and small-star steps, each a minimum by node and a join, until
    the links stand still; every node then points at the smallest node of its component.
    Minima are combined on the map side, so a hub with very many links is no single
    task's work. Returns (node, component) for the nodes that have a link to another;
    an empty graph gives an empty frame.
    """
    now = stored(_ordered(edges.select("a", "b")), "links")
    mark = _mark(now)
    while mark[0]:
        after = stored(_small_star(_large_star(now)), "links")
        discard(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _ordered(edges: DataFrame) -> DataFrame:
    """Links as (larger, smaller), each once."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return _ordered(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))
