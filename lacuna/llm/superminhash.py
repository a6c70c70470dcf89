"""Near-duplicates by SuperMinHash signatures, banding, verification and components.

SuperMinHash walks one random permutation of the signature's slots per element: at step j
the element offers the value j + r to its j-th slot. Slots of one element are thereby
correlated (it never offers to a slot twice), which lowers the variance against
independent hashes, and once every slot holds a value below j + 1 no later step can lower
any, so a document stops early; long texts need one or two steps.

Texts with the same shingle set are one node. Nodes that agree in a band share a bucket.
A bucket does not emit its pairs: every member is compared with the bucket's smallest
node, links are confirmed on full shingle sets, and components are formed. Only buckets
that still hold more than one component go on: once with another, random pivot, and then
members outside the bucket's largest component with members of other components, as far as
the rarest shingle that both have, and their sizes, allow a link. No pair of a bucket that
could join two components is left out. With 32 bands of 5
slots, two texts at a similarity of 0.8 share no bucket with a probability of 3e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import components, rows_of, stored, word_bytes

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOW = np.uint64(0xFFFFFFFF)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
        return x ^ (x >> np.uint64(31))


def signatures(elements: np.ndarray, sizes: np.ndarray, slots: int) -> np.ndarray:
    """SuperMinHash signatures (one row of ``slots`` values per document).

    ``elements`` holds the documents' element hashes one after another, ``sizes`` how many
    each has (at least 1). A value is j in the upper half, r in the lower half.
    """
    docs = len(sizes)
    least = np.full(docs * slots, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(docs), sizes)
    alive, order = np.arange(len(elements)), None
    for j in range(slots):
        with np.errstate(over="ignore"):
            x = scramble(elements[alive] + np.uint64(j + 1) * GOLDEN)
        k = j + (((x >> np.uint64(32)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            if order is None:
                order = np.tile(np.arange(slots, dtype=np.int16), (len(alive), 1))
                own = np.arange(len(alive))
                order[own, first] = 0  # the swap of step 0
                order[own, 0] = first
            own = np.arange(len(alive))
            slot = order[own, k].astype(np.int64)
            order[own, k] = order[own, j]
        np.minimum.at(least, owner[alive] * slots + slot, np.uint64(j) << np.uint64(32) | x & LOW)
        done = least.reshape(docs, slots).max(1) < np.uint64(j + 1) << np.uint64(32)
        if done.all():
            break
        going = ~done[owner[alive]]
        if j == 0:
            alive, first = alive[going], k[going]
        elif going.mean() < 0.7:
            alive, order = alive[going], order[going]
    return least.reshape(docs, slots)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per document and band."""
    docs, slots = signature.shape
    parts = signature.reshape(docs, bands, slots // bands)
    with np.errstate(over="ignore"):
        key = scramble(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN, (docs, bands)).copy())
        for i in range(parts.shape[2]):
            key = scramble(key * np.uint64(3) ^ parts[:, :, i])
    return key.view(np.int64)


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, remembered: int = 300_000):
        super().__init__()
        self.remembered = remembered

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.remembered:
            self[word] = h
        return h


_HASHES = WordHashes()


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; with fewer words the whole sequence is one."""
    words = word_bytes(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    with np.errstate(over="ignore"):
        acc = np.full(n, np.uint64(min(width, len(h))) * GOLDEN)
        for i in range(min(width, len(h))):
            acc = scramble(acc * np.uint64(3) ^ h[i : i + n])
    return np.unique(acc)


PROFILE = "doc_id long, n_shingles long, node binary, bands array<long>"


def profiles(docs: DataFrame, width: int, bands: int, rows: int, elements: int = 16_384, memo: int = 8192) -> DataFrame:
    """Set size, set fingerprint and band keys of every document."""
    import xxhash

    def profiled(batches):
        known: dict[bytes, np.ndarray] = {}

        def flush(held):
            fresh = {node: s for _, s, node in held if node is not None and node not in known}
            if fresh:
                sets = list(fresh.values())
                keys = band_keys(signatures(np.concatenate(sets), np.array([len(s) for s in sets]), bands * rows), bands)
                if len(known) > memo:
                    known.clear()
                known.update(zip(fresh, keys, strict=True))
            found = [known.get(node) if node is not None else None for _, _, node in held]
            return pa.RecordBatch.from_pydict({
                "doc_id": pa.array([d for d, _, _ in held], pa.int64()),
                "n_shingles": pa.array([len(s) for _, s, _ in held], pa.int64()),
                "node": pa.array([node for _, _, node in held], pa.binary()),
                "bands": pa.array([None if k is None else k.tolist() for k in found], pa.list_(pa.int64())),
            })

        held, n = [], 0
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            own = shingle_set(text, width)
            node = xxhash.xxh3_128_digest(own.tobytes()) if len(own) and doc_id is not None else None
            held.append((doc_id, own, node))
            n += len(own)
            if n >= elements or len(held) >= 1024:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(profiled, PROFILE)


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Full shingle sets of the wanted nodes, each from the document that stands for it."""

    def listed(batches):
        for doc_id, text, node in rows_of(batches, "doc_id", "text", "node"):
            import xxhash

            own = shingle_set(text, width)
            if xxhash.xxh3_128_digest(own.tobytes()) == node:
                yield pa.RecordBatch.from_pydict({"node": pa.array([node], pa.binary()), "shingles": pa.array([own.view(np.int64)], pa.list_(pa.int64()))})

    own = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text")
    made = own.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "text", "node")
    return made.mapInArrow(listed, "node binary, shingles array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return pairs.select("a", "b").join(left, "a").join(right, "b").filter(both * 100 >= union * percent).select("a", "b")


def _possible(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs that their set sizes do not rule out, each once as (larger, smaller) node."""
    sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    return pairs.filter((F.col("a") != F.col("b")) & sizes).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _rest(outside: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of two components that can still be links, one of them outside its bucket's largest component.

    All shingles of the members are put in one order, rare ones first. If the first
    shingle that two sets share is number i in one and j in the other, they share at most
    na - i + 1 and nb - j + 1; a link needs 100 * shared >= percent * (na + nb - shared).
    Variants of one text differ in rare shingles, so few pairs pass. A shingle meets the
    sizes of the sets that have it first, then only the sets of sizes that pass.
    """
    own = outside.groupBy("node").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.max(F.col("comp") != F.col("main")).alias("few"))
    rows = sets.join(own, "node").select("node", "n", "comp", "few", F.explode("shingles").alias("x"))
    shared = rows.groupBy("x").agg(F.count("*").alias("k")).filter("k > 1")
    by = Window.partitionBy("node")
    # Shingles that no other member has come first, and need no row.
    place = F.col("n") - F.count("*").over(by) + F.row_number().over(by.orderBy("k", "x"))
    ranked = rows.join(shared, "x").withColumn("top", F.col("n") - place + 1).filter(F.col("top") * 100 >= F.col("n") * percent)
    ranked = stored(ranked.select("x", "node", "n", "comp", "few", "top"), "ranked")

    def passes(top, na, nb):
        return (top * (100 + percent) >= (na + nb) * percent) & (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)

    few = ranked.filter("few").select("x", F.col("node").alias("a"), F.col("n").alias("na"), F.col("top").alias("ta"), F.col("comp").alias("ca"))
    sizes = ranked.groupBy("x", F.col("n").alias("nb")).agg(F.max("top").alias("most"))
    met = few.join(sizes, "x").filter(passes(F.least("ta", "most"), F.col("na"), F.col("nb"))).drop("most")
    every = ranked.select("x", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("top").alias("tb"), F.col("comp").alias("cb"))
    return met.join(every, ["x", "nb"]).filter((F.col("ca") != F.col("cb")) & passes(F.least("ta", "tb"), F.col("na"), F.col("nb")))


def _labelled(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    A document without words, with a null text or a null doc_id links with nothing: its
    component is its own doc_id and it is kept. Repeated rows share a component, and a
    component of one doc_id alone is kept in each of its rows. Other columns are not read.
    """
    every = stored(profiles(docs, width, bands, rows), "profiles")
    nodes = stored(
        every.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes"
    )
    in_bucket = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = in_bucket.groupBy("key").agg(F.min(F.struct("node", "n")).alias("pivot"), F.max("node").alias("last")).filter("pivot.node <> last")
    members = stored(in_bucket.join(shared.drop("last"), "key"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "rep"), "node")
    sets = stored(_sets(docs, wanted, width), "sets")

    first = stored(_possible(members.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("pivot.node").alias("b"), F.col("pivot.n").alias("nb")), percent), "pairs")
    links = stored(_verified(first, sets, percent), "links")
    comps = components(links)

    # Another pivot for the buckets that hold several components.
    open_ = _labelled(members, comps)
    mixed = open_.groupBy("key").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node", "n", "comp")).alias("other"),
    ).filter("lo <> hi")
    again = open_.drop("pivot").join(mixed.select("key", "other"), "key").filter("comp <> other.comp")
    second = _possible(again.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("other.node").alias("b"), F.col("other.n").alias("nb")), percent)
    second = stored(second.join(first, ["a", "b"], "left_anti"), "pairs")
    links = stored(links.union(_verified(second, sets, percent)), "links")
    comps = components(links)

    # What is left: members outside the largest component of their bucket with the others.
    open_ = _labelled(members.drop("pivot"), comps)
    parts = open_.groupBy("key", "comp").agg(F.count("*").alias("rows"))
    largest = parts.groupBy("key").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    outside = stored(open_.join(largest.select("key", "main"), "key"), "outside")
    third = stored(_possible(_rest(outside, sets, percent), percent).join(first.union(second), ["a", "b"], "left_anti"), "pairs")
    links = stored(links.union(_verified(third, sets, percent)), "links")
    comps = components(links)

    smallest = comps.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least"))
    labels = nodes.select("node", "rep").join(comps, "node", "left").join(smallest, "component", "left")
    labels = labels.select("node", F.coalesce("least", "rep").alias("label"))
    out = every.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    component = F.coalesce("label", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group of near-duplicates.

    Of repeated rows with one doc_id one stays; rows without a doc_id all stay.
    """
    ids = near_duplicates(docs, **options).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept")).distinct()
    some = docs.join(ids, F.col("doc_id").cast("long") == F.col("__kept"), "left_semi")
    # A group by doc_id of whole rows only where there are repeated ones.
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        some = some.dropDuplicates(["doc_id"])
    return some.unionByName(docs.filter("doc_id IS NULL"))
