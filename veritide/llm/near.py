"""Near-duplicates by exact Jaccard similarity of word shingles, for stages that no fingerprint contract binds.

1. A set a document: the XXH64 values of its five-word shingles. Equal sets are one node from here on.
2. Candidates by SimHash: the sets' fingerprints, majorities of their hashes, are probed and linked as in ``simhash.py``, within its radius.
   Sets of similarity 0.8 differ in 9.7 bits on average, and a radius of 17 or so, which would find them all, probes nothing apart.
   So candidates come by MinHash as well: ``BANDS`` bands of ``ROWS`` minima. Two sets of similarity 0.8 share no band with a chance of
   (1 - 0.8^4)^40 < 1e-9. Sets of little in common share bands too, and in a corpus of templates such bands would chain all of it into
   one component. So the nodes of a band are told apart by sketches of ``SKETCH`` bytes, and only those that agree in ``AGREE`` of them
   are candidates: sets of similarity 0.8 fail with a chance below 1e-7, sets of 0.3 pass with one below 1e-12. A band whose nodes
   another band has as well is looked at once. Each node of a band's candidates is tied to the least that they reach, so bands of the same copies
   send on much the same links.
3. Within a component of candidates sets are compared exactly. What is linked already is not compared again, and only a spanning
   forest is sent on. Components above ``BLOCK`` texts or ``BLOCK_BYTES`` are cut into blocks that meet in pairs, spread over all tasks.
4. Components over the verified links alone.

Defined cases: texts without words have the empty set and are one node; fewer words than a shingle: one shingle of them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tasks, tidy
from .simhash import SEED, components, hashes, keep_one, majority, plan, spanning
from .simhash import links as within_radius

SHINGLE, BANDS, ROWS, BLOCK, BLOCK_BYTES = 5, 40, 4, 2048, 16 << 20
#: Bytes of a sketch (the last byte of so many minima), and in how many of them sets agree that may be similar enough.
SKETCH, AGREE = 128, 77
#: Similarity of at least FOUR fifths.
FOUR, FIFTHS = 4, 5
_r = np.random.default_rng(20240601)
_MULTIPLY = (_r.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_MIX = _r.integers(0, 1 << 62, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _r.integers(0, 1 << 62, BANDS, dtype=np.uint64)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, hashes(text, shingle))]))


def bands(h: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band of minima, and a sketch of them."""
    high = (h >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(high), 2048):
        np.minimum(low, (_MULTIPLY * high[k : k + 2048]).min(1), out=low)
    x = (low.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64) + _BAND
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9), low[:SKETCH].astype(np.uint8).tobytes()


def alike(sketches: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of sketches that agree enough. What is linked already is not compared again."""
    left, one, two, queue = np.arange(len(sketches)), [], [], []
    while len(left) or queue:
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        u = queue.pop()
        near = (sketches[left] == sketches[u]).sum(1) >= AGREE
        if near.any():
            found = left[near].tolist()
            one += [u] * len(found)
            two += found
            queue += found
            left = left[~near]
    return one, two


def verified(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of sets that are similar enough; none of the sets is empty."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    place = np.split(flat, np.cumsum(size)[:-1])
    mark = np.zeros(len(names), np.int32)
    left, one, two = np.arange(len(sets)), [], []
    start, queue = np.cumsum(size) - size, []
    while len(left) or queue:
        if not queue:
            queue.append(int(left[0]))
            start, flat, left = start[1:] - size[left[0]], flat[size[left[0]] :], left[1:]
        u = queue.pop()
        if not len(left):
            continue
        mark[place[u]] = 1
        common = np.add.reduceat(mark[flat], start)
        mark[place[u]] = 0
        near = (FOUR + FIFTHS) * common >= FOUR * (size[left] + size[u])
        if near.any():
            found = left[near].tolist()
            one += [u] * len(found)
            two += found
            queue += found
            flat, left = flat[np.repeat(~near, size[left])], left[~near]
            start = np.cumsum(size[left]) - size[left]
    return one, two


def _prints(docs: DataFrame, text: str) -> DataFrame:
    """docs with ``_node`` (the hash of the set), ``_fp`` (its fingerprint), ``_bands`` and ``_sketch`` instead of the text."""
    names = [c for c in docs.columns if c != text]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, keys, sketches = [], [], [], []
            for t in batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()):
                h = shingles(t.as_py())
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                fps.append(majority([h]))
                key, sketch = bands(h)
                keys.append(key.view(np.int64))
                sketches.append(sketch)
            node, fp = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), node, fp, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=[*names, "_node", "_fp", "_bands", "_sketch"])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "_node long, _fp long, _bands array<long>, _sketch binary"]))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each key (the last so many columns), which follow each other."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return (list(own) for _, own in groupby(rows, key=lambda r: r[-keys:]))


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): nodes (_node, _fp) whose fingerprints are within the radius, tied to the least node of a fingerprint."""
    told = materialise(nodes.groupBy("_fp").agg(F.min("_node").alias("least")), "fingerprints")
    found = within_radius(told.select("_fp"), *plan(told.select("_fp")))
    side = lambda c: told.select(F.col("_fp").alias(c), F.col("least").alias(f"_{c}"))
    apart = found.join(side("a"), "a").join(side("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    same = nodes.join(told.withColumnRenamed("_fp", "f"), F.col("_fp") == F.col("f")).where("_node <> least").select(F.col("_node").alias("a"), F.col("least").alias("b"))
    return apart.unionByName(same)


def candidates(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, label): the nodes that may be similar enough to another, in components of such links.

    Nodes near by fingerprint, and those of a band that are alike by sketch; nodes of a band are compared in blocks of bounded size, which meet in pairs.
    """
    nodes = prints.groupBy("_node").agg(F.first("_fp").alias("_fp"), F.first("_bands").alias("b"), F.first("_sketch").alias("sketch"))
    keys = nodes.select("_node", F.explode("b").alias("key"))
    told = [F.bit_xor(F.xxhash64(F.lit(k), "_node")).alias(f"x{k}") for k in range(2)]
    buckets = keys.groupBy("key").agg(F.min("_node").alias("least"), F.count("*").alias("n"), *told).where("n > 1")
    #: Copies that differ little share most bands with each other and nobody else: one of these bands is enough.
    once = buckets.groupBy("least", "n", "x0", "x1").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / block).alias("blocks"))
    tied = materialise(keys.join(once, "key"), "tied")
    met = (
        tied.join(nodes.select(F.col("_node").alias("node"), "sketch"), F.col("_node") == F.col("node"))
        .withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("node", "sketch", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )
    by = ["key", "low", "high"]
    met = met.repartition(tasks(prints.sparkSession), *by).sortWithinPartitions(*by, "node")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches, 3):
            one, two = alike(np.frombuffer(b"".join(r[1] for r in own), np.uint8).reshape(len(own), SKETCH))
            if one:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in spanning(np.array([r[0] for r in own], np.int64), np.array(one), np.array(two))], names=["a", "b"])

    found = by_fingerprint(nodes.select("_node", "_fp")).unionByName(met.mapInArrow(run, "a long, b long")).distinct()
    #: A node keeps the least that it is tied to, and what else it is tied to is tied to that: few links, which many nodes share.
    least = materialise(found.withColumn("least", F.min("b").over(Window.partitionBy("a"))), "tied")
    return components(least.select("a", F.col("least").alias("b")).unionAll(least.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))).distinct())


def links(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): verified links among sets (node, label, text) of a label that connect all that are similar enough."""
    size = F.greatest(F.count("*") / block, F.sum(F.octet_length("text")) / F.lit(BLOCK_BYTES))
    counts = sets.groupBy("label").agg(F.greatest(F.lit(1), F.ceil(size)).alias("blocks")).withColumnRenamed("label", "l")
    met = (
        sets.join(counts, F.col("label") == F.col("l"))
        .withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("node", "label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "text")
    )
    key = ["label", "low", "high"]
    met = met.repartition(tasks(sets.sparkSession), *key).sortWithinPartitions(*key, "node")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, held = None, [], []

        def answer() -> pa.RecordBatch:
            one, two = verified(held) if len(held) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in x], pa.int64()) for x in (one, two)], names=["a", "b"])

        for batch in batches:
            rows = [c.to_pylist() for c in batch.columns[:4]]
            for node, where, t in zip(rows[0], zip(*rows[1:], strict=True), batch.column(4).cast(pa.large_binary()), strict=True):
                if where != at:
                    if held:
                        yield answer()
                    at, nodes, held = where, [], []
                nodes.append(node)
                held.append(shingles(t.as_py()))
        if held:
            yield answer()

    return met.mapInArrow(run, "a long, b long")


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """docs, whole, with one row of each group of near copies: that of smallest id."""

    def labelled(rows: DataFrame) -> DataFrame:
        prints = materialise(_prints(rows, "text"), "shingles")
        found = candidates(prints, block)
        #: One row stands for each candidate node; only these rows' texts are read again.
        stand = prints.groupBy("_node").agg(F.min("_row").alias("_stands")).join(found, F.col("_node") == F.col("node")).select("node", "label", "_stands")
        texts = rows.join(stand, F.col("_row") == F.col("_stands")).groupBy("node", "label").agg(F.first("text").alias("text"))
        linked = components(links(texts, block))
        #: A node of many exact copies is split by a merge join, and by no other.
        return prints.drop("_fp", "_bands", "_sketch").join(linked.hint("merge"), F.col("_node") == F.col("node"), "left").select("_id", "_row", F.coalesce("label", "_node").alias("_label"))

    return keep_one(docs, labelled, text, doc_id)
