"""Near-duplicates by SimHash, probed by the generalised pigeonhole principle.

1. A fingerprint a document: 64 bits, each the majority over the XXH64 values of the text's three-word shingles.
2. Distinct fingerprints only from here on, so exact copies cost nothing.
3. Bits that go together are grouped into partitions. With thresholds t_i that add up to (radius - partitions + 1), two
   fingerprints within the radius differ by at most t_i bits in some partition i. A dynamic programme chooses the
   thresholds (and how many partitions) that cost least by the counts of values over all fingerprints.
4. Each fingerprint is dealt to a bucket for its value in each partition, and to those of the values within t_i bits.
   A bucket's fingerprints are verified by exact Hamming distance; of its links only a spanning forest is sent on, so
   the number of links stays below that of fingerprints. A bucket above ``BLOCK`` is cut into blocks that meet in pairs
   of blocks, spread over all tasks.
5. Components over the links: labels go to neighbours and jump along labels until none moves, with a stored table a round.

Defined cases: null, empty or blank text has fingerprint 0, linked like any other; fewer words than a shingle: one shingle
of them all; a very long text is hashed run by run; a null id never is a component's id unless there is no other; repeated rows stay
rows of their own; an empty table gives no rows.
Extra columns are kept (own columns replace any of the same name).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carry, materialise, quoted, shielded, tidy

BITS, RADIUS, SHINGLE, SEED = 64, 3, 3, 42
#: The most fingerprints that are compared with each other in one step of a task.
BLOCK = 4096
#: Fixed: the bytes of A-Z to a-z.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ADDED = ("fingerprint", "component_id")
#: Bytes in a run of a long text.
RUN = 1 << 20
_SPACE = re.compile(rb"[\x09-\x0d\x20]")


def word_runs(text: bytes, keep: int) -> Iterator[list[bytes]]:
    """A text's words, A-Z lower-cased, in runs of about ``RUN`` bytes, each led by the last ``keep`` words before it."""
    low, at, last = text.translate(LOWER), 0, []
    while at < len(low):
        cut = _SPACE.search(low, at + RUN) if at + RUN < len(low) else None
        end = cut.end() if cut else len(low)
        words = last + low[at:end].split()
        yield words
        last, at = words[max(0, len(words) - keep) :] if keep else [], end


def hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 values of a text's shingles, repeats included, run by run; of fewer words than a shingle, one value of them all."""
    digest, few, words = xxhash.xxh64_intdigest, True, []
    for words in word_runs(text or b"", shingle - 1):
        if len(words) < shingle:
            continue
        few, joined = False, b" ".join(words)
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.concatenate([[0], end[:-1] + 1])
        h = [digest(joined[a:b], SEED) for a, b in zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)]
        yield np.array(h, dtype=np.uint64)
    if few and words:
        yield np.array([digest(b" ".join(words), SEED)], np.uint64)


def majority(runs: Iterable[np.ndarray]) -> int:
    """The bits that over half of all hashes have set."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in runs:
        for k in range(0, len(h), 65536):
            ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with ``_fp`` (the fingerprint as a signed long) instead of the text."""
    names = [c for c in docs.columns if c != text]
    into = T.StructType([*(docs.schema[c] for c in names), T.StructField("_fp", T.LongType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(fp.view(np.int64))], names=[*names, "_fp"])

    return docs.mapInArrow(run, into)


def correlated_groups(gram: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of (nearly) equal size; each next bit is the one that goes most with its group."""
    mean = np.diag(gram) / max(n, 1)
    cov = gram / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        start = max(free, key=lambda b: (corr[b, list(free)].sum(), -b))
        group = [start]
        free.discard(start)
        while len(group) < width:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The thresholds (one a partition, -1: not probed) of least cost that add up to ``total``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t, x in options.items():
                if s + t not in step or c + x < step[s + t][0]:
                    step[s + t] = (c + x, [*ts, t])
        best = step
    return best[total]


def _value(fp, group: list[int]):
    """The bits of a group, packed into a long."""
    runs, k = [], 0
    while k < len(group):
        n = 1
        while k + n < len(group) and group[k + n] == group[k] + n:
            n += 1
        runs.append(F.shiftleft(F.shiftrightunsigned(fp, group[k]).bitwiseAND(F.lit((1 << n) - 1).cast("long")) if n < 64 else fp, k))
        k += n
    out = runs[0]
    for r in runs[1:]:
        out = out.bitwiseOR(r)
    return out


def plan(distinct: DataFrame, radius: int = RADIUS) -> tuple[list[list[int]], list[int]]:
    """Partitions of the bits and their thresholds, by counts over all distinct fingerprints."""

    @tidy
    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), n))], names=["k", "v"])

    #: 64 x 64 sums and the number of rows from each task, added up by position.
    matrix = np.zeros(BITS * BITS + 1)
    for k, v in distinct.select("_fp").mapInArrow(gram, "k long, v double").groupBy("k").agg(F.sum("v")).collect():
        matrix[k] = v
    matrix, n = matrix[:-1], int(matrix[-1])
    choices = []
    for parts in range(max(1, (radius + 1) // 2), radius + 2):
        groups = correlated_groups(matrix.reshape(BITS, BITS), n, parts)
        per_part = distinct.select(F.explode(F.array(*(F.struct(F.lit(i).alias("part"), _value(F.col("_fp"), g).alias("v")) for i, g in enumerate(groups)))).alias("x")).groupBy("x.part", "x.v").agg(F.count("*").alias("c"))
        squares = dict(per_part.groupBy("part").agg(F.sum(F.col("c").cast("double") * F.col("c"))).collect())
        costs = []
        for i, g in enumerate(groups):
            #: A value's probes, and the candidates expected among them; a row dealt costs some ten comparisons.
            probes = lambda t, w=len(g): sum(comb(w, d) for d in range(t + 1))
            costs.append({-1: 0.0} | {t: 10.0 * n * probes(t) + squares.get(i, 0.0) * probes(t) / 2 for t in (0, 1)})
        with_total = radius - parts + 1
        try:
            choices.append((*allocate(costs, with_total), groups))
        except KeyError:
            continue
    cost, thresholds, groups = min(choices, key=lambda c: c[0])
    return groups, thresholds


def _pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of pairs within the radius, in strips of bounded memory."""
    left, right = [], []
    for k in range(0, len(a), 256):
        i, j = np.nonzero(np.bitwise_count(a[k : k + 256, None] ^ b[None, :]) <= radius)
        left.append(i + k)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def spanning(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs as (node, smallest index in its tree)."""
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    some = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[some], nodes[label[some]]


def links(distinct: DataFrame, groups: list[list[int]], thresholds: list[int], radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b) pairs of fingerprints that connect what is within the radius."""
    fp = F.col("_fp")
    dealt = []
    for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)):
        if t < 0:
            continue
        v = _value(fp, g)
        dealt.append(F.struct(F.lit(i).alias("part"), v.alias("v")))
        if t >= 1:
            dealt += [F.struct(F.lit(i).alias("part"), v.bitwiseXOR(F.lit(1 << k).cast("long")).alias("v")) for k in range(len(g))]
    rows = distinct.select("_fp", F.explode(F.array(*dealt)).alias("x")).select("_fp", "x.part", "x.v")
    counts = rows.groupBy("part", "v").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block)
    met = (
        rows.join(counts, ["part", "v"])
        .withColumn("own", F.pmod(F.xxhash64("_fp"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("_fp", "part", "v", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") <= F.col("other")).alias("is_low"))
    )
    key = ["part", "v", "low", "high"]
    met = met.repartition(max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *key).sortWithinPartitions(*key)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(part: dict[str, np.ndarray]) -> pa.RecordBatch:
            a, b = _bucket_links(part, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            new = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            held = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in held}
            #: All but the last bucket are whole.
            starts = _starts(held)
            if starts[-1]:
                yield answer({n: c[: starts[-1]] for n, c in held.items()})
                held = {n: c[starts[-1] :] for n, c in held.items()}
        if held is not None and len(held["v"]):
            yield answer(held)

    return met.mapInArrow(run, "a long, b long").distinct()


def _starts(rows: dict[str, np.ndarray]) -> np.ndarray:
    new = np.ones(len(rows["v"]), bool)
    new[1:] = np.any([rows[n][1:] != rows[n][:-1] for n in ("part", "v", "low", "high")], axis=0)
    return np.flatnonzero(new)


def _bucket_links(rows: dict[str, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in a run of whole buckets. Small ones are compared row by row at each distance, all at once."""
    fp = rows["_fp"].view(np.uint64)
    starts = _starts(rows)
    sizes = np.diff(np.append(starts, len(fp)))
    bucket = np.repeat(np.arange(len(starts)), sizes)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat((sizes <= 64) & (rows["low"][starts] == rows["high"][starts]), sizes)
    at = np.flatnonzero(small)
    for d in range(1, 64):
        at = at[at + d < len(fp)]
        at = at[bucket[at] == bucket[at + d]]
        if not len(at):
            break
        near = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
        left.append(near)
        right.append(near + d)
    for k in np.flatnonzero(~small[starts]):
        own = np.arange(starts[k], starts[k] + sizes[k])
        one = own if rows["low"][starts[k]] == rows["high"][starts[k]] else own[rows["is_low"][own]]
        two = own if one is own else own[~rows["is_low"][own]]
        i, j = _pairs(fp[one], fp[two], radius)
        left.append(one[i])
        right.append(two[j])
    i, j = np.concatenate(left), np.concatenate(right)
    nodes, place = np.unique(fp[np.concatenate([i, j])], return_inverse=True)
    return spanning(nodes, place[: len(i)], place[len(i) :])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node of the edges (a, b) with the smallest node that it reaches.

    A round takes the smallest label of the neighbours, then the label's own label, so long chains halve. Labels and edges
    are read from stored tables, so the planner sees their sizes and can split a node that holds many links.
    """
    #: Stored before it is turned round: which links span a group may differ from one reading to the next, and both ways must be of one reading.
    stored = materialise(edges.select("a", "b"), "links")
    edges = stored.unionAll(stored.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        heard = edges.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label")
        hooked = labels.select("node", "label", F.col("label").alias("old")).unionByName(heard.withColumn("old", F.lit(None).cast("long"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        moved = hooked.join(jump, F.col("label") == F.col("via"), "left").select("node", F.least("label", "beyond").alias("label"), "old")
        moved = materialise(moved, "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels


def labelled(docs: DataFrame, text: str, doc_id: str, radius: int, shingle: int, block: int) -> DataFrame:
    """docs with ``_fp`` instead of the text, ``_label`` (the smallest fingerprint within reach) and component_id."""
    prints = materialise(fingerprints(docs, text, shingle), "prints")
    distinct = materialise(prints.groupBy("_fp").agg(F.min(doc_id).alias("_least")), "distinct")
    groups, thresholds = plan(distinct.select("_fp"), radius)
    labels = components(links(distinct.select("_fp"), groups, thresholds, radius, block))
    reached = distinct.join(labels, F.col("_fp") == F.col("node"), "left").select("_fp", "_least", F.coalesce("label", "_fp").alias("_label"))
    least = reached.groupBy("_label").agg(F.min("_least").alias("component_id"))
    of = materialise(reached.select("_fp", "_label").join(least, "_label").select(F.col("_fp").alias("f"), "_label", "component_id"), "components")
    return prints.join(of, F.col("_fp") == F.col("f")).drop("f")


def group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """docs without the text, with fingerprint (16 hex digits) and component_id (smallest id within reach)."""

    def run(rows: DataFrame) -> DataFrame:
        return labelled(rows, "text", "doc_id", radius, shingle, block).withColumn("fingerprint", F.lower(F.lpad(F.hex("_fp"), 16, "0")))

    return shielded(docs, {"text": text, "doc_id": doc_id}, ADDED, run, drop=[text])


def keep_one(docs: DataFrame, label: Callable[[DataFrame], DataFrame], text: str, doc_id: str) -> DataFrame:
    """docs, whole, with one row of each label: the row of smallest id, null last; of several the one of smallest hash.

    label: from rows (_id, _row, text) to rows (_id, _row, _label). ``_row`` is the hash of a whole row.
    """
    row = F.xxhash64(*(F.col(quoted(f.name)) for f in docs.schema if "map<" not in f.dataType.simpleString()))
    rows = label(docs.select(F.col(quoted(doc_id)).alias("_id"), row.alias("_row"), F.col(quoted(text)).alias("text"))).groupBy("_label", "_id", "_row").agg(F.count("*").alias("_rows"))
    least = rows.groupBy("_label").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row", "_rows")).alias("k"))
    keepers = materialise(least.select(F.col("k._id").alias("_keep"), F.col("k._row").alias("_row"), F.col("k._rows").alias("_rows")), "keepers")
    #: Keepers grow with the documents, so this is a merge join at any size, not a broadcast at some.
    whole = docs.select(carry(docs).alias("_doc"), F.col(quoted(doc_id)).alias("_id"), row.alias("_own"))
    stay = whole.join(keepers.hint("merge"), (F.col("_own") == F.col("_row")) & F.col("_id").eqNullSafe(F.col("_keep")))
    once = stay.where("_rows = 1").select("_doc.*")
    if keepers.where("_rows > 1").isEmpty():
        return once
    #: Rows that are repeated whole: the aggregate keeps one, whatever their number.
    more = stay.where("_rows > 1").groupBy("_keep", "_row").agg(F.first("_doc").alias("r")).select("r.*")
    return once.unionByName(more)


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """docs, whole, with one row of each group: the row of smallest id."""
    return keep_one(docs, lambda rows: labelled(rows, "text", "_id", radius, shingle, block), text, doc_id)
