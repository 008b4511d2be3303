"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, by hash). Every row is then put into its leaf and packed
with others of that leaf into blocks, within its own task, so indexing shuffles nothing. A query walks the tree
through a priority queue of branches by distance to their centres and visits leaves, nearest branch first. It stops once the next
branch is so many times as far as the first leaf was: a query between leaves visits more of them than one amid its own. How many times
is calibrated: for ``CALIBRATION`` queries the true neighbours among all rows are found, and the reach widens until the wanted share
of them lies in visited leaves. Neighbouring leaves make groups of up to ``GROUP`` rows, a larger leaf several. A query goes once to every group
in which it visits leaves, with the numbers of these, and meets the group's rows in one task: what a task holds is a group and at most ``QUERIES``
queries, and what moves is a query a group, not one a leaf. Distances are exact.

Of equal vectors in one block only the k + 1 smallest ids
are kept, as ties go to the smaller id and no other could rank.

Defined cases: vectors that are null, zero, of another than the usual length, or with a null or non-finite component take no part, nor
do rows with a null id; a query's own id is never its neighbour; an id listed twice is one query (the smaller
vector) and at most one neighbour (the nearer vector); ties go to the smaller id; fewer candidates than k: all of them; an empty table
gives no rows. Extra columns are neither read nor returned, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, tasks, tidy

SAMPLE, BRANCH, LEAF_ROWS, CALIBRATION, RECALL = 40_000, 8, 64, 96, 0.97
#: Rows that a task packs at once, rows of a block, rows of a group (an eighth of it at least), queries that meet a group in one task, rows of a batch that is sent on.
BUFFER, BLOCK, GROUP, QUERIES, SENT = 65_536, 2_048, 8_192, 16_384, 2_048


class Tree:
    """Centres of each node's children; a child is a node (>= 0) or leaf -1 - number."""

    def __init__(self, sample: np.ndarray, leaf: int, branch: int = BRANCH, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaves = 0
        self.r = np.random.default_rng(seed)
        self.root = self._grow(sample, branch, leaf)

    def _grow(self, x: np.ndarray, branch: int, leaf: int) -> int:
        if len(x) <= leaf or (x == x[:1]).all():
            self.leaves += 1
            return -self.leaves
        centres = x[self.r.choice(len(x), min(branch, len(x)), replace=False)]
        for _ in range(8):
            own = nearest(x, centres)
            centres = np.array([x[own == k].mean(0) if (own == k).any() else c for k, c in enumerate(centres)])
        own = nearest(x, centres)
        some = [k for k in range(len(centres)) if (own == k).any()]
        if len(some) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(centres[some])
        self.children.append([])
        self.children[node] = [self._grow(x[own == k], branch, leaf) for k in some]
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf number of each row."""
        out = np.zeros(len(x), np.int64)
        work = [(self.root, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                own = nearest(x[rows], self.centres[node])
                work += [(child, rows[own == k]) for k, child in enumerate(self.children[node])]
        return out

    def best_bins(self, q: np.ndarray, reach: float) -> tuple[list[int], list[float]]:
        """Leaves in the order of best-bin-first traversal, as far as the reach, and how far each was, the first counting 1."""
        heap, out, far, first, at = [(0.0, self.root)], [], [], None, 0.0
        while heap:
            d, node = heapq.heappop(heap)
            at = max(at, d)
            if first is not None and at > reach * first:
                break
            if node < 0:
                first = max(at, 1e-300) if first is None else first
                out.append(-1 - node)
                far.append(at / first)
            else:
                for d, child in zip(((self.centres[node] - q) ** 2).sum(1).tolist(), self.children[node], strict=True):
                    heapq.heappush(heap, (d, child))
        return out, far


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _valid(rows: DataFrame, vector: str, vec_id: str) -> tuple[DataFrame, int]:
    v = F.col(vector)
    finite = rows.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    usual = finite.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return (finite.where(F.size("v") == usual["w"]), usual["w"]) if usual else (finite, 0)


def _near(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each query (distance, then id), without its own id; exact distances in double precision."""
    a, b, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    repeated = len(np.unique(ids)) < len(ids)
    all_ids = ids
    for i, v in zip(q_ids.tolist(), q, strict=True):
        d, ids = np.sqrt(((x - v) ** 2).sum(1)), all_ids
        if repeated:
            order = np.lexsort((d, ids))
            first = np.unique(ids[order], return_index=True)[1]
            ids, d = ids[order][first], d[order][first]
        d[ids == i] = np.inf
        if len(d) > k:
            limit = np.partition(d, k - 1)[k - 1]
            at = np.flatnonzero(d <= limit)
        else:
            at = np.arange(len(d))
        at = at[np.isfinite(d[at])]
        at = at[np.lexsort((ids[at], d[at]))][:k]
        a.append(np.full(len(at), i))
        b.append(ids[at])
        c.append(d[at])
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def _out(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> pa.RecordBatch:
    """What is left of several partial answers: k rows a query."""
    q, i, d = (np.concatenate([p[n] for p in parts]) if parts else np.zeros(0) for n in range(3))
    order = np.lexsort((i, d, q))
    q, i, d = q[order], i[order], d[order]
    #: Of an id met in several blocks, the nearest.
    nearest_first = np.sort(np.unique(np.stack([q, i]), axis=1, return_index=True)[1]) if len(q) else np.zeros(0, np.int64)
    q, i, d = q[nearest_first], i[nearest_first], d[nearest_first]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return pa.RecordBatch.from_arrays([pa.array(q[keep].astype(np.int64)), pa.array(i[keep].astype(np.int64)), pa.array(d[keep].astype(float))], names=["query_id", "vec_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(rows: DataFrame, queries: list[tuple[int, np.ndarray]], width: int, k: int) -> DataFrame:
    """The true neighbours of a few stated queries among all rows, each task answering for its own."""
    q_ids, q = np.array([i for i, _ in queries], np.int64), np.array([v for _, v in queries], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        for batch in batches:
            if batch.num_rows:
                parts.append(_near(q_ids, q, batch.column(0).to_numpy(), _matrix(batch.column(1), width).astype(float), k))
                if len(parts) > 16:
                    merged = _out(parts, k)
                    parts = [tuple(c.to_numpy() for c in merged.columns)]
        yield _out(parts, k)

    return _ranked(rows.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score double"), k)


def calibrate(tree: Tree, rows: DataFrame, width: int, count: int, k: int, recall: float, calibration: int = CALIBRATION) -> float:
    """The reach that gives the recall on queries sampled from the rows."""
    chance = F.pmod(F.xxhash64(F.lit("calibration"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(chance < 4.0 * calibration / max(count, 1)).orderBy(F.xxhash64(F.lit("calibration"), F.col("id"))).limit(calibration).collect()
    truth = brute_force(rows, [(r["id"], np.array(r["v"], float)) for r in picked], width, k)
    truth = materialise(truth.select("query_id", F.col("vec_id").alias("id")), "truth")
    own = rows.join(F.broadcast(truth.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
    truth = truth.join(own, "id").select("query_id", "v").collect()
    if not truth:
        return float("inf")
    leaf = tree.assign(np.array([r["v"] for r in truth], float))
    far = {r["id"]: dict(zip(*tree.best_bins(np.array(r["v"], float), float("inf")), strict=True)) for r in picked}
    needed = np.sort([far[r["query_id"]][b] for r, b in zip(truth, leaf.tolist(), strict=True)])
    return float(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def _blocks(rows: DataFrame, tree: Tree, width: int, k: int) -> DataFrame:
    """leaf, n, ids, data: all rows, packed by leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            leaf = shared.value.assign(x.astype(float))
            order = np.lexsort((ids, leaf))
            ids, x, leaf = ids[order], x[order], leaf[order]
            _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * width))).ravel(), return_inverse=True)
            #: Rows repeated whole go first, so that k + 1 ids of each vector stay, not k + 1 rows.
            by = np.lexsort((ids, same))
            first = np.ones(len(ids), bool)
            first[1:] = (same[by][1:] != same[by][:-1]) | (ids[by][1:] != ids[by][:-1])
            once = np.sort(by[first])
            ids, x, leaf, same = ids[once], x[once], leaf[once], same[once]
            by = np.argsort(same, kind="stable")
            nth = np.empty(len(ids), np.int64)
            nth[by] = np.arange(len(ids)) - np.searchsorted(same[by], same[by])
            keep = nth <= k
            ids, x, leaf = ids[keep], x[keep], leaf[keep]
            cuts = np.flatnonzero(np.diff(leaf, prepend=-1))
            ends = np.append(cuts[1:], len(leaf))
            spans = [(s, min(s + BLOCK, b)) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True) for s in range(a, b, BLOCK)]
            return pa.RecordBatch.from_arrays(
                [pa.array([int(leaf[a]) for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([x[a:b].tobytes() for a, b in spans], pa.binary())],
                names=["leaf", "n", "ids", "data"],
            )

        held: list = []
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), _matrix(batch.column(1), width)))
            if sum(len(i) for i, _ in held) >= BUFFER:
                yield pack(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
        if held:
            yield pack(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return rows.select("id", "v").mapInArrow(run, "leaf long, n long, ids binary, data binary")


def _groups(sizes: dict[int, int], leaves: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each leaf its group and how many groups from that one on it is dealt to: neighbouring leaves share one of up to ``most`` rows, a larger leaf has several."""
    first, over, group, held = np.zeros(leaves, np.int64), np.ones(leaves, np.int64), 0, 0
    for leaf in range(leaves):
        n = sizes.get(leaf, 0)
        if held and held + n > most:
            group, held = group + 1, 0
        first[leaf], over[leaf] = group, max(1, -(-n // most))
        held += n
        if over[leaf] > 1:
            group, held = group + int(over[leaf]), 0
    return first, over


def _asked(queries: DataFrame, tree: Tree, groups: tuple[np.ndarray, np.ndarray], width: int, reach: float, parts: int) -> DataFrame:
    """group, part, q_id, q_data, leaves: each query once for every group in which it visits leaves, with these."""
    shared = queries.sparkSession.sparkContext.broadcast((tree, *groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, first, over = shared.value
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=["group", "part", "q_id", "q_data", "leaves"])

        for given in batches:
            for i, v in zip(given.column(0).to_pylist(), _matrix(given.column(1), width), strict=True):
                leaf = np.array(tree.best_bins(v.astype(float), reach)[0], np.int64)
                n = over[leaf]
                at = np.repeat(first[leaf] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                leaf, order = np.repeat(leaf, n), np.argsort(at, kind="stable")
                leaf, at, data = leaf[order].astype(np.int32), at[order], v.tobytes()
                cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
                held += [(int(at[a]), i % parts, i, data, leaf[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                if len(held) >= SENT:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    return queries.select("id", "v").mapInArrow(tidy(run), "group long, part long, q_id long, q_data binary, leaves binary")


def search(rows: DataFrame, k: int = 10, every: int = 100, recall: float = RECALL, vector: str = "embedding", vec_id: str = "vec_id", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    rows, width = _valid(rows, vector, vec_id)
    rows = materialise(rows, "vectors")
    spark, count = rows.sparkSession, rows.count()
    kind = "<f4" if rows.schema["v"].dataType.elementType.typeName() == "float" else "<f8"
    chance = F.pmod(F.xxhash64(F.lit("tree"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    fitted = rows.where(chance < 1.2 * sample / max(count, 1)).orderBy(F.xxhash64(F.lit("tree"), F.col("id")), "id").limit(sample).select("v").collect()
    if not fitted:
        fitted = rows.limit(sample).select("v").collect()
    if not fitted:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    #: Leaves hold about LEAF_ROWS of all rows, as long as the sample can tell them apart.
    tree = Tree(np.array([r["v"] for r in fitted], float), max(8, LEAF_ROWS * len(fitted) // max(count, 1)))
    reach = calibrate(tree, rows, width, count, k, recall)
    blocks = materialise(_blocks(rows, tree, width, k), "blocks")
    #: Leaves are bounded by the sample.
    sizes = {r["leaf"]: r["n"] for r in blocks.groupBy("leaf").agg(F.sum("n").alias("n")).collect()}
    first, over = _groups(sizes, tree.leaves, min(GROUP, max(GROUP // 8, -(-count // tasks(spark)))))
    dealt = spark.createDataFrame(pa.table({"leaf": np.arange(tree.leaves), "first": first, "over": over}))
    queries = materialise(rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v")), "queries")
    parts = max(1, -(-queries.count() // QUERIES))
    #: A walk through the tree is work, however little it reads.
    asked = materialise(_asked(queries.repartition(tasks(spark), "id"), tree, (first, over), width, reach, parts), "asked")
    group = (F.col("first") + F.pmod(F.xxhash64("ids"), F.col("over"))).alias("group")
    held = blocks.join(F.broadcast(dealt), "leaf").select(group, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "leaf", "n", "ids", "data")

    def run(own: pa.Table, met: pa.Table) -> pa.Table:
        """The nearest of a group's rows to each query that visits it, among the leaves that it visits."""
        if not own.num_rows or not met.num_rows:
            return pa.Table.from_batches([_out([], k)])
        leaf = np.repeat(own.column("leaf").to_numpy(), own.column("n").to_numpy())
        order = np.argsort(leaf, kind="stable")
        ids = np.frombuffer(b"".join(own.column("ids").to_pylist()), np.int64)[order]
        x = np.frombuffer(b"".join(own.column("data").to_pylist()), kind).reshape(-1, width)[order].astype(float)
        there, starts = np.unique(leaf[order], return_index=True)
        ends = np.append(starts[1:], len(leaf))
        found: list = []
        for i, data, leaves in zip(*(met.column(c).to_pylist() for c in ("q_id", "q_data", "leaves")), strict=True):
            at = np.flatnonzero(np.isin(there, np.frombuffer(leaves, np.int32)))
            rows_at = slice(None) if len(at) == len(there) else np.concatenate([np.arange(a, b) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)] or [np.zeros(0, np.int64)])
            found.append(_near(np.array([i], np.int64), np.frombuffer(data, kind).reshape(1, width).astype(float), ids[rows_at], x[rows_at], k))
        return pa.Table.from_batches([_out(found, k)])

    #: As many tasks as groups, whatever the size of what moves: work is in the pairs.
    n = max(tasks(spark), min(4 * tasks(spark), parts * (int((first + over).max()))))
    sides = (side.repartition(n, "group", "part").groupBy("group", "part") for side in (held, asked))
    return _ranked(next(sides).cogroup(next(sides)).applyInArrow(run, "query_id long, vec_id long, score double"), k)
