"""Centroid clustering in whole numbers by Lloyd's rounds that look only at what changed.

1. State: each vector with its cluster and distance, stored once a round; sums and counts of every cluster, kept by the driver (``k`` x ``dim``
   whole numbers). The centroids are the floors of their quotients.
2. A round sends out the centroids. A vector whose own centroid did not move keeps its distance and is compared with those that
   did; a vector whose own centroid moved is compared with all. In numpy, batch by batch, without a shuffle.
3. A vector that changes its cluster leaves a transfer in the stored state: its components, to be taken from the one sum and added to
   the other. Tasks add up transfers into signed totals (at most 2 x k x dim numbers a task), Spark adds these up by place, and the driver
   applies them. Other rows' transfers are null, so this reads little once few vectors move.
4. No moved centroid: nothing can change any more, and the rounds left are not run. The last state has all distances.

All arithmetic is exact: 64-bit integers where components stay below 2^27, Python's integers for the rest. Sums travel as signed
digits to the base 2^48, so they never overflow.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are left out; ties go to the smaller number of a centroid;
a null id hashes as the empty string; of equal hashes (repeated ids) the smaller vector comes first, so equal rows give equal centroids, and later ones
stay empty and keep their place; fewer vectors than centroids give fewer centroids; a distance or an inertia that no long can hold is null; an empty
table gives no rows. Extra columns may have any name and are kept (own columns replace any of the same name).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carry, discard, materialise, quoted, tidy

DIM, K, ROUNDS, SCALE = 64, 8, 10, 1024
ADDED = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
#: Components below this give distances within 64 bits (DIM x (2 x SAFE)^2 < 2^63).
SAFE = 1 << 27
LONG = (1 << 63) - 1
#: Bits of a digit of a sum on its way.
DIGIT = 48


class Rounds(NamedTuple):
    """What the rounds end with. moved: how many centroids were sent out as moved; transfers: how many vectors changed their cluster; a number a round."""

    state: DataFrame
    centroids: list[list[int]]
    moved: list[int]
    transfers: list[int]


def whole_number(x: float) -> int:
    """floor(SCALE * x), exactly."""
    n, d = float(x).as_integer_ratio()
    return n * SCALE // d


def numbers(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, dict[int, list[int]]]:
    """The components of a batch as (rows, dim) integers, and of rows that hold a large one by row (in the array they are 0)."""
    column = batch.column(batch.schema.get_field_index("x"))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    large = np.flatnonzero((np.abs(x) >= SAFE / SCALE).any(1))
    exact = {int(r): [whole_number(v) for v in x[r]] for r in large}
    x[large] = 0
    return np.floor(x * SCALE).astype(np.int64), exact


def measure(x: np.ndarray, exact: dict[int, list[int]], centroid: list[int]) -> np.ndarray:
    """Squared distances of all rows from a centroid: int64, or Python's integers where a large one takes part."""
    if not exact and max(map(abs, centroid)) < SAFE:
        return ((x - np.array(centroid, np.int64)) ** 2).sum(1)
    out = np.empty(len(x), object)
    if max(map(abs, centroid)) < SAFE:
        out[:] = ((x - np.array(centroid, np.int64)) ** 2).sum(1).tolist()
    else:
        out[:] = ((x.astype(object) - np.array(centroid, object)) ** 2).sum(1)
    for r, v in exact.items():
        out[r] = sum((a - b) ** 2 for a, b in zip(v, centroid, strict=True))
    return out


def nearest(x: np.ndarray, exact: dict[int, list[int]], centroids: list[list[int]], moved: set[int], owner: np.ndarray, distance: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centroid and distance. ``known``: rows with a distance from an owner that did not move; these meet the moved ones alone."""
    wide = bool(exact) or any(max(map(abs, c)) >= SAFE for c in centroids)
    best, own, started = np.zeros(len(x), object if wide else np.int64), owner.copy(), known.copy()
    best[known] = distance[known]
    for c, centroid in enumerate(centroids):
        rows = np.arange(len(x)) if c in moved else np.flatnonzero(~known)
        if not len(rows):
            continue
        place = {int(r): k for k, r in enumerate(rows)} if exact else {}
        d = measure(x[rows], {place[r]: v for r, v in exact.items() if r in place}, centroid)
        better = (~started[rows] | (d < best[rows]) | ((d == best[rows]) & (c < own[rows]))).astype(bool)
        won = rows[better]
        best[won], own[won], started[won] = d[better], c, True
    return own, best


def digits(n: int) -> list[int]:
    """A number as signed digits to the base 2^DIGIT, least first."""
    sign, n, out = (-1 if n < 0 else 1), abs(n), []
    while n:
        out.append(sign * (n & (1 << DIGIT) - 1))
        n >>= DIGIT
    return out


def assign(state: DataFrame, centroids: list[list[int]], moved: set[int], dim: int) -> DataFrame:
    """state (own, x, cluster, distance) with the clusters and distances of these centroids, ``was`` and, for vectors that changed, ``transfer``."""
    into = T.StructType([state.schema["own"], state.schema["x"], *(T.StructField(c, t) for c, t in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("was", T.IntegerType()), ("transfer", state.schema["x"].dataType)))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in ("own", "x", "cluster", "distance")}
            x, exact = numbers(batch, dim)
            was = column["cluster"].fill_null(-1).to_numpy(zero_copy_only=False)
            known = column["distance"].is_valid().to_numpy(zero_copy_only=False) & ~np.isin(was, list(moved)) & (was >= 0)
            cluster, distance = nearest(x, exact, centroids, moved, was, column["distance"].fill_null(0).to_numpy(zero_copy_only=False), known)
            told = pa.array([int(d) if d <= LONG else None for d in distance], pa.int64()) if distance.dtype == object else pa.array(distance)
            changed = pa.array(cluster != was)
            given = pa.compute.if_else(changed, column["x"], pa.scalar(None, column["x"].type))
            yield pa.RecordBatch.from_arrays([column["own"], column["x"], pa.array(cluster.astype(np.int32)), told, pa.array(was.astype(np.int32)), given], names=["own", "x", "cluster", "distance", "was", "transfer"])

    return state.mapInArrow(run, into)


def transfers(state: DataFrame, k: int, dim: int) -> tuple[int, dict[tuple[int, int], int]]:
    """(vectors that moved, signed changes of the clusters' sums by (cluster, component); component ``dim`` is the count)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), object)
        for batch in batches:
            x, exact = numbers(batch.select(["transfer"]).rename_columns(["x"]), dim)
            to, was = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("cluster", "was"))
            for ends, sign in ((to, 1), (was, -1)):
                for c in np.unique(ends[ends >= 0]).tolist():
                    rows = np.flatnonzero(ends == c)
                    total[c, :dim] += sign * x[rows].sum(0).astype(object)
                    total[c, dim] += sign * len(rows)
            for r, v in exact.items():
                total[to[r], :dim] += np.array(v, object)
                if was[r] >= 0:
                    total[was[r], :dim] -= np.array(v, object)
        rows = [(c, j, e, d) for c in range(k) for j in range(dim + 1) for e, d in enumerate(digits(int(total[c, j])))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["c", "j", "e", "d"])

    changed = state.where("transfer IS NOT NULL").select("transfer", "cluster", "was")
    sums = changed.mapInArrow(run, "c int, j int, e int, d long").groupBy("c", "j", "e").agg(F.sum(F.col("d").cast("decimal(38,0)")).alias("d"))
    out: dict[tuple[int, int], int] = {}
    #: As many rows as the clusters' sums have digits.
    for row in sums.collect():
        out[row.c, row.j] = out.get((row.c, row.j), 0) + (int(row.d) << DIGIT * row.e)
    return changed.count(), out


def rounds(vectors: DataFrame, vec_id: str, embedding: str, k: int = K, dim: int = DIM, n: int = ROUNDS, seed: str = "3:") -> Rounds:
    """All rounds over vectors and the assignment after the last."""
    x, key = F.col(quoted(embedding)), F.col(quoted(vec_id))
    sound = (F.size(x) == dim) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.where(F.coalesce(sound, F.lit(False))).select(carry(vectors, {embedding, *ADDED}).alias("own"), x.alias("x"), key.alias("id"))
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(hashed.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    centroids = [[whole_number(v) for v in row.x] for row in first]
    sums, counts = [[0] * dim for _ in centroids], [0] * len(centroids)
    none = F.lit(None)
    state = kept.select("own", "x", none.cast("int").alias("cluster"), none.cast("long").alias("distance"))
    sent: list[int] = []
    went: list[int] = []
    if not centroids:
        return Rounds(state, centroids, sent, went)
    moved, stored = set(range(len(centroids))), None
    for turn in range(n + 1):
        if not moved:
            break
        sent.append(len(moved))
        before, stored = stored, materialise(assign(state, centroids, moved, dim), "assigned")
        state = stored.select("own", "x", "cluster", "distance")
        if before is not None:
            discard(before)
        if turn == n:
            break
        number, changes = transfers(stored, len(centroids), dim)
        went.append(number)
        for (c, j), d in changes.items():
            if j == dim:
                counts[c] += d
            else:
                sums[c][j] += d
        new = [[s // counts[c] for s in sums[c]] if counts[c] else centroids[c] for c in range(len(centroids))]
        moved = {c for c in range(len(centroids)) if new[c] != centroids[c]}
        centroids = new
    return Rounds(state, centroids, sent, went)


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", **how) -> DataFrame:
    """Sound vectors with cluster, squared distance, cluster_inertia, inertia and centroid_sha256."""
    done = rounds(vectors, vec_id, embedding, **how)
    spark = vectors.sparkSession
    names = [(c, hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()) for c, centroid in enumerate(done.centroids)]
    told = spark.createDataFrame(names, "c int, centroid_sha256 string")
    #: A distance that no long can hold makes its sums too large for one as well.
    sums = done.state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.max(F.col("distance").isNull()).alias("over"))
    of = sums.join(told, F.col("cluster") == F.col("c")).select("c", "centroid_sha256", F.when(~F.col("over"), F.col("s")).alias("s")).collect()
    total = None if any(r.s is None for r in of) else sum(int(r.s) for r in of)
    fits = lambda v: int(v) if v is not None and v <= LONG else None
    by_cluster = spark.createDataFrame([(r.c, fits(r.s), fits(total), r.centroid_sha256) for r in of], "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    #: One row a centroid.
    return done.state.join(F.broadcast(by_cluster), F.col("cluster") == F.col("c")).select("own.*", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
