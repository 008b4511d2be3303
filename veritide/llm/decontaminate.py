"""Benchmark decontamination as a prefix-filtered set join with exact verification.

Every item is cut into windows of ten consecutive words (an item of fewer words is one window). A document holds a
window only if it holds each of the window's shingles, so under containment 1 the necessary prefix is one shingle, and
the rarest one gives the fewest candidates. The order of shingles by rarity comes from a first pass that counts them over
all documents. The second pass meets document shingles with the prefix shingles, drops candidates whose window would
start before or end after the document (positional and length bounds), and verifies the rest word by word.

The benchmark side is taken in blocks of ``BLOCK_BYTES``, so that driver and tasks hold one block at a time, as arrays. One block
is the usual case and needs no other table. A larger benchmark is read item by item and runs block after block over the stored
documents; each block's marks (of documents that it hits) are stored, and all marks of a document meet in the end.

Defined cases: a null or empty text has no words, no hits and no items; an item without words has no window; rows of one
item id are one item; a null item id counts as the text ``null``; rows are judged one by one, so repeated ids and rows do not matter;
a very long text is one row of word numbers; empty tables give no rows, or rows without hits. Extra columns are kept (own columns
replace any of the same name).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, quoted, shielded, tidy

#: Fixed by the word rule [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: other ASCII separates words.
KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
RULE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in KEPT else 32 for c in range(256))
WINDOW, SHINGLE = 10, 5
#: The most bytes of benchmark text in one block.
BLOCK_BYTES = 4_000_000
ADDED = ("n_words", "n_hit", "n_items", "item_ids", "items_sha256", "hit_spans", "contaminated")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | bytes | None) -> list[bytes]:
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(RULE).split()


class Windows:
    """The windows of a block of items, and the shingles that lead to them. Word numbers start at 1; 0: any other word.

    A distinct window is a row of word numbers (0 after the end of a short one), its owners a run of item numbers.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW, shingle: int = SHINGLE):
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        self.window, self.shingle = window, shingle
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for at, (_, text) in enumerate(items):
            w = np.array([self.number.setdefault(x, len(self.number) + 1) for x in words(text)], np.int32)
            if len(w):
                rows.append(np.lib.stride_tricks.sliding_window_view(w, window) if len(w) >= window else np.pad(w, (0, window - len(w)))[None])
                owners.append(np.full(len(rows[-1]), at, np.int32))
        self.rows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.length = (self.rows > 0).sum(1)
        pairs = np.unique((which.ravel().astype(np.int64) << 32) | np.concatenate(owners))
        self.owners = (pairs & 0xFFFFFFFF).astype(np.int32)
        self.owner_at = np.searchsorted(pairs >> 32, np.arange(len(self.rows) + 1))

    def shingles(self, row: np.ndarray) -> np.ndarray:
        """A hash of each run of ``shingle`` word numbers along the last axis; runs with a foreign word hash to 0."""
        n = row.shape[-1] - self.shingle + 1
        if n <= 0:
            return np.zeros((*row.shape[:-1], 0), np.uint64)
        h, known = np.zeros((*row.shape[:-1], n), np.uint64), np.ones((*row.shape[:-1], n), bool)
        for k in range(self.shingle):
            part = row[..., k : k + n]
            known &= part > 0
            h = (h ^ part.astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
        return np.where(known, h, np.uint64(0))

    def all_shingles(self) -> np.ndarray:
        h = np.unique(self.shingles(self.rows))
        return h[h > 0]

    def order(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Choose each window's rarest shingle as its prefix (the first of several). Windows shorter than a shingle are met by their first word.

        keys: sorted hashes of shingles, counts: in how many places each stands.
        """
        h = self.shingles(self.rows)
        place = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
        often = np.where(keys[place] == h, counts[place], 0) if len(keys) else np.zeros(h.shape, np.int64)
        rarest = np.where(h > 0, often, np.iinfo(np.int64).max).argmin(1) if h.size else np.zeros(len(h), np.int64)
        long = np.flatnonzero(self.length >= self.shingle)
        found = h[long, rarest[long]] if h.size else np.zeros(0, np.uint64)
        by = np.argsort(found, kind="stable")
        #: Sorted prefix hashes, and for each the window and where in it the shingle stands.
        self.keys, self.meets, self.offset = found[by], long[by], rarest[long][by]
        short = np.flatnonzero(self.length < self.shingle)
        by = short[np.argsort(self.rows[short, 0], kind="stable")]
        self.first, self.short = self.rows[by, 0], by

    def numbers(self, text: bytes) -> np.ndarray:
        return np.array(list(map(self.number.get, w, [0] * len(w))), dtype=np.int64) if (w := words(text)) else np.zeros(0, np.int64)

    def _candidates(self, at: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each place with each entry of the sorted keys that has its value."""
        low, high = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
        n = high - low
        return np.repeat(at, n), np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)

    def spans(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and window of each occurrence of a window in a row of word numbers."""
        h = self.shingles(row)
        at = np.flatnonzero(h)
        place, entry = self._candidates(at, h[at], self.keys)
        start, which = place - self.offset[entry], self.meets[entry]
        if len(self.first):
            at = np.flatnonzero(row)
            place, entry = self._candidates(at, row[at], self.first)
            start, which = np.concatenate([start, place]), np.concatenate([which, self.short[entry]])
        end = start + self.length[which]
        inside = (start >= 0) & (end <= len(row))
        start, end, which = start[inside], end[inside], which[inside]
        if not len(start):
            return start, end, which
        padded = np.concatenate([row, np.zeros(self.window, np.int64)])
        held = padded[start[:, None] + np.arange(self.window)]
        held[np.arange(self.window) >= (end - start)[:, None]] = 0
        same = (held == self.rows[which]).all(1)
        return start[same], end[same], which[same]

    def items(self, which: np.ndarray) -> list[str]:
        """The ids of the items that own some of the windows."""
        some = np.unique(which)
        return [self.ids[o] for o in np.unique(np.concatenate([np.zeros(0, np.int32), *(self.owners[self.owner_at[w] : self.owner_at[w + 1]] for w in some.tolist())])).tolist()]


def _texts(batch: pa.RecordBatch, text: str) -> Iterator[bytes]:
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    return (x.as_py() or b"" for x in column)


def _blocks(benchmark: DataFrame, text: str, item_id: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t")).toLocalIterator()
    block, size = [], 0
    for i, t in rows:
        block.append((i, t))
        size += len(t or "") + 16
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _frequencies(docs: DataFrame, text: str, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """The block's shingles that stand in any document, sorted, and in how many places. A task sends at most a row a shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        keys = w.all_shingles()
        total = np.zeros(len(keys) + 1, np.int64)
        for batch in batches:
            for t in _texts(batch, text):
                h = w.shingles(w.numbers(t))
                h = h[h != 0]
                if len(h) and len(keys):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    total += np.bincount(at[keys[at] == h], minlength=len(total))
        some = np.flatnonzero(total[: len(keys)])
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(total[some])], names=["h", "n"])

    counted = docs.select(text).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).toArrow()
    keys, n = counted.column("h").to_numpy().astype(np.int64).view(np.uint64), counted.column("n").to_numpy()
    by = np.argsort(keys)
    shared.unpersist()
    return keys[by], n[by]


RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("items_sha256", T.StringType()), T.StructField("hit_spans", T.ArrayType(T.IntegerType()))]


def _joined(spans: list[tuple[int, int]]) -> list[int]:
    """Overlapping spans as one: start, end, start, end, ..."""
    merged: list[int] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1]:
            merged[-1] = max(merged[-1], b)
        else:
            merged += [a, b]
    return merged


def _result(n_words: list[int], spans: list[list[int]], items: list[list[str]]) -> list[pa.Array]:
    """The columns of RESULT, from joined spans and items in any order."""
    ids = [sorted({*i}) for i in items]
    return [
        pa.array(n_words, pa.int64()), pa.array([sum(s[1::2]) - sum(s[::2]) for s in spans], pa.int64()), pa.array(ids, pa.list_(pa.string())),
        pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids]), pa.array(spans, pa.list_(pa.int32())),
    ]


def _found(batch: pa.RecordBatch, text: str, w: Windows) -> tuple[list[int], list[list[int]], list[list[str]]]:
    """Words, joined spans and items of each text."""
    n_words, spans, items = [], [], []
    for t in _texts(batch, text):
        row = w.numbers(t)
        start, end, which = w.spans(row)
        n_words.append(len(row))
        spans.append(_joined(list(zip(start.tolist(), end.tolist(), strict=True))))
        items.append(w.items(which) if len(which) else [])
    return n_words, spans, items


def _mark(df: DataFrame, text: str, windows: Windows) -> DataFrame:
    """df with the columns of RESULT, by one block alone."""
    shared = df.sparkSession.sparkContext.broadcast(windows)
    into = T.StructType([*df.schema.fields, *RESULT])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_result(*_found(batch, text, shared.value))], names=into.names)

    return df.mapInArrow(run, into)


def _marks(rows: DataFrame, text: str, windows: Windows) -> DataFrame:
    """_rid, spans, items of the rows that one block hits, stored."""
    shared = rows.sparkSession.sparkContext.broadcast(windows)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, spans, items = _found(batch, text, shared.value)
            hit = [k for k, i in enumerate(items) if i]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(hit, pa.int64())), pa.array([spans[k] for k in hit], pa.list_(pa.int32())), pa.array([items[k] for k in hit], pa.list_(pa.string()))], names=["_rid", "spans", "items"])

    out = materialise(rows.select("_rid", text).mapInArrow(run, "_rid long, spans array<int>, items array<string>"), "marks")
    shared.unpersist()
    return out


def _all_marks(rows: DataFrame, text: str, marks: DataFrame) -> DataFrame:
    """rows with the columns of RESULT, from the marks of all blocks."""
    both = marks.groupBy(F.col("_rid").alias("_r")).agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
    #: Rows that are hit grow with the documents: a merge join at any size.
    met = rows.join(both.hint("merge"), F.col("_rid") == F.col("_r"), "left").drop("_rid", "_r")
    kept = met.columns[:-2]
    into = T.StructType([*(met.schema[c] for c in kept), *RESULT])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, items = (batch.column(k).to_pylist() for k in (batch.num_columns - 2, batch.num_columns - 1))
            spans = [_joined(list(zip(s[::2], s[1::2], strict=True))) if s else [] for s in flat]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *_result([len(words(t)) for t in _texts(batch, text)], spans, [i or [] for i in items])], names=into.names)

    return met.mapInArrow(run, into)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, item_ids, items_sha256, hit_spans (start, end, start, end, ...), contaminated."""
    return shielded(docs, {"text": text}, ADDED, lambda rows: _judged(rows, benchmark.select(F.col(quoted(item_id)).alias("item_id"), F.col(quoted(item_text)).alias("text")), block_bytes))


def _judged(docs: DataFrame, benchmark: DataFrame, block_bytes: int, text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    kept = docs.columns
    blocks = _blocks(benchmark, item_text, item_id, block_bytes)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        windows = Windows(block)
        windows.order(*_frequencies(docs, text, windows))
        out = _mark(docs.select(*kept), text, windows)
    else:
        rows = materialise(docs.select(*kept, F.monotonically_increasing_id().alias("_rid")), "judged")
        marks = None
        while block is not None:
            windows = Windows(block)
            windows.order(*_frequencies(rows, text, windows))
            own = _marks(rows, text, windows)
            marks = own if marks is None else marks.unionByName(own)
            block, following = following, next(blocks, None)
        out = _all_marks(rows, text, marks)
    return out.select(*kept, "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids", "items_sha256", "hit_spans", (F.col("n_hit") > 0).alias("contaminated"))
