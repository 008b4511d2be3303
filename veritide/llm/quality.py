"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from its bytes: shares of character
classes, word lengths and repetition, and hashed words. A learned layer turns these into an encoding; a gated attention
(tanh times sigmoid) learns from document labels how much each passage counts; the document's score is a logistic of the
attention-weighted sum of encodings. Training is in numpy on the driver, on a bounded sample of labelled rows: ``SAMPLE_DOCS``
documents, those of smallest hash, each with all passages of its whole text. Tasks encode them, so no text reaches the driver. Scoring covers every passage of every text; a text above ``CHUNK`` bytes is taken in parts that end where a
passage does, and its attention is summed up over the parts, so no text's length raises the memory needed.

Defined cases: null, empty or blank text is one passage without words and gets a score too; labels that are null are not learned from,
and of several labels for an id the largest counts; without any label, or with empty tables, every score is 0.5. Rows are judged one
by one, so repeated rows and ids, null or not, do not matter. Extra columns are kept (own columns replace any of the same name).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shielded, tidy

PASSAGE, BUCKETS, HIDDEN, GATE = 48, 128, 24, 12
SAMPLE_DOCS, EPOCHS, BATCH = 4000, 12, 64
CHUNK = 1 << 20
ADDED = ("score",)
#: Fixed: the character classes. Line ends and other space, lower, upper, digits, some marks, other ASCII, beyond ASCII.
CLASS = np.array([0 if c in (10, 13) else 1 if c in (9, 11, 12, 32) else 2 if 97 <= c <= 122 else 3 if 65 <= c <= 90 else 4 if 48 <= c <= 57 else 5 if c in b".,;:" else 6 if c in b"!?" else 7 if c in b"|/\\<>{}[]()=_" else 8 if c < 128 else 9 for c in range(256)], dtype=np.int64)
CLASSES = 10
STATS = CLASSES + 6
_SALT = np.random.default_rng(5).integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)


def passages(texts: list[bytes], goes_on: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the first passage of each text. No text is without a passage.

    goes_on: the last text is a part of one that does not end here, so no line end belongs to it.
    """
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    owner_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    kind = CLASS[data]
    inside = kind > 1
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = np.flatnonzero(first)
    n_words = np.searchsorted(starts, owner_end)
    per_text = np.diff(n_words, prepend=0)
    per_passages = np.maximum(1, -(-per_text // PASSAGE))
    offsets = np.concatenate([[0], np.cumsum(per_passages)])
    total = int(offsets[-1])
    x = np.zeros((total, STATS + BUCKETS), np.float32)
    text_of_word = np.repeat(np.arange(len(texts)), per_text)
    place = np.arange(len(starts)) - np.repeat(n_words - per_text, per_text)
    passage = offsets[text_of_word] + place // PASSAGE
    #: Bytes belong to the passage of the last word that began; those before a text's first word to its first passage.
    word = np.cumsum(first) - 1
    latest = np.where(word < 0, 0, passage[np.maximum(word, 0)]) if len(starts) else 0
    of_byte = np.maximum(latest, np.repeat(offsets[:-1], np.diff(owner_end, prepend=0)))
    counted = len(data) - goes_on
    shares = np.bincount(of_byte[:counted] * CLASSES + kind[:counted], minlength=total * CLASSES).reshape(total, CLASSES)
    x[:, :CLASSES] = shares / np.maximum(shares.sum(1, keepdims=True), 1)
    if not len(starts):
        return x, offsets[:-1]
    stops = np.flatnonzero(~inside[1:] & inside[:-1]) + 1
    length = stops - starts
    low = np.where(kind == 3, data + 32, data)
    mixed = _SALT[low] * (np.arange(1, len(data) + 1) - starts[np.maximum(word, 0)]).astype(np.uint64)
    mixed[~inside] = 0
    h = np.add.reduceat(mixed, starts)
    h ^= h >> np.uint64(31)
    words = np.bincount(passage, minlength=total)
    some = np.maximum(words, 1)
    x[:, CLASSES] = np.bincount(passage, weights=length, minlength=total) / some / 10
    x[:, CLASSES + 1] = np.bincount(passage, weights=np.minimum(length, 40.0) ** 2, minlength=total) / some / 100
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    x[:, CLASSES + 2] = np.bincount(passage, weights=same, minlength=total) / some
    key = np.sort((passage.astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    x[:, CLASSES + 3] = np.bincount((key[new] >> np.uint64(32)).astype(np.int64), minlength=total) / some
    x[:, CLASSES + 4] = np.minimum(words, PASSAGE) / PASSAGE
    x[:, CLASSES + 5] = np.bincount(passage, weights=kind[starts] == 3, minlength=total) / some
    bags = np.bincount(passage * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    x[:, STATS:] = np.sqrt(bags / some[:, None])
    return x, offsets[:-1]


def parts(text: bytes, size: int | None = None) -> Iterator[tuple[bytes, bool]]:
    """A text in parts of about ``size`` bytes that begin with a passage's first word, each with whether the text goes on."""
    size = size or CHUNK
    data, begin, words, before = np.frombuffer(text, np.uint8), 0, 0, False
    for at in range(0, len(data), size):
        inside = CLASS[data[at : at + size]] > 1
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        first[0] &= not before
        before = bool(inside[-1])
        starts = np.flatnonzero(first) + at
        heads = starts[(-words) % PASSAGE :: PASSAGE]
        words += len(starts)
        if len(heads) and heads[-1] > begin and (words > PASSAGE or len(heads) > 1):
            cut = int(heads[-1])
            yield text[begin:cut], True
            begin = cut
    yield text[begin:], False


def in_chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about a megabyte, which bounds what the features of one run need. A longer text is a run by itself."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > CHUNK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


class Model:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        d = STATS + BUCKETS
        self.mean, self.scale = np.zeros(d, np.float32), np.ones(d, np.float32)
        norm = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": norm(d, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": norm(HIDDEN, GATE), "U": norm(HIDDEN, GATE), "w": norm(GATE, 1)[:, 0], "c": np.zeros(HIDDEN, np.float32), "o": np.zeros(1, np.float32)}

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Inputs as they are learned from, encodings, both gates, and how much attention each passage asks for."""
        p = self.p
        x = np.clip((x - self.mean) * self.scale, -6, 6)
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return x, h, v, u, (v * u) @ p["w"]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, v, u, e = self.encoded(x)
        n = np.diff(np.append(first, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        a = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["o"][0], -30, 30)))
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "s": s, "n": n}

    def gradients(self, f: dict[str, np.ndarray], first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, d = self.p, ((f["s"] - y) / len(y)).astype(np.float32)
        dz = d[:, None] * p["c"]
        wide = np.repeat(dz, f["n"], axis=0)
        da = (wide * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, first), f["n"]))
        dg = de[:, None] * p["w"]
        dv, du = dg * f["u"] * (1 - f["v"] ** 2), dg * f["v"] * f["u"] * (1 - f["u"])
        dh = (wide * f["a"][:, None] + dv @ p["V"].T + du @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ dh, "b": dh.sum(0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ d, "o": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 4) -> Model:
        """Learn from the passages of each text."""
        x, first = np.concatenate(bags), np.cumsum([0, *(len(b) for b in bags[:-1])])
        self.mean, self.scale = x.mean(0), (1 / np.maximum(x.std(0), 0.02)).astype(np.float32)
        n = np.diff(np.append(first, len(x)))
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        rate = float(np.clip(y.mean(), 0.01, 0.99))
        self.p["o"][0] = np.log(rate / (1 - rate))
        t, steps = 0, epochs * -(-len(bags) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for k in range(0, len(order), BATCH):
                own = order[k : k + BATCH]
                rows = np.concatenate([np.arange(first[i], first[i] + n[i]) for i in own])
                at = np.concatenate([[0], np.cumsum(n[own])[:-1]])
                g = self.gradients(self.forward(x[rows], at), at, y[own])
                t += 1
                for q, v in g.items():
                    v = v + 1e-4 * self.p[q]
                    m[q] = 0.9 * m[q] + 0.1 * v
                    s[q] = 0.999 * s[q] + 0.001 * v * v
                    self.p[q] -= (0.01 * (1 - t / (steps + 1)) * (m[q] / (1 - 0.9**t)) / (np.sqrt(s[q] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def score_long(self, text: bytes) -> float:
        """The score of one text, part by part: attention weights stay relative to the largest so far."""
        top, total, pooled = -np.inf, 0.0, np.zeros(HIDDEN)
        for part, goes_on in parts(text):
            _, h, _, _, e = self.encoded(passages([part], goes_on)[0])
            new = max(top, float(e.max()))
            w, keep = np.exp(e.astype(float) - new), np.exp(top - new)
            top, total, pooled = new, total * keep + w.sum(), pooled * keep + w @ h
        return float(1 / (1 + np.exp(-np.clip(pooled / total @ self.p["c"] + self.p["o"][0], -30, 30))))

    def score(self, texts: list[bytes]) -> np.ndarray:
        each = (np.array([self.score_long(c[0])]) if len(c) == 1 and len(c[0]) > CHUNK else self.forward(*passages(c))["s"].astype(float) for c in in_chunks(texts))
        return np.concatenate([np.zeros(0), *each])


def learned(text: bytes) -> np.ndarray:
    """Features of all of a text's passages."""
    return np.concatenate([passages([p], goes_on)[0] for p, goes_on in parts(text)])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from documents whose id has a label. Both may be restricted beforehand to rows that may teach."""
    some = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_y"))
    some = some.orderBy(F.xxhash64(F.col("_id").cast("string")), "_id").limit(sample_docs)
    labelled = docs.select(F.col(doc_id), F.col(text).alias("t"), F.xxhash64(F.col(doc_id).cast("string")).alias("a"), F.xxhash64(text).alias("b")).join(F.broadcast(some), F.col(doc_id) == F.col("_id"))
    #: At most sample_docs rows of an id, a label and a text: bounded, whatever the tables hold.
    chosen = labelled.select("a", "b").distinct().orderBy("a", "b").limit(sample_docs)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("t")).cast(pa.large_binary())
            bags = [learned(x.as_py() or b"").astype(np.float32).tobytes() for x in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("a", "b")), batch.column(batch.schema.get_field_index("_y")).cast(pa.float64()), pa.array(bags, pa.binary())], names=["a", "b", "y", "x"])

    got = labelled.join(F.broadcast(chosen), ["a", "b"], "left_semi").select("a", "b", "_y", "t").mapInArrow(run, "a long, b long, y double, x binary")
    rows = got.groupBy("a", "b").agg(F.max("y").alias("y"), F.first("x").alias("x")).toArrow().sort_by([("a", "ascending"), ("b", "ascending")]).to_pylist()
    model = Model()
    if rows:
        model.fit([np.frombuffer(r["x"], np.float32).reshape(-1, STATS + BUCKETS) for r in rows], np.array([float(r["y"] > 0) for r in rows], np.float32))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, from 0 to 1."""
    return shielded(docs, {"text": text}, ADDED, lambda rows: _scored(rows, model))


def _scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    kept = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)
    into = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
            scores = m.score([x.as_py() or b"" for x in column])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(scores)], names=into.names)

    return docs.select(*kept).mapInArrow(run, into)
