"""Training-order materialisation: token ids in fixed-stride slots of a keyed random order.

1. Texts are tokenised (byte-level BPE read from a file, never trained), each ended by an end-of-text id, and cut into
   sequences of ``length`` ids, the last one filled up with the end-of-text id. Nothing is dropped or cut off.
2. The stored sequences are numbered 0..N-1 by task and place in the task. Only one count a task is gathered for it.
3. A keyed Feistel network permutes the smallest even-bit domain that holds N; numbers that leave 0..N-1 walk on along their
   cycle until they are back. That gives each sequence its slot: a bijection that needs no sort, no shuffle of keys and no
   state but the key, and can be inverted.
4. Sequences are stored and shuffled packed: one by one, by a codec with a dictionary from a few texts, on which only their size depends.
5. Range partitions of slots are sorted, so a shard is a run of slots, and slot s stands at byte
   (s mod per_shard) * stride of shard s div per_shard. A reader resumes from a slot number alone.

Defined cases: a null or empty text is one sequence with the end-of-text id alone; repeated rows and equal or null ids get slots of
their own; a very long text is tokenised in runs of about a megabyte, cut where no token can lie across; an empty table gives no
slots. Of extra columns none is read or returned, whatever their names. Ids are little-endian unsigned 16-bit numbers, which the
vocabulary's size is checked against.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, new_dir, tasks, tidy

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that this vocabulary was made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH, PER_SHARD, ROUNDS, WAVES = 512, 8192, 6, 3
#: Characters in a run of a long text; texts and characters of each that the dictionary is made from, and its bytes.
RUN, DICT_DOCS, DICT_CHARS, DICT_BYTES = 1 << 20, 400, 20_000, 1 << 18
#: A space between two words belongs to the second: no token lies across its left side.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Tokenizer:
    """Byte-level BPE from a file of ranks; the id after the last rank ends a text."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.end = max(self.ranks.values()) + 1
        if self.end > 65535:
            raise ValueError("ids must fit 16 bits")
        self._encoding = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoding": None}

    @property
    def encoding(self):
        if self._encoding is None:
            import tiktoken

            self._encoding = tiktoken.Encoding("veritide", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        return self._encoding

    def runs(self, text: str) -> Iterator[str]:
        """The text in parts that can be tokenised one by one."""
        at = 0
        while len(text) - at > RUN and (cut := _BETWEEN.search(text, at + RUN)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str | None) -> np.ndarray:
        ids = [self.encoding.encode_to_numpy(r).astype("<u2") for r in self.runs(text)] if text else []
        return np.concatenate([*ids, np.array([self.end], "<u2")])

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode([int(i) for i in ids if i != self.end])


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x ^ key) * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    return x ^ (x >> np.uint64(32))


class Feistel:
    """A keyed bijection of 0..n-1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        digest = hashlib.blake2b(str(key).encode(), digest_size=8 * ROUNDS).digest()
        self.keys = np.frombuffer(digest, np.uint64)

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for k in self.keys[::-1] if back else self.keys:
            left, right = (right ^ (_mix(left, k) & mask), left) if back else (right, left ^ (_mix(right, k) & mask))
        return (left << bits) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(x.astype(np.uint64), back)
        while len(out := np.flatnonzero(x >= np.uint64(self.n))):
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slots(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def indexes(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


class Codec:
    """Packs a sequence's bytes by itself; the dictionary is a matter of size alone."""

    def __init__(self, samples: list[bytes]):
        self.dictionary = b""
        if len(samples) >= 100:
            try:
                self.dictionary = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
            except zstandard.ZstdError:  # too little to learn from
                self.dictionary = b""
        self._pack = self._unpack = None

    def __getstate__(self) -> dict:
        return {"dictionary": self.dictionary, "_pack": None, "_unpack": None}

    def pack(self, data: bytes) -> bytes:
        if self._pack is None:
            d = {"dict_data": zstandard.ZstdCompressionDict(self.dictionary)} if self.dictionary else {}
            self._pack = zstandard.ZstdCompressor(level=3, write_checksum=False, write_dict_id=False, **d).compress
        return self._pack(data)

    def unpack(self, data: bytes) -> bytes:
        if self._unpack is None:
            d = {"dict_data": zstandard.ZstdCompressionDict(self.dictionary)} if self.dictionary else {}
            self._unpack = zstandard.ZstdDecompressor(**d).decompress
        return self._unpack(data)


def codec(docs: DataFrame, tokenizer: Tokenizer, length: int, text: str) -> Codec:
    """A codec from the passages of a few rows, whichever come first."""
    got = docs.select(F.substring(text, 1, DICT_CHARS).alias("t")).where(F.length("t") > 0).limit(DICT_DOCS).collect()
    ids = [tokenizer.encode(r["t"]).tobytes() for r in got]
    return Codec([i[k : k + 2 * length] for i in ids for k in range(0, len(i), 2 * length)])


def sequences(docs: DataFrame, tokenizer: Tokenizer, codec: Codec, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, seq_no, n_tokens, packed (tokens without what fills them up), with the task and the place in it."""
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, codec))
    into = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *(T.StructField(n, t) for n, t in (("seq_no", T.LongType()), ("n_tokens", T.IntegerType()), ("packed", T.BinaryType()), ("_task", T.LongType()), ("_place", T.LongType())))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tok, code), task, place = shared.value, TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            ids, seqs, counts, data = zip(*held, strict=True)
            n = len(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(seqs, pa.int64()), pa.array(counts, pa.int32()), pa.array(data, pa.binary()), pa.array([task] * n, pa.int64()), pa.array(range(place - n, place), pa.int64())], names=into.names)

        for batch in batches:
            own = batch.column(batch.schema.get_field_index(doc_id))
            for i, t in zip(own, batch.column(batch.schema.get_field_index(text)), strict=True):
                key, e = i.as_py(), tok.encode(t.as_py())
                raw = e.tobytes()
                for k in range(0, len(e), length):
                    held.append((key, k // length, min(length, len(e) - k), code.pack(raw[2 * k : 2 * (k + length)])))
                    place += 1
                    if len(held) == 8192:
                        yield flush(own.type)
            if held:
                yield flush(own.type)

    return docs.select(doc_id, text).mapInArrow(run, into)


class _Slots:
    """The stored sequences of a table, and which slot each has: everything that a task needs to tell it."""

    def __init__(self, docs: DataFrame, tokenizer: Tokenizer, code: Codec, key: int, length: int, per_shard: int, text: str, doc_id: str):
        self.stored = materialise(sequences(docs, tokenizer, code, length, text, doc_id), "sequences")
        #: One number a task: at which sequence it starts.
        counts = np.array(sorted(map(tuple, self.stored.groupBy("_task").count().collect())), np.int64).reshape(-1, 2)
        self.starts = np.zeros(int(counts[:, 0].max(initial=-1)) + 1, np.int64)
        self.starts[counts[:, 0]] = np.cumsum(counts[:, 1]) - counts[:, 1]
        self.n = int(counts[:, 1].sum())
        self.shards = -(-self.n // per_shard)
        self.order, self.code, self.length, self.per_shard = Feistel(self.n, key), code, length, per_shard
        self.fill = np.full(length, tokenizer.end, "<u2").tobytes()

    def rows(self, columns: list[str], first: int, last: int, whole: bool) -> DataFrame:
        """slot, shard, offset, the columns, and packed (or whole: tokens of full length) of the sequences in shards from first up to last, not in order."""
        spark, kind = self.stored.sparkSession, self.stored.schema
        shared = spark.sparkContext.broadcast((self.starts, self.order, self.code, self.fill))
        per_shard, stride = self.per_shard, 2 * self.length
        into = T.StructType([*(T.StructField(n, T.LongType()) for n in ("slot", "shard", "offset")), *(kind[c] for c in columns), T.StructField("tokens" if whole else "packed", T.BinaryType())])

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts, order, code, fill = shared.value
            for batch in batches:
                slot = order.slots(starts[batch.column(0).to_numpy()] + batch.column(1).to_numpy())
                shard = slot // per_shard
                here = (shard >= first) & (shard < last)
                some, slot, shard = batch.filter(pa.array(here)), slot[here], shard[here]
                data = some.column(some.num_columns - 1)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(shard), pa.array(slot % per_shard * stride), *some.columns[2:-1], _unpacked(data, code, fill) if whole else data], names=into.names)

        return self.stored.select("_task", "_place", *columns, "packed").mapInArrow(run, into)


def _ranged(numbered: DataFrame, first: int, last: int, length: int, per_shard: int, least: int) -> DataFrame:
    """The rows of the shards from first up to last, partitioned by ranges of whole shards, sorted by slot. A range holds about half a gigabyte at most."""
    some = max(1, last - first)
    ranges = min(some, max(least, -(-some * per_shard * 2 * length // (512 << 20))))
    return numbered.repartitionById(ranges, F.floor((F.col("shard") - first) * ranges / some).cast("int")).sortWithinPartitions("slot")


def _unpacked(packed: pa.Array, code: Codec, fill: bytes) -> pa.Array:
    """Packed sequences as tokens of full length."""
    raw = (code.unpack(x.as_py()) for x in packed)
    return pa.array([r + fill[len(r) :] for r in raw], pa.binary())


def in_training_order(docs: DataFrame, tokenizer: Tokenizer | None = None, key: int = 20240601, length: int = LENGTH, per_shard: int = PER_SHARD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """slot, shard, offset (byte in the shard), doc_id, seq_no, n_tokens, tokens; partitioned by ranges of whole shards, sorted by slot."""
    tokenizer = tokenizer or Tokenizer()
    slots = _Slots(docs, tokenizer, codec(docs, tokenizer, length, text), key, length, per_shard, text, doc_id)
    return _whole(_ranged(slots.rows(["doc_id", "seq_no", "n_tokens"], 0, slots.shards, False), 0, slots.shards, length, per_shard, tasks(docs.sparkSession)), slots)


def _whole(packed: DataFrame, slots: _Slots) -> DataFrame:
    """packed with tokens of full length in place of its last column."""
    code, fill = slots.code, slots.fill
    into = T.StructType([*packed.schema.fields[:-1], T.StructField("tokens", T.BinaryType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _unpacked(b.column(b.num_columns - 1), code, fill)], names=into.names)

    return packed.mapInArrow(run, into)


class _Shards:
    """Writes ``shard-N.bin`` files of fixed stride to a folder.

    A shard appears under its name only when whole (written beside it, then moved), so a lost executor leaves nothing half
    done, and a shard that is there already with the right size and sum is not written again.
    """

    def __init__(self, uri: str):
        from pyarrow import fs

        self.absent = fs.FileType.NotFound
        self.store, self.root = store_at(uri)
        self.store.create_dir(self.root)

    def close(self, shard: int, parts: list[bytes]) -> tuple[int, int, int, str]:
        """The shard's line of the manifest."""
        body = b"".join(parts)
        name, digest = f"{self.root}/shard-{shard:08d}.bin", hashlib.sha256(body).hexdigest()
        info = self.store.get_file_info(name)
        if info.type == self.absent or info.size != len(body) or hashlib.sha256(self.store.open_input_stream(name).read()).hexdigest() != digest:
            with self.store.open_output_stream(part := f"{self.root}/.part-{uuid.uuid4().hex}") as f:
                f.write(body)
            self.store.move(part, name)
        return shard, len(parts), len(body), digest


def _written(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    """shard, n, bytes, sha256 of each shard that the batches (shard, tokens; in order) are written to. A shard is held at a time."""
    shards, at, held, done = _Shards(uri), None, [], []

    def close() -> None:
        if held:
            done.append(shards.close(at, [t.as_py() for c in held for t in c]))
            held.clear()

    for batch in batches:
        own, tokens = batch.column(batch.schema.get_field_index("shard")).to_numpy(), batch.column(batch.schema.get_field_index("tokens"))
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if own[a] != at:
                close()
            at = int(own[a])
            held.append(tokens.slice(a, b - a))
    close()
    columns = zip(*done, strict=True) if done else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["shard", "n", "bytes", "sha256"])


MANIFEST = "shard long, n long, bytes long, sha256 string"


def write_shards(ordered: DataFrame, uri: str, slots: _Slots | None = None) -> DataFrame:
    """Write ``shard-N.bin`` files of fixed stride from in_training_order(), or from its rows still packed; shard, n, bytes, sha256 of each."""
    code, fill = (slots.code, slots.fill) if slots else (None, b"")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = (b if code is None else pa.RecordBatch.from_arrays([b.column(0), _unpacked(b.column(1), code, fill)], names=["shard", "tokens"]) for b in batches)
        return _written(whole, uri)

    return materialise(ordered.select("shard", "packed" if slots else "tokens").mapInArrow(run, MANIFEST), "shards")


@contextmanager
def _shuffles_end_with_their_job(spark: SparkSession) -> Iterator[None]:
    """While this holds, what a write has shuffled is deleted once it is written, not when the driver's memory is next tidied."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def to_shards(docs: DataFrame, uri: str | None = None, tokenizer: Tokenizer | None = None, key: int = 20240601, length: int = LENGTH, per_shard: int = PER_SHARD, waves: int = WAVES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The whole job: shard files under uri (a folder in the shared one, if None), and in_training_order's rows, not in order, with bytes and sha256 of their shard's file.

    Shards are written in waves: each shuffles and sorts the sequences of a run of shards, so shuffled data never hold more than
    one wave's, and after a failure whole waves of files are there already.
    """
    spark, tokenizer = docs.sparkSession, tokenizer or Tokenizer()
    uri = uri or new_dir(spark, "training")
    slots = _Slots(docs, tokenizer, codec(docs, tokenizer, length, text), key, length, per_shard, text, doc_id)
    bounds = [slots.shards * w // waves for w in range(waves + 1)]
    manifest = None
    with _shuffles_end_with_their_job(spark):
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            if first < last:
                some = slots.rows([], first, last, False).select("slot", "shard", "packed")
                own = write_shards(_ranged(some, first, last, length, per_shard, tasks(spark)), uri, slots)
                manifest = own if manifest is None else manifest.unionByName(own)
    if manifest is None:
        manifest = spark.createDataFrame([], MANIFEST)
    sums = manifest.select(F.col("shard").alias("_shard"), "bytes", "sha256")
    rows = slots.rows(["doc_id", "seq_no", "n_tokens"], 0, slots.shards, True)
    return rows.join(sums, F.col("shard") == F.col("_shard")).drop("_shard")


#: Names that Hadoop gives to stores, and those that the same stores have here.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def store_at(uri: str):
    """(file system, path) of a folder as Spark names it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


def read_slots(uri: str, start: int = 0, per_shard: int = PER_SHARD, length: int = LENGTH) -> Iterator[np.ndarray]:
    """The sequences from a slot on, in training order: one seek, then sequential reads."""
    from pyarrow import fs

    store, root = store_at(uri)
    shard, within = divmod(start, per_shard)
    while store.get_file_info(name := f"{root}/shard-{shard:08d}.bin").type != fs.FileType.NotFound:
        with store.open_input_file(name) as f:
            f.seek(within * 2 * length)
            while body := f.read(2 * length):
                yield np.frombuffer(body, "<u2")
        shard, within = shard + 1, 0

