import hashlib

from veritide.llm import sharding


def depth_of(rows, limit):
    """Split buckets one by one, as plainly as can be."""
    h = [(hashlib.md5(f"{i}\0{t or ''}".encode()).hexdigest()[:15], len((t or "").encode())) for i, t in rows]
    bit = [(f"{int(x, 16):060b}", b) for x, b in h]
    out = {}

    def grow(prefix):
        own = [k for k, (x, _) in enumerate(bit) if x.startswith(prefix)]
        if sum(bit[k][1] for k in own) > limit:
            grow(prefix + "0")
            grow(prefix + "1")
        else:
            for k in own:
                out[rows[k][0]] = (prefix, sum(bit[k][1] for k in own), len(own))

    grow("")
    return out


def test_only_oversized_buckets_split(spark):
    rows = [(i, "é" * (i * 37 % 211) if i % 7 else None) for i in range(300)]
    for limit in (500, 3000, 10**9):
        got = {r.doc_id: (r.shard, r.shard_bytes, r.shard_rows) for r in sharding.shard(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string"), limit).collect()}
        assert got == depth_of(rows, limit)


def test_equal_rows_overflow_and_a_large_row_stands_alone(spark):
    rows = [(1, "x" * 40)] * 25 + [(None, "y" * 10)] * 3 + [(2, "z" * 500), (3, "")]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 100).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.bytes)
    assert all(sum(b) == r.shard_bytes and len(b) == r.shard_rows for r in got for b in [sizes[r.shard]])
    assert all(sum(b) <= 100 for b in sizes.values() if b != [500]) and [500] in sizes.values()
    assert sum(b == [40, 40] for b in sizes.values()) == 12


def test_empty_and_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sharding.shard(docs.limit(0)).count() == 0
    sharding.write(docs, str(tmp_path / "out"), limit=100_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() > 1


def test_very_long_texts_and_no_hot_level(spark):
    """A text above the limit is a shard of its own; levels above the first that fits are not joined."""
    rows = [(i, "x" * (i % 90)) for i in range(500)] + [(999, "y" * 3_000_000), (None, "z" * 200_000), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.bytes): r for r in sharding.shard(docs, limit=2000).collect()}
    assert len(got) == len(rows) and got[999, 3_000_000].shard_rows == got[None, 200_000].shard_rows == 1
    sizes = {}
    for r in got.values():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.bytes
    assert all(sizes[r.shard] == r.shard_bytes and (r.shard_bytes <= 2000 or r.shard_rows == 1) for r in got.values())
