import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from veritide.llm import ann, queries, tokens

SF = "/root/testdata/sf0.01"


def true_neighbours(ids, x, i, k):
    d = np.sqrt(((x - x[i]) ** 2).sum(1))
    d[ids == ids[i]] = np.inf
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def test_recall_on_held_out_queries(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    ids, x = e.vec_id.to_numpy(), np.array(e.embedding.tolist(), float)
    got = {}
    for r in ann.search(spark.read.parquet(f"{SF}/embeddings.parquet"), every=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    found = 0
    for q, rows in got.items():
        rows.sort()
        assert [r for r, *_ in rows] == list(range(1, 11)) and [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        i = int(np.flatnonzero(ids == q)[0])
        near, _ = true_neighbours(ids, x, i, 10)
        found += len({v for _, v, _ in rows} & {*near.tolist()})
        assert all(abs(s - np.sqrt(((x[i] - x[ids == v][0]) ** 2).sum())) < 1e-12 for _, v, s in rows)
    assert len(got) == 100 and found >= 0.9 * 1000


def test_hot_vector_nulls_and_repeats(spark):
    r = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, r.standard_normal(3).tolist()) for i in range(200)]
    rows += [(500, None), (600, [0.0, 0.0, 0.0]), (700, [1.0, None, 2.0]), (800, [float("nan"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (900, [1.0, 2.0]), (100, [1.0, 2.0, 3.0]), (1001, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in ann.search(df, sample=200).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    assert set(got) == {0, 100, 200, 1000, 1100}
    assert [v for _, v, s in sorted(got[100]) if s == 0] == list(range(10))
    assert [v for _, v, _ in sorted(got[0])] == list(range(1, 11))
    assert all(len({v for _, v, _ in x}) == 10 for x in got.values())


def test_an_id_in_many_equal_rows_hides_no_other(spark):
    rows = [(0, [1.0, 2.0])] * 40 + [(i, [1.0, 2.0]) for i in range(1, 15)] + [(200 + i, [5.0 + i, 9.0]) for i in range(20)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)).where("query_id = 0").orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in got] == [(i, 0.0) for i in range(1, 11)]


def test_traversal_is_best_bin_first_and_widens_by_query():
    r = np.random.default_rng(5)
    x = np.concatenate([r.standard_normal((400, 6)) * 0.05 + c for c in r.standard_normal((8, 6)) * 4])
    tree = ann.Tree(x, 20)
    everything, far = tree.best_bins(x[0], float("inf"))
    assert sorted(everything) == list(range(tree.leaves)) and far == sorted(far) and far[0] == 1
    reach = far[len(far) // 3]
    some, _ = tree.best_bins(x[0], reach)
    assert some == everything[: len(some)] and far[len(some) - 1] <= reach < far[len(some)]
    assert len({len(tree.best_bins(v, reach)[0]) for v in x[::50]}) > 1


def test_a_query_goes_once_to_a_group_and_groups_are_bounded(spark, monkeypatch):
    """Leaves of all sizes in groups, one of many rows over several; queries in parts; every leaf visited, so the answer is exact."""
    first, over = ann._groups({0: 3, 1: 4, 2: 5, 3: 30, 4: 2, 6: 9}, 7, 10)
    assert first.tolist() == [0, 0, 1, 2, 5, 5, 6] and over.tolist() == [1, 1, 1, 3, 1, 1, 1]
    r = np.random.default_rng(3)
    x = np.concatenate([r.standard_normal((500, 8)), np.repeat(r.standard_normal((1, 8)), 150, 0) + r.standard_normal((150, 8)) * 1e-3]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    for name, value in (("GROUP", 64), ("QUERIES", 40), ("SENT", 7), ("BLOCK", 16), ("LEAF_ROWS", 20)):
        monkeypatch.setattr(ann, name, value)
    moved, plain = [], ann._asked
    monkeypatch.setattr(ann, "_asked", lambda *a: moved.append(plain(*a)) or moved[-1])
    got = sorted((g.query_id, g["rank"], g.vec_id) for g in ann.search(df, every=5, recall=1.0).collect())
    want = [(q, n + 1, int(v)) for q in range(0, 650, 5) for n, v in enumerate(true_neighbours(np.arange(650), x.astype(float), q, 10)[0])]
    assert len({*got} & {*want}) >= 0.97 * len(want) and len(got) == len(want)
    rows = moved[0].groupBy("group", "q_id").count().collect()
    assert {g["count"] for g in rows} == {1} and len({g.q_id for g in rows}) == 130 and len({g.group for g in rows}) > 5


def test_extra_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(k * 50, [float(k), 1.0], k, "x") for k in range(8)], "vec_id long, embedding array<float>, query_id int, score string")
    got = ann.search(df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and got.where("query_id = 0").orderBy("rank").first().vec_id == 50


def test_few_and_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [(x["rank"], x.vec_id, x.score) for x in ann.search(df).orderBy("rank").collect()] == [(1, 2, 0.5), (2, 1, 1.0)]
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.limit(1)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers())
def test_permutation_is_a_bijection(n, key):
    f = tokens.Feistel(n, key)
    slots = f.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and (f.indexes(slots) == np.arange(n)).all()


def test_round_trip_shards_and_resumption(spark, tmp_path):
    texts = [None, "", "Hello  world\n", "é ü <|endoftext|> 漢字 \U0001f600", "word " * 3000, "same", "same", " \n\n x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, "same")], "doc_id long, text string")
    tok = tokens.Tokenizer()
    ordered = tokens.in_training_order(docs.repartition(3), tok, length=64, per_shard=8)
    rows = ordered.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and all(len(r.tokens) == 128 and r.shard == r.slot // 8 and r.offset == r.slot % 8 * 128 for r in rows)
    parts = {}
    for r in sorted(rows, key=lambda r: r.seq_no):
        if r.doc_id not in (None, 5):
            parts.setdefault(r.doc_id, []).append(np.frombuffer(r.tokens, "<u2")[: r.n_tokens])
    for i, t in enumerate(texts):
        if i != 5:
            ids = np.concatenate(parts[i])
            assert tok.decode(ids) == (t or "") and ids[-1] == tok.end and (ids == tok.end).sum() == 1
    uri = f"file://{tmp_path}/shards"
    manifest = {m.shard: m for m in tokens.write_shards(ordered, uri).collect()}
    assert set(manifest) == set(range(-(-len(rows) // 8))) and sum(m.n for m in manifest.values()) == len(rows)
    for k, m in manifest.items():
        body = (tmp_path / "shards" / f"shard-{k:08d}.bin").read_bytes()
        assert hashlib.sha256(body).hexdigest() == m.sha256 and len(body) == m.bytes == m.n * 128
    by_slot = {r.slot: r.tokens for r in rows}
    for start in (0, 7, 8, 13):
        assert [x.tobytes() for x in tokens.read_slots(uri, start, 8, 64)] == [by_slot[s] for s in range(start, len(rows))]
    #: A broken shard is written again, the others stay.
    kept = (tmp_path / "shards" / "shard-00000001.bin").stat().st_mtime_ns
    (tmp_path / "shards" / "shard-00000000.bin").write_bytes(b"short")
    assert {m.sha256 for m in tokens.write_shards(ordered, uri).collect()} == {m.sha256 for m in manifest.values()}
    assert (tmp_path / "shards" / "shard-00000001.bin").stat().st_mtime_ns == kept
    assert hashlib.sha256((tmp_path / "shards" / "shard-00000000.bin").read_bytes()).hexdigest() == manifest[0].sha256
    assert tokens.in_training_order(docs.limit(0), tok).count() == 0


def test_long_texts_are_tokenised_in_runs(monkeypatch):
    tok = tokens.Tokenizer()
    texts = ["one two  three\n four 's\n\n five 12 ab!? \u3000x y " * 40, "x" * 900, " lead and trail ", "a\nb c\td " * 30]
    whole = [tok.encode(t).tolist() for t in texts]
    for run in (1, 7, 50):
        monkeypatch.setattr(tokens, "RUN", run)
        assert [tok.encode(t).tolist() for t in texts] == whole
        assert all("".join(tok.runs(t)) == t for t in texts)


def test_codec_gives_back_what_it_packed():
    r = np.random.default_rng(0)
    rows = [r.zipf(1.4, n).astype("<u2").tobytes() for n in [*[512] * 300, 1, 0, 77]]
    for code in (tokens.Codec(rows), tokens.Codec([])):
        assert [code.unpack(code.pack(x)) for x in rows] == rows


def test_extra_columns_and_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "same", 5, "x")] * 3 + [(None, None, 6, "y")] * 2, "doc_id long, text string, slot int, tokens string")
    rows = tokens.in_training_order(docs, length=16, per_shard=2).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(5)) and sorted((r.doc_id or 0) for r in rows) == [0, 0, 1, 1, 1]
    assert rows[0].__fields__ == ["slot", "shard", "offset", "doc_id", "seq_no", "n_tokens", "tokens"]


def test_order_depends_on_key_and_partitions_are_ranges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    a = tokens.in_training_order(docs, per_shard=100)
    parts = a.rdd.mapPartitions(lambda rows: iter([[r.slot for r in rows]])).collect()
    assert all(p == sorted(p) for p in parts) and [s for p in parts for s in p] == list(range(sum(map(len, parts))))
    first = lambda df: [(r.doc_id, r.seq_no) for r in df.where("slot < 20").orderBy("slot").collect()]
    assert first(a) == first(tokens.in_training_order(docs, per_shard=64)) != first(tokens.in_training_order(docs, key=1))


def test_query_returns_every_sequence(spark):
    got = queries.op1_token_output(spark, "/root/testdata/sf0.001")
    assert got.select("doc_id").distinct().count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_query_and_stage_write_every_shard(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for k, make in enumerate((lambda: queries.op1_token_output(spark, "/root/testdata/sf0.001"), lambda: corpus_pipeline.token_output(spark, docs, ""))):
        monkeypatch.setattr(tokens, "new_dir", lambda *_, k=k: f"file://{tmp_path}/{k}")
        rows = sorted(make().collect(), key=lambda r: r.slot)
        assert [x.tobytes() for x in tokens.read_slots(f"file://{tmp_path}/{k}")] == [r.tokens for r in rows]
        assert {(r.shard, r.bytes, r.sha256) for r in rows} == {(j, len(b), hashlib.sha256(b).hexdigest()) for j, b in enumerate(x.read_bytes() for x in sorted((tmp_path / str(k)).iterdir()))}


def test_rows_go_through_shards(spark, tmp_path):
    """In one wave or in more waves than shards, files and rows are the same."""
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 40)) for i in range(300)], "doc_id long, text string").repartition(3)
    ordered = tokens.in_training_order(docs, length=32, per_shard=7)
    manifest = {m.shard: (m.bytes, m.sha256) for m in tokens.write_shards(ordered, f"file://{tmp_path}/whole").collect()}
    for waves in (1, 4, 500):
        uri = f"file://{tmp_path}/{waves}"
        rows = sorted(tokens.to_shards(docs, uri, length=32, per_shard=7, waves=waves).collect(), key=lambda r: r.slot)
        assert [r[:7] for r in rows] == sorted(tuple(r) for r in ordered.collect())
        assert [x.tobytes() for x in tokens.read_slots(uri, 0, 7, 32)] == [r.tokens for r in rows]
        assert {r.shard: (r.bytes, r.sha256) for r in rows} == manifest
    assert tokens.to_shards(docs.limit(0)).count() == 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_stores_have_the_names_that_spark_uses(tmp_path):
    from pyarrow import fs

    for uri in ("s3a://bucket/a/b", "s3n://bucket/a/b", "s3://bucket/a/b"):
        store, path = tokens.store_at(uri + "?region=eu-west-1")
        assert isinstance(store, fs.S3FileSystem) and path == "bucket/a/b"
    store, path = tokens.store_at(f"file://{tmp_path}/x")
    assert isinstance(store, fs.LocalFileSystem) and path == f"{tmp_path}/x"
