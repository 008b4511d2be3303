"""Tables that change together, through crashes at any step; an index that takes changes, against one built anew."""

import random

import pytest
from pyspark.sql import functions as F

from veritide.operators import graph, incremental, retrieval
from veritide.plans.catalog import QUERIES
from veritide.sources import store, tables, versions


def both(spark, root):
    found = versions.tables(spark, root, ["a", "b"])
    return [found[n].first().x for n in "ab"]


def write(spark, root, x):
    return versions.write({n: spark.createDataFrame([(x,)], "x int") for n in "ab"}, root)


@pytest.mark.parametrize("step", ["first table", "second table", "manifest bytes", "manifest name", "vacuum"])
def test_a_crash_between_any_two_steps_leaves_one_whole_version(spark, tmp_path, monkeypatch, step):
    root = f"file://{tmp_path}/r"
    write(spark, root, 1)
    write(spark, root, 2)
    calls = []

    def crash(*_a, **_k):
        raise RuntimeError("crash")

    put, publish = versions.put, versions.publish

    def failing_put(df, root, name):
        calls.append(name)
        if len(calls) == {"first table": 1, "second table": 2}.get(step):
            df = df.withColumn("x", F.raise_error(F.lit("crash")).cast("int"))
        return put(df, root, name)

    def torn_publish(spark, root, number, said):
        if step == "manifest bytes":
            fs, passing = versions._at(spark, f"{root}/{versions.FOLDER}/.torn")
            stream = fs.create(passing, False)
            stream.write(bytearray(b'{"tab'))
            stream.close()
            crash()
        if step == "manifest name":
            crash()
        return publish(spark, root, number, said)

    monkeypatch.setattr(versions, "put", failing_put)
    monkeypatch.setattr(versions, "publish", torn_publish)
    if step == "vacuum":
        monkeypatch.setattr(versions, "vacuum", crash)
    with pytest.raises(Exception, match="crash"):
        write(spark, root, 3)
    assert both(spark, root) == ([3, 3] if step == "vacuum" else [2, 2])
    monkeypatch.undo()
    write(spark, root, 4)
    assert both(spark, root) == [4, 4]
    kept = {n for n in versions._names(spark, root) if n != versions.FOLDER}
    assert len(kept) == 4 and versions.numbers(spark, root) == versions.numbers(spark, root)[-2:]


def test_a_reader_keeps_the_version_it_opened(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    write(spark, root, 1)
    held = versions.tables(spark, root, ["a", "b"])
    write(spark, root, 2)
    assert [held[n].first().x for n in "ab"] == [1, 1] and both(spark, root) == [2, 2]
    (tmp_path / "r" / "notes.txt").write_text("not ours")
    number = versions.read(spark, root)[0]
    write(spark, root, 3)
    with pytest.raises(versions.Conflict):
        versions.write({"a": spark.range(1)}, root, over=number)
    assert both(spark, root) == [3, 3] and (tmp_path / "r" / "notes.txt").exists()
    with pytest.raises(FileNotFoundError):
        versions.tables(spark, root, ["c"])
    assert versions.read(spark, f"file://{tmp_path}/none") == (0, {})


def test_a_graph_is_replaced_from_what_it_holds(spark, tmp_path):
    """A new version may be made from the one it replaces."""
    root = f"file://{tmp_path}/g"
    people = spark.createDataFrame([("e1", "One")], "entity_id string, name string")
    links = spark.createDataFrame([("e1", "knows", "e1", "x", 1, 1.0, None)], tables.EDGE)
    graph.save(people, links, root)
    for n in range(2, 5):
        entities, relations = graph.load(spark, root)
        graph.save(entities.unionByName(spark.createDataFrame([(f"e{n}", "More")], "entity_id string, name string")), relations.unionByName(relations).distinct(), root)
    entities, relations = graph.load(spark, root)
    assert sorted(r.entity_id for r in entities.collect()) == ["e1", "e2", "e3", "e4"] and relations.count() == 1


WORDS = [f"w{k}" for k in range(40)]


def as_frame(spark, rows):
    return spark.createDataFrame([(i, p, t, v) for i, (p, t, v) in rows.items()], "chunk_id string, chunk_pos long, text string, embedding array<double>")


def found(spark, index, vectors):
    asked = spark.createDataFrame([(n, f"w{n} w{n + 7} w1 nothing") for n in range(12)], "qid int, query string")
    near = spark.createDataFrame([(n, [float(n), 1.0, -float(n % 3)]) for n in range(5)], "qid int, qvec array<double>")
    sparse = sorted(tuple(r) for r in retrieval.bm25(index, asked).collect())
    return sparse, sorted(tuple(r) for r in retrieval.dense(vectors, near, 4).collect())


def test_changes_and_merges_equal_an_index_built_anew(spark, tmp_path):
    r, root, now = random.Random(0), f"file://{tmp_path}/s", {}
    for step in range(9):
        if step in (3, 6, 8):
            gone = r.sample(sorted(now), min(len(now), 6)) + ["never there"]
            incremental.delete(spark.createDataFrame([(i,) for i in gone], "chunk_id string"), root)
            now = {i: x for i, x in now.items() if i not in gone}
        else:
            ids = {f"c{r.randrange(40)}" for _ in range([20, 3, 5, 0, 4, 6, 0, 9][step])}
            new = {i: (int(i[1:]), r.choice(["", " ".join(r.choices(WORDS, k=r.randrange(1, 12)))]), r.choice([None, [r.random() for _ in range(3)]])) for i in ids}
            incremental.upsert(as_frame(spark, new), root)
            now |= new
        if step in (4, 8):
            before = len(incremental.state(spark, root).segments)
            assert len(incremental.merge(spark, root, everything=step == 8).segments) < before
        if step in (4, 7, 8):
            index = incremental.opened(spark, root)
            fresh = as_frame(spark, now)
            assert found(spark, index, incremental.vectors(spark, root)) == found(spark, retrieval.build_index(fresh), fresh)
            assert index.size == len(now)
            built = {x.term: x.df for x in retrieval.build_index(fresh).terms.collect()}
            assert {x.term: x.df for x in index.terms.collect()} == built
    assert len(incremental.state(spark, root).segments) == 1
    with pytest.raises(ValueError, match="twice"):
        incremental.upsert(spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", None)], "chunk_id string, chunk_pos long, text string, embedding array<double>"), root)


def test_which_segments_merge():
    rows = lambda *n: [{"rows": x} for x in n]
    assert incremental.due(rows(16, 1, 1, 1)) is None and incremental.due(rows(1, 1, 1)) is None
    assert incremental.due(rows(100, 1, 1, 1, 1)) == [1, 2, 3, 4] and incremental.due(rows(0, 0, 0, 0)) == [0, 1, 2, 3]
    sizes, written = [], 0
    for _ in range(1000):
        sizes.append({"rows": 1})
        while run := incremental.due(sizes):
            sizes[run[0] : run[-1] + 1] = [{"rows": sum(sizes[k]["rows"] for k in run)}]
            written += sizes[run[0]]["rows"]
    assert len(sizes) < 30 and written < 1000 * 10


def test_a_change_writes_what_is_large_once(spark, tmp_path, monkeypatch):
    """Chunks and postings go to the root alone, whatever the change: none is stored beside it and copied."""
    root, beside = f"file://{tmp_path}/i", []
    written = store.written
    monkeypatch.setattr(store, "written", lambda df, name, path=None: beside.append(name if path is None else "root") or written(df, name, path))
    kind = "chunk_id string, chunk_pos long, text string, embedding array<double>"
    for k in range(4):
        incremental.upsert(spark.createDataFrame([(f"{k}{n}", k * 10 + n, "some words here", None) for n in range(4)], kind), root)
    incremental.delete(spark.createDataFrame([("00",)], "chunk_id string"), root)
    incremental.merge(spark, root)
    assert not {"upsert", "merged", "postings"} & set(beside) and beside.count("root") == 5
    #: The ids of each change lie apart from its texts, or their size is taken for that of texts and all postings are shuffled to meet them.
    assert beside.count("ids") == 5
    assert sorted(r.chunk_id for r in incremental.opened(spark, root).chunks.collect()) == sorted(f"{k}{n}" for k in range(4) for n in range(4) if (k, n) != (0, 0))


def test_texts_of_hits_are_not_shuffled(spark):
    """A few hits go to the texts, not the texts to them."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "100000")
    try:
        plan = QUERIES["merge_evidence"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert "BroadcastHashJoin [chunk_id" in plan and "SortMergeJoin [chunk_id" not in plan
