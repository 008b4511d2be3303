"""Packets, ablations, embedders, the stored index and atomic tables: what queries with SQL do not reach."""

import os

import pytest
from pyspark.sql import functions as F

from veritide.operators import chunking, embedding, evaluate, graph, ingest, packets, retrieval
from veritide.plans.fixtures import Views
from veritide.sources import store, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    """Lines as chunks, vectors of a hashing embedder, and a graph of nations."""
    v = Views(spark, SF)
    e = embedding.hashing(32)
    index = retrieval.build_index(v.chunks(), f"chunks {SF}")
    vectors = store.stored(embedding.chunks(v.chunks().select("chunk_id", "text"), e).select("chunk_id", "embedding"), "vectors")
    nations = v.entities().where(F.col("type") == "Location").withColumn("doc_ids", F.array(F.concat(F.split_part("entity_id", F.lit("_"), F.lit(3)), F.lit(".md"))))
    seeds = v.queries().select("qid", F.concat(F.lit("ent_region_"), (F.col("qid") % 5).cast("string")).alias("entity_id"))
    questions = embedding.queries(v.queries().withColumn("suite", F.col("qid") % 2), e)
    return evaluate.Corpus(index, vectors, seeds, v.places(), nations), questions, v.gold().withColumn("doc_id", F.col("doc_id"))


def test_all_seven_configurations(spark, corpus):
    c, questions, gold = corpus
    rows = {(r.suite, r.config): r for r in evaluate.ablation(c, questions, gold).collect()}
    assert len(rows) == 14 and all(0 <= r.recall <= 1 and r.questions == 20 for r in rows.values())
    assert rows[0, "1. BM25 only"].recall > 0.5
    for name, config in evaluate.ABLATION.items():
        places = evaluate.hits(c, questions, config).groupBy("qid").agg(F.count("*").alias("n"), F.max("rank").alias("last"), F.count_distinct("chunk_id").alias("d")).collect()
        assert all(r.n == r.last == r.d <= config.k for r in places), name


def test_empty_indexes_are_refused(spark, corpus):
    c, questions, gold = corpus
    empty = evaluate.Corpus(c.index, c.vectors.limit(0))
    with pytest.raises(ValueError, match="vectors"):
        evaluate.ablation(empty, questions, gold, {"d": retrieval.SearchConfig(mode="dense")})
    bare = retrieval.build_index(Views(spark, SF).chunks().limit(0))
    with pytest.raises(ValueError, match="empty"):
        evaluate.ablation(evaluate.Corpus(bare, c.vectors), questions, gold, {"s": retrieval.SearchConfig(mode="sparse")})


def test_blank_queries_and_failing_scorers(spark, corpus):
    c, questions, _ = corpus
    with pytest.raises(ValueError, match="9"):
        retrieval.refuse_blank(spark.createDataFrame([(9, " \n\t")], "qid int, query string"))
    assert retrieval.refuse_blank(questions).count() == 40
    assert retrieval.bm25(c.index, spark.createDataFrame([(1, "?!")], "qid long, query string")).count() == 0
    hits = store.stored(retrieval.search(c.index, c.vectors, questions, retrieval.SearchConfig(k=20)), "hits")
    good, said = retrieval.rerank_or_fused(hits, questions, c.index.chunks, 5)
    assert not said and good.groupBy("qid").count().where("count > 5").isEmpty()

    @F.pandas_udf("double")
    def broken(q, t):
        raise RuntimeError

    for scorer, reason in ((broken, "PythonException"), (lambda q, t: F.lit(None).cast("double"), "no score")):
        out, said = retrieval.rerank_or_fused(hits, questions, c.index.chunks, 5, scorer)
        assert len(said) == 1 and reason in said[0]
        assert sorted((r.qid, r.chunk_id, r["rank"]) for r in out.collect()) == sorted((r.qid, r.chunk_id, r["rank"]) for r in hits.where("rank <= 5").collect())


def test_index_reads_texts_once(spark, corpus):
    c, questions, _ = corpus
    plan = retrieval.bm25(c.index, questions)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan


def test_embedders(spark):
    model = embedding.of_model("two", 2, lambda texts: [[len(t), 1] for t in texts], "find: ")
    df = spark.createDataFrame([("ab",), (None,)], "text string")
    assert [r.embedding for r in embedding.chunks(df, model).collect()] == [[2.0, 1.0], [0.0, 1.0]]
    assert embedding.queries(df.withColumnRenamed("text", "query").limit(1), model).first().qvec == [8.0, 1.0]
    with pytest.raises(Exception, match="vectors of 3"):
        embedding.chunks(df, embedding.of_model("bad", 3, lambda texts: [[1, 2] for _ in texts])).collect()


def test_vocabulary_must_be_whole(spark):
    rows = spark.createDataFrame([("a", "Location"), ("b", "Title")], "name string, type string")
    assert packets.complete_vocabulary(rows, 2).count() == 2
    with pytest.raises(ValueError, match="2 of 3"):
        packets.complete_vocabulary(rows, 3)
    with pytest.raises(ValueError, match="no named"):
        packets.complete_vocabulary(rows.where("type = 'Title'"), 1)


def test_figures_bind_by_subject_label_and_number(spark):
    none = "array<string>"
    claims = spark.createDataFrame([("t", 1, "How strong is the Keep?", "The Keep holds 94", 0.9, ["a"], [("c", "Keep: 94")]), ("t", 2, "How strong is the Keep?", "The Keep holds 95", 0.9, ["a"], [("c", "Keep: 94")]), ("t", 3, "How strong is the Hold?", "The Keep holds 94", 0.9, ["a"], [("c", "Keep: 94")])], f"trace_id string, ord int, question string, text string, confidence double, asset_ids {none}, sources array<struct<chunk_id:string,quote:string>>")
    chunks = spark.createDataFrame([("t", "c", "d", 1, "Plate.\nKeep: 94\nHold: 7", ["a"])], f"trace_id string, chunk_id string, doc_id string, rank int, text string, asset_ids {none}")
    assets = spark.createDataFrame([("a", "The Keep", [("Keep", "94")])], "asset_id string, subject string, values array<struct<label:string,value:string>>")
    kept, cited, removed = packets.accept(claims, chunks, assets)
    assert [(r.claim_id, r.visuals) for r in kept.collect()] == [("claim_1", ["a"])] and cited.count() == 1
    assert sorted((r.ord, r.reason) for r in removed.collect()) == [(2, "figure_not_bound"), (3, "figure_not_bound")]


def test_quotations_over_chunks_are_cited_apart(spark):
    claims = spark.createDataFrame([("t", 1, "q", "x", 0.9, [], [("c1", "a long first part of the words ... and a long second part of them")])], "trace_id string, ord int, question string, text string, confidence double, asset_ids array<string>, sources array<struct<chunk_id:string,quote:string>>")
    chunks = spark.createDataFrame([("t", "c1", "d1", 1, "Here is a long first part of the words indeed.", []), ("t", "c2", "d2", 2, "Then comes and a long second part of them too.", [])], "trace_id string, chunk_id string, doc_id string, rank int, text string, asset_ids array<string>")
    assets = spark.createDataFrame([], "asset_id string, subject string, values array<struct<label:string,value:string>>")
    kept, cited, removed = packets.accept(claims, chunks, assets)
    assert kept.first().support == "corroborated" and sorted(r.chunk_id for r in cited.collect()) == ["c1", "c2"] and removed.isEmpty()


def test_runs_from_files_to_what_is_indexed(spark):
    files = spark.createDataFrame([("a/one.md", "# Keep\n\nSome words.\n", b""), ("a/two.txt", "Plain words here.\n\nAnd more of them.", b""), ("a/bad.docx", "", b"no zip"), ("a/x.bin", "", b"")], "path string, text string, content binary")
    blocks, dead, counts = ingest.run(files)
    assert {r.doc_id: r.blocks for r in counts.collect()} == {"one": 2, "two": 2}
    assert sorted(r.path for r in dead.collect()) == ["a/bad.docx", "a/x.bin"]
    docs = spark.createDataFrame([("one", 2, "wiki")], "doc_id string, authority_tier int, source_type string")
    images = spark.createDataFrame([("p1", "images/p1.png", "Plate", "Plate\nKeep: 94", 1, "figure_plate"), ("p2", "images/p2.png", "Plate", " ", 1, "figure_plate")], "asset_id string, canonical_path string, caption string, searchable_text string, authority_tier int, source_type string")
    own = blocks.select("doc_id", F.concat_ws(":", "doc_id", F.col("ord").cast("string")).alias("block_id"), "ord", F.lit(1).alias("page"), "block_type", "text", "section_path", F.lit(None).cast("string").alias("asset_path"))
    got = {r.chunk_id: (r.authority_tier, r.source_type) for r in chunking.run(own, docs, images).collect()}
    assert got == {"one:c0": (2, "wiki"), "two:c0": (4, "unknown"), "img:p1": (1, "figure_plate")}


def test_line_tables_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    read = lambda: sorted(r.x for r in tables.read_lines(spark, path, "x int").collect())
    tables.write_lines(spark.range(3).selectExpr("cast(id AS int) AS x"), path)
    assert read() == [0, 1, 2]
    tables.write_lines(spark.range(5, 6).selectExpr("cast(id AS int) AS x"), path)
    assert read() == [5] and os.listdir(tmp_path) == ["t"]
    with pytest.raises(Exception):  # noqa: B017, PT011  whatever the write raises, the table stays
        tables.write_lines(spark.range(1).select(F.raise_error(F.lit("no")).alias("x")), path)
    assert read() == [5]


def test_names_meet_texts_only_where_one_begins(spark):
    vertices = spark.createDataFrame([("e0", "Old Keep", "Location", [], [])], "entity_id string, name string, type string, aliases array<string>, doc_ids array<string>")
    texts = spark.createDataFrame([(1, "the old keep, the old hold"), (2, "older keep"), (3, "")], "qid int, query string")
    assert [(r.qid, r["at"]) for r in graph.mentions(texts, vertices).collect()] == [(1, 2)]


def plain_pdf(lines, sizes):
    """Blocks of (page, line, text, size, bold), read in order with a stack of titles."""
    out, path, seen, held, page = [], [], set(), [], None

    def flush():
        if held:
            out.append(("text", " ".join(held), list(path), page))
            held.clear()

    chars = {}
    for p, _, text, *_ in lines:
        chars[p] = chars.get(p, 0) + len(text)
    for p, _, text, size, bold in lines:
        if chars[p] < 50:
            continue
        if p != page:
            flush()
            page = p
        sized = size in sizes
        if sized or (bold and len(text) <= 80 and text[-1] not in ".,;:!?"):
            flush()
            if sized:
                seen.add(size)
            path = [*path[: sum(s > size for s in seen) if sized else len(path)], text]
            out.append(("heading", text, list(path), p))
        else:
            held.append(text)
    flush()
    return out, sorted(p for p, n in chars.items() if n < 50)


def test_pdf_spans_equal_a_plain_reader(spark):
    import random

    r = random.Random(2)
    lines, spans = [], []
    for page in range(1, 9):
        for line in range(1 if page == 5 else 14):
            size, bold = r.choice([(10.0, False)] * 6 + [(10.0, True), (14.0, False), (18.0, False)])
            text = f"Title {page} {line}" if size > 10 or bold else f"words of page {page} and line {line} go on and on" + r.choice([".", ""])
            text = "x" if page == 5 else text
            lines.append((page, line, text, size, bold))
            cut = len(text) // 2
            spans += [("d", page, line, 0, text[:cut], size, bold, 1.0, line * 2.0, 5.0, line * 2.0 + 1), ("d", page, line, 1, text[cut:], size - 0.01, bold, 5.0, line * 2.0, 9.0, line * 2.0 + 1), ("d", page, line, 2, " ", 10.0, False, 0.0, 0.0, 99.0, 99.0)]
    df = spark.createDataFrame(spans, "doc_id string, page int, line int, at int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double")
    blocks, scanned = ingest.pdf_blocks(df)
    got = blocks.orderBy("ord").collect()
    want, without = plain_pdf(lines, {14.0, 18.0})
    assert [(b.block_type, b.text, b.section_path, b.page) for b in got] == want and [r.page for r in scanned.collect()] == without == [5]
    assert all(b.bbox[0] == 1.0 and b.bbox[2] == 9.0 and b.bbox[1] < b.bbox[3] <= 29 for b in got) and [b.ord for b in got] == list(range(len(got)))


def test_saved_graphs_and_indexes(spark, tmp_path):
    v = Views(spark, SF)
    root = f"file://{tmp_path}/g"
    graph.save(v.entities(), v.places(), root)
    graph.save(v.entities().limit(3), v.places(), root)
    entities, relations = graph.load(spark, root)
    assert entities.count() == 3 and relations.count() == v.places().count()
    index = retrieval.build_index(v.chunks(), f"chunks {SF}")
    retrieval.save_index(index, f"file://{tmp_path}/i")
    again = retrieval.load_index(v.chunks(), f"file://{tmp_path}/i")
    rows = lambda i: sorted(map(tuple, retrieval.bm25(i, v.queries()).collect()))
    assert rows(index) == rows(again) and again.size == index.size


def test_paths_between_names(spark):
    v = Views(spark, SF)
    asked = spark.createDataFrame([(1, "ent_supplier_1", "ent_region_0"), (2, "ent_supplier_1", "nowhere at all")], "qid int, ref string, to string")
    found, lost = graph.act("graph_paths", asked, v.places(), v.entities(), 4)
    assert [r.qid for r in lost.collect()] == [2] and {r.qid for r in found.collect()} <= {1}
    with pytest.raises(ValueError, match="unknown action"):
        graph.act("graph_walk", asked, v.places(), v.entities())


def test_caches_traces_and_records(spark):
    from veritide.operators import metrics

    cache = spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], "key string, value string, created_at int")
    asked = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    got, after = metrics.get_or_set(asked, cache, lambda m: m.select("key", F.upper("key").alias("value"), F.lit(3).alias("created_at")))
    assert sorted((r.key, r.value, r.hit) for r in got.collect()) == [("a", "2", True), ("b", "B", False), ("b", "B", False)] and after.count() == 3
    old = spark.createDataFrame([("t", 1, 1, "x")], "trace string, step int, written long, text string")
    new = spark.createDataFrame([("t", 1, "y", 5), ("t", 2, "z", 6), ("u", 1, "w", 1)], "trace string, step int, text string, at int")
    both = metrics.append_steps(old, new)
    assert sorted((r.trace, r.step, r.text) for r in metrics.latest_steps(both).collect()) == [("t", 1, "y"), ("t", 2, "z"), ("u", 1, "w")]
    assert sorted(r.written for r in both.where("trace = 't'").collect()) == [1, 2, 3]
    images = spark.createDataFrame([("p", "s1"), ("q", "s2")], "path string, checksum string")
    records = spark.createDataFrame([("s1", "old", 1), ("s1", "new", 2)], "checksum string, description string, recorded_at int")
    done, left = ingest.described(images, records)
    assert [(r.path, r.description) for r in done.collect()] == [("p", "new")] and [r.path for r in left.collect()] == ["q"]


def test_conflict_detectors_are_any_function(spark):
    hits = spark.createDataFrame([(1, "c", "x", 1, 0.5)], "qid int, chunk_id string, text string, authority_tier int, score double")
    claims = spark.createDataFrame([("e", 1)], "entity string, n int")
    merged, found = packets.bundle(hits, claims, lambda df: df.where("n > 0"))
    assert merged.count() == 1 and found.first().entity == "e"


def test_as_of_equals_brute_force(spark):
    import random

    from veritide.operators import joins

    r = random.Random(8)
    left = [(n, r.randrange(4), r.choice([None, *range(12)])) for n in range(60)]
    right = [(r.randrange(5), r.choice([None, *range(12)]), r.randrange(99)) for _ in range(40)]
    a, b = spark.createDataFrame(left, "n int, k int, t int"), spark.createDataFrame(right, "k int, t int, v int")
    for or_equal in (False, True):
        want = {}
        for n, k, t in left:
            before = [(u, v) for j, u, v in right if j == k and u is not None and t is not None and (u < t or (or_equal and u == t))]
            want[n] = max(before)[1] if before else None
        assert {x.n: x.last_v for x in joins.as_of(a, b, "k", "t", ["v"], or_equal).collect()} == want


def test_search_sends_no_pair_of_query_and_chunk_as_a_row(spark):
    """Every chunk holds a word of every query: what is sorted for the ranks are the best of each task, not all pairs; scores are those of the formula."""
    import math

    from pyspark.sql import functions as F

    from veritide.operators import retrieval

    n, words = 300, ["ash", "birch", "cedar"]
    chunks = spark.range(n).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.col("id").alias("chunk_pos"), F.concat_ws(" ", F.expr("repeat('ash ', int(id % 7) + 1)"), F.when(F.col("id") % 2 == 0, "birch"), F.when(F.col("id") % 5 == 0, "cedar cedar")).alias("text"))
    queries = spark.range(40).select(F.col("id").alias("qid"), F.concat(F.lit("Ash ash "), F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 3 + 1).cast("int"))).alias("query"))
    index = retrieval.build_index(chunks)
    texts = {r.chunk_id: r.text.split() for r in chunks.collect()}
    mean = sum(map(len, texts.values())) / n
    df = {w: sum(w in t for t in texts.values()) for w in words}
    want = {}
    for q in queries.collect():
        own = q.query.lower().split()
        score = {c: round(sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in own if w in t), 6) for c, t in texts.items() if set(own) & set(t)}
        want[q.qid] = sorted(score.items(), key=lambda x: (-x[1], int(x[0][1:])))[:5]
    for block in (7, 2048):
        found = retrieval.bm25(index, queries, 5, block=block)
        got = {}
        for r in found.orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.chunk_id, r.score))
        assert {q: [c for c, _ in x] for q, x in got.items()} == {q: [c for c, _ in x] for q, x in want.items()}
        assert all(abs(a[1] - b[1]) < 2e-6 for q in want for a, b in zip(got[q], want[q], strict=True))
        assert "HashAggregate(keys=[qid" not in found._jdf.queryExecution().executedPlan().toString()
