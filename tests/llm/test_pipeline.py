"""Every stage against brute force on its own input, and the whole on rows with nulls and clashing columns."""

import random

import corpus_pipeline
from tests.llm.test_filters import brute_hits
from tests.llm.test_near import brute_groups

from veritide.llm import tokens

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, "123 456", "en", "src1", 7), (9002, None, None, None, 0), (9003, "", "en", "src2", 0)], docs.schema)
    docs = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_dedup", "decontamination", "mixing", "token_output"]

    told = stages["language_id"](spark, docs, SF)
    assert told.schema == docs.schema
    gone = {r.doc_id for r in docs.select("doc_id").exceptAll(told.select("doc_id")).collect()}
    assert {9001, 9002, 9003} <= gone and len(gone) <= 3 + 0.02 * docs.count()

    #: No fingerprint contract binds the stage, so five words and a similarity of 0.8 hold, compared exactly.
    rows = told.orderBy("doc_id").collect()
    single = stages["simhash_dedup"](spark, told, SF)
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[k].doc_id for k in brute_groups([r.text for r in rows])})

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, single, SF)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect() if not brute_hits(r.text, items)[-1])

    mixed = stages["mixing"](spark, clean, SF)
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and set(counts.values()) <= {1, 2} and set(counts) <= {r.doc_id for r in clean.collect()}
    words = sum(len(r.text.split()) for r in clean.collect())
    assert abs(sum(len(r.text.split()) for r in mixed.collect()) - 1.5 * words) < 0.1 * words

    out = stages["token_output"](spark, mixed, SF).collect()
    assert len(out) == sum(-(-len(tokens.Tokenizer().encode(r.text)) // tokens.LENGTH) for r in mixed.collect())


def test_language_stage_rejects_what_contradicts(spark):
    """Documents that name another language than theirs go; those that name none, or their own, stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 400")
    rows = docs.collect()
    other = {"en": "fr", "fr": "de", "de": "es", "es": "en"}
    swapped = {r.doc_id for r in random.Random(1).sample([r for r in rows if r.lang], 12)}
    unnamed = {r.doc_id for r in random.Random(2).sample([r for r in rows if r.doc_id not in swapped], 12)}
    changed = spark.createDataFrame([r.asDict() | ({"lang": other[r.lang]} if r.doc_id in swapped else {"lang": None} if r.doc_id in unnamed else {}) for r in rows], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, changed, SF).collect()}
    assert len(swapped & kept) <= 2 and unnamed <= kept and len(kept) >= 0.98 * (len(rows) - 12)


def test_null_and_repeated_ids(spark):
    """Rows of one id, or of none, stay rows of their own through every stage."""
    r = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = [w for t in docs.where("lang = 'en'").limit(40).collect() for w in t.text.split()]
    make = lambda: " ".join(r.choice(words) for _ in range(80))
    texts = [make() for _ in range(30)]
    rows = [(None, t) for t in texts[:10]] + [(7, t) for t in texts[10:20]] + [(k, t) for k, t in enumerate(texts[20:])] + [(7, texts[0]), (None, texts[25]), (7, texts[12])]
    more = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema)
    told = corpus_pipeline.language(spark, docs.unionByName(more), SF)
    added = lambda df: sorted((x.doc_id is None, x.doc_id or 0, x.text) for x in df.where("source = 's'").collect())
    assert len(added(told)) == len(rows)
    single = corpus_pipeline.near_duplicates(spark, told, SF)
    want = [(None, t) for t in texts[1:10]] + [(7, t) for t in texts[10:20]] + [(k, t) for k, t in enumerate(texts[20:])] + [(7, texts[0])]
    assert added(single) == sorted((i is None, i or 0, t) for i, t in want)
    mixed = corpus_pipeline.mixture(spark, corpus_pipeline.benchmark_free(spark, single, SF), SF)
    assert {*added(mixed)} <= {*added(single)}


def test_extra_columns_that_clash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).selectExpr("*", "1 AS score", "'x' AS copies", "2 AS n_hit", "'y' AS fingerprint", "3 AS lang_pred", "4 AS _fp1")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert name == "mixing" or out.exceptAll(docs).isEmpty()
    clash = docs.selectExpr("*", "1 AS slot", "'x' AS tokens", "2 AS packed", "3 AS shard")
    assert corpus_pipeline.token_output(spark, clash, SF).select("doc_id").distinct().count() == 20


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
