"""Extra columns of any name: internal ones, those of results, and names with dots, go through every operator that keeps columns."""

import pytest
from pyspark.sql import functions as F

from veritide.llm import decontaminate, exact, langid, lloyd, mixing, near, quality, queries, sharding, simhash, url_filter

NAMES = ["_own", "_row", "_keep", "_rows", "_fp", "_label", "_h", "_c0", "_rid", "_r", "_spans", "_items", "_source", "_null", "_id", "t_id", "t_size", "key", "digest", "prefix", "_full", "_of", "_best", "_doc", "f", "h", "a", "b", "node", "label", "own", "order", "first", "n", "x", "a.b", "a b", "c`d", "extra"]
TEXTS = ["One two three four five six seven eight nine ten eleven twelve.", "One two three four five six seven eight nine ten eleven twelve.", "Uno dos tres cuatro cinco.", None, "", "x " * 500]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, t, f"s{i % 2}", "en" if i % 2 else "es") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, lang string")
    for name in NAMES:
        df = df.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    return df


def check(out, without=(), added=(), rows=len(TEXTS)):
    names = [n for n in NAMES if n not in added]
    assert [c for c in out.columns if c in NAMES] == names and set(added) <= set(out.columns)
    got = out.collect()
    assert len(got) == rows
    for r in got:
        assert all(r[n] == f"{n} of {r.doc_id}" for n in names)
        assert "text" in without or r["text"] == TEXTS[r.doc_id]


def test_columns_of_any_name_stay_what_they_are(spark, docs):
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int")
    check(simhash.group(docs), ["text"], simhash.ADDED)
    check(sharding.shard(docs, limit=64), (), sharding.ADDED)
    check(mixing.mix(docs), (), mixing.ADDED)
    check(langid.identify(docs, langid.learn(docs)), (), langid.ADDED)
    check(quality.score(docs, quality.learn(docs, labels)), (), quality.ADDED)
    for size in (decontaminate.BLOCK_BYTES, 1):
        check(decontaminate.decontaminate(docs, bench, block_bytes=size), (), decontaminate.ADDED)
    check(url_filter.judge(docs.withColumn("url", F.lit("http://a.com/x")), rules), (), url_filter.ADDED)
    check(exact.mark(docs), ["text"], exact.ADDED)
    check(exact.deduplicate(docs), (), (), 4)
    check(simhash.deduplicate(docs), (), (), 4)
    check(near.deduplicate(docs), (), (), 4)
    vectors = docs.withColumn("embedding", F.array(F.col("doc_id").cast("float"))).withColumnRenamed("doc_id", "vec_id").withColumn("doc_id", F.col("vec_id"))
    check(lloyd.cluster(vectors, dim=1), (), lloyd.ADDED)


def test_columns_named_like_results_give_way(spark, docs):
    named = docs.select("doc_id", "text", "source").withColumn("Score", F.lit("old")).withColumn("target", F.lit("old")).withColumn("verdict", F.lit("old"))
    scored = quality.score(named, quality.Model())
    assert scored.columns == ["doc_id", "text", "source", "target", "verdict", "score"] and scored.where("score = 0.5 OR score <> 0.5").count() == len(TEXTS)
    mixed = mixing.mix(named)
    assert mixed.columns == ["doc_id", "text", "source", "Score", "verdict", *mixing.ADDED] and mixed.where("target >= 0").count() == len(TEXTS)
