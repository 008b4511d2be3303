"""The pipeline's near-duplicate stage against brute force: exact five-word Jaccard similarity."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.test_filters import brute_hits

from veritide.llm import near, tokens

SF = "/root/testdata/sf0.001"


def brute_groups(texts):
    sets = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def planted():
    """Texts with copies on either side of the bound, chains of copies and short texts."""
    r = random.Random(5)
    texts = [None, "", " \n", "One", "one", "a b c", "A B c d e f"]
    for _ in range(60):
        w = [f"w{r.randrange(3000)}" for _ in range(r.randrange(20, 300))]
        texts.append(" ".join(w))
        for _ in range(r.randrange(5)):
            v = list(w)
            for _ in range(r.randrange(1, 2 + len(w) // 30)):
                v[r.randrange(len(v))] = f"x{r.randrange(999)}"
            texts.append(" ".join(v))
            w = r.choice([w, v])
    return texts + [texts[10]] * 3


def test_near_copies_equal_brute_force(spark):
    texts = planted()
    want = brute_groups(texts)
    assert 20 < len(texts) - len({*want})
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == sorted({*want})
    assert sorted(r.doc_id for r in near.deduplicate(docs, block=2).collect()) == sorted({*want})
    assert near.deduplicate(docs.limit(0)).count() == 0


def test_a_corpus_of_templates_does_not_chain(spark):
    """Texts that share a third of their shingles: their bands form one component, their sketches none, so no text is sent to be compared."""
    r = random.Random(11)
    form = [f"t{k}" for k in range(110)]
    texts = [" ".join([*form, *(f"u{r.randrange(10**6)}" for _ in range(110))]) for _ in range(400)]
    texts += [f"{texts[7]} one", f"{texts[7]} two more"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_id long, text string")
    prints = near._prints(docs.withColumn("_row", F.col("_id")), "text").cache()
    keys = prints.select("_node", F.explode("_bands").alias("key"))
    least = keys.groupBy("key").agg(F.min("_node").alias("a"))
    chained = near.components(keys.join(least, "key").where("a <> _node").select("a", F.col("_node").alias("b")))
    assert max(x["count"] for x in chained.groupBy("label").count().collect()) > 200
    found = near.candidates(prints).collect()
    assert len(found) == 3 and len({x.label for x in found}) == 1
    assert sorted(x._id for x in prints.where(F.col("_node").isin([x.node for x in found])).collect()) == [7, 400, 401]
    assert near.deduplicate(docs.withColumnRenamed("_id", "doc_id")).count() == 400


def test_stages_by_similarity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, docs, SF)
    rows = told.orderBy("doc_id").collect()
    single = stages["simhash_dedup"](spark, told, SF)
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted({rows[k].doc_id for k in brute_groups([r.text for r in rows])})
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, single, SF)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect() if not brute_hits(r.text, items)[-1])
    mixed = stages["mixing"](spark, clean, SF)
    out = stages["token_output"](spark, mixed, SF).collect()
    assert len(out) == sum(-(-len(tokens.Tokenizer().encode(r.text)) // tokens.LENGTH) for r in mixed.collect())


def test_candidates_by_fingerprint_alone(spark, monkeypatch):
    """With no bands at all, sets whose fingerprints differ in three bits at most are candidates, and only these."""
    r = random.Random(3)
    w = [f"w{r.randrange(3000)}" for _ in range(3000)]
    texts = [" ".join(w), " ".join([*w[:-1], "x"]), " ".join(["y", *w[1:]]), *(" ".join(f"v{r.randrange(3000)}" for _ in range(300)) for _ in range(40))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_id long, text string")
    prints = near._prints(docs, "text").cache()
    told = {x._node: x._fp % 2**64 for x in prints.collect()}
    want = {a for a in told for b in told if a != b and (told[a] ^ told[b]).bit_count() <= 3}
    assert len(want) >= 2
    assert {x.node for x in near.components(near.by_fingerprint(prints.select("_node", "_fp"))).collect()} == want
    bare = prints.withColumn("_bands", F.array().cast("array<long>"))
    assert {x.node for x in near.candidates(bare).collect()} == want


def test_bands_of_the_same_copies_send_on_much_the_same_links(spark, monkeypatch):
    """A large group of near copies: a node is tied to a few others, not to another one in each of its bands."""
    r = random.Random(9)
    w = [f"w{k}" for k in range(400)]
    texts = [" ".join(f"x{r.randrange(10**6)}" if k in own else x for k, x in enumerate(w)) for own in (r.sample(range(400), 2) for _ in range(600))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_id long, text string")
    sent = []
    monkeypatch.setattr(near, "components", lambda links: sent.append(links.count()))
    near.candidates(near._prints(docs, "text").cache())
    assert 599 <= sent[0] < 600 * 2
