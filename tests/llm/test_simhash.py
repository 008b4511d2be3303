import random

import numpy as np
import pandas as pd
import xxhash

from veritide.llm import near, simhash


def brute(texts):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = w.encode().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def reach(prints, radius):
    label = list(range(len(prints)))
    find = lambda x: x if label[x] == x else find(label[x])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def corpus():
    r = random.Random(3)
    texts = [None, "", " \n", "One", "one", "a b", "A B c"]
    for _ in range(30):
        w = [f"w{r.randrange(500)}" for _ in range(r.randrange(5, 400))]
        texts.append(" ".join(w))
        for _ in range(r.randrange(4)):
            v = list(w)
            v[r.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    return texts + [texts[10]] * 5


def test_groups_equal_brute_force(spark):
    texts = corpus()
    prints = brute(texts)
    want = reach(prints, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    got = simhash.group(docs.repartition(3)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, want, strict=True))}
    kept = simhash.deduplicate(docs.unionByName(docs.limit(9))).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))
    assert simhash.group(docs.limit(0)).count() == 0


def test_crowded_buckets_are_cut_into_blocks(spark):
    """A thousand fingerprints around one centre: no link is lost when blocks are small."""
    r = np.random.default_rng(1)
    centre = int(r.integers(0, 2**63))
    prints = sorted({centre ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 9), replace=False)) for _ in range(600)})
    want = reach(prints, 3)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "_fp long")
    groups, thresholds = simhash.plan(df)
    assert sum(len(g) for g in groups) == 64 and sum(thresholds) == 3 - len(groups) + 1
    labels = {x.node: x.label for x in simhash.components(simhash.links(df, groups, thresholds, block=50)).collect()}
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    own = [labels.get(p, p) for p in signed]
    assert {(a == b) for a, b in zip(own, own, strict=True)} == {True}
    assert len({*zip(own, want, strict=True)}) == len({*own}) == len({*want})


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "e f g h"), (4, "e f g h"), (9, "e f g h")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in simhash.group(docs).collect()) == [("4", "4"), ("4", "4"), ("9", "4"), ("None", "None"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in simhash.deduplicate(docs).collect()) == ["4", "None"]


def test_allocation_is_cheapest():
    costs = [{-1: 0, 0: 5, 1: 9}, {-1: 0, 0: 1, 1: 2}, {-1: 0, 0: 4, 1: 50}]
    assert simhash.allocate(costs, 0) == (6, [-1, 1, 0])


def test_groups_not_ids_choose_the_rows_that_stay(spark):
    """Unrelated texts under one id or none all stay; the keeper of one group may be a copy in another."""
    r = random.Random(9)
    text = lambda: " ".join(f"w{r.randrange(9999)}" for _ in range(60))
    a, b, hot, none = text(), text(), [text() for _ in range(5)], [text() for _ in range(4)]
    rows = [(7, a), (8, a), (3, b), (7, b), *((5, t) for t in hot), *((None, t) for t in none), (5, hot[0]), (9, hot[1]), (None, hot[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted([(7, a), (3, b), *((5, t) for t in hot), *((None, t) for t in none)], key=str)
    for dedup in (simhash.deduplicate, near.deduplicate):
        assert sorted(((x.doc_id, x.text) for x in dedup(docs).collect()), key=str) == want


def test_long_texts_are_hashed_in_runs(monkeypatch):
    texts = [b"", b" ", b"one", b"one two", b"A b C d e f g h " * 40, b"x" * 300 + b" y", b"\n a  b\tc \x0bd\xc3\xa9 " * 30, b"w" * 50 + b" " + b"v " * 90]
    whole = [(simhash.fingerprint(t), [np.concatenate([*simhash.hashes(t, n), np.zeros(0, np.uint64)]).tolist() for n in (1, 3, 5)]) for t in texts]
    for run in (1, 7, 64):
        monkeypatch.setattr(simhash, "RUN", run)
        assert [(simhash.fingerprint(t), [np.concatenate([*simhash.hashes(t, n), np.zeros(0, np.uint64)]).tolist() for n in (1, 3, 5)]) for t in texts] == whole


def test_components_of_links_that_differ_from_reading_to_reading(spark):
    """A forest that is spanned anew at each reading still joins what it joins: both ways of a link are of one reading."""
    group = [(g, n) for g in range(40) for n in range(12)]
    rows = spark.createDataFrame(group, "g long, n long").repartition(4, "g")

    def chain(batches):
        for pdf in batches:
            for g, own in pdf.groupby("g"):
                ids = (own["n"] + 100 * g).sample(frac=1).tolist()
                yield pd.DataFrame({"a": ids[:-1], "b": ids[1:]})

    links = rows.coalesce(1).sortWithinPartitions("g").mapInPandas(chain, "a long, b long")
    for _ in range(3):
        assert {r.node: r.label for r in simhash.components(links).collect()} == {100 * g + n: 100 * g for g, n in group}
