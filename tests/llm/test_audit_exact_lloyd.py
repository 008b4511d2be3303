"""Filter audit, exact duplicates and whole-number clustering against brute force; nulls, ties, repeats, empty tables, clashing names."""

import hashlib
import random
import re
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from veritide.llm import audit, exact, lloyd

SPACE = re.compile(r"[\x20\x09-\x0D]")
ODD_NAMES = ["own", "order", "h", "n", "first", "content", "a.b", "row", "x", "was", "transfer", "c", "mask", "part", "_doc", "place"]


def with_odd_names(df):
    for name in ODD_NAMES:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(f"kept {name}"))
    return df


def brute_copies(rows):
    """{place: (keep_id, group_size, sha)} and the number of rows kept, from (id, text) rows."""
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i))
    out = []
    for i, t in rows:
        g = groups[SPACE.sub("", t or "")]
        out.append((i, min(g, key=lambda k: (k[0], k[1], k[2] or 0))[2], len(g), hashlib.sha256(SPACE.sub("", t or "").encode()).hexdigest()))
    return out, len(groups)


TEXTS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a\tb "), (5, None), (6, ""), (7, " \n\r"), (8, "c d"), (9, "cd"), (10, "é" * 40), (3, "a  b"), (3, "a  b"), (None, "x y z"), (11, "xy z"), (None, "q"), (12, "q"), (13, "long " * 100_000), (14, "long" * 100_000), (15, "\x1fab"), (16, "A b")]


@pytest.mark.parametrize("bits", [None, 2, 0])
def test_exact_copies(spark, bits):
    """Also where hashes collide: of 2 bits, and one hash for all."""
    hashed = exact.digest if bits is None else lambda c: F.substring(F.md5(c), 1, 1) if bits else F.lit("same")
    docs = with_odd_names(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    for broadcast in (exact.BROADCAST, 0):
        got = exact.mark(docs, hashed=hashed, broadcast=broadcast).collect()
        want, groups = brute_copies(TEXTS)
        key = lambda r: tuple((x is None, x or 0) for x in r)
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
        assert sum(r.kept for r in got) == groups
        assert all(r.doc_id == r.keep_id for r in got if r.kept) and all(r["a.b"] == "kept a.b" and r["own"] == "kept own" for r in got)


def test_exact_copies_of_a_hot_text_and_none(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"), F.lit(True).alias("kept"))
    got = exact.mark(hot)
    assert got.where("kept").count() == 2001 and got.where("group_size = 1000 AND keep_id = 0").count() == 1000
    assert exact.deduplicate(hot).columns == hot.columns and exact.deduplicate(hot).count() == 2001
    assert exact.mark(hot.limit(0)).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def brute_audit(rows, labels):
    """{(part, order, step): measures} by walking every document through every order."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    fails, out = [], {}
    for i, t, s in rows:
        t = t or ""
        w = [x for x in SPACE.sub(" ", t).split(" ") if x]
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        good, toxic = (any(x[k] == 1 for x in labels if i is not None and x[0] == i) for k in (1, 2))
        fails.append((s or "", {k for k, v in f.items() if v}, good, toxic))
    for part in {x[0] for x in fails}:
        own, total = [x for x in fails if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, k in enumerate(order, 1):
                gone = [x for x in left if k in x[1]]
                left = [x for x in left if k not in x[1]]
                total[k] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(k in x[1] for x in own) - len(gone), sum(x[1] == {k} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit(spark):
    r = random.Random(3)
    rows = [(None, None, None), (None, None, None), (1, None, "s"), (2, "", "s"), (3, "", ""), (3, "", None), (4, " \t", "s")]
    for i in range(5, 120):
        words = [r.choice(["one", "two", "Three", "#4", "FIVE", *(f"w{x}" for x in range(200))]) for _ in range(r.choice([3, 49, 50, 51, 120]))]
        rows.append((i, r.choice([" ", "\n", " \t "]).join(words), r.choice(["s", "t", None, "u.v"])))
    rows += [(r.randrange(5, 140), rows[k][1], r.choice(["s", "t"])) for k in range(10, 40)]
    rows += [(200, "Ab" + "c" * 38, "edge"), (201, "A" + "c" * 19, "edge"), (202, " ".join(f"w{k % 65}" for k in range(100)), "edge"), (203, " ".join(f"w{k % 64}" for k in range(100)), "edge"), (204, "x " * 200_000, "edge")]
    labels = [(5, 1, 0), (5, 0, 1), (6, 1, None), (7, None, 1), (3, 1, 1), (2, 1, 0), (999, 1, 1), (None, 1, 1), *((k, k % 2, k % 5 == 0 and 1 or 0) for k in range(8, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs, said = docs.withColumn("mask", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("labelled", F.lit(1)), said.withColumn("text", F.lit("x"))
    got = audit.audit(docs, said).collect()
    assert {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in got} == brute_audit(rows, labels)
    assert len(got) == 600 * len({s or "" for _, _, s in rows})
    assert audit.audit(docs.limit(0), said).count() == 0
    assert audit.audit(docs, said.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_removal_polynomial():
    """Corners count what is removed; the integral of a derivative equals the mean over all orders, a fraction where it must be."""
    r = random.Random(5)
    counts = {mask: r.randrange(50) for mask in range(32)}
    p = audit.removal(counts)
    for corner in range(32):
        assert audit.at_corner(p, corner) == sum(n for mask, n in counts.items() if mask & corner)
    for k in range(5):
        gains = []
        for order in permutations(range(5)):
            before = sum(1 << x for x in order[: order.index(k)])
            gains.append(audit.at_corner(p, before | 1 << k) - audit.at_corner(p, before))
        assert audit.shapley(p, k) == Fraction(sum(gains), 120)
    assert audit.shapley(audit.removal({0b111: 1}), 0) == Fraction(1, 3)


def brute_rounds(rows, k, dim, n):
    """Plain rounds over (id, vector) in Python's integers: {(id, vector): (cluster, distance)}, centroids."""
    sound = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and abs(x) < float("inf") for x in v)]
    vectors = [[lloyd.whole_number(x) for x in v] for _, v in sound]
    order = sorted(range(len(sound)), key=lambda j: (hashlib.sha256(f"3:{'' if sound[j][0] is None else sound[j][0]}".encode()).hexdigest(), sound[j][1]))
    centroids = [vectors[j] for j in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(n):
        if not centroids:
            break
        of = [near(v)[1] for v in vectors]
        for j in range(len(centroids)):
            own = [v for v, c in zip(vectors, of, strict=True) if c == j]
            if own:
                centroids[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return sorted(((i is None, i or 0), *near(v)[::-1]) for (i, _), v in zip(sound, vectors, strict=True)), centroids


def check_rounds(spark, rows, dim, rounds=lloyd.ROUNDS, k=lloyd.K, kind="double"):
    df = with_odd_names(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("cluster", F.lit("clash")))
    got = lloyd.cluster(df, dim=dim, n=rounds, k=k).collect()
    want, centroids = brute_rounds(rows, k, dim, rounds)
    fits = lambda d: d if d <= lloyd.LONG else None
    assert sorted((((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance) for r in got), key=str) == sorted(((i, c, fits(d)) for i, c, d in want), key=str)
    sums = {c: fits(sum(d for _, x, d in want if x == c)) for c in {x for _, x, _ in want}}
    for r in got:
        assert r.cluster_inertia == sums[r.cluster] and r.inertia == fits(sum(d for *_, d in want)) and r["a.b"] == "kept a.b"
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()
    return got


def test_rounds_equal_plain_rounds(spark):
    r = random.Random(7)
    rows = [(i, [r.gauss(0, 1) + (i % 11) / 3 for _ in range(5)]) for i in range(400)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[9][1]), (None, None), (500, [1.0] * 4), (501, [1.0, None, 1.0, 1.0, 1.0]), (502, [float("nan")] * 5), (503, [float("inf")] * 5), (504, [-0.0] * 5), (505, [0.0] * 5)]
    check_rounds(spark, rows, 5)
    check_rounds(spark, rows, 5, rounds=0)
    check_rounds(spark, rows[:60], 5, rounds=3, k=3)


def test_rounds_of_few_equal_and_large_vectors(spark):
    check_rounds(spark, [(1, [0.5, 0.5]), (2, [-0.5, 0.25])], 2)
    same = check_rounds(spark, [(i, [1.0, 2.0]) for i in range(20)] + [(30, [9.0, 9.0])], 2)
    assert {r.cluster for r in same if r.vec_id < 30} == {min(r.cluster for r in same if r.vec_id < 30)}
    r = random.Random(1)
    large = [(i, [r.gauss(0, 1) * 10 ** r.choice([0, 0, 5, 6, 15, 40, 300]) for _ in range(2)]) for i in range(120)]
    check_rounds(spark, large, 2)
    assert lloyd.cluster(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_only_what_changed_is_looked_at(spark):
    """Fewer vectors move from round to round, and no round is run after the last that moves a centroid."""
    r = random.Random(2)
    rows = [(i, [10.0 * (i % 8) + r.random(), r.random()]) for i in range(800)]
    done = lloyd.rounds(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", dim=2, n=50)
    assert len(done.moved) < 50 and done.transfers[0] == 800 and done.transfers[-1] < 80 and done.transfers[-1] <= done.transfers[1]
    assert min(done.moved) < 8
