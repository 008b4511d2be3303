"""Running sums, numbers and last values within keys of any size, and what is built on them."""

import random

import pytest
from pyspark.sql import functions as F

from veritide.operators import joins, metrics, ordered


@pytest.fixture
def narrow(spark):
    """Many small ranges, so that keys lie in several."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_numbers_and_running_sums_of_a_hot_key(narrow):
    r = random.Random(4)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), k, r.randrange(-5, 9) if k % 7 else None) for k in range(3000)]
    df = narrow.createDataFrame(r.sample(rows, len(rows)), "k string, t int, v long")
    parts = ordered.ranged(df, ["k"], ["t"]).where("k = 'hot'").select("_part").distinct().count()
    assert parts > 1
    total, number, sums = {}, {}, {}
    for k, t, v in rows:
        number[t], sums[t] = total.get((k, 0), 0), total.get((k, 1), 0)
        total[k, 0], total[k, 1] = number[t] + 1, sums[t] + (v or 0)
    assert {x.t: x.n for x in ordered.numbered(df, ["k"], ["t"], "n").collect()} == number
    assert {x.t: x.s for x in ordered.running(df, ["k"], ["t"], "v", "s").collect()} == sums
    assert ordered.numbered(df.limit(0), ["k"], ["t"], "n").count() == 0


@pytest.mark.parametrize("or_equal", [False, True])
def test_as_of_with_one_key_on_all_rows(narrow, or_equal):
    r = random.Random(6)
    left = [(n, r.choice(["hot"] * 9 + ["a", None]), r.choice([None, *range(400)])) for n in range(1500)]
    right = [(r.choice(["hot"] * 9 + ["a", "b", None]), r.choice([None, *range(0, 400, 3)]), r.randrange(100)) for _ in range(60)]
    a, b = narrow.createDataFrame(left, "n int, k string, t int"), narrow.createDataFrame(right, "k string, t int, v int")

    def want(k, t):
        fits = [(u, v) for q, u, v in right if k is not None and q == k and t is not None and u is not None and (u <= t if or_equal else u < t)]
        return max(fits)[1] if fits else None

    got = {x.n: x.last_v for x in joins.as_of(a, b, "k", "t", ["v"], or_equal).collect()}
    assert got == {n: want(k, t) for n, k, t in left}
    assert joins.as_of(a, b.limit(0), "k", "t", ["v"]).where("last_v IS NOT NULL").count() == 0
    assert joins.as_of(a.limit(0), b, "k", "t", ["v"]).count() == 0


def test_ranks_of_one_suite_of_all_rows(narrow):
    """The same elements as sorted lists give, with ties, nulls and null keys, and no list in the plan."""
    r = random.Random(8)
    rows = [(r.choice(["hot"] * 9 + ["a", None, "none"]), r.choice([None, *range(300)])) for _ in range(4000)]
    rows = [(k, None if k == "none" else v) for k, v in rows] + [("one", 5), ("two", 1), ("two", 9)]
    df = narrow.createDataFrame(rows, "suite string, ms int")
    out = metrics.elements_at(df, ["suite"], "ms", {"p50": None, "p95": 0.95, "top": 1.0})
    want = {}
    for suite in {k for k, _ in rows}:
        if v := sorted(x for k, x in rows if k == suite and x is not None):
            want[suite] = (v[len(v) // 2], v[int(len(v) * 0.95)], v[-1])
    assert {x.suite: (x.p50, x.p95, x.top) for x in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    full = df.select("suite", F.col("ms").alias("latency_ms"), F.lit(True).alias("scored"), *(F.lit(1.0).alias(c) for c in ("recall", "precision", "ndcg", "rr")), F.lit(True).alias("covered"))
    got = {x.suite: (x.questions, x.p50_ms, x.p95_ms) for x in metrics.suite_summary(full, ["suite"]).collect()}
    assert got == {s: (sum(k == s for k, _ in rows), *want.get(s, (None, None, None))[:2]) for s in {k for k, _ in rows}}
