"""URL filter, decontamination and mixing against brute force, with nulls, ties, repeated rows and empty tables."""

import hashlib
import re

from veritide.llm import decontaminate, mixing, queries, url_filter

DOC = "doc_id long, text string, source string, size string"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/1", "http://b.example.com/en", "http://xexample.com/en/", "https://u.net/es/1", "https://net/fr/", "https://u.net/fr/#", "http://a.com/en/", "http://a.com/en/"]
    rules = spark.createDataFrame([*queries.URL_RULES, (None, "/", "block"), ("example.com", "/en/", "block"), ("q.org", "/a", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*urls, "http://q.org/abc"])], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    assert len(got) == len(urls) + 1
    assert [got[i].rule for i in range(len(urls))] == [None, None, None, None, "com/", "www.example.com/en/", "example.com/en/", "com/", "com/", "net/es/", "net/fr/", "net/fr/", "com/", "com/"]
    assert got[5].host == "www.example.com" and got[5].path == "/en/x" and got[6].verdict == "block" and got[3].verdict == "allow"
    assert got[len(urls)].rule == "q.org/a" and got[0].host == "" and got[0].path == ""
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_long_urls_and_shared_prefixes(spark, monkeypatch):
    """A URL of many labels costs no more than a short one; rules that share a join key are told apart by their digests."""
    rules = spark.createDataFrame([("a.b", "/", "block"), ("c.a.b", "/x", "allow"), ("a.b", "/x/y/", "block"), ("zz", "/", "block")], "host string, path string, verdict string")
    long = "http://" + "q." * 50_000 + "c.a.b/x" + "/p" * 20_000
    pages = spark.createDataFrame([(1, long), (2, "http://c.a.b/x/y/"), (3, "http://a.b/x/y/z"), (4, "http://b/"), (5, "http://ca.b/"), (6, "http://.a.b/"), (7, "http://a.b./")], "page_id long, url string")
    want = {1: "c.a.b/x", 2: "a.b/x/y/", 3: "a.b/x/y/", 4: None, 5: None, 6: "a.b/", 7: None}
    assert {r.page_id: r.rule for r in url_filter.judge(pages, rules).collect()} == want
    plan = url_filter.judge(pages, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "(_prefix" in plan and "= digest" not in [x for x in plan.splitlines() if "Join LeftOuter" in x][0]


def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = low(text), set(), set()
    for i, t in items:
        v = low(t)
        for k in range(max(1, len(v) - 9) if v else 0):
            g = v[k : k + 10]
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_decontaminate_in_one_block_and_in_many(spark):
    items = [(1, "a b c d e f g h i j k l"), (20, "A-b"), (3, None), (4, "..."), (5, "x x x x x x x x x x x x"), (6, "é ü ñ ß 1 2 3 4 5 6 7"), (6, "a b c d e f g h i j k l")]
    texts = [None, "", "a B c d, e f g h i j", "a b", "b a b a", "x " * 30, "q é ü ñ ß 1 2 3 4 5 6 7 q a b c d e f g h i j k l", "a b c d e f g h i", "word " * 5000 + "c d e f g h i j k l", "a b"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 1):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(docs, bench, block_bytes=size).collect()}
        assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def level(sizes, weights, share, cap):
    """Targets by sharing the excess until none is above its cap."""
    left, target, open_ = share * sum(sizes.values()), {}, dict(zip(sizes, weights, strict=True))
    while open_:
        at = left / sum(open_.values())
        over = [s for s in open_ if cap * sizes[s] < at * open_[s]]
        if not over:
            return target | {s: at * w for s, w in open_.items()}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 23)), ["b", "a", None, "c"][i % 4 if i % 3 else 0], "clash") for i in range(400)]
    rows += [(7, "same same", "a", "x")] * 90 + [(None, "null id", "b", "x")] * 60 + [(500, None, "a", "x"), (501, "", "c", "x")]
    docs = spark.createDataFrame(rows, DOC)
    got = mixing.mix(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = level({s: sizes[s] for s in order}, [3, 1, 2, 3], 1.5, 2.0)
    for s in order:
        own = [r for r in got if r.source == s]
        assert abs(own[0].target - want[s]) < 1e-6 and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own)
        assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in own)
    key = lambda rs: sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in rs)
    assert key(mixing.mix(docs.repartition(5)).collect()) == key(got)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("doc_id = 500")).collect()] == [0]


def test_mixing_is_unbiased(spark):
    """Over many seeds every document is taken as often as its source's share says."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "a" if i < 60 else "b", "") for i in range(120)], DOC)
    taken = {}
    for seed in range(6):
        for r in mixing.mix(docs, weights=(1,), share=0.75, seed=seed).where("source = 'b'").collect():
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
            share = r.target / r.source_size
    assert abs(sum(taken.values()) / (6 * len(taken)) - share) < 0.15 and len({*taken.values()}) > 2


def test_targets_of_many_sources(spark):
    """Sources by the thousand, dealt over ranges, as by the plain model."""
    sizes = {f"host{k * 7919 % 5003}": 1 + k * k % 997 + (50_000 if k % 500 == 0 else 0) for k in range(3000)}
    rows = spark.createDataFrame([(s, False, n) for s, n in sizes.items()], "_source string, _null boolean, size long")
    for share, cap in ((1.5, 2.0), (0.3, 2.0), (3.0, 2.0)):
        got = {r._source: r.target for r in mixing.source_targets(rows, (3, 1, 2), share, cap).collect()}
        order = sorted(sizes, key=str.encode)
        want = level({s: sizes[s] for s in order}, [(3, 1, 2)[k % 3] for k in range(len(order))], min(share, cap), cap)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-6 * want[s] for s in got)
