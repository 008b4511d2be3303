"""Language identification, quality and language-model scores: held-out accuracy and brute-force models."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritide.llm import langid, lm, quality, queries
from veritide.llm.common import fold

SF = "/root/testdata/sf0.01"


def longest_first_phrases(symbols, source):
    """Phrases of a greedy parse: each the longest that is a factor of source, one symbol if none is."""
    n, at, text = 0, 0, "".join(map(chr, source))
    while at < len(symbols):
        k = 1
        while at + k < len(symbols) and "".join(map(chr, symbols[at : at + k + 1])) in text:
            k += 1
        at, n = at + k, n + 1
    return n


@pytest.mark.parametrize("lane,chunk", [(langid.LANE, langid.CHUNK), (7, 60), (64, 1000)])
def test_automaton_parses_like_brute_force(monkeypatch, lane, chunk):
    """Whole texts, longer than lanes and pieces, over alphabets of any size."""
    monkeypatch.setattr(langid, "LANE", lane)
    monkeypatch.setattr(langid, "CHUNK", chunk)
    r = np.random.default_rng(0)
    wide = [chr(0x4E00 + k) for k in range(900)]
    samples = {"x": ["".join(r.choice(list("abc "), 300))] * 2, "y": ["".join(r.choice(list("abd "), 300, p=[0.5, 0.3, 0.1, 0.1]))], "z": ["".join(r.choice(wide, 700, p=(w := 1 / np.arange(1, 901)) / w.sum())), "aaaaaaaa" * 9]}
    p = langid.Parser(samples)
    texts = ["".join(r.choice(list("abcde "), n)) for n in (1, 2, 7, 90, 512, 513, 6000)] + ["".join(r.choice([*wide[:50], *"ab "], 1500)), "", "aaaa" * 400, samples["y"][0] * 9]
    streams = [p.symbols(t) for t in texts]
    got = p.counts(streams)
    for s, g in zip(streams, got, strict=True):
        for k, lang in enumerate(p.languages):
            source = [c for t in samples[lang] for c in [0, *p.symbols(t).tolist()]]
            assert g[k] == (longest_first_phrases(s.tolist(), source) if len(s) else 0)


def test_many_scripts_are_told_apart():
    r = np.random.default_rng(3)
    scripts = {"el": range(0x3B1, 0x3C9), "ru": range(0x430, 0x450), "uk": [*range(0x430, 0x448), 0x456, 0x457, 0x491], "ja": range(0x3041, 0x3090), "ko": range(0xAC00, 0xAF00)}
    make = lambda k, n: "".join(" " if r.random() < 0.2 else chr(r.choice(list(scripts[k]))) for _ in range(n))
    p = langid.Parser({k: [make(k, 400) for _ in range(20)] for k in scripts})
    assert p.judge([make(k, 300) for k in scripts])[0] == list(scripts)


def test_language_on_held_out(spark):
    got = queries.op10_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) > 100


def test_language_cases(spark):
    rows = [(i, t, lg, "clash") for i, (t, lg) in enumerate([("abc abc abd", "x"), ("zzz zyz yyz", "y"), (None, "x"), ("", "y"), ("123 !!", None), ("É é", None), ("zyzzy " * 30000, None), ("abc", "y"), (None, None)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(docs, langid.learn(docs)).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4, 8)] == ["und"] * 4 and got[6].lang_pred == "y" and got[5].lang_pred in "xy"
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == len(rows)
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(docs.limit(0))).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.learn(docs)).count() == 0


def test_quality_on_held_out(spark):
    rows = queries.op4_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows) > 50


def test_quality_gradients():
    r = np.random.default_rng(2)
    m = quality.Model()
    m.p = {k: v.astype(float) for k, v in m.p.items()}
    m.p["c"] = r.standard_normal(quality.HIDDEN)
    x, first = quality.passages([b"one two. " * 70, b"", b"A B !!" * 9])
    y = np.array([1.0, 0, 1])
    loss = lambda: -np.mean(y * np.log(m.forward(x, first)["s"]) + (1 - y) * np.log(1 - m.forward(x, first)["s"]))
    g = m.gradients(m.forward(x, first), first, y)
    for k, v in m.p.items():
        at = tuple(r.integers(0, n) for n in v.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = loss()
        v[at] = old - 1e-5
        down = loss()
        v[at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[k][at], rel=0.02, abs=2e-6)


def plain_quality(model, text):
    """A text's score passage by passage: softmax attention over the encodings of its passages."""
    data = text.encode()
    words = [m.start() for m in re.finditer(rb"[^\x09\x0a-\x0d\x20]+", data)]
    cuts = [0, *words[quality.PASSAGE :: quality.PASSAGE], len(data)]
    e, h = [], []
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        x = quality.passages([data[a:b]], goes_on=k < len(cuts) - 2)[0]
        assert len(x) == 1
        z = np.clip((x[0].astype(float) - model.mean) * model.scale, -6, 6)
        own = np.tanh(z @ model.p["W"] + model.p["b"])
        e.append(float(np.sum(np.tanh(own @ model.p["V"]) / (1 + np.exp(-(own @ model.p["U"]))) * model.p["w"])))
        h.append(own)
    w = [math.exp(x - max(e)) for x in e]
    pooled = sum(a * b for a, b in zip(w, h, strict=True)) / sum(w)
    return 1 / (1 + math.exp(-(float(pooled @ model.p["c"]) + float(model.p["o"][0]))))


def test_quality_scores_equal_a_plain_forward_pass(spark, monkeypatch):
    """In batches, alone, and in parts of any size."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [r.text for r in docs.limit(60).collect()] + ["", " a", "\n\nx y\n", "One two. " * 3000]
    want = [plain_quality(model, t) for t in texts]
    assert 0.1 < np.std(want)
    for size in (quality.CHUNK, 3000, 400):
        monkeypatch.setattr(quality, "CHUNK", size)
        assert model.score([t.encode() for t in texts]) == pytest.approx(want, abs=2e-4)
        assert all(b"".join(p for p, _ in quality.parts(t.encode())) == t.encode() for t in texts)


def test_quality_memory_does_not_follow_the_text():
    import tracemalloc

    text = b"some more words of a very long text. " * 800_000
    tracemalloc.start()
    assert 0 <= quality.Model().score([text])[0] <= 1
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_quality_cases(spark):
    texts = [None, "", "  \n", "Fine words here.", "BAD!! BAD!!", " lead", "x " * 60000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(3, "Fine words here.", "clash")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, None), (None, 1), (99, 1), (3, 1)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    alone = [model.score([(t or "").encode()])[0] for t in texts]
    assert all(r.score == pytest.approx(alone[r.doc_id], abs=1e-6) for r in got)
    assert quality.score(docs.limit(0), quality.learn(docs, labels.limit(0))).count() == 0


def words_of(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def test_base_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 60)
    texts = [None, "", "A b c a", "a a b", "é É é", "long " * 4000, "z", "a a b", "qq \x1c qq"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 2)], "doc_id long, text string, score int")
    held = F.coalesce(F.pmod("doc_id", F.lit(4)) == 2, F.lit(False))
    got = {r.doc_id: r for r in lm.score(docs, held).collect()}
    counts = Counter(w for i, t in [*enumerate(texts), (0, "null id")] if i % 4 != 2 for w in words_of(t))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        w = words_of(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert got[i].score < 0 and got[i].held_out == (i % 4 == 2)
    none = lm.score(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in none)
    assert lm.score(docs.limit(0), held).count() == 0


def test_rare_words_are_looked_up_in_the_whole_vocabulary(spark, monkeypatch):
    """With hardly any frequent words, the join gives the same base scores."""
    monkeypatch.setattr(lm, "STEPS", 60)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.score(docs, fold("doc_id", 7) == 2).collect()}
    monkeypatch.setattr(lm.learn, "__defaults__", (None, 100, 60))
    two = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.score(docs, fold("doc_id", 7) == 2).collect()}
    assert one == two


def small_scorer(words=(), counts=(), sample=()):
    tok = lm.Tokenizer()
    index = np.full(tok.end + 1, lm.SPELLED)
    index[-1] = lm.SPELLED + 1
    pairs = lm.Pairs(index, np.zeros((lm.SPELLED + 2, lm.SPELLED + 2)), np.zeros(tok.end + 1), lm.opens_word(tok), 0.01)
    return lm.Scorer(tok, list(words), np.array(counts, float), 0, 0, 0, pairs, np.ones(tok.end + 1), list(sample))


def test_words_are_spelled_together_as_alone():
    s = small_scorer()
    words = [w.encode() for w in ["the", "don't", "\xa0x", "x\xa0", "\u3000", "é\x85é", "12,3", "漢字", "...", "a\x1cb", "\U0001f600", "x" * 300]]
    ids, n = s.spell_all(words)
    assert n.tolist() == [len(s.spell(w)) for w in words] and ids.tolist() == np.concatenate([s.spell(w) for w in words]).tolist()


def test_windows_score_each_place_once():
    for n in (1, 5, 24, 25, 100):
        _, target, scored = lm.windows(np.arange(n), np.arange(n) + 1000)
        assert sorted(target[scored].tolist()) == list(range(1000, 1000 + n))


def small_network(n=1, seed=1):
    r = np.random.default_rng(seed)
    net = lm.Attention(r.integers(0, 10, 40), 10)
    ids, prior = r.integers(0, 40, (n, lm.STEP + lm.OVERLAP)), np.log(r.dirichlet(np.ones(10), n * lm.STEP)).astype(np.float32)
    return net, ids, prior, r


def test_network_is_causal_and_normalised():
    net, ids, prior, _ = small_network()
    own, everything, ones = ids[:, lm.OVERLAP :] % 10, np.ones((1, lm.STEP), bool), np.ones(10, np.float32)
    logs = np.stack([net.log_probs(ids, prior, np.full_like(own, k), everything, ones)[0] for k in range(10)])
    assert np.allclose(np.exp(logs).sum(0), 1, atol=1e-4)
    d = ids.copy()
    d[0, -1] = (d[0, -1] + 1) % 40
    a, b = (net.log_probs(x, prior, own, everything, ones)[0] for x in (ids, d))
    assert np.allclose(a[:-1], b[:-1]) and not np.allclose(a[-1], b[-1])


def test_network_gradients():
    net, ids, prior, r = small_network(3, 0)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    prior, t, w = prior.astype(float), r.integers(0, 10, (3, lm.STEP)), np.ones((3, lm.STEP))

    def loss():
        return -net.log_probs(ids, prior, t, w > 0, np.ones(10))[0].mean()

    g = net.gradients(ids, prior, t, w)
    rows, move = g["E"]
    g["E"] = np.zeros_like(net.p["E"])
    g["E"][rows] = move
    for k, v in net.p.items():
        at = (ids[0, 9], 3) if k == "E" else tuple(r.integers(0, n) for n in v.shape)
        old = v[at]
        v[at] = old + 1e-5
        up = loss()
        v[at] = old - 1e-5
        down = loss()
        v[at] = old
        assert (up - down) / 2e-5 == pytest.approx(g[k][at], rel=1e-3, abs=1e-7), k


def learned_scorer(spark, sf, **how):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    vocabulary = lm.materialise(lm.count_words(docs, "text"), "vocabulary").cache()
    return lm.learn(docs, vocabulary, "text", "doc_id", **how)[0], vocabulary


def plain_text_score(s, counts, text):
    """A text's log10 probability, place by place: one masked attention row a place, softmax over classes, ids within classes by their definition."""
    p = {k: v.astype(float) for k, v in s.net.p.items()}
    words = text.encode().translate(lm.LOWER).split()
    spelled = [s.spell(w).tolist() for w in words]
    line = [s.tokenizer.end, *(i for w in spelled for i in w), s.tokenizer.end]
    logs, opens = [], []
    for t in range(len(line) - 1):
        begin = t // lm.STEP * lm.STEP - lm.OVERLAP
        x = [p["E"][line[max(j, 0)]] + p["P"][j - begin] for j in range(begin, t + 1)]
        q = x[-1] @ p["Q"]
        e = np.exp([q @ (v @ p["K"]) / math.sqrt(lm.WIDTH) for v in x])
        h = x[-1] + sum(a * (v @ p["V"]) for a, v in zip(e / e.sum(), x, strict=True))
        y = h + np.maximum(h @ p["A"] + p["a"], 0) @ p["B"]
        z = np.exp(y @ p["O"] + p["o"] + s.prior[s.place[line[t]]])
        z /= z.sum()
        logs.append(math.log(z[s.classes[line[t + 1]]]))
        opens.append(math.log(z[s.starts > 0].sum()))
    at, total = 0, 0.0
    for w, ids in zip(words, spelled, strict=True):
        kind, each = s.classes[ids[0]], 0.0
        for k, i in enumerate(ids):
            if k == 0:
                each += logs[at] + s.opening[i]
            else:
                before = s.place[ids[k - 1]]
                mates = np.flatnonzero(s.classes[:-1] == s.classes[i])
                share = np.exp(s.log_on[before, s.place[mates]] + s.log_within[mates])
                each += logs[at + k] + math.log(share[mates == i][0] / share.sum())
        each += opens[at + len(ids)] - opens[at]
        total += math.log(math.exp(each + s.weights[0, kind]) + counts.get(w, 0) * math.exp(logs[at] - opens[at] - s.log_in_class[kind] + s.weights[1, kind]))
        at += len(ids)
    return (total + logs[at] - opens[at]) / math.log(10)


def test_scores_equal_a_plain_masked_forward_pass(spark, monkeypatch):
    """Words sent to the tasks, joined and never seen; texts shorter and longer than windows."""
    monkeypatch.setattr(lm, "STEPS", 150)
    s, vocabulary = learned_scorer(spark, "sf0.001", per_million=500, frequent=800)
    counts = {r.word: r.c for r in vocabulary.collect()}
    counts = {bytes(k): c for k, c in counts.items()}
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(6).collect()] + ["", "The", "zzyzzx qqq the of zzyzzx", "Nunca jamás " * 20]
    for t, (n, _, _, score, rare, a, b) in zip(texts, s.score([t.encode() for t in texts]), strict=True):
        whole = score + sum(math.log10(x + counts.get(w, 0) * y) for w, x, y in zip(rare, a, b, strict=True) if counts.get(w, 0))
        assert n == len(t.encode().split()) + 1 and whole == pytest.approx(plain_text_score(s, counts, t), rel=2e-3, abs=2e-3)


def test_words_and_ids_sum_to_one(spark, monkeypatch):
    """Within a class the ids sum to 1 after any id; over the classes so do the priors."""
    monkeypatch.setattr(lm, "STEPS", 5)
    s, _ = learned_scorer(spark, "sf0.001", per_million=500)
    assert np.allclose(np.exp(s.prior).sum(1), 1, atol=1e-3)
    opening = s.opens_word[:-1]
    assert np.allclose(np.bincount(s.classes[:-1][opening], weights=np.exp(s.opening[:-1][opening]), minlength=lm.CLASSES)[np.unique(s.classes[:-1][opening])], 1)
    for before in (0, 5, 700):
        share = np.exp(s.log_on[before, s.place[:-1]] + s.log_within[:-1]) * ~opening
        by_class = np.bincount(s.classes[:-1], weights=share, minlength=lm.CLASSES)
        inside = np.unique(s.classes[:-1][~opening])
        assert np.allclose(np.log(by_class[inside]), s.prior[before, inside], atol=1e-3)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_model_beats_base_on_held_out_text(spark, sf):
    """On whole held-out texts, words and all."""
    rows = lm.score(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text"), fold("doc_id", 7) == 2).where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert rows.score > rows.base


def test_what_training_gathers_grows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    sizes = [len(lm.passages(docs, "text", "doc_id", tokens, per_million=100)) for tokens in (10**6, 8 * 10**6, 10**9)]
    assert 1.6 < sizes[1] / sizes[0] < 2.4 and 8 < sizes[2] / sizes[0] < 12
    got = lm.passages(docs, "text", "doc_id", 10**6, per_million=3000)
    whole = {r.text for r in docs.collect()}
    assert all(any(t.decode() in w for w in whole) for t, *_ in got[::97]) and 0.2 < sum(not b for _, b, _ in got) / len(got) < 0.95


def test_rare_words_score_by_their_counts(spark, monkeypatch):
    """A score is the same, whether words are sent to the tasks or joined."""
    monkeypatch.setattr(lm, "STEPS", 600)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(300)
    one = {r.doc_id: r.score for r in lm.score(docs, fold("doc_id", 7) == 2).collect()}
    monkeypatch.setattr(lm.learn, "__defaults__", (None, lm.PASSAGES, 200))
    two = {r.doc_id: r.score for r in lm.score(docs, fold("doc_id", 7) == 2).collect()}
    assert len(one) == 300 and two == pytest.approx(one, rel=1e-4)


def test_all_training_texts_teach(spark, monkeypatch):
    """Without any passages the network and the weights are learnt all the same, and tell texts of the training set better."""
    monkeypatch.setattr(lm, "passages", lambda *a, **k: [])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    vocabulary = lm.materialise(lm.count_words(docs, "text"), "vocabulary")
    s = lm.learn(docs, vocabulary, "text", "doc_id", frequent=300)[0]
    fresh = lm.Attention(s.classes, lm.CLASSES + 1)
    met = np.unique(np.concatenate([s.ids((r.text or "").encode())[0] for r in docs.collect()]))
    assert all((s.net.p[k] != fresh.p[k]).any() for k in fresh.p) and (s.net.p["E"][met] != fresh.p["E"][met]).any(1).all()
    texts = [r.text.encode() for r in docs.limit(50).collect()]
    taught = sum(x[3] for x in s.score(texts))
    s.net, weights = fresh, s.weights
    assert taught > sum(x[3] for x in s.score(texts))
    s.weights = np.log(np.tile([[0.3], [0.7]], (1, lm.CLASSES + 1)))
    assert not np.allclose(weights, s.weights)


def test_odds_count_every_training_word(spark, monkeypatch):
    """Frequent words and those met in the vocabulary alike."""
    monkeypatch.setattr(lm, "STEPS", 5)
    seen = []
    monkeypatch.setattr(lm.Scorer, "fit_weights", lambda self, odds: seen.append(odds))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    vocabulary = lm.materialise(lm.count_words(docs, "text"), "vocabulary")
    for frequent in (lm.FREQUENT, 50):
        lm.learn(docs, vocabulary, "text", "doc_id", per_million=500, frequent=frequent)
    assert seen[0].sum() == seen[1].sum() == vocabulary.agg(F.sum("c")).first()[0]
    assert np.abs(seen[0] - seen[1]).sum() < 0.01 * seen[0].sum()
