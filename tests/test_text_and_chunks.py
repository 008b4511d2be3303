import random
import re

import pytest
from pyspark.sql import functions as F

from tests.plain_chunker import plain_chunks
from veritide.functions import text as X
from veritide.operators import chunking


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, X.tokens(F.col("t")), t="Thrice-Bound Edge's 1,114") == ["thrice-bound", "edge's", "1", "114"]
    assert one(spark, X.tokens(F.lit(None).cast("string")), t="") == []


@pytest.mark.parametrize(("raw", "value"), [("1,114", "1114"), ("4672 troops", "4672"), ("246AS", "246 AS"), ("**None  recorded** ", "none recorded"), ("12 as", "12 AS"), ("A B", "a b")])
def test_values(spark, raw, value):
    assert one(spark, X.value_normal(F.col("t")), t=raw) == value


def test_entity_ids(spark):
    assert one(spark, X.entity_id(F.col("t")), t="The Iron-Ring Cartel") == one(spark, X.entity_id(F.col("t")), t="[[Iron-Ring Cartel]]") == "ent_iron_ring_cartel"


@pytest.mark.parametrize(
    ("path", "tier", "kind"),
    [("./Codex\\a.md", 1, "codex"), ("images/x.png", 1, "figure_plate"), ("wiki/images/a.png", 2, "wiki_image"), ("Wiki/a.md", 2, "wiki"), ("chronicles/n.pdf", 3, "novel"), ("ephemera/ballad_concerning_x.md", 5, "ballad"), ("ephemera/letter_concerning_x.scan.pdf", 4, "letter"), ("ephemera/_concerning_x.md", 4, "ephemera"), ("x/plate_1.md", 1, "figure_plate"), ("y.md", 4, "unknown")],
)
def test_provenance(spark, path, tier, kind):
    assert one(spark, X.authority(F.col("p"))["tier"], p=path) == tier
    assert one(spark, X.source_type(F.col("p")), p=path) == kind


def test_clean_and_captions(spark):
    assert one(spark, X.clean(F.col("t")), t="  a \t b \r\n\r\n\r\n\r\nc  \rd ") == "a b\n\nc\nd"
    assert one(spark, X.is_caption(F.col("t")), t=" Fig. 3 shows") and one(spark, X.is_caption(F.col("t")), t="plate IV") and not one(spark, X.is_caption(F.col("t")), t="Tables 3")


def test_point_id_is_uuid5(spark):
    import uuid

    ns = uuid.NAMESPACE_URL
    assert one(spark, X.point_id(ns.bytes, F.col("t")), t="doc:c1") == str(uuid.uuid5(ns, "doc:c1"))


def test_markdown_tables(spark):
    assert one(spark, X.rows_to_markdown(F.expr("array(array('a','b'), array('c'), array(null, 'd\ne'))")), t="") == "| a | b |\n|---|---|\n| c |  |\n|  | d e |"


def test_text_blocks(spark):
    text = "The Old Keep\n\nIt stood.\nLong ago.\n \nFig. 2 the keep\n\nNEXT PART\n\nmore words here."
    got = [(b.ord, b.block_type, b.text, b.section_path) for b in chunking.text_blocks(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("ord").collect()]
    assert got == [
        (0, "heading", "The Old Keep", ["The Old Keep"]),
        (1, "text", "It stood.\nLong ago.", ["The Old Keep"]),
        (2, "caption", "Fig. 2 the keep", ["The Old Keep"]),
        (3, "heading", "NEXT PART", ["NEXT PART"]),
        (4, "text", "more words here.", ["NEXT PART"]),
    ]


def test_markdown_blocks(spark):
    text = "intro\n# A\n\nText one\n![x](y.png)\nstill one\n| a | b |\n|---|---|\n| 1 | 2 |\nafter\n### C\ndeep\n## B\nPlate 3 here\n# D"
    got = [(b.block_type, b.text, b.section_path) for b in chunking.markdown_blocks(spark.createDataFrame([("d", text)], "doc_id string, text string")).orderBy("ord").collect()]
    assert got == [
        ("text", "intro", []),
        ("heading", "A", ["A"]),
        ("text", "Text one\nstill one", ["A"]),
        ("table", "| a | b |\n|---|---|\n| 1 | 2 |", ["A"]),
        ("text", "after", ["A"]),
        ("heading", "C", ["A", "C"]),
        ("text", "deep", ["A", "C"]),
        ("heading", "B", ["A", "B"]),
        ("caption", "Plate 3 here", ["A", "B"]),
        ("heading", "D", ["D"]),
    ]


def plain_pack(text, target):
    """Sentences packed greedily, as plainly as can be."""
    if chunking.estimate(text) <= target:
        return [text]
    out, now, size = [], [], 0
    for s in re.split(X.SENTENCE_END, text):
        n = chunking.estimate(s)
        if now and size + n > target:
            out, now, size = [*out, " ".join(now)], [], 0
        now, size = [*now, s], size + n
    return [*out, " ".join(now)]


def test_sentence_packing_is_a_fold(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["word ", "longer words ", "End. ", 'Said "x." ', "Why? "]) for _ in range(r.randrange(1, 120))).strip() or "x" for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for target in (5, 30, 100):
        got = {x.i: x.p for x in df.select("i", chunking.pack_sentences(F.col("t"), target).alias("p")).collect()}
        assert got == {i: plain_pack(t, target) for i, t in enumerate(texts)}


def blocks(spark, rows):
    return spark.createDataFrame([("d", f"d:b{n}", n, 1, k, t, s, None) for n, (k, t, s) in enumerate(rows)], "doc_id string, block_id string, ord int, page int, block_type string, text string, section_path array<string>, asset_path string")


def words(n):
    return " ".join(["word"] * n)


def test_chunks_keep_tables_whole_and_sections_apart(spark):
    got = chunking.chunk(blocks(spark, [("heading", "Lots", ["A"]), ("table", "| x |\n" * 400, ["A"]), ("text", words(60), ["A"]), ("text", words(60), ["B"]), ("figure", "a plate", ["B"])])).orderBy("chunk_id").collect()
    assert [c.block_ids for c in got] == [["d:b0", "d:b1"], ["d:b2"], ["d:b3"], ["d:b4"]]
    assert got[0].token_count > 450 and got[1].section_path == ["A"] and got[2].section_path == ["B"]


def test_long_text_is_split_and_overlaps(spark):
    sentence = words(30) + ". "
    rows = [("text", sentence * 40, ["A"])] + [("text", words(50), ["A"])] * 12
    got = sorted(chunking.chunk(blocks(spark, rows)).collect(), key=lambda c: int(c.chunk_id.split("c")[-1]))
    assert all(c.token_count <= 520 for c in got)
    ids = [b for c in got for b in c.block_ids]
    assert "d:b0.0" in ids and len(ids) > len(set(ids))
    assert [c.chunk_id for c in got] == [f"d:c{n}" for n in range(len(got))]


def test_short_pieces_wait_for_what_follows(spark):
    got = chunking.chunk(blocks(spark, [("heading", "Alone", ["A"]), ("text", words(60), ["B"]), ("text", "tail", ["B"]), ("text", "end", ["C"])])).orderBy("chunk_id").collect()
    assert [(c.block_ids, c.section_path) for c in got] == [(["d:b0", "d:b1", "d:b2"], ["B"]), (["d:b3"], ["C"])]


def test_section_groups(spark):
    df = blocks(spark, [("text", "a", ["A"]), ("text", "b", ["A"]), ("text", "c", ["B"]), ("text", "d", ["A"]), ("text", "e", None)])
    assert [r.group for r in chunking.section_groups(df).orderBy("ord").collect()] == [0, 0, 1, 2, 3]


def test_outline_overrides_depth(spark):
    b = spark.createDataFrame([("d", "heading", " Keep ", 3), ("d", "text", "Keep", 1)], "doc_id string, block_type string, text string, depth int")
    o = spark.createDataFrame([("d", 0, "keep", 1), ("d", 1, "KEEP", 2)], "doc_id string, pos int, title string, depth int")
    assert sorted((r.block_type, r.depth, r.outlined) for r in chunking.outline_depths(b, o).collect()) == [("heading", 2, True), ("text", 1, False)]


def random_blocks(r, n):
    """Blocks of all kinds and sizes: sections that return, empty and blank texts, long sentences."""
    out, section = [], ["A"]
    for _ in range(n):
        if r.random() < 0.25:
            section = r.choice([["A"], ["A", "B"], ["C"], []])
        kind = r.choices(["text", "heading", "table", "figure", "caption"], [10, 3, 1, 1, 1])[0]
        text = r.choice(["", " ", "end.", words(r.randrange(1, 12)), words(r.randrange(20, 70)) + ".", ". ".join(words(r.randrange(1, 40)) for _ in range(r.randrange(1, 25))), words(r.choice([150, 400]))])
        out.append((kind, text, section))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_chunks_equal_one_plain_fold(spark, monkeypatch, seed):
    """Documents of any length, in one segment and in many, under several sizes."""
    r = random.Random(seed)
    docs = {f"d{k}": random_blocks(r, n) for k, n in enumerate([0, 1, 2, 3, 40, 150, 400, 900])}
    rows = [(d, f"{d}:b{n}", n, r.randrange(1, 5), k, t, s, f"{d}/{n}.png" if k == "figure" and n % 3 else None) for d, own in docs.items() for n, (k, t, s) in enumerate(own)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id string, block_id string, ord int, page int, block_type string, text string, section_path array<string>, asset_path string")
    target, overlap, segment = [(450, 0.15, 4096), (20, 0.5, 8), (60, 0.3, 8)][seed]
    monkeypatch.setattr(chunking, "SEGMENT", segment)
    cut = {}
    for x in chunking.pieces(df, target, overlap).collect():
        cut.setdefault(x.doc_id, []).append(x)
    want = sorted(c for d, own in cut.items() for c in plain_chunks(d, [(x.section_path, x.block_id, x.block_type, x.piece, x.page, x.asset_path) for x in sorted(own, key=lambda x: (x.ord, x["at"]))], target, overlap))
    got = sorted((c.chunk_id, c.block_ids, c.text, (c.page_lo, c.page_hi), c.section_path, c.asset_ids, c.token_count) for c in chunking.chunk(df, target, overlap).collect())
    assert got == want and len(want) > 50


def test_a_document_of_one_section_is_folded_in_segments(spark, monkeypatch):
    """A long document without any place to start anew: as many tasks fold it as it has segments, and no window sees its texts."""
    monkeypatch.setattr(chunking, "SEGMENT", 64)
    r = random.Random(9)
    rows = [("d", f"b{n}", n, 1, "text", words(r.randrange(1, 14)), ["A"], None) for n in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id string, block_id string, ord int, page int, block_type string, text string, section_path array<string>, asset_path string")
    want = plain_chunks("d", [(s, b, k, t, p, a) for _, b, _, p, k, t, s, a in rows], 30, 0.4)
    got = {c.chunk_id: (c.block_ids, c.token_count) for c in chunking.chunk(df, 30, 0.4).collect()}
    assert got == {c[0]: (c[1], c[6]) for c in want}
    assert chunking.chunk(df.limit(0)).count() == 0


@pytest.mark.parametrize(("target", "overlap", "segment"), [(450, 0.15, 4096), (25, 0.4, 8)])
def test_sweeps_count_chunks_without_their_texts(spark, monkeypatch, target, overlap, segment):
    """Lengths told from pieces are those of the chunks, white space at their ends included; texts are neither stored nor moved, and what is stored on the way goes."""
    r = random.Random(target)
    blank = lambda: r.choice(["", " ", "\n", "  ", "\x1c", " \u0085\n"])
    rows = [(f"d{d}", f"d{d}:b{n}", n, 1, k, blank() + t + blank(), s, None) for d, size in enumerate([0, 1, 3, 60, 300]) for n, (k, t, s) in enumerate(random_blocks(r, size))]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "doc_id string, block_id string, ord int, page int, block_type string, text string, section_path array<string>, asset_path string")
    monkeypatch.setattr(chunking, "SEGMENT", segment)
    want = sorted((c.chunk_id, c.token_count) for c in chunking.chunk(df, target, overlap).collect())
    stored, plain = {}, chunking.store.written
    monkeypatch.setattr(chunking.store, "written", lambda table, name, path=None: stored.setdefault(plain(table, name, path), table.columns) and [*stored][-1])
    got = sorted((f"{c.doc_id}:c{c.chunk}", c.token_count) for c in chunking.token_counts(df, target, overlap).collect())
    assert got == want and len(want) > 30
    assert {c for columns in stored.values() for c in columns}.isdisjoint({"text", "piece", "raw_text"}) and len(stored) > 2
    stored.clear()
    one = chunking.sweep(df, (target,), 10).collect()[0]
    counts = [n for _, n in sorted((c.chunk_id, c.token_count) for c in chunking.chunk(df, target).collect())]
    assert (one.target, one.chunks, one.over_limit) == (target, len(counts), sum(n > 10 for n in counts))
