import importlib
import json
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from veritide.sources import tables

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_archive(spark, tmp_path):
    for path, body in {"wiki/a b.md": "# A", "wiki/images/x.png": "p", "readme.txt": "r", "codex/a.pdf": "1", "codex/a.docx": "2", "codex/a.scan.pdf": "1"}.items():
        f = tmp_path / "corpus" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    files = tables.archive(spark, str(tmp_path / "corpus"))
    assert sorted(r.path for r in files.collect()) == ["codex/a.docx", "codex/a.pdf", "codex/a.scan.pdf", "wiki/a b.md"]
    got = {(r.folder, r.doc_id): (r.canonical, r.aliases) for r in tables.pair_copies(files).collect()}
    assert got == {("codex", "a"): ("codex/a.docx", ["codex/a.pdf", "codex/a.scan.pdf"]), ("wiki", "a_b"): ("wiki/a b.md", [])}
    assert sorted(r.paths for r in tables.same_content(files).collect() if len(r.paths) > 1) == [["codex/a.pdf", "codex/a.scan.pdf"]]
    assert [(r.path, r.text) for r in tables.articles(spark, str(tmp_path / "corpus")).collect()] == [("wiki/a b.md", "# A")]


def test_lines(spark, tmp_path):
    (tmp_path / "in").write_text('{"entity_id": "e", "name": "n"}\n\nnot json\n')
    good, bad = tables.read_lines_or_set_aside(spark, str(tmp_path / "in"), tables.ENTITY)
    assert [r.entity_id for r in good.collect()] == ["e"] and [r.value for r in bad.collect()] == ["not json"]
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        tables.read_lines(spark, str(tmp_path / "in"), tables.ENTITY).collect()
    tables.write_lines(good, str(tmp_path / "out"))
    tables.write_lines(good, str(tmp_path / "out"))
    assert tables.read_lines(spark, str(tmp_path / "out"), tables.ENTITY).count() == 1


def test_routing_and_upsert(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, v int")
    good, bad = tables.route(df, {"present": F.col("v").isNotNull(), "positive": F.col("v") > 0})
    assert [r.id for r in good.collect()] == [1] and sorted((r.id, r.problem) for r in bad.collect()) == [(2, "present"), (3, "positive")]
    assert sorted((r.id, r.v) for r in tables.upsert(df, spark.createDataFrame([(1, 9)], "id int, v int"), "id", "v").collect()) == [(1, 9), (2, None), (3, -1)]


def test_pages_of_words_and_font_sizes(spark):
    words = spark.createDataFrame([("d", 1, 2, "b", 80.0), ("d", 1, 1, "a", 90.0), ("d", 1, 3, "", -1.0)], "doc_id string, page int, pos int, word string, conf double")
    assert [(r.text, round(r.confidence, 3)) for r in tables.ocr_pages(words).collect()] == [("a b", 0.85)]
    spans = spark.createDataFrame([("d", 10.0, "x" * 100)] * 5 + [("d", 20.0, "T")] * 2 + [("d", 15.0, "S")] * 3 + [("d", 13.0, "U")] * 3 + [("d", 30.0, "once"), ("d", 11.0, "e")], "doc_id string, size double, text string")
    assert sorted((r.level, r.size) for r in tables.heading_sizes(spans).collect()) == [(1, 20.0), (2, 15.0)]


def test_contract_without_the_training_data_part(monkeypatch):
    import __spark_entry__ as entry

    whole = set(entry.queries())
    real = importlib.import_module

    def without(name, *a):
        if name.startswith(("veritide.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", without)
    rest = set(entry.queries())
    assert rest and all(not q.startswith("op") and q != "pipeline" for q in rest) and rest <= whole
    assert set(entry.oracle_sql()) <= rest


def rows_of(columns, rows):
    def norm(x):
        return round(x, 6) + 0.0 if isinstance(x, float) else x

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def registered():
    from veritide.plans.catalog import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", registered())
def test_query_equals_sql(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["qid", "chunk_id", "score", "rank"]
    assert "veritide" in sys.modules and json.dumps(sorted(entry.queries()))


def docx(body):
    import io
    import zipfile

    buffer = io.BytesIO()
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return buffer.getvalue()


def test_word_processor_documents(spark):
    from veritide.operators import ingest

    p = lambda text, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Keep", "Title") + p("one") + p("two") + p("Walls", "Heading1") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}</w:tr></w:tbl>" + p("Plate 3 walls")
    files = spark.createDataFrame([("d", bytearray(docx(body))), ("bad", bytearray(b"no zip"))], "doc_id string, content binary")
    blocks, dead = ingest.docx_blocks(files)
    assert [(b.block_type, b.text, b.section_path) for b in blocks.orderBy("ord").collect()] == [
        ("heading", "Keep", ["Keep"]),
        ("text", "one\n\ntwo", ["Keep"]),
        ("heading", "Walls", ["Keep", "Walls"]),
        ("table", "| a | b |\n|---|---|\n| 1 |  |", ["Keep", "Walls"]),
        ("caption", "Plate 3 walls", ["Keep", "Walls"]),
    ]
    assert [r.doc_id for r in dead.collect()] == ["bad"]


def test_retries_and_boxes(spark):
    from veritide.operators import answers

    calls, waits = [], []

    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        answers.Retry(jitter=0).run(fails, sleep=waits.append)
    assert len(calls) == 5 and waits == [1, 2, 4, 8]
    box = lambda b: spark.range(1).select(answers.valid_box(F.expr(b), F.lit(10.0), F.lit(10.0)).alias("x")).first().x
    assert box("array(0D, 1D, 5D, 9D)") and not box("array(0D, 1D, 5D, 11D)") and not box("array(5D, 1D, 5D, 9D)") and not box("array(1D)")
    errors = spark.range(1).select(answers.structural_errors(F.lit(True), F.lit(False), F.lit(False), F.lit(True)).alias("x")).first().x
    assert errors == ["claim_citation_unresolved", "partial_without_missing_information"]
