"""Reading and writing: archives of files, JSON lines, the graph and vector tables, HTML pages, and what may fail to parse."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritide.functions import text as X
from veritide.sources import versions

#: Fixed: of copies of a document in several formats, the first of these is read.
FORMATS = ["md", "docx", "pdf", "txt"]

#: Closed schemas.
BLOCK = "block_id string, doc_id string, page int, ord int, block_type string, text string, asset_path string, bbox array<double>, section_path array<string>, caption_ref string, ocr_confidence double, token_count int, checksum string"
CHUNK = "chunk_id string, doc_id string, block_ids array<string>, text string, page_span struct<lo:int,hi:int>, section_path array<string>, authority_tier int, source_type string, embedding_id string, asset_ids array<string>, token_count int"
ENTITY = "entity_id string, name string, type string, aliases array<string>, mention_count int, doc_ids array<string>"
EDGE = "subject_id string, predicate string, object_id string, evidence string, tier int, confidence double, qualifier string"
IMAGE = "asset_id string, paths array<string>, canonical_path string, tier int, caption string, entity_link string, kind string, subject string, description string, text_visible string, values array<struct<label:string,value:string>>, objects_depicted array<string>, ocr_text string, ocr_char_count int, ocr_confidence double, searchable_text string, cached boolean"


def archive(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), content, length of all corpus files, images aside."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^.*?" + root.rstrip("/").removeprefix("file://").replace(".", r"\.") + "/", "")
    return files.select(path.alias("path"), "content", "length").where(X.is_corpus_file(F.col("path")) & ~F.lower("path").endswith(".png"))


def articles(spark: SparkSession, root: str) -> DataFrame:
    """path, text of wiki articles."""
    return archive(spark, root).where(F.lower("path").rlike(r"^wiki/[^/]*\.md$")).select("path", F.decode("content", "UTF-8").alias("text"))


def pair_copies(files: DataFrame) -> DataFrame:
    """Copies of a document in a folder as one: folder, doc_id, canonical path and the others. Not scanned first, then by format, then by path."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, FORMATS)), ext), F.lit(0)), F.lit(len(FORMATS) + 1))
    keyed = files.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), X.document_id(F.col("path")).alias("doc_id"), F.struct(X.is_scan(F.col("path")).alias("scan"), order.alias("order"), F.col("path")).alias("k"))
    paths = F.transform(F.array_sort(F.collect_list("k")), lambda k: k["path"])
    return keyed.groupBy("folder", "doc_id").agg(paths.alias("p")).select("folder", "doc_id", F.element_at("p", 1).alias("canonical"), F.slice("p", F.lit(2), F.greatest(F.lit(0), F.size("p") - 1)).alias("aliases"))


def same_content(files: DataFrame) -> DataFrame:
    """sha, paths: files of equal bytes; the first path under images/ names them, else the first."""
    return files.groupBy(F.sha2("content", 256).alias("sha")).agg(F.array_sort(F.collect_list("path")).alias("paths")).withColumn("canonical", F.coalesce(F.get(F.filter("paths", lambda p: p.startswith("images/")), F.lit(0)), F.element_at("paths", 1)))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a closed schema; a line that does not fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(lines_at(spark, path))


def read_lines_or_set_aside(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, lines that do not parse)."""
    raw = spark.read.text(lines_at(spark, path)).where(F.trim("value") != "")
    parsed = raw.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select("value")


def variant_lines(raw: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """(the other columns with ``record``, a VARIANT of what a line holds; the lines that are no JSON). Blank lines are neither.

    Lines need no schema and may differ from each other: what stands where is asked by path, with ``field``.
    """
    rows = raw.where(F.trim(line) != "").withColumn("record", F.try_parse_json(line))
    return rows.where("record IS NOT NULL").drop(line), rows.where("record IS NULL").drop("record")


def field(record: str | Column, path: str, kind: str) -> Column:
    """What stands at a path (``$.a.b[0]``) of a VARIANT, null where nothing does or where it is no such kind."""
    return F.try_variant_get(record, path, kind)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines in place of those under a path, which stands for the old lines or the new ones at any moment."""
    spark, root = df.sparkSession, path.rstrip("/")
    before = versions.read(spark, root)[0]
    folder = f"lines-{uuid.uuid4().hex[:16]}"
    df.write.json(f"{root}/{folder}")
    versions.publish(spark, root, before + 1, {"tables": {"lines": folder}})
    versions.vacuum(spark, root)


def lines_at(spark: SparkSession, path: str) -> str:
    """Where the lines of a path are: of its last version, or the path itself if it has none."""
    said = versions.read(spark, path.rstrip("/"))[1]
    return f"{path.rstrip('/')}/{said['tables']['lines']}" if said else path


def write_tables(named: dict[str, DataFrame], root: str) -> None:
    """Tables under a folder, all replaced at once: a graph's entities and relations, an index's postings and counts."""
    versions.write(named, root)


def read_tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return versions.tables(spark, root, names)


def route(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every rule, the others with ``problem``: the first rule they break). A rule that is null is broken."""
    problem = F.lit(None).cast("string")
    for name, ok in reversed(list(rules.items())):
        problem = F.when(F.coalesce(ok, F.lit(False)), problem).otherwise(name)
    marked = df.withColumn("problem", problem)
    return marked.where("problem IS NULL").drop("problem"), marked.where("problem IS NOT NULL")


def upsert(existing: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return existing.unionByName(new).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def html_outline(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, title, n_headings, n_links, n_paragraphs, first_heading of HTML pages."""
    strip = lambda c: X.squeeze(F.regexp_replace(c, r"<[^>]*>", " "))
    h = F.col(html)
    return pages.select(page_id, strip(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_count(h, F.lit(r"(?i)<h[1-6][ >]")).alias("n_headings"), F.regexp_count(h, F.lit(r"(?i)<a\s")).alias("n_links"), F.regexp_count(h, F.lit(r"(?i)<p[ >]")).alias("n_paragraphs"), strip(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("first_heading"))


def heading_sizes(spans: DataFrame, ratio: float = 1.15, most: int = 2, least_spans: int = 2) -> DataFrame:
    """doc_id, size, level: font sizes of headings from text spans (doc_id, size, text). The body is the size with most characters."""
    by = spans.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("volume"), F.count("*").alias("n"))
    body = by.groupBy("doc_id").agg(F.max_by("size", "volume").alias("body"))
    big = by.join(body, "doc_id").where((F.col("size") > F.col("body") * ratio) & (F.col("n") >= least_spans))
    return big.withColumn("level", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))).where(F.col("level") <= most).select("doc_id", "size", "level")


def ocr_pages(words: DataFrame) -> DataFrame:
    """doc_id, page, text, confidence from recognised words (doc_id, page, pos, word, conf; a conf below 0 is no word)."""
    ok = F.col("conf") >= 0
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok & (F.trim("word") != ""), F.struct("pos", "word")))), lambda x: x["word"]), " ")
    return words.groupBy("doc_id", "page").agg(line.alias("text"), F.avg(F.when(ok, F.col("conf") / 100)).alias("confidence"))


def describe(images: DataFrame, model: Callable, schema: str) -> DataFrame:
    """Images through an injected batch function (iterator of pandas frames), which stands for any external model."""
    return images.mapInPandas(model, schema)
