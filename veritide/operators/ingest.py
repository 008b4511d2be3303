"""Bringing files in: captions of images, routing by format, counters, profiles, word-processor documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritide.functions import text as X
from veritide.sources import tables

#: Fixed: first guesses of a tier by words in a path, tried in this order.
TIER_WORDS = [
    (5, r"ballad|tavern|rumou?r|hearsay|folk|legend|song|tale|verse|ditty"),
    (1, r"codex|plate|datasheet|data[\s_-]?book|reference|appendix|table[\s_-]?\d|figure[\s_-]?plate"),
    (2, r"wiki|encyclop|article|entry|lexicon|gazetteer"),
    (4, r"letter|ledger|transcript|trial|dispatch|decree|order|manifest|receipt|deposition|writ|invoice|inventory"),
    (3, r"novel|volume|vol[\s_.\-]?\d|chapter|book[\s_.\-]?\d|part[\s_.\-]?\d"),
]
#: Fixed: characters that stand for a page where a format has none.
PAGE_CHARS = 1800
#: Fixed: prices in dollars a million tokens (in, out).
PRICES = {"deepseek/deepseek-chat": (0.27, 1.10), "anthropic.claude-3-5-sonnet-20241022-v2:0": (3.00, 15.00), "gemini-2.5-flash": (0.30, 2.50)}
#: Fixed: image sources, whose passages propose no edges; the tiers of passages that do, and how many names they need.
IMAGE_SOURCES, EDGE_TIERS, EDGE_NAMES = ["figure_plate", "wiki_image"], [3, 4, 5], 2
PLATE = r"^plate_(\d+)_([a-z]+)_(.+)$"


def guess_tier(path: Column) -> Column:
    low = F.translate(F.lower(path), "\\", "/")
    out = F.lit(0)
    for tier, pattern in reversed(TIER_WORDS):
        out = F.when(low.rlike(pattern), tier).otherwise(out)
    return out


def capitalised(text: Column) -> Column:
    """Every word of lower-case letters with a capital first, also after marks."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|[^a-z]+"), F.lit(0)), F.initcap), "")


def captions(images: DataFrame, shown: DataFrame) -> DataFrame:
    """images (path) with caption, entity_link, owner: from a plate's name, else from the article that shows it, else the name.

    shown: path of an image, article, alt (the first article by name).
    """
    stem = F.regexp_replace(X.base_name(F.col("path")), r"\.[^.]*$", "")
    plate = stem.rlike(PLATE)
    subject = F.translate(F.regexp_extract(stem, PLATE, 3), "_", " ")
    out = images.join(shown.select(F.col("path").alias("_p"), "article", "alt"), F.col("path") == F.col("_p"), "left")
    named = F.concat(F.lit("Plate "), F.regexp_extract(stem, PLATE, 1), F.lit(" - "), capitalised(subject), F.lit(" ("), F.regexp_extract(stem, PLATE, 2), F.lit(")"))
    return out.select(
        *images.columns,
        F.when(plate, named).when(F.col("_p").isNotNull(), F.col("alt")).otherwise(F.translate(stem, "_", " ")).alias("caption"),
        F.when(plate, X.entity_id(subject)).when(F.col("alt") != "", X.entity_id(F.col("alt"))).alias("entity_link"),
        F.when(~plate, F.col("article")).alias("owner"),
    )


def cost(model: Column, tokens_in: Column, tokens_out: Column, cached: Column) -> Column:
    """Dollars of a call; nothing for a cached one or a model without a price."""
    out = F.lit(0.0)
    for name, (i, o) in PRICES.items():
        out = F.when(model == name, tokens_in * i / 1e6 + tokens_out * o / 1e6).otherwise(out)
    return F.when(cached, 0.0).otherwise(out)


def reader_for(path: Column, head: Column) -> Column:
    """Which scan reads a file, by its ending and, for plain text, by what it looks like; null: none does."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext.isin("md", "markdown"), "markdown").when(ext.isin("txt", "rst"), F.when(X.looks_like_markdown(head), "markdown").otherwise("text")).when(ext == "docx", "docx").when(ext == "pdf", "pdf")


def block_counts(blocks: DataFrame) -> DataFrame:
    """Counters of each document's blocks."""
    of = lambda kind: F.count_if(F.col("block_type") == kind)
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), of("table").alias("tables"), of("heading").alias("headings"), of("caption").alias("captions"), F.sum(F.length("text")).alias("chars"))


def profile(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages, characters, and shares of scanned and sparse pages. pages: keys, chars."""
    kind = X.scan_class(F.col("chars"))
    n = F.count("*")
    return pages.groupBy(*keys).agg(n.alias("pages"), F.sum("chars").alias("chars"), (F.count_if(kind == "scanned") / n).alias("scanned_share"), (F.count_if(kind == "sparse") / n).alias("sparse_share"))


def walk(files: DataFrame) -> DataFrame:
    """files (path, length) that a profile looks at, with ``kind``: their ending, or ``none``. Hidden files and all below hidden folders are skipped."""
    path = F.translate(F.col("path"), "\\", "/")
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    return files.where(~path.rlike(r"(^|/)\.[^./]")).withColumn("kind", F.when(ext == "", "none").otherwise(ext))


def worst(pages: DataFrame, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """(files that could not be read, files that mostly need recognition), the first by path and the first by their share of scanned pages. pages: path, chars, error."""
    scanned = F.count_if(X.scan_class(F.col("chars")) == "scanned")
    by = pages.groupBy("path").agg(F.max("error").alias("error"), F.count("*").alias("pages"), (scanned / F.count("*")).alias("scanned_share"))
    return by.where("error IS NOT NULL").orderBy("path").limit(most).select("path", "error"), by.where("error IS NULL AND scanned_share > 0.5").orderBy(F.desc("scanned_share"), F.desc("pages"), "path").limit(most).select("path", "pages", "scanned_share")


def verdict(scanned_share: Column) -> Column:
    """What a share of scanned pages means for reading a corpus."""
    return F.when(scanned_share < 0.05, "text").when(scanned_share < 0.3, "mixed").otherwise("needs recognition")


def image_stats(images: DataFrame) -> DataFrame:
    """Totals of described images. images: cost_usd, tokens_in, tokens_out, cached, values, entity_link, ocr_available, ocr_char_count."""
    return images.agg(F.count("*").alias("described"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.count_if("cached").alias("cached"), F.count_if(F.size("values") > 0).alias("with_values"), F.count_if(F.col("entity_link").isNotNull()).alias("linked"), F.count_if(F.col("ocr_available") & (F.col("ocr_char_count") == 0)).alias("zero_ocr"))


def edge_candidates(chunks: DataFrame, vertices: DataFrame) -> DataFrame:
    """chunk_id, text, tier, entity_ids: passages of weaker sources that name two entities or more."""
    from veritide.operators import graph

    rows = chunks.where(F.col("authority_tier").isin(EDGE_TIERS) & ~F.col("source_type").isin(IMAGE_SOURCES))
    named = graph.mentions(rows, vertices, "text", "chunk_id").groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entity_ids"))
    return rows.join(named.where(F.size("entity_ids") >= EDGE_NAMES), "chunk_id").select("chunk_id", "text", F.col("authority_tier").alias("tier"), "entity_ids")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _paragraph(p: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in p.iter(f"{_W}t"))


def docx_rows(content: bytes) -> list[tuple[str, str]]:
    """(style, text) of paragraphs and (table, markdown) of tables in a word-processor document, in their order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for child in body if body is not None else []:
        if child.tag == f"{_W}p":
            style = child.find(f"{_W}pPr/{_W}pStyle")
            out.append((style.get(f"{_W}val", "") if style is not None else "", _paragraph(child).strip()))
        elif child.tag == f"{_W}tbl":
            rows = [[" ".join(_paragraph(p) for p in c.iter(f"{_W}p")).strip() for c in r.iter(f"{_W}tc")] for r in child.iter(f"{_W}tr")]
            rows = [r for r in rows if r]
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            out.append(("table", "\n".join([lines[0], "|" + "---|" * width, *lines[1:]]) if lines else ""))
    return out


def docx_blocks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, files that do not parse). files: doc_id, content. Headings by style; runs of paragraphs between them are one block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                try:
                    items = docx_rows(r.content)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    out.append((r.doc_id, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
                    continue
                section, held, ord_ = [], [], 0

                def add(kind: str, text: str, path: list[str], doc: str = r.doc_id) -> None:
                    nonlocal ord_
                    out.append((doc, ord_, kind, text, path, None))
                    ord_ += 1

                for style, text in [*items, ("end", "")]:
                    level = 0 if style == "Title" else int(style[-1]) if style.startswith("Heading") and style[-1:].isdigit() else None
                    if held and (style in ("table", "end") or (level is not None and text)):
                        add("text", "\n\n".join(held), list(section))
                        held = []
                    if not text:
                        continue
                    if level is not None:
                        section = [*section[:level], text]
                        add("heading", text, list(section))
                    elif style == "table":
                        add("table", text, list(section))
                    else:
                        held.append(text)
            yield pd.DataFrame(out, columns=["doc_id", "ord", "block_type", "text", "section_path", "error"])

    parsed = files.select("doc_id", "content").mapInPandas(run, "doc_id string, ord int, block_type string, text string, section_path array<string>, error string")
    blocks = parsed.where("error IS NULL").drop("error").withColumn("block_type", F.when((F.col("block_type") == "text") & X.is_caption(F.col("text")), "caption").otherwise(F.col("block_type")))
    return blocks, parsed.where("error IS NOT NULL").select("doc_id", "error")


#: Fixed: the longest heading told by its size, the longest told by its weight, the marks that end no heading.
SIZED_CHARS, BOLD_CHARS, END_MARKS = 200, 80, r"[.,;:!?]\s*$"


def span_lines(spans: DataFrame) -> DataFrame:
    """doc_id, page, line, text, size, bold, box: the lines of a page from its text spans (doc_id, page, line, at, text, size, bold, x0, y0, x1, y1).

    A line is as large as its largest span, bold if all of them are, and its box holds them all; blank spans say nothing.
    """
    said = spans.where(F.trim("text") != "")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    box = F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1"))
    return said.groupBy("doc_id", "page", "line").agg(F.trim(text).alias("text"), F.max(F.round("size", 1)).alias("size"), F.bool_and("bold").alias("bold"), box.alias("box"))


def pdf_blocks(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks: doc_id, ord, page, block_type, text, section_path, bbox; pages without a text layer: doc_id, page) from text spans.

    A heading is a line of a heading's size, or a short bold one without an end mark; the lines between headings, page by page, are one
    paragraph with a box around all of them. A sized heading's depth is how many larger ones were seen, a bold one goes one below.
    """
    sizes = tables.heading_sizes(spans.withColumn("size", F.round("size", 1))).select(F.col("doc_id").alias("_d"), F.col("size").alias("_s"))
    lines = span_lines(spans)
    pages = spans.groupBy("doc_id", "page").agg(F.lit(1)).select("doc_id", "page").join(lines.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("chars")), ["doc_id", "page"], "left")
    scanned = pages.where(X.scan_class(F.coalesce("chars", F.lit(0))) == "scanned").select("doc_id", "page")
    told = lines.join(scanned, ["doc_id", "page"], "left_anti").join(sizes, (F.col("doc_id") == F.col("_d")) & (F.col("size") == F.col("_s")), "left")
    sized = F.col("_s").isNotNull() & (F.length("text") < SIZED_CHARS)
    heading = sized | (F.col("bold") & (F.length("text") <= BOLD_CHARS) & ~F.col("text").rlike(END_MARKS))
    w = Window.partitionBy("doc_id").orderBy("page", "line")
    told = told.withColumn("sized", sized).withColumn("heading", heading)
    new = F.col("heading") | F.coalesce(F.lag("heading").over(w), F.lit(True)) | (F.lag("page").over(w) != F.col("page"))
    told = told.withColumn("block", F.sum(F.when(new, 1).otherwise(0)).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    side = lambda f, k: f(F.get("box", F.lit(k)))
    blocks = told.groupBy("doc_id", "block").agg(F.min("page").alias("page"), F.bool_or("heading").alias("heading"), F.bool_or("sized").alias("sized"), F.max("size").alias("size"), body.alias("text"), F.array(side(F.min, 0), side(F.min, 1), side(F.max, 2), side(F.max, 3)).alias("bbox"))
    so_far = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    heads = F.collect_list(F.when(F.col("heading"), F.struct("sized", "size", "text"))).over(so_far)

    def step(acc: Column, h: Column) -> Column:
        seen = F.when(h["sized"], F.array_distinct(F.concat(acc["seen"], F.array(h["size"])))).otherwise(acc["seen"])
        level = F.when(h["sized"], F.size(F.filter(seen, lambda x: x > h["size"]))).otherwise(F.size(acc["path"]))
        return F.struct(seen.alias("seen"), F.concat(F.slice(acc["path"], F.lit(1), level), F.array(h["text"])).alias("path"))

    start = F.struct(F.array().cast("array<double>").alias("seen"), F.array().cast("array<string>").alias("path"))
    path = F.aggregate(heads, start, step, lambda a: a["path"])
    kind = F.when(F.col("heading"), "heading").when(X.is_caption(F.col("text")), "caption").otherwise("text")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("block")) - 1
    return blocks.select("doc_id", order.alias("ord"), "page", kind.alias("block_type"), "text", path.alias("section_path"), "bbox"), scanned


def described(images: DataFrame, records: DataFrame, key: str = "checksum") -> tuple[DataFrame, DataFrame]:
    """(images with what a model recorded of equal bytes, images that none was recorded of). records: key and the model's fields, the last of a key counts."""
    last = records.groupBy(key).agg(F.max_by(F.struct(*(c for c in records.columns if c != key)), "recorded_at").alias("_r"))
    return images.join(last, key).select(*images.columns, "_r.*"), images.join(last, key, "left_anti")


def run(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, files set aside, counters a document) of files (path, text, content), each by the scan that its ending and head ask for.

    text: what the file holds if it is plain, content: its bytes. A file that no scan reads or that does not parse is set aside.
    """
    from veritide.operators import chunking

    named = files.withColumn("doc_id", X.document_id(F.col("path"))).withColumn("reader", reader_for(F.col("path"), F.col("text")))
    read = {"markdown": chunking.markdown_blocks, "text": chunking.text_blocks}
    parts = [scan(named.where(F.col("reader") == kind)) for kind, scan in read.items()]
    pages, dead = docx_blocks(named.where("reader = 'docx'"))
    columns = ["doc_id", "ord", "block_type", "text", "section_path"]
    blocks = parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(pages.select(columns))
    unread = named.where("reader IS NULL OR reader = 'pdf'").select("path", F.when(F.col("reader").isNull(), "no scan reads it").otherwise("needs a parser outside the library").alias("error"))
    broken = dead.join(named.where("reader = 'docx'").select("doc_id", "path"), "doc_id").select("path", "error")
    return blocks, unread.unionByName(broken), block_counts(blocks)
