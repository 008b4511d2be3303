"""Column functions over text: normal forms, tokens, provenance rules. All run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: index tokens, captions, headings, sentence ends.
TOKEN = r"[a-z0-9]+(?:[-'][a-z0-9]+)*"
CAPTION = r"(?i)^\s*(fig(?:ure)?\.?|plate|table)\s+([ivxlc]+|\d+)\b"
HEADING = r"^(#{1,6})\s+(.*)$"
TABLE_ROW = r"^\s*\|.*\|\s*$"
IMAGE_ONLY = r"^\s*!\[[^\]]*\]\([^)]+\)\s*$"
SENTENCE_END = "(?<=[.!?])[\"'”’]?\\s+"
#: Fixed: what counts as saying that there is no value.
ABSENCES = ["none recorded", "none", "no attunement cost", "not recorded", "unrecorded", ""]
#: Fixed: files that are not part of an archive.
NOT_CORPUS = ["sample_questions.json", "readme.txt"]
#: Fixed: one-to-one dash and quote folding.
FOLD_FROM, FOLD_TO = "‑–—‐’‘“”", "----''\"\""


def tokens(text: Column) -> Column:
    """Lower-case ASCII index tokens; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def clean(text: Column) -> Column:
    """One kind of line end, single spaces, at most one blank line, no space at line or text ends."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t]+", " ")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    out = F.regexp_replace(out, "(?m)[ \t]+$", "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def checksum(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.char_length(text) / 4)).cast("int")


def is_caption(text: Column) -> Column:
    return F.trim(text).rlike(CAPTION)


def words(text: Column) -> Column:
    """Lower-case letters and digits, anything else as single spaces: the alphabet of entity ids."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fold_quotes(text: Column) -> Column:
    return F.translate(text, FOLD_FROM, FOLD_TO)


def path_normal(path: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(path), "\\", "/"), r"^[./]+", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def is_corpus_file(path: Column) -> Column:
    return ~base_name(path_normal(path)).isin(NOT_CORPUS)


def authority(path: Column) -> Column:
    """struct(tier, reason) by where a file lies in the archive. First rule that fits."""
    p = path_normal(path)
    name = base_name(p)
    rules = [
        (p.startswith("codex/") | p.startswith("images/") | p.contains("/plate_") | name.startswith("plate_"), 1, "codex / official figure plate"),
        (p.startswith("wiki/"), 2, "fan-wiki article"),
        (p.startswith("chronicles/"), 3, "narrative novel"),
        (p.startswith("ephemera/") & (name.startswith("ballad") | name.startswith("sermon")), 5, "folkloric / homiletic - unreliable narrator"),
        (p.startswith("ephemera/"), 4, "in-world primary record"),
    ]
    tier, why = F.lit(4), F.lit("unknown provenance - flag for review")
    for test, t, w in reversed(rules):
        tier, why = F.when(test, t).otherwise(tier), F.when(test, w).otherwise(why)
    return F.struct(tier.alias("tier"), why.alias("reason"))


def source_type(path: Column) -> Column:
    p = path_normal(path)
    name = base_name(p)
    stem = F.split_part(name, F.lit("_concerning_"), F.lit(1))
    return (
        F.when(name.startswith("plate_"), "figure_plate")
        .when(p.startswith("codex/"), "codex")
        .when(p.startswith("images/"), "figure_plate")
        .when(p.startswith("wiki/") & p.contains("/images/"), "wiki_image")
        .when(p.startswith("wiki/"), "wiki")
        .when(p.startswith("chronicles/"), "novel")
        .when(p.startswith("ephemera/"), F.when(stem == "", "ephemera").otherwise(stem))
        .otherwise("unknown")
    )


def document_id(path: Column) -> Column:
    """File name without its last extension and a scan mark, spaces as underscores."""
    stem = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
    return F.translate(F.regexp_replace(stem, r"\.scan$", ""), " ", "_")


def is_scan(path: Column) -> Column:
    return F.lower(base_name(path)).contains(".scan.")


def doc_slug(reference: Column) -> Column:
    """The name that a document has in an index, from a path to it."""
    return F.regexp_replace(F.regexp_extract(F.translate(reference, "\\", "/"), r"([^/]*)$", 1), r"\.[^.]*$", "")


def looks_like_markdown(text: Column) -> Column:
    return F.substring(text, 1, 4000).rlike(r"(?m)^#{1,6}\s+\S|^\s*\|.*\|\s*$")


def scan_class(chars: Column) -> Column:
    """Pages by how much text they hold."""
    return F.when(chars < 50, "scanned").when(chars < 200, "sparse").otherwise("digital")


def title_of(section_path: Column, doc_id: Column) -> Column:
    return F.when(F.size(section_path) > 0, F.concat_ws(" > ", section_path)).otherwise(F.translate(doc_id, "_", " "))


def entity_id(name: Column) -> Column:
    """A slug: wiki marks and a leading article dropped, everything but letters and digits one underscore."""
    plain = F.trim(F.translate(F.regexp_replace(name, r"\[\[([^\]]+)\]\]", "$1"), "*", ""))
    bare = F.trim(F.regexp_replace(plain, r"(?i)^(the|a|an)\s+", ""))
    return F.concat(F.lit("ent_"), F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "_"), "^_+|_+$", ""))


def value_normal(raw: Column) -> Column:
    """Values by meaning: no marks or thousands separators, years as ``N AS``, a number without its unit, else lower case."""
    v = F.regexp_replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), r"^[*_ ]+|[*_ ]+$", "")
    v = F.regexp_replace(F.regexp_replace(v, ",", ""), r"\s+", " ")
    year = v.rlike(r"(?i)^\d+\s*AS$")
    united = v.rlike(r"(?i)^\d+\s*[a-z-]+$")
    return F.when(year, F.trim(F.regexp_replace(F.upper(v), r"\s*AS", " AS"))).when(united, F.regexp_extract(v, r"^(\d+)", 1)).otherwise(F.lower(v))


def is_absence(value: Column) -> Column:
    return value_normal(value).isin(ABSENCES)


def rows_to_markdown(rows: Column) -> Column:
    """array<array<string>> as a markdown table, short rows padded; empty for no rows."""
    tidy = F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: F.transform(r, lambda c: F.translate(F.trim(F.coalesce(c, F.lit(""))), "\n", " ")))
    width = F.array_max(F.transform(tidy, F.size))
    padded = F.transform(tidy, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    lines = F.transform(padded, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---|"), width), ""))
    return F.when(F.size(tidy) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 1))), "\n"))


def searchable(caption: Column, subject: Column, description: Column, values: Column, visible: Column) -> Column:
    """What an image is found by: its texts and ``label: value`` lines, empty ones left out."""
    rows = F.transform(values, lambda v: F.concat(F.lit("  "), v["label"], F.lit(": "), v["value"]))
    return F.array_join(F.filter(F.concat(F.array(caption, subject, description), rows, F.array(visible)), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n")


def cache_key(model: Column, prompt: Column, payload: Column) -> Column:
    return F.sha2(F.concat(model, F.lit("\u0000"), prompt, F.lit("\u0000"), payload), 256)


def citation_id(chunk_id: Column, excerpt: Column) -> Column:
    return F.concat(F.lit("cite_"), F.substring(F.sha2(F.concat(chunk_id, F.lit("\u0000"), excerpt), 256), 1, 16))


def point_id(namespace: bytes, key: Column) -> Column:
    """A name-based UUID (version 5): SHA-1 with version and variant bits set."""
    h = F.sha1(F.concat(F.lit(namespace), key.cast("binary")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def iso_time(ts: Column) -> Column:
    """A UTC time as text, to the second, with its offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def elapsed_ms(begin: Column, end: Column) -> Column:
    """Whole milliseconds from one time to another."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))) / 1000)


def canonical_json(pairs: Column) -> Column:
    """A map as JSON with its keys in order, so that equal maps are equal texts."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def unfenced(text: Column) -> Column:
    """What stands in the first code fence of a text, or the text itself: models wrap JSON in fences."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(F.trim(text))
