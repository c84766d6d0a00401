"""Units of a book, titles, and links in running text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words for the numbers of chapters.
NUMBER_WORDS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), 1)}


def unit_kind(heading: Column) -> Column:
    """chapter, appendix, part or null by how a heading begins."""
    t = F.trim(heading)
    return F.when(t.rlike(r"(?iu)^(chapter|ch\.|kapitel|глава|capítulo|chapitre)\s") | t.rlike(r"^第\s*[0-9]+\s*章"), "chapter").when(t.rlike(r"(?iu)^(appendix|annexe|anhang|anexo)\b"), "appendix").when(t.rlike(r"(?iu)^(part|teil|partie|parte)\s"), "part").when(t.rlike(r"(?iu)^[0-9]+\.?\s+kapitel"), "chapter")


def label_number(heading: Column) -> Column:
    """The number in a unit's label, as digits or a word; null without."""
    digits = F.regexp_extract(heading, r"([0-9]+)", 1)
    word = F.lower(F.regexp_extract(heading, r"(?i)^\s*(?:chapter|part)\s+([a-z]+)", 1))
    m = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    return F.coalesce(F.when(digits != "", digits.try_cast("int")), F.try_element_at(m, word))


def units(headings: DataFrame) -> DataFrame:
    """``doc_id, unit, kind, number, first_page, last_page``: units from where they begin to before the next; several on one
    page count as the first. A chapter without number gets that of the one before plus one. Headings have doc_id, page,
    ord, block_id and text; the windows run over units of a document, not over its blocks."""
    h = headings.withColumn("kind", unit_kind(F.col("text"))).where(F.col("kind").isNotNull())
    first = h.groupBy("doc_id", "page").agg(F.min(F.struct("ord", "block_id", "kind", label_number(F.col("text")).alias("number"))).alias("u"))
    w = Window.partitionBy("doc_id").orderBy("page")
    d = first.select("doc_id", F.col("page").alias("first_page"), "u.kind", "u.number", F.row_number().over(w).alias("unit"), (F.lead("page").over(w) - 1).alias("last_page"))
    before = F.lag("number").over(Window.partitionBy("doc_id").orderBy("first_page"))
    return d.withColumn("number", F.coalesce("number", before + 1))


def unit_of(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``key, unit``: the unit whose pages hold a row; null before the first. An as-of join by pages."""
    marks = found.select("doc_id", F.col("first_page").alias("page"), "unit")
    pages = rows.select("doc_id", "page").distinct().join(marks, ["doc_id", "page"], "full")
    at = F.last("unit", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(pages.select("doc_id", "page", at.alias("unit")), ["doc_id", "page"]).select("key", "unit")


def titles(meta: DataFrame, headings: DataFrame) -> DataFrame:
    """``doc_id, title``: the title of the record, else the first heading that is no number."""
    first = headings.where(~F.col("text").rlike(r"^[0-9.\s]*$")).groupBy("doc_id").agg(F.min_by("text", F.struct("page", "ord", "block_id")).alias("_t"))
    m = meta.groupBy("doc_id").agg(F.max("title").alias("title"))
    return m.join(first, "doc_id", "left").select("doc_id", F.coalesce("title", "_t").alias("title"))


def contents_likelihood(lines: DataFrame) -> DataFrame:
    """``doc_id, page, lines, share``: the part of a page's lines that end in a page number."""
    ends = F.col("text").rlike(r"(^|[\s.…])([0-9]{1,4}|[ivxlc]{1,7})\s*$")
    by = lines.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("lines"), F.count_if(ends).alias("e"))
    return by.select("doc_id", "page", "lines", F.round(F.col("e") / F.col("lines"), 6).alias("share"))


_LINKS = [
    ("url", re.compile(r"(?:https?://|www\.)[^\s<>]*[^\s<>.,;:!?)\]]")),
    ("doi", re.compile(r"10\.\d{4,9}/[^\s<>]*[^\s<>.,;)]")),
    ("citation", re.compile(r"\((?:[^()]*?\b)?[A-Z][\w’'-]+(?:\s+(?:et al\.|and|&|und|et)\s*[\w.]*)*,?\s+(?:1[5-9]|20)\d\d[a-z]?(?:\s*[,;][^()]*)?\)")),
    ("narrative", re.compile(r"\b[A-Z][\w’'-]+(?:\s+et al\.)?\s+\((?:1[5-9]|20)\d\d[a-z]?\)")),
    ("numeric", re.compile(r"\[\d{1,3}(?:\s*[,–-]\s*\d{1,3})*\]")),
    ("callout", re.compile(r"\b(?:Fig|Figs|Figure|Table|Tab|Abb|Rule|Eq)\.?\s*\d+(?:\.\d+)*[A-Za-z]?\b")),
]


def find_links(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, text) of the links in a text: kinds in order of priority, no two overlap."""
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text or ""))
    for kind, pattern in _LINKS:
        for m in pattern.finditer(text or ""):
            if not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                found.append((m.start(), m.end(), kind, m.group()))
    return sorted(found)


def links(texts: DataFrame) -> DataFrame:
    """``key, start_char, end_char, kind, link`` of texts with key and text."""
    schema = pa.schema([("key", pa.int64()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("kind", pa.string()), ("link", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, *x) for k, t in zip(*(c.to_pylist() for c in b.columns)) for x in find_links(t)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return texts.select("key", "text").mapInArrow(run, "key bigint, start_char int, end_char int, kind string, link string")


def completeness(meta: DataFrame, checks: dict[str, DataFrame]) -> DataFrame:
    """``doc_id, check, failed``: checks (doc_id, failed) of every document in one table; a document that a check says
    nothing of has failed null."""
    docs = meta.select("doc_id").distinct()
    out = None
    for name, c in checks.items():
        one = docs.join(c.groupBy("doc_id").agg(F.bool_or("failed").alias("failed")), "doc_id", "left").select("doc_id", F.lit(name).alias("check"), "failed")
        out = one if out is None else out.unionByName(one)
    return out
