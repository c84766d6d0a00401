"""Readers of references, contents, glossaries, indexes and imprints: one text in, fields out, as Arrow functions."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_YEAR = re.compile(r"\(?\b(1[5-9]\d\d|20\d\d)([a-z])?\b\)?")
_PAGES = re.compile(r"(?:pp?\.\s*)?(\d{1,5})\s*[–-]\s*(\d{1,5})")
_DOI = re.compile(r"10\.\d{4,9}/[^\s<>]+")


def parse_reference(text: str | None) -> dict | None:
    """The spans of a reference: authors, year, title, source, volume, issue, pages, doi, publisher, place; None if no
    year tells authors from title. Author-year and numbered styles are read; what is not understood is no field."""
    if not text:
        return None
    body = re.sub(r"^\s*(?:\[\d+\]|\d+[.)])\s*", "", text).strip()
    m = _YEAR.search(body)
    if not m:
        return None
    out: dict[str, str] = {"year": m.group(1) + (m.group(2) or "")}
    if d := _DOI.search(body):
        out["doi"] = d.group().rstrip(".,;)")
        body = body[: d.start()].rstrip(" .;") + "."
    before, after = body[: m.start()].strip(" .,;("), body[m.end() :].strip(" .,;:)")
    if m.start() > len(body) * 0.55 and ". " in before:
        # numbered style: authors. title. source year;volume(issue):pages
        pieces = re.split(r"\.\s+", before)
        out["authors"] = pieces[0].strip(" .")
        if len(pieces) > 1:
            out["title"] = pieces[1].strip(" .")
        if len(pieces) > 2:
            out["source"] = pieces[2].strip(" .;,")
        v = re.match(r"(\d+)(?:\((\d+)\))?\s*:?\s*(\d+\s*[–-]\s*\d+)?", after)
        if v:
            out |= {k: x for k, x in zip(("volume", "issue", "pages"), v.groups()) if x}
        return out
    if before:
        out["authors"] = before
    if p := _PAGES.search(after):
        out["pages"] = f"{p.group(1)}–{p.group(2)}"
        after = after[: p.start()].rstrip(" ,:(") + after[p.end() :]
    pieces = [x.strip(" .,") for x in re.split(r"(?<=[^A-Z\s])\.\s+", after) if x.strip(" .,")]
    if pieces:
        out["title"] = pieces[0]
    if len(pieces) > 1:
        rest = pieces[1]
        if v := re.search(r",?\s*(?:vol\.\s*)?(\d+)\s*(?:\((\d+)\))?\s*$", rest):
            out["volume"] = v.group(1)
            if v.group(2):
                out["issue"] = v.group(2)
            rest = rest[: v.start()]
        place = re.match(r"([^:]+):\s*(.+)$", rest)
        if place:
            out |= {"place": place.group(1).strip(), "publisher": place.group(2).strip()}
        else:
            out["source"] = rest.strip(" ,")
    return out


def parse_contents_line(text: str | None) -> dict | None:
    """label, title and folio of a line of a contents page; None without a folio at its end."""
    m = re.match(r"^\s*((?:(?:Chapter|Part|Appendix)\s+)?(?:\d+(?:\.\d+)*|[IVXLC]+|[A-Z])[.:]?\s+)?(\S.*?)(?:\s*[.·…]{2,}\s*|\s{2,}|\t|\s)(\d{1,4}|[ivxlc]{1,8})\s*$", text or "")
    if not m:
        return None
    label = (m.group(1) or "").strip(" .:")
    return {"label": label, "title": m.group(2).strip(), "folio": m.group(3), "level": str(label.count(".") + 1)}


def parse_glossary_line(text: str | None) -> dict | None:
    """term and definition: "Term: definition" or "Term – definition", a term of six words at most."""
    m = re.match(r"^\s*([^:–—]{2,60}?)\s*(?::|\s[–—]\s)\s*(\S.+)$", text or "", re.S)
    return {"term": m.group(1), "definition": m.group(2).strip()} if m and len(m.group(1).split()) <= 6 else None


def parse_index_line(text: str | None) -> dict | None:
    """term, locators, see and see also of a line of a back-of-book index."""
    m = re.match(r"^\s*(.+?)\s*(?:,\s*((?:\d+(?:[–-]\d+)?)(?:\s*,\s*\d+(?:[–-]\d+)?)*))?\s*(?:\.\s*)?(?:[.,]?\s*(see also|see)\s+(.+?))?\s*\.?\s*$", text or "", re.I)
    if not m or not (m.group(2) or m.group(4)):
        return None
    out = {"term": m.group(1).rstrip(" ,.")}
    if m.group(2):
        out["locators"] = re.sub(r"\s+", "", m.group(2))
    if m.group(4):
        out["see_also" if m.group(3).lower() == "see also" else "see"] = m.group(4)
    return out


def parse_imprint(text: str | None) -> dict | None:
    """isbn, publisher, place, year and edition of an imprint; None if there is none of them."""
    t, out = text or "", {}
    if m := re.search(r"ISBN(?:-1[03])?:?\s*([\dXx][\dXx -]{8,16}[\dXx])", t):
        out["isbn"] = re.sub(r"[ -]", "", m.group(1)).upper()
    if m := re.search(r"(?:©|\(c\)|Copyright)\s*(\d{4})", t, re.I):
        out["year"] = m.group(1)
    if m := re.search(r"\b(\w+)\s+edition\b", t, re.I):
        out["edition"] = m.group(1).lower()
    if m := re.search(r"(?:Published by|Publisher:)\s+([^,.\n]+)(?:,\s*([^,.\n]+))?", t):
        out["publisher"] = m.group(1).strip()
        if m.group(2):
            out["place"] = m.group(2).strip()
    return out or None


def parsed(df: DataFrame, column: str, parser: Callable[[str | None], dict | None], name: str = "fields") -> DataFrame:
    """Adds the parser's fields as a map; null where it understands nothing."""

    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: parser(t if isinstance(t, str) else None))

    return df.withColumn(name, F.pandas_udf(run, "map<string,string>")(F.col(column)))


def line_diff(a: str | None, b: str | None, moved_from: int = 4) -> dict[str, int]:
    """How two texts differ by lines: equal, added, removed, and moved for lines of enough words that left one place and
    came at another."""
    x, y = (a or "").split("\n"), (b or "").split("\n")
    ops = difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
    gone = [line for tag, i, j, _, _ in ops if tag in ("replace", "delete") for line in x[i:j]]
    come = [line for tag, _, _, i, j in ops if tag in ("replace", "insert") for line in y[i:j]]
    moved = 0
    left = {}
    for line in come:
        left[line] = left.get(line, 0) + 1
    for line in gone:
        if len(line.split()) >= moved_from and left.get(line):
            left[line] -= 1
            moved += 1
    return {"equal": sum(j - i for tag, i, j, _, _ in ops if tag == "equal"), "removed": len(gone) - moved, "added": len(come) - moved, "moved": moved}


def diffs(pairs: DataFrame) -> DataFrame:
    """``a, b, equal, removed, added, moved`` of pairs with text_a and text_b."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((k, pa.int64()) for k in ("equal", "removed", "added", "moved"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, j, *line_diff(x, y).values()) for i, j, x, y in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows) if rows else [[]] * 6)], schema=schema)

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, equal bigint, removed bigint, added bigint, moved bigint")


def similarity(a: str | None, b: str | None) -> float:
    """Twice the matching characters over all characters; 1 for two empty texts."""
    return difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()
