"""Entries of a contents list and the headings that they name (JN-20)."""

from __future__ import annotations

import difflib
import json
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import nested
from quire.session import cut

_LABEL = r"(?:(?:chapter|ch\.|part|section|unit|module|lesson|box|appendix|annexe|anhang|anexo|kapitel)\s*)"
_SPLIT = re.compile(rf"\s*(?:{_LABEL}(?:\d+(?:\.\d+)*|[a-z]|[ivxlc]+)\b[.:]?|\d{{1,3}}(?:\.\d{{1,3}})*[.:)]?(?=\s)|[a-z][.:)](?=\s)|[ivxlc]{{1,6}}\.(?=\s))\s*", re.I)
_LABEL_ONLY = re.compile(rf"\s*(?:{_LABEL}(?:\d+(?:\.\d+)*|[a-z]|[ivxlc]+)\s*[.:]?|\d{{1,3}})\s*", re.I)
#: Headings that a title may be printed over; pages before and after the entry's that a heading may be on.
LINES, BEFORE, AFTER = 3, 1, 2
#: Share of equal letters from which titles are alike; contents records of one document in a task.
ALIKE, RECORDS = 0.85, 100


def _despaced(text: str) -> str:
    t = " ".join(text.split())
    return t.replace(" ", "") if re.fullmatch(r"(?:\S ){2,}\S", t) else t


def title_key(text: str) -> str:
    """Letters and digits only, in lower case."""
    return re.sub(r"[\W_]+", "", _despaced(text).lower())


def close(w: str, g: str) -> bool:
    """Whether two keys of titles are alike: one begins the other, or few letters differ."""
    return min(len(w), len(g)) >= 6 and (w.startswith(g) or g.startswith(w) or (len(w) >= 8 and difflib.SequenceMatcher(None, w, g).ratio() >= ALIKE))


def title_score(want: set[str], got: set[str], fuzzy: bool) -> int:
    """2 for the same title; 1 for a close one, where that counts; else 0."""
    return 2 if want & got else int(fuzzy and any(close(w, g) for w in want for g in got))


def _letters(keys: list[str]) -> np.ndarray:
    """How often each letter stands in each key, letters in 64 classes."""
    out = np.zeros((len(keys), 64), dtype=np.int32)
    for row, k in zip(out, keys):
        for c in k:
            row[ord(c) & 63] += 1
    return out


class Titles:
    """The headings of a document, found by page and by title."""

    def __init__(self, found: list[tuple[int, int, list[set[str]]]]):
        self.found = found
        self.pages = [f[0] for f in found]
        self.at: dict[str, list[int]] = {}
        for j, (_, _, ways) in enumerate(found):
            for k in set().union(*ways):
                self.at.setdefault(k, []).append(j)
        self.keys = sorted(self.at)
        self.letters, self.lengths = _letters(self.keys), np.array([len(k) for k in self.keys])
        self.known: dict[str, list[int]] = {}

    def alike(self, w: str) -> list[int]:
        """The headings with a title like ``w``, in order. Only keys that share enough letters can be alike; those that
        one begins are tried as well."""
        if w not in self.known:
            common = np.minimum(self.letters, _letters([w])).sum(axis=1)
            may = (2 * common >= ALIKE * (self.lengths + len(w)) - 1e-9) | (common >= np.minimum(self.lengths, len(w)))
            self.known[w] = sorted({j for i in np.flatnonzero(may) if w == self.keys[i] or close(w, self.keys[i]) for j in self.at[self.keys[i]]})
        return self.known[w]

    def first(self, want: set[str], cursor: int, page: int | None, near: bool) -> tuple[int, int] | None:
        """(heading, of how many headings less one its title is) of the first that fits from the cursor on."""
        lists = [self.alike(w) if near else self.at.get(w, []) for w in want]
        low = cursor if not near or page is None else max(cursor, bisect_left(self.pages, page - BEFORE))
        high = len(self.found) if not near or page is None else bisect_right(self.pages, page + AFTER)
        j = min((own[i] for own in lists if (i := bisect_left(own, low)) < len(own)), default=high)
        if j >= high:
            return None
        return j, max((title_score(want, keys, near), n) for n, keys in enumerate(self.found[j][2]))[1]


def starts(headings: list[tuple[int, int, int, str]]) -> list[tuple[int, int, list[set[str]]]]:
    """(page, block_id, the keys of its title by how many headings it is printed over) of each heading of a document.

    ``headings`` are (place in the document, page, block_id, text) in order; only headings at neighbouring places are
    one title. A label alone belongs to the heading after it on its page.
    """
    out = []
    for j, (_, page, block, text) in enumerate(headings):
        beside = lambda k: k < len(headings) and headings[k][0] - headings[j][0] == k - j  # noqa: B023, E731
        alone = bool(_LABEL_ONLY.fullmatch(_despaced(text))) and beside(j + 1) and headings[j + 1][1] == page
        first, label = j + alone, text if alone else ""
        joined, ways = "", [set()] * alone
        for k in range(first, first + LINES):
            if not beside(k) or (k > first and _LABEL_ONLY.fullmatch(_despaced(headings[k][3]))):
                break
            joined = f"{joined} {headings[k][3]}".strip()
            m = _SPLIT.match(joined)
            ways.append({title_key(joined), title_key(joined[m.end() :] if m else joined), title_key(f"{label} {joined}")} - {""})
        out.append((page, block, ways))
    return out


def matched(entries: list[tuple[str, str, str | None, int | None]], titles: Titles) -> list[tuple[str, int, str]]:
    """(entry, block_id, how) of the entries of one list, in their order: ``page`` if a heading after the cursor, on the
    entry's pages, has a close title (an entry without page may have it on any), ``title`` if one anywhere after the
    cursor has the same title. The cursor then stands after that heading; an entry that names none leaves it."""
    cursor, out = 0, []
    for entry, title, label, page in entries:
        want = {title_key(title), title_key(f"{label or ''} {title}")} if title_key(title) else set()
        for near in (True, False) if want and page is not None else (True,) if want else ():
            if hit := titles.first(want, cursor, page, near):
                out.append((entry, titles.found[hit[0]][1], "page" if near else "title"))
                cursor = hit[0] + hit[1] + 1
                break
    return out


def entries_of(payload: str) -> list[tuple[str, str, str | None, int | None]]:
    """(node_path, title, label, page) of all entries of a record, in document order."""
    found: dict[str, dict] = {}
    for kind, path, _, _, field, value in nested.triples("toc", payload):
        if kind == "toc_entry":
            node = found.setdefault(path, {})
            if field:
                node[field] = value
    out = []
    for path, node in found.items():
        title = node.get("title") or ""
        if title.lstrip()[:1] in ("[", "{"):
            try:
                runs = json.loads(title)
                title = "".join(str(r.get("text") or "") if isinstance(r, dict) else str(r or "") for r in (runs if isinstance(runs, list) else [runs]))
            except ValueError:
                pass
        page = (node.get("page") or "").strip()
        out.append((path, title, node.get("label"), int(page) if re.fullmatch(r"\d{1,9}", page) else None))
    return out


def headings_named(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rec_id, node_path, block_id, how``: the heading of its own document that each contents entry names.

    ``page`` of an entry is where it says it begins. The cursor makes a list sequential, so a task holds one document's
    headings and some of its contents records, and no other block.
    """
    toc = records.where(F.col("kind") == "toc").withColumn("kind", F.struct("kind", "doc_id"))  # the delivery's own document
    r = nested.latest_readable(toc).select("rec_id", "kind.doc_id", "payload").where(F.col("doc_id").isNotNull())
    r = cut(r)
    parts = r.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / RECORDS).alias("parts"))
    r = r.join(parts, "doc_id").select("rec_id", "doc_id", "payload", F.pmod(F.xxhash64("rec_id"), "parts").alias("part"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "ord", "block_id"))
    h = blocks.select("doc_id", "page", "block_id", "kind", "text", "ord").withColumn("place", place).where((F.col("kind") == "heading") & F.col("text").isNotNull()).select("doc_id", "place", "page", "block_id", "text")
    h = h.join(r.select("doc_id", F.col("part").alias("of")).distinct(), "doc_id")
    schema = pa.schema([("rec_id", pa.int64()), ("node_path", pa.string()), ("block_id", pa.int64()), ("how", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        titles = Titles(starts(sorted(zip(*(right.column(c).to_pylist() for c in ("place", "page", "block_id", "text"))))))
        rows = [(rec, *m) for rec, payload in zip(left.column("rec_id").to_pylist(), left.column("payload").to_pylist()) if titles.found for m in matched(entries_of(payload), titles)]
        return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

    return r.groupBy("doc_id", "part").cogroup(h.groupBy("doc_id", "of")).applyInArrow(run, "rec_id bigint, node_path string, block_id bigint, how string")
