"""Sequential structure of one page or one block group: lines, reading order, list nesting, ink regions. Each runs on
one page at a time, so that no group grows with the collection."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame


def visual_lines(words: DataFrame, guard: float = 0.85) -> DataFrame:
    """``word_id, line``: words of a page in visual lines. A word joins the line whose middle is nearest if it lies
    within half the smaller height and sizes agree by the guard; words smaller than the page's usual size join the line
    they overlap most, or make lines of their own; rotated words come last, each by itself."""

    def clustered(rows: list) -> list[list]:
        lines: list[list] = []  # middle, size, words, top, bottom
        for w in rows:
            middle, height = (w.y0 + w.y1) / 2, w.y1 - w.y0
            best = None
            for i in range(len(lines) - 1, max(-1, len(lines) - 9), -1):
                m, size, _, top, bottom = lines[i]
                if abs(m - middle) <= min(height, bottom - top) / 2 and min(size, w.size) >= guard * max(size, w.size) and (best is None or abs(m - middle) < abs(lines[best][0] - middle)):
                    best = i
            if best is None:
                lines.append([middle, w.size, [w], w.y0, w.y1])
            else:
                lines[best][2].append(w)
        return lines

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y0", "x0", "word_id"])
        upright = page.upright.fillna(True).astype(bool)
        rows = list(page[upright].itertuples())
        usual = page[upright]["size"].mode().min() if rows else 0.0
        out: dict[int, int] = {}
        lines = clustered([w for w in rows if w.size >= guard * usual])
        own = []
        for w in (w for w in rows if w.size < guard * usual):
            over = max(((min(w.y1, b) - max(w.y0, t), -i) for i, (_, _, _, t, b) in enumerate(lines)), default=(0, 0))
            if over[0] > 0:
                lines[-over[1]][2].append(w)
            else:
                own.append(w)
        lines += clustered(own)
        order = sorted(range(len(lines)), key=lambda i: (lines[i][3], min(x.x0 for x in lines[i][2])))
        for n, i in enumerate(order):
            for w in lines[i][2]:
                out[w.word_id] = n
        for n, w in enumerate(page[~upright].itertuples(), len(lines)):
            out[w.word_id] = n
        return pd.DataFrame({"word_id": list(out), "line": list(out.values())}, dtype="int64")

    need = words.where("x0 is not null and y0 is not null and x1 is not null and y1 is not null and size is not null")
    return need.select("doc_id", "page", "word_id", "x0", "y0", "x1", "y1", "size", "upright").groupBy("doc_id", "page").applyInPandas(run, "word_id bigint, line bigint")


def xy_cut(boxes: DataFrame, gap: float = 4.0, depth: int = 40) -> DataFrame:
    """``block_key, position``: reading order of a page's boxes: column gutters first, then row bands; a leaf is read from the top."""

    def split(rows: list, lo: str, hi: str) -> list[list]:
        rows = sorted(rows, key=lambda r: (getattr(r, lo), getattr(r, hi)))
        groups, end = [], None
        for r in rows:
            if end is None or getattr(r, lo) > end + gap:
                groups.append([])
                end = getattr(r, hi)
            groups[-1].append(r)
            end = max(end, getattr(r, hi))
        return groups

    def order(rows: list) -> list:
        # an explicit stack; each part is either cut again or read as it is
        out, todo = [], [(rows, 0)]
        while todo:
            part, level = todo.pop()
            cut = None
            if len(part) > 1 and level < depth:
                for lo, hi in (("x0", "x1"), ("y0", "y1")):
                    groups = split(part, lo, hi)
                    if len(groups) > 1:
                        cut = groups
                        break
            if cut:
                todo += [(g, level + 1) for g in reversed(cut)]
            else:
                out += sorted(part, key=lambda r: (r.y0, r.x0, r.block_key))
        return out

    def run(page: pd.DataFrame) -> pd.DataFrame:
        found = order(list(page.itertuples()))
        return pd.DataFrame({"doc_id": [r.doc_id for r in found], "block_key": [r.block_key for r in found], "position": range(len(found))})

    return boxes.select("doc_id", "page", "block_key", "x0", "y0", "x1", "y1").groupBy("doc_id", "page").applyInPandas(run, "doc_id string, block_key bigint, position bigint")


_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def marker_value(marker: str) -> list[tuple[str, int]]:
    """The kinds and values that a list marker may have; a single i, v or x is a letter as well as a number."""
    bare = re.sub(r"[().]", "", marker).strip()
    wrap = "(" if marker.startswith("(") else ""
    if bare.isdigit():
        return [(wrap + "decimal", int(bare))]
    found = []
    if bare and all(c in _ROMAN for c in bare):
        v = [_ROMAN[c] for c in bare]
        found.append((wrap + "roman", sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))))
    if len(bare) == 1 and bare.isalpha():
        found.append((wrap + "alpha", ord(bare.lower()) - 96))
    return found or [("bullet " + bare, 0)]


def list_nesting(items: DataFrame, step: float = 12.0, column: float = 100.0) -> DataFrame:
    """``block_id, depth, kind``: depth of list items of a page in their order. An item that continues an open list by
    kind and successor closes those below it; another kind opens a list inside; the same bullet is nested by indent; an
    indent beyond a column's width is another column and not a depth. Items have doc_id, page, ord, block_id, marker, x0."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        open_: list[tuple[str, int, float]] = []
        rows = []
        for it in page.sort_values(["ord", "block_id"]).itertuples():
            ways = marker_value(it.marker or "•")
            x = it.x0 if it.x0 == it.x0 and it.x0 is not None else 0.0
            level = None
            for k in range(len(open_) - 1, -1, -1):
                kind, value, left = open_[k]
                fit = next(((w, v) for w, v in ways if w == kind and (w.startswith("bullet") or v == value + 1)), None)
                if fit and (not kind.startswith("bullet") or abs(x - left) < step or abs(x - left) >= column):
                    level, chosen = k, fit
                    break
            if level is None:
                chosen = next((w for w in ways if w[1] in (0, 1)), ways[0])
                same = open_ and open_[-1][0] == chosen[0] and not (step <= x - open_[-1][2] < column)
                level = len(open_) - 1 if same else len(open_)
            open_ = open_[:level] + [(chosen[0], chosen[1], x)]
            rows.append((it.block_id, level + 1, chosen[0]))
        return pd.DataFrame(rows, columns=["block_id", "depth", "kind"])

    return items.select("doc_id", "page", "ord", "block_id", "marker", "x0").groupBy("doc_id", "page").applyInPandas(run, "block_id bigint, depth int, kind string")


def ink_regions(cells: DataFrame) -> DataFrame:
    """``doc_id, page, region, cells, x0, y0, x1, y1, shape``: 8-connected cells of ink as regions: a rule is thin, a filled
    region dense, a frame sparse in the middle. Cells have doc_id, page, x and y (integers)."""

    def run(page: pd.DataFrame) -> pd.DataFrame:
        left = {(int(x), int(y)) for x, y in zip(page.x, page.y)}
        rows = []
        for start in sorted(left, key=lambda c: (c[1], c[0])):
            if start not in left:
                continue
            left.discard(start)
            part, todo = [], [start]
            while todo:
                x, y = todo.pop()
                part.append((x, y))
                for c in ((x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if c in left:
                        left.discard(c)
                        todo.append(c)
            xs, ys = [c[0] for c in part], [c[1] for c in part]
            w, h = max(xs) - min(xs) + 1, max(ys) - min(ys) + 1
            full = len(part) / (w * h)
            shape = "rule" if min(w, h) <= 1 and max(w, h) >= 4 else "filled" if full > 0.8 and w * h >= 9 else "frame" if full < 0.4 and w >= 4 and h >= 4 else "content"
            rows.append((page.doc_id.iloc[0], int(page.page.iloc[0]), len(rows), len(part), min(xs), min(ys), max(xs), max(ys), shape))
        return pd.DataFrame(rows, columns=["doc_id", "page", "region", "cells", "x0", "y0", "x1", "y1", "shape"])

    return cells.select("doc_id", "page", "x", "y").groupBy("doc_id", "page").applyInPandas(run, "doc_id string, page int, region int, cells int, x0 int, y0 int, x1 int, y1 int, shape string")
