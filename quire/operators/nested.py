"""Flattening of deeply nested JSON records into related tables (problem 5).

Each payload is read once, as a stream of parse events, and comes out as triples of path, field and value with the
position of every node; no tree is built. Paths are grouped by their nearest repeated ancestor: a group is a node kind,
and a group's triples pivot into one flat table whose rows carry ``node_path`` and ``parent_path``.

Defined results: a null, empty or unreadable payload, one whose root is no object and one of an unknown kind have
no rows; null elements are no nodes but keep their position; a lone value where an array is expected counts as
position 0; an array given as JSON text counts as the array; an empty object is a node; of a field given twice in an
object the last counts; values that are objects or arrays come out as they stand in the payload; a null ``rec_id`` is
a key like any other; of several deliveries the latest readable one counts (null ``received_at`` is oldest, ties are
settled by a hash of the payload). Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import spread

#: Node kind of the root, by record kind.
ROOTS = {"toc": "toc_entry", "bibl": "bibl", "export_check": "export_check"}
#: Repeated fields of a node kind, with the kind of their elements.
REPEATED = {
    "toc_entry": {"children": "toc_entry", "contributors": "contributor"},
    "bibl": {"authors": "author", "editors": "editor"},
    "author": {"given": "given"},
    "editor": {"given": "given"},
    "export_check": {"dropped": "dropped", "moved": "moved", "missing": "missing"},
    "missing": {"absent_words": "absent_word"},
}

#: Fields of each node kind that come out as columns of its table.
COLUMNS = {
    "toc_entry": ["title", "label", "folio", "level", "page"], "contributor": ["value"],
    "bibl": ["title_a", "year", "volume", "publisher"], "author": ["surname", "org", "value"], "editor": ["surname", "org", "value"], "given": ["value"],
    "export_check": ["target", "blocks", "missing_chars"], "dropped": ["page", "kind", "text", "reason", "partly"], "moved": ["page", "kind", "text"], "missing": ["page", "kind", "text"], "absent_word": ["value"],
}

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|"([^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*)"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')
_END = re.compile(r"[ \t\n\r]*\Z")


class Unreadable(ValueError):
    """The text is no JSON value."""


def _string(body: str) -> str:
    """The text of a string token; halves of surrogate pairs that stand alone are replaced."""
    if "\\" not in body:
        return body
    text = json.loads(f'"{body}"')
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def events(text: str) -> Iterator[tuple[str, str, int, int]]:
    """The parse events of a JSON text with their places: ``{ } [ ]``, ``key``, ``string`` and ``plain`` (numbers, true,
    false and null as they are written); nesting depth is bounded by memory only."""
    at, stack, want, match = 0, [], "value", _TOKEN.match
    while True:
        m = match(text, at)
        if not m:
            raise Unreadable(at)
        group, at = m.lastindex, m.end()
        if group != 1:
            if want == "value" or want == "first":
                yield "string" if group == 2 else "plain", m.group(group), m.start(group) - (group == 2), at
            elif group == 2 and (want == "key" or want == "firstkey"):
                yield "key", m.group(2), m.start(2), at
                want = "colon"
                continue
            else:
                raise Unreadable(at)
        else:
            mark = m.group(1)
            if mark == ",":
                if want != "more":
                    raise Unreadable(at)
                want = "key" if stack[-1] == "{" else "value"
                continue
            if mark == ":":
                if want != "colon":
                    raise Unreadable(at)
                want = "value"
                continue
            if mark == "{" or mark == "[":
                if want != "value" and want != "first":
                    raise Unreadable(at)
                stack.append(mark)
                want = "firstkey" if mark == "{" else "first"
                yield mark, "", at - 1, at
                continue
            if not stack or stack[-1] != ("{" if mark == "}" else "[") or want not in ("more", "firstkey" if mark == "}" else "first"):
                raise Unreadable(at)
            stack.pop()
            yield mark, "", at - 1, at
        if not stack:
            if not _END.match(text, at):
                raise Unreadable(at)
            return
        want = "more"


Triple = tuple[str, str, str, int, "str | None", "str | None"]


def _stream(text: str, first: tuple, fields: bool, repeated: dict) -> list[Triple | None]:
    """The triples of a JSON text whose value plays the role ``first``: ``("node", kind, path, parent, ordinal)`` or
    ``("many", kind, path, parent)`` for the elements of a repeated field."""
    out: list[Triple | None] = []
    frames: list[list] = []  # of nodes: node, repeated fields, places of the fields' triples; of arrays: role, position
    role: tuple = first
    deep, start = 0, 0  # inside a value that comes out as it stands
    for what, value, at, end in events(text):
        if deep:
            if what == "{" or what == "[":
                deep += 1
            elif what == "}" or what == "]":
                deep -= 1
                if not deep and fields:
                    _field(out, frames, role, text[start:end])
            continue
        if what == "key":
            node, inner, places, last = frames[-1]
            name = _string(value)
            if last is not None:
                places[last] = (places[last][0], len(out))
            if name in places:
                out[slice(*places[name])] = [None] * (places[name][1] - places[name][0])
            places[name] = (len(out), len(out))
            frames[-1][3] = name
            role = ("many", inner[name], f"{node[1]}.{name}", node[1]) if name in inner else ("field", name)
            continue
        if what == "}" or what == "]":
            frames.pop()
            continue
        if frames and len(frames[-1]) == 2:
            (_, kind, path, parent), i = frames[-1]
            role = ("node", kind, f"{path}.{i}", parent, i)
            frames[-1][1] += 1
        if role[0] == "many":
            if what == "[":
                frames.append([role, 0])
                continue
            if what == "string" and value.lstrip()[:1] == "[":
                try:
                    inside = _string(value)
                    out += _stream(inside, role, fields, repeated) if inside.lstrip()[:1] == "[" else []
                    continue
                except Unreadable:
                    pass
            role = ("node", role[1], f"{role[2]}.0", role[3], 0)
        if role[0] == "node" and value != "null" or role[0] == "node" and what == "string":
            node = role[1:]
            out.append((*node, None, None))
            if what == "{":
                frames.append([node, repeated.get(node[0], {}), {}, None])
                continue
        if what == "{" or what == "[":
            deep, start = 1, at
        elif fields and (what == "string" or value != "null"):
            _field(out, frames, role, _string(value) if what == "string" else value)
    return out


def _field(out: list, frames: list, role: tuple, value: str) -> None:
    """The triple of a value: of a field of the node around it, or of a node that is no object."""
    out.append((*role[1:], "value", value) if role[0] == "node" else (*frames[-1][0], role[1], value))


def read(kind: str | None, payload: str | None, fields: bool = True, roots: dict = ROOTS, repeated: dict = REPEATED) -> list[Triple] | None:
    """The triples of one record; None if its payload is no JSON object."""
    if not payload or payload.lstrip(" \t\n\r")[:1] != "{":
        return None
    try:
        if kind not in roots:
            for _ in events(payload):
                pass
            return []
        return [t for t in _stream(payload, ("node", roots[kind], "$", "", 0), fields, repeated) if t is not None]
    except Unreadable:
        return None


def triples(kind: str | None, payload: str | None, fields: bool = True, roots: dict = ROOTS, repeated: dict = REPEATED) -> Iterator[Triple]:
    """(node_kind, node_path, parent_path, ordinal, field, value) of one record.

    The triple whose field is null says that the node exists. A scalar node's own value has the field ``value``.
    """
    return iter(read(kind, payload, fields, roots, repeated) or [])


_NODE = pa.struct([("node_kind", pa.string()), ("node_path", pa.string()), ("parent_path", pa.string()), ("ordinal", pa.int32()), ("field", pa.string()), ("value", pa.string())])
_READ = pa.schema([("rec_id", pa.int64()), ("kind", pa.string()), ("received_at", pa.int64()), ("tie", pa.string()), ("triples", pa.list_(_NODE))])
_READ_DDL = "rec_id bigint, kind string, received_at bigint, tie string, triples array<struct<node_kind: string, node_path: string, parent_path: string, ordinal: int, field: string, value: string>>"


def record_triples(records: DataFrame, fields: bool = True, kinds: list[str] | None = None) -> DataFrame:
    """The triples of the latest readable delivery of each record, of some node kinds only if they are named. Every
    payload is read once, where the table is scanned; what is shuffled are the triples, not the payloads."""
    wanted = set(kinds) if kinds is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                part = batch.slice(at, 500)
                for rec, kind, received, payload in zip(*(c.to_pylist() for c in part.columns)):
                    found = read(kind, payload, fields)
                    if found is not None:
                        own = found if wanted is None else [t for t in found if t[0] in wanted]
                        rows.append((rec, kind, received, hashlib.blake2b(payload.encode("utf-8", "replace"), digest_size=8).hexdigest(), own))
                columns = list(zip(*rows)) if rows else [[]] * 5
                flat = [t for own in columns[4] for t in own]
                ends = [0]
                for own in columns[4]:
                    ends.append(ends[-1] + len(own))
                inner = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*flat) if flat else [[]] * 6, _NODE)], fields=list(_NODE))
                yield pa.RecordBatch.from_arrays([*(pa.array(list(c), f.type) for c, f in zip(columns[:4], _READ)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)], schema=_READ)

    r = records.where(F.col("payload").isNotNull() & (F.col("payload") != "")).select("rec_id", "kind", F.unix_micros(F.col("received_at").cast("timestamp")).alias("received_at"), "payload")
    best = F.max_by(F.struct("kind", "triples"), F.struct("received_at", "tie")).alias("b")
    return spread(r).mapInArrow(run, _READ_DDL).groupBy("rec_id").agg(best).select("rec_id", "b.kind", F.explode("b.triples").alias("t")).select("rec_id", "kind", "t.*")


def latest_readable(records: DataFrame) -> DataFrame:
    """``rec_id, kind, payload`` of the latest readable delivery of each record; ``kind`` may be a struct of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("payload")).to_pylist()
            yield batch.filter(pa.array([read(None, t) is not None for t in texts], pa.bool_()))

    r = records.select("rec_id", "kind", "payload", "received_at").where(F.col("payload").isNotNull() & (F.col("payload") != ""))
    best = F.max_by(F.struct("kind", "payload"), F.struct("received_at", "payload"))
    return r.mapInArrow(run, r.schema).groupBy("rec_id").agg(best.alias("_b")).select("rec_id", "_b.kind", "_b.payload")


def nodes(records: DataFrame) -> DataFrame:
    """One row per node of each record, with its parent."""
    return record_triples(records, fields=False).select("rec_id", "node_kind", "node_path", "parent_path")


def flat_table(found: DataFrame, node_kind: str, columns: list[str] | None = None) -> DataFrame:
    """The table of one group: a row per node of ``node_kind`` and a column per named field (null where absent)."""
    columns = COLUMNS[node_kind] if columns is None else columns
    return (
        found.where(F.col("node_kind") == node_kind)
        .groupBy("rec_id", "node_path", "parent_path", "ordinal")
        .agg(*[F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in columns])
    )


def reasons(found: DataFrame) -> DataFrame:
    """``target, reason, n``: how many dropped nodes of the exports have each reason, ``none`` where they have none."""
    value = lambda c: F.max(F.when(F.col("field") == c, F.col("value"))).alias(c)
    n = found.where(F.col("node_kind").isin("export_check", "dropped")).groupBy("rec_id", "node_kind", "node_path").agg(value("target"), value("reason"))
    root = F.max(F.when(F.col("node_kind") == "export_check", F.col("target"))).alias("target")
    own = F.collect_list(F.when(F.col("node_kind") == "dropped", F.coalesce("reason", F.lit("none")))).alias("own")
    return n.groupBy("rec_id").agg(root, own).select("target", F.explode("own").alias("reason")).groupBy("target", "reason").agg(F.count(F.lit(1)).alias("n"))
