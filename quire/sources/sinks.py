"""Outputs: canonical JSON, XML of blocks, content and publishing XML, CSS, HTML, a JSON Schema and EPUB packages.

Each is a projection to text or bytes by block or page, so that no document is gathered in one task; ``write_lines``
and Spark's own writers put them down. EPUB packages hold a bounded number of pages.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.scalars import html_escape, two_decimals

#: Elements of a block kind: canonical, content and publishing XML.
ELEMENTS = {"paragraph": ("p", "para", "p"), "heading": ("h", "title", "title"), "list_item": ("li", "para", "list-item"), "footnote": ("note", "para", "fn"), "caption": ("caption", "para", "caption")}


def canonical_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """``json``: each row as JSON with sorted keys and without nulls."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "true"}).alias("json"))


def read_canonical(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of canonical JSON again; an unreadable line has nulls only."""
    return lines.select(F.from_json("json", schema).alias("r")).select("r.*")


def xml_text(text: Column) -> Column:
    """Escaped text without characters that XML forbids."""
    return html_escape(F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""))


def _element(kind: Column, column: int) -> Column:
    e = F.lit("p")
    for k, names in ELEMENTS.items():
        e = F.when(kind == k, F.lit(names[column])).otherwise(e)
    return e


def block_xml(blocks: DataFrame, form: str = "canonical") -> DataFrame:
    """``doc_id, page, ord, block_id, xml``: an element for each block; only attributes that are there."""
    tag = _element(F.col("kind"), {"canonical": 0, "content": 1, "publishing": 2}[form])
    attributes = F.concat_ws("", F.concat(F.lit(' id="b'), "block_id", F.lit('"')), F.concat(F.lit(' page="'), "page", F.lit('"'))) if form == "canonical" else F.lit("")
    inner = xml_text(F.coalesce("text", F.lit("")))
    inner = F.when(F.col("kind").isin("list_item", "footnote", "caption"), F.concat(F.lit("<p>"), inner, F.lit("</p>"))).otherwise(inner) if form == "publishing" else inner
    return blocks.select("doc_id", "page", "ord", "block_id", F.concat(F.lit("<"), tag, attributes, F.lit(">"), inner, F.lit("</"), tag, F.lit(">")).alias("xml"))


def run_xml(runs: DataFrame) -> DataFrame:
    """``block_id, run_ix, xml``: runs as mixed content: bold, italic, sup and sub around their text."""
    t = xml_text(F.coalesce("text", F.lit("")))
    for c, tag in (("italic", "i"), ("bold", "b"), ("sub", "sub"), ("sup", "sup")):
        t = F.when(F.coalesce(c, F.lit(False)), F.concat(F.lit(f"<{tag}>"), t, F.lit(f"</{tag}>"))).otherwise(t)
    return runs.select("block_id", "run_ix", t.alias("xml"))


def css(catalogue: DataFrame) -> DataFrame:
    """``doc_id, style, rule``: a rule for each style, sizes relative to the body's."""
    body = catalogue.where(F.col("style") == "body").select("doc_id", F.col("size").alias("_body"))
    size = F.when(F.col("_body") > 0, F.concat(F.lit("font-size:"), two_decimals(F.col("size") / F.col("_body")), F.lit("em;")))
    rule = F.concat(F.lit("."), "style", F.lit("{"), F.concat_ws("", F.concat(F.lit("font-family:'"), F.coalesce("family", F.lit("serif")), F.lit("';")), size, F.when(F.col("bold"), F.lit("font-weight:bold;")), F.when(F.col("italic"), F.lit("font-style:italic;"))), F.lit("}"))
    return catalogue.join(body, "doc_id", "left").select("doc_id", "style", rule.alias("rule"))


def html_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """``html``: a table row of each row, for reports."""
    cells = [F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def json_schema(schema: T.StructType, title: str) -> str:
    """A JSON Schema of a table's rows."""

    def of(t: T.DataType) -> dict:
        if isinstance(t, T.StructType):
            return {"type": "object", "additionalProperties": False, "properties": {f.name: of(f.dataType) for f in t.fields}, "required": [f.name for f in t.fields if not f.nullable]}
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": of(t.elementType)}
        if isinstance(t, T.MapType):
            return {"type": "object", "additionalProperties": of(t.valueType)}
        kind = "boolean" if isinstance(t, T.BooleanType) else "integer" if isinstance(t, T.IntegralType) else "number" if isinstance(t, T.NumericType) else "string"
        return {"type": [kind, "null"]}

    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title} | of(schema), sort_keys=True)


#: Pages in one EPUB package.
PAGES = 50


def epub_bytes(key: str, title: str, chapters: list[tuple[str, str]]) -> bytes:
    """An EPUB of (name, body) chapters: the mimetype first, fixed times, an id made from the key, so that equal input
    gives equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:

        def put(name: str, text: str, how: int = zipfile.ZIP_DEFLATED) -> None:
            info = zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0))
            info.compress_type = how
            z.writestr(info, text)

        esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        names = [f"c{i}.xhtml" for i in range(len(chapters))]
        items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
        put("book.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, key)}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:language>en</dc:language><meta property="dcterms:modified">2000-01-01T00:00:00Z</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{"".join(f"<itemref idref=\"c{i}\"/>" for i in range(len(names)))}</spine></package>')
        links = "".join(f'<li><a href="{n}">{esc(t)}</a></li>' for n, (t, _) in zip(names, chapters))
        put("nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')
        for n, (t, body) in zip(names, chapters):
            put(n, f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{esc(t)}</title></head><body>{body}</body></html>')
    return out.getvalue()


def epub_packages(blocks: DataFrame) -> DataFrame:
    """``doc_id, part, pages, epub``: a package for each ``PAGES`` pages of a document, a chapter for each page."""
    x = block_xml(blocks, "publishing").select("doc_id", "page", F.struct("ord", "block_id", "xml").alias("b"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["xml"]), "\n")
    pages = x.groupBy("doc_id", "page").agg(body.alias("body")).withColumn("part", F.floor(F.col("page") / PAGES))
    parts = pages.groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("page", "body"))).alias("pages"))
    schema = pa.schema([("doc_id", pa.string()), ("part", pa.int64()), ("pages", pa.int32()), ("epub", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, part, pages in zip(*(c.to_pylist() for c in b.columns)):
                data = epub_bytes(f"{doc}/{part}", str(doc), [(f"Page {p['page']}", p["body"]) for p in pages])
                yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([part], pa.int64()), pa.array([len(pages)], pa.int32()), pa.array([data])], schema=schema)

    return parts.select("doc_id", "part", "pages").mapInArrow(run, "doc_id string, part bigint, pages int, epub binary")


def write_lines(df: DataFrame, column: str, path: str, partitions: list[str] | None = None) -> None:
    """One text column as files of lines, in folders by the partition columns."""
    w = df.select(*(partitions or []), F.col(column).cast("string").alias("value")).write.mode("overwrite")
    (w.partitionBy(*partitions) if partitions else w).text(path)
