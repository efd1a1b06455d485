"""Markup to typed text blocks."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.functions.normalize import normalize_by_kind
from docspark.operators.html import page_blocks

SCHEMA = (
    "doc_id {id}, pos int, div_index int, tag string, div_type string, place string, head string, xml_id string, "
    "targets array<string>, equation_label string, text string, error string"
)
#: Characters of markup whose blocks are handed on together.
SLICE = 1_000_000
REFERENCE_TAGS = ("ref", "ptr", "bibl", "biblStruct", "listBibl")


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _walk(doc: object, xml: str | None, nested: bool) -> Iterator[tuple]:
    """Rows of one document, in reading order; nested divisions are read once unless ``nested``."""
    root = ET.fromstring(xml or "")
    names = lambda e, name: [x for x in e if _tag(x) == name]
    text = lambda e: " ".join("".join(e.itertext()).split())
    xml_id = lambda e: next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == "id"), None)
    links = lambda e: [x.attrib["target"] for x in e.iter() if _tag(x) in ("ref", "ptr") and "target" in x.attrib]
    body = next((x for x in root.iter() if _tag(x) == "body"), None)
    pos = 0
    for div_index, div in enumerate(x for x in (body.iter() if body is not None else ()) if _tag(x) == "div"):
        head_el = next(iter(names(div, "head")), None)
        head = text(head_el) if head_el is not None else None
        rows = [("head", None, (xml_id(head_el) or xml_id(div)) if head_el is not None else None, [], None, head)] if head else []
        for e in div:
            tag = _tag(e)
            if tag == "head" or (tag == "div" and not nested):
                continue
            if tag in ("formula", "equation"):
                label_el = next(iter(names(e, "label")), None)
                label = (" ".join((label_el.text or "").split()) if label_el is not None else "") or e.attrib.get("n")
                parts = [e.text or ""]
                for x in e:
                    parts += [("" if x is label_el else "".join(x.itertext())), x.tail or ""]
                rows.append((tag, None, xml_id(e), [], label, " ".join(" ".join(parts).split()) or label))
            elif tag == "figure":
                desc = next(iter(names(e, "figDesc")), None)
                rows.append((tag, None, xml_id(e), [], None, text(e if desc is None else desc)))
            elif tag == "list":
                rows += [("item", None, xml_id(i), links(i), None, text(i)) for i in names(e, "item")]
            elif tag == "note":
                rows.append((tag, f"{e.attrib.get('place') or ''} {e.attrib.get('type') or ''}".lower(), xml_id(e), links(e), None, text(e)))
            else:
                rows.append((tag, None, xml_id(e), links(e) if tag == "p" else [], None, text(e)))
        for tag, place, ident, targets, label, t in rows:
            if t:
                yield (doc, pos, div_index, tag, div.attrib.get("type"), place, head, ident, targets, label, t, None)
                pos += 1


def extract_tei(docs: DataFrame, id_col: str = "doc_id", xml_col: str = "xml", on_error: str = "fail", as_shipped: bool = False) -> DataFrame:
    """X1 for TEI: untyped block rows in reading order, then typed. No body gives no rows; bad markup fails or is one row with ``error``.

    ``as_shipped``: a nested division appears in its parent as well.
    """
    if on_error not in ("fail", "collect"):
        raise ValueError(on_error)

    columns = [c.split()[0] for c in SCHEMA.format(id="x").split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"pos": "int32", "div_index": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, read = [], 0
            for doc, xml in zip(b.iloc[:, 0], b.iloc[:, 1]):
                if read > SLICE:
                    yield frame(rows)
                    rows, read = [], 0
                read += len(xml or "")
                try:
                    rows += _walk(doc, xml, as_shipped)
                except ET.ParseError as e:
                    if on_error == "fail":
                        raise ValueError(f"invalid markup in document {doc}") from e
                    rows.append((doc, 0, None, None, None, None, None, None, [], None, None, str(e)))
            yield frame(rows)

    found = docs.select(F.col(id_col).alias("doc_id"), F.col(xml_col)).mapInPandas(run, SCHEMA.format(id=docs.schema[id_col].dataType.simpleString()))
    typed = classify_blocks(flag_reference_sections(found))
    return typed.withColumn("text_norm", normalize_by_kind(F.col("text"), F.col("kind"))).drop("tag", "div_type", "place", "is_reference")


def flag_reference_sections(blocks: DataFrame) -> DataFrame:
    """By the division's type or its heading."""
    kind, head = F.lower(F.coalesce("div_type", F.lit(""))), F.lower(F.coalesce("head", F.lit("")))
    return blocks.withColumn("is_reference", kind.contains("reference") | kind.contains("bibl") | head.contains("reference"))


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """``kind`` by tag."""
    tag, ref = F.col("tag"), F.col("is_reference")
    kind = (
        F.when(tag == "head", "section_head").when(tag == "p", F.when(ref, "reference").otherwise("paragraph")).when(tag.isin("formula", "equation"), "equation")
        .when(tag == "table", "table").when(tag == "figure", "figure_caption").when(tag == "item", F.when(ref, "reference").otherwise("list_item"))
        .when(tag == "note", F.when(F.coalesce("place", F.lit("")).contains("foot"), "footnote").otherwise("unknown")).when(tag.isin(*REFERENCE_TAGS), "reference").otherwise("unknown")
    )
    return blocks.withColumn("kind", kind)


def extract_targets(html: Column) -> Column:
    """Link targets in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def equation_labels(label: Column, n: Column) -> Column:
    """The label, else the ``n`` attribute."""
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), n)


def extract_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", closed: bool = False) -> DataFrame:
    """X1 for HTML: a row for each block of text in reading order; all text that is shown is in some block (see ``html.Page``).

    A page is read in its row, headings included, so nothing is shuffled. Null and
    empty pages give no rows.
    """

    names = ["doc_id", "pos", "kind", "targets", "text", "head", "div_index"]
    types = [pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, read = [], 0
            handed = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [b.schema.field(0).type, *types])], names=names)  # noqa: B023, E731
            # a page of the batch at a time: all of them as Python's own strings are several times the batch
            for doc, source in zip(b.column(0), b.column(1)):
                source = source.as_py()
                read += len(source or "")
                doc = doc.as_py()
                rows += [(doc, *block) for block in page_blocks(source, closed)]
                if rows and read > SLICE:
                    yield handed()
                    rows, read = [], 0
            if rows:
                yield handed()

    told = f"doc_id {pages.schema[id_col].dataType.simpleString()}, pos int, kind string, targets array<string>, text string, head string, div_index int"
    rows = pages.select(F.col(id_col).alias("doc_id"), F.col(html_col)).mapInArrow(run, told)
    return rows.withColumn("text_norm", normalize_by_kind(F.col("text"), F.col("kind")))


def propagate_heads(blocks: DataFrame) -> DataFrame:
    """``head`` is the last heading so far in the document, ``div_index`` counts headings from 0."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_head = F.col("kind") == "section_head"
    return blocks.withColumns({"head": F.last(F.when(is_head, F.col("text")), ignorenulls=True).over(w), "div_index": F.greatest(F.sum(is_head.cast("int")).over(w) - 1, F.lit(0)).cast("int")})
