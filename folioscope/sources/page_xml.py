"""Page XML: documents of one page each, read into segment rows and written from them.

Reading is one pass: whole files as text, each parsed in a worker, a row for each segment with its parent, level and
place in the document. Writing builds each page's document from its rows, grouped by page.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

NAMESPACE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"
LEVELS = {"TextLine": "line", "Word": "word", "Glyph": "glyph"}
SCHEMA = (
    "page_id string, image string, width long, height long, level string, seg_id string, parent_id string, seg_class string, subtype string,"
    " custom string, points string, conf double, depth int, pos long, text string, error string"
)
_FIELDS = [f.split()[0] for f in SCHEMA.split(", ")]


@lru_cache(maxsize=1024)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _name(element: ET.Element) -> str:
    return _local(element.tag)


def _child(element: ET.Element, name: str) -> ET.Element | None:
    for e in element:
        if _name(e) == name:
            return e
    return None


def parse(page_id: str, text: str) -> list[tuple]:
    """Rows of one document, in document order; one row with ``error`` for a document that can't be read."""
    try:
        page = _child(ET.fromstring(text), "Page")
        if page is None:
            raise ValueError("no Page")
    except (ET.ParseError, ValueError) as bad:
        return [(page_id, *[None] * (len(_FIELDS) - 2), str(bad))]
    head = (page_id, page.get("imageFilename"), *(int(page.get(k) or 0) for k in ("imageWidth", "imageHeight")))
    rows: list[tuple] = []
    work = [(e, None, 0) for e in reversed(page)]
    while work:
        element, parent, depth = work.pop()
        kind = _name(element)
        level = "region" if kind.endswith("Region") else LEVELS.get(kind) or ("border" if kind == "Border" else None)
        if level is None:
            continue
        coords = equiv = None
        inner = []
        for e in element:
            name = _name(e)
            if name == "Coords":
                coords = e if coords is None else coords
            elif name == "TextEquiv":
                equiv = e if equiv is None else equiv
            else:
                inner.append(e)
        unicode = _child(equiv, "Unicode") if equiv is not None else None
        conf = coords.get("conf") if coords is not None else None
        rows.append((
            *head, level, element.get("id"), parent, kind, element.get("type"), element.get("custom"),
            coords.get("points") if coords is not None else None, float(conf) if conf else None, depth, len(rows),
            (unicode.text or "") if unicode is not None else None, None,
        ))
        work += [(e, element.get("id"), depth + 1) for e in reversed(inner)]
    return rows or [(*head, *[None] * (len(_FIELDS) - 4))]


def parse_documents(documents: DataFrame) -> DataFrame:
    """Segment rows of documents (page_id, xml)."""

    types = {f.split()[0]: {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[f.split()[1]] for f in SCHEMA.split(", ")}

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = [r for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in parse(k, x or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types.values(), strict=True)], list(types))

    return documents.select(F.col("page_id").cast("string"), "xml").mapInArrow(batches, SCHEMA)


def scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Segment rows of all files; a page's id is its file's name without extension."""
    files = spark.read.text(paths, wholetext=True)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1)
    return parse_documents(files.select(stem.alias("page_id"), F.col("value").alias("xml")))


def _escaped(text):
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def documents(regions: DataFrame, width: int, height: int) -> DataFrame:
    """(page_id, xml): flat regions (page_id, seg_id, seg_class, subtype, points, conf) as documents, by id in a page.

    Built from column expressions, so that a page's document is made where its rows meet.
    """

    def attribute(name: str, value):
        return F.coalesce(F.concat(F.lit(f' {name}="'), _escaped(value.cast("string")), F.lit('"')), F.lit(""))

    region = F.concat(
        F.lit("<"), "seg_class", attribute("id", F.col("seg_id")), attribute("type", F.col("subtype")), F.lit("><Coords"),
        attribute("points", F.col("points")), attribute("conf", F.col("conf")), F.lit("/></"), "seg_class", F.lit(">"),
    )
    listed = F.sort_array(F.collect_list(F.struct("seg_id", region.alias("xml"))))
    body = F.array_join(F.transform(listed, lambda r: r["xml"]), "")
    head = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="{NAMESPACE}"><Page imageFilename="IMG_'), F.col("page_id").cast("string"),
        F.lit(f'.tif" imageWidth="{width}" imageHeight="{height}">'),
    )
    return regions.groupBy("page_id").agg(body.alias("body")).select("page_id", F.concat(head, "body", F.lit("</Page></PcGts>")).alias("xml"))


def build(rows: list[dict]) -> str:
    """The document of one page from its segment rows (those of ``parse``), nested by parent, in the order of ``pos``."""
    first = rows[0]
    root = ET.Element("PcGts", xmlns=NAMESPACE)
    page = ET.SubElement(root, "Page", imageFilename=first["image"] or "", imageWidth=str(first["width"] or 0), imageHeight=str(first["height"] or 0))
    made: dict[str, ET.Element] = {}
    for r in sorted((r for r in rows if r["level"]), key=lambda r: r["pos"]):
        given = {"id": r["seg_id"], "type": r["subtype"], "custom": r["custom"]}
        element = ET.SubElement(made.get(r["parent_id"], page), r["seg_class"], {k: v for k, v in given.items() if v})
        if r["points"] is not None:
            coords = ET.SubElement(element, "Coords", points=r["points"])
            if r["conf"] is not None:
                coords.set("conf", repr(float(r["conf"])))
        if r["text"] is not None:
            ET.SubElement(ET.SubElement(element, "TextEquiv"), "Unicode").text = r["text"]
        if r["seg_id"]:
            made[r["seg_id"]] = element
    return ET.tostring(root, encoding="unicode")


def write(segments: DataFrame, path: str) -> None:
    """One XML file for each page under path/page_id=.., written by the tasks that hold the pages."""

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        plain = rows.astype(object).where(rows.notna(), None).to_dict("records")
        return pd.DataFrame({"page_id": [rows["page_id"].iloc[0]], "xml": [build(plain)]})

    made = segments.where("error is null").groupBy("page_id").applyInPandas(page, "page_id string, xml string")
    made.write.partitionBy("page_id").text(path)
