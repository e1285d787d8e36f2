"""Segment trees: recursive regions, inherited styles, merged children, re-based coordinates, sheets and addresses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rect, ring
from . import groups

#: Attributes that a merge can lose.
ATTRIBUTES = ("orientation", "type", "script", "language")


def _codes(table: pa.Table, names: list[str], starts: np.ndarray) -> list[np.ndarray]:
    """Columns of ids as numbers, the same for equal ids of a page, below 0 for null ids and rows without a page."""
    page = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
    ids = pa.chunked_array([groups.chunk(table, n) for n in names]).combine_chunks().dictionary_encode()
    code = ids.indices.fill_null(-1).to_numpy().astype(np.int64).reshape(len(names), -1)
    none = (code < 0) | groups.chunk(table, "page_id").is_null().to_numpy(zero_copy_only=False)
    return list(np.where(none, -1 - np.arange(len(names))[:, None], page * len(ids.dictionary) + code))


def regions_recursive(segments: DataFrame, classes: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """(page_id, seg_id, depth, root, path) of all regions below the top level ones, level by level.

    Levels are taken in batches of whole pages until one is empty, or ``depth`` of them. Classes are looked up after the
    descent, so a region of a class left out still leads to its children. Regions that lie in themselves are an error.
    """

    def kernel(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        ids, page, kind = (groups.chunk(table, n) for n in ("seg_id", "page_id", "seg_class"))
        top = groups.chunk(table, "parent_id").is_null().to_numpy(zero_copy_only=False)
        own, up = _codes(table, ["seg_id", "parent_id"], starts)
        below, most = np.flatnonzero(~top), int(np.diff(np.append(starts, table.num_rows)).max())
        row = root = np.flatnonzero(top)
        path, at = ids.take(pa.array(row)), 0
        while len(row) and (depth is None or at < depth):
            if at > most:
                raise ValueError("a region lies in itself")
            place = pa.array(row)
            yield pa.table({
                "page_id": page.take(place), "seg_id": ids.take(place), "seg_class": kind.take(place), "depth": pa.array(np.full(len(row), at, np.int32)),
                "root": ids.take(pa.array(root)), "path": path,
            })
            lower, upper = groups.met(up[below], own[row])
            row, root, path, at = below[lower], root[upper], path.take(pa.array(upper)), at + 1
            path = pc.binary_join_element_wise(path, ids.take(pa.array(row)), "/", null_handling="skip")

    rows = segments.select("page_id", "seg_id", "parent_id", "seg_class")
    every = groups.whole(rows, ["page_id"], ["seg_id"], kernel, f"{groups.kinds(rows, 'page_id', 'seg_id', 'seg_class')}, depth int, root string, path string")
    return (every.where(F.col("seg_class").isin(classes)) if classes else every).drop("seg_class")


def text_regions_union(segments: DataFrame) -> DataFrame:
    """Text regions of the top level, and those right inside its tables, in batches of whole pages."""

    def kernel(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        top = groups.chunk(table, "parent_id").is_null().to_numpy(zero_copy_only=False)
        text, tables = (pc.fill_null(pc.equal(groups.chunk(table, "seg_class"), c), False).to_numpy(zero_copy_only=False) for c in ("TextRegion", "TableRegion"))
        own, up = _codes(table, ["seg_id", "parent_id"], starts)
        inner = np.flatnonzero(text & ~top)
        inner = inner[groups.met(up[inner], own[top & tables])[0]]
        rows = np.concatenate([np.flatnonzero(text & top), inner])
        source = pa.array(np.where(np.arange(len(rows)) < len(rows) - len(inner), "page", "table"), pa.string())
        yield table.select(["page_id", "seg_id"]).take(pa.array(rows)).append_column("source", source)

    rows = segments.select("page_id", "seg_id", "parent_id", "seg_class")
    return groups.whole(rows, ["page_id"], ["seg_id"], kernel, f"{groups.kinds(rows, 'page_id', 'seg_id')}, source string")


def style_inherit(rows: DataFrame, levels: list[str]) -> DataFrame:
    """The nearest style as a whole: fields of different levels aren't mixed."""
    style = F.coalesce(*levels)
    return rows.select("page_id", "seg_id", style["font"].alias("font"), style["size"].alias("size"))


def rebase_original(segments: DataFrame, matrix: list[list[float]], gone: list[str]) -> DataFrame:
    """Segments in the coordinates of a new original: rings moved, negative points raised, two-point rings closed.

    Features that were applied to the image already are dropped from its list.
    """
    moved = ring.ensure_valid(ring.affine(ring.parse(F.col("points")), matrix))
    left = F.filter(F.split("features", ","), lambda f: ~f.isin(gone))
    return segments.select("page_id", "seg_id", ring.serialize(moved).alias("points"), F.array_join(left, ",").alias("features"))


def merge_child_order(targets: DataFrame, ranks: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, region_id, line_id, pos): lines of merged regions and their targets in one list.

    Regions follow each other by ``rank``, their lines by their own places.
    """
    group = targets.select("page_id", F.explode(F.array("seg_id", "target_id")).alias("region_id"), "target_id").distinct()
    order = ranks.select("page_id", F.col("seg_id").alias("region_id"), "rank")
    rows = lines.join(group, ["page_id", "region_id"]).join(order, ["page_id", "region_id"])
    pos = F.row_number().over(W.partitionBy("page_id", "target_id").orderBy("rank", "region_id", "pos")) - 1
    return rows.select("page_id", F.col("target_id").alias("region_id"), "line_id", pos.alias("pos"))


def merge_conflicts(targets: DataFrame, attributes: DataFrame, names: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """(page_id, seg_id, target_id, attribute, value, kept): what a merge would lose, null being a value too."""
    own = attributes.select("page_id", "seg_id", *names)
    kept = attributes.select("page_id", F.col("seg_id").alias("target_id"), *[F.col(c).alias(f"t_{c}") for c in names])
    met = targets.join(own, ["page_id", "seg_id"]).join(kept, ["page_id", "target_id"])
    each = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value"), F.col(f"t_{c}").cast("string").alias("kept")) for c in names])
    return met.select("page_id", "seg_id", "target_id", F.inline(F.filter(each, lambda e: ~e["value"].eqNullSafe(e["kept"]))))


def enlarge_parents(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents' boxes grown to hold their children; parents without children stay as they are."""
    inner = children.groupBy("page_id", F.col("parent_id").alias("seg_id")).agg(*[(F.min if c[1] == "0" else F.max)(c).alias(f"c_{c}") for c in rect.CORNERS])
    grown = [(F.least if c[1] == "0" else F.greatest)(F.col(c), F.coalesce(f"c_{c}", c)).alias(c) for c in rect.CORNERS]
    return parents.join(inner, ["page_id", "seg_id"], "left").select("page_id", "seg_id", *grown)


def line_sheet(lines: DataFrame, file_id: Column) -> DataFrame:
    """Rows of the transcription sheet: identifier, text, state to be edited, image, text file."""
    name = F.concat_ws("_", file_id, "region_id", "line_id")
    image = F.concat(name, F.lit(".raw.png"))
    return lines.select(
        "page_id", name.alias("id"), "text", F.lit("ToDo").alias("status"), image.alias("image"),
        F.replace(image, F.lit(".raw.png"), F.lit(".gt.txt")).alias("text_file"),
    )


def presentation_url(pages: DataFrame) -> DataFrame:
    """Addresses of page images in two libraries' presentations, by the convention named; others have none.

    The first takes its catalogue number and page; the second cuts the file name off the address of the anchor, or
    joins the digital identifiers where there is no anchor. Pages that aren't numbered physically have none there.
    """
    page, anchor = F.col("page_name"), F.col("anchor")
    base = F.concat(F.lit("_tif/jpegs/0000"), F.substring(page, 6, 1000), F.lit(".tif.original.jpg"))
    cut = F.length(anchor) - F.instr(F.reverse(anchor), F.reverse(F.lit("_anchor.xml")).cast("string")) - F.length(F.lit("_anchor.xml")) + 1
    stem = F.concat_ws("_", "collection", "digital")
    joined = F.concat(F.lit("https://digital.slub-dresden.de/data/kitodo/"), stem, F.lit("/"), stem, base)
    slub = (
        F.when(~F.startswith(page, F.lit("PHYS_")), "")
        .when(F.endswith(anchor, F.lit("_anchor.xml")), F.concat(F.substring(anchor, F.lit(1), cut), base))
        .when(F.col("collection").isNotNull() & F.col("digital").isNotNull(), joined)
        .otherwise("")
    )
    sbb = F.concat(F.lit("https://digital.staatsbibliothek-berlin.de/werkansicht?PPN="), F.col("ppn"), F.lit("&PHYSID="), page)
    url = F.when(F.col("convention") == "slub", slub).when(F.col("convention") == "sbb", sbb).otherwise("")
    return pages.select("page_id", "convention", url.alias("url"))
