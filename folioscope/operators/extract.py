"""Page trees as flat records: text levels, inherited attributes, labels, colours, reading order and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rect


def first_filled(*columns: str) -> Column:
    """The first value that is neither null nor empty, from the segment's own to its farthest ancestor's."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def attr_inherit(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", "seg_id", first_filled("own", "region", "page").alias("value"))


def flatten_tree(docs: DataFrame) -> DataFrame:
    """Words of the lines of text pages with their places, blank-separated; empty texts have no words."""
    lines = docs.where("text is not null").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line", "line_text"))
    words = lines.select("page_id", "line", F.posexplode(F.split("line_text", " ")).alias("word", "text"))
    return words.where("text != ''")


def line_filter(lines: DataFrame, length: int, width: int, height: int) -> DataFrame:
    """Lines of at least so many characters and pixels; those without extent go in any case."""
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return lines.where((F.length("text") >= length) & (wide >= width) & (high >= height) & (wide > 0) & (high > 0))


def textequiv_pick(rows: DataFrame, choice: str | int) -> DataFrame:
    """The text of the first or last alternative, or of the first with an index; segments without any have ''.

    With an index that no alternative has, the segment goes. Alternatives are (index, unicode) in document order.
    """
    listed = F.col("alternatives")
    picked = {"first": F.get(listed, F.lit(0)), "last": F.get(F.reverse(listed), F.lit(0))}.get(choice)
    if picked is None:
        picked = F.get(F.filter(listed, lambda e: e["index"] == choice), F.lit(0))
    none = listed.isNull() | (F.size(listed) == 0)
    return rows.select("page_id", "line", F.when(none, "").otherwise(picked["unicode"]).alias("text")).where("text is not null")


def class_filter(segments: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Segments of the classes named; no names are all, names that aren't regions count for nothing."""
    names = [c for c in classes or [] if c.endswith("Region")]
    return segments.where(F.col("seg_class").isin(names)) if classes else segments


def page_numeric_id(pages: DataFrame) -> DataFrame:
    """The number inside a page name, else the page's ordinal: a trim by sets of characters, not a pattern."""
    digits = F.lit("0123456789")
    other = F.btrim(F.col("page_name"), digits)
    number = F.btrim(F.col("page_name"), other).try_cast("bigint")
    return pages.select("page_name", F.coalesce(number, F.col("ordinal").cast("bigint")).alias("page_number"))


def dpi_norm(pages: DataFrame) -> DataFrame:
    """Resolution in dots per inch; 1 means unknown; per centimetre is converted, halves to even."""
    value = F.when(F.col("resolution") == 1, F.lit(None)).when(F.col("unit") == "cm", F.bround(F.col("resolution") * 2.54)).otherwise(F.col("resolution"))
    return pages.select("page_id", value.cast("int").alias("dpi"))


def feature_subtract(rows: DataFrame, gone: list[str]) -> DataFrame:
    left = F.filter(F.split("features", ","), lambda f: ~f.isin(gone) & ~f.startswith("rotated-"))
    return rows.select("page_id", F.array_join(left, ",").alias("features"))


def feature_extension(rows: DataFrame) -> DataFrame:
    has = lambda name: F.array_contains(F.split("features", ","), name)
    return rows.select("page_id", F.when(has("binarized"), ".bin").when(has("grayscale_normalized"), ".nrm").otherwise(".raw").alias("extension"))


def output_path(lines: DataFrame, file_id: Column, extension: str) -> DataFrame:
    return lines.select("page_id", "line_id", F.concat(F.concat_ws("_", file_id, "region_id", "line_id"), F.lit(extension)).alias("path"))


def subtype_resolve(rows: DataFrame, known: list[str]) -> DataFrame:
    """Known subtypes as they are; others become ``other`` with the subtype in a custom attribute."""
    named = F.col("subtype").isin(known)
    return rows.select(
        "page_id", "seg_id",
        F.when(F.col("subtype").isNull(), F.lit(None)).when(named, F.col("subtype")).otherwise("other").alias("type"),
        F.when(~named, F.concat(F.lit("subtype:"), "subtype")).alias("custom"),
    )


def category_map(segments: DataFrame, mapping: dict[str, str], source: str = "custom") -> DataFrame:
    """Foreign categories as region classes and subtypes; unmapped ones get none.

    A mapped value of exactly two parts around a colon has a subtype, any other is a class alone. With ``source``
    "PAGE" the categories are classes already and pass unchanged. The map is a bounded parameter.
    """
    if source == "PAGE":
        return segments.select("page_id", "seg_id", F.col("seg_class").alias("mapped_class"), F.col("subtype").alias("mapped_type"))
    table = F.create_map(*[F.lit(x) for pair in sorted(mapping.items()) for x in pair])
    value = F.try_element_at(table, F.col("subtype"))
    two = F.size(F.split(value, ":")) == 2
    return segments.select(
        "page_id", "seg_id", F.when(two, F.get(F.split(value, ":"), F.lit(0))).otherwise(value).alias("mapped_class"),
        F.when(two, F.get(F.split(value, ":"), F.lit(1))).alias("mapped_type"),
    )


def color_decode(colors: DataFrame) -> DataFrame:
    """Hexadecimal colours as three numbers and, packed, one."""
    part = lambda k: F.conv(F.substring("color", k, 2), 16, 10).cast("bigint")
    return colors.select("label", "color", *[part(k).alias(n) for k, n in ((1, "red"), (3, "green"), (5, "blue"))], F.conv(F.substring("color", 1, 6), 16, 10).cast("bigint").alias("packed"))


def colordict_inverse(colors: DataFrame) -> DataFrame:
    """(label, color) from color to label, without the unnamed; the least colour of a label."""
    return colors.where("label != ''").groupBy("label").agg(F.min("color").alias("color"))


def coco_rows(segments: DataFrame) -> DataFrame:
    """Annotations in the interchange form: flat ring, box and area."""
    x0, y0, x1, y1 = rect.corners()
    return segments.select(
        F.col("page_id").alias("image_id"), "seg_id", F.array(x0, y0, x1, y0, x1, y1, x0, y1).alias("ring"),
        F.array(x0, y0, x1 - x0, y1 - y0).alias("bbox"), rect.area().alias("area"), F.lit(0).alias("iscrowd"),
    )


def page_region_json(segments: DataFrame) -> DataFrame:
    """One document for each page, its regions in the order of their ids."""
    region = F.to_json(F.struct(F.col("seg_id").alias("id"), F.col("seg_class").alias("type"), *rect.CORNERS))
    rows = segments.select("page_id", "seg_id", region.alias("region"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "region"))), lambda r: r["region"])
    return rows.groupBy("page_id").agg(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")).alias("regions"))


def reading_order(groups: DataFrame, subgroups: DataFrame, leaves: DataFrame) -> DataFrame:
    """References in reading order: three nested levels as (path, ref, depth), the ordinal by path.

    The levels are joins of fixed depth, since nesting is shallow; numbering is one window over the reading order.
    """
    top = groups.select(F.array("idx").alias("path"), F.col("name").alias("ref"), F.lit(0).alias("depth"), "idx")
    mid = subgroups.join(top.select(F.col("idx").alias("parent"), F.col("path").alias("up")), "parent").select(F.concat("up", F.array("idx")).alias("path"), F.col("name").alias("ref"), F.lit(1).alias("depth"), "idx")
    low = leaves.join(mid.select(F.col("idx").alias("parent"), F.col("path").alias("up")), "parent").select(F.concat("up", F.array("idx")).alias("path"), F.col("name").alias("ref"), F.lit(2).alias("depth"), "idx")
    every = top.unionByName(mid).unionByName(low)
    return every.select("ref", "depth", F.element_at("path", 1).alias("root"), F.row_number().over(W.partitionBy(F.element_at("path", 1)).orderBy("path")).alias("ordinal"))


def arrows(ordered: DataFrame) -> DataFrame:
    """Consecutive references of a group."""
    after = F.lead("ref").over(W.partitionBy("root").orderBy("ordinal"))
    return ordered.select("root", "ref", after.alias("next"), "depth").where("next is not null")


def reindex(ordered: DataFrame, gone: DataFrame) -> DataFrame:
    """Places from 0 without gaps once some references are gone."""
    left = ordered.join(gone, "ref", "left_anti")
    return left.select("root", "ref", (F.row_number().over(W.partitionBy("root").orderBy("ordinal")) - 1).alias("idx"))


def points_roundtrip(segments: DataFrame) -> DataFrame:
    from ..functions import ring

    parsed = ring.parse(rect.points())
    return segments.select("page_id", "seg_id", ring.serialize(parsed).alias("points"))


def poly_measures(segments: DataFrame) -> DataFrame:
    """Area, perimeter and centroid of rings."""
    from ..functions import ring

    rows = segments.select("page_id", "seg_id", ring.parse(rect.points()).alias("ring"))
    centre = ring.centroid(F.col("ring"))
    return rows.select(
        "page_id", "seg_id", F.round(ring.area(F.col("ring")), 3).alias("area"), F.round(ring.perimeter(F.col("ring")), 3).alias("perimeter"),
        F.round(centre["x"], 3).alias("cx"), F.round(centre["y"], 3).alias("cy"),
    )


def poly_bbox(segments: DataFrame) -> DataFrame:
    from ..functions import ring

    rows = segments.select("page_id", "seg_id", ring.parse(rect.points()).alias("ring"))
    box = ring.box(F.col("ring"))
    return rows.select("page_id", "seg_id", box["x0"].alias("x"), box["y0"].alias("y"), (box["x1"] - box["x0"]).alias("w"), (box["y1"] - box["y0"]).alias("h"))


def coords_rel_abs(segments: DataFrame, matrix: list[list[float]]) -> DataFrame:
    from ..functions import ring

    moved = ring.affine(ring.parse(rect.points()), matrix)
    return segments.select("page_id", "seg_id", ring.serialize(moved).alias("points"))
