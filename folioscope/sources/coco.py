"""Annotation JSON in the interchange form: categories, images and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rect

SCHEMA = (
    "struct<categories:array<struct<id:bigint,name:string,supercategory:string,source:string>>,"
    "images:array<struct<id:bigint,file_name:string,width:bigint,height:bigint>>,"
    "annotations:array<struct<id:bigint,image_id:bigint,category_id:bigint,segmentation:array<array<double>>,area:double,bbox:array<double>,iscrowd:int>>>"
)


def documents(segments: DataFrame, categories: list[tuple[int, str, str | None]], width: int, height: int) -> DataFrame:
    """(page_id, json): a document for each page, annotations numbered from 1 by segment id.

    ``categories`` are (id, name, supercategory); a segment has that of its subtype and class, else that of its class.
    """
    known = F.create_map(*[F.lit(x) for k, name, above in categories for x in (f"{above or ''}|{name}", k)])
    category = F.coalesce(F.try_element_at(known, F.concat_ws("|", "seg_class", "subtype")), F.try_element_at(known, F.concat(F.lit("|"), "seg_class")))
    x0, y0, x1, y1 = (c.cast("double") for c in rect.corners())
    one = F.struct("seg_id", category.cast("long").alias("category_id"), F.array(F.array(x0, y0, x1, y0, x1, y1, x0, y1)).alias("segmentation"), rect.area().cast("double").alias("area"), F.array(x0, y0, x1 - x0, y1 - y0).alias("bbox"))
    pages = segments.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    notes = F.transform("all", lambda a, k: F.struct(
        (k + 1).cast("long").alias("id"), F.col("page_id").alias("image_id"), a["category_id"].alias("category_id"), a["segmentation"].alias("segmentation"),
        a["area"].alias("area"), a["bbox"].alias("bbox"), F.lit(0).alias("iscrowd"),
    ))
    kinds = F.array(*[F.struct(F.lit(k).cast("long").alias("id"), F.lit(n).alias("name"), F.lit(a).cast("string").alias("supercategory"), F.lit("PAGE").alias("source")) for k, n, a in categories])
    image = F.array(F.struct(F.col("page_id").alias("id"), F.concat(F.lit("IMG_"), F.col("page_id").cast("string"), F.lit(".tif")).alias("file_name"), F.lit(width).cast("long").alias("width"), F.lit(height).cast("long").alias("height")))
    return pages.select("page_id", F.to_json(F.struct(kinds.alias("categories"), image.alias("images"), notes.alias("annotations"))).alias("json"))


def read(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documents (json) of whole files."""
    return spark.read.text(paths, wholetext=True).select(F.col("value").alias("json"))


def ingest(documents: DataFrame) -> DataFrame:
    """(image_id, file_name, ann_id, category, subcategory, points, area, source) of all annotations of all documents.

    Annotations find their image within their document by its id, an equal-key join on document and id; those whose
    image or category is missing go. A category below another is the subcategory of that one.
    """
    whole = documents.select(F.monotonically_increasing_id().alias("doc"), F.from_json("json", SCHEMA).alias("d"))
    kinds = F.map_from_entries(F.transform("d.categories", lambda c: F.struct(c["id"], c)))
    images = F.map_from_entries(F.transform("d.images", lambda i: F.struct(i["id"], i)))
    source = F.array_max(F.transform("d.categories", lambda c: c["source"]))
    rows = whole.select(kinds.alias("kinds"), images.alias("images"), F.coalesce(source, F.lit("custom")).alias("source"), F.explode("d.annotations").alias("a"))
    kind, image = F.try_element_at("kinds", F.col("a.category_id")), F.try_element_at("images", F.col("a.image_id"))
    flat = F.element_at("a.segmentation", 1)
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1), lambda k: F.concat_ws(",", *[F.get(flat, k * 2 + j).cast("long").cast("string") for j in (0, 1)]))
    above = F.nullif(kind["supercategory"], F.lit(""))
    return rows.where(kind.isNotNull() & image.isNotNull()).select(
        F.col("a.image_id").alias("image_id"), image["file_name"].alias("file_name"), F.col("a.id").alias("ann_id"),
        F.coalesce(above, kind["name"]).alias("category"), F.when(above.isNotNull(), kind["name"]).alias("subcategory"),
        F.array_join(points, " ").alias("points"), F.col("a.area").alias("area"), "source",
    )


def page_match(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(page_id, image_id, how): a page's image by its file name, else by the base name, else by the page's number.

    Of images with one file name the last counts. Pages without an image have null in both.
    """
    named = images.groupBy("file_name").agg(F.max("image_id").alias("image_id"))
    base = F.element_at(F.split("file_name", "/"), -1)
    rows = (
        pages.join(named.withColumnRenamed("image_id", "by_name"), "file_name", "left").withColumn("base", base)
        .join(named.select(F.col("file_name").alias("base"), F.col("image_id").alias("by_base")), "base", "left")
        .join(images.select(F.col("image_id").alias("number"), F.col("image_id").alias("by_number")).distinct(), "number", "left")
    )
    how = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_base").isNotNull(), "base").when(F.col("by_number").isNotNull(), "number")
    return rows.select("page_id", F.coalesce("by_name", "by_base", "by_number").alias("image_id"), how.alias("how"))


def category_lookup(segments: DataFrame, categories: DataFrame) -> DataFrame:
    """The first category named like the segment's subtype, else like its class."""
    first = F.broadcast(categories.groupBy("name").agg(F.min("id").alias("id")))
    by = lambda name, out: first.select(F.col("name").alias(name), F.col("id").alias(out))
    rows = segments.join(by("subtype", "by_subtype"), "subtype", "left").join(by("seg_class", "by_class"), "seg_class", "left")
    return rows.select("page_id", "seg_id", F.coalesce("by_subtype", "by_class").alias("category_id"))
