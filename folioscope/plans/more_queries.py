"""Registered queries on trees, formats, general outlines and whole images, beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import rect, ring
from ..operators import evaluate as ev, outlines as ol, raster as ra, repair as re, tree as tr
from ..sources import coco, lists, page_xml
from .fixtures import LAYOUT, layout

WIDTH, HEIGHT = 1400, 900
STEP = 20
REBASE = [[1.0, 0.0, -50.0], [0.0, 1.0, -40.0], [0.0, 0.0, 1.0]]
CATEGORIES = [(1, "TextRegion", None), (2, "TableRegion", None), (3, "heading", "TextRegion"), (4, "TextRegion", "Region"), (5, "caption", "TextRegion")]
PAINT = {"TextRegion": 9699539, "TableRegion": 65280}


def rings(segments: DataFrame) -> DataFrame:
    """Outlines of 2 to 43 points: by corner, one in forty crosses itself, one has two points, others more on top."""
    x0, y0, x1, y1 = rect.corners()
    k = F.pmod(x0 + y0, F.lit(40))

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    top = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), lambda i: point(x0 + F.floor(i * (x1 - x0) / (k + 1)), y0))
    whole = F.concat(F.array(point(x0, y0)), top, F.array(point(x1, y0), point(x1, y1), point(x0, y1)))
    crossed = F.array(point(x0, y0), point(x1, y1), point(x1, y0), point(x0, y1))
    outline = F.when(k == 0, crossed).when(k == 1, F.array(point(x0, y0), point(x1, y1))).otherwise(whole)
    return segments.withColumn("ring", outline)


def _tree(s: SparkSession, d: str) -> DataFrame:
    """Truth as a tree: a page's region n lies in region n / 2."""
    rank = F.substring("seg_id", 2, 10).cast("long")
    return layout(s, d, "seg_gt").withColumn("parent_id", F.when(rank > 1, F.concat(F.lit("r"), F.floor(rank / 2).cast("string"))))


def _pages(s, d):
    return layout(s, d, "seg_gt").select("page_id").distinct()


def _styles(s, d):
    style = lambda c, m, name: F.when(F.col(c) % m == 0, F.struct(F.concat(F.lit(name), F.col(c).cast("string")).alias("font"), F.when(F.col(c) % 2 == 0, F.col(c)).alias("size")))
    return layout(s, d, "seg_dup").select("page_id", "seg_id", style("x0", 3, "word").alias("word"), style("y0", 4, "line").alias("line"), style("page_id", 2, "region").alias("region"))


def _addresses(s, d):
    """Pages with the metadata of two libraries' presentations, some of it missing."""
    p = F.col("page_id")
    name = F.concat(F.when(p % 7 == 0, "PAGE_").otherwise("PHYS_"), F.lpad(p.cast("string"), 4, "0"))
    return _pages(s, d).select(
        "page_id", name.alias("page_name"), F.element_at(F.array(*map(F.lit, ("slub", "sbb", "none"))), (p % 3 + 1).cast("int")).alias("convention"),
        F.concat(F.lit("PPN"), p.cast("string")).alias("ppn"), F.when(p % 2 == 0, F.concat(F.lit("https://example.org/data/"), p.cast("string"), F.lit("_anchor.xml"))).alias("anchor"),
        F.when(p % 5 != 0, F.lit("coll")).alias("collection"), p.cast("string").alias("digital"),
    )


def _decided(s, d):
    return re.classify(re.overlap_pairs(layout(s, d, "seg_dup").where("seg_class = 'TextRegion'")))


def _attributes(s, d):
    return layout(s, d, "seg_dup").select(
        "page_id", "seg_id", (F.col("x0") % 2).alias("orientation"), F.col("subtype").alias("type"),
        F.when(F.col("y0") % 3 > 0, F.concat(F.lit("script"), (F.col("y0") % 3).cast("string"))).alias("script"), F.lit("German").alias("language"),
    )


def _lines(s, d):
    return layout(s, d, "seg_line").withColumn("text", F.repeat(F.lit("x"), (F.col("x0") % 30).cast("int")))


def _images(s, d):
    p = F.col("page_id")
    number = p.cast("string")
    name = F.when(p % 4 == 0, F.concat(F.lit("scan/IMG_"), number, F.lit(".tif"))).when(p % 4 == 1, F.concat(F.lit("IMG_"), number, F.lit(".tif"))).otherwise(F.concat(F.lit("other_"), number, F.lit(".tif")))
    return _pages(s, d).select(F.when(p % 4 == 2, p).otherwise(p + 5_000_000_000).alias("image_id"), name.alias("file_name"))


def _list(s, d):
    number = F.col("page_id").cast("string")
    line = F.concat(F.lit(" GT/"), number, F.lit(".xml\tDT/"), number, F.lit(".xml\tBIN/"), number, F.lit(".png \n"))
    return _pages(s, d).select(F.col("page_id").alias("row"), F.regexp_replace(line, "\n$", "").alias("line"))


def _outlined(rows: DataFrame, *prefixes: str) -> DataFrame:
    for prefix in prefixes:
        rows = rows.withColumn(f"{prefix}points", rect.points(prefix))
    return rows


def _merged(s, d):
    pairs = _decided(s, d).where("decision like 'merge%'")
    return ol.merge_outline(_outlined(pairs, "a_", "b_").select("page_id", "a_seg_id", "b_seg_id", "a_points", "b_points")).select("page_id", "a_seg_id", "b_seg_id", "area")


def _split(s, d):
    lines = layout(s, d, "seg_line")
    actions = re.line_actions(re.line_pairs(_decided(s, d), lines)).where("action = 'split'")
    side = lambda key, prefix: lines.select("page_id", F.col("line_id").alias(key), *[F.col(c).alias(prefix + c) for c in rect.CORNERS])
    rows = actions.join(side("line_id", ""), ["page_id", "line_id"]).join(side("other_id", "other_"), ["page_id", "other_id"])
    return ol.apply_splits(_outlined(rows, "", "other_").select("page_id", "line_id", "other_id", "points", "other_points")).drop("points")


def _children(s, d):
    lines = layout(s, d, "seg_line")
    return _outlined(lines, "").select("page_id", F.col("region_id").alias("parent_id"), F.col("line_id").alias("seg_id"), "points")


def _resampled(s, d):
    rows = ol.resample(rings(layout(s, d, "seg_gt")).select("page_id", "seg_id", "ring"), STEP, every=False)
    rows = rows.select("page_id", "seg_id", F.size("ring").alias("n"), ol.sums(F.col("ring")).alias("s"))
    return rows.select("page_id", "seg_id", "n", F.round("s.x", 3).alias("sum_x"), F.round("s.y", 3).alias("sum_y"))


def _channels(s, d):
    """Colour channels from the numbers of the vectors, four of them."""
    rows = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("page_id"), F.posexplode("embedding").alias("i", "v"))
    value = F.floor(F.abs(F.col("v").cast("double")) * 1000)
    return rows.select("page_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), *[((value + F.lit(k * 37)) % 256).alias(c) for k, c in enumerate("rgba")])


def _parts(s, d):
    return ra.components(s.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", 8)


def _ap(s, d):
    gt, dt = ev.annotations(layout(s, d, "seg_gt")), ev.annotations(layout(s, d, "seg_dt"))
    return ev.coco_ap(gt, dt, ev.iou_pairs(gt, dt))


def _xml(s, d):
    regions = _outlined(layout(s, d, "seg_gt"), "")
    rows = page_xml.parse_documents(page_xml.documents(regions, WIDTH, HEIGHT))
    return rows.select(F.col("page_id").cast("long").alias("page_id"), "image", "width", "height", "seg_id", "seg_class", "subtype", "points", "conf", "pos")


def _rebased(s, d):
    rows = rings(layout(s, d, "seg_gt")).where(F.pmod(F.col("x0") + F.col("y0"), F.lit(40)) < 2)
    rows = rows.select("page_id", "seg_id", ring.serialize(F.col("ring")).alias("points"), F.lit("cropped,binarized,deskewed,rotated-90").alias("features"))
    return tr.rebase_original(rows, REBASE, ["cropped", "deskewed", "rotated-90", "rotated-180", "rotated-270"])


def _ranked(s, d):
    return re.ranked(layout(s, d, "seg_dup").where("seg_class = 'TextRegion'"), ["page_id", "seg_class"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "regions_recursive": lambda s, d: tr.regions_recursive(_tree(s, d)),
    "text_regions_union": lambda s, d: tr.text_regions_union(_tree(s, d)),
    "style_inherit": lambda s, d: tr.style_inherit(_styles(s, d), ["word", "line", "region"]),
    "presentation_url": lambda s, d: tr.presentation_url(_addresses(s, d)),
    "merge_child_order": lambda s, d: tr.merge_child_order(re.merge_targets(_decided(s, d)), _ranked(s, d), layout(s, d, "seg_line")),
    "merge_conflicts": lambda s, d: tr.merge_conflicts(re.merge_targets(_decided(s, d)), _attributes(s, d)),
    "enlarge_parents": lambda s, d: tr.enlarge_parents(layout(s, d, "seg_gt"), layout(s, d, "seg_dt").withColumn("parent_id", F.expr("left(seg_id, length(seg_id) - 1)"))),
    "line_sheet": lambda s, d: tr.line_sheet(_lines(s, d), F.concat(F.lit("FILE_"), F.col("page_id").cast("string"))),
    "rebase_original": _rebased,
    "scan_page_xml": _xml,
    "filelist_scan": lambda s, d: lists.filelist(_list(s, d)),
    "coco_ingest": lambda s, d: coco.ingest(coco.documents(layout(s, d, "seg_gt"), CATEGORIES, WIDTH, HEIGHT)),
    "coco_page_match": lambda s, d: coco.page_match(_pages(s, d).select("page_id", F.concat(F.lit("scan/IMG_"), F.col("page_id").cast("string"), F.lit(".tif")).alias("file_name"), F.col("page_id").alias("number")), _images(s, d)),
    "coco_category_lookup": lambda s, d: coco.category_lookup(layout(s, d, "seg_gt"), s.createDataFrame([(k, n) for k, n, _ in CATEGORIES], "id long, name string")),
    "coco_ap": _ap,
    "merge_outline": _merged,
    "apply_splits": _split,
    "project_hull": lambda s, d: ol.project_hull(_children(s, d)).drop("points"),
    "convex_hull": lambda s, d: ol.convex_hull(_children(s, d)).drop("points"),
    "mst_bridges": lambda s, d: ol.mst_bridges(_outlined(layout(s, d, "seg_gt"), "")),
    "make_valid": lambda s, d: ol.make_valid(rings(layout(s, d, "seg_gt")).select("page_id", "seg_id", ring.serialize(F.col("ring")).alias("points"))),
    "spread_rects": lambda s, d: ol.spread(_outlined(layout(s, d, "seg_gt"), ""), 5).drop("points"),
    "simplify_resample": _resampled,
    "mask_pack": lambda s, d: ra.pack(_channels(s, d)),
    "components": _parts,
    "contour_filter": lambda s, d: ra.contour_filter(_parts(s, d), 64, 6, 10.0),
    "component_scale": lambda s, d: ra.component_scale(_parts(s, d)),
    "painter_mask": lambda s, d: ra.painter_mask(layout(s, d, "seg_gt"), PAINT, 25),
    "simplify_guard": lambda s, d: rings(layout(s, d, "seg_gt")).select("page_id", "seg_id", ol.simplifies(F.col("ring"), STEP).alias("resample")),
    "segment_validity": lambda s, d: re.segment_validity(rings(layout(s, d, "seg_dt"))),
    "ensure_valid": lambda s, d: re.ensure_valid(rings(layout(s, d, "seg_dt"))),
    "error_resolve": lambda s, d: re.error_resolve(re.segment_validity(rings(layout(s, d, "seg_dt"))).where("reason is not null"), layout(s, d, "seg_dup")),
}

_TREE = """,
t AS (SELECT page_id, seg_id, seg_class, CASE WHEN substr(seg_id, 2)::BIGINT > 1 THEN 'r' || (substr(seg_id, 2)::BIGINT // 2) END AS parent_id FROM seg_gt)"""
_PAGES = ", p AS (SELECT DISTINCT page_id FROM seg_gt)"
_K = "(((x0 + y0) % 40) + 40) % 40"


def _ring(of: str = "{}") -> str:
    """Text of the outlines of ``rings``, each coordinate put through ``of``."""
    point = lambda x, y: f"{of.format(x)} || ',' || {of.format(y)}"
    top = f"array_to_string(list_transform(range(1, k + 1), lambda i: {point('(x0 + (i * (x1 - x0)) // (k + 1))', 'y0')}), ' ')"
    two = f"{point('x0', 'y0')} || ' ' || {point('x1', 'y1')}"
    crossed = f"{two} || ' ' || {point('x1', 'y0')} || ' ' || {point('x0', 'y1')}"
    whole = f"{point('x0', 'y0')} || ' ' || {top} || ' ' || {point('x1', 'y0')} || ' ' || {point('x1', 'y1')} || ' ' || {point('x0', 'y1')}"
    return f"CASE k WHEN 0 THEN {crossed} WHEN 1 THEN {{two}} ELSE {whole} END".replace("{two}", two)


_RINGS = f", k AS (SELECT *, {_K} AS k FROM seg_gt), kd AS (SELECT *, {_K} AS k FROM seg_dt)"
_CLAMP = "greatest(0, {})"
_BACK = "(" + _ring(_CLAMP) + ") || CASE k WHEN 1 THEN ' ' || (greatest(0, x1) + 1) || ',' || (greatest(0, y1) + 1) || ' ' || (greatest(0, x0) + 1) || ',' || (greatest(0, y0) + 1) ELSE '' END"
_REASON = "CASE WHEN k = 1 THEN 'too few points' WHEN k = 0 THEN 'self-intersection' WHEN x0 < 0 OR y0 < 0 THEN 'negative' END"
_GUARD = f"(k >= 6 AND 2 * (x1 - x0 + y1 - y0) >= {4 * STEP} AND 2 * (x1 - x0 + y1 - y0) <= {STEP} * (k + 4) AND sqrt((x1 - x0) * (y1 - y0)) >= {STEP} * 0.1)"
_PX = "px AS (SELECT vec_id AS page_id, i, i % 8 AS x, i // 8 AS y FROM embeddings, range(0, 64) t(i) WHERE embedding[i + 1] > 0)"
_PARTS = f"""WITH RECURSIVE {_PX},
reach(page_id, i, root) AS (
  SELECT page_id, i, i FROM px
  UNION SELECT b.page_id, b.i, r.root FROM reach r JOIN px a ON a.page_id = r.page_id AND a.i = r.i
    JOIN px b ON b.page_id = a.page_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1),
lab AS (SELECT page_id, i, min(root) AS root FROM reach GROUP BY ALL),
parts AS (SELECT page_id, root, count(*) AS n, min(i % 8) AS x0, min(i // 8) AS y0, max(i % 8) AS x1, max(i // 8) AS y1 FROM lab GROUP BY ALL)"""


def _with(extra: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{LAYOUT}{extra}\n{body}"


def more_sql(decide: str, lines: str) -> dict[str, str]:
    """SQL of the queries, from the common tables ``decide`` and ``lines`` of the pair rules."""
    conflict = lambda name, a, b: f"SELECT t.page_id, t.seg_id, t.target_id, '{name}' AS attribute, ({a})::VARCHAR AS value, ({b})::VARCHAR AS kept FROM targets t JOIN seg_dup a USING (page_id, seg_id) JOIN seg_dup b ON b.page_id = t.page_id AND b.seg_id = t.target_id WHERE ({a}) IS DISTINCT FROM ({b})"
    script = lambda p: f"CASE WHEN {p}.y0 % 3 > 0 THEN 'script' || ({p}.y0 % 3) END"
    style = lambda c, m, name: f"CASE WHEN {c} % {m} = 0 THEN struct_pack(font := '{name}' || {c}, size := CASE WHEN {c} % 2 = 0 THEN {c} END) END"
    return {
        "regions_recursive": _with(_TREE, """, r(page_id, seg_id, depth, root, path) AS (
  SELECT page_id, seg_id, 0, seg_id, seg_id FROM t WHERE parent_id IS NULL
  UNION ALL SELECT t.page_id, t.seg_id, r.depth + 1, r.root, r.path || '/' || t.seg_id FROM t JOIN r ON t.page_id = r.page_id AND t.parent_id = r.seg_id)
SELECT page_id, seg_id, depth::INT AS depth, root, path FROM r""", recursive=True),
        "text_regions_union": _with(_TREE, """SELECT page_id, seg_id, 'page' AS source FROM t WHERE parent_id IS NULL AND seg_class = 'TextRegion'
UNION ALL SELECT t.page_id, t.seg_id, 'table' FROM t JOIN t AS p ON p.page_id = t.page_id AND p.seg_id = t.parent_id
WHERE t.seg_class = 'TextRegion' AND p.parent_id IS NULL AND p.seg_class = 'TableRegion'"""),
        "style_inherit": _with("", f"SELECT page_id, seg_id, s.font AS font, s.size AS size FROM (SELECT page_id, seg_id, coalesce({style('x0', 3, 'word')}, {style('y0', 4, 'line')}, {style('page_id', 2, 'region')}) AS s FROM seg_dup)"),
        "presentation_url": _with(_PAGES, """, a AS (SELECT page_id, (['slub', 'sbb', 'none'])[page_id % 3 + 1] AS convention,
  CASE WHEN page_id % 7 = 0 THEN 'PAGE_' ELSE 'PHYS_' END || lpad(page_id::VARCHAR, 4, '0') AS name FROM p)
SELECT page_id, convention, CASE convention
  WHEN 'sbb' THEN 'https://digital.staatsbibliothek-berlin.de/werkansicht?PPN=PPN' || page_id || '&PHYSID=' || name
  WHEN 'slub' THEN CASE WHEN page_id % 7 = 0 THEN ''
    WHEN page_id % 2 = 0 THEN 'https://example.org/data/' || page_id || '_tif/jpegs/0000' || name[6:] || '.tif.original.jpg'
    WHEN page_id % 5 <> 0 THEN 'https://digital.slub-dresden.de/data/kitodo/coll_' || page_id || '/coll_' || page_id || '_tif/jpegs/0000' || name[6:] || '.tif.original.jpg'
    ELSE '' END
  ELSE '' END AS url FROM a"""),
        "merge_child_order": _with(decide, """, g AS (SELECT page_id, seg_id AS region_id, target_id FROM targets UNION SELECT page_id, target_id, target_id FROM targets)
SELECT l.page_id, g.target_id AS region_id, l.line_id, (row_number() OVER (PARTITION BY l.page_id, g.target_id ORDER BY o.k, g.region_id, l.pos) - 1)::INT AS pos
FROM g JOIN seg_line l USING (page_id, region_id) JOIN ordered o ON o.page_id = g.page_id AND o.seg_id = g.region_id AND o.seg_class = 'TextRegion'"""),
        "merge_conflicts": _with(decide, " UNION ALL ".join((conflict("orientation", "a.x0 % 2", "b.x0 % 2"), conflict("type", "a.subtype", "b.subtype"), conflict("script", script("a"), script("b"))))),
        "apply_merges": _with(decide, """, m AS (SELECT s.page_id, t.target_id AS seg_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM seg_dup s JOIN targets t USING (page_id, seg_id) GROUP BY ALL)
SELECT s.page_id, s.seg_id, s.seg_class, s.subtype, least(s.x0, coalesce(m.x0, s.x0)) AS x0, least(s.y0, coalesce(m.y0, s.y0)) AS y0, greatest(s.x1, coalesce(m.x1, s.x1)) AS x1, greatest(s.y1, coalesce(m.y1, s.y1)) AS y1
FROM seg_dup s LEFT JOIN m USING (page_id, seg_id) WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.page_id = s.page_id AND t.seg_id = s.seg_id)"""),
        "enlarge_parents": _with("", """, c AS (SELECT page_id, seg_id[1:-2] AS seg_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM seg_dt GROUP BY ALL)
SELECT p.page_id, p.seg_id, least(p.x0, coalesce(c.x0, p.x0)) AS x0, least(p.y0, coalesce(c.y0, p.y0)) AS y0, greatest(p.x1, coalesce(c.x1, p.x1)) AS x1, greatest(p.y1, coalesce(c.y1, p.y1)) AS y1
FROM seg_gt p LEFT JOIN c USING (page_id, seg_id)"""),
        "line_sheet": _with("", "SELECT page_id, id, text, 'ToDo' AS status, id || '.raw.png' AS image, id || '.gt.txt' AS text_file FROM (SELECT page_id, 'FILE_' || page_id || '_' || region_id || '_' || line_id AS id, repeat('x', x0 % 30) AS text FROM seg_line)"),
        "rebase_original": _with(_RINGS, ", m AS (SELECT page_id, seg_id, x0 - 50 AS x0, y0 - 40 AS y0, x1 - 50 AS x1, y1 - 40 AS y1, k FROM k WHERE k < 2)\nSELECT page_id, seg_id, " + _BACK + " AS points, 'binarized' AS features FROM m"),
        "scan_page_xml": _with("", f"SELECT page_id, 'IMG_' || page_id || '.tif' AS image, {WIDTH}::BIGINT AS width, {HEIGHT}::BIGINT AS height, seg_id, seg_class, subtype, x0 || ',' || y0 || ' ' || x1 || ',' || y0 || ' ' || x1 || ',' || y1 || ' ' || x0 || ',' || y1 AS points, conf, row_number() OVER (PARTITION BY page_id ORDER BY seg_id) - 1 AS pos FROM seg_gt"),
        "filelist_scan": _with(_PAGES, "SELECT page_id AS row, 'GT/' || page_id || '.xml' AS gt, 'DT/' || page_id || '.xml' AS dt, 'BIN/' || page_id || '.png' AS image FROM p"),
        "coco_ingest": _with("", """SELECT page_id AS image_id, 'IMG_' || page_id || '.tif' AS file_name, row_number() OVER (PARTITION BY page_id ORDER BY seg_id) AS ann_id,
  seg_class AS category, CASE WHEN subtype IN ('heading', 'caption') THEN subtype END AS subcategory,
  x0 || ',' || y0 || ' ' || x1 || ',' || y0 || ' ' || x1 || ',' || y1 || ' ' || x0 || ',' || y1 AS points, ((x1 - x0) * (y1 - y0))::DOUBLE AS area, 'PAGE' AS source FROM seg_gt"""),
        "coco_page_match": _with(_PAGES, "SELECT page_id, CASE WHEN page_id % 4 < 2 THEN page_id + 5000000000 WHEN page_id % 4 = 2 THEN page_id END AS image_id, CASE page_id % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'base' WHEN 2 THEN 'number' END AS how FROM p"),
        "coco_category_lookup": _with("", "SELECT page_id, seg_id, CASE WHEN subtype = 'heading' THEN 3 WHEN subtype = 'caption' THEN 5 WHEN seg_class = 'TextRegion' THEN 1 ELSE 2 END::BIGINT AS category_id FROM seg_gt"),
        "merge_outline": _with(decide, "SELECT page_id, a_seg_id, b_seg_id, (aa + ba - inter)::DOUBLE AS area FROM decided WHERE decision LIKE 'merge%'"),
        "apply_splits": _with(lines, """, act AS (SELECT page_id, CASE WHEN la > lb THEN a_line ELSE b_line END AS line_id, CASE WHEN la > lb THEN b_line ELSE a_line END AS other_id FROM lp WHERE NOT (a_in_b OR b_in_a))
SELECT c.page_id, c.line_id, c.other_id,
  ((a.x1 - a.x0) * (a.y1 - a.y0) - (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)))::DOUBLE AS area,
  CASE WHEN b.x0 <= a.x0 AND b.x1 >= a.x1 THEN (b.y0 > a.y0)::BIGINT + (b.y1 < a.y1)::BIGINT WHEN b.y0 <= a.y0 AND b.y1 >= a.y1 THEN (b.x0 > a.x0)::BIGINT + (b.x1 < a.x1)::BIGINT ELSE 1 END AS parts
FROM act c JOIN seg_line a ON a.page_id = c.page_id AND a.line_id = c.line_id JOIN seg_line b ON b.page_id = c.page_id AND b.line_id = c.other_id"""),
        "project_hull": _with("", "SELECT page_id, region_id AS parent_id, ((max(x1) - min(x0)) * (max(y1) - min(y0)))::DOUBLE AS area FROM seg_line GROUP BY ALL"),
        "convex_hull": _with("", "SELECT page_id, region_id AS parent_id, ((max(x1) - min(x0)) * (max(y1) - min(y0)))::DOUBLE AS area FROM seg_line GROUP BY ALL"),
        "simplify_resample": _with(_RINGS, f""", r AS (SELECT page_id, seg_id, x0, y0, x1, y1, x1 - x0 AS w, y1 - y0 AS h, unnest(range(0, ceil(2 * (x1 - x0 + y1 - y0) / {STEP}.0)::BIGINT)) * {STEP} AS s FROM k WHERE {_GUARD})
SELECT page_id, seg_id, count(*)::INT AS n,
  round(sum(CASE WHEN s <= w THEN x0 + s WHEN s <= w + h THEN x1 WHEN s <= 2 * w + h THEN x1 - (s - w - h) ELSE x0 END)::DOUBLE, 3) AS sum_x,
  round(sum(CASE WHEN s <= w THEN y0 WHEN s <= w + h THEN y0 + s - w WHEN s <= 2 * w + h THEN y1 ELSE y1 - (s - 2 * w - h) END)::DOUBLE, 3) AS sum_y
FROM r GROUP BY page_id, seg_id"""),
        "simplify_guard": _with(_RINGS, f"SELECT page_id, seg_id, {_GUARD} AS resample FROM k"),
        "segment_validity": _with(_RINGS, f"SELECT page_id, seg_id, {_REASON} AS reason FROM kd"),
        "error_resolve": _with(_RINGS, f"SELECT page_id, seg_id, reason, EXISTS (SELECT 1 FROM seg_dup s WHERE s.page_id = e.page_id AND s.seg_id = e.seg_id) AS found FROM (SELECT page_id, seg_id, {_REASON} AS reason FROM kd) e WHERE reason IS NOT NULL"),
        "ensure_valid": _with(_RINGS, f"SELECT page_id, seg_id, {_BACK} AS points FROM kd"),
        "mask_pack": "WITH v AS (SELECT vec_id AS page_id, i % 8 AS x, i // 8 AS y, floor(abs(embedding[i + 1]::DOUBLE) * 1000)::BIGINT AS v FROM embeddings, range(0, 64) t(i)), c AS (SELECT page_id, x::INT AS x, y::INT AS y, (v % 256) * 16777216 + ((v + 37) % 256) * 65536 + ((v + 74) % 256) * 256 + (v + 111) % 256 AS color FROM v)\nSELECT page_id, x, y, color, lpad(hex(color), 8, '0') AS hex FROM c",
        "components": f"{_PARTS}\nSELECT * FROM parts",
        "contour_filter": f"{_PARTS}\nSELECT page_id, 'region_' || row_number() OVER (PARTITION BY page_id ORDER BY root) AS seg_id, x0, y0, x1, y1, n AS area FROM parts WHERE NOT (n < 6 AND n * 100 < 640)",
        "component_scale": f"{_PARTS}\nSELECT page_id, (CASE WHEN count(*) > 1 THEN coalesce(floor(median(CASE WHEN sqrt(3 * n) > 5 AND sqrt(3 * n) < 100 THEN sqrt(3 * n) END)), 43) ELSE 43 END)::INT AS scale FROM parts GROUP BY page_id",
        "painter_mask": _with("", """, c AS (SELECT page_id, seg_id, seg_class, unnest(range(ceil(x0 / 25.0)::BIGINT, ceil(x1 / 25.0)::BIGINT)) AS cx, ceil(y0 / 25.0)::BIGINT AS a, ceil(y1 / 25.0)::BIGINT AS b FROM seg_gt),
d AS (SELECT page_id, seg_id, seg_class, cx, unnest(range(a, b)) AS cy FROM c)
SELECT page_id, cx, cy, CASE max_by(seg_class, seg_id) WHEN 'TextRegion' THEN 9699539 ELSE 65280 END::INT AS color FROM d GROUP BY ALL"""),
    }
