"""The same queries in SQL, written apart from the operators."""

from __future__ import annotations

from .fixtures import LAYOUT
from .more_queries import more_sql

_NOTES = """,
ann_gt AS (SELECT page_id, concat_ws('.', seg_class, nullif(subtype, '')) AS category, seg_id, coalesce(nullif(conf, 0), 1.0) AS score, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area FROM seg_gt WHERE x1 > x0 AND y1 > y0),
ann_dt AS (SELECT page_id, concat_ws('.', seg_class, nullif(subtype, '')) AS category, seg_id, coalesce(nullif(conf, 0), 1.0) AS score, x0, y0, x1, y1, (x1 - x0) * (y1 - y0) AS area FROM seg_dt WHERE x1 > x0 AND y1 > y0)"""
_PAIRS = _NOTES + """,
raw AS (SELECT g.page_id, g.category, g.seg_id AS gt_id, d.seg_id AS dt_id, g.area AS gt_area, d.area AS dt_area,
  (least(g.x1, d.x1) - greatest(g.x0, d.x0)) * (least(g.y1, d.y1) - greatest(g.y0, d.y0)) AS inter
  FROM ann_gt g JOIN ann_dt d USING (page_id, category) WHERE g.x0 < d.x1 AND d.x0 < g.x1 AND g.y0 < d.y1 AND d.y0 < g.y1),
pairs AS (SELECT *, gt_area + dt_area - inter AS union_area, round(inter::DOUBLE / (gt_area + dt_area - inter), 6) AS iou, round(inter::DOUBLE / gt_area, 6) AS iogt, round(inter::DOUBLE / dt_area, 6) AS iodt FROM raw)"""
_MATCH = _PAIRS + """,
matches AS (SELECT * EXCLUDE (union_area) FROM pairs WHERE 2 * inter >= least(union_area, gt_area, dt_area)),
missed AS (
  SELECT page_id, category, 'fp' AS kind, seg_id, area FROM ann_dt a WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.page_id = a.page_id AND m.category = a.category AND m.dt_id = a.seg_id)
  UNION ALL
  SELECT page_id, category, 'fn', seg_id, area FROM ann_gt a WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.page_id = a.page_id AND m.category = a.category AND m.gt_id = a.seg_id))"""
_COUNT = _MATCH + """,
sides AS (SELECT page_id, category, sum(g)::BIGINT AS n_gt, sum(d)::BIGINT AS n_dt FROM (SELECT page_id, category, 1 AS g, 0 AS d FROM ann_gt UNION ALL SELECT page_id, category, 0, 1 FROM ann_dt) GROUP BY ALL),
partners AS (SELECT *, count(*) OVER (PARTITION BY page_id, category, gt_id) AS pg, count(*) OVER (PARTITION BY page_id, category, dt_id) AS pd FROM matches),
met AS (SELECT page_id, category, count(*) AS n_match, sum(inter)::BIGINT AS tp_area, count(DISTINCT gt_id) AS gt_met, count(DISTINCT dt_id) AS dt_met,
  count(DISTINCT gt_id) FILTER (pg > 1) AS over_gt, count(DISTINCT dt_id) FILTER (pg > 1) AS over_dt,
  count(DISTINCT gt_id) FILTER (pd > 1) AS under_gt, count(DISTINCT dt_id) FILTER (pd > 1) AS under_dt,
  sum(iou) AS sum_iou, sum(iogt) AS sum_iogt, sum(iodt) AS sum_iodt FROM partners GROUP BY ALL),
lost AS (SELECT page_id, category, coalesce(sum(area) FILTER (kind = 'fp'), 0)::BIGINT AS fp_area, coalesce(sum(area) FILTER (kind = 'fn'), 0)::BIGINT AS fn_area,
  count(*) FILTER (kind = 'fp') AS n_fp, count(*) FILTER (kind = 'fn') AS n_fn FROM missed GROUP BY ALL),
counted AS (SELECT page_id, category, n_gt, n_dt, """ + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in "n_match tp_area gt_met dt_met over_gt over_dt under_gt under_dt sum_iou sum_iogt sum_iodt fp_area fn_area n_fp n_fn".split()
) + """
  FROM sides LEFT JOIN met USING (page_id, category) LEFT JOIN lost USING (page_id, category))"""
_DECIDE = """,
ordered AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY page_id, seg_class ORDER BY (x1 - x0) * (y1 - y0), seg_id) AS k FROM seg_dup),
over AS (SELECT a.page_id, a.seg_class, a.seg_id AS a_seg_id, b.seg_id AS b_seg_id, a.area AS aa, b.area AS ba, a.k AS ak, b.k AS bk,
  a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1,
  (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter,
  2 * (greatest(a.x1, b.x1) - least(a.x0, b.x0)) * (greatest(a.y1, b.y1) - least(a.y0, b.y0))
   - greatest(0, -(a.x0 - b.x0) * (a.y0 - b.y0)) - greatest(0, -(a.x1 - b.x1) * (a.y1 - b.y1))
   - greatest(0, (a.x1 - b.x1) * (a.y0 - b.y0)) - greatest(0, (a.x0 - b.x0) * (a.y1 - b.y1)) AS hull2
  FROM ordered a JOIN ordered b ON a.page_id = b.page_id AND a.seg_class = b.seg_class AND a.k < b.k
  WHERE a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1),
decided AS (SELECT *, CASE WHEN ax0 = bx0 AND ay0 = by0 AND ax1 = bx1 AND ay1 = by1 THEN 'delete_b_equal'
  WHEN bx0 >= ax0 AND by0 >= ay0 AND bx1 <= ax1 AND by1 <= ay1 THEN 'delete_b_within'
  WHEN ax0 >= bx0 AND ay0 >= by0 AND ax1 <= bx1 AND ay1 <= by1 THEN 'delete_a_within'
  WHEN hull2 >= 2 * (aa + ba) THEN 'undecided_hull' WHEN inter > 0.9 * ba THEN 'merge_b_into_a' WHEN inter > 0.9 * aa THEN 'merge_a_into_b'
  ELSE 'undecided' END AS decision FROM over WHERE seg_class = 'TextRegion'),
written AS (SELECT page_id, CASE decision WHEN 'merge_b_into_a' THEN b_seg_id ELSE a_seg_id END AS seg_id, CASE decision WHEN 'merge_b_into_a' THEN a_seg_id ELSE b_seg_id END AS target_id, ak, bk
  FROM decided WHERE decision LIKE 'merge%'),
targets AS (SELECT page_id, seg_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id, seg_id ORDER BY ak DESC, bk DESC, target_id DESC) AS k FROM written) WHERE k = 1)"""
_LINES = _DECIDE + """,
lp AS (SELECT d.page_id, a.line_id AS a_line, b.line_id AS b_line, aa, ba, (a.x1 - a.x0) * (a.y1 - a.y0) AS la, (b.x1 - b.x0) * (b.y1 - b.y0) AS lb,
  (a.x0 + a.x1) / 2.0 > b.x0 AND (a.x0 + a.x1) / 2.0 < b.x1 AND (a.y0 + a.y1) / 2.0 > b.y0 AND (a.y0 + a.y1) / 2.0 < b.y1 AS a_in_b,
  (b.x0 + b.x1) / 2.0 > a.x0 AND (b.x0 + b.x1) / 2.0 < a.x1 AND (b.y0 + b.y1) / 2.0 > a.y0 AND (b.y0 + b.y1) / 2.0 < a.y1 AS b_in_a
  FROM decided d JOIN seg_line a ON a.page_id = d.page_id AND a.region_id = d.a_seg_id JOIN seg_line b ON b.page_id = d.page_id AND b.region_id = d.b_seg_id
  WHERE decision LIKE 'undecided%' AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)"""
_PAGES = ", pages_ AS (SELECT page_id, 'PHYS_' || lpad(page_id::VARCHAR, 9, '0') AS page_name, (['cropped,binarized', 'deskewed,grayscale_normalized', 'rotated-90,clipped'])[page_id % 3 + 1] AS features FROM (SELECT DISTINCT page_id FROM seg_gt))"
_RING = "x0 || ',' || y0 || ' ' || x1 || ',' || y0 || ' ' || x1 || ',' || y1 || ' ' || x0 || ',' || y1"
_PIXELS = "px AS (SELECT vec_id AS page_id, i % 8 AS x, i // 8 AS y, embedding[i + 1] > 0 AS fg, label AS color FROM embeddings, range(0, 64) t(i))"
_BOXES = ", boxes AS (SELECT * FROM (VALUES (0, 0, 0, 3, 3), (1, 2, 2, 6, 5)) b(box_id, x0, y0, x1, y1))"
_TREE = """tree AS (SELECT 'r' || r_regionkey AS ref, 0 AS depth, r_regionkey::BIGINT AS root, -1::BIGINT AS b, -1::BIGINT AS c FROM region
 UNION ALL SELECT 'n' || n_nationkey, 1, n_regionkey, n_nationkey, -1 FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)
 UNION ALL SELECT 's' || s_suppkey, 2, n_regionkey, n_nationkey, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
ro AS (SELECT ref, depth, root, row_number() OVER (PARTITION BY root ORDER BY b, c) AS ordinal FROM tree)"""
_COLORS = "colors(label, color) AS (VALUES ('Page', 'FFFFFF'), ('', '000000'), ('Text', '9400D3'), ('Image', '00FF00'), ('Text', '8A2BE2'))"
_LINE = "ln AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL)"


def _with(extra: str, body: str) -> str:
    return f"WITH {LAYOUT}{extra}\n{body}"


def _level(column: str, m: int, name: str) -> str:
    return f"CASE WHEN {column} % {m} IN (0, 1) THEN NULL ELSE '{name}' || {column} END"


ORACLE_SQL: dict[str, str] = {
    "annotations": _with(_NOTES, "SELECT * FROM ann_dt"),
    "category_label": _with("", "SELECT page_id, seg_id, CASE WHEN subtype IS NULL OR subtype = '' THEN seg_class ELSE seg_class || ':' || subtype END AS category FROM seg_gt"),
    "category_select": _with(_NOTES, "SELECT page_id, seg_id, category FROM ann_gt WHERE category IN ('TextRegion.heading', 'TableRegion')"),
    "iou_pairs": _with(_PAIRS, "SELECT * FROM pairs"),
    "segment_matches": _with(_MATCH, "SELECT * FROM matches"),
    "misses": _with(_MATCH, "SELECT * FROM missed"),
    "fp_fn": _with(_COUNT, "SELECT page_id, category, n_fp, fp_area, n_fn, fn_area FROM counted WHERE n_fp + n_fn > 0"),
    "over_under_image": _with(_COUNT, "SELECT page_id, category, round((over_gt * over_dt)::DOUBLE / (n_gt * n_dt), 6) AS oversegmentation, round((under_gt * under_dt)::DOUBLE / (n_gt * n_dt), 6) AS undersegmentation FROM counted WHERE n_gt > 0 AND n_dt > 0"),
    "pr_image": _with(_COUNT, "SELECT page_id, category, round((n_dt - n_fp)::DOUBLE / n_dt, 6) AS precision, round((n_gt - n_fn)::DOUBLE / n_gt, 6) AS recall FROM counted WHERE n_gt > 0 AND n_dt > 0"),
    "pixel_image": _with(_COUNT, "SELECT page_id, category, round(tp_area::DOUBLE / (tp_area + fp_area), 6) AS pixel_precision, round(tp_area::DOUBLE / (tp_area + fn_area), 6) AS pixel_recall, round(tp_area::DOUBLE / (tp_area + fp_area + fn_area), 6) AS pixel_iou FROM counted WHERE tp_area > 0 OR (fp_area > 0 AND fn_area > 0)"),
    "category_stats": _with(_COUNT, """, t AS (SELECT category, """.replace(", t AS", ", t AS") + ", ".join(f"sum({c})::{'DOUBLE' if c.startswith('sum') else 'BIGINT'} AS {c}" for c in "n_gt n_dt n_match tp_area over_gt over_dt under_gt under_dt sum_iou sum_iogt sum_iodt fp_area fn_area n_fp n_fn".split()) + """ FROM counted GROUP BY category)
SELECT category, """ + ", ".join(
        f"round(CASE WHEN {w} THEN ({a})::DOUBLE / ({b}) ELSE -1.0 END, 5) AS {n}" for n, w, a, b in (
            ("oversegmentation", "n_gt > 0 AND n_dt > 0", "over_gt * over_dt", "n_gt * n_dt"), ("undersegmentation", "n_gt > 0 AND n_dt > 0", "under_gt * under_dt", "n_gt * n_dt"),
            ("segment_precision", "n_gt > 0 AND n_dt > 0", "n_dt - n_fp", "n_dt"), ("segment_recall", "n_gt > 0 AND n_dt > 0", "n_gt - n_fn", "n_gt"),
            ("iou", "n_match > 0", "sum_iou", "n_match"), ("iogt", "n_match > 0", "sum_iogt", "n_match"), ("iodt", "n_match > 0", "sum_iodt", "n_match"),
            ("pixel_precision", "tp_area > 0 OR (fp_area > 0 AND fn_area > 0)", "tp_area", "tp_area + fp_area"), ("pixel_recall", "tp_area > 0 OR (fp_area > 0 AND fn_area > 0)", "tp_area", "tp_area + fn_area"), ("pixel_iou", "tp_area > 0 OR (fp_area > 0 AND fn_area > 0)", "tp_area", "tp_area + fp_area + fn_area"))
    ) + " FROM t"),
    "score_rank": _with(_NOTES, "SELECT page_id, category, seg_id, score, row_number() OVER (PARTITION BY page_id, category ORDER BY score DESC, seg_id)::INT AS rank FROM ann_dt"),
    "category_encode": _with(_NOTES, "SELECT category, row_number() OVER (ORDER BY p, s)::INT AS category_id FROM (SELECT category, page_id AS p, min(seg_id) AS s FROM ann_gt a WHERE page_id = (SELECT min(page_id) FROM ann_gt b WHERE b.category = a.category) GROUP BY ALL) UNION ALL SELECT 'bg', 0"),
    "dense_ids": _with(_NOTES, "SELECT page_id, seg_id, row_number() OVER (ORDER BY page_id, seg_id) AS ann_id FROM ann_gt"),
    "page_pairs": _with("", "SELECT coalesce(g.page_id, d.page_id) AS page_id, CASE WHEN g.page_id IS NULL THEN 'no_gt' WHEN d.page_id IS NULL THEN 'no_dt' ELSE 'both' END AS status FROM (SELECT DISTINCT page_id FROM seg_gt) g FULL JOIN (SELECT DISTINCT page_id FROM seg_dt) d ON g.page_id = d.page_id"),
    "coco_unmatched": _with("", "SELECT DISTINCT page_id FROM seg_gt WHERE page_id NOT IN (SELECT page_id FROM seg_dt)"),
    "overlap_pairs": _with(_DECIDE, "SELECT page_id, seg_class, a_seg_id, b_seg_id, inter, hull2 FROM over"),
    "redundancy_class": _with(_DECIDE, "SELECT page_id, a_seg_id, b_seg_id, decision FROM decided"),
    "apply_deletes": _with(_DECIDE, "SELECT page_id, seg_id FROM seg_dup s WHERE NOT EXISTS (SELECT 1 FROM decided d WHERE d.page_id = s.page_id AND ((d.decision LIKE 'delete_a%' AND d.a_seg_id = s.seg_id) OR (d.decision LIKE 'delete_b%' AND d.b_seg_id = s.seg_id)))"),
    "merge_cascade": _with(_DECIDE, "SELECT l.page_id, l.region_id, l.line_id, t.target_id FROM seg_line l JOIN targets t ON t.page_id = l.page_id AND t.seg_id = l.region_id"),
    "line_pairs": _with(_LINES, "SELECT page_id, a_line, b_line, a_in_b, b_in_a FROM lp"),
    "line_actions": _with(_LINES, """SELECT page_id, CASE WHEN a_in_b OR b_in_a THEN 'merge' ELSE 'split' END AS action,
 CASE WHEN a_in_b OR b_in_a THEN CASE WHEN aa > ba THEN b_line ELSE a_line END ELSE CASE WHEN la > lb THEN a_line ELSE b_line END END AS line_id,
 CASE WHEN a_in_b OR b_in_a THEN CASE WHEN aa > ba THEN a_line ELSE b_line END ELSE CASE WHEN la > lb THEN b_line ELSE a_line END END AS other_id FROM lp"""),
    "clip_to_parent": _with("", "SELECT page_id, seg_id, CASE WHEN k THEN a END AS x0, CASE WHEN k THEN b END AS y0, CASE WHEN k THEN c END AS x1, CASE WHEN k THEN d END AS y1 FROM (SELECT *, c > a AND d > b AS k FROM (SELECT c.page_id, c.seg_id, greatest(c.x0, p.x0) AS a, greatest(c.y0, p.y0) AS b, least(c.x1, p.x1) AS c, least(c.y1, p.y1) AS d FROM seg_dt c JOIN seg_gt p ON p.page_id = c.page_id AND p.seg_id = c.seg_id[1:-2]))"),
    "parent_consistency": _with("", "SELECT c.page_id, p.seg_id AS parent_id, c.seg_id, CASE WHEN c.x0 >= p.x0 AND c.y0 >= p.y0 AND c.x1 <= p.x1 AND c.y1 <= p.y1 THEN 'none' WHEN c.x0 < p.x1 AND p.x0 < c.x1 AND c.y0 < p.y1 AND p.y0 < c.y1 THEN 'clip' ELSE 'drop' END AS action FROM seg_dt c JOIN seg_gt p ON p.page_id = c.page_id AND p.seg_id = c.seg_id[1:-2]"),
    "neighbor_overlap": _with("", """, n AS (SELECT a.page_id, a.seg_id AS a_seg_id, b.seg_id AS b_seg_id, a.seg_class = b.seg_class AS alike, (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ba,
 (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter FROM seg_gt a JOIN seg_gt b ON a.page_id = b.page_id AND a.seg_id < b.seg_id WHERE a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
SELECT page_id, a_seg_id, b_seg_id, CASE WHEN alike THEN 'iou' ELSE 'within' END AS kind, round(CASE WHEN alike THEN inter::DOUBLE / (aa + ba - inter) ELSE least(aa, ba)::DOUBLE / greatest(aa, ba) END, 6) AS value FROM n WHERE alike OR inter = least(aa, ba)"""),
    "project_bbox": _with("", "SELECT page_id, region_id AS parent_id, greatest(min(x0) - 5, 0) AS x0, greatest(min(y0) - 5, 0) AS y0, least(max(x1) + 5, 1400) AS x1, least(max(y1) + 5, 900) AS y1 FROM seg_line GROUP BY ALL"),
    "attr_inherit": _with("", f"SELECT page_id, seg_id, coalesce({_level('x0', 3, 'own')}, {_level('y0', 5, 'region')}, {_level('page_id', 2, 'page')}) AS value FROM seg_dup"),
    "flatten_tree": f"WITH {_LINE}, w AS (SELECT page_id, line, unnest(string_split(text, ' ')) AS word_text, unnest(range(0, len(string_split(text, ' ')))) AS word FROM ln) SELECT page_id, line::INT AS line, word::INT AS word, word_text AS text FROM w WHERE word_text <> ''",
    "line_filter": _with("", "SELECT page_id, line_id, repeat('x', x0 % 30) AS text FROM seg_line WHERE x0 % 30 >= 8 AND x1 - x0 >= 60 AND y1 - y0 >= 15"),
    "textequiv_pick": "SELECT conv_id AS page_id, turn AS line, CASE WHEN turn % 3 = 0 THEN '' ELSE text || '*' END AS text FROM conversations WHERE turn % 3 = 0 OR (turn % 3 = 1 AND text IS NOT NULL)",
    "textequiv_last": "SELECT conv_id AS page_id, turn AS line, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN text || '*' ELSE text END AS text FROM conversations WHERE turn % 3 = 0 OR text IS NOT NULL",
    "text_insert": "SELECT conv_id AS page_id, turn, CASE WHEN turn % 2 = 0 THEN ['new ' || turn, text] ELSE [text] END AS alternatives FROM conversations",
    "class_filter": _with("", "SELECT page_id, seg_id FROM seg_gt WHERE seg_class = 'TextRegion'"),
    "page_numeric_id": _with(_PAGES, "SELECT page_name, page_id AS page_number FROM pages_"),
    "dpi_norm": _with(_PAGES, "SELECT page_id, (CASE WHEN page_id % 400 = 0 THEN NULL WHEN page_id % 2 = 0 THEN round_even((page_id % 400 + 1) * 2.54, 0) ELSE page_id % 400 + 1 END)::INT AS dpi FROM pages_"),
    "feature_subtract": _with(_PAGES, "SELECT page_id, array_to_string(list_filter(string_split(features, ','), lambda f: f NOT IN ('cropped', 'deskewed') AND NOT starts_with(f, 'rotated-')), ',') AS features FROM pages_"),
    "feature_extension": _with(_PAGES, "SELECT page_id, CASE WHEN features LIKE '%binarized%' THEN '.bin' WHEN features LIKE '%grayscale_normalized%' THEN '.nrm' ELSE '.raw' END AS extension FROM pages_"),
    "output_path": _with("", "SELECT page_id, line_id, 'FILE_' || page_id || '_' || region_id || '_' || line_id || '.raw.png' AS path FROM seg_line"),
    "subtype_resolve": _with("", "SELECT page_id, seg_id, CASE WHEN subtype IN ('paragraph', 'heading') THEN subtype WHEN subtype IS NOT NULL THEN 'other' END AS type, CASE WHEN subtype NOT IN ('paragraph', 'heading') THEN 'subtype:' || subtype END AS custom FROM seg_gt"),
    "category_map": _with("", "SELECT page_id, seg_id, CASE WHEN subtype IN ('paragraph', 'heading') THEN 'TextRegion' END AS mapped_class, CASE WHEN subtype IN ('paragraph', 'heading') THEN subtype END AS mapped_type FROM seg_gt"),
    "color_decode": f"WITH {_COLORS} SELECT label, color, ('0x' || color[1:2])::BIGINT AS red, ('0x' || color[3:4])::BIGINT AS green, ('0x' || color[5:6])::BIGINT AS blue, ('0x' || color)::BIGINT AS packed FROM colors",
    "colordict_inverse": f"WITH {_COLORS} SELECT label, min(color) AS color FROM colors WHERE label <> '' GROUP BY label",
    "coco_export": _with("", "SELECT page_id AS image_id, seg_id, [x0, y0, x1, y0, x1, y1, x0, y1] AS ring, [x0, y0, x1 - x0, y1 - y0] AS bbox, (x1 - x0) * (y1 - y0) AS area, 0 AS iscrowd FROM seg_gt"),
    "page_region_json": _with("", """SELECT page_id, '[' || string_agg('{"id":"' || seg_id || '","type":"' || seg_class || '","x0":' || x0 || ',"y0":' || y0 || ',"x1":' || x1 || ',"y1":' || y1 || '}', ',' ORDER BY seg_id) || ']' AS regions FROM seg_gt GROUP BY page_id"""),
    "reading_order_flat": f"WITH {_TREE} SELECT ref, depth, root, ordinal::INT AS ordinal FROM ro",
    "reading_order_arrows": f"WITH {_TREE} SELECT * FROM (SELECT root, ref, lead(ref) OVER (PARTITION BY root ORDER BY ordinal) AS next, depth FROM ro) WHERE next IS NOT NULL",
    "reading_order_reindex": f"WITH {_TREE} SELECT root, ref, (row_number() OVER (PARTITION BY root ORDER BY ordinal) - 1)::INT AS idx FROM ro WHERE ref NOT LIKE '%3'",
    "points_roundtrip": _with("", f"SELECT page_id, seg_id, {_RING} AS points FROM seg_gt"),
    "poly_measures": _with("", "SELECT page_id, seg_id, round(((x1 - x0) * (y1 - y0))::DOUBLE, 3) AS area, round((2 * (x1 - x0 + y1 - y0))::DOUBLE, 3) AS perimeter, round((x0 + x1) / 2.0::DOUBLE, 3) AS cx, round((y0 + y1) / 2.0::DOUBLE, 3) AS cy FROM seg_gt"),
    "poly_bbox": _with("", "SELECT page_id, seg_id, x0::DOUBLE AS x, y0::DOUBLE AS y, (x1 - x0)::DOUBLE AS w, (y1 - y0)::DOUBLE AS h FROM seg_gt"),
    "coords_rel_abs": _with(", moved AS (SELECT page_id, seg_id, x0 + 10 AS x0, y0 + 20 AS y0, x1 + 10 AS x1, y1 + 20 AS y1 FROM seg_gt)", f"SELECT page_id, seg_id, {_RING} AS points FROM moved"),
    "replace_page": _with("", "SELECT page_id, 1400 AS width, 900 AS height, seg_id, seg_class FROM seg_dt WHERE page_id IN (SELECT page_id FROM seg_gt)"),
    "text_attach": _with(_PAGES, """, f AS (SELECT page_id, page_name || '_' || seg_id AS stem FROM seg_dup JOIN pages_ USING (page_id)),
 m AS (SELECT DISTINCT stem, s.seg_id, s.seg_class, s.x0 FROM f JOIN seg_dup s USING (page_id) WHERE suffix(stem, s.seg_id)),
 r AS (SELECT stem, seg_id, row_number() OVER (PARTITION BY stem ORDER BY CASE seg_class WHEN 'TextRegion' THEN 0 ELSE 1 END, x0, seg_id) AS k, count(*) OVER (PARTITION BY stem) AS n FROM m)
SELECT stem || '.gt.txt' AS path, seg_id, n > 1 AS ambiguous FROM r WHERE k = 1"""),
    "text_update_counts": _with("", "SELECT seg_class, count(*) FILTER (x0 % 3 = 0) AS updated, count(*) FILTER (x0 % 3 <> 0) AS missing FROM seg_dup GROUP BY seg_class"),
    "mask_colors": f"WITH {_PIXELS} SELECT color, count(*) AS n, color = 0 AS background FROM px GROUP BY color",
    "class_masks": f"WITH {_PIXELS} SELECT page_id, color, min(x)::INT AS x0, min(y)::INT AS y0, max(x)::INT AS x1, max(y)::INT AS y1, count(*) AS area FROM px WHERE fg AND color <> 0 GROUP BY ALL",
    "glyph_scale": _with("", "SELECT page_id, coalesce(floor(median(CASE WHEN v > 5 AND v < 100 THEN v END)), 43)::INT AS scale FROM (SELECT page_id, sqrt(3 * (x1 - x0) * 7) AS v FROM seg_gt) GROUP BY page_id"),
    "mask_foreground": f"WITH {_PIXELS}{_BOXES} SELECT page_id, box_id, count(*) AS n FROM px, boxes WHERE fg AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL",
    "shrink_to_foreground": f"WITH {_PIXELS}{_BOXES} SELECT page_id, box_id, min(x)::INT AS x0, min(y)::INT AS y0, max(x)::INT AS x1, max(y)::INT AS y1 FROM px, boxes WHERE fg AND x BETWEEN boxes.x0 AND boxes.x1 AND y BETWEEN boxes.y0 AND boxes.y1 GROUP BY ALL",
}
ORACLE_SQL |= more_sql(_DECIDE, _LINES)
