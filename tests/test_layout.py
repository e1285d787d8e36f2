"""Layout queries against their SQL, and the rules on small hand-made pages."""

from __future__ import annotations

import duckdb
import pytest

from folioscope.operators import evaluate as ev, repair as re
from folioscope.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "segment_matches", "misses", "category_stats", "redundancy_class", "apply_deletes", "line_actions", "dense_ids",
    "parent_consistency", "reading_order_reindex", "text_attach", "poly_measures", "page_numeric_id", "class_masks",
    "regions_recursive", "text_regions_union", "style_inherit", "presentation_url", "merge_child_order", "merge_conflicts", "enlarge_parents",
    "line_sheet", "rebase_original", "scan_page_xml", "filelist_scan", "coco_ingest", "coco_page_match", "coco_category_lookup", "merge_outline",
    "apply_splits", "apply_merges", "project_hull", "simplify_resample", "simplify_guard", "segment_validity", "error_resolve", "ensure_valid",
    "clip_to_parent", "mask_pack", "components", "contour_filter", "component_scale", "painter_mask", "textequiv_pick", "textequiv_last",
    "text_insert", "category_map", "line_filter", "pixel_image", "over_under_image", "fp_fn",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "supplier", "lineitem", "documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(str(float(r[k])) if isinstance(r[k], (int, float)) and not isinstance(r[k], bool) else str(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_gives_what_its_sql_gives(spark, duck, name):
    found = QUERIES[name](spark, SF)
    asked = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, asked.fetchall())


def segments(spark, *boxes):
    return spark.createDataFrame(
        [(1, f"s{k}", "TextRegion", None, 0.0, *b) for k, b in enumerate(boxes)],
        "page_id long, seg_id string, seg_class string, subtype string, conf double, x0 long, y0 long, x1 long, y1 long",
    )


def test_exactly_half_is_a_match_and_touching_is_none(spark):
    gt = ev.annotations(segments(spark, (0, 0, 10, 10), (100, 0, 110, 10)))
    dt = ev.annotations(segments(spark, (5, 0, 15, 10), (110, 0, 120, 10), (3, 3, 3, 9)))
    assert [r.score for r in dt.collect()] == [1.0, 1.0]
    pairs = ev.segment_matches(ev.iou_pairs(gt, dt)).collect()
    assert [(r.gt_id, r.dt_id, r.inter) for r in pairs] == [("s0", "s0", 50)]


def test_undefined_scores_are_minus_one(spark):
    gt, dt = ev.annotations(segments(spark, (0, 0, 10, 10))), ev.annotations(segments(spark))
    row = ev.category_stats(ev.counts(gt, dt, ev.segment_matches(ev.iou_pairs(gt, dt)))).first()
    assert (row.segment_precision, row.iou, row.pixel_iou) == (-1.0, -1.0, -1.0)


def test_pair_rules(spark):
    def decide(a, b):
        return re.classify(re.overlap_pairs(segments(spark, a, b))).first()["decision"]

    assert decide((0, 0, 9, 9), (0, 0, 9, 9)) == "delete_b_equal"
    assert decide((2, 2, 5, 5), (0, 0, 9, 9)) == "delete_a_within"
    assert decide((0, 0, 10, 10), (0, 1, 10, 11)) == "undecided"
    assert decide((0, 0, 100, 100), (0, 1, 100, 101)) == "merge_b_into_a"


def test_deletes_are_idempotent(spark):
    once = segments(spark, (0, 0, 9, 9), (0, 0, 9, 9), (2, 2, 5, 5), (50, 50, 60, 60))
    for _ in range(2):
        once = re.apply_deletes(once, re.classify(re.overlap_pairs(once)))
        assert sorted(r.seg_id for r in once.collect()) == ["s0", "s3"]
