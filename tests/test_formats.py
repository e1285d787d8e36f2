"""Sources and sinks, general outlines, trees, average precision and the processors' functions, on small pages."""

from __future__ import annotations

import json

import numpy as np
import pytest

import folioscope
from folioscope.functions import polygon
from folioscope.operators import evaluate as ev, outlines as ol, tree as tr
from folioscope.sources import coco, lists, page_xml

PAGE = """<?xml version="1.0"?><PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15">
<Page imageFilename="scan/a.tif" imageWidth="100" imageHeight="200"><Border><Coords points="0,0 99,0 99,199 0,199"/></Border>
<TableRegion id="t1"><Coords points="1,1 50,1 50,50 1,50" conf="0.5"/><TextRegion id="r1" type="caption"><Coords points="2,2 9,2 9,9 2,9"/>
<TextLine id="l1"><Coords points="2,2 9,2 9,5 2,5"/><TextEquiv><Unicode>a &amp; b</Unicode></TextEquiv></TextLine></TextRegion></TableRegion>
<TextRegion id="r2" custom="subtype:x"><Coords points=""/></TextRegion></Page></PcGts>"""


def rect(a, b, c, d):
    return [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]


def text(*box):
    return ol.text_of(rect(*box))


def test_page_xml_is_read_and_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xml").write_text(PAGE)
    (tmp_path / "in/bad.xml").write_text("<PcGts><Page>")
    rows = page_xml.scan(spark, str(tmp_path / "in")).cache()
    good = [r for r in rows.orderBy("pos").collect() if r.page_id == "a"]
    assert [(r.level, r.seg_id, r.parent_id, r.seg_class, r.depth) for r in good] == [
        ("border", None, None, "Border", 0), ("region", "t1", None, "TableRegion", 0), ("region", "r1", "t1", "TextRegion", 1),
        ("line", "l1", "r1", "TextLine", 2), ("region", "r2", None, "TextRegion", 0),
    ]
    assert (good[1].conf, good[3].text, good[4].custom, good[0].width) == (0.5, "a & b", "subtype:x", 100)
    assert [bool(r.error) for r in rows.collect() if r.page_id == "bad"] == [True]
    page_xml.write(rows, str(tmp_path / "out"))
    again = page_xml.scan(spark, str(tmp_path / "out/page_id=a")).drop("page_id").orderBy("pos").collect()
    assert again == rows.where("page_id = 'a'").drop("page_id").orderBy("pos").collect()


def test_annotation_json(spark, tmp_path):
    doc = {
        "categories": [{"id": 1, "name": "text"}, {"id": 2, "name": "caption", "supercategory": "text", "source": "PAGE"}],
        "images": [{"id": 7, "file_name": "a.tif", "width": 9, "height": 9}],
        "annotations": [{"id": k, "image_id": i, "category_id": c, "segmentation": [[0, 0, 4, 0, 4, 4]], "area": 8, "bbox": [0, 0, 4, 4], "iscrowd": 0} for k, i, c in ((1, 7, 1), (2, 7, 2), (3, 8, 1), (4, 7, 9))],
    }
    (tmp_path / "c.json").write_text(json.dumps(doc))
    rows = coco.ingest(coco.read(spark, str(tmp_path / "c.json"))).orderBy("ann_id").collect()
    assert [(r.ann_id, r.file_name, r.category, r.subcategory, r.points, r.source) for r in rows] == [(1, "a.tif", "text", None, "0,0 4,0 4,4", "PAGE"), (2, "a.tif", "text", "caption", "0,0 4,0 4,4", "PAGE")]


def test_lists_and_texts(spark, tmp_path):
    (tmp_path / "files.tsv").write_text("a.xml\tb.xml\nc.xml\td.xml\n")
    rows = lists.filelist(lists.read_lines(spark, str(tmp_path / "files.tsv"))).orderBy("row").collect()
    assert [(r.gt, r.dt, r.image) for r in rows] == [("a.xml", "b.xml", None), ("c.xml", "d.xml", None)]
    (tmp_path / "bad.tsv").write_text("a\tb\nc\td\te\n")
    with pytest.raises(Exception, match="columns"):
        lists.filelist(lists.read_lines(spark, str(tmp_path / "bad.tsv"))).collect()
    (tmp_path / "p_r1.gt.txt").write_text(" word \n")
    assert [r.text for r in lists.text_glob(spark, str(tmp_path / "*.gt.txt")).collect()] == ["word"]
    one = spark.createDataFrame([(0, "a"), (1, "b")], "row int, line string")
    assert lists.parallel(one, one).count() == 2
    with pytest.raises(Exception, match="lengths"):
        lists.parallel(one, one.where("row = 0")).collect()


def test_overlays_against_counted_pixels():
    rng = np.random.default_rng(3)
    for _ in range(40):
        boxes = [rect(x, y, x + w, y + h) for x, y, w, h in rng.integers(1, 20, (3, 4)).tolist()]
        masks = np.zeros((3, 50, 50), bool)
        for m, b in zip(masks, boxes, strict=True):
            m[int(b[0][1]) : int(b[2][1]), int(b[0][0]) : int(b[2][0])] = True
        parts = polygon.difference(boxes[0], boxes[1])
        assert sum(map(polygon.area, parts)) == (masks[0] & ~masks[1]).sum() or (masks[1] & ~masks[0]).sum() and len(parts) <= 1
        joint = polygon.join(boxes)
        assert polygon.is_simple(joint) and polygon.area(joint) >= masks.any(axis=0).sum() * 0.99
        spread = polygon.spread(boxes, 2)
        assert all(polygon.area(r) >= polygon.area(b) for r, b in zip(spread, boxes, strict=True))


def test_bridges_are_a_least_tree():
    rng = np.random.default_rng(5)
    rings = [rect(x, y, x + 3, y + 3) for x, y in rng.integers(0, 100, (9, 2)).tolist()]
    d = {(i, j): polygon.distance(rings[i], rings[j])[0] for i in range(9) for j in range(i)}
    root = list(range(9))
    total = 0.0
    for (i, j), size in sorted(d.items(), key=lambda x: x[1]):
        a, b = root[i], root[j]
        if a != b:
            total += size
            root = [a if r == b else r for r in root]
    assert abs(sum(e[2] for e in polygon.bridges(rings)) - total) < 1e-9


def test_repaired_outlines_are_simple():
    rng = np.random.default_rng(7)
    for n in (2, 3, 4, 6, 9):
        for _ in range(10):
            assert polygon.is_simple(polygon.make_valid([tuple(p) for p in rng.integers(0, 30, (n, 2)).astype(float).tolist()]))
    bow = [(0.0, 0.0), (50.0, 60.0), (50.0, 0.0), (0.0, 60.0)]
    assert polygon.problem(np.array(bow)) == "self-intersection" and polygon.area(polygon.make_valid(bow)) == 3000
    assert polygon.problem(np.array(rect(0, 0, 5, 5))) is None and polygon.problem(np.array(rect(-1, 0, 5, 5))) == "negative"


def test_hull_holds_all_points():
    points = [tuple(p) for p in np.random.default_rng(1).integers(0, 50, (40, 2)).astype(float).tolist()]
    hull = polygon.hull(points)
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    assert all(turn(a, b, p) >= 0 for a, b in zip(hull, hull[1:] + hull[:1], strict=True) for p in points)


def segments(spark, *boxes):
    return spark.createDataFrame([(1, f"s{k}", "TextRegion", None, c, *b) for k, (c, b) in enumerate(boxes)], "page_id long, seg_id string, seg_class string, subtype string, conf double, x0 long, y0 long, x1 long, y1 long")


def average_precision(gt, dt, threshold):
    """One category, all areas: greedy matches by score, precision read at 101 recalls."""
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inter = max(w, 0) * max(h, 0)
        return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)

    left, hits = set(range(len(gt))), []
    for _, box in sorted(dt, key=lambda x: -x[0]):
        best = max(((iou(gt[k], box), -k) for k in left), default=(0, 0))
        hits.append(best[0] >= threshold)
        if hits[-1]:
            left.discard(-best[1])
    tp, fp = np.cumsum(hits), np.cumsum(~np.array(hits))
    recall, precision = tp / len(gt), tp / (tp + fp)
    return sum(max((p for r, p in zip(recall, precision, strict=True) if r >= k / 100 - 1e-12), default=0) for k in range(101)) / 101, float(recall[-1])


def test_average_precision(spark):
    rng = np.random.default_rng(11)
    gt = [(x, y, x + 40, y + 30) for x, y in rng.integers(0, 400, (12, 2)).tolist()]
    dt = [(float(s), (a + int(j), b, c + int(j), d)) for (a, b, c, d), s, j in zip(gt, rng.permutation(12) / 20 + 0.1, rng.integers(0, 25, 12), strict=True)]
    a, b = ev.annotations(segments(spark, *((1.0, g) for g in gt))), ev.annotations(segments(spark, *dt))
    rows = {r.metric: r.value for r in ev.coco_ap(a, b, ev.iou_pairs(a, b)).collect()}
    every = [average_precision(gt, dt, t) for t in ev.THRESHOLDS]
    assert abs(rows["AP all"] - np.mean([x[0] for x in every])) < 1e-6 and abs(rows["AR all"] - np.mean([x[1] for x in every])) < 1e-6
    assert abs(rows["AP 0.75 all"] - average_precision(gt, dt, 0.75)[0]) < 1e-6
    assert rows["AP large"] == -1.0 and rows["AP medium"] == rows["AP all"]


def test_regions_to_a_depth(spark):
    rows = spark.createDataFrame([(1, "a", None, "TableRegion"), (1, "b", "a", "TextRegion"), (1, "c", "b", "TextRegion"), (2, "b", None, "TextRegion")], "page_id long, seg_id string, parent_id string, seg_class string")
    assert sorted((r.page_id, r.path) for r in tr.regions_recursive(rows).collect()) == [(1, "a"), (1, "a/b"), (1, "a/b/c"), (2, "b")]
    assert sorted(r.path for r in tr.regions_recursive(rows, ["TextRegion"], 2).collect()) == ["a/b", "b"]


def test_processors(spark):
    gt = segments(spark, (1.0, (0, 0, 10, 10)), (1.0, (20, 0, 30, 10)))
    report = folioscope.evaluate(gt, gt)
    assert report["by_category"].first().segment_precision == 1.0 and {r.metric: r.value for r in report["scores"].collect()}["AP all"] == 1.0
    twice = segments(spark, (1.0, (0, 0, 10, 10)), (1.0, (0, 0, 10, 10)), (1.0, (-5, 50, 20, 60)), (1.0, (5, 5, 5, 9)))
    kept = folioscope.repair(twice, folioscope.RepairParams(plausibilize=True)).collect()
    assert sorted((r.seg_id, r.x0) for r in kept) == [("s0", 0), ("s2", 0)]
    lines = spark.createDataFrame([(1, "p", "a", text(0, 0, 9, 9)), (1, "p", "b", text(0, 9, 9, 20))], "page_id long, parent_id string, seg_id string, points string")
    assert folioscope.project(lines).first().area == 180 == folioscope.project(lines, folioscope.ProjectParams(convex=True)).first().area
    with pytest.raises(ValueError, match="merge_threshold"):
        folioscope.RepairParams(merge_threshold=2)
