"""Batches of outlines against the kernels for single ones, and groups that are cut by batches (findings of round 3)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.functions import boxes, flat, polygon
from folioscope.operators import evaluate as ev, groups, outlines as ol, raster as ra, repair as re, tree as tr


def rect(a, b, c, d):
    return [(float(a), float(b)), (float(c), float(b)), (float(c), float(d)), (float(a), float(d))]


def some_rings(count=600):
    rng = np.random.default_rng(1)
    out = []
    for k in range(count):
        n = int(rng.integers(0, 14))
        ring = [tuple(map(float, p)) for p in rng.integers(-1, (3, 6, 30)[k % 3], (n, 2))]
        ring = polygon.hull(ring) if k % 4 == 0 else ring
        ring = ring[:1] * 2 + ring[1:] if k % 5 == 0 else ring
        out.append([(x + 0.5, y) for x, y in ring] if k % 50 == 7 else ring)
    return out


def texts(rings):
    return [" ".join(f"{x:g},{y:g}" for x, y in r) for r in rings]


def some_pages(spark, count=60):
    """Pages of one to six outlines, mostly rectangles, by page; the rows as a table."""
    rng = np.random.default_rng(2)
    pages = {}
    for k in range(count):
        boxes_ = [rect(x, y, x + w, y + h) for x, y, w, h in rng.integers(1, (12, 40)[k % 2], (int(rng.integers(1, 7)), 4)).tolist()]
        if k % 3 == 0:
            boxes_ = [rect(3, 5 * i, 20, 5 * i + 5) for i in range(len(boxes_))]
        if k % 7 == 0:
            boxes_[0] = [(1.0, 1.0), (9.0, 2.0), (4.0, 8.0)]
        pages[k] = boxes_
    rows = [(k, 1, f"s{i}", ol.text_of(r)) for k, page in pages.items() for i, r in enumerate(page)]
    return pages, spark.createDataFrame(rows, "page_id long, parent_id long, seg_id string, points string").repartition(3)


@pytest.fixture
def small_batches(spark, monkeypatch):
    """Batches of three rows, so that pages are cut by them, and kernels that get the whole pages of each."""
    monkeypatch.setattr(groups, "LEAST", 1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    yield
    spark.conf.set(key, before)


def test_f1_repair_of_batches(spark):
    rings = some_rings()
    given = flat.of_texts(pa.array(texts(rings)))
    assert [given.ring(k) for k in range(len(rings))] == rings
    assert flat.simple(given).tolist() == [bool(polygon.is_simple(r)) for r in rings]
    rows = spark.createDataFrame([(k, f"s{k}", t) for k, t in enumerate([*texts(rings), "01,2  3,4 5,1", None])], "page_id long, seg_id string, points string")
    found = {r.page_id: (r.points, r.changed) for r in ol.make_valid(rows).collect()}
    for k, r in enumerate(rings):
        out = polygon.make_valid(r) if r else r
        assert found[k] == (ol.text_of(out), out != r)
    assert (found[len(rings)], found[len(rings) + 1]) == (("1,2 3,4 5,1", False), ("", False))


def test_f2_joint_outlines_of_batches(spark, small_batches):
    pages, rows = some_pages(spark)
    found = {r.page_id: (r.points, r.area) for r in ol.project_hull(rows).collect()}
    assert found == {k: (ol.text_of(out := polygon.join(p)), polygon.area(out)) for k, p in pages.items()}


def test_f3_resampling_of_batches(spark):
    rings = [r for r in some_rings() if r] + [rect(0, 0, 10, 5), [(0.0, 0.0)], rect(0, 0, 4000, 7)]
    out = flat.resample(flat.of_texts(pa.array(texts(rings))), 2.5)
    for k, r in enumerate(rings):
        size = [float(np.hypot(b[0] - a[0], b[1] - a[1])) for a, b in zip(r, r[1:] + r[:1], strict=True)]
        begun = [0.0]
        for s in size:
            begun.append(begun[-1] + s)
        want = []
        for s in (2.5 * i for i in range(max(int(np.ceil(begun[-1] / 2.5 - 1e-9)) - 1, 0) + 1)):
            e = min(sum(b <= s for b in begun), len(r)) - 1
            t, (ax, ay), (bx, by) = (s - begun[e]) / max(size[e], 1e-12), r[e], r[(e + 1) % len(r)]
            want.append((ax + (bx - ax) * t, ay + (by - ay) * t))
        assert out.ring(k) == want


def test_f3_resampling_leaves_out_in_the_same_pass(spark):
    many = [(float(x), 0.0) for x in range(0, 100, 10)] + [(100.0, 60.0), (0.0, 60.0)]
    rows = spark.createDataFrame([("a", many), ("b", rect(0, 0, 100, 60)), ("c", None)], "id string, ring array<struct<x:double,y:double>>")
    every = {r.id: r for r in ol.resample(rows, 30).select("id", "ring", ol.sums(F.col("ring")).alias("s")).collect()}
    assert (every["c"].ring, len(every["b"].ring), every["b"].s) == (None, 11, (sum(p.x for p in every["b"].ring), sum(p.y for p in every["b"].ring)))
    assert [r.id for r in ol.resample(rows, 30, every=False).collect()] == ["a"]


def test_f4_trees_of_batches(spark, small_batches):
    pages, rows = some_pages(spark)
    found: dict = {k: [] for k in pages}
    for r in ol.mst_bridges(rows).collect():
        found[r.page_id].append((r.a, r.b, r.distance))
    assert found == {k: [(f"s{i}", f"s{j}", round(d, 3)) for i, j, d, _, _ in polygon.bridges(p)] for k, p in pages.items()}


def test_f5_spread_of_batches(spark, small_batches):
    pages, rows = some_pages(spark)
    found = {(r.page_id, r.seg_id): (r.points, r.area) for r in ol.spread(rows, 2).collect()}
    assert found == {(k, f"s{i}"): (ol.text_of(out), polygon.area(out)) for k, p in pages.items() for i, out in enumerate(polygon.spread(p, 2))}


def test_f7_f9_problems_of_batches(spark):
    rings = some_rings()
    assert flat.problems(flat.of_texts(pa.array(texts(rings)))) == [polygon.problem(np.array(r).reshape(-1, 2)) for r in rings]
    rows = spark.createDataFrame([(1, "a", [(0.0, 0.0), (9.9, 0.0), (None, 3.0), (9.0, 9.9)]), (1, "b", None), (1, "c", [(0.0, 0.0), (5.0, 6.0), (5.0, 0.0), (0.0, 6.0)])], "page_id long, seg_id string, ring array<struct<x:double,y:double>>")
    validity = re.segment_validity(rows)
    assert {r.seg_id: r.reason for r in validity.collect()} == {"a": None, "b": "too few points", "c": "self-intersection"}
    known = spark.createDataFrame([(1, "c")], "page_id long, seg_id string")
    assert sorted((r.seg_id, r.found) for r in re.error_resolve(validity.where("reason is not null"), known).collect()) == [("b", False), ("c", True)]


def test_f11_cuts_and_unions_of_batches(spark):
    rng = np.random.default_rng(4)
    pairs = []
    for k in range(300):
        a, b = ((x, y, x + w, y + h) for x, y, w, h in np.c_[rng.integers(0, 12, (2, 2)), rng.integers(1, 12, (2, 2))].tolist())
        b = (a[0] - 1, a[1] + 1, a[2] + 2, a[1] + 2) if k % 4 == 1 else b
        pairs.append((rect(*a), [(1.0, 1.0), (9.0, 2.0), (4.0, 8.0)] if k % 29 == 0 else rect(*b)))
    rows = spark.createDataFrame([(k, "a", "b", ol.text_of(a), ol.text_of(b)) for k, (a, b) in enumerate(pairs)], "page_id long, line_id string, other_id string, points string, other_points string")
    for r in ol.apply_splits(rows).collect():
        parts = polygon.difference(*pairs[r.page_id])
        out = polygon.join(parts) if len(parts) > 1 else parts[0] if parts else None
        assert (r.points, r.area, r.parts) == (ol.text_of(out) if out else None, sum(map(polygon.area, parts)), len(parts))
    named = rows.toDF("page_id", "a_seg_id", "b_seg_id", "a_points", "b_points")
    for r in ol.merge_outline(named).collect():
        out = polygon.join(list(pairs[r.page_id]))
        assert (r.points, r.area) == (ol.text_of(out), polygon.area(out))


def test_f12_hulls_of_batches(spark, small_batches):
    pages, rows = some_pages(spark)
    found = {r.page_id: (r.points, r.area) for r in ol.convex_hull(rows).collect()}
    assert found == {k: (ol.text_of(out := polygon.hull([q for r in p for q in r])), polygon.area(out)) for k, p in pages.items()}


def test_f17_which_outlines_are_resampled(spark):
    many = [(float(x), 0.0) for x in range(0, 100, 10)] + [(100.0, 60.0), (0.0, 60.0)]
    rows = spark.createDataFrame([("a", many), ("b", rect(0, 0, 100, 60)), ("c", None)], "id string, ring array<struct<x:double,y:double>>")
    assert {r.id: r.yes for r in rows.select("id", ol.simplifies(rows.ring, 20).alias("yes")).collect()} == {"a": False, "b": False, "c": None}
    assert {r.id: r.yes for r in rows.select("id", ol.simplifies(rows.ring, 30).alias("yes")).collect()} == {"a": True, "b": False, "c": None}


def test_large_groups_are_met_in_stripes(monkeypatch):
    monkeypatch.setattr(flat, "PAIRS", 8)
    box = np.array([(0, 0, 5, 5), (5, 0, 9, 5), (20, 20, 21, 21), (6, 3, 7, 4)])
    assert list(zip(*(v.tolist() for v in boxes.meeting(box, np.array([0]), np.array([4]), 1)), strict=True)) == [(0, 1), (1, 0), (1, 3), (3, 1)]


def test_f6_greedy_matches_of_batches(spark, small_batches):
    rng = np.random.default_rng(6)
    gt, dt, pairs, want = [], [], [], {}
    for page in range(40):
        truths = {f"g{i}": (int(rng.integers(500, 12000)),) for i in range(int(rng.integers(0, 5)))}
        found = {f"d{i}": (float(rng.integers(1, 4)) / 4, float(rng.integers(500, 12000))) for i in range(int(rng.integers(1, 6)))}
        met = {(g, d): int(rng.integers(50, 101)) for g in truths for d in found if rng.random() < 0.6}
        gt += [(page, "c", g, a) for g, (a,) in truths.items()]
        dt += [(page, "c", d, s, a) for d, (s, a) in found.items()]
        pairs += [(page, "c", g, d, v, 100, truths[g][0]) for (g, d), v in met.items()]
        for t in ev.THRESHOLDS:
            for r, (low, high) in ev.RANGES.items():
                left = set(truths)
                for d, (s, a) in sorted(found.items(), key=lambda x: (-x[1][0], x[0])):
                    best = min(((not low <= truths[g][0] <= high, -met[g, d] / 100, g) for g in left if (g, d) in met and met[g, d] / 100 >= t - 1e-10), default=None)
                    left -= {best[2]} if best else set()
                    n = want.setdefault(("c", t, r, s), [0, 0])
                    n[0] += best is not None and not best[0]
                    n[1] += best is None and low <= a <= high
    made = ev.greedy_matches(
        spark.createDataFrame(gt, "page_id long, category string, seg_id string, area long"), spark.createDataFrame(dt, "page_id long, category string, seg_id string, score double, area double"),
        spark.createDataFrame(pairs, "page_id long, category string, gt_id string, dt_id string, inter long, union_area long, gt_area long"),
    )
    assert {tuple(r)[:4]: [r.tp, r.fp] for r in made.collect()} == want


def test_f8_levels_of_batches(spark, small_batches):
    rows = [(p, s, q, c) for p in range(9) for s, q, c in (("r1", None, "TextRegion"), ("r2", "r1", "TableRegion"), ("r3", "r2", None), ("r3", "r1", "TextRegion"), ("r9", "r8", "TextRegion"))]
    segments = spark.createDataFrame([*rows, (None, "a", None, "TextRegion"), (None, "b", "a", "TextRegion")], "page_id long, seg_id string, parent_id string, seg_class string")
    found = tr.regions_recursive(segments).where("page_id = 3 or page_id is null").collect()
    assert sorted((r.depth, r.root, r.path) for r in found) == [(0, "a", "a"), (0, "r1", "r1"), (1, "r1", "r1/r2"), (1, "r1", "r1/r3"), (2, "r1", "r1/r2/r3")]
    with pytest.raises(Exception, match="lies in itself"):
        tr.regions_recursive(spark.createDataFrame([(1, "a", None, "x"), (1, "a", "a", "x")], segments.schema)).collect()


def test_f10_last_painted_cells_of_batches(spark, small_batches, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(p, f"s{i}", "ab"[int(rng.integers(0, 2))], *b, b[0] + w, b[1] + h) for p in range(12) for i in range(int(rng.integers(1, 5))) for *b, w, h in [rng.integers(-30, 200, 4).tolist()]]
    rows += [(5, "far", "a", 10**7, 10**7, 10**7 + 50, 10**7 + 50), (6, "other", "c", 0, 0, 90, 90)]
    want = {}
    for p, _, c, x0, y0, x1, y1 in sorted(rows, key=lambda r: r[1]):
        if c in "ab":
            want |= {(p, x, y): ord(c) for x in range(-(-max(x0, 0) // 25), -(-x1 // 25)) for y in range(-(-max(y0, 0) // 25), -(-y1 // 25))}
    segments = spark.createDataFrame(rows, "page_id long, seg_id string, seg_class string, x0 long, y0 long, x1 long, y1 long")
    painted = lambda: {(r.page_id, r.cx, r.cy): r.color for r in ra.painter_mask(segments, {"a": 97, "b": 98}, 25).collect()}
    assert painted() == want


def test_f10_large_pages_are_painted_in_stripes(monkeypatch):
    cells = np.array([(0, 2, 3, 9, 7), (0, 0, 0, 4, 4), (0, 9, 7, 9, 9)])
    once = sorted(zip(*(v.tolist() for v in ra._painted(cells)), strict=True))
    monkeypatch.setattr(ra, "CELLS", 4)
    assert sorted(c for part in ra._striped(cells) for c in zip(*(v.tolist() for v in part), strict=True)) == once


def test_f18_text_regions_of_batches(spark, small_batches):
    rows = [(p, s, q, c) for p in range(9) for s, q, c in (("t", None, "TableRegion"), ("a", "t", "TextRegion"), ("b", "a", "TextRegion"), ("c", None, "TextRegion"), ("d", "x", "TextRegion"), ("e", "t", None))]
    segments = spark.createDataFrame([*rows, (None, "t", None, "TableRegion"), (None, "a", "t", "TextRegion")], "page_id long, seg_id string, parent_id string, seg_class string")
    assert sorted(map(tuple, tr.text_regions_union(segments).collect())) == [(p, *r) for p in range(9) for r in (("a", "table"), ("c", "page"))]


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def notes(spark, *ids):
    return spark.createDataFrame([(p, "c", i, 1.0, 0, 0, 9, 9, 81) for p, i in ids], "page_id long, category string, seg_id string, score double, x0 long, y0 long, x1 long, y1 long, area long")


def test_f13_misses_meet_their_matches_once(spark):
    gt, dt = notes(spark, (1, "g"), (1, "h"), (1, "h"), (2, None)), notes(spark, (1, "d"), (None, "d"), (2, "g"))
    matches = spark.createDataFrame([(1, "c", "g", "d"), (2, "c", None, "g")], "page_id long, category string, gt_id string, dt_id string")
    found = ev.misses(gt, dt, matches)
    assert sorted((r.kind, str(r.page_id), str(r.seg_id), r.area) for r in found.collect()) == [("fn", "1", "h", 81), ("fn", "1", "h", 81), ("fn", "2", "None", 81), ("fp", "None", "d", 81)]
    assert "Join" not in plan(found)


def test_f14_merged_regions_are_listed_once(spark):
    targets = spark.createDataFrame([(1, "a", "t"), (1, "b", "t"), (1, "t", "u")], "page_id long, seg_id string, target_id string")
    ranks = spark.createDataFrame([(1, k, n) for n, k in enumerate("tabu")], "page_id long, seg_id string, rank int")
    lines = spark.createDataFrame([(1, k, f"{k}{i}", i) for k in "abtu" for i in (0, 1)], "page_id long, region_id string, line_id string, pos int")
    made = tr.merge_child_order(targets, ranks, lines)
    assert sorted((r.region_id, r.pos, r.line_id) for r in made.collect()) == [*(("t", k, v) for k, v in enumerate(("t0", "t1", "a0", "a1", "b0", "b1"))), *(("u", k, v) for k, v in enumerate(("t0", "t1", "u0", "u1")))]
    assert "Union" not in plan(made)


def test_f15_segments_meet_their_targets_once(spark):
    box = {"a": (0, 0, 4, 4), "b": (1, 1, 9, 5), "c": (2, 2, 12, 3), "d": (50, 50, 60, 60)}
    segments = spark.createDataFrame([(1, k, "TextRegion", *b) for k, b in box.items()], "page_id long, seg_id string, seg_class string, x0 long, y0 long, x1 long, y1 long")
    decided = spark.createDataFrame([(1, "a", "b", 1, 2, "merge_a_into_b"), (1, "b", "c", 2, 3, "merge_b_into_a"), (1, "a", "d", 1, 4, "undecided")], "page_id long, a_seg_id string, b_seg_id string, a_rank int, b_rank int, decision string")
    made = re.apply_merges(segments, decided)
    assert {r.seg_id: tuple(r)[3:] for r in made.collect()} == {"b": (0, 0, 12, 5), "d": (50, 50, 60, 60)}
    assert plan(made).split("Initial Plan")[-1].count("Join [") == 1 and "Union" not in plan(re.merge_targets(decided))


def test_f15_partitions_grow_with_the_input(spark, monkeypatch):
    from folioscope.plans import fixtures
    from folioscope.plans.registry import QUERIES

    monkeypatch.setattr(fixtures, "PART", 1 << 12)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    made = QUERIES["apply_merges"](spark, "/root/testdata/sf0.001")
    parts = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    assert parts > 20 and f", {parts})" in plan(made) and spark.conf.get("spark.sql.shuffle.partitions") == before


def test_f16_f21_matches_are_sorted_once_a_side(spark):
    schema = "page_id long, category string, gt_id string, dt_id string, gt_area long, dt_area long, inter long, iou double, iogt double, iodt double"
    matches = spark.createDataFrame([(1, "c", "g", d, 81, 81, 40, 0.5, 0.5, 0.5) for d in ("d", "e")] + [(1, "c", "h", "e", 81, 81, 40, 0.5, 0.5, 0.5)], schema)
    made = ev.counts(notes(spark, (1, "g"), (1, "h")), notes(spark, (1, "d"), (1, "e"), (1, "f")), matches)
    row = made.first()
    assert [row[c] for c in ("n_gt", "n_dt", "n_match", "gt_met", "dt_met", "over_gt", "over_dt", "under_gt", "under_dt", "n_fp", "n_fn")] == [2, 3, 3, 2, 2, 1, 2, 2, 1, 1, 0]
    assert plan(made).split("Initial Plan")[-1].count("- Sort [") <= 3


def test_f19_files_are_named_without_a_join(spark):
    from folioscope.plans.registry import QUERIES

    assert plan(QUERIES["text_attach"](spark, "/root/testdata/sf0.001")).split("Initial Plan")[-1].count("Join [") == 1


def test_f20_documents_without_segments_and_unread_ones(spark):
    from folioscope.sources import page_xml

    rows = spark.createDataFrame([(1, "<PcGts><Page>"), (2, None), (3, '<PcGts><Page imageWidth="5"><TextRegion id="r"><Unknown/><Coords points="1,1"/><Coords points="2,2"/></TextRegion></Page></PcGts>'), (4, "<PcGts><Page/></PcGts>")], "page_id long, xml string")
    found = {r.page_id: r for r in page_xml.parse_documents(rows).collect()}
    assert [bool(found[k].error) for k in "1234"] == [True, True, False, False]
    assert (found["3"].points, found["3"].width, found["3"].pos, found["4"].seg_id, page_xml._local.cache_info().maxsize) == ("1,1", 5, 0, None, 1024)
