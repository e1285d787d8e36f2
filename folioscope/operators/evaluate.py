"""A predicted segmentation against ground truth: n:m matches, misses, over- and undersegmentation, scores.

Overlaps are found by an equal-key join on page and category with the rectangles' overlap as its residual, so pairs
never leave their page; everything later is one aggregation by page and category, and one by category.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import rect
from . import groups

#: A pair matches where intersection over union, over truth or over prediction reaches this.
MATCH = 0.5
KEYS = ["page_id", "category"]


def category_label(segments: DataFrame, separator: str = ".") -> DataFrame:
    """Class and subtype as one label; an absent or empty subtype leaves the class alone."""
    return segments.withColumn("category", F.concat_ws(separator, "seg_class", F.expr("nullif(subtype, '')")))


def annotations(segments: DataFrame) -> DataFrame:
    """One row for each usable segment: label, score (absent and 0 count as 1), area; empty outlines go."""
    score = F.coalesce(F.expr("nullif(conf, 0.0D)"), F.lit(1.0))
    return (
        category_label(segments)
        .where("x1 > x0 and y1 > y0")
        .select("page_id", "category", "seg_id", score.alias("score"), *rect.CORNERS, rect.area().alias("area"))
    )


def category_select(notes: DataFrame, wanted: str = "") -> DataFrame:
    """Rows of the categories in a comma-separated list; an empty list is all."""
    names = [c.strip() for c in wanted.split(",") if c.strip()]
    return notes.where(F.col("category").isin(names)) if names else notes


def iou_pairs(gt: DataFrame, dt: DataFrame) -> DataFrame:
    """All pairs of a truth and a prediction of one page and category that overlap."""
    corners = [F.col(c).alias(f"g_{c}") for c in (*rect.CORNERS, "area")]
    left = gt.select(*KEYS, F.col("seg_id").alias("gt_id"), *corners)
    right = dt.select(*KEYS, F.col("seg_id").alias("dt_id"), *[F.col(c).alias(f"d_{c}") for c in (*rect.CORNERS, "area")])
    pairs = left.join(right, KEYS).where(rect.overlap("g_", "d_")).withColumn("inter", rect.intersection("g_", "d_"))
    union = F.col("g_area") + F.col("d_area") - F.col("inter")
    return pairs.select(
        *KEYS, "gt_id", "dt_id", F.col("g_area").alias("gt_area"), F.col("d_area").alias("dt_area"), "inter",
        F.round(F.col("inter") / union, 6).alias("iou"),
        F.round(F.col("inter") / F.col("g_area"), 6).alias("iogt"),
        F.round(F.col("inter") / F.col("d_area"), 6).alias("iodt"),
        union.alias("union_area"),
    )


def segment_matches(pairs: DataFrame, least: float = MATCH) -> DataFrame:
    """Pairs that match; compared as areas, so exactly ``least`` is a match."""
    return pairs.where(F.greatest(*[F.col("inter") >= least * F.col(c) for c in ("union_area", "gt_area", "dt_area")])).drop("union_area")


def misses(gt: DataFrame, dt: DataFrame, matches: DataFrame) -> DataFrame:
    """(page_id, category, kind, seg_id, area): predictions (fp) and truths (fn) without a match.

    Segments and the matches' ids, which are made once for both sides, lie in one window.
    """
    key = ["page_id", "category", "kind", "seg_id"]
    side = lambda rows, kind: rows.select(*KEYS, F.lit(kind).alias("kind"), "seg_id", "area", F.lit(False).alias("met"))
    each = F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).alias("seg_id")) for kind, c in (("fp", "dt_id"), ("fn", "gt_id"))]))
    met = matches.select(*KEYS, each).select(*key, F.lit(None).cast(gt.schema["area"].dataType).alias("area"), F.lit(True).alias("met"))
    rows = side(dt, "fp").unionAll(side(gt, "fn")).unionAll(met)
    # Segments without an id match none.
    known = F.max("met").over(W.partitionBy(*key)) & F.col("seg_id").isNotNull()
    return rows.withColumn("known", known).where("not met and not known").select(*key, "area")


def counts(gt: DataFrame, dt: DataFrame, matches: DataFrame, by: list[str] = KEYS) -> DataFrame:
    """Whole-number counts and areas by page and category (or ``by`` alone), from which all scores follow.

    The first match of each segment stands for the segment, so distinct counts and misses are plain sums: matches,
    truths and predictions are united and aggregated once.
    """
    # All windows of a side have one order, so that a side is sorted once.
    g, d = W.partitionBy(*KEYS, "gt_id").orderBy("dt_id"), W.partitionBy(*KEYS, "dt_id").orderBy("gt_id")
    of_gt, of_dt = (w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing) for w in (g, d))
    m = matches.select("*", F.count("*").over(of_gt).alias("per_gt"), (F.row_number().over(g) == 1).alias("first_gt"))
    m = m.select("*", F.count("*").over(of_dt).alias("per_dt"), (F.row_number().over(d) == 1).alias("first_dt"), (F.max("per_gt").over(of_dt) > 1).alias("split"))
    m = m.withColumn("joined", F.max("per_dt").over(of_gt) > 1)
    gt_first, dt_first = F.col("first_gt"), F.col("first_dt")
    count, zero = (lambda when: when.cast("long")), F.lit(0).cast("long")
    met = {
        "n_gt": zero, "n_dt": zero, "n_match": F.lit(1).cast("long"), "tp_area": F.col("inter"),
        "gt_met": count(gt_first), "dt_met": count(dt_first),
        "over_gt": count(gt_first & (F.col("per_gt") > 1)), "over_dt": count(dt_first & F.col("split")),
        "under_gt": count(gt_first & F.col("joined")), "under_dt": count(dt_first & (F.col("per_dt") > 1)),
        "sum_iou": F.col("iou"), "sum_iogt": F.col("iogt"), "sum_iodt": F.col("iodt"),
        "fp_area": -F.when(dt_first, F.col("dt_area")).otherwise(0), "fn_area": -F.when(gt_first, F.col("gt_area")).otherwise(0),
        "n_fp": -count(dt_first), "n_fn": -count(gt_first),
    }
    none = {k: F.lit(0.0) if k.startswith("sum_") else zero for k in met}
    one = F.lit(1).cast("long")
    side = lambda rows, n, area, missed: rows.select(*KEYS, *[v.alias(k) for k, v in (none | {n: one, area: F.col("area"), missed: one}).items()])
    rows = m.select(*KEYS, *[v.alias(k) for k, v in met.items()]).unionAll(side(gt, "n_gt", "fn_area", "n_fn")).unionAll(side(dt, "n_dt", "fp_area", "n_fp"))
    return rows.groupBy(*by).agg(*[F.sum(k).alias(k) for k in met])


def fp_fn(counted: DataFrame) -> DataFrame:
    return counted.select(*KEYS, "n_fp", "fp_area", "n_fn", "fn_area").where("n_fp + n_fn > 0")


def over_under_image(counted: DataFrame) -> DataFrame:
    """Shares of segments that are split or merged, where both sides have segments."""
    both = F.col("n_gt") * F.col("n_dt")
    return counted.where("n_gt > 0 and n_dt > 0").select(
        *KEYS, F.round(F.col("over_gt") * F.col("over_dt") / both, 6).alias("oversegmentation"),
        F.round(F.col("under_gt") * F.col("under_dt") / both, 6).alias("undersegmentation"),
    )


def pr_image(counted: DataFrame) -> DataFrame:
    return counted.where("n_gt > 0 and n_dt > 0").select(
        *KEYS, F.round(F.col("dt_met") / F.col("n_dt"), 6).alias("precision"), F.round(F.col("gt_met") / F.col("n_gt"), 6).alias("recall")
    )


def pixel_image(counted: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(f"{k}_area") for k in ("tp", "fp", "fn"))
    return counted.where((tp > 0) | ((fp > 0) & (fn > 0))).select(
        *KEYS, F.round(tp / (tp + fp), 6).alias("pixel_precision"), F.round(tp / (tp + fn), 6).alias("pixel_recall"),
        F.round(tp / (tp + fp + fn), 6).alias("pixel_iou"),
    )


def category_stats(counted: DataFrame) -> DataFrame:
    """The scores by category over all pages; -1 where a score isn't defined."""
    total = counted
    if "page_id" in counted.columns:
        total = counted.groupBy("category").agg(*[F.sum(c).alias(c) for c in counted.columns if c not in KEYS])
    tp, fp, fn = (F.col(f"{k}_area") for k in ("tp", "fp", "fn"))
    both, pixels = "n_gt > 0 and n_dt > 0", (tp > 0) | ((fp > 0) & (fn > 0))
    score = lambda when, a, b: F.round(F.when(when, a / b).otherwise(-1.0), 5)
    c = F.col
    sides = c("n_gt") * c("n_dt")
    return total.select(
        "category",
        score(F.expr(both), c("over_gt") * c("over_dt"), sides).alias("oversegmentation"),
        score(F.expr(both), c("under_gt") * c("under_dt"), sides).alias("undersegmentation"),
        score(F.expr(both), c("n_dt") - c("n_fp"), c("n_dt")).alias("segment_precision"),
        score(F.expr(both), c("n_gt") - c("n_fn"), c("n_gt")).alias("segment_recall"),
        *[score(c("n_match") > 0, c(f"sum_{k}"), c("n_match")).alias(k) for k in ("iou", "iogt", "iodt")],
        score(pixels, tp, tp + fp).alias("pixel_precision"),
        score(pixels, tp, tp + fn).alias("pixel_recall"),
        score(pixels, tp, tp + fp + fn).alias("pixel_iou"),
    )


def score_rank(notes: DataFrame) -> DataFrame:
    """Predictions of a page and category from the surest down, in a total order."""
    rank = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("score"), "seg_id"))
    return notes.select(*KEYS, "seg_id", "score", rank.alias("rank"))


def category_encode(notes: DataFrame) -> DataFrame:
    """Numbers of categories by first appearance, background being 0; the table is as small as the label set."""
    first = notes.groupBy("category").agg(F.min(F.struct("page_id", "seg_id")).alias("first"))
    return first.select("category", F.row_number().over(W.orderBy("first")).alias("category_id")).unionAll(
        notes.sparkSession.createDataFrame([("bg", 0)], "category string, category_id int")
    )


def dense_ids(notes: DataFrame, start: int = 1) -> DataFrame:
    """Annotation numbers from ``start`` without gaps, in the order of page and segment.

    Numbers are local to ranges of pages, to which the count of all ranges before is added, on two levels: no global
    sort, and a table of one row for 2 ** 24 pages at the top.
    """
    cell, block = F.floor(F.col("page_id") / 4096), F.floor(F.col("page_id") / (1 << 24))
    local = notes.select("page_id", "seg_id", cell.alias("cell"), F.row_number().over(W.partitionBy(cell).orderBy("page_id", "seg_id")).alias("k"))
    sizes = notes.groupBy(block.alias("block"), cell.alias("cell")).agg(F.count("*").alias("n"))
    earlier = lambda over: F.coalesce(F.sum("n").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("n")).select("block", earlier(W.orderBy("block")).alias("base"))
    before = sizes.select("block", "cell", earlier(W.partitionBy("block").orderBy("cell")).alias("before")).join(F.broadcast(blocks), "block")
    return local.join(before.select("cell", (F.col("base") + F.col("before")).alias("before")), "cell").select(
        "page_id", "seg_id", (F.col("before") + F.col("k") + (start - 1)).alias("ann_id")
    )


#: Area ranges of average precision, in pixels.
RANGES = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
THRESHOLDS = [round(0.5 + 0.05 * k, 2) for k in range(10)]


def _match_greedily(dt_starts: np.ndarray, score_area: np.ndarray, of: np.ndarray, truth: np.ndarray, iou: np.ndarray, area: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each prediction is a true or false positive, by threshold and range: predictions by falling score in groups.

    ``of`` is the prediction of a candidate, ``truth`` a number of its truth that grows with the truth's id in a group.
    The k-th predictions of all groups are matched together.
    """
    limits = np.array([RANGES[r] for _ in THRESHOLDS for r in RANGES]).T
    least = np.repeat(THRESHOLDS, len(RANGES)) - 1e-10
    outside = lambda areas: (areas[:, None] < limits[0]) | (areas[:, None] > limits[1])
    n, none = len(score_area), np.iinfo(np.int64).max
    turn = np.arange(n) - np.repeat(dt_starts, np.diff(np.append(dt_starts, n)))
    order = np.lexsort((truth, -iou, of, turn[of]))
    of, truth, iou, area = of[order], truth[order], iou[order], area[order]
    known, truth = np.unique(truth, return_inverse=True)
    used = np.zeros((len(known), len(least)), bool)
    tp, fp = np.zeros((n, len(least)), bool), ~outside(score_area)
    bounds = np.flatnonzero(np.diff(turn[of], prepend=-1))
    for low, high in zip(bounds.tolist(), np.append(bounds, len(of))[1:].tolist(), strict=True):
        at = slice(low, high)
        ignored = outside(area[at])
        # Truths outside the range of areas come after all others; places tell candidates apart.
        place = np.where((iou[at, None] >= least) & ~used[truth[at]], np.arange(low, high)[:, None] + ignored * np.int64(len(of)), none)
        first = np.flatnonzero(np.diff(of[at], prepend=-1))
        best = np.minimum.reduceat(place, first, axis=0)
        hit = best < none
        own = of[at][first]
        tp[own] = hit & (best < len(of))
        fp[own] &= ~hit
        row, setting = np.nonzero(hit)
        used[truth[best[row, setting] % len(of)], setting] = True
    return tp, fp


def greedy_matches(gt: DataFrame, dt: DataFrame, pairs: DataFrame) -> DataFrame:
    """(category, threshold, range, score, tp, fp): counts of predictions, matched one to one by falling score.

    A page's predictions of a category are taken in order, each with the best truth left; truths outside the range of
    areas are taken last and then count for nothing, like unmatched predictions outside it. Ties in score go to the
    lower id, ties in overlap too. Whole pages are matched by batches, which send their counts on, not their segments.
    """
    left = dt.select(*KEYS, F.lit(False).alias("pair"), "seg_id", F.lit(None).cast("string").alias("gt_id"), "score", F.lit(None).cast("double").alias("iou"), F.col("area").cast("double").alias("area"))
    right = pairs.where("dt_id is not null and gt_id is not null").select(
        *KEYS, F.lit(True).alias("pair"), F.col("dt_id").alias("seg_id"), "gt_id", F.lit(None).cast("double").alias("score"), (F.col("inter") / F.col("union_area")).alias("iou"), F.col("gt_area").cast("double").alias("area")
    )

    def kernel(table: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        column = lambda n: groups.chunk(table, n).to_numpy(zero_copy_only=False)
        group, pair = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows))), column("pair")
        ids = groups.chunk(table, "seg_id").dictionary_encode()
        key = group * (len(ids.dictionary) + 1) + ids.indices.fill_null(len(ids.dictionary)).to_numpy()
        truths = groups.chunk(table, "gt_id").dictionary_encode()
        # Ids are compared as bytes.
        rank = np.argsort(pc.sort_indices(truths.dictionary).to_numpy())
        dt_rows, pair_rows = np.flatnonzero(~pair), np.flatnonzero(pair)
        if not len(dt_rows):
            return
        own, of = groups.met(key[pair_rows], key[dt_rows])
        rows = pair_rows[own]
        truth = group[rows] * (len(rank) + 1) + (rank[truths.indices.fill_null(0).to_numpy()[rows]] if len(rank) else 0)
        area, iou, score, category = column("area"), column("iou"), column("score")[dt_rows], groups.chunk(table, "category").dictionary_encode()
        dt_starts = np.flatnonzero(np.diff(group[dt_rows], prepend=-1))
        tp, fp = _match_greedily(dt_starts, area[dt_rows], of, truth, iou[rows], area[rows])
        scores, place = np.unique(score, return_inverse=True)
        kind = category.indices.to_numpy()[dt_rows] * len(scores) + place
        order = np.argsort(kind, kind="stable")
        first = np.flatnonzero(np.diff(kind[order], prepend=-1))
        kind, each = kind[order][first], len(THRESHOLDS) * len(RANGES)
        tp, fp = (np.add.reduceat(v[order].astype(np.int64), first, axis=0).ravel() for v in (tp, fp))
        names = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.arange(len(RANGES)), len(kind) * len(THRESHOLDS)).astype(np.int32)), pa.array(list(RANGES)))
        yield pa.table({
            "category": category.dictionary.take(pa.array(np.repeat(kind // len(scores), each))), "threshold": np.tile(np.repeat(THRESHOLDS, len(RANGES)), len(kind)),
            "range": names.cast(pa.string()), "score": np.repeat(scores[kind % len(scores)], each), "tp": tp, "fp": fp,
        })

    order = ["pair", F.desc("score"), "seg_id"]
    made = groups.whole(left.unionAll(right), KEYS, order, kernel, "category string, threshold double, range string, score double, tp long, fp long")
    return made.groupBy("category", "threshold", "range", "score").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))


def coco_ap(gt: DataFrame, dt: DataFrame, pairs: DataFrame) -> DataFrame:
    """(metric, value): average precision and recall over thresholds and ranges of areas; -1 where no truth is.

    Precision is read at 101 recalls from its envelope. Predictions of one score enter together, so curves have a
    point for each distinct score, however many predictions there are.
    """
    kinds = ["category", "threshold", "range"]
    found = greedy_matches(gt, dt, pairs)
    inside = [F.count(F.when((F.col("area") >= a) & (F.col("area") <= b), 1)).alias(r) for r, (a, b) in RANGES.items()]
    wide = gt.groupBy("category").agg(*inside)
    truths = wide.select("category", F.inline(F.array(*[F.struct(F.lit(r).alias("range"), F.col(r).alias("n")) for r in RANGES]))).where("n > 0")
    down = W.partitionBy(*kinds).orderBy(F.desc("score"))
    curve = found.join(truths, ["category", "range"]).select(*kinds, "score", "n", F.sum("tp").over(down).alias("tp"), F.sum("fp").over(down).alias("fp")).where("tp + fp > 0")
    curve = curve.select(*kinds, "score", (F.col("tp") / F.col("n")).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))
    envelope = F.max("precision").over(W.partitionBy(*kinds).orderBy("score"))
    # Of the recalls 0, 0.01 .. 1, those that a point is the first to reach.
    upto, before = F.floor(F.col("recall") * 100 + 1e-9), F.lag(F.floor(F.col("recall") * 100 + 1e-9), 1, -1).over(down)
    parts = curve.select(*kinds, "recall", (envelope * (upto - before)).alias("part"))
    ones = parts.groupBy(*kinds).agg((F.sum("part") / 101).alias("ap"), F.max("recall").alias("ar"))
    every = truths.select("category", "range", F.explode(F.array(*map(F.lit, THRESHOLDS))).alias("threshold"))
    scores = every.join(ones, kinds, "left").select(*kinds, F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("ar", F.lit(0.0)).alias("ar"))
    mean = lambda value, when: F.round(F.coalesce(F.avg(F.when(when, F.col(value))), F.lit(-1.0)), 6)
    at = lambda r: F.col("range") == r
    named = {"AP all": mean("ap", at("all")), "AP 0.50 all": mean("ap", at("all") & (F.col("threshold") == 0.5)), "AP 0.75 all": mean("ap", at("all") & (F.col("threshold") == 0.75))}
    named |= {f"AP {r}": mean("ap", at(r)) for r in ("small", "medium", "large")} | {f"AR {r}": mean("ar", at(r)) for r in RANGES}
    total = scores.agg(*[v.alias(k) for k, v in named.items()])
    return total.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("value")) for k in named])))
