"""One function for each processor: DataFrames and checked parameters in, DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .functions import rect
from .operators import evaluate as ev, outlines as ol, repair as re, text as tx, tree as tr

LEVELS = ("region", "line")


def _among(name: str, value: object, allowed: tuple) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, not {value!r}")


def _between(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value!r}")


@dataclass(frozen=True)
class EvaluateParams:
    """``for_categories`` is a comma-separated list, empty for all; ``ignore_subtype`` leaves labels to classes."""

    for_categories: str = ""
    ignore_subtype: bool = False
    match: float = ev.MATCH

    def __post_init__(self) -> None:
        _between("match", self.match, 0, 1)


@dataclass(frozen=True)
class RepairParams:
    """``plausibilize`` resolves redundant neighbours, ``simplify`` and ``spread`` are distances in pixels, 0 for none."""

    plausibilize: bool = False
    merge_threshold: float = re.SHARE
    spread: int = 0

    def __post_init__(self) -> None:
        _between("merge_threshold", self.merge_threshold, 0, 1)
        _between("spread", self.spread, 0, 1000)


@dataclass(frozen=True)
class ProjectParams:
    """``convex`` asks for hulls instead of joint outlines; ``scale`` is the width of bridges times five."""

    convex: bool = False
    scale: float = 20

    def __post_init__(self) -> None:
        _between("scale", self.scale, 1, 1000)


def evaluate(gt: DataFrame, dt: DataFrame, params: EvaluateParams | None = None) -> dict[str, DataFrame]:
    """The report of two segmentations: scores by category, counts by page, and average precision and recall."""
    params = params or EvaluateParams()
    sides = []
    for rows in (gt, dt):
        rows = rows.withColumn("subtype", F.lit(None).cast("string")) if params.ignore_subtype else rows
        sides.append(ev.category_select(ev.annotations(rows), params.for_categories))
    pairs = ev.iou_pairs(*sides)
    matches = ev.segment_matches(pairs, params.match)
    return {
        "by_image": ev.counts(*sides, matches), "by_category": ev.category_stats(ev.counts(*sides, matches, by=["category"])),
        "scores": ev.coco_ap(*sides, pairs),
    }


def repair(segments: DataFrame, params: RepairParams | None = None) -> DataFrame:
    """Segments with negative corners raised, empty ones dropped, redundant ones resolved, and spread.

    In this order, as later steps rely on what earlier ones put right. With a spread, outlines come as ``points``.
    """
    params = params or RepairParams()
    rows = segments.select(*[c for c in segments.columns if c not in rect.CORNERS], *[F.greatest(c, F.lit(0)).alias(c) for c in rect.CORNERS]).where("x1 > x0 and y1 > y0")
    if params.plausibilize:
        decided = re.classify(re.overlap_pairs(rows.where("seg_class = 'TextRegion'")), params.merge_threshold)
        rows = re.apply_merges(re.apply_deletes(rows, decided), decided)
    return ol.spread(rows.withColumn("points", rect.points()), params.spread) if params.spread else rows


def project(children: DataFrame, params: ProjectParams | None = None) -> DataFrame:
    """Parents' outlines from those of their children (page_id, parent_id, seg_id, points)."""
    params = params or ProjectParams()
    return ol.convex_hull(children) if params.convex else ol.project_hull(children, params.scale)


def replace_text(files: DataFrame, segments: DataFrame) -> DataFrame:
    """Which segment each text file belongs to."""
    return tx.text_attach(files, segments)


def replace_page(metadata: DataFrame, segments: DataFrame) -> DataFrame:
    return tx.replace_page(metadata, segments)


def replace_original(segments: DataFrame, matrix: list[list[float]], gone: tuple[str, ...] = ("cropped", "deskewed", "rotated-90", "rotated-180", "rotated-270")) -> DataFrame:
    return tr.rebase_original(segments, matrix, list(gone))
