"""Rasters as pixel tables (page_id, x, y, value), and whole small images where pixels depend on their neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import rect
from . import groups


def pixels(images: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """One row for each pixel of a flat raster; foreground where the value is positive."""
    rows = images.select(F.col(key).alias("page_id"), F.posexplode(column).alias("i", "value"), F.col("label").alias("color"))
    return rows.select("page_id", (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("value") > 0).alias("fg"), "color")


def mask_colors(raster: DataFrame, background: list[int]) -> DataFrame:
    """Distinct colours, how many pixels each has, and whether it is background."""
    return raster.groupBy("color").agg(F.count("*").alias("n")).select("color", "n", F.col("color").isin(background).alias("background"))


def class_masks(raster: DataFrame, background: list[int]) -> DataFrame:
    """Boxes of the foreground of each page and class that isn't background."""
    return raster.where(~F.col("color").isin(background) & F.col("fg")).groupBy("page_id", "color").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("area")
    )


def glyph_scale(sizes: DataFrame) -> DataFrame:
    """The median scale of a page's components, 43 where none is of a glyph's size."""
    scale = F.sqrt(3 * F.col("n"))
    fitting = F.when((scale > 5) & (scale < 100), scale)
    return sizes.groupBy("page_id").agg(F.coalesce(F.floor(F.percentile(fitting, 0.5)), F.lit(43)).cast("int").alias("scale"))


def mask_foreground(raster: DataFrame, boxes: DataFrame) -> DataFrame:
    """Foreground pixels inside each box of the same page."""
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    return raster.where("fg").join(boxes, "page_id").where(inside).groupBy("page_id", "box_id").agg(F.count("*").alias("n"))


def shrink_to_foreground(raster: DataFrame, boxes: DataFrame) -> DataFrame:
    """Boxes drawn in to the foreground that they hold; boxes without any go."""
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    return raster.where("fg").join(boxes, "page_id").where(inside).groupBy("page_id", "box_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")
    )


def pack(channels: DataFrame) -> DataFrame:
    """(page_id, x, y, color, hex): red, green, blue and, if there, alpha packed to one number, and its six or eight digits."""
    names = [c for c in ("r", "g", "b", "a") if c in channels.columns]
    color = F.lit(0).cast("long")
    for c in names:
        color = F.shiftleft(color, 8).bitwiseOR(F.col(c).cast("long"))
    return channels.select("page_id", "x", "y", color.alias("color"), F.lpad(F.hex(color), 2 * len(names), "0").alias("hex"))


def components(images: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """(page_id, root, n, x0, y0, x1, y1) of the parts of the foreground, pixels touching at sides or corners.

    ``root`` is the least pixel of a part. All images of a batch are labelled together, by the least label around.
    """

    def batches(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in found:
            if not len(batch):
                continue
            fg = np.stack([np.asarray(v, float) for v in batch["pixels"]]).reshape(len(batch), -1, width) > 0
            size = fg[0].size
            label = np.where(fg, np.arange(size).reshape(fg.shape[1:])[None], size)
            while True:
                padded = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=size)
                around = np.minimum.reduce([padded[:, dy : dy + fg.shape[1], dx : dx + width] for dy in range(3) for dx in range(3)])
                lower = np.where(fg, np.minimum(label, around), size)
                if (lower == label).all():
                    break
                label = lower
            image, y, x = np.nonzero(fg)
            rows = pd.DataFrame({"page_id": batch["page_id"].to_numpy()[image], "root": label[image, y, x], "x": x, "y": y})
            out = rows.groupby(["page_id", "root"], sort=False).agg(n=("x", "size"), x0=("x", "min"), y0=("y", "min"), x1=("x", "max"), y1=("y", "max"))
            yield out.reset_index()

    rows = images.where(F.size(column) > 0).select(F.col(key).cast("long").alias("page_id"), F.col(column).alias("pixels"))
    return rows.mapInPandas(batches, "page_id long, root long, n long, x0 long, y0 long, x1 long, y1 long")


def contour_filter(parts: DataFrame, pixels: int, least: int, percent: float) -> DataFrame:
    """Parts kept, numbered as regions of their page: those too small both in pixels and in share of the page go."""
    kept = parts.where(~((F.col("n") < least) & (F.col("n") * 100 < percent * pixels)))
    k = F.row_number().over(W.partitionBy("page_id").orderBy("root"))
    return kept.select("page_id", F.concat(F.lit("region_"), k.cast("string")).alias("seg_id"), *rect.CORNERS, F.col("n").alias("area"))


def component_scale(parts: DataFrame) -> DataFrame:
    """Glyph scales from the sizes of components, 43 for pages with one component."""
    scale = F.sqrt(3 * F.col("n"))
    fitting = F.when((scale > 5) & (scale < 100), scale)
    return parts.groupBy("page_id").agg(F.when(F.count("*") > 1, F.coalesce(F.floor(F.percentile(fitting, 0.5)), F.lit(43))).otherwise(F.lit(43)).cast("int").alias("scale"))


#: Cells that are painted at once.
CELLS = 1 << 21


def _painted(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cx, cy, the last row over it) of the cells of rows (page, x0, y0, x1, y1), bounds included, and rows of each page."""
    page, x0, y0, x1, y1 = cells.T
    starts = np.flatnonzero(np.diff(page, prepend=-1))
    left, low = np.minimum.reduceat(x0, starts), np.minimum.reduceat(y0, starts)
    wide, high = np.maximum.reduceat(x1, starts) - left + 1, np.maximum.reduceat(y1, starts) - low + 1
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(page))))
    base = np.cumsum(wide * high) - wide * high
    rows = y1 - y0 + 1
    count = (x1 - x0 + 1) * rows
    row = np.repeat(np.arange(len(page)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    cx, cy = x0[row] + k // rows[row], y0[row] + k % rows[row]
    slot = base[of[row]] + (cx - left[of[row]]) * high[of[row]] + cy - low[of[row]]
    if (wide * high).sum() > 8 * len(row) + CELLS:
        slot, last = np.unique(slot[::-1], return_index=True)
        last = len(row) - 1 - last
    else:
        canvas = np.full(int((wide * high).sum()), -1)
        canvas[slot] = np.arange(len(row))
        last = canvas[canvas >= 0]
    return cx[last], cy[last], row[last]


def _striped(cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """As _painted for one page of many cells, in stripes of columns that are painted row by row."""
    _, x0, y0, x1, y1 = cells.T
    low, high = int(y0.min()), int(y1.max() - y0.min()) + 1
    for left in range(int(x0.min()), int(x1.max()) + 1, step := max(1, 8 * CELLS // high)):
        canvas = np.full((min(step, int(x1.max()) + 1 - left), high), -1)
        for k in np.flatnonzero((x0 < left + step) & (x1 >= left)).tolist():
            canvas[max(0, int(x0[k]) - left) : int(x1[k]) + 1 - left, int(y0[k]) - low : int(y1[k]) + 1 - low] = k
        cx, cy = np.nonzero(canvas >= 0)
        yield cx + left, cy + low, canvas[cx, cy]


def painter_mask(segments: DataFrame, colors: dict[str, int], cell: int) -> DataFrame:
    """(page_id, cx, cy, color): cells of a mask, each with the colour of the segment drawn last over its corner.

    Segments are drawn in the order of their ids, in batches of whole pages; classes without a colour aren't drawn.
    Only cells that show in the end leave a batch, and none is exchanged or sorted.
    """
    table = F.create_map(*[F.lit(x) for pair in sorted(colors.items()) for x in pair])
    x0, y0, x1, y1 = rect.corners()
    low = lambda v: F.ceil(F.greatest(v, F.lit(0)) / cell)
    high = lambda v: F.ceil(v / cell) - 1
    drawn = segments.withColumn("color", F.try_element_at(table, F.col("seg_class"))).where("color is not null")
    drawn = drawn.select("page_id", "seg_id", "color", low(x0).alias("x0"), low(y0).alias("y0"), high(x1).alias("x1"), high(y1).alias("y1")).where("x1 >= x0 and y1 >= y0")

    def kernel(found: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        sizes = np.diff(np.append(starts, found.num_rows))
        cells = np.stack([np.repeat(np.arange(len(starts)), sizes), *[groups.chunk(found, c).to_numpy() for c in rect.CORNERS]], axis=1)
        count = (cells[:, 3] - cells[:, 1] + 1) * (cells[:, 4] - cells[:, 2] + 1)
        by_page = np.add.reduceat(count, starts)
        first = 0
        while first < len(starts):
            upto = max(first + 1, int(np.searchsorted(np.cumsum(by_page[first:]), CELLS, "right")) + first)
            rows = slice(int(starts[first]), int(starts[upto - 1] + sizes[upto - 1]))
            for cx, cy, row in _striped(cells[rows]) if by_page[first] > CELLS else [_painted(cells[rows])]:
                yield found.select(["page_id", "color"]).take(pa.array(row + rows.start)).add_column(1, "cx", pa.array(cx)).add_column(2, "cy", pa.array(cy))
            first = upto

    return groups.whole(drawn, ["page_id"], ["seg_id", "color"], kernel, f"{groups.kinds(drawn, 'page_id')}, cx long, cy long, {groups.kinds(drawn, 'color')}")
