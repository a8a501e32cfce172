"""Page geometry: boxes are arrays (x0, top, x1, bottom)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_box(x0: Column, top: Column, x1: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Box inside the page, or null if nothing is left."""
    box = [F.greatest(F.lit(0.0), x0.cast("double")), F.greatest(F.lit(0.0), top.cast("double")), F.least(width.cast("double"), x1.cast("double")), F.least(height.cast("double"), bottom.cast("double"))]
    return F.when((box[2] > box[0]) & (box[3] > box[1]), F.array(*box))


def mid_y(box: Column) -> Column:
    return (box[1] + box[3]) / 2


def in_band(box: Column, top: Column, bottom: Column) -> Column:
    """Whether the box's middle lies in [top, bottom)."""
    return (mid_y(box) >= top) & (mid_y(box) < bottom)


def polygon_box(polygon: Column) -> Column:
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def toc_top(height: Column, view_y: Column, is_xyz: Column) -> Column:
    """Distance from the page's top of an outline target given from its bottom; 0 for targets without a place."""
    return F.bround(F.when(is_xyz, F.greatest(F.lit(0.0), F.least(height, height - view_y - 5))).otherwise(F.lit(0.0)), 2)


def distinct_boxes(boxes: Column, slack: float = 2.0) -> Column:
    """Boxes that differ by ``slack`` or more in some edge from every box kept before them."""
    close = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d < slack)
    return F.aggregate(boxes, F.array().cast("array<array<double>>"), lambda kept, b: F.when(F.exists(kept, lambda k: close(k, b)), kept).otherwise(F.concat(kept, F.array(b))))


def image_verdict(width: Column, height: Column, sha: Column, min_width: int, min_height: int, ignored=()) -> Column:
    """Null for images to keep, else the reason why not."""
    return F.when(sha.isin(list(ignored)) if ignored else F.lit(False), "reviewed_decoration").when((width < min_width) | (height < min_height), "small_image_candidate_not_indexed")


def page_boxes(text: Column, boxes: Column, width: Column, height: Column) -> Column:
    """The boxes, or the whole page where a page has neither images nor text to speak of."""
    whole = F.array(F.array(F.lit(0.0), F.lit(0.0), width.cast("double"), height.cast("double")))
    return F.when((F.length(text) < 40) & (F.size(boxes) == 0), whole).otherwise(boxes)


def low_confidence(lines: Column, least: float = 0.75) -> Column:
    """Number of recognised lines below a score."""
    return F.size(F.filter(lines, lambda x: x["score"] < least))
