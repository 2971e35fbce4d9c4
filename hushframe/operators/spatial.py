"""Joins of boxes on the same page. The page is always an equality key; the geometry is a residual condition."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions.geometry import area, coverage, holds, inside, iou, meets, near


def overlapping_pairs(a: DataFrame, b: DataFrame, page: str = "page_id") -> DataFrame:
    """Pairs of a page's boxes (box, other) with an intersection; a and b carry ord and box."""
    left = a.select(page, F.col("ord").alias("ord_a"), F.col("box").alias("box_a"))
    right = b.select(page, F.col("ord").alias("ord_b"), F.col("box").alias("box_b"))
    return left.join(right, page).where(
        (F.col("box_a.x1") < F.col("box_b.x2")) & (F.col("box_b.x1") < F.col("box_a.x2"))
        & (F.col("box_a.y1") < F.col("box_b.y2")) & (F.col("box_b.y1") < F.col("box_a.y2"))
    )


def _covering(items: DataFrame, masks: DataFrame, threshold: float, how: str, page: str) -> DataFrame:
    m = masks.select(F.col(page).alias("_page"), F.col("box").alias("_box"))
    return items.join(m, (F.col(page) == F.col("_page")) & (coverage(F.col("box"), F.col("_box")) > threshold), how)


def covered(items: DataFrame, masks: DataFrame, threshold: float = 0.5, page: str = "page_id") -> DataFrame:
    """Items of which one mask covers more than the threshold."""
    return _covering(items, masks, threshold, "left_semi", page)


def uncovered(items: DataFrame, masks: DataFrame, threshold: float = 0.5, page: str = "page_id") -> DataFrame:
    return _covering(items, masks, threshold, "left_anti", page)


def not_exactly_covered(items: DataFrame, masks: DataFrame, page: str = "page_id") -> DataFrame:
    """Items whose very box no mask has."""
    return items.join(masks.select(page, "box"), [page, "box"], "left_anti")


def containers(items: DataFrame, slack: int = 2, page: str = "page_id") -> DataFrame:
    """Items that hold another item of the page, up to so many pixels."""
    other = items.select(F.col(page).alias("_page"), F.col("ord").alias("_ord"), F.col("box").alias("_box"))
    return items.join(
        other, (F.col(page) == F.col("_page")) & (F.col("ord") != F.col("_ord")) & inside(F.col("_box"), F.col("box"), slack), "left_semi"
    )


def nearby(items: DataFrame, targets: DataFrame, gap: int = 120, page: str = "page_id") -> DataFrame:
    """Items near some target: at most ``gap`` pixels above or below, and overlapping sideways."""
    t = targets.select(F.col(page).alias("_page"), F.col("box").alias("_box"))
    return items.join(t, (F.col(page) == F.col("_page")) & near(F.col("box"), F.col("_box"), gap), "left_semi")


def first_agreement(items: DataFrame, detections: DataFrame, threshold: float = 0.4, page: str = "page_id") -> DataFrame:
    """Adds confidence: the score of the first detection (by ord) that overlaps an item by more; 0 without one."""
    seen = detections.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("ord", "box", "score"))).alias("_seen"))
    # Most boxes are apart, which four comparisons show.
    apart = (lambda s: ~meets(F.col("box"), s["box"])) if threshold >= 0 else (lambda s: F.lit(False))
    first = F.get(F.filter("_seen", lambda s: F.when(apart(s), False).otherwise(iou(F.col("box"), s["box"]) > threshold)), 0)["score"]
    return items.join(seen, page, "left").withColumn("confidence", F.coalesce(first, F.lit(0.0))).drop("_seen")


def at_point(points: DataFrame, elements: DataFrame, page: str = "page_id") -> DataFrame:
    """For each point (x, y) the smallest element that holds it, as hit; null if none does.

    Stored snapshots have no stacking order; the smallest box stands for the topmost.
    """
    e = elements.select(F.col(page).alias("_page"), F.col("ord").alias("_ord"), F.col("box").alias("_box"))
    hits = points.join(e, (F.col(page) == F.col("_page")) & holds(F.col("_box"), F.col("x"), F.col("y")), "left")
    keys = points.columns
    return hits.groupBy(*keys).agg(F.min(F.when(F.col("_ord").isNotNull(), F.struct(area(F.col("_box")).alias("a"), "_ord")))["_ord"].alias("hit"))
