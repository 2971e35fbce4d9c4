"""Rectangles as struct<x1, y1, x2, y2>, half-open, in pixels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushframe.functions.bind import let


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(F.expr(v).alias(n) if isinstance(v, str) else v.alias(n) for v, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def meets(a: Column, b: Column) -> Column:
    """Whether two boxes have a pixel in common."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def union(a: Column, b: Column) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    return F.coalesce(F.try_divide(intersection(a, b), union(a, b)), F.lit(0.0))


def coverage(a: Column, b: Column) -> Column:
    """The share of a that b covers; 0 for an empty a."""
    return F.coalesce(F.try_divide(intersection(a, b), area(a)), F.lit(0.0))


def inside(inner: Column, outer: Column, slack: int = 2) -> Column:
    return (
        (inner["x1"] >= outer["x1"] - slack)
        & (inner["y1"] >= outer["y1"] - slack)
        & (inner["x2"] <= outer["x2"] + slack)
        & (inner["y2"] <= outer["y2"] + slack)
    )


def near(a: Column, b: Column, gap: int = 120) -> Column:
    """At most so far apart vertically, with some horizontal overlap."""
    vertical = F.greatest(F.lit(0), F.greatest(a["y1"], b["y1"]) - F.least(a["y2"], b["y2"]))
    horizontal = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    return (vertical <= gap) & (horizontal > 0)


def scaled(b: Column, fx: Column, fy: Column) -> Column:
    """Times a factor each way, rounded half up (toward positive infinity), as screens do."""
    half_up = lambda v: F.floor(v + F.lit(0.5)).cast("int")
    return box(half_up(b["x1"] * fx), half_up(b["y1"] * fy), half_up(b["x2"] * fx), half_up(b["y2"] * fy))


def unscaled(b: Column, fx: Column, fy: Column) -> Column:
    """Back from ``scaled``: divided by the factors, rounded half up; null where a factor is 0."""
    half_up = lambda v: F.floor(v + F.lit(0.5)).cast("int")
    over = lambda v, f: half_up(F.try_divide(v.cast("double"), f.cast("double")))
    return box(over(b["x1"], fx), over(b["y1"], fy), over(b["x2"], fx), over(b["y2"], fy))


def rebased(b: Column, origin: Column) -> Column:
    return box(b["x1"] - origin["x1"], b["y1"] - origin["y1"], b["x2"] - origin["x1"], b["y2"] - origin["y1"])


def centre(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))


def holds(b: Column, x: Column, y: Column) -> Column:
    return (b["x1"] <= x) & (x < b["x2"]) & (b["y1"] <= y) & (y < b["y2"])


def union_area(boxes: Column) -> Column:
    """Pixels in any of an array of boxes, exactly: slabs between all vertical edges, in each of which the boxes are
    walked from the top down. Edges and boxes are sorted once."""
    sides = F.concat(F.transform(boxes, lambda b: b["x1"]), F.transform(boxes, lambda b: b["x2"]))
    downward = F.array_sort(F.transform(boxes, lambda b: F.struct(b["y1"].alias("y1"), b["y2"].alias("y2"), b["x1"].alias("x1"), b["x2"].alias("x2"))))
    none = F.struct(F.lit(0).cast("bigint").alias("px"), F.lit(-(2**31)).alias("upto"))

    def height(inside: Column) -> Column:
        step = lambda s, b: F.struct(
            (s["px"] + F.greatest(F.lit(0), b["y2"] - F.greatest(s["upto"], b["y1"]))).alias("px"),
            F.greatest(s["upto"], b["y2"]).alias("upto"),
        )
        return F.aggregate(inside, none, step)["px"]

    def slabs(x: Column) -> Column:
        starts = F.slice(x["edges"], 1, F.greatest(F.size(x["edges"]) - 1, F.lit(0)))
        slab = lambda lo, hi: (hi - lo) * height(F.filter(x["boxes"], lambda b: (b["x1"] <= lo) & (hi <= b["x2"])))
        return F.aggregate(F.transform(starts, lambda lo, i: slab(lo, F.get(x["edges"], i + 1))), F.lit(0).cast("bigint"), lambda a, v: a + v)

    return let(F.struct(F.array_sort(F.array_distinct(sides)).alias("edges"), downward.alias("boxes")), slabs)


def clipped(b: Column, width: int, height: int) -> Column:
    clip = lambda v, most: F.least(F.greatest(v, F.lit(0)), F.lit(most))
    return box(clip(b["x1"], width), clip(b["y1"], height), clip(b["x2"], width), clip(b["y2"], height))
