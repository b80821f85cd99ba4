"""Geometry as column expressions over points (array of struct x, y) and rectangles (struct x, y, w, h).

y grows downwards. An intersection of rectangles may have negative extents, which tell how far
the two are apart; zero means that they touch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def points(*pairs: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")) for x, y in pairs])


def _axis(pts: Column, name: str) -> Column:
    return F.transform(pts, lambda p: p[name])


def min_of(pts: Column, name: str) -> Column:
    return F.array_min(_axis(pts, name))


def max_of(pts: Column, name: str) -> Column:
    return F.array_max(_axis(pts, name))


def mean_of(pts: Column, name: str) -> Column:
    """Mean coordinate: 1 / n times the sum, in this order."""
    total = F.aggregate(_axis(pts, name), F.lit(0).cast("long"), lambda a, v: a + v)
    return F.lit(1.0) / F.size(pts) * total


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def bounds(pts: Column) -> Column:
    """The bounding box; its width is the difference of the extremes."""
    x, y = min_of(pts, "x"), min_of(pts, "y")
    return rect(x, y, max_of(pts, "x") - x, max_of(pts, "y") - y)


def overlap(a: Column, b: Column, axis: str, extent: str) -> Column:
    """Extent of the intersection of two rectangles on one axis."""
    return F.least(a[axis] + a[extent], b[axis] + b[extent]) - F.greatest(a[axis], b[axis])


def intersection(a: Column, b: Column) -> Column:
    return rect(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]), overlap(a, b, "x", "w"), overlap(a, b, "y", "h"))


def contains(a: Column, b: Column) -> Column:
    """a contains b, edges included."""
    return (a["x"] <= b["x"]) & (a["y"] <= b["y"]) & (a["x"] + a["w"] >= b["x"] + b["w"]) & (a["y"] + a["h"] >= b["y"] + b["h"])


def pixels(w: Column, h: Column) -> Column:
    """Pixels of an extent that may be negative."""
    return F.when((w >= 0) & (h >= 0), (w + 1) * (h + 1)).otherwise(F.lit(0))


def valid_baseline(pts: Column) -> Column:
    """At least two points; null-safe."""
    return F.coalesce(F.size(pts) > 1, F.lit(False))


def scaled(pts: Column, factor: Column) -> Column:
    """Coordinates times factor, cut toward zero."""
    return F.transform(pts, lambda p: F.struct((p["x"] * factor).cast("int").alias("x"), (p["y"] * factor).cast("int").alias("y")))


def rescaled(pts: Column, factor: Column) -> Column:
    """As scaled, and unchanged where the factor is zero or null."""
    return F.when(F.coalesce(factor, F.lit(0.0)) == 0, pts).otherwise(scaled(pts, factor))


def _lifted(pts: Column, distance: Column) -> Column:
    shift = F.greatest((F.lit(0.95) * distance).cast("int"), F.lit(1))
    return F.transform(pts, lambda p: F.struct((p["x"] + 1).alias("x"), (p["y"] - shift).alias("y")))


def line_ring(pts: Column, distance: Column) -> Column:
    """A closed outline of a line: its points, then the same raised by most of the distance, backwards."""
    return F.concat(pts, F.reverse(_lifted(pts, distance)))


def line_cloud(pts: Column, distance: Column) -> Column:
    """The same points without turning back."""
    return F.concat(pts, _lifted(pts, distance))


def clamped(distance: Column, mean: Column) -> Column:
    """distance, or the mean where it lies outside half to one and a half of it."""
    return F.when(distance.between(0.5 * mean, 1.5 * mean), distance).otherwise(mean)


def grown(box: Column, distance: Column, factor: float) -> Column:
    """box drawn up and down by factor times distance, cut toward zero."""
    return rect(
        box["x"].cast("int"), (box["y"] - F.lit(factor) * distance).cast("int"),
        box["w"].cast("int"), (box["h"] + F.lit(2 * factor) * distance).cast("int"),
    )


def line_box(baseline: Column, surrounding: Column | None, use_surrounding: bool = True) -> Column:
    """The box of the surrounding points where there are any and they are asked for, else of the baseline."""
    if surrounding is None or not use_surrounding:
        return bounds(baseline)
    return F.when(F.coalesce(F.size(surrounding) > 0, F.lit(False)), bounds(surrounding)).otherwise(bounds(baseline))


def raised_box(box: Column, distance: Column) -> Column:
    """A baseline's box drawn over the text above it: up by the whole distance, higher by 1.1 of that."""
    d = distance.cast("int")
    return rect(box["x"], box["y"] - d, box["w"], box["h"] + (F.lit(1.1) * d).cast("int"))


def lone_line_box(box: Column, lines: Column, surrounding: Column) -> Column:
    """A rectangle of one line without surrounding points becomes a strip of ten above it."""
    alone = (F.size(lines) == 1) & F.coalesce(F.size(surrounding) == 0, F.lit(True))
    return F.when(alone, rect(box["x"], box["y"] - 10, box["w"], F.lit(10))).otherwise(box)


def aligned(min1: Column, max1: Column, min2: Column, max2: Column, margin: int = 20) -> Column:
    """Whether two extents in x stand above each other: one within the other, up to margin on one side, or edges near."""
    first = min1.between(min2 - margin, max2) & max1.between(min2, max2 + margin)
    second = min2.between(min1 - margin, max1) & max2.between(min1, max1 + margin)
    near = (F.abs(min1 - min2) < margin) | (F.abs(max1 - max2) < margin)
    return first | second | near


def _cross(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def line_meets_rect(pts: Column, box: Column) -> Column:
    """Whether a segment of the line has a point inside the rectangle; touching its edge from outside does not count.

    A segment whose own box overlaps the rectangle's interior meets it unless all four corners lie strictly on one side.
    """
    x0, y0, x1, y1 = box["x"], box["y"], box["x"] + box["w"], box["y"] + box["h"]

    def segment(i: Column) -> Column:
        p, q = F.get(pts, i), F.get(pts, i + 1)
        apart = (F.greatest(p["x"], q["x"]) <= x0) | (F.least(p["x"], q["x"]) >= x1) | (F.greatest(p["y"], q["y"]) <= y0) | (F.least(p["y"], q["y"]) >= y1)
        sides = [_cross(p["x"], p["y"], q["x"], q["y"], cx, cy) for cx, cy in ((x0, y0), (x1, y0), (x0, y1), (x1, y1))]
        one_side = (F.least(*sides) > 0) | (F.greatest(*sides) < 0)
        return ~apart & ~one_side

    return F.exists(F.sequence(F.lit(0), F.size(pts) - 2), segment)


def scale_factor(fixed_height: int, height: Column, scaling: float, least: float | None = 0.1) -> Column:
    """fixed_height / height where a height is fixed, else scaling (no less than least, where there is one)."""
    if fixed_height > 0:
        return F.lit(float(fixed_height)) / height
    return F.lit(max(least, scaling) if least is not None else scaling)
