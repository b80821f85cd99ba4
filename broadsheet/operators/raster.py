"""Images as tables of pixels (img_id, y, x, v): every row of an image has a pixel for each x."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stash
from .components import connected_components

#: The binomial weights of a 5 x 5 blur, in sixteenths.
BLUR = {-2: 1, -1: 4, 0: 6, 1: 4, 2: 1}


def profile(pixels: DataFrame, axis: str = "y") -> DataFrame:
    """img_id, i, ink: sum of values over 255 for each row (axis y) or column (x)."""
    return pixels.groupBy("img_id", F.col(axis).alias("i")).agg((F.sum("v") / F.lit(255.0)).alias("ink"))


def separators(pixels: DataFrame, threshold: float = 0.1, axis: str = "y") -> DataFrame:
    """img_id, i, score: rows or columns whose share of white is above threshold."""
    other = "x" if axis == "y" else "y"
    got = pixels.groupBy("img_id", F.col(axis).alias("i")).agg((F.sum("v") / F.lit(255.0)).alias("ink"), F.count(other).alias("n"))
    return got.select("img_id", "i", (F.col("ink") / F.col("n")).alias("score")).where(F.col("score") > threshold)


def gaps(marks: DataFrame, extent: Column, least: Column, key: list[str]) -> DataFrame:
    """key, lo, hi: ranges between separators i that are longer than least, before the first and after the last too."""
    by = Window.partitionBy(*key).orderBy("i")
    rows = marks.withColumns({"_next": F.lead("i").over(by), "_first": F.lag("i").over(by).isNull(), "_extent": extent, "_least": least})
    i, nxt, end = F.col("i"), F.col("_next"), F.col("_extent") - 1
    zero = F.lit(0).cast("int")
    span = lambda ok, lo, hi: F.when(ok, F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))
    found = F.array(
        span(F.col("_first") & (i > F.col("_least")), zero, i), span(nxt - i > F.col("_least"), i + 1, nxt), span(nxt.isNull() & (end - i > F.col("_least")), i, end)
    )
    return rows.withColumn("_g", F.explode(F.array_compact(found))).select(*key, "_g.lo", "_g.hi")


def binarized(pixels: DataFrame, threshold: float) -> DataFrame:
    """Values strictly above threshold are 1, others 0."""
    return pixels.withColumn("v", (F.col("v") > threshold).cast("int"))


def other_channel(channels: DataFrame) -> DataFrame:
    """What no channel shows: 255 less all of them in 8-bit arithmetic, kept only where that is 0 or 255."""
    left = F.pmod(F.lit(255) - F.sum("v"), F.lit(256))
    return channels.groupBy("img_id", "y", "x").agg(F.when(left == 255, 255).otherwise(0).alias("v"))


def disjoint(channels: DataFrame) -> DataFrame:
    """Each channel 0 where it equals the channel before it, as it was at first."""
    before = F.lag("v").over(Window.partitionBy("img_id", "y", "x").orderBy("channel"))
    return channels.withColumn("v", F.when(before == F.col("v"), 0).otherwise(F.col("v")))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b in 8-bit arithmetic, which wraps."""
    rows = a.join(b.select("img_id", "y", "x", F.col("v").alias("_v")), ["img_id", "y", "x"])
    return rows.withColumn("v", F.pmod(F.col("v") - F.col("_v"), F.lit(256))).drop("_v")


def _swept(pixels: DataFrame, size: int, along: str, across: str, best) -> DataFrame:
    """best over size pixels around each, the anchor at size // 2; what lies outside the image does not count."""
    frame = Window.partitionBy("img_id", across).orderBy(along).rowsBetween(-(size // 2), size - 1 - size // 2)
    return pixels.withColumn("v", best("v").over(frame))


def dilated(pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    """Maximum over a rectangle: first along rows, then along columns."""
    return _swept(_swept(pixels, cols, "x", "y", F.max), rows, "y", "x", F.max)


def eroded(pixels: DataFrame, rows: int, cols: int) -> DataFrame:
    return _swept(_swept(pixels, cols, "x", "y", F.min), rows, "y", "x", F.min)


def blurred(pixels: DataFrame) -> DataFrame:
    """5 x 5 binomial blur, mirrored at the edges without doubling them, rounded half up."""

    def swept(rows: DataFrame, axis: str, value: str) -> DataFrame:
        last = F.max(axis).over(Window.partitionBy("img_id"))
        rows = rows.withColumn("_last", last)
        spread = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in BLUR.items()]))
        asks = rows.drop(value).withColumn("_o", spread)
        at = F.abs(F.col(axis) + F.col("_o.d"))
        at = F.when(at > F.col("_last"), F.greatest(2 * F.col("_last") - at, F.lit(0))).otherwise(at)
        other = "x" if axis == "y" else "y"
        source = rows.select("img_id", F.col(axis).alias("_at"), other, F.col(value).alias("_v"))
        met = asks.withColumn("_at", at).join(source, ["img_id", "_at", other])
        return met.groupBy("img_id", "y", "x").agg(F.sum(F.col("_v") * F.col("_o.w")).alias(value))

    out = swept(swept(pixels.select("img_id", "y", "x", "v"), "x", "v"), "y", "v")
    return out.withColumn("v", F.floor((F.col("v") + 128) / 256).cast("int"))


def otsu(pixels: DataFrame) -> DataFrame:
    """img_id, threshold: the value that parts an image's values into two classes with the greatest variance between; the least of equals.

    The variance is kept in whole numbers up to one division, so equal histograms give equal thresholds.
    """
    counts = pixels.groupBy("img_id", "v").agg(F.count("*").alias("n"))
    up = Window.partitionBy("img_id").orderBy("v")
    every = Window.partitionBy("img_id")
    rows = counts.withColumns({
        "w0": F.sum("n").over(up), "s0": F.sum(F.col("n") * F.col("v")).over(up), "w": F.sum("n").over(every), "s": F.sum(F.col("n") * F.col("v")).over(every),
    })
    apart = (F.col("w") * F.col("s0") - F.col("w0") * F.col("s")).cast("double")
    between = F.when(F.col("w0") < F.col("w"), apart * apart / (F.col("w0") * (F.col("w") - F.col("w0")))).otherwise(F.lit(0.0))
    best = F.max(F.struct(between.alias("b"), (-F.col("v")).alias("t")))
    return rows.groupBy("img_id").agg((-best["t"]).alias("threshold"))


def halved(pixels: DataFrame, factor: int = 2) -> DataFrame:
    """Means of blocks of factor x factor pixels, rounded half up."""
    n = factor * factor
    by = ["img_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")]
    return pixels.groupBy(*by).agg(F.floor((F.sum("v") + n // 2) / n).cast("int").alias("v"))


def pixel_components(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """img_id, y, x, label of all pixels with v > 0: 8-connected components, numbered from 1 by their first pixel in row order."""
    on = pixels.where("v > 0").select("img_id", "y", "x", ((F.col("img_id") * height + F.col("y")) * width + F.col("x")).cast("long").alias("node"))
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    to = on.withColumn("_s", steps).select("img_id", (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"), F.col("node").alias("src"))
    links = to.join(on.withColumnRenamed("node", "dst"), ["img_id", "y", "x"]).select("src", "dst")
    rooted = on.join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return rooted.select("img_id", "y", "x", F.dense_rank().over(Window.partitionBy("img_id").orderBy("component")).alias("label"))


def same_shapes(images: DataFrame) -> DataFrame:
    """page_id, same: whether all images of a page (page_id, h, w) have one shape."""
    return images.groupBy("page_id").agg((F.count_distinct("h", "w") == 1).alias("same"))


def xy_cut(pixels: DataFrame, depth: int = 4, threshold: float = 0.9, gap_share: float = 0.003) -> DataFrame:
    """img_id, depth, x, y, w, h: regions between white runs, by turns of rows and columns, depth times; a written table for each round.

    Each round crops both axes to its regions, and takes the share of white over the region. The thresholds fall
    by a tenth a round to 0.65 at least. All regions of a round are one aggregation.
    """
    size = Window.partitionBy("img_id")
    base = pixels.withColumns({"_h": F.max("y").over(size) + 1, "_w": F.max("x").over(size) + 1})
    whole = base.groupBy("img_id").agg(F.first("_w").alias("w"), F.first("_h").alias("h"))
    regions = whole.select("img_id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"))
    out, key = None, ["img_id", "rx", "ry", "rw", "rh"]
    for k in range(depth):
        along, start, extent = ("y", "ry", "rh") if k % 2 == 0 else ("x", "rx", "rw")
        inside = F.col("x").between(F.col("rx"), F.col("rx") + F.col("rw") - 1) & F.col("y").between(F.col("ry"), F.col("ry") + F.col("rh") - 1)
        named = regions.select("img_id", *[F.col(c).alias(f"r{c}") for c in "xywh"])
        met = base.join(named, "img_id").where(inside)
        rows = met.groupBy(*key, "_h", (F.col(along) - F.col(start)).alias("i")).agg((F.sum(255 - F.col("v")) / F.lit(255.0) / F.count("*")).alias("score"))
        found = gaps(rows.where(F.col("score") > threshold), F.col(extent), F.floor(F.col("_h") * gap_share), key)
        lo, n = F.col("lo"), F.col("hi") - F.col("lo")
        if along == "y":
            cut = [F.col("rx").alias("x"), (F.col("ry") + lo).alias("y"), F.col("rw").alias("w"), n.alias("h")]
        else:
            cut = [(F.col("rx") + lo).alias("x"), F.col("ry").alias("y"), n.alias("w"), F.col("rh").alias("h")]
        regions = found.select("img_id", *cut).where("w > 0 and h > 0")
        regions = marked = stash(regions.withColumn("depth", F.lit(k + 1)), "regions")  # else each round would run all before it again
        out = marked if out is None else out.unionByName(marked)
        threshold = max(0.9 * threshold, 0.65)
    return out.select("img_id", "depth", "x", "y", "w", "h")
