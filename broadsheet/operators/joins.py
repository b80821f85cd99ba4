"""Joins of boxes on a page: predicates that overlap, contain or exclude."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

IMAGE_TYPES = ("GraphicRegion", "ImageRegions", "ImageRegion")


def image_regions(regions: DataFrame) -> DataFrame:
    return regions.where(F.col("region_type").isin(*IMAGE_TYPES))


def valid_text_regions(regions: DataFrame, threshold: int = 20) -> DataFrame:
    """Text regions that no image region of the page contains, or overlaps by more than threshold both ways.

    An anti-join on the page; regions have page_id, region_id, region_type, box.
    """
    text = regions.where(F.col("region_type") == "TextRegion")
    image = image_regions(regions).select(F.col("page_id").alias("_page"), F.col("box").alias("_image"))
    both = C.intersection(F.col("box"), F.col("_image"))
    hit = C.contains(F.col("_image"), F.col("box")) | ((both["h"] > threshold) & (both["w"] > threshold))
    return text.join(image, (F.col("page_id") == F.col("_page")) & hit, "left_anti")


def quadrants(boxes: DataFrame, root: str = "root", box: str = "box") -> DataFrame:
    """boxes with a row for each quadrant (1 to 4) of their root rectangle that they overlap; odd pixels go right and down."""
    r, b = F.col(root), F.col(box)
    w1, h1 = F.floor(r["w"] / 2), F.floor(r["h"] / 2)
    four = [
        C.rect(r["x"], r["y"], w1, h1), C.rect(r["x"] + w1, r["y"], r["w"] - w1, h1),
        C.rect(r["x"], r["y"] + h1, w1, r["h"] - h1), C.rect(r["x"] + w1, r["y"] + h1, r["w"] - w1, r["h"] - h1),
    ]
    inside = [(C.overlap(b, q, "x", "w") > 0) & (C.overlap(b, q, "y", "h") > 0) for q in four]
    return boxes.withColumn("quadrant", F.explode(F.array_compact(F.array(*[F.when(c, k + 1) for k, c in enumerate(inside)]))))


def blank_to_articles(rects: DataFrame, hulls: DataFrame) -> DataFrame:
    """Blank rectangles with the article whose hulls they overlap, where that is exactly one; else still blank.

    rects: page_id, rect_id, article_id, box; hulls: page_id, article_id, box, several for an article at will.
    """
    blank = rects.where(F.col("article_id") == "blank")
    h = hulls.where(F.col("article_id") != "blank").select(F.col("page_id").alias("_page"), F.col("article_id").alias("_article"), F.col("box").alias("_hull"))
    over = (C.overlap(F.col("box"), F.col("_hull"), "x", "w") > 0) & (C.overlap(F.col("box"), F.col("_hull"), "y", "h") > 0)
    met = blank.join(h, (F.col("page_id") == F.col("_page")) & over, "left")
    got = met.groupBy("page_id", "rect_id").agg(F.count_distinct("_article").alias("n"), F.min("_article").alias("one"))
    return got.select("page_id", "rect_id", F.when(F.col("n") == 1, F.col("one")).otherwise(F.lit("blank")).alias("article_id"))


def with_rings(lines: DataFrame, distances: DataFrame) -> DataFrame:
    """lines with ring: their surrounding points, or an outline made from the distance of the line (page_id, idx, dist)."""
    rows = lines.join(distances.select("page_id", "idx", "dist"), ["page_id", "idx"], "left")
    made = F.when(F.col("dist").isNotNull(), C.line_ring(F.col("baseline"), F.col("dist")))
    return rows.withColumn("ring", F.coalesce(F.col("surr_p"), made) if "surr_p" in lines.columns else made)


def with_distance(lines: DataFrame, distances: DataFrame) -> DataFrame:
    """Lines that have a distance: those without a valid baseline fall away."""
    return lines.join(distances.select("page_id", "idx"), ["page_id", "idx"], "left_semi")


def crossed_regions(lines: DataFrame, regions: DataFrame, step: int = 256) -> DataFrame:
    """page_id, region_id, n: lines of the page that have a point inside each region; zero where there are none.

    Lines and regions meet by page and strips of `step` pixels, each pair in the strip where its overlap begins.
    """
    def strips(b):
        return F.explode(F.sequence(F.floor(b["y"] / step), F.floor((b["y"] + b["h"]) / step)))

    side = lines.where(C.valid_baseline(F.col("baseline"))).select("page_id", "baseline", C.bounds(F.col("baseline")).alias("_b"))
    side = side.withColumn("_strip", strips(F.col("_b")))
    b = F.col("box")
    near = (F.col("_b.x") < b["x"] + b["w"]) & (F.col("_b.x") + F.col("_b.w") > b["x"]) & (F.col("_b.y") < b["y"] + b["h"]) & (F.col("_b.y") + F.col("_b.h") >= b["y"])
    begins = F.floor(F.greatest(F.col("_b.y"), b["y"]) / step) == F.col("_strip")
    met = regions.select("page_id", "region_id", "box", strips(b).alias("_strip")).join(side, ["page_id", "_strip"])
    counts = met.where(near & begins & C.line_meets_rect(F.col("baseline"), b)).groupBy("page_id", "region_id").agg(F.count("*").alias("n"))
    return regions.select("page_id", "region_id").distinct().join(counts, ["page_id", "region_id"], "left").select("page_id", "region_id", F.coalesce("n", F.lit(0)).alias("n"))
