"""Queries that join boxes on a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clustering as O
from ..operators import joins as J
from ..operators import records as R
from . import fixtures
from .clustering import lines, slanted


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, region_id, region_type, box; article_id: blank, a1, a2 or a3."""
    f = fixtures.sql(spark, sf_dir, fixtures.REGIONS)
    article = F.when(F.col("region_id") % 4 == 0, "blank").otherwise(F.concat(F.lit("a"), (F.col("region_id") % 4).cast("string")))
    return f.select("page_id", "region_id", "region_type", C.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"), article.alias("article_id"))


def valid_text_regions(spark, sf_dir):
    return J.valid_text_regions(regions(spark, sf_dir)).select("page_id", "region_id")


def image_regions(spark, sf_dir):
    return J.image_regions(regions(spark, sf_dir)).groupBy("page_id", "region_type").agg(F.count("*").alias("n"))


def regions_by_type(spark, sf_dir):
    return regions(spark, sf_dir).groupBy("page_id", "region_type").agg(F.count("*").alias("n"))


def quadrants(spark, sf_dir):
    root = C.rect(F.lit(0), F.lit(0), F.lit(1501), F.lit(8001))
    return J.quadrants(regions(spark, sf_dir).withColumn("root", root)).select("page_id", "region_id", "quadrant")


def blank_by_hulls(spark, sf_dir):
    """Blank rectangles against the box of each article's rectangles, in strips of 500 pixels so that not all boxes overlap."""
    rects = regions(spark, sf_dir).withColumnRenamed("region_id", "rect_id")
    rects = rects.withColumn("page_id", F.col("page_id") * 16 + F.floor(F.col("box.y") / 500))
    return J.blank_to_articles(rects, R.union_boxes(rects.where("article_id <> 'blank'"))).select("page_id", "rect_id", "article_id")


def blank_by_polygons(spark, sf_dir):
    """Blank rectangles against every rectangle of the articles by itself."""
    rects = regions(spark, sf_dir).withColumnRenamed("region_id", "rect_id")
    return J.blank_to_articles(rects, rects).select("page_id", "rect_id", "article_id")


def aligned_lines(spark, sf_dir):
    """Whether each line stands above the next of its page."""
    nxt = Window.partitionBy("page_id").orderBy("idx")
    rows = slanted(spark, sf_dir).select("page_id", "idx", C.min_of(F.col("baseline"), "x").alias("a"), C.max_of(F.col("baseline"), "x").alias("b"))
    rows = rows.withColumns({"a2": F.lead("a").over(nxt), "b2": F.lead("b").over(nxt)})
    return rows.select("page_id", "idx", F.coalesce(C.aligned(F.col("a"), F.col("b"), F.col("a2"), F.col("b2")), F.lit(False)).alias("aligned"))


def crossed_regions(spark, sf_dir):
    return J.crossed_regions(slanted(spark, sf_dir), regions(spark, sf_dir))


def ringed_lines(spark, sf_dir):
    """Outline of every line that has a distance: its size and its least height."""
    rows = lines(spark, sf_dir)
    ring = J.with_rings(rows, O.interline_distances(rows))
    return ring.select("page_id", "idx", F.size("ring").cast("long").alias("n"), C.min_of(F.col("ring"), "y").cast("long").alias("top"))


def lines_with_distance(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return J.with_distance(rows, O.interline_distances(rows).where("dist < 50")).groupBy("page_id").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    valid_text_regions, image_regions, regions_by_type, quadrants, blank_by_hulls, blank_by_polygons, aligned_lines, crossed_regions, ringed_lines, lines_with_distance,
)}

_R, _L, _S = fixtures.REGIONS, fixtures.LINES, fixtures.SLANTED
_A = f"r AS MATERIALIZED (SELECT *, CASE region_id % 4 WHEN 0 THEN 'blank' ELSE concat('a', (region_id % 4)::VARCHAR) END AS article_id FROM ({_R}))"
_OVER = "b.x < h.x + h.w AND h.x < b.x + b.w AND b.y < h.y + h.h AND h.y < b.y + b.h"
_LENS = "least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)", "least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)"
_QUAD = """VALUES (1, 0, 0, 750, 4000), (2, 750, 0, 751, 4000), (3, 0, 4000, 750, 4001), (4, 750, 4000, 751, 4001)"""
_DIST = """d AS (SELECT a.page_id, a.idx, a.x0, a.x1, a.y, least(500, coalesce(min(abs(a.y - b.y)), 500)) AS dist
  FROM l a LEFT JOIN l b ON a.page_id = b.page_id AND a.idx <> b.idx AND a.x0 <= b.x1 AND b.x0 <= a.x1 GROUP BY ALL)"""


def _side(cx: str, cy: str) -> str:
    return f"(qx - px) * ({cy} - py) - (qy - py) * ({cx} - px)"


_SIDES = ", ".join(_side(cx, cy) for cx in ("x", "x + w") for cy in ("y", "y + h"))

SQL = {
    "valid_text_regions": f"""WITH r AS MATERIALIZED ({_R}) SELECT page_id, region_id FROM r a WHERE region_type = 'TextRegion' AND NOT EXISTS (
      SELECT 1 FROM r b WHERE b.region_type = 'GraphicRegion' AND a.page_id = b.page_id AND (
        (b.x <= a.x AND b.y <= a.y AND b.x + b.w >= a.x + a.w AND b.y + b.h >= a.y + a.h) OR ({_LENS[0]} > 20 AND {_LENS[1]} > 20)))""",
    "image_regions": f"SELECT page_id, region_type, count(*) AS n FROM ({_R}) WHERE region_type = 'GraphicRegion' GROUP BY ALL",
    "regions_by_type": f"SELECT page_id, region_type, count(*) AS n FROM ({_R}) GROUP BY ALL",
    "quadrants": f"SELECT page_id, region_id, k::INT AS quadrant FROM ({_R}) b, ({_QUAD}) h(k, x, y, w, h) WHERE {_OVER}",
    "blank_by_hulls": f"""WITH {_A}, s AS (SELECT page_id * 16 + y // 500 AS page_id, * EXCLUDE (page_id) FROM r), h AS (
        SELECT page_id, article_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM s WHERE article_id <> 'blank' GROUP BY ALL)
      SELECT b.page_id, b.region_id AS rect_id, CASE count(DISTINCT h.article_id) WHEN 1 THEN min(h.article_id) ELSE 'blank' END AS article_id
      FROM s b LEFT JOIN h ON b.page_id = h.page_id AND {_OVER} WHERE b.article_id = 'blank' GROUP BY b.page_id, b.region_id""",
    "blank_by_polygons": f"""WITH {_A} SELECT b.page_id, b.region_id AS rect_id, CASE count(DISTINCT h.article_id) WHEN 1 THEN min(h.article_id) ELSE 'blank' END AS article_id
      FROM r b LEFT JOIN r h ON b.page_id = h.page_id AND h.article_id <> 'blank' AND {_OVER} WHERE b.article_id = 'blank' GROUP BY b.page_id, b.region_id""",
    "aligned_lines": f"""WITH l AS (SELECT page_id, idx, x0 AS a, x1 AS b, lead(x0) OVER n AS c, lead(x1) OVER n AS d FROM ({_S}) WINDOW n AS (PARTITION BY page_id ORDER BY idx))
      SELECT page_id, idx, coalesce((a BETWEEN c - 20 AND d AND b BETWEEN c AND d + 20) OR (c BETWEEN a - 20 AND b AND d BETWEEN a AND b + 20) OR abs(a - c) < 20 OR abs(b - d) < 20, false) AS aligned FROM l""",
    "crossed_regions": f"""WITH s AS MATERIALIZED ({_S}), r AS MATERIALIZED ({_R}), seg AS (SELECT page_id, idx, x0 AS px, y0 AS py, xm AS qx, ym AS qy FROM s UNION ALL SELECT page_id, idx, xm, ym, x1, y1 FROM s),
      met AS (SELECT DISTINCT r.page_id, region_id, idx FROM r JOIN seg USING (page_id) WHERE greatest(px, qx) > x AND least(px, qx) < x + w AND greatest(py, qy) > y AND least(py, qy) < y + h
        AND NOT (least({_SIDES}) > 0 OR greatest({_SIDES}) < 0))
      SELECT r.page_id, r.region_id, count(idx) AS n FROM r LEFT JOIN met USING (page_id, region_id) GROUP BY ALL""",
    "ringed_lines": f"""WITH l AS MATERIALIZED ({_L}), {_DIST}
      SELECT page_id, idx, 4::BIGINT AS n, y - greatest(trunc(0.95::DOUBLE * dist)::BIGINT, 1) AS top FROM d""",
    "lines_with_distance": f"WITH l AS MATERIALIZED ({_L}), {_DIST} SELECT page_id, count(*) AS n FROM d WHERE dist < 50 GROUP BY page_id",
}
