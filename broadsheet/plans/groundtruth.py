"""Queries on rectangles, regions and images of whole pages; folds, so only some have SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import articles as A
from ..operators import clustering as O
from ..operators import groundtruth as G
from ..operators import joins as J
from . import fixtures
from .clustering import lines, slanted
from .joins import regions
from .raster import pixels

HEIGHT, WIDTH = 9000, 1920


def _ringed(spark, sf_dir):
    """Lines whose surrounding points, where they have an article, follow from their distance."""
    rows = lines(spark, sf_dir)
    ring = J.with_rings(rows, O.interline_distances(rows, 40))
    return ring.select("page_id", "idx", "baseline", "article_id", F.when(F.col("article_id").isNotNull(), F.col("ring")).alias("surr_p"))


def article_rectangles(spark, sf_dir):
    return A.rectangles(lines(spark, sf_dir, True))


def article_rectangles_of_rings(spark, sf_dir):
    return A.rectangles(_ringed(spark, sf_dir), use_surrounding=True)


def article_outlines(spark, sf_dir):
    return A.outlines(lines(spark, sf_dir, True), least_width=10)


def article_convex_outlines(spark, sf_dir):
    return A.outlines(lines(spark, sf_dir, True), convex=True)


def smoothed_outlines(spark, sf_dir):
    return A.smoothed(article_outlines(spark, sf_dir), 50)


def min_area_boxes(spark, sf_dir):
    return A.min_area_boxes(article_hulls(spark, sf_dir))


def article_hulls(spark, sf_dir):
    return A.hulls(slanted(spark, sf_dir, True))


def ortho_outlines(spark, sf_dir):
    return A.ortho_outlines(regions(spark, sf_dir).select("page_id", "article_id", "box"))


def subregions(spark, sf_dir):
    """Down to parts of one article, however deep: lines of the fixture lie across each other as on no page."""
    return A.subregions(_ringed(spark, sf_dir), (0, 0, WIDTH, HEIGHT))


def text_regions(spark, sf_dir):
    rows = lines(spark, sf_dir)
    found = O.interline_distances(rows, 100).select("page_id", "idx", "dist")
    return A.regions(rows.join(found, ["page_id", "idx"], "left"))


def _outlined(spark, sf_dir, mode):
    return G.white_pixels(G.line_ground_truth(lines(spark, sf_dir, True), HEIGHT, WIDTH, mode, 0.1, least_width=10))


def ground_truth_ab_bl(spark, sf_dir):
    return _outlined(spark, sf_dir, "ab_bl")


def ground_truth_ab(spark, sf_dir):
    return _outlined(spark, sf_dir, "ab")


def ground_truth_a(spark, sf_dir):
    return _outlined(spark, sf_dir, "a")


def ground_truth_ab_a(spark, sf_dir):
    return _outlined(spark, sf_dir, "AB_A")


def text_block_ground_truth(spark, sf_dir):
    """Valid text regions of each page, filled, and the rest."""
    rows = J.valid_text_regions(regions(spark, sf_dir))
    b = F.col("box")
    ring = C.points((b["x"], b["y"]), (b["x"] + b["w"], b["y"]), (b["x"] + b["w"], b["y"] + b["h"]), (b["x"], b["y"] + b["h"]))
    return G.white_pixels(G.text_block_ground_truth(rows.select("page_id", ring.alias("points")), 8400, 2000, 0.25, "box"))


def rotated_pixels(spark, sf_dir):
    return G.rotated(pixels(spark, sf_dir), 15.0)


def quarter_turn(spark, sf_dir):
    """A turn by 90 degrees is exact."""
    return G.rotated(pixels(spark, sf_dir), 90.0)


QUERIES = {f.__name__: f for f in (
    article_rectangles, article_rectangles_of_rings, article_outlines, article_convex_outlines, smoothed_outlines, min_area_boxes, article_hulls, ortho_outlines,
    subregions, text_regions, ground_truth_ab_bl, ground_truth_ab, ground_truth_a, ground_truth_ab_a, text_block_ground_truth, rotated_pixels, quarter_turn,
)}

#: Valid regions as runs of pixels by row of the image; a run counts what no run before it covers.
_BLOCKS = f"""WITH r AS MATERIALIZED ({fixtures.REGIONS}), valid AS (SELECT * FROM r a WHERE region_type = 'TextRegion' AND NOT EXISTS (
  SELECT 1 FROM r b WHERE b.region_type = 'GraphicRegion' AND a.page_id = b.page_id AND (
    (b.x <= a.x AND b.y <= a.y AND b.x + b.w >= a.x + a.w AND b.y + b.h >= a.y + a.h)
    OR (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) > 20 AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > 20)))),
runs AS (SELECT page_id, trunc(x * 0.25)::INT AS a, trunc((x + w) * 0.25)::INT AS b, unnest(range(trunc(y * 0.25)::INT, trunc((y + h) * 0.25)::INT + 1)) AS line FROM valid),
fresh AS (
  SELECT page_id, greatest(0, b - greatest(a, coalesce(max(b) OVER (PARTITION BY page_id, line ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, a)) + 1) AS n FROM runs),
filled AS (SELECT page_id, sum(n)::BIGINT AS n FROM fresh GROUP BY page_id)
SELECT page_id, 0::INT AS channel, 2100::INT AS h, 500::INT AS w, n AS n_white FROM filled UNION ALL SELECT page_id, 1::INT, 2100::INT, 500::INT, 2100 * 500 - n FROM filled"""

#: The pixel that each one takes after a turn by 15 degrees about the middle.
_TURNED = f"""WITH p AS MATERIALIZED ({fixtures.PIXELS_DUCKDB}), t AS (
  SELECT img_id, y, x, round(cos(radians(15)) * (y - 3.5::DOUBLE) - sin(radians(15)) * (x - 3.5::DOUBLE) + 3.5::DOUBLE)::INT AS sy,
    round(sin(radians(15)) * (y - 3.5::DOUBLE) + cos(radians(15)) * (x - 3.5::DOUBLE) + 3.5::DOUBLE)::INT AS sx FROM p)
SELECT t.img_id, t.y, t.x, coalesce(p.v, 0)::INT AS v FROM t LEFT JOIN p ON p.img_id = t.img_id AND p.y = sy AND p.x = sx"""

SQL = {
    "quarter_turn": f"WITH p AS ({fixtures.PIXELS_DUCKDB}) SELECT img_id, y, x, v FROM (SELECT img_id, x AS y, 7 - y AS x, v FROM p)",
    "rotated_pixels": _TURNED,
    "text_block_ground_truth": _BLOCKS,
}
