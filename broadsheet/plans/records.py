"""Queries on orders, texts, names and boxes of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clustering as O
from ..operators import records as R
from . import fixtures
from .clustering import lines, slanted


def _flat(rows: DataFrame, box: str, *keys: str) -> DataFrame:
    return rows.select(*keys, *[F.col(f"{box}.{c}").cast("long").alias(c) for c in "xywh"])


def baseline_stats(spark, sf_dir):
    """Box, mean and least height of three-point baselines that are valid; lines without article lose theirs first."""
    rows = slanted(spark, sf_dir).withColumn("baseline", F.when(F.col("article_id").isNotNull(), F.col("baseline")))
    rows = O.boxed(rows).withColumns({"mean_y": C.mean_of(F.col("baseline"), "y"), "min_y": C.min_of(F.col("baseline"), "y").cast("long")})
    return rows.select("page_id", "idx", "mean_y", "min_y", *[F.col(f"box.{c}").cast("long").alias(c) for c in "xywh"])


def print_space(spark, sf_dir):
    """Root rectangle of each page: the box of all its points."""
    rows = slanted(spark, sf_dir).withColumns({"box": C.bounds(F.col("baseline")), "article_id": F.lit("page")})
    return _flat(R.union_boxes(rows), "box", "page_id")


def scaled_points(spark, sf_dir):
    rows = slanted(spark, sf_dir).withColumn("pts", C.scaled(F.col("baseline"), F.lit(0.37)))
    return rows.select("page_id", "idx", F.posexplode("pts").alias("pos", "p")).select("page_id", "idx", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def rescaled_points(spark, sf_dir):
    """Scaled by the page number modulo 3 over 2; factor 0 leaves points as they are."""
    rows = slanted(spark, sf_dir).withColumn("pts", C.rescaled(F.col("baseline"), (F.col("page_id") % 3) / 2.0))
    return rows.select("page_id", "idx", F.posexplode("pts").alias("pos", "p")).select("page_id", "idx", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def _ring(spark, sf_dir, make):
    rows = slanted(spark, sf_dir).withColumn("pts", make(F.col("baseline"), F.col("idx") / 2.0))
    return rows.select("page_id", "idx", F.posexplode("pts").alias("pos", "p")).select("page_id", "idx", "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def line_rings(spark, sf_dir):
    return _ring(spark, sf_dir, C.line_ring)


def line_clouds(spark, sf_dir):
    return _ring(spark, sf_dir, C.line_cloud)


def raised_boxes(spark, sf_dir):
    rows = O.interline_distances(lines(spark, sf_dir), 50)
    return _flat(rows.withColumn("r", C.raised_box(F.col("box"), F.col("dist"))), "r", "page_id", "idx")


def line_boxes(spark, sf_dir):
    """Boxes of surrounding points for lines of article a1, of baselines for others."""
    rows = slanted(spark, sf_dir).withColumn("surr_p", F.when(F.col("article_id") == "a1", C.line_ring(F.col("baseline"), F.lit(40.0))))
    return _flat(rows.withColumn("b", C.line_box(F.col("baseline"), F.col("surr_p"))), "b", "page_id", "idx")


def lone_line_boxes(spark, sf_dir):
    """Boxes of articles in strips of 100 pixels: one of a single line becomes a strip above it."""
    rows = lines(spark, sf_dir).withColumn("box", C.bounds(F.col("baseline")))
    rows = rows.withColumn("article_id", F.concat_ws(":", F.coalesce("article_id", F.lit("-")), F.floor(F.col("box.y") / 100).cast("string")))
    got = R.union_boxes(rows).join(rows.groupBy("page_id", "article_id").agg(F.collect_list("idx").alias("ids")), ["page_id", "article_id"])
    box = C.lone_line_box(F.col("box"), F.col("ids"), F.lit(None).cast("array<int>"))
    return _flat(got.withColumn("b", box), "b", "page_id", "article_id")


def article_boxes(spark, sf_dir):
    return _flat(R.union_boxes(lines(spark, sf_dir).withColumn("box", C.bounds(F.col("baseline")))), "box", "page_id", "article_id")


def article_id_sets(spark, sf_dir):
    """Article ids of the lines in each strip of 1000 pixels; no article shows as -."""
    rows = lines(spark, sf_dir).withColumn("strip", F.floor(F.element_at("baseline", 1)["y"] / 1000).cast("long"))
    return R.article_sets(rows, ["page_id", "strip"]).select("page_id", "strip", F.array_join("a_ids", ",", "-").alias("ids"))


def rectangles_by_article(spark, sf_dir):
    """Strips of each article; strips of no article with an id are blank."""
    rows = lines(spark, sf_dir).withColumn("strip", F.floor(F.element_at("baseline", 1)["y"] / 100).cast("long"))
    sets = R.article_sets(rows, ["page_id", "strip"]).withColumn("a_ids", F.array_compact("a_ids"))
    return R.rects_by_article(sets).groupBy("page_id", "article_id").agg(F.count("*").alias("n"))


def lines_by_article(spark, sf_dir):
    """Lines of each article in order; null is an article."""
    rows = lines(spark, sf_dir).groupBy("page_id", "article_id").agg(F.array_sort(F.collect_list("idx")).alias("ids"))
    return rows.select("page_id", "article_id", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def tagged_lines(spark, sf_dir):
    return lines(spark, sf_dir).where(F.col("article_id").isNotNull()).groupBy("page_id").agg(F.count("*").alias("n"))


def reading_order(spark, sf_dir):
    return R.reading_order(slanted(spark, sf_dir)).select("page_id", "idx", F.col("reading_order").cast("long").alias("reading_order"))


def lines_by_top(spark, sf_dir):
    return R.by_top(slanted(spark, sf_dir)).select("page_id", "idx", F.col("rank").cast("long").alias("rank"))


def region_numbers(spark, sf_dir):
    return R.region_numbers(lines(spark, sf_dir)).select("page_id", "idx", "region")


def article_text(spark, sf_dir):
    return R.article_texts(fixtures.sql(spark, sf_dir, fixtures.ARTICLE_TEXT))


def polygon_text_articles(spark, sf_dir):
    rows = R.text_articles(fixtures.sql(spark, sf_dir, fixtures.TEXT_LINES_SPARK))
    return rows.select("page_id", "article_no", F.size("polygons").cast("long").alias("n"), F.array_join("polygons", "\n").alias("polygons"))


def page_paths(spark, sf_dir):
    rows = fixtures.sql(spark, sf_dir, "SELECT page_id, regexp_replace(url, '[?#].*', '') AS p FROM pages")
    return rows.select("page_id", R.page_path(F.col("p")).alias("path"))


def text_paths(spark, sf_dir):
    rows = fixtures.sql(spark, sf_dir, "SELECT page_id, url FROM pages")
    return rows.select("page_id", R.text_path(F.col("url")).alias("beside"), R.text_path(F.col("url"), "out/").alias("inside"))


def output_names(spark, sf_dir):
    rows = fixtures.sql(spark, sf_dir, "SELECT page_id, concat('p/x.', CAST(page_id AS STRING), '.xml') AS xml_path FROM pages")
    return R.output_names(rows, "AB_A", "gt").select("page_id", "kind", "path")


def channel_names(spark, sf_dir):
    rows = fixtures.sql(spark, sf_dir, "SELECT page_id, concat('p/x', CAST(page_id AS STRING), '.tif') AS img_path FROM pages")
    return R.channel_names(rows, 2, "gt").select("page_id", "path")


def unfinished_pages(spark, sf_dir):
    """Pages whose files are not all there; even pages have all of theirs, every seventh lacks one."""
    wanted = output_names(spark, sf_dir)
    done = wanted.where("page_id % 2 = 0 AND NOT (page_id % 7 = 0 AND kind = 'grey')")
    return R.unfinished(wanted.select("page_id", "path"), done)


def zipped_lists(spark, sf_dir):
    """A list of pages beside a longer one of images: as long as the shorter."""
    a = fixtures.sql(spark, sf_dir, "SELECT page_id AS pos, concat('x', CAST(page_id AS STRING)) AS path FROM pages")
    b = fixtures.sql(spark, sf_dir, "SELECT vec_id AS pos, concat('ix', CAST(vec_id AS STRING)) AS path FROM embeddings")
    return R.zipped_lists(a, b)


def scale_factors(spark, sf_dir):
    rows = fixtures.sql(spark, sf_dir, "SELECT vec_id FROM embeddings").withColumn("h", F.col("vec_id") % 4000 + 500)
    return rows.select("vec_id", C.scale_factor(1800, F.col("h"), 0.5).alias("fixed"), C.scale_factor(0, F.col("h"), 0.05).alias("at_least"), C.scale_factor(0, F.col("h"), 0.05, None).alias("raw"))


def progress(spark, sf_dir):
    return R.progress(fixtures.sql(spark, sf_dir, "SELECT page_id FROM pages")).select("page_id", F.col("n").cast("long").alias("n"))


QUERIES = {f.__name__: f for f in (
    baseline_stats, print_space, scaled_points, rescaled_points, line_rings, line_clouds, raised_boxes, line_boxes, lone_line_boxes, article_boxes,
    article_id_sets, rectangles_by_article, lines_by_article, tagged_lines, reading_order, lines_by_top, region_numbers, article_text, polygon_text_articles,
    page_paths, text_paths, output_names, channel_names, unfinished_pages, zipped_lists, scale_factors, progress,
)}

# ---- DuckDB -----------------------------------------------------------------------------------

_L, _S = fixtures.LINES, fixtures.SLANTED
_POINTS = f"""p AS (
  SELECT page_id, idx, article_id, pos::INT AS pos, CASE pos WHEN 0 THEN x0 WHEN 1 THEN xm ELSE x1 END AS x, CASE pos WHEN 0 THEN y0 WHEN 1 THEN ym ELSE y1 END AS y
  FROM ({_S}) s, range(3) r(pos))"""
_DIST = f"""l AS MATERIALIZED ({_L}), d AS (
  SELECT a.page_id, a.idx, a.x0, a.x1, a.y, least(50, coalesce(min(abs(a.y - b.y)), 50)) AS dist
  FROM l a LEFT JOIN l b ON a.page_id = b.page_id AND a.idx <> b.idx AND a.x0 <= b.x1 AND b.x0 <= a.x1 GROUP BY ALL)"""
_LIFT = "greatest(trunc(0.95::DOUBLE * (idx / 2.0::DOUBLE))::BIGINT, 1)"
_NAMES = """SELECT page_id, kind, path FROM (SELECT page_id, concat('x.', page_id::VARCHAR) AS s FROM pages), LATERAL (VALUES
  ('boundary', concat('gt/C3/', s, '_GT0.png')), ('article', concat('gt/C3/', s, '_GT1.png')), ('other', concat('gt/C3/', s, '_GT2.png')),
  ('grey', concat('gt/', s, '.png')), ('rotation', concat('gt/', s, '.png.rot'))) v(kind, path)"""

SQL = {
    "baseline_stats": f"""WITH {_POINTS} SELECT page_id, idx, 1.0::DOUBLE / 3 * sum(y) AS mean_y, min(y) AS min_y, min(x) AS x, min(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h
      FROM p WHERE article_id IS NOT NULL GROUP BY page_id, idx""",
    "print_space": f"WITH {_POINTS} SELECT page_id, min(x) AS x, min(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h FROM p GROUP BY page_id",
    "scaled_points": f"WITH {_POINTS} SELECT page_id, idx, pos, trunc(x * 0.37::DOUBLE)::INT AS x, trunc(y * 0.37::DOUBLE)::INT AS y FROM p",
    "rescaled_points": f"""WITH {_POINTS} SELECT page_id, idx, pos, CASE page_id % 3 WHEN 0 THEN x ELSE trunc(x * (page_id % 3 / 2.0::DOUBLE)) END::INT AS x,
      CASE page_id % 3 WHEN 0 THEN y ELSE trunc(y * (page_id % 3 / 2.0::DOUBLE)) END::INT AS y FROM p""",
    "line_rings": f"WITH {_POINTS} SELECT page_id, idx, pos, x::INT AS x, y::INT AS y FROM p UNION ALL SELECT page_id, idx, 5 - pos, (x + 1)::INT, (y - {_LIFT})::INT FROM p",
    "line_clouds": f"WITH {_POINTS} SELECT page_id, idx, pos, x::INT AS x, y::INT AS y FROM p UNION ALL SELECT page_id, idx, 3 + pos, (x + 1)::INT, (y - {_LIFT})::INT FROM p",
    "raised_boxes": f"WITH {_DIST} SELECT page_id, idx, x0 AS x, y - dist AS y, x1 - x0 AS w, trunc(1.1::DOUBLE * dist)::BIGINT AS h FROM d",
    "line_boxes": f"""WITH {_POINTS}, q AS (SELECT page_id, idx, x, y FROM p UNION ALL SELECT page_id, idx, x + 1, y - 38 FROM p WHERE article_id = 'a1')
      SELECT page_id, idx, min(x) AS x, min(y) AS y, max(x) - min(x) AS w, max(y) - min(y) AS h FROM q GROUP BY page_id, idx""",
    "lone_line_boxes": f"""SELECT page_id, concat(coalesce(article_id, '-'), ':', (y // 100)::VARCHAR) AS article_id, min(x0) AS x, CASE count(*) WHEN 1 THEN min(y) - 10 ELSE min(y) END AS y, max(x1) - min(x0) AS w,
      CASE count(*) WHEN 1 THEN 10 ELSE max(y) - min(y) END AS h FROM ({_L}) GROUP BY ALL""",
    "article_boxes": f"SELECT page_id, article_id, min(x0) AS x, min(y) AS y, max(x1) - min(x0) AS w, max(y) - min(y) AS h FROM ({_L}) GROUP BY page_id, article_id",
    "article_id_sets": f"SELECT page_id, y // 1000 AS strip, string_agg(DISTINCT coalesce(article_id, '-'), ',' ORDER BY coalesce(article_id, '-')) AS ids FROM ({_L}) GROUP BY ALL",
    "rectangles_by_article": f"""WITH s AS (SELECT DISTINCT page_id, y // 100 AS strip, article_id FROM ({_L})), k AS (SELECT *, count(article_id) OVER (PARTITION BY page_id, strip) AS c FROM s)
      SELECT page_id, coalesce(article_id, 'blank') AS article_id, count(*) AS n FROM k WHERE article_id IS NOT NULL OR c = 0 GROUP BY ALL""",
    "lines_by_article": f"SELECT page_id, article_id, count(*) AS n, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS ids FROM ({_L}) GROUP BY page_id, article_id",
    "tagged_lines": f"SELECT page_id, count(*) AS n FROM ({_L}) WHERE article_id IS NOT NULL GROUP BY page_id",
    "reading_order": f"SELECT page_id, idx, row_number() OVER (PARTITION BY page_id, article_id ORDER BY 1.0::DOUBLE / 3 * (y0 + ym + y1), idx) - 1 AS reading_order FROM ({_S})",
    "lines_by_top": f"SELECT page_id, idx, row_number() OVER (PARTITION BY page_id, article_id ORDER BY least(y0, ym, y1), idx) - 1 AS rank FROM ({_S})",
    "region_numbers": f"""WITH l AS (SELECT page_id, idx, article_id, min(idx) OVER (PARTITION BY page_id, article_id) AS place FROM ({_L}))
      SELECT page_id, idx, concat('tr_', (dense_rank() OVER (PARTITION BY page_id ORDER BY place, CASE WHEN article_id IS NULL THEN idx ELSE place END) - 1)::VARCHAR) AS region FROM l""",
    "article_text": f"""WITH a AS (SELECT page_id, article_id, min(idx) AS place, coalesce(string_agg(text || chr(10), '' ORDER BY idx) FILTER (text <> ''), '') AS t FROM ({fixtures.ARTICLE_TEXT}) GROUP BY page_id, article_id)
      SELECT page_id, string_agg(t, chr(10) || repeat('#', 100) || chr(10) || chr(10) ORDER BY place) AS content FROM a GROUP BY page_id""",
    "polygon_text_articles": f"""WITH l AS MATERIALIZED ({fixtures.TEXT_LINES_DUCKDB}), r AS (SELECT *, sum((line = '')::INT) OVER (PARTITION BY page_id ORDER BY idx) - (line = '')::INT AS article_no FROM l),
      e AS (SELECT page_id, unnest(range(0, sum((line = '')::INT)::BIGINT + 1)) AS article_no FROM l GROUP BY page_id)
      SELECT e.page_id, e.article_no, count(line) FILTER (line <> '') AS n, coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (line <> ''), '') AS polygons
      FROM e LEFT JOIN r USING (page_id, article_no) GROUP BY e.page_id, e.article_no""",
    "page_paths": r"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*', '') AS p FROM pages), s AS (SELECT page_id, regexp_extract(p, '^(.*/)?([^/]*)$', 1) AS d, regexp_extract(p, '([^/]*)$', 1) AS f FROM p)
      SELECT page_id, d || 'page/' || CASE WHEN regexp_matches(f, '[^.].*\.[^.]*$') THEN regexp_replace(f, '\.[^.]*$', '') ELSE f END || '.xml' AS path FROM s""",
    "text_paths": r"SELECT page_id, url || '.txt' AS beside, 'out/' || regexp_extract(url, '([^/]*)$', 1) || '.txt' AS inside FROM pages",
    "output_names": _NAMES,
    "channel_names": "SELECT page_id, path FROM (SELECT page_id, concat('x', page_id::VARCHAR) AS s FROM pages), LATERAL (VALUES (concat('gt/C2/', s, '_GT0.png')), (concat('gt/C2/', s, '_GT1.png')), (concat('gt/', s, '.jpg')), (concat('gt/', s, '.jpg.rot'))) v(path)",
    "unfinished_pages": f"WITH w AS ({_NAMES}) SELECT DISTINCT page_id FROM w WHERE NOT (page_id % 2 = 0 AND NOT (page_id % 7 = 0 AND kind = 'grey'))",
    "zipped_lists": "SELECT page_id AS pos, concat('x', page_id::VARCHAR) AS xml_path, concat('ix', page_id::VARCHAR) AS img_path FROM pages SEMI JOIN embeddings ON vec_id = page_id",
    "scale_factors": "SELECT vec_id, 1800.0::DOUBLE / (vec_id % 4000 + 500) AS fixed, 0.1::DOUBLE AS at_least, 0.05::DOUBLE AS raw FROM embeddings",
    "progress": "SELECT page_id, row_number() OVER (ORDER BY page_id) AS n FROM pages",
}
