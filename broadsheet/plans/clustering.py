"""Queries on baselines: distances, neighbours, clusters, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import clustering as O
from . import fixtures


def lines(spark: SparkSession, sf_dir: str, by_page: bool = False) -> DataFrame:
    """page_id, idx, baseline of two points, article_id; by_page: dealt as folds over pages ask for it."""
    f = fixtures.sql(spark, sf_dir, fixtures.LINES, by_page)
    return f.select("page_id", "idx", C.points((F.col("x0"), F.col("y")), (F.col("x1"), F.col("y"))).alias("baseline"), "article_id")


def slanted(spark: SparkSession, sf_dir: str, by_page: bool = False) -> DataFrame:
    """page_id, idx, baseline of three points, article_id; by_page: dealt as folds over pages ask for it."""
    f = fixtures.sql(spark, sf_dir, fixtures.SLANTED, by_page)
    pts = C.points(*[(F.col(a), F.col(b)) for a, b in (("x0", "y0"), ("xm", "ym"), ("x1", "y1"))])
    return f.select("page_id", "idx", pts.alias("baseline"), "article_id")


def article_clustering(spark, sf_dir):
    """Flagship: distances, neighbours, clusters and tags of horizontal baselines."""
    return O.article_tags(O.cluster(lines(spark, sf_dir, True)))


def article_clustering_rescaled(spark, sf_dir):
    """The same after each page is scaled to a mean distance of 50."""
    return O.article_tags(O.cluster(lines(spark, sf_dir, True), target=50))


def clusters_of_three(spark, sf_dir):
    """Clusters of at least three lines; the others are noise."""
    return O.cluster(lines(spark, sf_dir, True), min_article=3)


def border_clusters(spark, sf_dir):
    """Core lines need three neighbours, so a line may border on several clusters."""
    return O.cluster(lines(spark, sf_dir, True), min_lines=3, min_article=2)


def interline_distance(spark, sf_dir):
    return O.interline_distances(lines(spark, sf_dir)).select("page_id", "idx", "dist")


def mean_interline_distance(spark, sf_dir):
    return O.page_means(O.interline_distances(lines(spark, sf_dir)))


def rescaled_baselines(spark, sf_dir):
    rows = O.rescaled_lines(O.interline_distances(lines(spark, sf_dir)), 50)
    first, last = F.element_at("baseline", 1), F.element_at("baseline", -1)
    return rows.select("page_id", "idx", first["x"].alias("x0"), first["y"].alias("y0"), last["x"].alias("x1"), last["y"].alias("y1"))


def neighbour_counts(spark, sf_dir):
    rows = O.with_mean(O.interline_distances(lines(spark, sf_dir)))
    return O.neighbours(rows).groupBy("page_id", "idx").agg(F.count("*").alias("n"))


def articles_of_page(spark, sf_dir):
    """Distinct labels of each page, noise included."""
    return clusters_of_three(spark, sf_dir).groupBy("page_id").agg(F.countDistinct("label").alias("n_labels"))


def expanded_boxes(spark, sf_dir):
    rows = O.with_mean(O.interline_distances(lines(spark, sf_dir)))
    d = C.clamped(F.col("dist"), F.col("mean_dist"))
    big = C.grown(F.col("box"), d, 1.25)
    return rows.select("page_id", "idx", d.alias("d"), *[big[c].cast("long").alias(f"big_{c}") for c in "xywh"])


def slanted_interline_distance(spark, sf_dir):
    """Lines of three points, with the spacing and limit of text regions; rounded, as sines differ in their last digits."""
    return O.distances(slanted(spark, sf_dir, True), 50, 100).select("page_id", "idx", F.round("dist", 6).alias("dist"))


def slanted_clustering(spark, sf_dir):
    """The flagship on baselines that are not horizontal."""
    return O.article_tags(O.cluster(slanted(spark, sf_dir, True)))


QUERIES = {f.__name__: f for f in (
    article_clustering, article_clustering_rescaled, clusters_of_three, border_clusters, interline_distance, mean_interline_distance,
    rescaled_baselines, neighbour_counts, articles_of_page, expanded_boxes, slanted_interline_distance, slanted_clustering,
)}

# ---- DuckDB -----------------------------------------------------------------------------------

_LINES = f"lines AS MATERIALIZED ({fixtures.LINES})"


def _distances(src: str, out: str) -> str:
    return f"""{out} AS MATERIALIZED (
  SELECT a.page_id, a.idx, a.x0, a.x1, a.y, least(500, coalesce(min(abs(a.y - b.y)), 500))::DOUBLE AS dist
  FROM {src} a LEFT JOIN {src} b ON a.page_id = b.page_id AND a.idx <> b.idx AND a.x0 <= b.x1 AND b.x0 <= a.x1
  GROUP BY ALL)"""


_MEANS = """means AS (
  SELECT page_id, count(*) FILTER (dist > 0) AS n_positive,
    CASE WHEN count(*) FILTER (dist > 0) > 0 THEN 1.0::DOUBLE / count(*) FILTER (dist > 0) * sum(dist) FILTER (dist > 0) END AS mean_exact,
    1.0::DOUBLE / (count(*) FILTER (dist > 0) + 1e-8::DOUBLE) * coalesce(sum(dist) FILTER (dist > 0), 0) AS mean_dist
  FROM d GROUP BY page_id)"""


def _scaled(then: str) -> str:
    return f"""WITH RECURSIVE {_LINES}, {_distances('lines', 'd')}, {_MEANS},
scaled AS MATERIALIZED (
  SELECT page_id, idx, trunc(x0 * f)::BIGINT AS x0, trunc(x1 * f)::BIGINT AS x1, trunc(y * f)::BIGINT AS y
  FROM d JOIN (SELECT page_id, coalesce(50.0::DOUBLE / mean_exact, 1.0::DOUBLE) AS f FROM means) USING (page_id))
{then}"""


_BIG = """big AS MATERIALIZED (
  SELECT d.*, CASE WHEN dist BETWEEN 0.5::DOUBLE * mean_dist AND 1.5::DOUBLE * mean_dist THEN dist ELSE mean_dist END AS c,
    trunc(y - 1.25::DOUBLE * c)::BIGINT AS top, trunc(2.5::DOUBLE * c)::BIGINT AS bh
  FROM {d} d JOIN {means} m USING (page_id)),
one_way AS (
  SELECT a.page_id, a.idx, b.idx AS other FROM big a JOIN big b ON a.page_id = b.page_id AND a.idx <> b.idx
    AND least(a.x1, b.x1) >= greatest(a.x0, b.x0) AND b.y BETWEEN a.top AND a.top + a.bh
    AND least(a.x1, b.x1) - greatest(a.x0, b.x0) + 1 >= 0.95::DOUBLE * (b.x1 - b.x0 + 1)),
links AS MATERIALIZED (SELECT * FROM one_way UNION SELECT page_id, other, idx FROM one_way)"""


def _labels(src: str, core: int, article: int) -> str:
    size = "label" if article == 1 else f"CASE WHEN count(*) OVER (PARTITION BY page_id, label) < {article} THEN -1 ELSE label END"
    fresh = "CASE WHEN label = -1 THEN max(label) OVER (PARTITION BY page_id) + sum((label = -1)::INT) OVER (PARTITION BY page_id ORDER BY idx) ELSE label END" if article == 1 else size
    return f"""core AS MATERIALIZED (SELECT page_id, idx FROM links GROUP BY ALL HAVING count(*) >= {core}),
cc AS MATERIALIZED (SELECT l.page_id, l.idx, l.other FROM links l JOIN core c USING (page_id, idx) JOIN core e ON e.page_id = l.page_id AND e.idx = l.other),
reach AS (SELECT page_id, idx AS root, idx FROM core UNION SELECT r.page_id, r.root, c.other FROM reach r JOIN cc c ON r.page_id = c.page_id AND r.idx = c.idx),
roots AS (SELECT page_id, idx, min(root) AS root FROM reach GROUP BY ALL),
numbered AS (SELECT page_id, idx, dense_rank() OVER (PARTITION BY page_id ORDER BY root) AS label FROM roots),
border AS (SELECT l.page_id, l.idx, min(n.label) AS label FROM links l ANTI JOIN core c USING (page_id, idx) JOIN numbered n ON n.page_id = l.page_id AND n.idx = l.other GROUP BY ALL),
first_labels AS (SELECT s.page_id, s.idx, coalesce(n.label, b.label, -1) AS label FROM {src} s LEFT JOIN numbered n USING (page_id, idx) LEFT JOIN border b USING (page_id, idx)),
labels AS (SELECT page_id, idx, ({fresh})::BIGINT AS label FROM first_labels)"""


_TAGS = "SELECT page_id, idx, CASE WHEN label <> -1 THEN concat('a', label::VARCHAR) END AS article_id FROM labels"
_PLAIN = f"WITH RECURSIVE {_LINES}, {_distances('lines', 'd')}, {_MEANS}"
_LINKED = f"{_PLAIN}, {_BIG.format(d='d', means='means')}"
_MEANS2 = _MEANS.replace("means AS", "means2 AS").replace("FROM d ", "FROM d2 ")

SQL = {
    "article_clustering": f"{_LINKED}, {_labels('lines', 2, 1)} {_TAGS}",
    "article_clustering_rescaled": _scaled(f", {_distances('scaled', 'd2')}, {_MEANS2}, {_BIG.format(d='d2', means='means2')}, {_labels('scaled', 2, 1)} {_TAGS}"),
    "clusters_of_three": f"{_LINKED}, {_labels('lines', 2, 3)} SELECT * FROM labels",
    "border_clusters": f"{_LINKED}, {_labels('lines', 3, 2)} SELECT * FROM labels",
    "interline_distance": f"{_PLAIN} SELECT page_id, idx, dist FROM d",
    "mean_interline_distance": f"{_PLAIN} SELECT * FROM means",
    "rescaled_baselines": _scaled("SELECT page_id, idx, x0::INT AS x0, y::INT AS y0, x1::INT AS x1, y::INT AS y1 FROM scaled"),
    "neighbour_counts": f"{_LINKED} SELECT page_id, idx, count(*) AS n FROM links GROUP BY ALL",
    "articles_of_page": f"{_LINKED}, {_labels('lines', 2, 3)} SELECT page_id, count(DISTINCT label) AS n_labels FROM labels GROUP BY ALL",
    "expanded_boxes": f"{_LINKED} SELECT page_id, idx, c AS d, x0 AS big_x, top AS big_y, x1 - x0 AS big_w, bh AS big_h FROM big",
}
