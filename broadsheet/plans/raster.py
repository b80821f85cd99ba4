"""Queries on pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import raster as R
from . import fixtures


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.sql(spark, sf_dir, fixtures.PIXELS_SPARK)


def _inked(spark, sf_dir, threshold=150):
    """0 or 255."""
    return R.binarized(pixels(spark, sf_dir), threshold).withColumn("v", F.col("v") * 255)


def _channels(spark, sf_dir):
    p = pixels(spark, sf_dir)
    cuts = F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), F.lit(t).alias("t")) for k, t in enumerate((100, 130, 160))]))
    return p.withColumn("_c", cuts).select("img_id", "_c.channel", "y", "x", F.when(F.col("v") > F.col("_c.t"), 255).otherwise(0).alias("v"))


def row_profiles(spark, sf_dir):
    return R.profile(_inked(spark, sf_dir))


def column_separators(spark, sf_dir):
    return R.separators(_inked(spark, sf_dir), 0.3, "x")


def gap_ranges(spark, sf_dir):
    marks = R.separators(_inked(spark, sf_dir), 0.3)
    return R.gaps(marks, F.lit(8), F.lit(0), ["img_id"])


def thresholded(spark, sf_dir):
    return R.binarized(pixels(spark, sf_dir), 127.5)


def other_channel(spark, sf_dir):
    return R.other_channel(_channels(spark, sf_dir))


def disjoint_channels(spark, sf_dir):
    return R.disjoint(_channels(spark, sf_dir))


def filled_minus_outline(spark, sf_dir):
    c = _channels(spark, sf_dir)
    return R.minus(c.where("channel = 2").drop("channel"), c.where("channel = 0").drop("channel"))


def dilated(spark, sf_dir):
    return R.dilated(pixels(spark, sf_dir), 10, 10)


def dilated_then_eroded(spark, sf_dir):
    return R.eroded(R.dilated(_inked(spark, sf_dir), 1, 3), 5, 5)


def blurred(spark, sf_dir):
    return R.blurred(pixels(spark, sf_dir))


def otsu_thresholds(spark, sf_dir):
    return R.otsu(pixels(spark, sf_dir))


def halved(spark, sf_dir):
    return R.halved(pixels(spark, sf_dir))


def pixel_components(spark, sf_dir):
    return R.pixel_components(_inked(spark, sf_dir), 8, 8)


def same_shapes(spark, sf_dir):
    """Images of ten to a page; every 50th counts one row less."""
    p = pixels(spark, sf_dir).groupBy("img_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    p = p.select(F.floor(F.col("img_id") / 10).alias("page_id"), (F.col("h") - F.when(F.col("img_id") % 50 == 0, 1).otherwise(0)).alias("h"), "w")
    return R.same_shapes(p)


def xy_cut(spark, sf_dir):
    return R.xy_cut(_inked(spark, sf_dir, 165), threshold=0.85)


QUERIES = {f.__name__: f for f in (
    row_profiles, column_separators, gap_ranges, thresholded, other_channel, disjoint_channels, filled_minus_outline, dilated, dilated_then_eroded,
    blurred, otsu_thresholds, halved, pixel_components, same_shapes, xy_cut,
)}

_P = f"p AS MATERIALIZED ({fixtures.PIXELS_DUCKDB})"
_INK = "k AS MATERIALIZED (SELECT img_id, y, x, CASE WHEN v > {t} THEN 255 ELSE 0 END AS v FROM p)"
_I = _INK.format(t=150)
_CH = f"{_P}, c AS MATERIALIZED (SELECT img_id, k::INT AS channel, y, x, CASE WHEN v > t THEN 255 ELSE 0 END AS v FROM p, (VALUES (0, 100), (1, 130), (2, 160)) h(k, t))"


def _sweep(src: str, best: str, rows: int, cols: int) -> str:
    def frame(n: int) -> str:
        return f"ROWS BETWEEN {n // 2} PRECEDING AND {n - 1 - n // 2} FOLLOWING"

    first = f"SELECT img_id, y, x, {best}(v) OVER (PARTITION BY img_id, y ORDER BY x {frame(cols)}) AS v FROM {src}"
    return f"SELECT img_id, y, x, {best}(v) OVER (PARTITION BY img_id, x ORDER BY y {frame(rows)}) AS v FROM ({first})"


def _gaps(src: str, extent: str, least: str, key: str) -> str:
    return f"""SELECT {key}, lo::INT AS lo, hi::INT AS hi FROM (
      SELECT {key}, 0 AS lo, i AS hi, i - 0 AS n FROM g WHERE f IS NULL
      UNION ALL SELECT {key}, i + 1, nx, nx - i FROM g WHERE nx IS NOT NULL
      UNION ALL SELECT {key}, i, {extent} - 1, {extent} - 1 - i FROM g WHERE nx IS NULL) WHERE n > {least}""".replace("FROM g", f"FROM (SELECT *, lag(i) OVER (PARTITION BY {key} ORDER BY i) AS f, lead(i) OVER (PARTITION BY {key} ORDER BY i) AS nx FROM {src})")


def _cut() -> str:
    ctes, threshold = [_P, _INK.format(t=165), "r0 AS (SELECT DISTINCT img_id, 0 AS x, 0 AS y, 8 AS w, 8 AS h FROM k)"], 0.85
    for n in range(4):
        a, at, ext = ("y", "r.y", "r.h") if n % 2 == 0 else ("x", "r.x", "r.w")
        extent = "h" if n % 2 == 0 else "w"
        ctes.append(f"""s{n} AS (SELECT img_id, r.x, r.y, r.w, r.h, k.{a} - {at} AS i FROM k JOIN r{n} r USING (img_id) WHERE k.x BETWEEN r.x AND r.x + r.w - 1 AND k.y BETWEEN r.y AND r.y + r.h - 1
          GROUP BY img_id, r.x, r.y, r.w, r.h, i HAVING sum(255 - k.v) / 255.0::DOUBLE / count(*) > {threshold!r}::DOUBLE)""")
        span = _gaps(f"s{n}", extent, "0", "img_id, x, y, w, h")
        box = "x, y + lo AS y, w, hi - lo AS h" if n % 2 == 0 else "x + lo AS x, y, hi - lo AS w, h"
        ctes.append(f"r{n + 1} AS (SELECT img_id, {box} FROM ({span}) WHERE hi > lo)")
        threshold = max(0.9 * threshold, 0.65)
    return f"WITH {', '.join(ctes)} " + " UNION ALL ".join(f"SELECT img_id, {n}::INT AS depth, x::INT AS x, y::INT AS y, w::INT AS w, h::INT AS h FROM r{n}" for n in range(1, 5))


SQL = {
    "row_profiles": f"WITH {_P}, {_I} SELECT img_id, y AS i, sum(v) / 255.0::DOUBLE AS ink FROM k GROUP BY ALL",
    "column_separators": f"WITH {_P}, {_I} SELECT img_id, x AS i, sum(v) / 255.0::DOUBLE / count(*) AS score FROM k GROUP BY ALL HAVING score > 0.3::DOUBLE",
    "gap_ranges": f"WITH {_P}, {_I}, m AS (SELECT img_id, y AS i, sum(v) / 255.0::DOUBLE / count(*) AS score FROM k GROUP BY ALL HAVING score > 0.3::DOUBLE) {_gaps('m', '8', '0', 'img_id')}",
    "thresholded": f"WITH {_P} SELECT img_id, y, x, (v > 127.5)::INT AS v FROM p",
    "other_channel": f"WITH {_CH} SELECT img_id, y, x, CASE WHEN ((255 - sum(v)) % 256 + 256) % 256 = 255 THEN 255 ELSE 0 END AS v FROM c GROUP BY ALL",
    "disjoint_channels": f"WITH {_CH} SELECT img_id, channel, y, x, CASE WHEN lag(v) OVER (PARTITION BY img_id, y, x ORDER BY channel) = v THEN 0 ELSE v END AS v FROM c",
    "filled_minus_outline": f"WITH {_CH} SELECT a.img_id, a.y, a.x, (a.v - b.v + 256) % 256 AS v FROM c a JOIN c b USING (img_id, y, x) WHERE a.channel = 2 AND b.channel = 0",
    "dilated": f"WITH {_P} {_sweep('p', 'max', 10, 10)}",
    "dilated_then_eroded": f"WITH {_P}, {_I}, d AS ({_sweep('k', 'max', 1, 3)}) {_sweep('d', 'min', 5, 5)}",
    "blurred": f"""WITH {_P}, b(d, wt) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)), m AS (SELECT d, wt, t, CASE WHEN abs(t + d) > 7 THEN 14 - abs(t + d) ELSE abs(t + d) END AS s FROM b, range(8) r(t)),
      h AS (SELECT img_id, y, t AS x, sum(v * wt) AS v FROM p JOIN m ON x = s GROUP BY ALL)
      SELECT img_id, t::INT AS y, x::INT AS x, floor((sum(v * wt) + 128) / 256.0)::INT AS v FROM h JOIN m ON y = s GROUP BY img_id, t, x""",
    "otsu_thresholds": f"""WITH {_P}, n AS (SELECT img_id, v, count(*) AS n FROM p GROUP BY ALL),
      u AS (SELECT img_id, v, sum(n) OVER a AS w0, sum(n * v) OVER a AS s0, sum(n) OVER e AS w, sum(n * v) OVER e AS s FROM n WINDOW a AS (PARTITION BY img_id ORDER BY v), e AS (PARTITION BY img_id)),
      b AS (SELECT img_id, v, CASE WHEN w0 < w THEN (w * s0 - w0 * s)::DOUBLE * (w * s0 - w0 * s)::DOUBLE / (w0 * (w - w0))::DOUBLE ELSE 0 END AS b FROM u)
      SELECT img_id, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY img_id ORDER BY b DESC, v) AS k FROM b) WHERE k = 1""",
    "halved": f"WITH {_P} SELECT img_id, (y // 2)::INT AS y, (x // 2)::INT AS x, ((sum(v) + 2) // 4)::INT AS v FROM p GROUP BY img_id, y // 2, x // 2",
    "pixel_components": f"""WITH RECURSIVE {_P}, {_I}, o AS MATERIALIZED (SELECT img_id, y, x, y * 8 + x AS n FROM k WHERE v > 0),
      e AS MATERIALIZED (SELECT a.img_id, a.n AS s, b.n AS t FROM o a JOIN o b ON a.img_id = b.img_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.n <> b.n),
      r AS (SELECT img_id, n AS root, n FROM o UNION SELECT r.img_id, r.root, e.t FROM r JOIN e ON r.img_id = e.img_id AND r.n = e.s),
      m AS (SELECT img_id, n, min(root) AS root FROM r GROUP BY ALL)
      SELECT img_id, y, x, dense_rank() OVER (PARTITION BY img_id ORDER BY root)::INT AS label FROM o JOIN m USING (img_id, n)""",
    "same_shapes": f"""WITH {_P}, s AS (SELECT img_id, max(y) + 1 - (img_id % 50 = 0)::INT AS h, max(x) + 1 AS w FROM p GROUP BY img_id)
      SELECT img_id // 10 AS page_id, count(DISTINCT (h, w)) = 1 AS same FROM s GROUP BY ALL""",
    "xy_cut": _cut(),
}
