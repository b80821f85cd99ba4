"""Ground-truth images of pages: channels of white on black, one byte a pixel.

An image travels as page_id, channel, h, w, data (h * w bytes in row order).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import planar as P
from .articles import _lines as page_lines
from .articles import article_rectangles, merged_outlines
from .clustering import by_page, polylines
from .records import CHANNELS

IMAGES = "page_id long, channel int, h int, w int, data binary"


def rescale(points, factor: float) -> list[tuple[int, int]]:
    """Points times factor, cut toward zero; as they are where the factor is zero or none."""
    return [(int(x * factor), int(y * factor)) for x, y in points] if factor else [tuple(p) for p in points]


def article_image(outlines: list, factor: float, height: int, width: int, fill: bool = False) -> np.ndarray:
    """Outlines, thickened (dilation 10, erosion 5); or filled as they are. No outline: a black image."""
    img = np.zeros((round(height * factor), round(width * factor)), np.uint8)
    for points in outlines:
        P.draw_polygon(img, rescale(points, factor), fill)
    if fill:
        return img
    return P.swept(P.swept(img, 10, 10), 5, 5, np.minimum)


def baseline_image(baselines: list, factor: float, height: int, width: int) -> np.ndarray:
    """Baselines as open lines, thickened by a dilation of one column and three rows."""
    img = np.zeros((round(height * factor), round(width * factor)), np.uint8)
    for points in baselines:
        P.draw_lines(img, rescale(points, factor))
    return P.swept(img, 3, 1)


def region_image(polygons: list, factor: float, height: int, width: int, fill: bool = True, shape: str = "polygon") -> np.ndarray:
    """Regions filled, or as closed lines of width 7; each as it is, as its box ('box') or its smallest rectangle ('rotated')."""
    img = np.zeros((round(height * factor), round(width * factor)), np.uint8)
    for points in polygons:
        made = P.corners(P.box_of(points)) if shape == "box" else P.min_area_box(points) if shape == "rotated" else points
        P.draw_polygon(img, rescale(made, factor), fill, 1 if fill else 7)
    return img


def other_image(*channels: np.ndarray) -> np.ndarray:
    """White less all channels in 8-bit arithmetic, kept where that is 0 or 255."""
    left = np.full(channels[0].shape, 255, np.uint8)
    for c in channels:
        left = left - c
    return np.where(left == 255, left, 0).astype(np.uint8)


def disjoint_images(channels: list[np.ndarray]) -> list[np.ndarray]:
    """Each image black where it equals the one before it, as that was at first."""
    return channels[:1] + [np.where(a == b, 0, b).astype(np.uint8) for a, b in zip(channels, channels[1:])]


def article_channels(mode: str, outlines: list, baselines: list, factor: float, height: int, width: int) -> dict[str, np.ndarray]:
    """The images of a mode by channel name, in the order of CHANNELS; article is the filled image less its boundary."""
    names = CHANNELS[mode.lower()]
    made: dict[str, np.ndarray] = {"boundary": article_image(outlines, factor, height, width)}
    if "article" in names:
        made["article"] = article_image(outlines, factor, height, width, True) - made["boundary"]
    if "baselines" in names:
        made["baselines"] = baseline_image(baselines, factor, height, width)
    made["other"] = other_image(*[made[n] for n in names if n != "other"])
    return {n: made[n] for n in names}


def _image_rows(page_id: int, images: list[np.ndarray]) -> list[dict]:
    return [{"page_id": page_id, "channel": k, "h": i.shape[0], "w": i.shape[1], "data": np.ascontiguousarray(i).tobytes()} for k, i in enumerate(images)]


def _schema():
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(IMAGES))


def _size_of(page: pa.Table, height: int, width: int, factor: float) -> tuple[int, int, float]:
    """height, width and factor: the page's own columns img_height, img_width and factor where it has them."""
    own = [page[c][0].as_py() if c in page.column_names else None for c in ("img_height", "img_width", "factor")]
    return tuple(given if found is None else found for found, given in zip(own, (height, width, factor)))


def article_ground_truth(outlines: DataFrame, lines: DataFrame, height: int = 0, width: int = 0, mode: str = "ab_bl", factor: float = 0.5) -> DataFrame:
    """Images of every page that has lines. outlines: page_id, article_id, points; lines: page_id, idx, baseline, and
    img_height, img_width and factor where pages differ in them. Outlines without article are not drawn."""
    arrow = _schema()

    def xy(rows) -> list:
        return [[(p["x"], p["y"]) for p in r] for r in rows if r]

    def run(shapes: pa.Table, own: pa.Table) -> pa.Table:
        if not own.num_rows:
            return arrow.empty_table()
        drawn = [p for p, a in zip(shapes["points"].to_pylist(), shapes["article_id"].to_pylist()) if a is not None]
        h, w, f = _size_of(own, height, width, factor)
        images = article_channels(mode, xy(drawn), xy(own.sort_by("idx")["baseline"].to_pylist()), f, h, w)
        return pa.Table.from_pylist(_image_rows(own["page_id"][0].as_py(), list(images.values())), schema=arrow)

    return by_page(outlines).cogroup(by_page(lines)).applyInArrow(run, IMAGES)


def line_ground_truth(lines: DataFrame, height: int = 0, width: int = 0, mode: str = "ab_bl", factor: float = 0.5, use_surrounding: bool = False, least_width: int = 20) -> DataFrame:
    """article_ground_truth() of articles.outlines() of the same lines, in one fold, so that a page's lines travel once."""
    arrow = _schema()

    def run(page: pa.Table) -> pa.Table:
        outlines = merged_outlines(article_rectangles(page_lines(page), use_surrounding), least_width)
        drawn = [o["outline"] for o in outlines if o["article_id"] is not None]
        points, first, last = polylines(page.sort_by("idx")["baseline"])
        baselines = [points[a:b].tolist() for a, b in zip(first, last) if b > a]
        h, w, f = _size_of(page, height, width, factor)
        return pa.Table.from_pylist(_image_rows(page["page_id"][0].as_py(), list(article_channels(mode, drawn, baselines, f, h, w).values())), schema=arrow)

    return by_page(lines).applyInArrow(run, IMAGES)


def text_block_ground_truth(regions: DataFrame, height: int = 0, width: int = 0, factor: float = 1.0, shape: str = "polygon") -> DataFrame:
    """Two images of each page: its regions (page_id, points, and img_height, img_width and factor where pages differ in
    them) filled, and the rest; disjoint."""
    arrow = _schema()

    def run(page: pa.Table) -> pa.Table:
        polygons = [[(p["x"], p["y"]) for p in r] for r in page["points"].to_pylist() if r]
        h, w, f = _size_of(page, height, width, factor)
        filled = region_image(polygons, f, h, w, True, shape)
        return pa.Table.from_pylist(_image_rows(page["page_id"][0].as_py(), disjoint_images([filled, other_image(filled)])), schema=arrow)

    return by_page(regions).applyInArrow(run, IMAGES)


def white_pixels(images: DataFrame) -> DataFrame:
    """page_id, channel, h, w, n_white."""

    def run(batches):
        for b in batches:
            white = [int(np.count_nonzero(np.frombuffer(d, np.uint8))) for d in b.column(b.schema.get_field_index("data")).to_pylist()]
            keep = [b.column(b.schema.get_field_index(c)) for c in ("page_id", "channel", "h", "w")]
            yield pa.record_batch([*keep, pa.array(white, pa.int64())], ["page_id", "channel", "h", "w", "n_white"])

    return images.mapInArrow(run, "page_id long, channel int, h int, w int, n_white long")


def to_pixels(images: DataFrame) -> DataFrame:
    """img_id, channel, y, x, v: images as pixel tables."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                v = np.frombuffer(r["data"], np.uint8)
                n = len(v)
                y, x = np.divmod(np.arange(n), max(1, r["w"]))
                cols = [np.full(n, r["page_id"]), np.full(n, r["channel"], np.int32), y.astype(np.int32), x.astype(np.int32), v.astype(np.int32)]
                yield pa.record_batch([pa.array(c) for c in cols], ["img_id", "channel", "y", "x", "v"])

    return images.select("page_id", "channel", "h", "w", "data").mapInArrow(run, "img_id long, channel int, y int, x int, v int")


def rotated(pixels: DataFrame, degrees: float) -> DataFrame:
    """Pixels turned about the middle of their image, which keeps its size: each takes the nearest source pixel, or 0."""
    size = pixels.groupBy("img_id").agg((F.max("y") / 2).alias("_cy"), (F.max("x") / 2).alias("_cx"))
    a = np.deg2rad(degrees)
    rows = pixels.join(size, "img_id")
    dy, dx = F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx")
    at = rows.select("img_id", "y", "x", F.round(float(np.cos(a)) * dy - float(np.sin(a)) * dx + F.col("_cy")).cast("int").alias("_y"), F.round(float(np.sin(a)) * dy + float(np.cos(a)) * dx + F.col("_cx")).cast("int").alias("_x"))
    source = pixels.select("img_id", F.col("y").alias("_y"), F.col("x").alias("_x"), "v")
    return at.join(source, ["img_id", "_y", "_x"], "left").select("img_id", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))
