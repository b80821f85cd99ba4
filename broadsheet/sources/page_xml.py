"""PAGE-XML documents, list files, polygon files and images as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators.records import text_articles
from .png import read_grey

_COORDS = "Coords: struct<_points: string>"
_LINE = f"struct<_id: string, _custom: string, Baseline: struct<_points: string>, {_COORDS}, TextEquiv: array<struct<Unicode: string>>>"
_REGION = f"struct<_id: string, _custom: string, _type: string, {_COORDS}, TextLine: array<{_LINE}>>"
#: Element names of regions; ImageRegion counts as ImageRegions.
REGION_TYPES = ("TextRegion", "GraphicRegion", "ImageRegion", "SeparatorRegion")
PAGE_SCHEMA = (
    "struct<_imageFilename: string, _imageWidth: int, _imageHeight: int, PrintSpace: struct<Coords: struct<_points: string>>, "
    + ", ".join(f"{t}: array<{_REGION}>" for t in REGION_TYPES)
    + ">"
)


def points(text: Column) -> Column:
    """'x,y x,y ...' as points; null for null and for text without a pair."""
    pairs = F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?,-?\d+(?:\.\d+)?)"))
    got = F.transform(pairs, lambda p: F.struct(F.split(p, ",")[0].cast("double").cast("int").alias("x"), F.split(p, ",")[1].cast("double").cast("int").alias("y")))
    return F.when(F.size(got) > 0, got)


def article_id(custom: Column) -> Column:
    """The id in structure {... id:a1; ...} of a custom attribute."""
    return F.nullif(F.regexp_extract(custom, r"structure\s*\{[^}]*?\bid:\s*([^;}]+?)\s*;", 1), F.lit(""))


def reading_index(custom: Column) -> Column:
    return F.nullif(F.regexp_extract(custom, r"readingOrder\s*\{[^}]*?\bindex:\s*(\d+)\s*;", 1), F.lit("")).cast("int")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: page_id (its path), parsed Page element, error (null, or why it is none). Whole files, never split."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    return parse_pages(files.select(F.col("path").alias("page_id"), F.col("content").cast("string").alias("xml")))


def parse_pages(files: DataFrame) -> DataFrame:
    """files (page_id, xml) with their Page element; one that cannot be read has an error instead, never silence."""
    page = F.regexp_extract(F.regexp_replace("xml", r"<(/?)[A-Za-z][\w.-]*:(?=[A-Za-z])", "<$1"), r"(?s)(<Page\b.*</Page>)", 1)
    parsed = F.from_xml(page, PAGE_SCHEMA, {"mode": "PERMISSIVE", "attributePrefix": "_"})
    rows = files.withColumn("page", F.when(page != "", parsed))
    bad = F.col("page").isNull() | (F.col("page._imageWidth").isNull() & F.col("page.TextRegion").isNull())
    return rows.withColumn("error", F.when(bad, F.lit("no readable Page element"))).drop("xml")


def pages(parsed: DataFrame) -> DataFrame:
    """page_id, xml_path, img_path, img_width, img_height, print_space."""
    p = F.col("page")
    return parsed.where("error IS NULL").select(
        "page_id", F.col("page_id").alias("xml_path"), p["_imageFilename"].alias("img_path"), p["_imageWidth"].alias("img_width"), p["_imageHeight"].alias("img_height"),
        points(p["PrintSpace"]["Coords"]["_points"]).alias("print_space"),
    )


def text_lines(parsed: DataFrame) -> DataFrame:
    """page_id, idx, line_id, text, baseline, surr_p, article_id, reading_order, in document order."""
    lines = F.flatten(F.filter(F.transform("page.TextRegion", lambda r: r["TextLine"]), lambda x: x.isNotNull()))
    rows = parsed.where("error IS NULL").select("page_id", F.posexplode(lines).alias("idx", "l"))
    line = F.col("l")
    return rows.select(
        "page_id", F.col("idx").cast("long").alias("idx"), line["_id"].alias("line_id"), F.get(line["TextEquiv"], F.lit(0))["Unicode"].alias("text"),
        points(line["Baseline"]["_points"]).alias("baseline"), points(line["Coords"]["_points"]).alias("surr_p"),
        article_id(line["_custom"]).alias("article_id"), reading_index(line["_custom"]).alias("reading_order"),
    )


def regions(parsed: DataFrame) -> DataFrame:
    """page_id, region_id, region_type, points, reading_order; a type a page lacks has no rows."""
    parts = []
    for t in REGION_TYPES:
        rows = parsed.where("error IS NULL").select("page_id", F.explode(F.col(f"page.{t}")).alias("r"))
        parts.append(rows.select("page_id", F.col("r._id").alias("region_id"), F.lit("ImageRegions" if t == "ImageRegion" else t).alias("region_type"), points(F.col("r.Coords._points")).alias("points"), reading_index(F.col("r._custom")).alias("reading_order")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def article_polygons(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """page_id, with_none, without_none (arrays of articles, each an array of baselines), error.

    Articles stand in page order; the error is true where no article but the null one has lines, or the page could not be read.
    """
    rows = lines.groupBy("page_id", "article_id").agg(F.min("idx").alias("place"), F.array_sort(F.collect_list(F.struct("idx", "baseline"))).alias("own"))
    rows = rows.withColumn("own", F.transform(F.filter("own", lambda o: o["baseline"].isNotNull()), lambda o: o["baseline"]))
    got = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("place", "article_id", "own"))).alias("a"))
    own = lambda keep: F.transform(F.filter("a", keep), lambda x: x["own"])
    got = got.select("page_id", own(lambda x: F.lit(True)).alias("with_none"), own(lambda x: x["article_id"].isNotNull()).alias("without_none"))
    out = parsed.select("page_id", F.col("error").isNotNull().alias("_bad")).join(got, "page_id", "left")
    return out.select("page_id", "with_none", F.when(F.size("without_none") > 0, F.col("without_none")).alias("without_none"), (F.col("_bad") | F.coalesce(F.size("without_none") == 0, F.lit(True))).alias("error"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """pos, path: a list file, a path on each line, trailing white space off. The lines of each file keep their order."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")).alias("pos", "path"))
    return rows.select("pos", F.rtrim(F.col("path")).alias("path"))


def list_folder(spark: SparkSession, path: str) -> DataFrame:
    """path: the files of a folder, not those of its folders. Contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path")


def read_polygon_text(spark: SparkSession, path: str) -> DataFrame:
    """page_id, article_no, polygons (arrays of points): a polygon on each line as 'x,y;x,y', an empty line ends an article."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page_id"), "value")
    lines = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n")
    rows = text_articles(whole.where("value <> ''").select("page_id", F.posexplode(lines).alias("idx", "line")))
    return rows.select("page_id", "article_no", F.transform("polygons", points).alias("polygons"))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Polygons by article from a .txt or .xml path; other names are refused."""
    if path.endswith(".txt"):
        return read_polygon_text(spark, path)
    if path.endswith(".xml"):
        parsed = read_pages(spark, path)
        return article_polygons(text_lines(parsed), parsed)
    raise ValueError(f"neither .txt nor .xml: {path}")


def read_grey_images(spark: SparkSession, path: str) -> DataFrame:
    """path, h, w, data, error: grey PNG files, decoded where they lie."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path).select("path", "content")

    def decoded(batches):
        for b in batches:
            rows = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    img = read_grey(data)
                    rows.append((name, *img.shape, np.ascontiguousarray(img).tobytes(), None))
                except (ValueError, KeyError) as e:
                    rows.append((name, None, None, None, str(e)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], ["path", "h", "w", "data", "error"])

    return files.mapInArrow(decoded, "path string, h int, w int, data binary, error string")


