"""Orders, texts and groups of lines on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

RULE = "#" * 100


def reading_order(lines: DataFrame, region: str = "article_id") -> DataFrame:
    """lines with reading_order: 0-based rank by mean height in page and region; equal ones in page order."""
    by = Window.partitionBy("page_id", region).orderBy(C.mean_of(F.col("baseline"), "y"), "idx")
    return lines.withColumn("reading_order", F.row_number().over(by) - 1)


def by_top(lines: DataFrame) -> DataFrame:
    """lines with rank: 0-based place by least height on the page and article; equal ones in page order."""
    by = Window.partitionBy("page_id", "article_id").orderBy(C.min_of(F.col("baseline"), "y"), "idx")
    return lines.withColumn("rank", F.row_number().over(by) - 1)


def article_place() -> Column:
    """Where a line's article begins on its page: articles stand in the order of their first lines. Null is an article."""
    return F.min("idx").over(Window.partitionBy("page_id", "article_id"))


def region_numbers(lines: DataFrame) -> DataFrame:
    """lines with region: tr_0, tr_1, ... in article order; lines without article are regions of their own."""
    rows = lines.withColumn("_place", article_place())
    by = Window.partitionBy("page_id").orderBy("_place", F.when(F.col("article_id").isNull(), F.col("idx")).otherwise(F.col("_place")))
    return rows.withColumn("region", F.concat(F.lit("tr_"), (F.dense_rank().over(by) - 1).cast("string"))).drop("_place")


def article_texts(lines: DataFrame) -> DataFrame:
    """page_id, content: the text of each page, its articles apart by a rule. Empty and null texts are left out; an article
    of nothing else keeps its place."""
    line = F.when(F.col("text") != "", F.concat("text", F.lit("\n")))
    parts = lines.groupBy("page_id", "article_id").agg(F.min("idx").alias("_place"), F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("_lines"))
    text = F.array_join(F.transform("_lines", lambda x: F.coalesce(x["line"], F.lit(""))), "")
    whole = parts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("_place", text.alias("text")))).alias("_parts"))
    return whole.select("page_id", F.array_join(F.transform("_parts", lambda x: x["text"]), f"\n{RULE}\n\n").alias("content"))


def text_articles(lines: DataFrame) -> DataFrame:
    """page_id, article_no, polygons (lines in order): an empty line ends an article, also one without lines."""
    by = Window.partitionBy("page_id").orderBy("idx")
    rows = lines.withColumn("article_no", F.sum(F.when(F.col("line") == "", 1).otherwise(0)).over(by))
    rows = rows.withColumn("article_no", F.col("article_no") - F.when(F.col("line") == "", 1).otherwise(0))
    kept = F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("idx", "line"))))
    got = rows.groupBy("page_id", "article_no").agg(kept.alias("_l"))
    got = got.select("page_id", "article_no", F.transform("_l", lambda x: x["line"]).alias("polygons"))
    last = rows.groupBy("page_id").agg(F.sum(F.when(F.col("line") == "", 1).otherwise(0)).alias("n"))
    every = last.select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("article_no"))
    return every.join(got, ["page_id", "article_no"], "left").withColumn("polygons", F.coalesce("polygons", F.array().cast("array<string>")))


def union_boxes(rects: DataFrame) -> DataFrame:
    """The bounding box of each page's articles; rects have page_id, article_id, box."""
    b = F.col("box")
    got = rects.groupBy("page_id", "article_id").agg(F.min(b["x"]).alias("x"), F.min(b["y"]).alias("y"), F.max(b["x"] + b["w"]).alias("x2"), F.max(b["y"] + b["h"]).alias("y2"))
    return got.select("page_id", "article_id", C.rect(F.col("x"), F.col("y"), F.col("x2") - F.col("x"), F.col("y2") - F.col("y")).alias("box"))


def article_sets(rows: DataFrame, key: list[str], none: str = "\x00none") -> DataFrame:
    """key, a_ids: the sorted set of article ids of each group; null is a member, shown as null."""
    got = rows.groupBy(*key).agg(F.sort_array(F.collect_set(F.coalesce("article_id", F.lit(none)))).alias("a_ids"))
    return got.withColumn("a_ids", F.transform("a_ids", lambda a: F.when(a != none, a)))


def rects_by_article(rects: DataFrame) -> DataFrame:
    """One row for each article id of a rectangle; an empty set counts as blank."""
    ids = F.when(F.size("a_ids") == 0, F.array(F.lit("blank"))).otherwise(F.col("a_ids"))
    return rects.withColumn("article_id", F.explode(ids)).drop("a_ids")


def zipped_lists(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two lists (pos, path) side by side, as long as the shorter."""
    return left.select("pos", F.col("path").alias("xml_path")).join(right.select("pos", F.col("path").alias("img_path")), "pos")


def page_path(img_path: Column) -> Column:
    """folder/page/stem.xml of an image path."""
    folder, name = F.regexp_extract(img_path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(img_path, r"([^/]*)$", 1)
    return F.concat(folder, F.lit("page/"), stem(name), F.lit(".xml"))


def stem(name: Column) -> Column:
    """A file name without its last extension; a leading dot is no extension."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")


def text_path(page: Column, folder: str | None = None) -> Column:
    """Where a page's text goes: beside it, or into folder under its own name."""
    if folder:
        return F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract(page, r"([^/]*)$", 1), F.lit(".txt"))
    return F.concat(page, F.lit(".txt"))


#: Channels of each mode of article ground truth, in the order of their numbers.
CHANNELS = {
    "ab_bl": ("boundary", "baselines", "other"),
    "ab": ("boundary", "other"),
    "a": ("article", "other"),
    "ab_a": ("boundary", "article", "other"),
}


def output_names(pages: DataFrame, mode: str, folder: str) -> DataFrame:
    """pages (page_id, xml_path) with a row for each file of a mode: kind, path. The mode may be in any case."""
    channels = CHANNELS[mode.lower()]
    name = stem(F.col("xml_path"))
    gt = [F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(f"{folder}/C3/"), name, F.lit(f"_GT{i}.png")).alias("path")) for i, kind in enumerate(channels)]
    grey = F.concat(F.lit(f"{folder}/"), name, F.lit(".png"))
    rest = [F.struct(F.lit("grey").alias("kind"), grey.alias("path")), F.struct(F.lit("rotation").alias("kind"), F.concat(grey, F.lit(".rot")).alias("path"))]
    return pages.withColumn("_f", F.explode(F.array(*gt, *rest))).select(*pages.columns, "_f.kind", "_f.path")


def channel_names(images: DataFrame, n_channels: int, folder: str) -> DataFrame:
    """images (img_path) with the files of their channels: C<n>/<stem>_GT<i>.png, <stem>.jpg and <stem>.jpg.rot."""
    name = stem(F.col("img_path"))
    gt = [F.concat(F.lit(f"{folder}/C{n_channels}/"), name, F.lit(f"_GT{i}.png")) for i in range(n_channels)]
    rest = [F.concat(F.lit(f"{folder}/"), name, F.lit(ext)) for ext in (".jpg", ".jpg.rot")]
    return images.withColumn("path", F.explode(F.array(*gt, *rest)))


def unfinished(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages of which a wanted file (page_id, path) is not in the manifest (path)."""
    return wanted.join(manifest.select("path").distinct(), "path", "left_anti").select("page_id").distinct()


def progress(pages: DataFrame) -> DataFrame:
    """pages with n, their 1-based place by page_id. Ranks are counted by range partition, then offset."""
    parts = pages.sparkSession.conf.get("spark.sql.shuffle.partitions")
    rows = pages.repartitionByRange(int(parts), "page_id").withColumn("_part", F.spark_partition_id())
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy("page_id")))
    return ranked.join(before, "_part").withColumn("n", F.col("_r") + F.col("_before")).select(*pages.columns, "n")
