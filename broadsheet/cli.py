"""Commands on folders of PAGE-XML files.

    python -m broadsheet.cli cluster PAGES OUT          article tags of baselines
    python -m broadsheet.cli regions PAGES OUT          text regions of tagged lines, in reading order
    python -m broadsheet.cli article-gt PAGES OUT       ground-truth images of articles
    python -m broadsheet.cli block-gt PAGES OUT         ground-truth images of text blocks
    python -m broadsheet.cli text PAGES OUT             the text of each page, article by article

Results are new files under OUT; inputs are never changed. Pages that cannot be read are listed, and the exit code is 1.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import articles, clustering, groundtruth, joins, records
from .sources import page_xml, sinks


def truth(text: str) -> bool:
    """yes/no, true/false, t/f, y/n, 1/0 in any case."""
    if text.lower() in ("yes", "true", "t", "y", "1"):
        return True
    if text.lower() in ("no", "false", "f", "n", "0"):
        return False
    raise argparse.ArgumentTypeError(f"neither yes nor no: {text}")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """files (page_id as path, xml), parsed pages, and lines with a number for their page (key: path)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.col("path").alias("page_id"), F.col("content").cast("string").alias("xml"))
    parsed = page_xml.parse_pages(files)
    lines = page_xml.text_lines(parsed).withColumn("key", F.col("page_id")).withColumn("page_id", F.xxhash64("key"))
    return files, parsed, lines


def _below(spark: SparkSession, root: str, path: Column) -> Column:
    """path below the folder root, so that files of one name in several folders stay apart."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/") + "/"
    return F.when(path.startswith(top), F.substring(path, len(top) + 1, 1 << 20)).otherwise(F.regexp_extract(path, r"([^/]*)$", 1))


def _named(files: DataFrame, root: str) -> DataFrame:
    """Files under their names below root."""
    return files.withColumn("path", _below(files.sparkSession, root, F.col("path")))


def cluster(spark: SparkSession, pages: str, out: str, **settings) -> int:
    """Article tags: min_lines, min_article, factor, max_d, target, spacing as in clustering.cluster()."""
    files, _, lines = _read(spark, pages)
    tags = clustering.article_tags(clustering.cluster(lines, **settings))
    own = lines.select("page_id", "idx", "key", "line_id").join(tags, ["page_id", "idx"])
    return sinks.save(_named(sinks.with_article_tags(files, own.select(F.col("key").alias("page_id"), "line_id", "article_id")), pages), out)


def regions(spark: SparkSession, pages: str, out: str, spacing: float = 50, max_d: int = 100, alpha: float = 75) -> int:
    """Text regions of articles. Distances are always taken at a spacing of 5; spacing is that of the outline."""
    files, _, lines = _read(spark, pages)
    dist = clustering.slanted_distances(lines, 5, max_d)
    usable = lines.join(dist, ["page_id", "idx"], "left")
    found = articles.regions(usable, spacing, alpha)
    line = joins.with_rings(joins.with_distance(lines, dist), dist).withColumn("surr_p", F.col("ring"))
    member = found.select("page_id", "region", F.explode("line_ids").alias("idx"))
    line = records.reading_order(line.drop("reading_order").join(member, ["page_id", "idx"]), "region")
    packed = line.groupBy("page_id", "key", "region").agg(F.array_sort(F.collect_list(F.struct("reading_order", "line_id", "text", "baseline", "surr_p"))).alias("lines"))
    full = packed.join(found.drop("line_ids"), ["page_id", "region"])
    full = full.withColumn("lines", F.transform("lines", lambda n: F.struct(n["line_id"].alias("line_id"), n["reading_order"].alias("reading_order"), n["text"].alias("text"), n["baseline"].alias("baseline"), n["surr_p"].alias("surr_p"))))
    return sinks.save(_named(sinks.with_text_regions(files, full.drop("page_id").withColumnRenamed("key", "page_id")), pages), out)


def text(spark: SparkSession, pages: str, out: str) -> int:
    _, parsed, lines = _read(spark, pages)
    got = records.article_texts(lines.drop("page_id").withColumnRenamed("key", "page_id"))
    every = parsed.where("error IS NULL").select("page_id").join(got, "page_id", "left")
    return sinks.save(_named(sinks.text_files(every.select(records.text_path(F.col("page_id")).alias("path"), F.coalesce("content", F.lit("")).alias("content"))), pages), out)


def _write_images(images: DataFrame, names: DataFrame, out: str) -> int:
    """images (page_id, channel, ...) under the names of their channels (page_id, channel, path)."""
    return sinks.save(sinks.image_files(images.join(names, ["page_id", "channel"])), out)


def _sized(rows: DataFrame, parsed: DataFrame, scaling: float, fixed_height: int) -> DataFrame:
    """rows (page_id as number) with img_height and img_width of their page, and its factor: fixed_height by the page's own height, or scaling."""
    pages = page_xml.pages(parsed).select(F.xxhash64("page_id").alias("page_id"), F.col("img_height").cast("int"), F.col("img_width").cast("int"))
    fixed = F.when((F.col("img_height") > 0) & F.lit(fixed_height > 0), F.lit(float(fixed_height)) / F.col("img_height"))
    return rows.join(pages.withColumn("factor", F.coalesce(fixed, F.lit(float(scaling)))), "page_id", "left")


def article_gt(spark: SparkSession, pages: str, out: str, mode: str = "ab_bl", scaling: float = 0.5, fixed_height: int = 0, use_surrounding: bool = False, convex: bool = False, least_width: int = 10) -> int:
    _, parsed, lines = _read(spark, pages)
    outlines = articles.outlines(lines, use_surrounding, least_width, convex)
    images = groundtruth.article_ground_truth(outlines, _sized(lines, parsed, scaling, fixed_height), mode=mode)
    channels = records.CHANNELS[mode.lower()]
    below = _below(spark, pages, F.col("page_id"))
    named = records.output_names(parsed.where("error IS NULL").select("page_id", below.alias("xml_path")), mode, ".")
    place = F.array_position(F.array(*map(F.lit, channels)), F.col("kind")) - 1
    folder = F.regexp_extract(below, r"^(.*/)?[^/]*$", 1)
    named = named.where(F.col("kind").isin(*channels)).select(F.xxhash64("page_id").alias("page_id"), place.cast("int").alias("channel"), F.concat(folder, "path").alias("path"))
    return _write_images(images, named, out)


def block_gt(spark: SparkSession, pages: str, out: str, scaling: float = 1.0, fixed_height: int = 0, shape: str = "polygon") -> int:
    _, parsed, _ = _read(spark, pages)
    own = page_xml.regions(parsed).withColumns({"key": F.col("page_id"), "box": C.bounds(F.col("points"))}).withColumn("page_id", F.xxhash64("key"))
    valid = _sized(joins.valid_text_regions(own), parsed, max(0.1, scaling), fixed_height)
    images = groundtruth.text_block_ground_truth(valid, shape=shape)
    below = _below(spark, pages, F.col("page_id"))
    folder, name = F.regexp_extract(below, r"^(.*/)?[^/]*$", 1), records.stem(F.col("page_id"))
    named = parsed.select("page_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("channel"), name.alias("_n"), folder.alias("_f"))
    named = named.select(F.xxhash64("page_id").alias("page_id"), "channel", F.concat("_f", F.lit("C2/"), "_n", F.lit("_GT"), F.col("channel").cast("string"), F.lit(".png")).alias("path"))
    return _write_images(images, named, out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    options = {
        cluster: {"min_lines": (int, 2), "min_article": (int, 1), "factor": (float, 1.25), "max_d": (int, 500), "target": (float, 50.0), "spacing": (int, 5)},
        regions: {"spacing": (float, 50.0), "max_d": (int, 100), "alpha": (float, 75.0)},
        article_gt: {"mode": (str, "ab_bl"), "scaling": (float, 0.5), "fixed_height": (int, 0), "use_surrounding": (truth, False), "convex": (truth, False), "least_width": (int, 10)},
        block_gt: {"scaling": (float, 1.0), "fixed_height": (int, 0), "shape": (str, "polygon")},
        text: {},
    }
    for run, own in options.items():
        p = sub.add_parser(run.__name__.replace("_", "-"))
        p.add_argument("pages")
        p.add_argument("out", help="a URI, such as file:///results")
        for name, (kind, default) in own.items():
            p.add_argument(f"--{name}", type=kind, default=default)
        p.set_defaults(run=run)
    args = vars(parser.parse_args(argv))
    run, pages, out = args.pop("run"), args.pop("pages"), args.pop("out")
    args.pop("command")
    spark = spark or SparkSession.builder.appName("broadsheet").getOrCreate()
    print(f"{run(spark, pages, out, **args)} files written")
    bad = [r["page_id"] for r in page_xml.read_pages(spark, pages).where("error IS NOT NULL").select("page_id").toLocalIterator()]
    for name in bad:
        print(f"not readable: {name}")
    return int(bool(bad))


if __name__ == "__main__":
    raise SystemExit(main())
