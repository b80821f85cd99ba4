"""PAGE-XML, lists, polygon files, images; and what is written of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.sources import page_xml as X
from broadsheet.sources import png, sinks
from broadsheet.streaming import ingest

PAGE = """<?xml version="1.0"?>
<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"><Page imageFilename="p.jpg" imageWidth="800" imageHeight="600">
<PrintSpace><Coords points="0,0 800,0 800,600 0,600"/></PrintSpace>
<TextRegion id="r1" custom="readingOrder {index:0;}"><Coords points="0,0 300,0 300,200 0,200"/>
<TextLine id="l1" custom="readingOrder {index:0;} structure {id:a1; type:article;}"><Coords points="1,2 30,2 30,9 1,9"/><Baseline points="1,9 30,9"/><TextEquiv><Unicode>One &amp; two</Unicode></TextEquiv></TextLine>
<TextLine id="l2"><Baseline points="1,20 30,20"/></TextLine></TextRegion>
<TextRegion id="r2"><Coords points="0,0 1,1"/><TextLine id="l3" custom="structure {id:a2;}"><Coords points="3,3 4,4"/></TextLine></TextRegion>
<GraphicRegion id="g1"><Coords points="5,5 9,5 9,9"/></GraphicRegion></Page></PcGts>"""


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pages")
    (folder / "a.xml").write_text(PAGE)
    (folder / "bad.xml").write_text("<html>no page</html>")
    return X.read_pages(spark, str(folder))


def test_page_is_read(parsed):
    assert {r["page_id"].rpartition("/")[2]: r["error"] is None for r in parsed.collect()} == {"a.xml": True, "bad.xml": False}
    page = X.pages(parsed).first()
    assert (page["img_width"], page["img_height"], len(page["print_space"])) == (800, 600, 4)
    lines = X.text_lines(parsed).orderBy("idx").collect()
    assert [(r["idx"], r["line_id"], r["article_id"], r["reading_order"], r["text"]) for r in lines] == [(0, "l1", "a1", 0, "One & two"), (1, "l2", None, None, None), (2, "l3", "a2", None, None)]
    assert lines[2]["baseline"] is None and [tuple(p) for p in lines[0]["baseline"]] == [(1, 9), (30, 9)] and lines[1]["surr_p"] is None
    assert {(r["region_id"], r["region_type"]) for r in X.regions(parsed).collect()} == {("r1", "TextRegion"), ("r2", "TextRegion"), ("g1", "GraphicRegion")}


def test_article_polygons(parsed):
    got = {r["page_id"].rpartition("/")[2]: r for r in X.article_polygons(X.text_lines(parsed), parsed).collect()}
    good = got["a.xml"]
    assert [len(a) for a in good["with_none"]] == [1, 1, 0] and [len(a) for a in good["without_none"]] == [1, 0] and not good["error"]
    assert got["bad.xml"]["error"]


def test_lists_and_polygon_text(spark, tmp_path):
    (tmp_path / "x.lst").write_text("a/b.jpg \nc.jpg\n")
    assert [(r["pos"], r["path"]) for r in X.read_list(spark, str(tmp_path / "x.lst")).orderBy("pos").collect()] == [(0, "a/b.jpg"), (1, "c.jpg")]
    (tmp_path / "p.txt").write_text("1,2;3,4\n5,6;7,8\n\n\n9,9;8,8\n")
    got = X.read_polygons(spark, str(tmp_path / "p.txt")).orderBy("article_no").collect()
    assert [len(r["polygons"]) for r in got] == [2, 0, 1]
    assert len([r for r in X.list_folder(spark, str(tmp_path)).collect()]) == 2
    with pytest.raises(ValueError):
        X.read_polygons(spark, "p.json")


def test_png_round_trip(spark, tmp_path):
    img = np.random.default_rng(0).integers(0, 256, (7, 5)).astype(np.uint8)
    assert (png.read_grey(png.write_grey(img)) == img).all()
    files = sinks.image_files(spark.createDataFrame([("C1/a.png", 7, 5, bytearray(img.tobytes()))], "path string, h int, w int, data binary"))
    assert sinks.save(files, tmp_path.as_uri()) == 1
    (tmp_path / "C1" / "b.png").write_bytes(b"nothing")
    got = {r["path"][-5:]: r for r in X.read_grey_images(spark, str(tmp_path / "C1")).collect()}
    assert got["a.png"]["data"] == img.tobytes() and got["b.png"]["error"]


def test_tags_and_regions_are_written(spark, tmp_path):
    files = spark.createDataFrame([("a.xml", PAGE)], "page_id string, xml string")
    tags = spark.createDataFrame([("a.xml", "l1", None), ("a.xml", "l2", "a7")], "page_id string, line_id string, article_id string")
    out = sinks.with_article_tags(files, tags).select(F.col("path").alias("page_id"), F.col("content").cast("string").alias("xml"))
    assert {r["line_id"]: r["article_id"] for r in X.text_lines(X.parse_pages(out)).collect()} == {"l1": None, "l2": "a7", "l3": "a2"}
    own = "page_id string, region string, reading_order int, article_id string, points array<struct<x: int, y: int>>, lines array<struct<line_id: string, reading_order: int, text: string, baseline: array<struct<x: int, y: int>>, surr_p: array<struct<x: int, y: int>>>>"
    regions = spark.createDataFrame([("a.xml", "tr_0", 0, "a1", [(0, 0), (9, 9)], [("l2", 0, "x < y", [(1, 2), (3, 4)], None)])], own)
    out = sinks.with_text_regions(files, regions).select(F.col("path").alias("page_id"), F.col("content").cast("string").alias("xml"))
    (row,) = X.text_lines(X.parse_pages(out)).collect()
    assert (row["line_id"], row["article_id"], row["text"], row["reading_order"]) == ("l2", "a1", "x < y", 0)
    texts = sinks.text_files(spark.createDataFrame([("t/a.txt", "é\n")], "path string, content string"))
    assert sinks.save(texts, tmp_path.as_uri()) == 1 and (tmp_path / "t/a.txt").read_text() == "é\n"
    assert bytes(sinks.rotation_files(texts).first()["content"]) == b"0"


def test_stream_of_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(PAGE)
    lines = ingest.line_stream(spark, str(tmp_path / "in"))
    assert lines.isStreaming
    lines = lines.withColumn("page_id", F.xxhash64("page_id"))
    ingest.article_clusters(lines, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2  # the line without a baseline is in no cluster


def test_commands(spark, tmp_path):
    from broadsheet import cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(PAGE)
    for command in ("cluster", "regions", "text", "article-gt", "block-gt"):
        assert cli.main([command, str(tmp_path / "in"), (tmp_path / command).as_uri()], spark) == 0
    tagged = X.text_lines(X.read_pages(spark, str(tmp_path / "cluster"))).collect()
    assert {r["line_id"]: r["article_id"] for r in tagged} == {"l1": "a0", "l2": "a1", "l3": "a2"}
    ruled = X.text_lines(X.read_pages(spark, str(tmp_path / "regions"))).orderBy("idx").collect()
    assert [(r["line_id"], r["article_id"]) for r in ruled] == [("l1", "a1"), ("l2", None)]
    assert (tmp_path / "text" / "a.xml.txt").read_text().startswith("One & two\n\n" + "#" * 100)
    made = {p.relative_to(tmp_path).as_posix(): png.read_grey(p.read_bytes()) for k in ("article-gt", "block-gt") for p in (tmp_path / k).rglob("*.png")}
    assert set(made) == {f"article-gt/C3/a_GT{k}.png" for k in range(3)} | {f"block-gt/C2/a_GT{k}.png" for k in range(2)}
    assert made["block-gt/C2/a_GT0.png"].shape == (600, 800) and made["article-gt/C3/a_GT1.png"].any()
    (tmp_path / "in" / "b.xml").write_text("nothing")
    assert cli.main(["text", str(tmp_path / "in"), (tmp_path / "again").as_uri()], spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["article-gt", "x", "y", "--convex", "perhaps"], spark)


def test_commands_keep_folders_and_sizes(spark, tmp_path):
    from broadsheet import cli

    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "a.xml").write_text(PAGE)
    (tmp_path / "in" / "x" / "a.xml").write_text(PAGE.replace('imageWidth="800"', 'imageWidth="700"').replace('imageHeight="600"', 'imageHeight="900"'))
    for command, more in (("text", []), ("article-gt", ["--fixed_height", "300"])):
        assert cli.main([command, str(tmp_path / "in"), (tmp_path / command).as_uri(), *more], spark) == 0
    assert {p.relative_to(tmp_path / "text").as_posix() for p in (tmp_path / "text").rglob("*.txt")} == {"a.xml.txt", "x/a.xml.txt"}
    made = {p.relative_to(tmp_path / "article-gt").as_posix(): png.read_grey(p.read_bytes()).shape for p in (tmp_path / "article-gt").rglob("*.png")}
    assert made == {f"C3/a_GT{k}.png": (300, 400) for k in range(3)} | {f"x/C3/a_GT{k}.png": (300, 233) for k in range(3)}


def test_stretched_rectangles(spark):
    from broadsheet.operators import articles as A

    lines = spark.createDataFrame([(1, 0, [(10, 50), (60, 50)], "a")], "page_id long, idx long, baseline array<struct<x: int, y: int>>, article_id string")
    ink = np.zeros((100, 100), np.uint8)
    ink[36:40] = 1
    table = spark.createDataFrame([(1, 100, 100, bytearray(ink.tobytes()))], "page_id long, h int, w int, data binary")
    got = A.stretched_rectangles(lines, table)
    (r,) = got.collect()
    assert tuple(r["r"]) == (10, 35, 50, 15) and r["line_ids"] == [0]
    assert len(A.rectangle_outlines(got).first()["points"]) == 4
