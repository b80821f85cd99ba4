"""Results to files: tagged PAGE-XML, text regions, article texts, images.

Every writer is a Spark write, or a foreachPartition that goes through the path's own file system, so targets may lie
in any store.
"""

from __future__ import annotations

import re
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .png import write_grey

FILES = "path string, content binary"


def _retag(custom: str, article: str | None) -> str:
    """custom with its structure entry replaced, or taken away where there is no article."""
    rest = re.sub(r"\s*structure\s*\{[^}]*\}", "", custom).strip()
    own = f"structure {{id:{article}; type:article;}}" if article is not None else ""
    return " ".join(x for x in (rest, own) if x)


def tagged_xml(xml: str, tags: dict[str, str | None]) -> str:
    """A document whose text lines carry the tags of their ids; lines without an entry stay as they are."""

    def line(m: re.Match) -> str:
        head = m.group(0)
        found = re.search(r'\bid="([^"]*)"', head)
        if not found or found[1] not in tags:
            return head
        custom = re.search(r'\s*\bcustom="([^"]*)"', head)
        new = _retag(custom[1] if custom else "", tags[found[1]])
        head = head.replace(custom[0], "", 1) if custom else head
        end = "/>" if head.endswith("/>") else ">"
        return head[: -len(end)].rstrip() + (f" custom={quoteattr(new)}" if new else "") + end

    return re.sub(r"<(?:\w+:)?TextLine\b[^>]*>", line, xml)


def with_article_tags(files: DataFrame, tags: DataFrame) -> DataFrame:
    """path, content: documents (page_id, xml) with the tags of their lines (page_id, line_id, article_id)."""
    own = tags.groupBy("page_id").agg(F.collect_list(F.struct("line_id", "article_id")).alias("tags"))

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            made = [tagged_xml(r["xml"], {t["line_id"]: t["article_id"] for t in r["tags"] or []}).encode() for r in rows]
            yield pa.record_batch([pa.array([r["page_id"] for r in rows], pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return files.join(own, "page_id", "left").select("page_id", "xml", "tags").mapInArrow(run, FILES)


def region_xml(region: dict) -> str:
    """A text region of type paragraph with its reading order, outline and lines."""
    pts = lambda ps: " ".join(f"{p['x']},{p['y']}" for p in ps or [])
    lines = []
    for n in region["lines"]:
        custom = f"readingOrder {{index:{n['reading_order']};}}" + (f" structure {{id:{region['article_id']}; type:article;}}" if region["article_id"] is not None else "")
        parts = [f'<Coords points="{pts(n["surr_p"])}"/>'] if n["surr_p"] else []
        parts += [f'<Baseline points="{pts(n["baseline"])}"/>'] if n["baseline"] else []
        text = (n["text"] or "").replace("&", "&amp;").replace("<", "&lt;")
        parts += [f"<TextEquiv><Unicode>{text}</Unicode></TextEquiv>"] if n["text"] else []
        lines.append(f"<TextLine id={quoteattr(n['line_id'] or '')} custom={quoteattr(custom)}>{''.join(parts)}</TextLine>")
    head = f'<TextRegion type="paragraph" id={quoteattr(region["region"])} custom="readingOrder {{index:{region["reading_order"]};}}">'
    return f'{head}<Coords points="{pts(region["points"])}"/>{"".join(lines)}</TextRegion>'


def with_text_regions(files: DataFrame, regions: DataFrame) -> DataFrame:
    """path, content: documents whose text regions are replaced by the given ones.

    regions: page_id, region, reading_order, article_id, points, lines (array of line_id, reading_order, text, baseline,
    surr_p in reading order). Lines in no region are gone, as in the regions.
    """
    own = regions.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("reading_order", "region", "article_id", "points", "lines"))).alias("regions"))

    def run(batches):
        for b in batches:
            names, made = [], []
            for r in b.to_pylist():
                bare = re.sub(r"(?s)<((?:\w+:)?TextRegion)\b[^>]*?(?:/>|>.*?</\1>)\s*", "", r["xml"])
                new = "".join(map(region_xml, r["regions"] or []))
                made.append(re.sub(r"</(?:\w+:)?Page>", lambda m: new + m.group(0), bare, count=1).encode())
                names.append(r["page_id"])
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return files.join(own, "page_id", "left").select("page_id", "xml", "regions").mapInArrow(run, FILES)


def image_files(images: DataFrame, path: str = "path") -> DataFrame:
    """path, content: grey images (h, w, data) as PNG."""

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            made = [write_grey(np.frombuffer(r["data"], np.uint8).reshape(r["h"], r["w"])) for r in rows]
            yield pa.record_batch([pa.array([r["path"] for r in rows], pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return images.select(F.col(path).alias("path"), "h", "w", "data").mapInArrow(run, FILES)


def text_files(texts: DataFrame) -> DataFrame:
    """path, content: texts (path, content as string) as files."""
    return texts.select("path", F.encode("content", "UTF-8").alias("content"))


def rotation_files(images: DataFrame) -> DataFrame:
    """path, content: the sidecar of each image (path), whose angle is always 0."""
    return images.select(F.concat("path", F.lit(".rot")).alias("path"), F.encode(F.lit("0"), "UTF-8").alias("content"))


def save(files: DataFrame, root: str) -> int:
    """Writes files (path, content) under root, each by a task of its own run, through Arrow's file systems; returns their number.

    A file is first written beside its place and then moved there, so a task that runs twice leaves no half file.
    """

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                place = f"{base.rstrip('/')}/{name.lstrip('/')}"
                store.create_dir(place.rpartition("/")[0])
                with store.open_output_stream(place + ".part") as out:
                    out.write(content)
                store.move(place + ".part", place)
            yield pa.record_batch([pa.array([b.num_rows])], ["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
