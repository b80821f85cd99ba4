"""Main text of web pages by differencing each page with its nearest page by URL.

Pages stand in order of host, path and URL; of the two neighbours on the same host the one whose
path shares the longer beginning is the nearest (in sorted order no other page shares more). The
blocks of both pages are aligned by a longest common subsequence, and blocks they share are
template text, so they are deleted.

Differencing alone leaves menus and adverts that differ on every page, and deletes what two
articles of a host both carry. So each block also has a role from its elements: blocks in navigation, headers,
footers, asides, forms, adverts, notices and comments go. Where a page has an article or main element that is
left, its text is the blocks inside, less the groups (div, list, table and the like) that differencing finds to be template:
all their blocks are shared with both of two pages that are no copies. A single shared line beside others that are not shared
is a line that two articles carry, and stays. Other pages are differenced block by block. There, a neighbour that leaves under COPY of a page's text is a copy and no template, so the other
neighbour is compared, then the last page before both that was no copy of the one after it. Where all are copies,
what the least like of them leaves stays, or all. extract(roles=False) gives plain differencing.

Pages are dealt by range of their order, with the last page before and the first page after each
range sent along, so a host of any size is many tasks and a task holds four pages at a time. Pages before that one are
not seen from the next range, and pages after the next are seen from none.

Defined results: null or empty html: empty text; null or odd url: host and path empty; equal urls: by
page_id; repeated rows: neighbours of each other, and copies; no page on the same host: nothing
is shared; cut-off pages: as far as they go; an empty table: no rows.
"""

from __future__ import annotations

import html as html_
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_of, shuffle_parts, table

NAME = "op8_pages"
SQL = None

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)[^<>]*(?:>|\Z|(?=<))", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style title textarea noscript template svg iframe head select button object math canvas".split())
RAW = frozenset("script style title textarea".split())
#: Elements that stand apart from the article.
APART = frozenset("nav footer aside form menu dialog".split())
INSIDE = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements within a block; all others begin and end blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
#: Elements that group blocks; in an article differencing deletes a group as a whole, or not.
GROUPS = frozenset("div section ul ol dl table figure details fieldset address center".split())
#: Words of class, id or role that mark what is no article.
APART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies respond related "
    "share sharing social newsletter subscribe subscription popup modal overlay login signup search toolbar widget pagination contentinfo complementary".split()
)
#: Those that an article may use for its own parts.
OWN_NAMES = frozenset(("header", "masthead", "search", "widget"))
#: Share of a page's characters that a neighbour leaves at least, unless it is a copy.
COPY = 0.05
NAME_PARTS = re.compile(r"[a-z0-9]+")


@dataclass
class Block:
    text: str
    inside: bool  # in an article or main element
    apart: bool  # in something that is no article
    groups: tuple[int, ...] = ()  # numbers of the groups inside the article that it is in


def _apart(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in APART or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body") or tag in INSIDE:
        return False
    for found in ATTRIBUTE.finditer(attributes):
        value = (found[2] or found[3] or found[4] or "").lower()
        if APART_NAMES.intersection(NAME_PARTS.findall(value)) - (OWN_NAMES if in_article else frozenset()):
            return True
    return False


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, with white space made one space and empty ones left out."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool, bool, tuple]] = []  # tag, hidden, inside, apart, groups, each of it or what it is in
    number = 0
    held: list[str] = []
    at, page = 0, page or ""

    def state() -> tuple[str, bool, bool, bool, tuple]:
        return open_[-1] if open_ else ("", False, False, False, ())

    def close() -> None:
        text = " ".join(html_.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(Block(text, *state()[2:]))

    def pop(tag: str) -> None:
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] == tag:
                del open_[k:]
                break

    while at < len(page):
        found = TOKEN.search(page, at)
        if not state()[1]:
            held.append(page[at : found.start() if found else len(page)])
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found[1] or found[4], (found[2] or found[5] or "").lower(), found[3] or ""
        if not tag:
            continue
        if tag in INLINE and tag not in HIDDEN:
            if tag == "br":
                held.append(" ")
            continue
        close()
        if closing:
            pop(tag)
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and any(t[0] == tag for t in open_[-3:]):
            pop(tag)
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        _, hidden, inside, apart, groups = state()
        number += 1
        groups = groups + (number,) if inside and tag in GROUPS else groups
        open_.append((tag, hidden or tag in HIDDEN, inside or tag in INSIDE, apart or _apart(tag, attributes, inside), groups))
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            open_.pop()
    close()
    return out


def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence."""
    both = set(a) & set(b)
    pa_, pb = [i for i, x in enumerate(a) if x in both], [j for j, x in enumerate(b) if x in both]
    number = {x: k for k, x in enumerate(both)}
    x, y = np.array([number[a[i]] for i in pa_], np.int64), np.array([number[b[j]] for j in pb], np.int64)
    out: list[tuple[int, int]] = []

    def lengths(p: np.ndarray, q: np.ndarray, keep: bool) -> np.ndarray:
        row = np.zeros(len(q) + 1, np.int32)
        rows = [row]
        for v in p:
            nxt = row.copy()
            nxt[1:] = np.maximum(row[1:], row[:-1] + (q == v))
            row = np.maximum.accumulate(nxt)
            if keep:
                rows.append(row)
        return np.stack(rows) if keep else row

    stack = [(0, len(x), 0, len(y))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and x[a0] == y[b0]:
            out.append((pa_[a0], pb[b0]))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and x[a1 - 1] == y[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((pa_[a1], pb[b1]))
        n, m = a1 - a0, b1 - b0
        if not n or not m:
            continue
        if n * m <= 4_000_000 or n == 1:
            rows, i, j = lengths(x[a0:a1], y[b0:b1], True), n, m
            while i and j:
                if rows[i, j] == rows[i - 1, j]:
                    i -= 1
                elif rows[i, j] == rows[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((pa_[a0 + i], pb[b0 + j]))
            continue
        mid = (a0 + a1) // 2  # halves, each with the part of b that fits best
        best = int(np.argmax(lengths(x[a0:mid], y[b0:b1], False) + lengths(x[mid:a1][::-1], y[b0:b1][::-1], False)[::-1]))
        stack += [(a0, mid, b0, b0 + best), (mid, a1, b0 + best, b1)]
    return sorted(out)


def copied(page: list[Block], other: list[Block]) -> bool:
    """Whether other has nearly all of page's text."""
    there = {b.text for b in other}
    return sum(len(b.text) for b in page if b.text not in there) < COPY * sum(len(b.text) for b in page)


def template_groups(page: list[Block], near: list[list[Block]]) -> set[int]:
    """Groups inside the article whose blocks are all shared, by longest common subsequence, with both of the two nearest
    pages that are no copies; none where there are not two."""
    texts, shared = [b.text for b in page], []
    inner = {b.text for b in page if b.groups}
    if not inner:
        return set()
    for other in near:
        if not copied(page, other):
            there = [b.text for b in other]
            if inner.isdisjoint(there):
                return set()
            shared.append({i for i, _ in common_lines(texts, there)})
            if len(shared) == 2:
                break
    else:
        return set()
    own = [g for i, b in enumerate(page) for g in b.groups if i not in shared[0] or i not in shared[1]]
    return {g for b in page for g in b.groups}.difference(own)


def main_text(page: list[Block], near: list[list[Block]], roles: bool = True) -> str:
    """What the roles of blocks, or differencing from the pages near (nearest first), leave of a page."""

    def rest(places: list[int], other: list[Block]) -> list[int]:
        shared = dict(common_lines([b.text for b in page], [b.text for b in other]))
        return [i for i in places if i not in shared]

    def chars(places: list[int]) -> int:
        return sum(len(page[i].text) for i in places)

    if not roles:
        kept = list(range(len(page)))
        return "\n".join(page[i].text for i in (rest(kept, near[0]) if near else kept))
    framed = any(b.inside and not b.apart for b in page)
    kept = [i for i, b in enumerate(page) if not b.apart and b.inside == framed]
    if not framed and kept:
        most: list[int] = []
        for other in near:
            left = rest(kept, other)
            most = max(most, left, key=chars)
            if chars(left) >= COPY * chars(kept):
                most = left
                break
        kept = most or kept
    if framed:
        template = template_groups(page, near)
        kept = [i for i in kept if template.isdisjoint(page[i].groups)] or kept
    return "\n".join(page[i].text for i in kept)


def _shared_beginning(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def _ordered(pages: DataFrame) -> DataFrame:
    """pages with key: host, path and URL as one string in the order of all pages."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path, "key": F.concat_ws("\x00", host, path, url, F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 20, "0"))})


def in_turn(pages: DataFrame, parts: int) -> DataFrame:
    """Rows dealt by range of key; ghost -1 and 1 mark the page before and after each part."""
    rows = _ordered(pages.select(F.col("page_id").cast("long"), "url", "html"))
    keys = rows.select("key")
    some = sorted(r["key"] for r in keys.orderBy(F.xxhash64("key"), "key").limit(20 * parts).collect())  # places to cut only: any will do
    bounds = [some[len(some) * i // parts] for i in range(1, parts)] if some else []

    def part_of(values: list[str]) -> np.ndarray:
        import bisect

        return np.array([bisect.bisect_right(bounds, v) for v in values], np.int32)

    def numbered(batches):
        for batch in batches:
            part = part_of(batch.column(0).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(part)], ["key", "part"])

    ends = keys.mapInArrow(numbered, "key string, part int").groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).collect()  # a row for each part
    ends = sorted(ends, key=lambda r: r["part"])
    first, last = {}, {}
    for before, after in zip(ends, ends[1:]):
        last.setdefault(before["hi"], []).append(after["part"])
        first.setdefault(after["lo"], []).append(before["part"])

    def dealt(batches):
        for batch in batches:
            values = batch.column(batch.schema.get_field_index("key")).to_pylist()
            where, to, ghost = list(range(len(values))), part_of(values).tolist(), [0] * len(values)
            for i, v in enumerate(values):
                for ends_, mark in ((last, -1), (first, 1)):
                    for p in ends_.get(v, ()):
                        where.append(i)
                        to.append(p)
                        ghost.append(mark)
            got = pa.Table.from_batches([batch]).take(pa.array(where))
            yield from got.append_column("part", pa.array(to, pa.int32())).append_column("ghost", pa.array(ghost, pa.int32())).to_batches()

    schema = "page_id long, url string, html string, host string, path string, key string, part int, ghost int"
    return rows.mapInArrow(dealt, schema).repartitionById(parts, F.col("part")).sortWithinPartitions("ghost", "key")


def extract(pages: DataFrame, parts: int | None = None, roles: bool = True) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    parts = parts or shuffle_parts(pages.sparkSession)

    def texts(batches):
        def stream():
            for batch in batches:
                columns = [column_of(batch, c) for c in ("page_id", "url", "html", "host", "path", "ghost")]
                for row in zip(*columns):
                    yield (*row[:2], blocks(row[2]), *row[3:])

        rows: list[tuple] = []
        before = now = further = None

        def settled(after):
            near = [p for p in (after, before) if p and p[3] == now[3]]
            near.sort(key=lambda p: -_shared_beginning(p[4], now[4]))
            if further and further[3] == now[3]:
                near.append(further)
            rows.append((now[0], now[1], main_text(now[2], [p[2] for p in near], roles)))

        def out():
            cols = list(zip(*rows)) or [(), (), ()]
            chars = pa.array([len(t) for t in cols[2]], pa.int64())
            batch = pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), chars], ["page_id", "url", "text", "n_chars"])
            rows.clear()
            return batch

        for page in stream():
            if page[5] == -1:
                now = page
                continue
            if now and now[5] != -1:
                settled(page)
                if len(rows) >= 256:
                    yield out()
            if before and not copied(now[2], before[2]):
                further = before
            before, now = now, page
            if page[5] == 1:
                break
        if now and now[5] == 0:
            settled(None)
        yield out()
        for _ in batches:  # equal pages after the first ghost
            pass

    return in_turn(pages, parts).mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every page."""
    return extract(table(spark, sf_dir, "pages"))
