"""Layout operators against sequential versions, hand-made pages, and properties."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.functions import columns as C
from broadsheet.functions import planar as P
from broadsheet.operators import articles as A
from broadsheet.operators import clustering as O
from broadsheet.operators import components, groundtruth, joins, raster, records
from broadsheet.plans import groundtruth as PG

PTS = "array<struct<x: int, y: int>>"


def line(page, idx, pts, article=None):
    return (page, idx, [tuple(p) for p in pts] if pts is not None else None, article)


def table(spark, rows):
    return spark.createDataFrame(rows, f"page_id long, idx long, baseline {PTS}, article_id string")


def sequential_labels(n, links, least):
    """Textbook clustering: grow each cluster to its end from its first core line."""
    near = {i: [] for i in range(n)}
    for a, b in links:
        near[a].append(b)
    label, number = [0] * n, 0
    for i in range(n):
        if label[i]:
            continue
        if len(near[i]) < least:
            label[i] = -1
            continue
        number += 1
        label[i], todo = number, list(near[i])
        while todo:
            j = todo.pop(0)
            if label[j] == -1:
                label[j] = number
            elif not label[j]:
                label[j] = number
                if len(near[j]) >= least:
                    todo += near[j]
    return label


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 14), st.integers(0, 4), st.randoms())
def test_labels_of_a_page_are_those_of_growing(n, least, rng):
    links = {(a, b) for a in range(n) for b in range(a) if rng.random() < 0.25}
    links |= {(b, a) for a, b in links}
    if not links:
        return
    a, b = zip(*sorted(links))
    got = O._page_labels(pa.table({"page_id": pa.array([1] * len(a)), "idx": pa.array(a), "other": pa.array(b)}), max(1, least)).to_pylist()
    want = sequential_labels(n, sorted(links), max(1, least))
    for r in got:
        assert (r["cluster"] + 1 if r["cluster"] is not None else -1) == want[r["idx"]]


def test_clustering_of_a_small_page(spark):
    rows = [line(1, k, [(0, 10 * k), (100, 10 * k)]) for k in range(4)] + [line(1, 4, [(300, 0), (400, 0)]), line(1, 5, [(300, 10), (400, 10)]), line(1, 6, None), line(1, 7, [(5, 5)])]
    rows += [line(2, 0, [(0, 0), (9, 0)])]
    got = {(r["page_id"], r["idx"]): r["label"] for r in O.cluster(table(spark, rows)).collect()}
    assert [got.get((1, k)) for k in range(4)] == [1] * 4
    assert {got[1, 4], got[1, 5]} == {2, 3}  # a pair by itself is noise, so each is an article of its own
    assert got[2, 0] == 0  # a page of only noise begins at 0
    noisy = {(r["page_id"], r["idx"]): r["label"] for r in O.cluster(table(spark, rows), min_article=3).collect()}
    assert noisy[1, 4] == noisy[2, 0] == -1
    tags = {r["idx"]: r["article_id"] for r in O.article_tags(O.cluster(table(spark, rows), min_article=3)).where("page_id = 1").collect()}
    assert tags[0] == "a1" and tags[4] is None


def test_distances_agree_for_horizontal_lines(spark):
    rng = random.Random(3)
    rows = [line(1, k, [(x := 10 * rng.randint(0, 20), y := rng.randint(0, 300)), (x + 200, y)]) for k in range(25)]
    flat = {r["idx"]: r["dist"] for r in O.interline_distances(table(spark, rows), 60).collect()}
    slant = {r["idx"]: r["dist"] for r in O.slanted_distances(table(spark, rows), 5, 60).collect()}
    own = A.distances([{"points": np.array(r[2])} for r in rows], 5, 60)
    for k in range(25):
        assert flat[k] == pytest.approx(slant[k], abs=1e-6) and flat[k] == pytest.approx(own[k], abs=1e-6)


def test_toy_page_of_three_lines():
    lines = [{"idx": k, "points": np.array(p), "surr": None, "article": a} for k, (a, p) in enumerate((("a1", [(1, 3), (5, 1)]), ("a2", [(1, 4), (5, 2)]), ("a3", [(1, 5), (5, 5)])))]
    boxes = A.line_boxes(lines)
    assert all(min(P.overlap(boxes[i], boxes[j])) < 0 for i in range(3) for j in range(i))
    parts = A.quadtree((0, 0, 100, 100), lines, 50, 0, 8)
    assert sum(p["box"][2] * p["box"][3] for p in parts) == 100 * 100
    assert all(min(P.overlap(a["box"], b["box"])) <= 0 for k, a in enumerate(parts) for b in parts[:k])


def test_subregions_go_down_to_one_article_and_the_height_limit(spark, monkeypatch):
    ringed = PG._ringed
    monkeypatch.setattr(PG, "_ringed", lambda spark, sf_dir: ringed(spark, sf_dir).where("page_id = 0"))
    parts = PG.subregions(spark, "/root/testdata/sf0.001").collect()
    assert len(parts) > 4**5 and sum(p["r"]["w"] * p["r"]["h"] for p in parts) == PG.WIDTH * PG.HEIGHT
    assert max(p["r"]["h"] for p in parts) <= PG.HEIGHT // 50
    assert all(len(p["a_ids"]) <= 1 for p in parts)


def test_parts_that_cannot_part_end():
    box = np.array([(0, 0), (64, 0), (64, 64), (0, 64)])
    lines = [{"idx": k, "points": box, "surr": None, "article": a} for k, a in enumerate("ab")]
    boxes = lambda own, *_: [(0, 0, 40, 64)] * len(own)
    made, A.line_boxes = A.line_boxes, boxes
    try:
        parts = A.quadtree((0, 0, 64, 64), lines, 50, 0)
    finally:
        A.line_boxes = made
    assert {len(p["a_ids"]) for p in parts if p["box"][0] < 40} == {2} and sum(p["box"][2] * p["box"][3] for p in parts) == 64 * 64
    assert len(parts) < 100


def test_rectangles_cover_each_line_once_and_lone_lines_are_strips():
    rng = random.Random(5)
    lines = [{"idx": k, "points": np.array([(x := 600 * (k % 3), y := rng.randint(0, 3000)), (x + 500, y)]), "surr": None, "article": rng.choice([None, "a", "b"])} for k in range(90)]
    got = A.article_rectangles(lines)
    assert sorted(i for r in got for i in r["lines"]) == list(range(90))
    assert all(r["box"][3] == 10 for r in got if len(r["lines"]) == 1)
    hulls = A.merged_outlines(got, convex=True)
    assert {r["article_id"] for r in hulls} == {r["article_id"] for r in got}


def test_a_column_of_lines_is_one_rectangle():
    lines = [{"idx": k, "points": np.array([(10, 50 * k), (300, 50 * k)]), "surr": None, "article": "a"} for k in range(5)]
    (only,) = A.article_rectangles(lines)
    assert only["box"] == (10, 0, 290, 200) and only["lines"] == [0, 1, 2, 3, 4]


def test_merging_needs_a_free_gap():
    a, b = {"article_id": "a", "box": (0, 0, 100, 50)}, {"article_id": "a", "box": (0, 80, 100, 50)}
    assert [sorted(r["outline"]) for r in A.merged_outlines([a, b])] == [[(0, 0), (0, 130), (100, 0), (100, 130)]]
    between = {"article_id": "b", "box": (20, 60, 10, 10)}
    assert len([r for r in A.merged_outlines([a, b, between]) if r["article_id"] == "a"]) == 2
    inner = {"article_id": "a", "box": (10, 10, 10, 10)}
    assert len(A.merged_outlines([a, inner])) == 1


def _naive_distances(lines, spacing, most):
    """Points of each line against points of every other, as the text of slanted_distances says."""
    import math

    out = []
    for i, a in enumerate(lines):
        n, sx, sy = len(a), sum(x for x, _ in a), sum(y for _, y in a)
        spread = n * sum(x * x for x, _ in a) - sx * sx
        t = math.atan((n * sum(x * y for x, y in a) - sx * sy) / spread) if spread else math.pi / 2
        u, v = math.cos(t), math.sin(t)
        best = float(most)
        for j, b in enumerate(lines):
            ends = [(q[0] - p[0]) * u + (q[1] - p[1]) * v for p in (a[0], a[-1]) for q in (b[0], b[-1])]
            if j != i and min(ends) <= 0 <= max(ends):
                for p in a:
                    for q in b:
                        if abs((q[0] - p[0]) * u + (q[1] - p[1]) * v) <= 2 * spacing:
                            best = min(best, abs((q[0] - p[0]) * v - (q[1] - p[1]) * u))
        out.append(best)
    return out


def test_distances_of_any_direction(spark):
    rng = random.Random(3)
    pages = {1: [[(0, 0), (1000, 300)], [(900, 320), (1000, 350)]]}
    for page in range(2, 7):
        pages[page] = []
        for _ in range(25):
            x, y, tilt = rng.randint(0, 900), rng.randint(0, 1500), 0 if page == 2 else rng.randint(-60, 60)
            pages[page].append([(x, y), (x + 150, y + tilt // 2), (x + rng.randint(200, 500), y + tilt)])
    pages[7] = [[(5, 5), (5, 400)], [(30, 10), (30, 380)], [(500, 0), (900, 0)]]
    rows = [(p, k, [{"x": x, "y": y} for x, y in line]) for p, lines in pages.items() for k, line in enumerate(lines)]
    table = spark.createDataFrame(rows, "page_id long, idx long, baseline array<struct<x: int, y: int>>")
    points = {(r["page_id"], r["idx"]): [tuple(p) for p in r["pts"]] for r in table.select("page_id", "idx", O.resampled(F.col("baseline"), 10).alias("pts")).collect()}
    want = {}
    for p, lines in pages.items():
        for k, d in enumerate(_naive_distances([points[p, k] for k in range(len(lines))], 10, 200)):
            want[p, k] = d
    for got in (O.distances(table, 10, 200), O.slanted_distances(table, 10, 200)):
        found = {(r["page_id"], r["idx"]): r["dist"] for r in got.collect()}
        assert found.keys() == want.keys()
        assert all(abs(found[k] - want[k]) < 1e-6 for k in want)
    near = {r["idx"]: r["dist"] for r in O.distances(table, 5, 500).where("page_id = 1").collect()}
    assert 40 < near[0] < 55
    assert O.cluster(table).count() == len(rows)


def test_boxes_part_in_as_few_steps_as_one_by_one():
    rng = random.Random(8)
    for _ in range(3000):
        a, b = ((rng.randint(0, 30), rng.randint(0, 30), rng.randint(0, 40), rng.randint(0, 40)) for _ in range(2))
        c, d = A.apart(a, b)
        assert min(P.overlap(c, d)) < 0 or (c, d) == (a, b)
        if (c, d) != (a, b):
            assert min(P.overlap(a, b)) >= 0 and P.holds(a, c) and P.holds(b, d) or min(c[2:] + d[2:]) < 0


def test_stretching_stops_at_white():
    ink = np.ones((2000, 3000), int)
    ink[90:92] = 0
    x, y, w, h = A.stretched((100, 200, 50, 20), ink)
    assert (x, w) == (100, 50) and y == 90 and h > 20
    assert A.stretched((100, 0, 50, 20), ink) == (100, 0, 50, 20)


# ---- geometry ---------------------------------------------------------------------------------

boxes = st.tuples(st.integers(0, 30), st.integers(0, 30), st.integers(1, 20), st.integers(1, 20))


@settings(max_examples=200, deadline=None)
@given(st.lists(boxes, min_size=1, max_size=6))
def test_outlines_have_the_area_of_the_union(bs):
    cell = np.zeros((60, 60), int)
    for x, y, w, h in bs:
        cell[y : y + h, x : x + w] = 1
    outside = np.zeros_like(cell)
    outside[-1, -1] = 1
    while True:  # what holes there are belong to outer outlines
        grown = P.swept(outside, 3, 1) | P.swept(outside, 1, 3)
        grown = grown & (cell == 0)
        if (grown == outside).all():
            break
        outside = grown
    got = sum(P.area(r) for r in P.ortho_outlines(bs))
    assert got >= cell.sum()
    if cell.sum() + outside.sum() == cell.size:
        assert got == cell.sum()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50)), min_size=3, max_size=30))
def test_hull_holds_all_points(pts):
    h = P.hull(pts)
    if len(h) > 2:
        for x, y in pts:
            assert all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(h, h[1:] + h[:1]))
        box = P.min_area_box(pts)
        assert P.area(box) <= math.prod(P.box_of(pts)[2:]) + 60


def test_alpha_shape_of_a_ring_of_points():
    square = [(x, y) for x in range(0, 101, 10) for y in range(0, 101, 10) if not (20 < x < 80 and 60 < y)]
    assert P.area(P.alpha_shape(square, 1e9)) == P.area(P.hull(square)) == 100 * 100
    assert P.area(P.alpha_shape(square, 15)) < 100 * 100
    assert P.alpha_shape([(0, 0), (1, 1)], 5) == [(0, 0), (1, 1)]


def test_clip_and_segments():
    assert P.area(P.clip(P.corners((0, 0, 10, 10)), P.corners((5, 5, 10, 10)))) == 25
    assert P.clip(P.corners((0, 0, 10, 10)), P.corners((10, 0, 5, 5))) == []
    seg = np.array([[0, 5, 20, 5], [0, 0, 20, 0], [12, 0, 20, 9], [-5, 9, 9, 25]], float)
    assert P.segments_in_box(seg, (0, 0, 10, 10)).tolist() == [True, False, False, False]


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 10), st.integers(1, 10), st.randoms())
def test_sweeps_are_maxima(rows, cols, rng):
    img = np.array([[rng.randint(0, 255) for _ in range(9)] for _ in range(7)])
    got = P.swept(img, rows, cols)
    for y in range(7):
        for x in range(9):
            part = img[max(0, y - rows // 2) : y + rows - rows // 2, max(0, x - cols // 2) : x + cols - cols // 2]
            assert got[y, x] == part.max()


def test_smoothing_keeps_a_box():
    ring = P.smooth([(0, 0), (1000, 0), (1000, 1003), (500, 1000), (0, 1000)], 20)
    assert abs(P.area(ring) - 1e6) < 6e4


# ---- tables -----------------------------------------------------------------------------------


def test_columns(spark):
    row = spark.range(1).select(
        C.line_meets_rect(C.points((F.lit(0), F.lit(5)), (F.lit(20), F.lit(5))), C.rect(*map(F.lit, (0, 0, 10, 10)))).alias("through"),
        C.line_meets_rect(C.points((F.lit(0), F.lit(0)), (F.lit(20), F.lit(0))), C.rect(*map(F.lit, (0, 0, 10, 10)))).alias("edge"),
        C.valid_baseline(F.lit(None).cast(PTS)).alias("none"),
        C.rescaled(C.points((F.lit(-3), F.lit(7)), (F.lit(3), F.lit(9))), F.lit(0.5)).alias("half"),
        C.intersection(C.rect(*map(F.lit, (0, 0, 10, 10))), C.rect(*map(F.lit, (15, 10, 5, 5)))).alias("apart"),
    ).first()
    assert row["through"] and not row["edge"] and row["none"] is False
    assert [tuple(p) for p in row["half"]] == [(-1, 3), (1, 4)]
    assert (row["apart"]["w"], row["apart"]["h"]) == (-5, 0)


def test_regions_overlapped_by_exactly_the_threshold_stay(spark):
    rows = [(1, 1, "TextRegion", (0, 0, 50, 50)), (1, 2, "ImageRegion", (30, 30, 50, 50)), (1, 3, "TextRegion", (29, 29, 21, 22)), (1, 4, "TextRegion", (31, 31, 5, 5)), (2, 5, "TextRegion", (0, 0, 5, 5))]
    t = spark.createDataFrame(rows, "page_id long, region_id long, region_type string, box struct<x: int, y: int, w: int, h: int>")
    assert {r["region_id"] for r in joins.valid_text_regions(t).collect()} == {1, 3, 5}


def test_texts_and_articles(spark):
    rows = [(1, 0, "a", "x"), (1, 1, "b", ""), (1, 2, None, "n"), (1, 3, "a", None), (1, 4, "a", "y")]
    t = spark.createDataFrame(rows, "page_id long, idx long, article_id string, text string")
    rule = "\n" + "#" * 100 + "\n\n"
    assert records.article_texts(t).first()["content"] == "x\ny\n" + rule + rule + "n\n"
    lines = spark.createDataFrame([(1, k, v) for k, v in enumerate(["p", "", "", "q", "r"])], "page_id long, idx int, line string")
    assert [r["polygons"] for r in records.text_articles(lines).orderBy("article_no").collect()] == [["p"], [], ["q", "r"]]


def test_channels_wrap(spark):
    px = [(1, 0, x, v) for x, v in enumerate((0, 255, 254))]
    t = spark.createDataFrame(px * 2, "img_id long, y int, x int, v int")
    assert {r["x"]: r["v"] for r in raster.other_channel(t).collect()} == {0: 255, 1: 0, 2: 0}
    assert groundtruth.other_image(*[np.array([[0, 255, 254]], np.uint8)] * 2).tolist() == [[255, 0, 0]]
    assert groundtruth.disjoint_images([np.array([[255, 0]], np.uint8), np.array([[255, 255]], np.uint8)])[1].tolist() == [[0, 255]]


def test_channels_of_all_modes():
    ring = [[(2, 2), (30, 2), (30, 30), (2, 30)]]
    for mode, names in records.CHANNELS.items():
        got = groundtruth.article_channels(mode.upper(), ring, [[(5, 10), (25, 10)]], 1.0, 40, 40)
        assert tuple(got) == names and all(i.shape == (40, 40) for i in got.values())
    assert not groundtruth.article_image([], 0.5, 40, 40).any()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(100)] + [(500, 501 + k) for k in range(50)] + [(rng.randint(600, 700), rng.randint(600, 700)) for _ in range(60)]
    root = {v: v for e in links for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    loops = {v for e in links for v in e} - {v for e in links if e[0] != e[1] for v in e}
    t = spark.createDataFrame([*links, (None, 3)], "src long, dst long")
    got = {r["node"]: r["component"] for r in components.connected_components(t).collect()}
    assert got == {v: find(v) for v in root if v not in loops}


def test_xy_cut_crops_both_axes(spark):
    img = np.zeros((12, 12), int)
    img[:5, :5] = img[:5, 7:] = img[7:] = 255
    px = [(1, y, x, int(img[y, x])) for y in range(12) for x in range(12)]
    got = {tuple(r)[1:] for r in raster.xy_cut(spark.createDataFrame(px, "img_id long, y int, x int, v int"), 2).collect()}
    assert {(1, 0, 0, 12, 5), (2, 0, 0, 5, 5)} <= got


def test_registered_queries_have_names_apart():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "article_clustering" in entry.queries()


# ---- work of folds at size --------------------------------------------------------------------


def _crowded_page(n=300, seed=4):
    rng = random.Random(seed)
    pts = [[(x := 40 + (k % 3) * 620 + rng.randint(0, 24), y := rng.randint(0, 8999)), (x + rng.randint(400, 560), y)] for k in range(n)]
    return [{"idx": k, "points": np.array(p), "surr": None, "article": rng.choice([None, "a1", "a2", "a3"])} for k, p in enumerate(pts)]


def test_candidates_that_lie_beyond_a_foreign_line_are_not_tried(monkeypatch):
    tried, whole = [], A._clear_of
    monkeypatch.setattr(A, "_clear_of", lambda *a: tried.append(1) or whole(*a))
    got = A.article_rectangles(_crowded_page())
    assert sorted(i for r in got for i in r["lines"]) == list(range(300)) and len(got) < 290
    assert len(tried) < 200  # 800 while each one was tried


def test_pairs_of_far_rectangles_are_not_looked_at(monkeypatch):
    met, meet = [], P.meet
    rects = A.article_rectangles(_crowded_page())
    monkeypatch.setattr(P, "meet", lambda *a: met.append(1) or meet(*a))
    assert len(A.merged_outlines(rects)) > 100
    assert len(met) < len(rects) * 4


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_lines_of_a_page_travel_once(spark):
    sf = "/root/testdata/sf0.001"
    assert _exchanges(PG.article_outlines(spark, sf)) == 1
    assert _exchanges(PG.ground_truth_ab_a(spark, sf)) == 1


def test_ground_truth_of_lines_is_that_of_their_outlines(spark):
    rows = PG.lines(spark, "/root/testdata/sf0.001").where("page_id < 2")
    for mode in ("ab_bl", "AB_A"):
        want = groundtruth.article_ground_truth(A.outlines(rows, least_width=10), rows, 9000, 1920, mode, 0.1)
        got = groundtruth.line_ground_truth(rows, 9000, 1920, mode, 0.1, least_width=10)
        key = lambda r: (r["page_id"], r["channel"])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and len({key(r) for r in got.collect()}) == got.count()


def test_distances_of_any_direction_need_no_pairs_of_points_in_a_shuffle(spark):
    from broadsheet.plans import clustering as PC

    plan = PC.slanted_interline_distance(spark, "/root/testdata/sf0.001")
    assert _exchanges(plan) == 1 and "Join" not in plan._jdf.queryExecution().executedPlan().toString()


def test_distances_of_horizontal_pages_are_those_of_the_join(spark):
    rng = random.Random(13)
    rows = [line(p, k, [(x := rng.randint(0, 300), y := rng.randint(0, 900)), (x + rng.randint(0, 200), y)]) for p in range(3) for k in range(40)]
    want = {(r["page_id"], r["idx"]): r["dist"] for r in O.interline_distances(table(spark, rows), 60).collect()}
    got = {(r["page_id"], r["idx"]): r["dist"] for r in O.distances(table(spark, rows), 5, 60).collect()}
    assert got == want


def test_triangles_keep_their_places_while_points_come_in(monkeypatch):
    rng = random.Random(9)
    points = np.array(sorted({(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(400)}))
    sorts, unique = [], np.unique
    monkeypatch.setattr(np, "unique", lambda *a, **b: sorts.append(1) or unique(*a, **b))
    tri = P.delaunay(points)
    assert not sorts  # one for each point before
    p = points.astype(float)
    a, b, c = p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]
    twice = np.abs((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0])
    assert twice.sum() / 2 == pytest.approx(P.area(P.hull(points)), rel=0.01)
    assert set(tri.ravel().tolist()) == set(range(len(points)))


def test_few_lines_find_their_distances_as_the_whole_text_says():
    rng = random.Random(21)
    for _ in range(60):
        pts = [[(x := rng.randint(0, 90), y := rng.randint(0, 90)), (x + rng.randint(1, 60), y + rng.randint(-9, 9))] for _ in range(rng.randint(1, 8))]
        got = A.distances([{"points": np.array(p)} for p in pts])
        want = _naive_distances([[tuple(map(float, q)) for q in P.resample(p, 5)] for p in pts], 5, 50)
        assert got == pytest.approx(want, abs=1e-6)


def test_parts_of_a_page_come_as_columns(spark):
    rows = table(spark, [line(1, k, [(10, 40 * k + 20), (90, 40 * k + 20)], a) for k, a in enumerate("aabb")])
    got = A.subregions(rows, (0, 0, 128, 200), 1 / 10).orderBy("rect_id").collect()
    lines = [{"idx": k, "points": np.array([(10, 40 * k + 20), (90, 40 * k + 20)]), "surr": None, "article": a} for k, a in enumerate("aabb")]
    want = A.quadtree((0, 0, 128, 200), lines, 10, 20)
    assert [(tuple(r["r"]), r["line_ids"], r["a_ids"]) for r in got] == [(p["box"], p["lines"], p["a_ids"]) for p in want]


def _plain_quadtree(part, own, boxes, largest):
    x, y, w, h = part
    for q in ((x, y, w // 2, h // 2), (x + w // 2, y, w - w // 2, h // 2), (x, y + h // 2, w // 2, h - h // 2), (x + w // 2, y + h // 2, w - w // 2, h - h // 2)):
        inside = [n for n, b in zip(own, boxes) if min(P.overlap(b, q)) > 0 and min(b[2:]) > 0 and min(q[2:]) > 0]
        ids = sorted({n["article"] for n in inside}, key=lambda a: (a is None, a or ""))
        high = 0 < largest < q[3]
        if min(q[2:]) > 0 and (len(ids) > 1 or high):
            anew = A.line_boxes(inside)
            if high or not all(P.holds(b, q) for b in anew):
                yield from _plain_quadtree(q, inside, anew, largest)
                continue
        yield {"box": q, "lines": [n["idx"] for n in inside], "a_ids": ids}


def test_parts_by_levels_are_those_of_the_plain_recursion_without_resampling_level_lines(monkeypatch):
    rng = random.Random(31)
    for n, largest in ((0, 20), (5, 0), (12, 20), (90, 20), (90, 0)):  # over 62 lines sets are told apart by their places
        lines = []
        for k in range(n):
            x, y, w = rng.randint(0, 250), rng.randint(0, 200), rng.randint(1, 80)
            ring = np.array([(x, y), (x + w, y), (x + w + 1, y - 9), (x + 1, y - 9)]) if rng.random() < 0.5 else None
            lines.append({"idx": 2 * k, "points": np.array([(x, y), (x + w, y)]), "surr": ring, "article": rng.choice([None, "a", "b"])})
        want = list(_plain_quadtree((0, 0, 300, 200), lines, A.line_boxes(lines, 5, 10), largest))
        with monkeypatch.context() as m:
            m.setattr(P, "resample", None)
            assert A.quadtree((0, 0, 300, 200), lines, 10, largest) == want


def test_distances_of_a_page_come_from_few_looks_at_all_lines_together(monkeypatch):
    rng = random.Random(41)
    calls, runs = [], O.runs
    monkeypatch.setattr(O, "runs", lambda sizes: calls.append(1) or runs(sizes))
    for lines_, at_once in ((300, O.AT_ONCE), (12, 40)):  # the second page is cut into many small steps
        monkeypatch.setattr(O, "AT_ONCE", at_once)
        pts = [[(x := 600 * rng.randint(0, 2), y := rng.randint(0, 9000 * lines_ // 300)), (x + 250, y + rng.randint(-4, 4)), (x + 500, y + rng.randint(-9, 9))] for _ in range(lines_)]
        first = np.arange(lines_) * 3
        calls.clear()
        got = O._page_distances(np.concatenate(pts), first, first + 3, 5, 500)
        if lines_ == 300:
            assert len(calls) < 20  # lines were looked at one by one before
            continue
        p, begin = O._resampled_page(np.concatenate(pts).astype(float), first, first + 3, 5)
        want = _naive_distances([list(map(tuple, q)) for q in np.split(p, begin[1:])], 5, 500)
        assert got == pytest.approx(want, abs=1e-9)


def test_outlines_come_from_circles_and_are_those_of_all_triangles(monkeypatch):
    rng = random.Random(51)
    rings = 0
    for k in range(120):
        pts = []
        for _ in range(rng.randint(1, 12) if k % 2 else 0):  # lines of a page, each with its points raised
            x, y, w, d = rng.randint(0, 500), rng.randint(0, 600), rng.randint(20, 300), rng.randint(1, 60)
            q = P.resample([(x, y), (x + w, y)], rng.choice([20, 50])).tolist()
            pts += q + [(a + 1, b - d) for a, b in q]
        pts = pts or [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(rng.choice([9, 30, 90]))]
        alpha = rng.choice([15, 40, 75])
        p = np.array(sorted({tuple(q) for q in pts}))
        want = P._alpha_shape_by_triangles(p, alpha)
        with monkeypatch.context() as m:
            if k % 2:
                m.setattr(P, "delaunay", None)  # each point was put into a triangulation before
            got = P.alpha_shape(pts, alpha)
        if want != P.hull(pts):  # flat triangles at the hull are missing there
            assert got == want
            rings += 1
        assert set(P.hull(pts)) <= set(got)
    assert rings > 60


def test_a_flat_triangle_at_the_hull_with_a_large_circle_is_no_part_of_the_outline():
    points = [(10, 46), (10, 59), (30, 38), (33, 35), (26, 30)]
    assert P.alpha_shape(points, 75) == points  # the hull, without (30, 38), before


def test_lines_are_resampled_together_as_one_by_one():
    lines = [np.array(v) for v in ([(0, 0), (100, 7)], [(5, 5), (5, 5)], [(0, 0), (30, 40), (-7, 3)])]
    assert [v.tolist() for v in P.resampled(lines, 7)] == [P.resample(v, 7).tolist() for v in lines]
