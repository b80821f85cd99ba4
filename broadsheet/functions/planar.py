"""Plane geometry in numpy for operators that fold over a page. y grows downwards; boxes are (x, y, w, h)."""

from __future__ import annotations

import math

import numpy as np

Box = tuple[int, int, int, int]


def box_of(points) -> Box:
    p = np.asarray(points)
    x, y = p.min(0)
    return int(x), int(y), int(p[:, 0].max() - x), int(p[:, 1].max() - y)


def overlap(a: Box, b: Box) -> tuple[int, int]:
    """Extents of the intersection, negative where the boxes are apart."""
    return min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])


def meet(a: Box, b: Box) -> Box:
    w, h = overlap(a, b)
    return max(a[0], b[0]), max(a[1], b[1]), w, h


def union(a: Box, b: Box) -> Box:
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y


def holds(a: Box, b: Box) -> bool:
    return a[0] <= b[0] and a[1] <= b[1] and a[0] + a[2] >= b[0] + b[2] and a[1] + a[3] >= b[1] + b[3]


def corners(b: Box) -> list[tuple[int, int]]:
    """From the upper left, clockwise."""
    x, y, w, h = b
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def segments(points) -> np.ndarray:
    p = np.asarray(points, dtype=float)
    return np.hstack([p[:-1], p[1:]])


def segments_in_box(seg: np.ndarray, box: Box) -> np.ndarray:
    """Which segments (n x 4) have a point inside the box; touching it from outside does not count."""
    if not len(seg):
        return np.zeros(0, bool)
    x0, y0, x1, y1 = box[0], box[1], box[0] + box[2], box[1] + box[3]
    px, py, qx, qy = seg.T
    apart = (np.maximum(px, qx) <= x0) | (np.minimum(px, qx) >= x1) | (np.maximum(py, qy) <= y0) | (np.minimum(py, qy) >= y1)
    hit = ~apart
    at = np.flatnonzero(hit)
    if len(at):  # sides of those alone that are near
        px, py, qx, qy = seg[at].T
        sides = np.stack([(qx - px) * (cy - py) - (qy - py) * (cx - px) for cx, cy in ((x0, y0), (x1, y0), (x0, y1), (x1, y1))])
        hit[at] = ~((sides > 0).all(0) | (sides < 0).all(0))
    return hit


def resample(points, spacing: float) -> np.ndarray:
    """Points at most spacing apart, each segment in equal steps, ends kept."""
    p = np.asarray(points, dtype=float)
    out = []
    for a, b in zip(p[:-1], p[1:]):
        n = max(1, math.ceil(math.hypot(*(b - a)) / spacing))
        out.append(a + (b - a) * np.arange(n)[:, None] / n)
    return np.rint(np.vstack([*out, p[-1:]])).astype(int)


def resampled(lines: list[np.ndarray], spacing: float) -> list[np.ndarray]:
    """resample() of each of some lines."""
    p = np.concatenate(lines).astype(float)
    last = np.cumsum([len(v) for v in lines]) - 1
    step = np.zeros_like(p)
    step[:-1] = p[1:] - p[:-1]
    step[last] = 0
    n = np.maximum(1, np.ceil(np.hypot(step[:, 0], step[:, 1]) / spacing)).astype(np.int64)
    which, ends = np.repeat(np.arange(len(p)), n), np.cumsum(n)
    k = np.arange(len(which)) - np.repeat(ends - n, n)
    return np.split(np.rint(p[which] + step[which] * k[:, None] / n[which][:, None]).astype(int), ends[last[:-1]])


def hull(points) -> list[tuple[int, int]]:
    """Convex hull by monotone chain; collinear points left out."""
    p = sorted({(int(x), int(y)) for x, y in points})
    if len(p) < 3:
        return p

    def chain(seq):
        out: list[tuple[int, int]] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return chain(p) + chain(p[::-1])


def area(points) -> float:
    p = np.asarray(points, dtype=float)
    x, y = p.T
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def clip(subject, clipper) -> list[tuple[float, float]]:
    """The part of subject inside a convex polygon; empty where they share no area."""
    out = [(float(x), float(y)) for x, y in subject]
    c = [(float(x), float(y)) for x, y in clipper]
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(c, c[1:] + c[:1])) < 0:
        c.reverse()
    for (ax, ay), (bx, by) in zip(c, c[1:] + c[:1]):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        nxt = []
        for (p, s), (q, t) in zip(zip(out, side), zip(out[1:] + out[:1], side[1:] + side[:1])):
            if s >= 0:
                nxt.append(p)
            if s * t < 0:
                k = s / (s - t)
                nxt.append((p[0] + (q[0] - p[0]) * k, p[1] + (q[1] - p[1]) * k))
        out = nxt
        if not out:
            return []
    return out if area(out) > 0 else []


def min_area_box(points) -> list[tuple[int, int]]:
    """Corners of the smallest rectangle of any direction; a side of it lies on a side of the hull."""
    h = np.asarray(hull(points), dtype=float)
    if len(h) < 3:
        return [(int(x), int(y)) for x, y in h]
    edge = np.roll(h, -1, 0) - h
    unit = edge / np.hypot(*edge.T)[:, None]
    best = None
    for u in unit:
        v = np.array([-u[1], u[0]])
        a, b = h @ u, h @ v
        size = (a.max() - a.min()) * (b.max() - b.min())
        if best is None or size < best[0] - 1e-9:
            best = size, [u * s + v * t for s, t in ((a.min(), b.min()), (a.max(), b.min()), (a.max(), b.max()), (a.min(), b.max()))]
    return [(int(round(x)), int(round(y))) for x, y in best[1]]


def _rings(edges: dict) -> list[list[tuple[int, int]]]:
    """Closed rings of directed edges (start -> ends), corners only."""
    out = []
    while edges:
        start = min(edges)
        ring, now, came = [start], start, None
        while True:
            ends = edges[now]
            nxt = ends[0]
            if len(ends) > 1 and came is not None:  # where rings touch, turn so that they stay apart
                dx, dy = now[0] - came[0], now[1] - came[1]
                nxt = min(ends, key=lambda e: dx * (e[1] - now[1]) - dy * (e[0] - now[0]))
            ends.remove(nxt)
            if not ends:
                del edges[now]
            came, now = now, nxt
            if now == start:
                break
            ring.append(now)
        n = len(ring)
        turn = [i for i in range(n) if (ring[i][0] - ring[i - 1][0]) * (ring[(i + 1) % n][1] - ring[i][1]) != (ring[i][1] - ring[i - 1][1]) * (ring[(i + 1) % n][0] - ring[i][0])]
        out.append([ring[i] for i in turn])
    return out


def ortho_outlines(boxes: list[Box]) -> list[list[tuple[int, int]]]:
    """Outer outlines of the union of boxes, one for each connected part, by marking the cells between all their edges."""
    boxes = [b for b in boxes if b[2] > 0 and b[3] > 0]
    if not boxes:
        return []
    if len(boxes) == 1:
        return [corners(boxes[0])]
    xs = sorted({v for b in boxes for v in (b[0], b[0] + b[2])})
    ys = sorted({v for b in boxes for v in (b[1], b[1] + b[3])})
    cell = np.zeros((len(ys) + 1, len(xs) + 1), bool)  # a margin of empty cells
    for x, y, w, h in boxes:
        cell[ys.index(y) + 1 : ys.index(y + h) + 1, xs.index(x) + 1 : xs.index(x + w) + 1] = True
    edges: dict = {}
    for i, j in zip(*np.nonzero(cell)):
        x0, x1, y0, y1 = xs[j - 1], xs[j], ys[i - 1], ys[i]
        for empty, a, b in (
            (not cell[i - 1, j], (x0, y0), (x1, y0)), (not cell[i, (j + 1) % cell.shape[1]], (x1, y0), (x1, y1)),
            (not cell[(i + 1) % cell.shape[0], j], (x1, y1), (x0, y1)), (not cell[i, j - 1], (x0, y1), (x0, y0)),
        ):
            if empty:
                edges.setdefault(a, []).append(b)
    rings = _rings(edges)
    signed = [sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:] + r[:1])) for r in rings]
    return [r for r, s in zip(rings, signed) if s > 0]  # the others go round holes


def delaunay(points: np.ndarray) -> np.ndarray:
    """Triangles (n x 3 places) by insertion in order of x; triangles whose circle lies behind the sweep are settled."""
    p = points.astype(float)
    rng = np.random.default_rng(7)
    p = p + rng.uniform(-1e-4, 1e-4, p.shape)  # breaks ties of points on a line or circle
    order = np.argsort(p[:, 0], kind="stable")
    span = max(np.ptp(p[:, 0]), np.ptp(p[:, 1]), 1.0)
    mid = p.mean(0)
    q = np.vstack([p, mid + [-20 * span, -18 * span], mid + [20 * span, -18 * span], mid + [0, 25 * span]])
    n, at = len(p), list(map(tuple, q.tolist()))

    def circle(i: int, j: int, k: int) -> tuple[float, float, float]:
        (ax, ay), (bx, by), (cx, cy) = at[i], at[j], at[k]
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        if abs(d) < 1e-12:
            d = 1e-12
        bb, cc = bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (cy * bb - by * cc) / d, (bx * cc - cx * bb) / d
        return ax + ux, ay + uy, ux * ux + uy * uy

    # live triangles stand in places [0, m) of rings (x, y, square of the radius); a step frees the places of what it drops
    rings, live, m, done = np.empty((3, 64)), [(n, n + 1, n + 2)], 1, []
    rings[:, 0] = circle(n, n + 1, n + 2)
    for step, k in enumerate(order.tolist()):
        x, y = at[k]
        dx = x - rings[0, :m]
        if step % 32 == 31:
            past = (dx > 0) & (dx * dx > rings[2, :m])
            stay = np.flatnonzero(~past)
            done += [live[i] for i in np.flatnonzero(past).tolist()]
            live = [live[i] for i in stay.tolist()]
            rings[:, : len(stay)] = rings[:, stay]
            m, dx = len(stay), dx[stay]
        bad = np.flatnonzero(dx * dx + (y - rings[1, :m]) ** 2 <= rings[2, :m]).tolist()
        edge: dict = {}
        for i in bad:
            a, b, c = live[i]
            for e in ((a, b) if a < b else (b, a), (b, c) if b < c else (c, b), (c, a) if c < a else (a, c)):
                edge[e] = e not in edge
        places = bad
        made = [(a, b, k) for (a, b), once in edge.items() if once]
        if len(made) > len(places):
            places = places + list(range(m, m + len(made) - len(places)))
            live += [()] * (len(places) - len(bad))
            m = len(live)
            if m > rings.shape[1]:
                rings = np.hstack([rings, np.empty((3, m))])
        for i, t in zip(places, made):
            live[i] = t
        rings[:, places[: len(made)]] = np.array([circle(*t) for t in made]).reshape(-1, 3).T
        for i in reversed(places[len(made) :]):  # fewer than before: the last ones move into the gaps
            m -= 1
            live[i], rings[:, i] = live[m], rings[:, m]
            live.pop()
    out = np.array(done + live)
    return out[(out < n).all(1)]


def _alpha_shape_by_triangles(p: np.ndarray, alpha: float) -> list[tuple[int, int]]:
    """alpha_shape() of points in order by all their triangles."""
    tri = delaunay(p)
    if not len(tri):
        return hull(p)
    a, b, c = (p[tri[:, k]].astype(float) for k in range(3))
    la, lb, lc = np.hypot(*(b - c).T), np.hypot(*(a - c).T), np.hypot(*(a - b).T)
    twice = np.abs((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0])
    radius = np.where(twice > 0, la * lb * lc / np.maximum(2 * twice, 1e-12), np.inf)
    least = np.full(len(p), np.inf)  # an alpha up to a point's least radius leaves that point out
    np.minimum.at(least, tri.ravel(), np.repeat(radius, 3))
    while alpha < radius[np.isfinite(radius)].max(initial=0):
        kept = tri[radius < alpha] if alpha > least.max() else tri[:0]
        if len(kept):
            edge = np.sort(np.vstack([kept[:, [0, 1]], kept[:, [1, 2]], kept[:, [2, 0]]]), 1)
            pairs, times = np.unique(edge @ [len(p), 1], return_counts=True)
            outer = np.column_stack(np.divmod(pairs[times == 1], len(p)))
            at: dict[int, list[int]] = {}
            for u, v in outer.tolist():
                at.setdefault(u, []).append(v)
                at.setdefault(v, []).append(u)
            if all(len(v) == 2 for v in at.values()):
                start = int(outer[0, 0])
                ring, before, now = [start], None, start
                while True:
                    nxt = at[now][0] if at[now][0] != before else at[now][1]
                    before, now = now, nxt
                    if now == start:
                        break
                    ring.append(now)
                if len(ring) == len(at) and len(np.unique(kept)) == len(p):
                    return [tuple(map(int, p[i])) for i in ring]
        alpha *= 2
    return hull(p)


#: Directions from a point are looked at in so many sectors, of which one is level and one upright.
SECTORS = 48


class _Ties(Exception):
    """Points that lie on a circle but for rounding."""


def _none_inside(p: np.ndarray, alpha: float):
    """A function of middles: whether a grid of cells shows no point in three boxes inside a circle about them, which lies in all
    circles of radius alpha whose middles are seen from a point in one sector. A point in a cell that lies partly in a box
    does not count, so some are taken for empty that are not."""
    low = p.min(0)
    cell = max(alpha / 12, math.sqrt(float(np.prod(np.ptp(p, 0) + 1.0))) / 512)
    at = ((p - low) // cell).astype(np.int64)
    size = at.max(0) + 1
    total = np.zeros(size + 1, np.int64)
    total[1:, 1:] = np.bincount(at[:, 0] * size[1] + at[:, 1], minlength=size[0] * size[1]).reshape(size).cumsum(0).cumsum(1)
    radius = alpha * (0.999 - 2 * math.sin(np.pi / 2 / SECTORS))

    def cells(v: np.ndarray, half: float, c: int) -> tuple[np.ndarray, np.ndarray]:
        first = np.clip(np.ceil((v - half - low[c]) / cell), 0, size[c]).astype(np.int64)
        return first, np.maximum(first, np.clip(np.floor((v + half - low[c]) / cell), 0, size[c]).astype(np.int64))

    def none(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        left = np.arange(len(x))
        for slope in (np.pi / 4, np.pi / 8, np.pi * 3 / 8):
            (i0, i1), (j0, j1) = cells(x[left], radius * math.cos(slope), 0), cells(y[left], radius * math.sin(slope), 1)
            left = left[total[i1, j1] - total[i0, j1] - total[i1, j0] + total[i0, j0] == 0]
        out = np.zeros(len(x), bool)
        out[left] = True
        return out

    return none


def _maybe_bare(p: np.ndarray, alpha: float, none) -> np.ndarray:
    """Places of all points that a circle of radius alpha without points inside can touch, and of some others."""
    order = np.lexsort((p[:, 0], p[:, 1]))
    x, y = p[order].T
    step = np.where(y[1:] == y[:-1], x[1:] - x[:-1], np.inf)  # to the next point of a level row
    turn = 2 * np.pi / SECTORS
    middle = turn * np.arange(SECTORS)
    # a neighbour on the row keeps circles out of the sectors about its direction
    off = lambda towards: np.abs((middle - towards + np.pi) % (2 * np.pi) - np.pi) + turn / 2
    kept_out = lambda d, towards: (np.cos(np.minimum(off(towards), np.pi)) - 1e-9)[None] > d[:, None] / (2 * alpha)
    k, s = np.nonzero(~(kept_out(np.append(step, np.inf), 0.0) | kept_out(np.insert(step, 0, np.inf), np.pi)))
    bare = none(x[k] + alpha * np.cos(middle[s]), y[k] + alpha * np.sin(middle[s]))
    return np.unique(order[k[bare]])


def _ring_of_circles(p: np.ndarray, alpha: float) -> np.ndarray | None:
    """Places of points on the outline of the alpha shape of p (in order), if it is one ring that has every point on or inside it.

    A point is on the outline if a circle of radius alpha through it has no point inside. Such a circle can turn about the
    point until it meets the two next to it on the outline. One span of turning for each point, and one round of all: a ring.
    """
    for v in (np.sort(p[:, 0]), np.sort(p[:, 1])):
        if (np.diff(v) >= 2 * alpha).any():
            return None  # falls apart
    none = _none_inside(p, alpha)
    some = _maybe_bare(p, alpha, none)
    # those that some may meet: both in some, less than twice alpha apart
    by_y = some[np.argsort(p[some, 1], kind="stable")]
    x, y = p[by_y].astype(float).T
    upto = np.searchsorted(y, y + 2 * alpha)
    sizes = upto - np.arange(len(y)) - 1
    a = np.repeat(np.arange(len(y)), sizes)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    dx, dy = x[b] - x[a], y[b] - y[a]
    d = np.sqrt(dx * dx + dy * dy)
    near = d < 2 * alpha
    a, b, dx, dy, d = a[near], b[near], dx[near], dy[near], d[near]
    half, towards = np.arccos(d / (2 * alpha)), np.arctan2(dy, dx)
    own, other = np.concatenate([a, b]), np.concatenate([b, a])
    if len(np.unique(own)) < len(by_y):
        alone = np.setdiff1d(np.arange(len(by_y)), own)
        if _empty(p, by_y[alone], x[alone] + alpha, y[alone], alpha).any():
            return None
    start = np.concatenate([towards, towards + np.pi]) - np.tile(half, 2)
    start %= 2 * np.pi
    stop = start + 2 * np.tile(half, 2)
    past = stop > 2 * np.pi
    own, other, start, stop = (np.concatenate([v, v[past] - c]) for v, c in ((own, 0), (other, 0), (start, 2 * np.pi), (stop, 2 * np.pi)))
    order = np.argsort(100.0 * own + start)
    own, other, start, stop = own[order], other[order], start[order], stop[order]
    far = np.maximum.accumulate(stop + 100.0 * own)
    holder = np.maximum.accumulate(np.where(stop + 100.0 * own == far, np.arange(len(own)), 0))
    far = stop[holder]
    ends = np.append(np.flatnonzero(np.diff(own)), len(own) - 1)
    begins = np.append(0, ends[:-1] + 1)
    following = np.arange(1, len(own) + 1)
    following[ends] = begins
    until = start[following]
    until[ends] = np.where(start[begins] < 0, -np.inf, start[begins] + 2 * np.pi)
    span = until - far
    if (np.abs(span) < 1e-9).any():
        raise _Ties
    free = np.flatnonzero(span > 0)
    at, middle = own[free], (far + until)[free] / 2
    cx, cy = x[at] + alpha * np.cos(middle), y[at] + alpha * np.sin(middle)
    bare = none(cx, cy)
    free, at, cx, cy = free[bare], at[bare], cx[bare], cy[bare]
    bare = _empty(p, by_y[at], cx, cy, alpha)
    free, at = free[bare], at[bare]
    before, after = other[holder[free]], other[following[free]]
    # where circles touch a pair from both sides nothing hangs on it, and the spans beside it are one
    ties = np.intersect1d(at * len(p) + before, at * len(p) + after)
    first, last = (~np.isin(at * len(p) + v, ties) for v in (before, after))
    outer = np.unique(at)
    if len(outer) < 3 or first.sum() != len(outer) or last.sum() != len(outer) or len(np.unique(at[first])) < len(outer):
        return None
    come, go = np.full(len(by_y), -1), np.full(len(by_y), -1)
    come[at[first]], go[at[last]] = before[first], after[last]
    at = outer
    if (go[at] < 0).any() or (come[go[at]] != at).any() or (go[come[at]] != at).any():
        raise _Ties
    go, now = go.tolist(), int(at[np.argmin(by_y[at])])
    ring = [now]
    while (now := go[now]) != ring[0]:
        ring.append(now)
    if len(ring) < len(at):
        return None
    out = by_y[ring]
    return out if out[1] < out[-1] else np.roll(out[::-1], 1)


def _empty(p: np.ndarray, own: np.ndarray, x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Whether the circles about (x, y), each through its point own, have no other point inside."""
    if not len(x):
        return np.zeros(0, bool)
    order = np.argsort(p[:, 1], kind="stable")
    px, py = np.ascontiguousarray(p[order].T.astype(float))
    place = np.empty(len(p), np.int64)
    place[order] = np.arange(len(p))
    first, last = np.searchsorted(py, y - 1.001 * alpha), np.searchsorted(py, y + 1.001 * alpha)  # own is among them
    begin = np.cumsum(last - first) - (last - first)
    at = np.arange(begin[-1] + last[-1] - first[-1]) + np.repeat(first - begin, last - first)
    square = (px[at] - np.repeat(x, last - first)) ** 2 + (py[at] - np.repeat(y, last - first)) ** 2
    square[begin + place[own] - first] = np.inf
    least = np.minimum.reduceat(square, begin) / (alpha * alpha)
    if (np.abs(least - 1) < 1e-11).any():
        raise _Ties
    return least > 1


def _flat_strip(p: np.ndarray, alpha: float) -> bool:
    """Whether p lies on two levels and no triangle between them has a circle larger than alpha."""
    upper = p[:, 1] == p[0, 1]
    rows = p[upper, 0], p[~upper, 0]
    d = float(p[:, 1].max() - p[:, 1].min())
    if not len(rows[1]) or (p[~upper, 1] != p[:, 1][~upper][0]).any():
        return False
    for row, other in (rows, rows[::-1]):
        if len(row) > 1:  # on each step stands the triangle of the point of the other row nearest to its middle
            middle, half = (row[1:] + row[:-1]) / 2, (row[1:] - row[:-1]) / 2
            at = np.searchsorted(other, middle)
            off = np.minimum(np.abs(other[np.maximum(at - 1, 0)] - middle), np.abs(other[np.minimum(at, len(other) - 1)] - middle))
            if (half**2 + ((off**2 + d * d - half**2) / (2 * d)) ** 2 > alpha * alpha * (1 - 1e-12)).any():
                return False
    return True


def alpha_shape(points, alpha: float) -> list[tuple[int, int]]:
    """Ordered outline of the points' alpha shape. Where it falls apart or is no ring, alpha is doubled, up to the convex hull.

    The outline is found from circles of radius alpha that touch it; where points lie on one circle but for rounding, or
    alpha is far larger than the points' extent, from all triangles.
    """
    p = np.asarray(points).astype(np.int64).reshape(-1, 2)
    if not len(p):
        return []
    low, high = p.min(0), p.max(0)
    keys = np.unique((p[:, 0] - low[0]) * (high[1] - low[1] + 1) + p[:, 1] - low[1])
    p = np.column_stack(np.divmod(keys, high[1] - low[1] + 1)) + low
    if len(p) < 4:
        return [tuple(map(int, v)) for v in p]
    if _flat_strip(p, alpha):
        rows = p[:, 1] == p[0, 1]
        return hull([p[r][k] for r in (rows, ~rows) for k in (0, -1)])
    at = alpha
    try:
        while at < 20 * np.ptp(p, 0).max():
            ring = _ring_of_circles(p, at)
            if ring is not None:
                out = p[ring]
                around = hull(out)
                return around if area(out) == area(around) else [tuple(v) for v in out.tolist()]
            at *= 2
    except _Ties:
        pass
    return _alpha_shape_by_triangles(p, alpha)


def smooth(points, spacing: float = 10, dims=(600, 300, 600, 300), offset: float = 0) -> list[tuple[int, int]]:
    """A crooked outline made smooth.

    Points of the outline, resampled, are counted in boxes of the given dimensions above, right, below and left of
    each vertex; the two fullest tell whether it lies on a vertical or horizontal stretch or at a corner. Single vertices
    that differ from neighbours who agree follow them; of a run of like corners only the middle stays one. Stretches of
    five vertices and more between corners take their mean x (vertical) or mean y (horizontal).
    """
    ring = [tuple(map(float, q)) for q in points]
    if len(ring) < 3:
        return [(int(round(x)), int(round(y))) for x, y in ring]
    p = resample(ring + ring[:1], spacing)[:-1].astype(float)
    wv, hv, wh, hh = dims
    dx, dy = p[None, :, 0] - p[:, None, 0], p[None, :, 1] - p[:, None, 1]
    north = (np.abs(dx) <= wv / 2) & (dy <= offset) & (dy >= offset - hv)
    south = (np.abs(dx) <= wv / 2) & (dy >= -offset) & (dy <= hv - offset)
    east = (np.abs(dy) <= hh / 2) & (dx >= -offset) & (dx <= wh - offset)
    west = (np.abs(dy) <= hh / 2) & (dx <= offset) & (dx >= offset - wh)
    top = np.argsort(-np.stack([north.sum(1), south.sum(1), east.sum(1), west.sum(1)], 1), axis=1, kind="stable")[:, :2]
    kind = np.array(["v" if set(t) == {0, 1} else "h" if set(t) == {2, 3} else "".join("nsew"[k] for k in sorted(t)) for t in top.tolist()])
    agree = (np.roll(kind, 1) == np.roll(kind, -1)) & (np.roll(kind, 1) != kind)
    kind[agree] = np.roll(kind, 1)[agree]
    n = len(p)
    corner = np.array([len(k) == 2 for k in kind])
    for i in range(n):
        if corner[i] and not (corner[i - 1] and kind[i - 1] == kind[i]):
            run = [i]
            while len(run) < n and corner[(run[-1] + 1) % n] and kind[(run[-1] + 1) % n] == kind[i]:
                run.append((run[-1] + 1) % n)
            for j in run:
                if j != run[len(run) // 2]:
                    kind[j] = "v"
    corner = np.array([len(k) == 2 for k in kind])
    at = np.flatnonzero(corner)
    out = p.copy()
    if len(at):
        for a, b in zip(at, np.append(at[1:], at[0] + n)):
            run = np.arange(a + 1, b) % n
            if len(run) >= 5:
                vertical = (kind[run] == "v").sum() * 2 >= len(run)
                out[run, 0 if vertical else 1] = p[run, 0 if vertical else 1].mean()
    return [(int(round(x)), int(round(y))) for x, y in out]


def draw_lines(img: np.ndarray, points, width: int = 1) -> None:
    """Draws an open line of the given width into an image, white."""
    r = (width - 1) // 2
    for a, b in zip(points, points[1:]):
        if not r and (a[0] == b[0] or a[1] == b[1]):
            x0, x1 = (a[0], b[0]) if a[0] <= b[0] else (b[0], a[0])
            y0, y1 = (a[1], b[1]) if a[1] <= b[1] else (b[1], a[1])
            img[y0 if y0 > 0 else 0 : y1 + 1 if y1 >= 0 else 0, x0 if x0 > 0 else 0 : x1 + 1 if x1 >= 0 else 0] = 255
            continue
        n = int(max(abs(b[0] - a[0]), abs(b[1] - a[1]))) + 1
        x = np.rint(np.linspace(a[0], b[0], n)).astype(int)
        y = np.rint(np.linspace(a[1], b[1], n)).astype(int)
        for oy in range(-r, r + 1):
            for ox in range(-r, r + 1):
                if ox * ox + oy * oy <= r * r + r:
                    ok = (x + ox >= 0) & (x + ox < img.shape[1]) & (y + oy >= 0) & (y + oy < img.shape[0])
                    img[y[ok] + oy, x[ok] + ox] = 255


def draw_polygon(img: np.ndarray, points, fill: bool = False, width: int = 1) -> None:
    """Draws a closed outline, and what it holds by the even-odd rule where fill is set."""
    pts = [tuple(p) for p in points]
    if not pts:
        return
    draw_lines(img, pts + pts[:1] if len(pts) > 1 else pts * 2, width)
    if fill and len(pts) > 2:
        edges = list(zip(pts, pts[1:] + pts[:1]))
        first, last = max(0, int(min(y for _, y in pts))), min(img.shape[0] - 1, int(max(y for _, y in pts)))
        if all(a[0] == b[0] or a[1] == b[1] for a, b in edges):  # the same cuts from one corner's height to the next
            rows = sorted({first, last + 1, *(math.ceil(y) for _, y in pts if first < y <= last)})
        else:
            rows = range(first, last + 2)
        for y, end in zip(rows, rows[1:]):
            x = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for a, b in edges if (a[1] <= y) != (b[1] <= y))
            for x0, x1 in zip(x[::2], x[1::2]):
                img[y:end, max(0, math.ceil(x0)) : max(0, math.floor(x1) + 1)] = 255


def swept(img: np.ndarray, rows: int, cols: int, best=np.maximum) -> np.ndarray:
    """Maximum (or minimum) over a rectangle of pixels, anchored at its middle; outside does not count."""
    out = img
    for axis, size in ((1, cols), (0, rows)):
        src, res = out, out.copy()
        for d in range(-(size // 2), size - size // 2):
            if d:
                cut = [slice(None)] * 2
                put = [slice(None)] * 2
                cut[axis], put[axis] = (slice(d, None), slice(None, -d)) if d > 0 else (slice(None, d), slice(-d, None))
                res[tuple(put)] = best(res[tuple(put)], src[tuple(cut)])
        out = res
    return out
