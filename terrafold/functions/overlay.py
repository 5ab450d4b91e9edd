"""Overlays of shapes as geometry: union, intersection, difference and symmetric difference, and outlines of rings that cross.

A shape is a list of closed rings by the even-odd rule, so holes and parts need no marks. Points go to a fine grid
(EXTENT steps over both shapes), on which every test is exact; edges are cut where they meet, edges that lie on each other
cancel by twos, and an edge stays where the wanted inside changes across it. What stays is linked to rings, interior on the left, cut
where a ring passes a point twice, and holes go to the smallest ring around them.

A result is a list of polygons, each its outer ring (counter-clockwise) and then its holes (clockwise), from their lowest
points on, so equal areas give equal lists. Corners keep their given coordinates; points on straight lines go.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import listed
from .geometry import RING, signed_area

POLYGONS = f"array<array<{RING}>>"
_POLYGONS_ARROW = pa.list_(pa.list_(pa.list_(pa.struct({"x": pa.float64(), "y": pa.float64()}))))
#: Steps of the grid over the larger extent; products of differences stay within 64 bits.
EXTENT = 1 << 27
#: Pairs of edges that are tested at once.
PAIRS = 1 << 20


def _turn(o: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Positive where q lies left of the line from o to p."""
    return (p[..., 0] - o[..., 0]) * (q[..., 1] - o[..., 1]) - (p[..., 1] - o[..., 1]) * (q[..., 0] - o[..., 0])


def _meetings(edges: np.ndarray) -> np.ndarray:
    """Rows (edge, x, y): points within edges at which another edge crosses, ends or begins."""
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    order = np.argsort(low[:, 0], kind="stable")
    left = low[order, 0]
    found, at = [], 0
    while at < len(order):
        # a run of edges by their left ends, against all that begin before it ends
        step = max(1, min(len(order) - at, PAIRS // max(1, len(order) - at)))
        rows = order[at : at + step]
        until = np.searchsorted(left, high[rows, 0].max(), side="right")
        columns = order[at:until]
        meet = (low[columns, 0] <= high[rows, None, 0]) & (low[columns, 1] <= high[rows, None, 1]) & (high[columns, 1] >= low[rows, None, 1])
        meet &= np.arange(at, until) > np.arange(at, at + len(rows))[:, None]
        i, j = np.nonzero(meet)
        i, j = rows[i], columns[j]
        a, b, c, d = edges[i, :2], edges[i, 2:], edges[j, :2], edges[j, 2:]
        sides = [_turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)]
        signs = [np.sign(s) for s in sides]
        cross = (signs[0] * signs[1] < 0) & (signs[2] * signs[3] < 0)
        t = sides[2][cross] / (sides[2][cross] - sides[3][cross]).astype(float)
        point = np.rint(a[cross] + t[:, None] * (b - a)[cross]).astype(np.int64)
        found += [np.column_stack([i[cross], point]), np.column_stack([j[cross], point])]
        for side, edge, p in ((signs[0], i, c), (signs[1], i, d), (signs[2], j, a), (signs[3], j, b)):
            on = (side == 0) & (p >= low[edge]).all(1) & (p <= high[edge]).all(1)
            found.append(np.column_stack([edge[on], p[on]]))
        at += step
    points = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    own = edges[points[:, 0]]
    return points[(points[:, 1:] != own[:, :2]).any(1) & (points[:, 1:] != own[:, 2:]).any(1)]


def _cut(edges: np.ndarray, of: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges cut at points on them, and their rows of `of`."""
    n = np.arange(len(edges))
    stops = np.concatenate([np.column_stack([n, edges[:, :2]]), points, np.column_stack([n, edges[:, 2:]])])
    along = ((stops[:, 1:] - edges[stops[:, 0], :2]) * (edges[:, 2:] - edges[:, :2])[stops[:, 0]]).sum(1)
    stops = stops[np.lexsort((along, stops[:, 0]))]
    same = (stops[1:, 0] == stops[:-1, 0]) & (stops[1:, 1:] != stops[:-1, 1:]).any(1)
    return np.column_stack([stops[:-1, 1:], stops[1:, 1:]])[same], of[stops[:-1, 0][same]]


def _cancelled(edges: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each edge once, from its lower end (x, then y), with the shapes that have it an odd number of times."""
    back = (edges[:, 0] > edges[:, 2]) | ((edges[:, 0] == edges[:, 2]) & (edges[:, 1] > edges[:, 3]))
    edges = np.where(back[:, None], edges[:, [2, 3, 0, 1]], edges)
    one, which = np.unique(edges, axis=0, return_inverse=True)
    total = np.zeros((len(one), odd.shape[1]), np.int64)
    np.add.at(total, which.ravel(), odd)
    total &= 1
    keep = total.any(1)
    return one[keep], total[keep]


def _insides(edges: np.ndarray, odd: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each of the rows (none upright), whether the shapes' insides are above it."""
    x0, x1 = 2 * edges[:, 0], 2 * edges[:, 2]
    out = np.empty((len(rows), odd.shape[1]), np.int64)
    step = max(1, PAIRS // max(1, len(edges)))
    for at in range(0, len(rows), step):
        middle = edges[rows[at : at + step], :2] + edges[rows[at : at + step], 2:]
        over = (x0 <= middle[:, None, 0]) & (middle[:, None, 0] < x1) & (_turn(2 * edges[:, :2], 2 * edges[:, 2:], middle[:, None]) < 0)
        out[at : at + step] = (over.astype(np.int64) @ odd) & 1
    return out


def _linked(edges: np.ndarray) -> list[np.ndarray]:
    """Directed edges as rings without a point that is passed twice: at each point the sharpest left turn goes on."""
    leaving: dict[tuple, list[int]] = {}
    rows = edges.tolist()
    for k, (x, y, _, _) in enumerate(rows):
        leaving.setdefault((x, y), []).append(k)

    def after(k: int) -> int:
        x0, y0, x1, y1 = rows[k]
        choices = leaving[x1, y1]
        if len(choices) == 1:
            return choices[0]
        back = math.atan2(y0 - y1, x0 - x1)
        return min(choices, key=lambda c: (back - math.atan2(rows[c][3] - y1, rows[c][2] - x1)) % math.tau or math.tau)

    rings, used = [], [False] * len(rows)
    for first in range(len(rows)):
        path: list[tuple] = []
        seen: dict[tuple, int] = {}
        k = first
        while not used[k]:
            used[k] = True
            p = (rows[k][0], rows[k][1])
            if p in seen:  # a ring closes within the walk
                rings.append(np.array(path[seen[p] :], np.int64))
                for q in path[seen[p] :]:
                    del seen[q]
                del path[len(path) - len(rings[-1]) :]
            seen[p] = len(path)
            path.append(p)
            k = after(k)
        if path:
            rings.append(np.array(path, np.int64))
    return rings


def _trimmed(ring: np.ndarray) -> np.ndarray:
    """An open ring without points on straight lines, from its lowest point on, closed."""
    bend = _turn(np.roll(ring, 1, axis=0), ring, np.roll(ring, -1, axis=0)) != 0
    ring = ring[bend]
    if len(ring) < 3:
        return np.zeros((0, 2), np.int64)
    ring = np.roll(ring, -int(np.lexsort((ring[:, 1], ring[:, 0]))[0]), axis=0)
    return np.concatenate([ring, ring[:1]])


def _twice_area(ring: np.ndarray) -> int:
    x, y = (ring - ring[0]).T.astype(float)
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum())


def _around(ring: np.ndarray, hole: np.ndarray) -> bool:
    """Whether a ring goes round a hole that has no edge in common with it."""
    p = hole[0] + hole[1]
    a, b = 2 * ring[:-1], 2 * ring[1:]
    back = a[:, 0] > b[:, 0]
    a, b = np.where(back[:, None], b, a), np.where(back[:, None], a, b)
    if hole[0, 0] == hole[1, 0]:  # the middle of an upright edge: look sideways
        a, b, p = a[:, ::-1], b[:, ::-1], p[::-1]
        back = a[:, 0] > b[:, 0]
        a, b = np.where(back[:, None], b, a), np.where(back[:, None], a, b)
    return bool(((a[:, 0] <= p[0]) & (p[0] < b[:, 0]) & (_turn(a, b, p) < 0)).sum() & 1)


def linked_polygons(edges: np.ndarray) -> list[list[np.ndarray]]:
    """Polygons of directed edges (x, y, x, y; integers, interior on the left) that don't cross, in the order of their lowest points."""
    sized = [(r, _twice_area(r)) for r in map(_trimmed, _linked(edges)) if len(r)]
    outer = sorted(((r, a) for r, a in sized if a > 0), key=lambda ra: (ra[1], ra[0].tolist()))
    held: list[list[np.ndarray]] = [[r] for r, _ in outer]
    for hole in sorted((r for r, a in sized if a < 0), key=lambda r: r.tolist()):
        for polygon in held:  # the smallest first
            if (polygon[0].min(0) <= hole.min(0)).all() and (polygon[0].max(0) >= hole.max(0)).all() and _around(polygon[0], hole):
                polygon.append(hole)
                break
    return sorted(held, key=lambda p: p[0].tolist())


def combine(shapes: list[list[np.ndarray]], rule: Callable[[np.ndarray], np.ndarray]) -> list[list[np.ndarray]]:
    """The polygons of all places where the rule holds; it is given a matrix of which shapes' insides places are in.

    Rings that aren't finite or have fewer than three edges have no inside.
    """
    layers = [[r for r in rings if len(r) > 3 and np.isfinite(r).all()] for rings in shapes]
    flat = [r for rings in layers for r in rings]
    if not flat:
        return []
    points = np.concatenate(flat)
    origin = points.min(0)
    extent = float((points.max(0) - origin).max())
    if extent == 0:
        return []
    step = 2.0 ** math.ceil(math.log2(extent)) / EXTENT
    snapped = [np.rint((r - origin) / step).astype(np.int64) for r in flat]
    given = dict(zip(map(tuple, np.concatenate(snapped)[::-1].tolist()), points[::-1].tolist()))
    edges = np.concatenate([np.column_stack([r[:-1], r[1:]]) for r in snapped])
    layer = np.repeat([k for k, rings in enumerate(layers) for _ in rings], [len(r) - 1 for r in snapped])
    edges, odd = _cancelled(edges, np.eye(len(shapes), dtype=np.int64)[layer])
    while len(edges):
        inside = (edges[:, :2] != edges[:, 2:]).any(1)
        edges, odd = edges[inside], odd[inside]
        met = _meetings(edges)
        if not len(met):
            break
        edges, odd = _cancelled(*_cut(edges, odd, met))  # rounded points can make new meetings: until there are none
    upright = edges[:, 0] == edges[:, 2]
    beyond = np.empty((len(edges), len(shapes)), np.int64)
    beyond[~upright] = _insides(edges, odd, np.flatnonzero(~upright))
    turned = edges[:, [1, 0, 3, 2]]
    back = turned[:, 0] > turned[:, 2]
    turned = np.where(back[:, None], turned[:, [2, 3, 0, 1]], turned)
    beyond[upright] = _insides(turned, odd, np.flatnonzero(upright))
    here, there = rule(beyond.astype(bool)), rule((beyond ^ odd).astype(bool))
    stays = here != there
    forward = (here ^ upright)[stays]  # interior on the left; beyond an upright edge is its right side
    edges = edges[stays]
    held = linked_polygons(np.where(forward[:, None], edges, edges[:, [2, 3, 0, 1]]))
    real = lambda r: np.array([given.get(p) or (origin + np.array(p) * step).tolist() for p in map(tuple, r.tolist())])
    return [[real(r) for r in polygon] for polygon in held]


#: What each operation keeps of two shapes' insides.
RULES: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "union": lambda m: m.any(1),
    "intersection": lambda m: m.all(1),
    "difference": lambda m: m[:, 0] & ~m[:, 1:].any(1),
    "symmetric_difference": lambda m: np.bitwise_xor.reduce(m, axis=1),
}


def _arrays(rings: list) -> list[np.ndarray]:
    return [np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) for ring in rings or [] if ring and all(p and p["x"] is not None and p["y"] is not None for p in ring)]


def _rows(polygons: list[list[np.ndarray]]) -> list:
    return [[[{"x": x, "y": y} for x, y in ring.tolist()] for ring in polygon] for polygon in polygons]


@listed(POLYGONS, _POLYGONS_ARROW)
def of_edges(edges: pd.Series) -> pd.Series:
    """Polygons of a list of directed edges struct(xa, ya, xb, yb) of whole coordinates, interior on the left. Null for null."""
    as_rows = lambda e: np.array([(v["xa"], v["ya"], v["xb"], v["yb"]) for v in e], np.int64).reshape(-1, 4)
    return edges.map(lambda e: None if e is None else _rows([[r.astype(float) for r in polygon] for polygon in linked_polygons(as_rows(e))]))


@listed(POLYGONS, _POLYGONS_ARROW)
def outline(shapes: pd.Series) -> pd.Series:
    """Polygons of a shape's inside, whatever its rings do: a bow-tie is two triangles, what two rings share is a hole. Null for null."""
    return shapes.map(lambda rings: None if rings is None else _rows(combine([_arrays(rings)], RULES["union"])))


@listed(POLYGONS, _POLYGONS_ARROW)
def dissolved(shapes: pd.Series) -> pd.Series:
    """The union of a list of shapes, each with an inside of its own. Null for null."""
    return shapes.map(lambda parts: None if parts is None else _rows(combine([_arrays(rings) for rings in parts], RULES["union"])) if len(parts) else [])


def thinned(line: np.ndarray, tolerance: float) -> np.ndarray:
    """A line's points without those that its remaining edges pass within the tolerance: halved at the farthest point until none is farther."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    spans = [(0, len(line) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        d, v = line[b] - line[a], line[a + 1 : b] - line[a]
        long = float(d @ d)
        t = np.clip(v @ d / long, 0, 1) if long else np.zeros(len(v))
        off = ((v - t[:, None] * d) ** 2).sum(1)
        far = int(off.argmax())
        if off[far] > tolerance**2:
            keep[a + 1 + far] = True
            spans += [(a, a + 1 + far), (a + 1 + far, b)]
    return line[keep]


def _thin_ring(ring: np.ndarray, fixed: set[tuple], tolerance: float) -> np.ndarray:
    """A closed ring, thinned between its fixed points; every arc from its lower end on, so both sides of a border make the same of it."""
    open_ = ring[:-1]
    at = [k for k, p in enumerate(open_.tolist()) if tuple(p) in fixed]
    if len(at) < 2:  # its lowest point and the one farthest from it
        low = at[0] if at else int(np.lexsort((open_[:, 1], open_[:, 0]))[0])
        at = sorted({low, int(((open_ - open_[low]) ** 2).sum(1).argmax())})
    around = np.concatenate([open_, open_])
    parts = []
    for a, b in zip(at, [*at[1:], at[0] + len(open_)]):
        arc = around[a : b + 1]
        turn = tuple(arc[-1]) < tuple(arc[0]) or (tuple(arc[-1]) == tuple(arc[0]) and tuple(arc[-2]) < tuple(arc[1]))
        arc = thinned(arc[::-1] if turn else arc, tolerance)
        parts.append((arc[::-1] if turn else arc)[:-1])
    made = np.concatenate(parts)
    return np.concatenate([made, made[:1]]) if len(made) > 2 else ring


def _crossing(rings: list[np.ndarray]) -> bool:
    """Whether edges of these rings meet elsewhere than at their ends."""
    points = np.concatenate(rings)
    extent = float((points.max(0) - points.min(0)).max())
    step = 2.0 ** math.ceil(math.log2(extent)) / EXTENT if extent else 1.0
    edges = np.concatenate([np.column_stack([r[:-1], r[1:]]) for r in (np.rint((r - points.min(0)) / step).astype(np.int64) for r in rings)])
    return len(_meetings(edges[(edges[:, :2] != edges[:, 2:]).any(1)])) > 0


def simplify(polygons: list[list[np.ndarray]], fixed: set[tuple], tolerance: float) -> list[list[np.ndarray]]:
    """Polygons with fewer points, none of the old ones farther than the tolerance from the new edges; where that would make edges cross, half the tolerance."""
    while polygons and tolerance > 0:
        made = [[_thin_ring(ring, fixed, tolerance) for ring in polygon] for polygon in polygons]
        rings = [r for polygon in made for r in polygon]
        if not _crossing(rings) and all(_twice_area(r) * _twice_area(old) > 0 for r, old in zip(rings, (r for p in polygons for r in p))):
            return made
        tolerance = tolerance / 2 if tolerance > 1e-12 else 0.0
    return polygons


def simplified(tolerance: float):
    """A column function of polygons and an array of points that must stay: `simplify` for each row. Null for null."""

    @listed(POLYGONS, _POLYGONS_ARROW)
    def apply(polygons: pd.Series, fixed: pd.Series) -> pd.Series:
        def one(parts, points):
            if parts is None:
                return None
            return _rows(simplify([_arrays(polygon) for polygon in parts], {(p["x"], p["y"]) for p in (points if points is not None else [])}, tolerance))

        return pd.Series([one(p, f) for p, f in zip(polygons, fixed)], dtype=object)

    return apply


def overlay(how: str):
    """A column function of two shapes (columns of rings): union, intersection, difference or symmetric_difference. Null if either is."""
    rule = RULES[how]

    @listed(POLYGONS, _POLYGONS_ARROW)
    def apply(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _rows(combine([_arrays(a), _arrays(b)], rule)) for a, b in zip(left, right)], dtype=object)

    return apply


def polygons_area(polygons: Column) -> Column:
    """Planar area: outer rings count, holes are taken off."""
    return F.aggregate(polygons, F.lit(0.0), lambda total, p: total + F.aggregate(p, F.lit(0.0), lambda t, ring: t + signed_area(ring)))


def all_rings(polygons: Column) -> Column:
    """Polygons as one shape of rings again."""
    return F.flatten(polygons)
