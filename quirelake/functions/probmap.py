"""Text boxes from a detector's probability map."""

from __future__ import annotations

from collections import namedtuple

import numpy as np

Found = namedtuple("Found", "polys scores")


def components(mask: np.ndarray) -> np.ndarray:
    """Numbers (from 1, in order of first pixel) of the 8-connected areas of a mask; 0 is none.

    Runs of each row are joined with those of the row above that they touch.
    """
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    up = np.arange(len(rows))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    for y in range(1, h):
        a, b = first[y - 1], first[y]
        while a < first[y] and b < first[y + 1]:
            if starts[a] <= ends[b] and starts[b] <= ends[a]:  # touching at a corner counts
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
            a, b = (a + 1, b) if ends[a] < ends[b] else (a, b + 1)
    out, number = np.zeros((h, w), np.int32), {}
    for i in range(len(rows)):
        out[rows[i], starts[i] : ends[i]] = number.setdefault(root(i), len(number) + 1)
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull against the clock, by Andrew's chain."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows):
        out: list = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out[:-1]

    return np.array(chain(p.tolist()) + chain(p[::-1].tolist()))


def least_rectangle(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Corners of the rectangle of least area around points (it lies along an edge
    of their hull), as top left, top right, bottom right, bottom left, and its
    shorter side."""
    h = hull(np.asarray(points, float))
    if len(h) == 1:
        return np.repeat(h, 4, axis=0), 0.0
    edges = np.roll(h, -1, axis=0) - h
    angles = np.unique(np.mod(np.arctan2(edges[:, 1], edges[:, 0]), np.pi / 2))
    best = None
    for t in angles:
        axes = np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
        at = h @ axes.T
        low, high = at.min(axis=0), at.max(axis=0)
        size = float(np.prod(high - low))
        if best is None or size < best[0] - 1e-9:
            best = size, low, high, axes
    _, low, high, axes = best
    corners = np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]]) @ axes
    by_x = corners[np.lexsort((corners[:, 1], corners[:, 0]))]
    left, right = by_x[:2][np.argsort(by_x[:2, 1], kind="stable")], by_x[2:][np.argsort(by_x[2:, 1], kind="stable")]
    return np.array([left[0], right[0], right[1], left[1]]), float(min(high - low))


def inside(quad: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Which points lie in a convex quad or on its edge."""
    edges = np.roll(quad, -1, axis=0) - quad
    turn = edges[:, 0][:, None] * (ys[None] - quad[:, 1][:, None]) - edges[:, 1][:, None] * (xs[None] - quad[:, 0][:, None])
    return (turn >= -1e-9).all(axis=0) | (turn <= 1e-9).all(axis=0)


def mean_inside(prob: np.ndarray, quad: np.ndarray) -> float:
    """Mean probability of the pixels in a quad; 0 if there are none."""
    h, w = prob.shape
    x1, y1 = np.clip(np.floor(quad.min(axis=0)), 0, [w - 1, h - 1]).astype(int)
    x2, y2 = np.clip(np.ceil(quad.max(axis=0)), 0, [w - 1, h - 1]).astype(int)
    ys, xs = np.mgrid[y1 : y2 + 1, x1 : x2 + 1]
    hit = inside(np.trunc(quad), xs.ravel(), ys.ravel())
    return float(prob[y1 : y2 + 1, x1 : x2 + 1].ravel()[hit].mean()) if hit.any() else 0.0


def grow(quad: np.ndarray, ratio: float) -> np.ndarray:
    """A rectangle moved outwards by area * ratio / perimeter on each side: the
    least rectangle around the rounded offset of ``quad``."""
    along, across = quad[1] - quad[0], quad[3] - quad[0]
    a, b = np.linalg.norm(along), np.linalg.norm(across)
    if not a or not b:
        return quad
    d = a * b * ratio / (2 * (a + b))
    u, v = along / a * d, across / b * d
    return np.array([quad[0] - u - v, quad[1] + u - v, quad[2] + u + v, quad[3] - u + v])


def text_boxes(
    prob: np.ndarray,
    width: int,
    height: int,
    threshold: float = 0.3,
    least_score: float = 0.6,
    ratio: float = 1.5,
    candidates: int = 1000,
    least_side: float = 3,
) -> Found:
    """Quads (integers, on a page of ``width`` x ``height``) and scores of a probability map.

    Pixels above ``threshold`` form areas, the first ``candidates`` of which are
    read. The least rectangle of an area must have a side of ``least_side`` or
    more and a mean probability of ``least_score``; it is grown, must then have
    ``least_side`` + 2, and is scaled to the page, rounded and clamped.
    """
    areas = components(prob > threshold)
    polys, scores = [], []
    ys, xs = np.nonzero(areas)
    if not len(ys):
        return Found(polys, scores)
    order = np.argsort(areas[ys, xs], kind="stable")
    bounds = np.searchsorted(areas[ys, xs][order], np.arange(1, areas.max() + 2))
    for a, b in zip(bounds[:-1][:candidates], bounds[1:][:candidates], strict=True):
        quad, side = least_rectangle(np.stack([xs[order[a:b]], ys[order[a:b]]], axis=1))
        if side < least_side:
            continue
        score = mean_inside(prob, quad)
        if score < least_score:
            continue
        quad = grow(quad, ratio)
        if min(np.linalg.norm(quad[1] - quad[0]), np.linalg.norm(quad[3] - quad[0])) < least_side + 2:
            continue
        scaled = np.floor(quad * [width / prob.shape[1], height / prob.shape[0]] + 0.5)
        polys.append(np.clip(scaled, 0, [width, height]).astype(int).tolist())
        scores.append(score)
    return Found(polys, scores)
