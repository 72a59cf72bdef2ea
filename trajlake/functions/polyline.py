"""Douglas-Peucker features: kept vertices, one tight box along each chord, and distances to such boxes."""

from __future__ import annotations

import numpy as np

THETA = 0.01


def simplify(pts: np.ndarray, theta: float = THETA) -> list[int]:
    """Indexes of the vertices kept; distances are to the infinite line through the chord, both ends always stay."""
    keep, todo = {0, len(pts) - 1}, [(0, len(pts) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        inner, chord = pts[a + 1 : b] - pts[a], pts[b] - pts[a]
        length = np.hypot(*chord)
        far = np.hypot(inner[:, 0], inner[:, 1]) if length == 0 else np.abs(chord[0] * inner[:, 1] - chord[1] * inner[:, 0]) / length
        i = int(far.argmax())
        if far[i] > theta:
            keep.add(a + 1 + i)
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    return sorted(keep)


def chord_boxes(pts: np.ndarray, kept: list[int]) -> np.ndarray:
    """For each kept chord the tight box along it around the points it stands for: (chords, 4 corners, 2)."""
    out = []
    for a, b in zip(kept[:-1], kept[1:], strict=True):
        chord = pts[b] - pts[a]
        length = np.hypot(*chord)
        u = chord / length if length else np.array([1.0, 0.0])
        v = np.array([-u[1], u[0]])
        own = pts[a : b + 1] - pts[a]
        s, t = own @ u, own @ v
        out.append([pts[a] + x * u + y * v for x, y in ((s.min(), t.min()), (s.max(), t.min()), (s.max(), t.max()), (s.min(), t.max()))])
    return np.array(out).reshape(-1, 4, 2)


def point_to_boxes(p: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Distances (points, boxes) from points to boxes with any direction; 0 inside."""
    origin = boxes[:, 0]
    u, v = boxes[:, 1] - origin, boxes[:, 3] - origin
    length, height = np.hypot(u[:, 0], u[:, 1]), np.hypot(v[:, 0], v[:, 1])
    # the longer side gives the direction: that of a side of no length is noise
    swap = height > length
    long, size = np.where(swap[:, None], v, u), np.maximum(length, height)
    eu = np.where((size > 0)[:, None], long / np.where(size > 0, size, 1)[:, None], [1.0, 0.0])
    short = np.where(swap[:, None], u, v)
    ev = np.stack([-eu[:, 1], eu[:, 0]], 1)
    ev *= np.where((short * ev).sum(1) < 0, -1, 1)[:, None]
    length, height = size, np.minimum(length, height)
    d = p[:, None, :] - origin[None]
    s, t = (d * eu[None]).sum(2), (d * ev[None]).sum(2)
    ds, dt = np.maximum(np.maximum(-s, s - length), 0), np.maximum(np.maximum(-t, t - height), 0)
    return np.hypot(ds, dt)


def boxes_apart(query_points: np.ndarray, query_boxes: np.ndarray, points: np.ndarray, boxes: np.ndarray, eps: float, slack: float = 1e-9) -> bool:
    """Is a kept vertex of either trajectory farther than eps from all boxes of the other? Then their distance exceeds eps."""
    one = point_to_boxes(query_points, boxes).min(1).max() if len(boxes) else 0.0
    two = point_to_boxes(points, query_boxes).min(1).max() if len(query_boxes) else 0.0
    return max(one, two) > eps + slack


def in_polygon(p: np.ndarray, polygon: np.ndarray) -> np.ndarray:
    """Which of the points (n, 2) lie in a convex polygon (corners in order, either way round), its border included?"""
    a, b = polygon, np.roll(polygon, -1, axis=0)
    side = (b[None, :, 0] - a[None, :, 0]) * (p[:, None, 1] - a[None, :, 1]) - (b[None, :, 1] - a[None, :, 1]) * (p[:, None, 0] - a[None, :, 0])
    return (side >= 0).all(1) | (side <= 0).all(1)


def point_to_segments(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances (points, segments)."""
    step = b - a
    squared = (step**2).sum(1)
    t = np.clip(((p[:, None] - a[None]) * step[None]).sum(2) / np.where(squared > 0, squared, 1), 0, 1)
    foot = a[None] + t[..., None] * step[None]
    return np.hypot(p[:, None, 0] - foot[..., 0], p[:, None, 1] - foot[..., 1])


def segment_to_polygon(a: np.ndarray, b: np.ndarray, polygon: np.ndarray) -> float:
    """Distance from a segment to a convex polygon; 0 if they meet."""
    c, d = polygon, np.roll(polygon, -1, axis=0)
    if in_polygon(np.array([a, b]), polygon).any():
        return 0.0
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    turn = cross(b - a, d - c)
    safe = np.where(turn != 0, turn, 1)
    t, u = cross(c - a, d - c) / safe, cross(c - a, b - a) / safe
    if ((turn != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)).any():
        return 0.0
    return float(min(point_to_segments(np.array([a, b]), c, d).min(), point_to_segments(polygon, a[None], b[None]).min()))


def box_to_boxes(box: np.ndarray, boxes: np.ndarray) -> float:
    """The largest, over the four edges of a box (4, 2), of the smallest distance to a set of boxes (n, 4, 2)."""
    return max(min(segment_to_polygon(a, b, other) for other in boxes) for a, b in zip(box, np.roll(box, -1, axis=0), strict=True))
