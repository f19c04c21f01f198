"""Two pictures of one page laid over each other: corners, binary descriptors, a robust similarity, warping and filling.

As in ``pixels``, a kernel sees single images of bounded size.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np

from quire.operators.pixels import grey

# Matches kept and least number of them, distance of an inlier in pixels, and limits of the quality names.
MOST_MATCHES, LEAST_MATCHES, INLIER = 350, 8, 4.0
HIGH_SHARE, HIGH_RESIDUAL, MEDIUM_SHARE = 0.45, 3.5, 0.20
CORNERS, PATCH, BITS, TRIALS = 700, 12, 256, 400


class Registration(NamedTuple):
    """A similarity (2 x 3) that takes the second image's points to the first's, null where none was found."""

    matrix: np.ndarray | None
    n_matches: int
    n_inliers: int
    residual: float | None
    quality: str


def _box_blur(tone: np.ndarray, steps: int) -> np.ndarray:
    total = np.pad(np.pad(tone, steps, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    k = 2 * steps + 1
    return (total[k:, k:] - total[:-k, k:] - total[k:, :-k] + total[:-k, :-k]) / k**2


def corners(tone: np.ndarray, most: int = CORNERS) -> np.ndarray:
    """(x, y) of the strongest corners (Harris), none nearer to the border than a patch or to a stronger one than two pixels."""
    dy, dx = np.gradient(_box_blur(tone, 1))
    xx, yy, xy = (_box_blur(v, 2) for v in (dx * dx, dy * dy, dx * dy))
    strength = xx * yy - xy**2 - 0.04 * (xx + yy) ** 2
    inner = np.zeros(tone.shape, bool)
    inner[PATCH:-PATCH, PATCH:-PATCH] = True
    around = np.lib.stride_tricks.sliding_window_view(np.pad(strength, 2, constant_values=-np.inf), (5, 5)).max((2, 3))
    at = np.argwhere(inner & (strength >= around) & (strength > 1e-6 * max(float(strength.max()), 1e-12)))
    order = np.lexsort((at[:, 1], at[:, 0], -strength[at[:, 0], at[:, 1]]))[:most]
    return at[order][:, ::-1]


def descriptors(tone: np.ndarray, points: np.ndarray) -> np.ndarray:
    """256 bits of each point, packed: comparisons of blurred tones at fixed places, turned with the patch's centre of mass."""
    soft = _box_blur(tone, 2)
    rng = np.random.default_rng(1)
    pairs = np.clip(np.rint(rng.normal(0, PATCH / 2.5, (2, BITS, 2))), -PATCH + 4, PATCH - 4)
    offset = np.arange(-PATCH + 1, PATCH)
    disc = offset[:, None] ** 2 + offset[None, :] ** 2 < PATCH**2
    out = np.zeros((len(points), BITS // 8), "uint8")
    for i, (x, y) in enumerate(points):
        patch = soft[y - PATCH + 1 : y + PATCH, x - PATCH + 1 : x + PATCH] * disc
        angle = np.arctan2((patch * offset[:, None]).sum(), (patch * offset[None, :]).sum())
        c, s = np.cos(angle), np.sin(angle)
        turned = np.rint(pairs @ np.array([[c, s], [-s, c]])).astype(int)
        a, b = (soft[np.clip(y + t[:, 1], 0, tone.shape[0] - 1), np.clip(x + t[:, 0], 0, tone.shape[1] - 1)] for t in turned)
        out[i] = np.packbits(a < b)
    return out


def similarity(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The similarity of least squares between points (as complex numbers z -> az + b); null for a single place."""
    z, w = source @ [1, 1j], target @ [1, 1j]
    dz = z - z.mean()
    spread = float((np.abs(dz) ** 2).sum())
    if spread < 1e-9:
        return None
    a = (dz.conj() * (w - w.mean())).sum() / spread
    b = w.mean() - a * z.mean()
    return np.array([[a.real, -a.imag, b.real], [a.imag, a.real, b.imag]])


def apply(matrix: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Points under a similarity."""
    return points @ matrix[:, :2].T + matrix[:, 2]


def register(first: np.ndarray, second: np.ndarray, seed: int = 3) -> Registration:
    """The similarity from the second image to the first that most mutual matches of corners agree on (RANSAC, refitted on its inliers)."""
    tones = [grey(i) for i in (first, second)]
    if min(min(t.shape) for t in tones) <= 2 * PATCH + 2:
        return Registration(None, 0, 0, None, "unresolved")
    points = [corners(t) for t in tones]
    bits = [descriptors(t, p) for t, p in zip(tones, points)]
    if not all(map(len, points)):
        return Registration(None, 0, 0, None, "unresolved")
    apart = np.stack([np.bitwise_count(bits[0] ^ d).sum(1) for d in bits[1]])
    best = apart.argmin(1)
    mutual = np.flatnonzero(apart.argmin(0)[best] == np.arange(len(best)))
    mutual = mutual[np.argsort(apart[mutual, best[mutual]], kind="stable")][:MOST_MATCHES]
    if len(mutual) < LEAST_MATCHES:
        return Registration(None, len(mutual), 0, None, "unresolved")
    source, target = points[1][mutual].astype("float64"), points[0][best[mutual]].astype("float64")
    rng, held = np.random.default_rng(seed), np.zeros(len(mutual), bool)
    for _ in range(TRIALS):
        two = rng.choice(len(mutual), 2, replace=False)
        matrix = similarity(source[two], target[two])
        if matrix is not None:
            near = np.linalg.norm(apply(matrix, source) - target, axis=1) <= INLIER
            held = near if near.sum() > held.sum() else held
    if held.sum() < 2:
        return Registration(None, len(mutual), 0, None, "unresolved")
    matrix = similarity(source[held], target[held])
    if matrix is None:
        return Registration(None, len(mutual), 0, None, "unresolved")
    residual, share = float(np.linalg.norm(apply(matrix, source[held]) - target[held], axis=1).mean()), float(held.mean())
    quality = "high" if share >= HIGH_SHARE and residual <= HIGH_RESIDUAL else "medium" if share >= MEDIUM_SHARE else "low"
    return Registration(matrix, len(mutual), int(held.sum()), residual, quality)


def warp(image: np.ndarray, matrix: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """An image laid out under a similarity, by bilinear sampling; beyond its border its edge goes on."""
    inverse = np.linalg.inv(np.vstack([matrix, [0, 0, 1]]))[:2]
    y, x = np.indices(shape)
    at = apply(inverse, np.stack([x.ravel(), y.ravel()], 1).astype("float64"))
    h, w = image.shape[:2]
    px, py = np.clip(at[:, 0], 0, w - 1), np.clip(at[:, 1], 0, h - 1)
    left, top = np.minimum(px.astype(int), max(w - 2, 0)), np.minimum(py.astype(int), max(h - 2, 0))
    right, low = np.minimum(left + 1, w - 1), np.minimum(top + 1, h - 1)
    fx, fy = (px - left)[:, None], (py - top)[:, None]
    tones = image.astype("float64")
    out = (tones[top, left] * (1 - fx) + tones[top, right] * fx) * (1 - fy) + (tones[low, left] * (1 - fx) + tones[low, right] * fx) * fy
    return np.rint(out).astype("uint8").reshape(*shape, -1)


def march_fill(image: np.ndarray, hole: np.ndarray, radius: int = 2) -> np.ndarray:
    """A hole filled from its border inwards (fast marching): each pixel from the known ones within ``radius``, carried on along
    their slopes and weighed by direction, distance and level. An image that is all hole stays as it is."""
    out, known = image.astype("float64"), ~hole
    if not known.any():
        return image.copy()
    h, w = hole.shape
    time = np.where(known, 0.0, np.inf)
    heap = []
    sides = ((-1, 0), (1, 0), (0, -1), (0, 1))

    def arrival(y: int, x: int) -> float:
        """Time at a pixel from its known neighbours: the front moves a pixel a step."""
        across = min((time[y, nx] for nx in (x - 1, x + 1) if 0 <= nx < w and known[y, nx]), default=np.inf)
        down = min((time[ny, x] for ny in (y - 1, y + 1) if 0 <= ny < h and known[ny, x]), default=np.inf)
        low, high = sorted((across, down))
        return low + 1 if high - low >= 1 else (low + high + np.sqrt(2 - (high - low) ** 2)) / 2

    def slope(field: np.ndarray, y: int, x: int) -> tuple[np.ndarray, np.ndarray]:
        def along(a: tuple[int, int], b: tuple[int, int]) -> np.ndarray:
            ok = [0 <= p[0] < h and 0 <= p[1] < w and bool(known[p]) for p in (a, b)]
            here = (y, x)
            lo, hi = (a if ok[0] else here), (b if ok[1] else here)
            span = sum(ok)
            return (field[hi] - field[lo]) / span if span else np.zeros_like(field[here])

        return along((y - 1, x), (y + 1, x)), along((y, x - 1), (y, x + 1))

    def offer(y: int, x: int) -> None:
        if 0 <= y < h and 0 <= x < w and not known[y, x]:
            heapq.heappush(heap, (arrival(y, x), y, x))

    for y, x in zip(*np.nonzero(hole)):
        if any(0 <= y + a < h and 0 <= x + b < w and known[y + a, x + b] for a, b in sides):
            offer(int(y), int(x))
    while heap:
        t, y, x = heapq.heappop(heap)
        if known[y, x]:
            continue
        time[y, x] = t
        ty, tx = slope(time, y, x)
        total, weight = np.zeros(image.shape[2]), 0.0
        for ny in range(max(0, y - radius), min(h, y + radius + 1)):
            for nx in range(max(0, x - radius), min(w, x + radius + 1)):
                ry, rx = y - ny, x - nx
                far = ry * ry + rx * rx
                if not known[ny, nx] or not 0 < far <= radius * radius:
                    continue
                k = max(abs(ry * ty + rx * tx), 1e-6) / (far * np.sqrt(far)) / (1 + abs(time[ny, nx] - t))
                gy, gx = slope(out, ny, nx)
                total += k * (out[ny, nx] + gy * ry + gx * rx)
                weight += k
        out[y, x] = np.clip(total / weight, 0, 255) if weight else out[known].mean(0)
        known[y, x] = True
        for a, b in sides:
            offer(y + a, x + b)
    return np.rint(out).astype("uint8")
