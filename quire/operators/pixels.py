"""Kernels over single images in numpy, for use inside ``mapInPandas`` (see ``per_image``).

Images are uint8 arrays of height x width x 3, masks are boolean arrays of height x width. A kernel sees one image, whose
size the caller bounds; nothing here looks across rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quire.session import shipped

# Weights of the Rec. 601 luma, and the sRGB to XYZ matrix under D65 with its white point.
LUMA = np.array([0.299, 0.587, 0.114])
TO_XYZ = np.array([[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]])
WHITE = np.array([0.95047, 1.0, 1.08883])


def per_image(rows: DataFrame, kernel: Callable[[pd.Series], dict], schema: str) -> DataFrame:
    """One row out for each row in, by a kernel of the row."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([kernel(r) for _, r in batch.iterrows()], columns=columns)

    return shipped(rows).mapInPandas(apply, schema)


def image_of(data: bytes, height: int, width: int) -> np.ndarray:
    """Image from raw bytes of three channels."""
    return np.frombuffer(data, "uint8").reshape(height, width, 3)


def grey(image: np.ndarray) -> np.ndarray:
    """Luma."""
    return image.astype("float64") @ LUMA


def lab(image: np.ndarray) -> np.ndarray:
    """CIE Lab of an sRGB image."""
    c = image / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = linear @ TO_XYZ.T / WHITE
    f = np.where(t > (6 / 29) ** 3, np.cbrt(t), t / (3 * (6 / 29) ** 2) + 4 / 29)
    return np.stack([116 * f[..., 1] - 16, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def encode_runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the runs of true values in row order."""
    flat = np.concatenate([[0], mask.ravel().astype("int8"), [0]])
    edges = np.flatnonzero(np.diff(flat))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist()))


def decode_runs(runs: Sequence[tuple[int, int]], shape: tuple[int, int]) -> np.ndarray:
    """The mask of runs; runs beyond the shape raise."""
    flat = np.zeros(shape[0] * shape[1], bool)
    for start, length in runs:
        if start < 0 or length < 0 or start + length > flat.size:
            raise ValueError("run outside the mask")
        flat[start : start + length] = True
    return flat.reshape(shape)


def alternating_counts(mask: np.ndarray) -> tuple[int, list[int]]:
    """First value and lengths of the alternating runs of a mask."""
    flat = mask.ravel().astype("int8")
    if not flat.size:
        return 0, []
    edges = np.concatenate([[0], np.flatnonzero(np.diff(flat)) + 1, [flat.size]])
    return int(flat[0]), np.diff(edges).tolist()


def compose(members: Sequence[tuple[str, np.ndarray, np.ndarray]], base: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    """Members (id, mask, pixels) written over a base in order, the last writer winning; image, union mask and fingerprint."""
    out, union, digest = base.copy(), np.zeros(base.shape[:2], bool), hashlib.sha256()
    for name, mask, pixels in members:
        out[mask] = pixels[mask]
        union |= mask
        digest.update(name.encode() + b"\0" + np.packbits(mask).tobytes())
    digest.update(out.tobytes())
    return out, union, digest.hexdigest()


def grow(mask: np.ndarray, steps: int) -> np.ndarray:
    """A mask grown by a square of 2 * steps + 1."""
    out = mask
    for axis in (0, 1):
        padded = np.pad(out, [(steps, steps) if a == axis else (0, 0) for a in (0, 1)])
        out = np.lib.stride_tricks.sliding_window_view(padded, 2 * steps + 1, axis).any(-1)
    return out


def border_fill(image: np.ndarray, mask: np.ndarray, width: int = 3) -> np.ndarray:
    """The mask filled with the median colour of a ring around it; an image without a ring stays as it is."""
    ring = grow(mask, width) & ~mask
    out = image.copy()
    if ring.any():
        out[mask] = np.median(image[ring], axis=0).astype("uint8")
    return out


def diffuse_fill(image: np.ndarray, mask: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The mask filled by diffusion from its border (repeated means of the four neighbours)."""
    out = image.astype("float64")
    out[mask] = np.median(image[~mask], axis=0) if (~mask).any() else 0
    for _ in range(rounds):
        p = np.pad(out, ((1, 1), (1, 1), (0, 0)), mode="edge")
        out[mask] = ((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4)[mask]
    return np.rint(out).astype("uint8")


def gradient(tone: np.ndarray) -> np.ndarray:
    """Sobel magnitude with repeated edges."""
    p = np.pad(tone.astype("float64"), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return np.hypot(gx, gy)


# The budget of a flooding, in pixels and queue entries.
MOST_PIXELS, MOST_ENTRIES = 262_144, 500_000


def watershed(height: np.ndarray, seeds: np.ndarray, most_pixels: int = MOST_PIXELS, most_entries: int = MOST_ENTRIES) -> np.ndarray | None:
    """Labels by flooding from the positive seeds in order of height, first come first; null past a budget of pixels or queue entries."""
    if height.size > most_pixels:
        return None
    labels = seeds.copy()
    h, w = height.shape
    queue: list[tuple[float, int, int, int]] = []
    count = 0
    for y, x in zip(*np.nonzero(seeds > 0)):
        heapq.heappush(queue, (float(height[y, x]), count, int(y), int(x)))
        count += 1
    while queue:
        level, _, y, x = heapq.heappop(queue)
        for ny, nx in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= ny < h and 0 <= nx < w and labels[ny, nx] == 0:
                labels[ny, nx] = labels[y, x]
                count += 1
                if count > most_entries:
                    return None
                heapq.heappush(queue, (max(level, float(height[ny, nx])), count, ny, nx))
    return labels


def label_areas(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Four-connected areas of a mask, numbered from 1 in row order."""
    labels, n = np.zeros(mask.shape, "int32"), 0
    for y, x in zip(*np.nonzero(mask)):
        if labels[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        labels[y, x] = n
        while stack:
            cy, cx = stack.pop()
            for ny, nx in ((cy - 1, cx), (cy + 1, cx), (cy, cx - 1), (cy, cx + 1)):
                if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and not labels[ny, nx]:
                    labels[ny, nx] = n
                    stack.append((ny, nx))
    return labels, n


def difference_boxes(a: np.ndarray, b: np.ndarray, limit: float = 24, least: int = 16, join: int = 2) -> list[tuple[int, int, int, int, int]]:
    """Boxes (x, y, width, height, pixels) of the areas where two images differ, near ones joined, small ones left out."""
    mask = np.abs(grey(a) - grey(b)) > limit
    labels, n = label_areas(grow(mask, join))
    out = []
    for i in range(1, n + 1):
        ys, xs = np.nonzero((labels == i) & mask)
        if len(ys) >= least:
            out.append((int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1, len(ys)))
    return out


def perceptual_hash(image: np.ndarray, size: int = 32, keep: int = 8) -> str:
    """64 bits, as hex: low DCT coefficients of the shrunken luma against the median of those outside the first row and column."""
    tone = grey(image)
    rows, cols = (np.minimum(np.arange(size) * n // size, n - 1) for n in tone.shape)
    rows_to, cols_to = (np.maximum((np.arange(size) + 1) * n // size, f + 1) for n, f in zip(tone.shape, (rows, cols)))
    total = np.pad(tone.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    box = total[np.ix_(rows_to, cols_to)] - total[np.ix_(rows, cols_to)] - total[np.ix_(rows_to, cols)] + total[np.ix_(rows, cols)]
    small = box / np.outer(rows_to - rows, cols_to - cols)
    k = np.arange(size)
    basis = np.cos(np.pi * np.outer(k, 2 * k + 1) / (2 * size))
    low = (basis @ small @ basis.T)[:keep, :keep] * np.outer(*[np.where(k[:keep] == 0, np.sqrt(1 / size), np.sqrt(2 / size))] * 2)
    bits = (low > np.median(low[1:, 1:])).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):0{keep * keep // 4}x}"


def quality(image: np.ndarray) -> dict[str, float | str]:
    """Mean, spread, sharpness (variance of the Laplacian), edge share and kind (grey or colour) of a page."""
    tone = grey(image)
    p = np.pad(tone, 1, mode="edge")
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * tone
    spread = image.astype("int16").max(-1) - image.astype("int16").min(-1)
    return {"mean": float(tone.mean()), "contrast": float(tone.std()), "sharpness": float(laplacian.var()), "edges": float((gradient(tone) > 100).mean()), "kind": "colour" if (spread > 16).mean() > 0.02 else "grey"}


def region_class(image: np.ndarray, mask: np.ndarray) -> str:
    """``plain``, ``toned`` or ``textured`` by the tones around a mask."""
    ring = grow(mask, 6) & ~mask
    if not ring.any():
        return "unknown"
    tone = grey(image)
    spread, edges = tone[ring].std(), (gradient(tone)[ring] > 100).mean()
    return "plain" if spread < 8 and edges < 0.05 else "toned" if edges < 0.2 else "textured"


def tolerance_scores(truth: np.ndarray, found: np.ndarray, tolerance: int = 2) -> dict[str, float | None]:
    """IoU, and precision and recall with a tolerance in pixels; null where nothing was found or true."""
    both, either = (truth & found).sum(), (truth | found).sum()
    near_truth, near_found = grow(truth, tolerance), grow(found, tolerance)
    return {
        "iou": float(both / either) if either else None,
        "precision": float((found & near_truth).sum() / found.sum()) if found.any() else None,
        "recall": float((truth & near_found).sum() / truth.sum()) if truth.any() else None,
    }
