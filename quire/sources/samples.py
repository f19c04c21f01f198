"""A small synthetic set of pages: pictures as raw bytes with the boxes of what was drawn on them, the same at every run."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

PAGES = ("plain", "toned", "two_bubbles", "no_text")
SCHEMA = "page_id string, kind string, height int, width int, pixels binary, sha256 string, boxes array<struct<x: int, y: int, width: int, height: int>>"


def draw_page(kind: str, height: int = 96, width: int = 128) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """A picture and the boxes of its text: bubbles with dark outlines on paper, text as dark bars."""
    out = np.full((height, width, 3), 235 if kind != "toned" else 150, "uint8")
    if kind == "toned":
        out[::2, ::2] = 120
    bubbles = {"no_text": [], "two_bubbles": [(6, 8, 50, 60), (68, 20, 54, 66)]}.get(kind, [(20, 12, 80, 70)])
    boxes = []
    for x, y, w, h in bubbles:
        out[y : y + h, x : x + w] = 0
        out[y + 2 : y + h - 2, x + 2 : x + w - 2] = 255
        bx, by, bw, bh = x + w // 4, y + h // 4, w // 2, h // 2
        for k in range(0, bh, 6):
            out[by + k : by + k + 3, bx : bx + bw] = 10
        boxes.append((bx, by, bw, bh))
    return out, boxes


def sample_pages(spark: SparkSession) -> DataFrame:
    """Rows of ``SCHEMA``, one for each kind of page."""
    rows = []
    for i, kind in enumerate(PAGES):
        image, boxes = draw_page(kind)
        data = image.tobytes()
        rows.append((f"sample-{i + 1:03d}", kind, *image.shape[:2], data, hashlib.sha256(data).hexdigest(), boxes))
    return spark.createDataFrame(rows, SCHEMA)
