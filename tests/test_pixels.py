from itertools import permutations

import numpy as np
import pytest

from quire.operators import pixels as px

RNG = np.random.default_rng(5)


def page(h=40, w=60):
    return np.full((h, w, 3), 240, "uint8")


def box(h, w, y, x, dy, dx):
    m = np.zeros((h, w), bool)
    m[y : y + dy, x : x + dx] = True
    return m


def test_runs_round_trip():
    for shape in ((0, 0), (1, 1), (7, 9)):
        m = RNG.random(shape) < 0.5
        assert (px.decode_runs(px.encode_runs(m), shape) == m).all()
        first, counts = px.alternating_counts(m)
        assert (np.repeat([(first + i) % 2 for i in range(len(counts))], counts).astype(bool) == m.ravel()).all()
    with pytest.raises(ValueError):
        px.decode_runs([(3, 5)], (2, 3))


def test_cleaning():
    base, ink, area = page(), page(), box(40, 60, 10, 10, 8, 20)
    ink[box(40, 60, 12, 12, 3, 10)] = 0
    assert (px.diffuse_fill(ink, area) == base).all() and (px.border_fill(ink, np.ones((40, 60), bool)) == ink).all()
    members = [("a", area, page() * 0), ("b", box(40, 60, 12, 12, 2, 2), page())]
    out, union, print_a = px.compose(members, base)
    assert (out[12:14, 12:14] == 240).all() and (out[10, 10] == 0).all() and union.sum() == 160
    assert px.compose(members[::-1], base)[2] != print_a == px.compose(members, base)[2]


def test_lab_and_gradient():
    assert px.lab(np.array([[[255, 255, 255], [0, 0, 0], [255, 0, 0]]], "uint8"))[0] == pytest.approx(np.array([[100, 0, 0], [0, 0, 0], [53.24, 80.09, 67.2]]), abs=0.1)
    ramp = np.tile(np.arange(10.0), (5, 1))
    assert (px.gradient(ramp)[1:-1, 1:-1] == 8).all() and (px.gradient(np.ones((3, 3))) == 0).all()


def test_watershed_and_budget():
    height = np.zeros((5, 11))
    height[:, 5] = 9
    seeds = np.zeros((5, 11), int)
    seeds[2, 1], seeds[2, 9] = 1, 2
    labels = px.watershed(height, seeds)
    assert (labels[:, :5] == 1).all() and (labels[:, 6:] == 2).all() and (labels > 0).all()
    assert px.watershed(height, seeds, most_pixels=10) is None and px.watershed(height, seeds, most_entries=20) is None


def test_differences_and_hash():
    a, b = page(), page()
    b[box(40, 60, 5, 7, 6, 9)] = 0
    b[30, 50] = 0
    assert px.difference_boxes(a, b) == [(7, 5, 9, 6, 54)]
    picture = (RNG.random((64, 96, 3)) * 255).astype("uint8")
    h = px.perceptual_hash(picture)
    assert len(h) == 16 and px.perceptual_hash(np.repeat(np.repeat(picture, 2, 0), 2, 1)) == h
    assert px.label_areas(np.array([[1, 0, 1], [1, 0, 0], [0, 0, 1]], bool))[1] == 3


def test_quality_and_scores():
    assert px.quality(page())["kind"] == "grey" and px.quality(page())["contrast"] == pytest.approx(0)
    assert px.region_class(page(), box(40, 60, 10, 10, 5, 5)) == "plain" and px.region_class((RNG.random((40, 60, 3)) * 255).astype("uint8"), box(40, 60, 10, 10, 5, 5)) == "textured"
    truth, found = box(20, 20, 5, 5, 6, 6), box(20, 20, 6, 6, 6, 6)
    assert px.tolerance_scores(truth, found, 1) == {"iou": 25 / 47, "precision": 1.0, "recall": 1.0}
    assert px.tolerance_scores(truth, truth & False) == {"iou": 0.0, "precision": None, "recall": 0.0}


def test_per_image(spark):
    rows = spark.createDataFrame([(1, page().tobytes(), 40, 60)], "id int, data binary, h int, w int")
    got = px.per_image(rows, lambda r: {"id": r["id"], "hash": px.perceptual_hash(px.image_of(r["data"], r["h"], r["w"]))}, "id int, hash string")
    assert got.first()["hash"] == px.perceptual_hash(page())
