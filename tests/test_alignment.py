import numpy as np
import pytest

from quire.operators import alignment as al

RNG = np.random.default_rng(2)


def page(h=140, w=180):
    out = np.full((h, w, 3), 245, "uint8")
    for _ in range(40):
        y, x = RNG.integers(0, h - 20), RNG.integers(0, w - 20)
        out[y : y + RNG.integers(3, 18), x : x + RNG.integers(3, 18)] = RNG.integers(0, 255)
    return out


@pytest.mark.parametrize("angle,scale,shift", [(0.0, 1.0, (7.0, -5.0)), (0.05, 1.03, (-4.0, 6.0))])
def test_a_moved_page_is_found_again(angle, scale, shift):
    first = page()
    c, s = scale * np.cos(angle), scale * np.sin(angle)
    truth = np.array([[c, -s, shift[0]], [s, c, shift[1]]])
    second = al.warp(first, truth, first.shape[:2])  # first -> second
    found = al.register(first, second)
    assert found.quality in ("high", "medium") and found.n_inliers >= 8 and found.residual < 3
    points = np.array([[30.0, 40.0], [120.0, 90.0]])
    assert al.apply(found.matrix, al.apply(truth, points)) == pytest.approx(points, abs=1.5)


def test_pages_that_tell_nothing():
    blank = np.full((60, 60, 3), 255, "uint8")
    assert al.register(blank, blank).quality == "unresolved" and al.register(blank[:10], blank).matrix is None
    assert al.similarity(np.ones((3, 2)), np.ones((3, 2))) is None


def test_warp_and_similarity():
    image = page(40, 60)
    same = np.array([[1.0, 0, 0], [0, 1.0, 0]])
    assert (al.warp(image, same, (40, 60)) == image).all()
    moved = al.warp(image, np.array([[1.0, 0, 3], [0, 1.0, 2]]), (40, 60))
    assert (moved[2:, 3:] == image[:-2, :-3]).all() and (moved[:2, 3:] == image[:1, :-3]).all()
    points = RNG.random((9, 2)) * 50
    turn = np.array([[0.8, -0.6, 2], [0.6, 0.8, -7]])
    assert al.similarity(points, al.apply(turn, points)) == pytest.approx(turn)


def test_filling_by_marching():
    ramp = np.repeat(np.tile(np.arange(40, dtype="uint8") * 5, (30, 1))[..., None], 3, 2)
    hole = np.zeros((30, 40), bool)
    hole[10:16, 15:22] = True
    spoilt = ramp.copy()
    spoilt[hole] = 255
    filled = al.march_fill(spoilt, hole)
    assert (filled[~hole] == ramp[~hole]).all() and np.abs(filled[hole].astype(int) - ramp[hole]).max() <= 12
    flat = np.full((9, 9, 3), 77, "uint8")
    assert (al.march_fill(flat, np.eye(9, dtype=bool)) == 77).all() and (al.march_fill(flat, np.ones((9, 9), bool)) == flat).all()
