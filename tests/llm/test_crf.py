from itertools import product

import numpy as np

from quire.llm import crf


def brute(f, x):
    scores = {}
    for path in product(range(len(f.first)), repeat=len(x)):
        s = f.first[path[0]] + f.last[path[-1]] + sum(f.emit[y] @ v for y, v in zip(path, x))
        scores[path] = s + sum(f.step[a, b] for a, b in zip(path, path[1:]))
    return scores


def field(rng, k=3, w=4):
    return crf.Field(rng.normal(size=(k, w)), rng.normal(size=(k, k)), rng.normal(size=k), rng.normal(size=k))


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for t in (1, 2, 5):
        f, x = field(rng), rng.normal(size=(t, 4))
        scores = brute(f, x)
        assert tuple(crf.decode(f, x)) == max(scores, key=scores.get)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    f, x, y = field(rng), rng.normal(size=(2, 3, 4)), rng.integers(0, 3, (2, 3))
    value, grad = crf._batch_gradient(f, x, y)
    want = sum(brute(f, a)[tuple(b)] - np.log(sum(np.exp(s) for s in brute(f, a).values())) for a, b in zip(x, y))
    assert np.isclose(value, want)
    for part, g in zip(range(4), grad):
        for at in list(np.ndindex(g.shape))[:6]:
            moved = [p.copy() for p in f]
            moved[part][at] += 1e-6
            assert np.isclose((crf._batch_gradient(crf.Field(*moved), x, y)[0] - value) / 1e-6, g[at], atol=1e-4)


def test_fit_learns_order():
    rng = np.random.default_rng(2)
    data = []
    for _ in range(200):
        y = np.array([0, 1, 2, 1][: rng.integers(2, 5)])
        data.append((np.column_stack([np.ones(len(y)), rng.normal(size=len(y)) + (y == 2)]), y))
    f = crf.fit(data, 3)
    assert np.mean([(crf.decode(f, x) == y).mean() for x, y in data]) > 0.95
