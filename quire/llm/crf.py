"""A linear-chain conditional random field over dense features, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Field(NamedTuple):
    """Weights of a fitted field: labels x features, label x next label, first and last label."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _batch_gradient(f: Field, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Log-likelihood and its gradient for sequences of one length: x is (n, t, features), y is (n, t)."""
    n, t, _ = x.shape
    k = len(f.first)
    score = x @ f.emit.T
    ahead = np.empty((t, n, k))
    ahead[0] = f.first + score[:, 0]
    for i in range(1, t):
        ahead[i] = _log_sum(ahead[i - 1][:, :, None] + f.step, 1) + score[:, i]
    back = np.empty((t, n, k))
    back[t - 1] = f.last
    for i in range(t - 2, -1, -1):
        back[i] = _log_sum(f.step + (score[:, i + 1] + back[i + 1])[:, None, :], 2)
    total = _log_sum(ahead[t - 1] + f.last, 1)
    rows = np.arange(n)
    truth = f.first[y[:, 0]] + f.last[y[:, -1]] + score[rows[:, None], np.arange(t), y].sum(1)
    one = np.eye(k)[y]
    chance = np.exp(ahead + back - total[None, :, None]).transpose(1, 0, 2)
    step = np.zeros((k, k))
    for i in range(1, t):
        truth = truth + f.step[y[:, i - 1], y[:, i]]
        pair = np.exp(ahead[i - 1][:, :, None] + f.step + (score[:, i] + back[i])[:, None, :] - total[:, None, None])
        step += one[:, i - 1].T @ one[:, i] - pair.sum(0)
    emit = (one - chance).reshape(n * t, k).T @ x.reshape(n * t, -1)
    return float((truth - total).sum()), [emit, step, (one - chance)[:, 0].sum(0), (one - chance)[:, -1].sum(0)]


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], n_labels: int, rounds: int = 150, rate: float = 0.2, ridge: float = 1e-4) -> Field:
    """Weights that maximise the penalised likelihood of (features, labels) sequences, by Adam over whole passes; deterministic."""
    width = sequences[0][0].shape[1]
    weights = [np.zeros((n_labels, width)), np.zeros((n_labels, n_labels)), np.zeros(n_labels), np.zeros(n_labels)]
    by_length: dict[int, list] = {}
    for x, y in sequences:
        by_length.setdefault(len(y), []).append((x, y))
    batches = [(np.stack([x for x, _ in s]), np.stack([y for _, y in s])) for _, s in sorted(by_length.items())]
    count = sum(y.size for _, y in batches)
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for i in range(1, rounds + 1):
        grad = [-ridge * w for w in weights]
        for x, y in batches:
            for g, part in zip(grad, _batch_gradient(Field(*weights), x, y)[1]):
                g += part / count
        for j, g in enumerate(grad):
            mean[j] = 0.9 * mean[j] + 0.1 * g
            square[j] = 0.999 * square[j] + 0.001 * g * g
            weights[j] = weights[j] + rate * (mean[j] / (1 - 0.9**i)) / (np.sqrt(square[j] / (1 - 0.999**i)) + 1e-8)
    return Field(*weights)


def decode(f: Field, x: np.ndarray) -> np.ndarray:
    """Most probable labels of one sequence of features (Viterbi)."""
    score = x @ f.emit.T
    best, came = f.first + score[0], []
    for row in score[1:]:
        options = best[:, None] + f.step
        came.append(options.argmax(0))
        best = options.max(0) + row
    path = [int((best + f.last).argmax())]
    for back in reversed(came):
        path.append(int(back[path[-1]]))
    return np.array(path[::-1])


def decode_many(f: Field, x: np.ndarray, sequence: np.ndarray) -> np.ndarray:
    """Most probable labels of many sequences: the features of all steps, and the sequence of each, in order.

    Sequences of one length are decoded together.
    """
    if not len(x):
        return np.zeros(0, "int64")
    score = x @ f.emit.T
    starts = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
    lengths = np.diff(np.append(starts, len(x)))
    out = np.zeros(len(x), "int64")
    for t in np.unique(lengths):
        at = starts[lengths == t]
        best = f.first + score[at]
        came = np.zeros((t, *best.shape), "int8")
        for i in range(1, t):
            options = best[:, :, None] + f.step
            came[i] = options.argmax(1)
            best = options.max(1) + score[at + i]
        label = (best + f.last).argmax(1)
        for i in range(t - 1, -1, -1):
            out[at + i] = label
            label = came[i][np.arange(len(at)), label]
    return out
