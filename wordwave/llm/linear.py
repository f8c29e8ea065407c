"""A logistic model on sparse hashed features, trained on posterior labels."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int], target: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise weighted log loss + l2/2 |w|^2, by accelerated gradient steps.

    ``target`` may be soft (probabilities).  Deterministic.
    """
    n, d = shape
    weight = np.ones(n) if weight is None else weight
    total = weight.sum()
    norms = np.bincount(rows, weights=values**2, minlength=n) + 1
    step = 1.0 / (0.25 * float((norms * weight).max()) * min(n, 60) + l2)
    w, b = np.zeros(d), float(np.log(max((target * weight).sum(), 1e-9) / max(((1 - target) * weight).sum(), 1e-9)))
    scale = np.bincount(columns, weights=values**2 * weight[rows] * 0.25, minlength=d) + l2  # diagonal of the curvature
    spread = np.bincount(rows, weights=np.abs(values), minlength=n).max() + 1
    vw, vb, prev_w, prev_b = w.copy(), b, w.copy(), b
    step = 1.0 / min(spread, 50)
    for k in range(rounds):
        z = np.bincount(rows, weights=values * vw[columns], minlength=n) + vb
        error = (sigmoid(z) - target) * weight
        gw = np.bincount(columns, weights=values * error[rows], minlength=d) + l2 * vw
        w, b = vw - step * gw / scale, vb - step * error.sum() / (0.25 * total + 1e-9)
        momentum = k / (k + 3.0)
        vw, vb = w + momentum * (w - prev_w), b + momentum * (b - prev_b)
        prev_w, prev_b = w, b
    return w, float(b)


def label_model(votes: np.ndarray, polarity: np.ndarray, prior: float, start: float = 0.85, strength: float = 8.0, rounds: int = 100, alike: float = 0.6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the hidden label from voters that vote or abstain, by expectation-maximisation.

    ``votes`` is a boolean matrix rows x voters, ``polarity`` 1 for a voter that
    votes for the label and 0 for one against it.  A voter has two rates, at
    which it votes where the label holds and where it does not; they begin as
    those of a voter that is right at a rate of ``start``, which keeps the weight
    of ``strength`` rows, and follow the posteriors, as the label's share does from
    ``prior`` on.  Voters that vote together beyond what the labels explain
    (residual correlation of ``alike`` or more) divide their say by one plus the
    summed correlations.  Returns posteriors, accuracies (how often a vote is
    right) and shares of say.  No rows give empty posteriors; a row without
    votes is judged by that.
    """
    v = votes.astype(np.float64)
    n, m = v.shape
    fired, say = v.sum(axis=0), np.ones(m)
    if not n:
        return np.zeros(0), np.full(m, start), say
    right = np.where(polarity == 1, start, 1 - start)
    rate = (fired + 1) / (n + 2)
    first = [np.clip(rate * p, 1e-4, 0.95) for p in (right / prior, (1 - right) / (1 - prior))]
    one, zero = first
    post, share = np.full(n, prior), prior
    for k in range(rounds):
        new = sigmoid(np.log(share / (1 - share)) + v @ (np.log(one / zero) * say) + (1 - v) @ (np.log((1 - one) / (1 - zero)) * say))
        change, post = np.abs(new - post).max(), new
        share = float(np.clip(post.mean(), 0.01, 0.6))
        one, zero = (np.clip((w @ v + strength * f) / (w.sum() + strength), 1e-4, 0.99) for w, f in ((post, first[0]), (1 - post, first[1])))
        if k in (0, 5, 15):  # correlations that the labels leave unexplained
            rest = v - post[:, None] * one - (1 - post)[:, None] * zero
            sd = np.sqrt((rest**2).mean(axis=0)) + 1e-9
            corr = (rest.T @ rest) / n / np.outer(sd, sd)
            np.fill_diagonal(corr, 0)
            corr[corr < alike] = 0
            say = 1.0 / (1.0 + corr.sum(axis=0))
        if change < 1e-6 and k > 15:
            break
    accuracy = np.where(polarity == 1, post @ v, (1 - post) @ v) / np.maximum(fired, 1)
    return post, accuracy, say


def calibrate(z: np.ndarray, target: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Scale (positive) and shift of logits ``z`` that fit 0/1 targets best, by Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * z + b)
        g = np.array([((p - target) * z).sum() + 0.01 * (a - 1), (p - target).sum() + 0.01 * b])
        w = p * (1 - p)
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = max(a - float(np.clip(step[0], -1, 1)), 0.05), b - float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-7:
            break
    return a, b
