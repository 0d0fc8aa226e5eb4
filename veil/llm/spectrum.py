"""Eigenvalues and eigenvectors of a growing sum of outer products, one rank-one update at a time."""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)


def empty(d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(d), np.eye(d)


def _runs(values: np.ndarray, near: float) -> list[tuple[int, int]]:
    """Stretches of ascending ``values`` that lie within ``near`` of their first one, if longer than one."""
    out, first = [], 0
    close = np.flatnonzero(np.diff(values) <= near)
    while len(close):
        first = int(close[0])
        end = int(np.searchsorted(values, values[first] + near, side="right"))
        out.append((first, max(end, first + 2)))
        close = close[close >= out[-1][1]]
    return out


def _roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - x), one above each of the ascending ``d``: as distances d_j - x_i, row i, and x."""
    m = len(d)
    if m == 1:
        return -z2[None, :], d + z2
    upper = np.append(d[1:], d[-1] + z2.sum())
    middle = (d + upper) / 2
    left = 1 + (z2[None, :] / (d[None, :] - middle[:, None])).sum(axis=1) >= 0
    left[-1] = True  # nothing lies above the last one
    origin = np.where(left, d, upper)
    shifted = d[None, :] - origin[:, None]
    half = (upper - d) / 2
    low, high = np.where(left, 0.0, -half), np.where(left, half, 0.0)
    high[-1] = upper[-1] - d[-1]
    x = (low + high) / 2
    below = np.arange(m)[None, :] <= np.arange(m)[:, None]
    near = np.arange(m)
    for _ in range(80):
        gap = shifted - x[:, None]
        gap[gap == 0] = np.finfo(np.float64).tiny
        terms = z2[None, :] / gap
        f = 1 + terms.sum(axis=1)
        high, low = np.where(f >= 0, x, high), np.where(f >= 0, low, x)
        done = (np.abs(f) <= 4 * EPS * (1 + np.abs(terms).sum(axis=1))) | (high - low <= 2 * EPS * np.abs(x))
        if done.all():
            break
        slopes = terms / gap
        psi = np.where(below, slopes, 0.0).sum(axis=1)
        phi = slopes.sum(axis=1) - psi
        one, two = gap[near, near], gap[near, np.minimum(near + 1, m - 1)]
        with np.errstate(all="ignore"):
            # The two nearest poles keep their slopes; what is left is taken for constant.
            c = f - one * psi - two * phi
            a = (one + two) * f - one * two * (psi + phi)
            b = one * two * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            constant = f[-1] - one[-1] * psi[-1]
            move[-1] = one[-1] + one[-1] ** 2 * psi[-1] / constant
        x_new = x + move
        inside = np.isfinite(x_new) & (x_new > low) & (x_new < high)
        x = np.where(done, x, np.where(inside, x_new, (low + high) / 2))
    gap = shifted - x[:, None]
    gap[gap == 0] = np.finfo(np.float64).tiny
    return gap, origin + x


def add_outer(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of (vectors diag(values) vectors') + v v'. ``values`` ascend; ``vectors`` are columns."""
    z = vectors.T @ v
    size = float(z @ z)
    if size == 0:
        return values, vectors
    near = 8 * EPS * max(float(values[-1]), size)
    values, vectors = values.copy(), vectors.copy()
    z[np.abs(z) * np.sqrt(size) <= near] = 0.0  # these directions stay
    live = np.flatnonzero(z)
    if not len(live):
        return values, vectors
    for first, end in _runs(values[live], near):
        # Within an eigenspace the basis is free: turn it so that one direction holds all of v.
        run = live[first:end]
        w = z[run].copy()
        whole = float(np.sqrt(w @ w))
        turned = -whole if w[-1] > 0 else whole
        w[-1] -= turned
        w /= np.sqrt(w @ w)
        vectors[:, run] -= 2 * np.outer(vectors[:, run] @ w, w)
        z[run] = 0.0
        z[run[-1]] = turned
    live = np.flatnonzero(z)
    d, part = values[live], z[live]
    gap, roots = _roots(d, part * part)
    m = len(d)
    if m > 1:
        # The weights for which these roots are exact; with them the vectors are orthogonal.
        between = d[:, None] - d[None, :]
        under = np.empty((m, m))
        under[:-1] = np.where(np.arange(m)[None, :] > np.arange(m - 1)[:, None], between[:-1], between[1:])
        under[-1] = 1.0
        np.negative(under[:-1], out=under[:-1])
        exact = np.sqrt(np.abs(np.prod(gap / under, axis=0)))
        part = np.where(part < 0, -exact, exact)
    turn = part[:, None] / gap.T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    vectors[:, live] = vectors[:, live] @ turn
    values[live] = roots
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def add_spectrum(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of the sum of two matrices given by theirs."""
    values, vectors = one
    for value, vector in zip(other[0], other[1].T):
        if value > 0:
            values, vectors = add_outer(values, vectors, np.sqrt(value) * vector)
    return values, vectors
