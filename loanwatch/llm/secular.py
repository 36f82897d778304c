"""Rank-one updates of symmetric eigendecompositions, many at a time.

A spectrum is ``values`` (ascending) and ``vectors`` (in columns) of a matrix M.
The spectrum of M + rho * v * v' follows from z = vectors' * v: its values are the
roots of the secular equation 1 + rho * sum(z_i**2 / (d_i - x)), one between each
two neighbouring old values, and its vectors are the old ones times a matrix
with columns z_i / (d_i - x).

Deflation: a component of z that is nothing beside the matrix leaves its value and
vector as they are; of two equal values one is rotated out of z. The
roots are kept as distances from the nearer pole, and the vectors are made from
the z that these roots belong to exactly (Loewner's formula), so that they are
orthogonal however close two values lie.

Arrays have a leading axis: spectra that take one update each, side by side.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
#: Rounds after which a root is taken as it is; halving alone needs about so many.
ROUNDS = 80


def _rotate_equal(d: np.ndarray, vectors: np.ndarray, z: np.ndarray, tol: np.ndarray) -> None:
    """Of neighbouring equal values that z both touches, turn the first out of z; changes its arguments."""
    last = np.full(len(d), -1)                  # the last touched value so far
    lane = np.arange(len(d))
    for i in range(d.shape[1]):
        here = z[:, i] != 0
        a = np.maximum(last, 0)
        near = np.flatnonzero(here & (last >= 0) & (d[:, i] - d[lane, a] <= tol))
        if len(near):
            p = a[near]
            r = np.hypot(z[near, p], z[near, i])
            c, s = z[near, i] / r, z[near, p] / r
            z[near, i], z[near, p] = r, 0
            left, right = vectors[near, :, p], vectors[near, :, i]
            vectors[near, :, p] = c[:, None] * left - s[:, None] * right
            vectors[near, :, i] = s[:, None] * left + c[:, None] * right
            low, high = d[near, p], d[near, i]
            d[near, p], d[near, i] = c * c * low + s * s * high, s * s * low + c * c * high
        last = np.where(here, i, last)


def _roots(d: np.ndarray, w: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum_j w_j / (d_j - x), and the distances d_j - x_i as [lane, i, j] without cancellation.

    ``w`` is rho * z**2. Of values that are not active the root is the value
    itself; their distances are of no use.
    """
    k, n = d.shape
    upper = np.where(active, d, np.inf)
    upper = np.minimum.accumulate(upper[:, ::-1], axis=1)[:, ::-1]
    upper = np.concatenate([upper[:, 1:], np.full((k, 1), np.inf)], axis=1)           # the next active value
    final = np.isinf(upper)
    upper = np.where(final, d + w.sum(axis=1, keepdims=True), upper)

    # One row for each root from here on; values that are not active are poles at infinity.
    lane, at = np.nonzero(active)
    poles, w = np.where(active, d, np.inf)[lane], w[lane]
    left = (np.arange(n) <= at[:, None]).astype(np.float64)            # poles up to the root's own
    own, upper, final = d[lane, at], upper[lane, at], final[lane, at]
    half = (upper - own) / 2
    right = (1 + (w / (poles - own[:, None] - half[:, None])).sum(axis=1) < 0) & ~final
    origin = np.where(right, upper, own)                               # the nearer pole
    low, high = np.where(right, -half, 0.0), np.where(right, 0.0, np.where(final, 2 * half, half))
    x, base = (low + high) / 2, poles - origin[:, None]
    own, upper = own - origin, upper - origin

    rows = np.arange(len(lane))
    for _ in range(ROUNDS):
        at_x, side = x[rows], left[rows]
        delta = base[rows] - at_x[:, None]
        t = w[rows] / delta
        slope = t / delta
        f = 1 + t.sum(axis=1)
        size = f - 2 * np.einsum("ij,ij->i", t, side)                  # the sum of all terms' sizes
        lo, hi = low[rows], high[rows]
        going = (np.abs(f) > 2 * EPS * n * size) & (hi - lo > 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if not going.any():
            break
        lo, hi = np.where(f < 0, at_x, lo), np.where(f < 0, hi, at_x)
        # Fit a constant and the two poles beside the root to value and slopes; the next x is that function's root.
        last, near, far = final[rows], own[rows] - at_x, upper[rows] - at_x
        psi = np.where(last, slope.sum(axis=1), np.einsum("ij,ij->i", slope, side))
        phi = np.where(last, 0.0, slope.sum(axis=1) - psi)
        c = f - near * psi - np.where(last, 0.0, far * phi)
        a, b = (near + far) * f - near * far * (psi + phi), near * far * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            new = at_x + np.where(last, near + near * near * psi / c, np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root)))
        new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
        x[rows], low[rows], high[rows] = np.where(going, new, at_x), lo, hi
        rows = rows[going]
    roots, delta = d.copy(), np.ones((k, n, n))
    roots[lane, at] = origin + x
    delta[lane, at] = base - x[:, None]
    return roots, delta


def update(values: np.ndarray, vectors: np.ndarray, rho: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of M + rho * v * v' for lanes of spectra: values [lane, n], vectors [lane, n, n], rho [lane] >= 0, v [lane, n]."""
    d = values.copy()
    z = np.matmul(v[:, None, :], vectors)[:, 0, :] * np.sqrt(rho)[:, None]
    norm = np.sqrt((z * z).sum(axis=1))
    tol = 8 * EPS * np.maximum(np.abs(d).max(axis=1), norm * norm)
    z[np.abs(z) * norm[:, None] <= tol[:, None]] = 0
    if (np.diff(d, axis=1) <= tol[:, None]).any():
        vectors = vectors.copy()
        _rotate_equal(d, vectors, z, tol)
    active = z != 0
    if not active.any():
        return d, vectors
    x, delta = _roots(d, z * z, active)

    # The z that the roots belong to: z_j**2 = prod_i (x_i - d_j) / prod_{i != j} (d_i - d_j), over active i.
    n = d.shape[1]
    both = active[:, :, None] & active[:, None, :]
    between = d[:, :, None] - d[:, None, :]                             # [lane, i, j] = d_i - d_j
    own = np.eye(n, dtype=bool)[None]
    ratio = np.where(both & ~own, -delta / np.where(both & ~own, between, 1.0), 1.0)
    exact = np.sqrt(np.abs(ratio.prod(axis=1) * np.where(active, -np.diagonal(delta, axis1=1, axis2=2), 0.0)))
    exact = np.copysign(exact, z)
    turn = np.where(both, exact[:, None, :] / np.where(both & (delta != 0), delta, 1.0), 0.0)
    length = np.sqrt((turn * turn).sum(axis=2, keepdims=True))
    turn = np.where(active[:, :, None], turn / np.where(length > 0, length, 1.0), own)
    order = np.argsort(x, axis=1, kind="stable")
    turn = np.take_along_axis(turn, order[:, :, None], axis=1)
    return np.take_along_axis(x, order, axis=1), np.matmul(vectors, turn.transpose(0, 2, 1))


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum of the sum of two matrices, by one update for each eigenvector of the second that is not nothing."""
    values, vectors = a[0][None], a[1][None]
    least = EPS * max(np.abs(b[0]).max(initial=0), np.abs(a[0]).max(initial=0))
    for value, vector in zip(b[0][::-1], b[1].T[::-1], strict=True):
        if value > least:
            values, vectors = update(values, vectors, np.array([value]), vector[None])
    return values[0], vectors[0]
