"""Spectra under rank-one updates, several in lock-step.

A spectrum holds a symmetric matrix as ``Q diag(lam) Q'`` (``lam`` rising).
Adding ``rho v v'`` turns it into the problem ``diag(lam) + z z'`` with
``z = sqrt(rho) Q'v``, whose eigenvalues are the roots of the secular
equation ``1 + sum z_i^2 / (lam_i - y) = 0``, one between each two poles and
one above the last.  Poles with no weight keep their value and vector, and
poles that agree are turned (one reflection) until one of them carries all
their weight: both are deflated.  Roots are found as offsets from the nearer
pole by rational interpolation of the two sides, inside a bracket; the
weights are then recomputed from the roots, so that the new vectors are
orthogonal whatever the gaps.

All arrays have a leading axis of independent spectra, since one update of a
small matrix is too little work for a numpy call.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
STEPS = 60
NEAR = 1e-12        # a root is found when the equation's terms cancel to this share
FAR = 1e300         # stands for the distance of a pole without weight


def _merge_equal_poles(lam: np.ndarray, q: np.ndarray, z: np.ndarray, tol: np.ndarray) -> None:
    """Reflect the weight of each run of agreeing poles into its last one."""
    close = (lam[:, 1:] - lam[:, :-1] <= tol[:, None]) & (z[:, 1:] != 0) & (z[:, :-1] != 0)
    for s in np.nonzero(close.any(axis=1))[0]:
        at, m = 0, lam.shape[1]
        while at < m - 1:
            end = at
            while end < m - 1 and lam[s, end + 1] - lam[s, at] <= tol[s]:
                end += 1
            if end > at and np.count_nonzero(z[s, at:end + 1]) > 1:
                w = z[s, at:end + 1].copy()
                size = np.linalg.norm(w)
                w[-1] += size if w[-1] >= 0 else -size
                z[s, at:end] = 0.0
                z[s, end] = -size if w[-1] >= 0 else size
                block = q[s, :, at:end + 1]
                q[s, :, at:end + 1] = block - np.outer(block @ w, w) * (2.0 / (w @ w))
            at = end + 1


def _roots(lam: np.ndarray, z2: np.ndarray, upper: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per spectrum and pole ``j``: the root in ``(lam_j, upper_j)`` as an
    origin and an offset, with the differences ``lam_i - root_j``."""
    b, m = lam.shape
    width = np.where(live, upper - lam, 1.0)
    half = 0.5 * width
    left_of = (np.arange(m)[:, None] <= np.arange(m)[None, :]).astype(float)    # [i, j]: i <= j
    gap = lam[:, :, None] - lam[:, None, :]                              # [i, j] = lam_i - lam_j
    if not live.all():
        gap[~live] = FAR                                                 # poles without weight
    weight = z2[:, :, None]
    mid = 1.0 + (weight / (gap - half[:, None, :])).sum(axis=1)
    # offsets count from the nearer pole (from the left one above the last)
    last = live & (np.cumsum(live[:, ::-1], axis=1)[:, ::-1] == 1)
    right = (mid < 0) & ~last & live
    origin = np.where(right, upper, lam)
    delta = gap
    delta -= (origin - lam)[:, None, :]
    lo = np.where(right, -half, np.where(mid < 0, half, 0.0))
    hi = np.where(right, 0.0, np.where(mid < 0, width, half))
    d1, d2 = lam - origin, upper - origin                                # both poles seen from the origin
    tau = np.where(right, -half, half)
    d = delta - tau[:, None, :]
    w = weight / d
    for _ in range(STEPS):
        below = np.einsum("bij,ij->bj", w, left_of)
        f = 1.0 + w.sum(axis=1)
        size = 1.0 + (f - 1.0) - 2.0 * below
        lo, hi = np.where(f < 0, tau, lo), np.where(f >= 0, tau, hi)
        done = (np.abs(f) <= NEAR * size) | (hi - lo <= 4 * EPS * np.maximum(np.abs(lo), np.abs(hi))) | ~live
        if done.all():
            break
        w /= d
        left = np.einsum("bij,ij->bj", w, left_of)
        right_sum = w.sum(axis=1) - left
        a1, a2 = d1 - tau, d2 - tau
        c = f - a1 * left - a2 * right_sum
        p = (a1 + a2) * f - a1 * a2 * (left + right_sum)
        r = a1 * a2 * f
        root = np.sqrt(np.maximum(p * p - 4 * c * r, 0.0))
        new = tau + np.where(p <= 0, (p - root) / (2 * c), 2 * r / (p + root))
        bad = ~((new > lo) & (new < hi))
        tau = np.where(done, tau, np.where(bad, 0.5 * (lo + hi), new))
        np.subtract(delta, tau[:, None, :], out=d)
        np.divide(weight, d, out=w)
    return origin + tau, d


@np.errstate(divide="ignore", invalid="ignore", over="ignore")
def rank_one(lam: np.ndarray, q: np.ndarray, v: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectra of ``Q diag(lam) Q' + rho v v'`` for ``rho >= 0``: ``lam``
    (b, m) rising, ``q`` (b, d, m), ``v`` (b, d), ``rho`` (b,)."""
    z = np.matmul(v[:, None, :], q)[:, 0, :] * np.sqrt(rho)[:, None]
    norm2 = (z * z).sum(axis=1)
    tol = 8 * EPS * np.maximum(np.abs(lam).max(axis=1), norm2)
    z[np.sqrt(norm2)[:, None] * np.abs(z) <= tol[:, None]] = 0.0
    if ((lam[:, 1:] - lam[:, :-1] <= tol[:, None]) & (z[:, 1:] != 0) & (z[:, :-1] != 0)).any():
        q = q.copy()
        _merge_equal_poles(lam, q, z, tol)
    live = z != 0
    if not live.any():
        return lam, q
    b, m = lam.shape
    # each live pole's interval ends at the next live one
    place = np.where(live, np.arange(m), m)
    after = np.full((b, m), m)
    after[:, :-1] = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, 1:]
    ends = np.concatenate([lam, np.zeros((b, 1))], axis=1)
    ends[:, -1] = lam.max(axis=1)
    rows = np.arange(b)[:, None]
    top = lam + norm2[:, None] * (1 + 4 * EPS)
    upper = np.where(after < m, ends[rows, after], top)
    upper = np.where(upper > lam, upper, lam + tol[:, None])
    z2 = z * z
    roots, d = _roots(lam, z2, upper, live)                              # d[i, j] = lam_i - root_j
    # weights that have exactly these roots: the product over j of
    # (root_j - lam_i) / (lam_j - lam_i), live poles only
    gap = lam[:, None, :] - lam[:, :, None]                              # [i, j] = lam_j - lam_i
    whole = live.all()
    i = np.arange(m)
    gap[:, i, i] = -1.0
    ratio = d / gap
    np.negative(ratio, out=ratio)
    if not whole:
        dead = ~(live[:, :, None] & live[:, None, :])
        ratio[dead] = 1.0
        d[dead] = FAR
    ratio[:, i, i] = np.abs(d[:, i, i])
    again = np.copysign(np.sqrt(np.abs(ratio.prod(axis=2))), z)
    u = again[:, :, None] / d
    if not whole:
        u = np.where(live[:, None, :], u, np.eye(m))
    u[~np.isfinite(u)] = 0.0
    size = np.sqrt(np.einsum("bij,bij->bj", u, u))
    u /= np.where(size > 0, size, 1.0)[:, None, :]
    lam = np.where(live, roots, lam)
    q = np.matmul(q, u)
    if (lam[:, 1:] < lam[:, :-1]).any():
        order = np.argsort(lam, axis=1, kind="stable")
        lam = np.take_along_axis(lam, order, 1)
        q = np.take_along_axis(q, order[:, None, :], 2)
    return lam, q
