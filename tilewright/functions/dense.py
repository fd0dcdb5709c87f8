"""Small dense helpers that run inside tasks: truncation, factorisations and compression of one block. NumPy only.

A low-rank block is a pair (U, V) with block = U V^T; U has the block's rows, V its columns. Empty blocks have rank 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Acc:
    """Accuracy of an approximation: a fixed rank, or a relative and absolute bound in the spectral or Frobenius norm."""

    rank: int | None = None
    rel: float = 0.0
    abs: float = 0.0
    norm: str = "frobenius"


TIGHT = Acc(rel=1e-12)


def trunc_rank(s: np.ndarray, acc: Acc) -> int:
    """Number of singular values (in falling order) to keep."""
    if len(s) == 0 or s[0] == 0:
        return 0
    if acc.rank is not None:
        return min(acc.rank, len(s))
    if acc.norm == "spectral":
        return int((s > max(acc.rel * s[0], acc.abs)).sum())
    tails = np.sqrt(np.concatenate((np.cumsum((s**2)[::-1])[::-1], [0.0])))
    return int(np.argmax(tails <= max(acc.rel * np.linalg.norm(s), acc.abs)))


def svd_lowrank(a: np.ndarray, acc: Acc) -> tuple[np.ndarray, np.ndarray]:
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    k = trunc_rank(s, acc)
    if a.shape[0] <= a.shape[1]:  # the weights go to the shorter factor
        return u[:, :k] * s[:k], vt[:k].T
    return u[:, :k], vt[:k].T * s[:k]


def truncate(u: np.ndarray, v: np.ndarray, acc: Acc) -> tuple[np.ndarray, np.ndarray]:
    """Recompress U V^T through QR of both factors."""
    if u.shape[1] == 0:
        return u, v
    if u.shape[1] >= min(len(u), len(v)):
        return svd_lowrank(u @ v.T, acc)
    qu, ru = np.linalg.qr(u)
    qv, rv = np.linalg.qr(v)
    w, s, zt = np.linalg.svd(ru @ rv.T)
    k = trunc_rank(s, acc)
    return qu @ (w[:, :k] * s[:k]), qv @ zt[:k].T


def lowrank_singular_values(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    if u.shape[1] == 0:
        return np.zeros(0)
    return np.linalg.svd(np.linalg.qr(u)[1] @ np.linalg.qr(v)[1].T, compute_uv=False)


def sum_lowrank(parts: list[tuple[np.ndarray, np.ndarray]], acc: Acc) -> tuple[np.ndarray, np.ndarray]:
    return truncate(np.hstack([u for u, _ in parts]), np.hstack([v for _, v in parts]), acc)


def sum_lowrank_pairwise(parts: list[tuple[np.ndarray, np.ndarray]], acc: Acc) -> tuple[np.ndarray, np.ndarray]:
    """Truncated sums of neighbours until one is left."""
    while len(parts) > 1:
        parts = [sum_lowrank(parts[i : i + 2], acc) for i in range(0, len(parts), 2)]
    return truncate(*parts[0], acc)


def rrqr(a: np.ndarray, acc: Acc) -> tuple[np.ndarray, np.ndarray]:
    """Column-pivoted QR by modified Gram-Schmidt with a second pass; wide blocks go transposed."""
    if a.shape[1] > a.shape[0]:
        v, u = rrqr(a.T, acc)
        return u, v
    rest, whole, basis = a.astype(float).copy(), np.linalg.norm(a), []
    limit = max(acc.rel * whole, acc.abs)
    while len(basis) < min(a.shape) and (acc.rank is None or len(basis) < acc.rank):
        norms = np.einsum("ij,ij->j", rest, rest)
        if np.sqrt(norms.sum()) <= max(limit, 1e-300):
            break
        q = rest[:, norms.argmax()].copy()
        for b in basis:
            q -= b * (b @ q)
        q /= np.linalg.norm(q)
        basis.append(q)
        rest -= np.outer(q, q @ rest)
    u = np.array(basis).T.reshape(a.shape[0], len(basis))
    return u, a.T @ u


def aca(a: np.ndarray, acc: Acc, pivot: str = "max") -> tuple[np.ndarray, np.ndarray]:
    """Adaptive cross approximation; pivot 'full' (largest entry), 'max' (largest of a row) or 'next' (next unused row).

    Zero rows are passed over. The last term, which meets the tolerance, is kept.
    """
    n, m = a.shape
    rest, us, vs, total = a.astype(float).copy(), [], [], 0.0
    free = np.ones(n, bool)
    row = 0
    while free.any() and len(us) < min(n, m) and (acc.rank is None or len(us) < acc.rank):
        if pivot == "full":
            row, col = np.unravel_index(np.abs(rest).argmax(), rest.shape)
        else:
            if not free[row]:
                row = int(np.flatnonzero(free)[0])
            col = int(np.abs(rest[row]).argmax())
        free[row] = False
        if abs(rest[row, col]) <= 1e-300:
            if pivot == "full":
                break
            continue
        u, v = rest[:, col] / rest[row, col], rest[row].copy()
        rest -= np.outer(u, v)
        us.append(u)
        vs.append(v)
        term = np.linalg.norm(u) * np.linalg.norm(v)
        total = np.hypot(total, term)
        if pivot == "max" and free.any():
            row = int(np.where(free, np.abs(u), -1).argmax())
        if acc.rank is None and term <= max(acc.rel * total, acc.abs) and np.linalg.norm(rest) <= max(acc.rel * total, acc.abs):
            break
    k = len(us)
    return np.array(us).T.reshape(n, k), np.array(vs).T.reshape(m, k)


def cross(row: Callable[[int], np.ndarray], col: Callable[[int], np.ndarray], n: int, m: int, acc: Acc, pivot: str = "max") -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
    """Cross approximation of an n x m block that is never formed, from its rows and columns: pivot rows, pivot columns, U, V.

    Ends when a term is below the tolerance of the whole (norms are those of the terms) and so are a few other rows, taken by lot; else the
    worst of those is the next pivot, which finds parts of a block that the terms so far do not touch.
    """
    us, vs, rows, cols = np.zeros((n, 0)), np.zeros((m, 0)), [], []
    free, at, total, rng = np.ones(n, bool), 0, 0.0, np.random.default_rng(7)
    while free.any() and len(rows) < min(n, m) and (acc.rank is None or len(rows) < acc.rank):
        if not free[at]:
            at = int(np.flatnonzero(free)[0])
        free[at] = False
        v = row(at) - vs @ us[at]
        j = int(np.abs(v).argmax())
        if abs(v[j]) <= 1e-300:
            continue
        u = (col(j) - us @ vs[j]) / v[j]
        us, vs = np.column_stack([us, u]), np.column_stack([vs, v])
        rows.append(at)
        cols.append(j)
        term = np.linalg.norm(u) * np.linalg.norm(v)
        total = np.hypot(total, term)
        limit = max(acc.rel * total, acc.abs)
        left = np.where(free, np.abs(u), -1)
        at = int(left.argmax()) if pivot == "max" and left.max() > 0 else at
        if acc.rank is None and term <= limit and free.any():
            some = rng.choice(np.flatnonzero(free), min(12, int(free.sum())), replace=False)
            rest = np.array([np.linalg.norm(row(int(i)) - vs @ us[i]) for i in some])
            if rest.max() * np.sqrt(n) <= limit:
                break
            at = int(some[rest.argmax()])
    return rows, cols, us, vs


def _seeded(a: np.ndarray, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, *a.shape])


def randsvd(a: np.ndarray, acc: Acc, over: int = 8, power: int = 1, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    k = min(*a.shape, (acc.rank or min(a.shape)) + over)
    q = np.linalg.qr(a @ _seeded(a, seed).standard_normal((a.shape[1], k)))[0]
    for _ in range(power):
        q = np.linalg.qr(a @ np.linalg.qr(a.T @ q)[0])[0]
    return truncate(q, a.T @ q, acc)


def randlr(a: np.ndarray, acc: Acc, step: int = 8, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive range finder: blocks of random products until the rest is small."""
    rng, w = _seeded(a, seed), np.zeros((a.shape[0], 0))
    limit = max(acc.rel * np.linalg.norm(a), acc.abs)
    while w.shape[1] < min(a.shape) and (acc.rank is None or w.shape[1] < acc.rank):
        rest = a - w @ (w.T @ a)
        if np.linalg.norm(rest) <= limit:
            break
        y = rest @ rng.standard_normal((a.shape[1], min(step, min(a.shape) - w.shape[1])))
        y -= w @ (w.T @ y)
        w = np.hstack([w, np.linalg.qr(y)[0]])
    return truncate(w, a.T @ w, acc)


def lanczos(a: np.ndarray, acc: Acc, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Golub-Kahan bidiagonalisation with full reorthogonalisation; a vanished direction starts anew."""
    n, m = a.shape
    rng, us, vs = _seeded(a, seed), np.zeros((n, 0)), np.zeros((m, 0))
    limit = max(acc.rel * np.linalg.norm(a), acc.abs)
    v = rng.standard_normal(m)
    while us.shape[1] < min(n, m) and (acc.rank is None or us.shape[1] < acc.rank):
        for _ in range(2):
            v -= vs @ (vs.T @ v)
        v /= np.linalg.norm(v)
        u = a @ v
        for _ in range(2):
            u -= us @ (us.T @ u)
        vs = np.column_stack([vs, v])
        size = np.linalg.norm(u)
        if size > 1e-14 * (limit + np.linalg.norm(a) + 1e-300):
            us = np.column_stack([us, u / size])
            v = a.T @ us[:, -1]
        else:
            v = rng.standard_normal(m)
        if vs.shape[1] >= m or np.linalg.norm(a - us @ (us.T @ a)) <= limit:
            break
        if np.linalg.norm(v - vs @ (vs.T @ v)) < 1e-12 * (np.linalg.norm(v) + 1e-300):
            v = rng.standard_normal(m)
    return truncate(us, a.T @ us, acc) if us.shape[1] else (us, np.zeros((m, 0)))


def column_id(a: np.ndarray, acc: Acc) -> tuple[np.ndarray, np.ndarray]:
    """Interpolative decomposition: chosen columns times interpolation weights."""
    rest, cols = a.astype(float).copy(), []
    limit = max(acc.rel * np.linalg.norm(a), acc.abs)
    while len(cols) < min(a.shape) and (acc.rank is None or len(cols) < acc.rank) and np.linalg.norm(rest) > max(limit, 1e-300):
        cols.append(int(np.einsum("ij,ij->j", rest, rest).argmax()))
        q = np.linalg.qr(a[:, cols])[0]
        rest = a - q @ (q.T @ a)
    if not cols:
        return np.zeros((a.shape[0], 0)), np.zeros((a.shape[1], 0))
    weights = np.linalg.lstsq(a[:, cols], a, rcond=None)[0]
    return a[:, cols].astype(float), weights.T


APPROX = {
    "svd": svd_lowrank, "rrqr": rrqr, "randsvd": randsvd, "randlr": randlr, "lanczos": lanczos, "id": column_id,
    "aca_next": lambda a, acc: aca(a, acc, "next"), "aca_max": lambda a, acc: aca(a, acc, "max"), "aca_full": lambda a, acc: aca(a, acc, "full"),
}


def column_basis(a: np.ndarray, acc: Acc, how: str = "svd") -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal basis of the columns with its singular values: by SVD, by pivoted QR ('rrqr') or by a random range ('randsvd')."""
    if how == "rrqr":
        q, v = rrqr(a, acc)
        u, s, _ = np.linalg.svd(np.linalg.qr(q)[0].T @ a, full_matrices=False)
        return np.linalg.qr(q)[0] @ u[:, : q.shape[1]], s[: q.shape[1]]
    if how == "randsvd":
        u, _ = randsvd(a, acc)
        q = np.linalg.qr(u)[0]
        w, s, _ = np.linalg.svd(q.T @ a, full_matrices=False)
        return q @ w, s
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    k = trunc_rank(s, acc)
    return u[:, :k], s[:k]


def chebyshev(order: int, lo: float, hi: float, kind: str = "cheb") -> np.ndarray:
    """Points of an axis: Chebyshev roots, roots stretched to the ends ('bounds'), or Lobatto points."""
    if hi <= lo or order == 1:
        return np.array([(lo + hi) / 2])
    i = np.arange(order)
    t = np.cos(np.pi * i / (order - 1)) if kind == "lobatto" else np.cos(np.pi * (2 * i + 1) / (2 * order))
    if kind == "bounds":
        t = t / t[0]
    return (lo + hi) / 2 + (hi - lo) / 2 * t


def grid_axes(low: np.ndarray, high: np.ndarray, order: int, kind: str = "cheb") -> list[np.ndarray]:
    """Points of each axis of a box: fewer than `order` on shorter axes, by the square root of their share of the longest."""
    side = np.asarray(high, float) - np.asarray(low, float)
    longest = side.max() if len(side) else 0.0
    count = [int(np.ceil(order * np.sqrt(s / longest) - 1e-9)) if s > 0 else 1 for s in side]
    return [chebyshev(n if order == 1 else max(n, 2) if s > 0 else 1, float(lo), float(hi), kind) for n, s, lo, hi in zip(count, side, low, high, strict=True)]


def fitting_grids(kernel, rows: tuple, cols: tuple, acc: Acc, order: int, most: int = 15) -> tuple[list, list, float]:
    """Axes on two boxes (low, high) between which the kernel interpolates to the accuracy, and the relative error seen on test points.

    The order grows from the given one until the error is a fourth of the tolerance or `most` is reached.
    """
    rng = np.random.default_rng(1)
    tests = [np.asarray(lo, float) + rng.random((12, len(lo))) * (np.asarray(hi, float) - np.asarray(lo, float)) for lo, hi in (rows, cols)]
    want = kernel(*tests)
    scale = np.abs(want).max() or 1.0
    while True:
        a, b = grid_axes(*rows, order), grid_axes(*cols, order)
        off = max(np.abs(lagrange(tests[0], a) @ kernel(grid_points(a), tests[1]) - want).max(), np.abs(kernel(tests[0], grid_points(b)) @ lagrange(tests[1], b).T - want).max()) / scale
        if order >= most or acc.rank is not None or 4 * off <= max(acc.rel, 1e-14):
            return a, b, float(off)
        order += 2


def grid_points(axes: list[np.ndarray]) -> np.ndarray:
    return np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1).reshape(-1, len(axes))


def lagrange(x: np.ndarray, axes: list[np.ndarray]) -> np.ndarray:
    """Values at x of the tensor Lagrange polynomials of a grid."""
    u = np.ones((len(x), 1))
    for d, p in enumerate(axes):
        own = np.eye(len(p))
        terms = (x[:, d, None] - p)[:, None, :] / (p[:, None] - p + own)  # point, polynomial, root
        values = np.where(own > 0, 1.0, terms).prod(axis=2)
        u = (u[:, :, None] * values[:, None, :]).reshape(len(x), -1)
    return u


def interpolate(x: np.ndarray, y: np.ndarray, kernel, order: int, kind: str = "cheb") -> tuple[np.ndarray, np.ndarray]:
    """Kernel block by tensor interpolation on the rows' bounding box: U holds Lagrange values, V the kernel at grid points."""
    axes = grid_axes(x.min(axis=0), x.max(axis=0), order, kind)
    return lagrange(x, axes), kernel(grid_points(axes), y).T


def bessel_k(nu: float, x: np.ndarray, nodes: int = 128) -> np.ndarray:
    """K_nu(x) = integral over t >= 0 of exp(-x cosh t) cosh(nu t), by the trapezoidal rule.

    Each x has its own step, as the integrand falls below rounding where x (cosh t - 1) is large enough.
    """
    x = np.asarray(x, float)[..., None]
    step = np.arccosh(1 + (45 + 40 * abs(nu)) / x) / nodes
    t = step * np.arange(nodes + 1)
    fall = -x * np.cosh(t)
    both = np.exp(fall + nu * t) + np.exp(fall - nu * t)
    return (both.sum(axis=-1) - both[..., 0] / 2) * step[..., 0] / 2


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (n, dim) below 2^bits: Skilling's transposed form, all rows at once."""
    x = cells.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            hot = (x[i] & q) > 0
            t = np.where(hot, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(hot, q - 1, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key
