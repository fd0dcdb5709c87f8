"""Helpers on small arrays, without Spark."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.functions import codecs, dense
from tilewright.operators import tensors


@pytest.mark.parametrize("name", sorted(dense.APPROX))
@pytest.mark.parametrize("shape", [(30, 20), (20, 30), (1, 5), (5, 1), (1, 1), (16, 16)])
@pytest.mark.parametrize("rank", [0, 1, 3, 99])
def test_approximations_rebuild(name, shape, rank):
    rng, k = np.random.default_rng(1), min(rank, *shape)
    a = rng.standard_normal((shape[0], k)) @ rng.standard_normal((k, shape[1]))
    u, v = dense.APPROX[name](a, dense.TIGHT)
    assert np.linalg.norm(a - u @ v.T) <= 1e-10 * (np.linalg.norm(a) or 1)
    assert u.shape[1] <= k + 1  # cross approximation keeps its last term


def test_zero_rows_do_not_stop_cross_approximation():
    a = np.zeros((6, 5))
    a[4, 2] = 3.0
    for pivot in ("next", "max", "full"):
        u, v = dense.aca(a, dense.TIGHT, pivot)
        assert np.allclose(u @ v.T, a)


def test_trunc_rank():
    s = np.array([4.0, 2.0, 1.0, 0.0])
    assert dense.trunc_rank(s, dense.Acc(rank=2)) == 2
    assert dense.trunc_rank(s, dense.Acc(rel=0.4, norm="spectral")) == 2
    assert dense.trunc_rank(s, dense.Acc(abs=1.0)) == 2
    assert dense.trunc_rank(np.zeros(3), dense.TIGHT) == 0 and dense.trunc_rank(np.zeros(0), dense.TIGHT) == 0


def test_sums_and_truncation():
    rng = np.random.default_rng(2)
    parts = [(rng.standard_normal((12, 2)), rng.standard_normal((9, 2))) for _ in range(5)]
    want = sum(u @ v.T for u, v in parts)
    for f in (dense.sum_lowrank, dense.sum_lowrank_pairwise):
        u, v = f(parts, dense.TIGHT)
        assert np.allclose(u @ v.T, want)
    assert np.allclose(np.sort(dense.lowrank_singular_values(*parts[0]))[::-1], np.linalg.svd(parts[0][0] @ parts[0][1].T, compute_uv=False)[:2])
    assert dense.truncate(np.zeros((4, 0)), np.zeros((3, 0)), dense.TIGHT)[0].shape == (4, 0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False).filter(lambda x: x == 0 or abs(x) > 1e-6), min_size=0, max_size=60), st.sampled_from(codecs.CODECS), st.sampled_from([1e-3, 1e-6]))
def test_codecs(values, codec, eps):
    x = np.array(values)
    z, head = codecs.encode(x, codec, eps)
    y = codecs.decode(z, head)
    bound = np.abs(x) * max(eps, 6e-8) if codec != "bfp" else np.abs(x).max(initial=0) * eps
    assert len(y) == len(x) and (np.abs(x - y) <= bound * 1.0001).all()


def test_adaptive_tolerances_meet_their_equation():
    sigma = np.array([5.0, 1.0, 0.01])
    e = codecs.column_tolerances(sigma, 1e-3) * sigma
    assert np.allclose(e, e[0]) and np.isclose((1 / sigma).sum() * e[0] ** 2 + e[0], 1e-3)


def test_curve_and_bessel():
    g = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = g[np.argsort(dense.hilbert_key(g, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()
    x = np.array([1e-9, 0.05, 1.0, 8.0, 300.0])
    assert np.allclose(dense.bessel_k(1.5, x), np.sqrt(np.pi / 2 / x) * np.exp(-x) * (1 + 1 / x), rtol=1e-12)
    assert np.allclose(dense.bessel_k(0.5, x), np.sqrt(np.pi / 2 / x) * np.exp(-x), rtol=1e-9)


def test_interpolation_of_a_smooth_kernel():
    rng = np.random.default_rng(3)
    x, y = rng.random((40, 3)), rng.random((30, 3)) + 3
    f = lambda a, b: 1 / np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    for kind in ("cheb", "bounds", "lobatto"):
        u, v = dense.interpolate(x, y, f, 6, kind)
        assert np.abs(u @ v.T - f(x, y)).max() < 1e-4
    flat = np.column_stack([x[:, :2], np.zeros(40)])  # an axis without extent
    u, v = dense.interpolate(flat, y, f, 6)
    assert np.abs(u @ v.T - f(flat, y)).max() < 1e-4


def test_local_tucker_forms():
    rng = np.random.default_rng(4)
    x = np.einsum("ir,jr,kr->ijk", rng.random((5, 2)), rng.random((4, 2)), rng.random((3, 2)))
    for f in (tensors.local_hosvd, tensors.local_tca):
        g, factors = f(x, 1e-9)
        assert np.allclose(tensors.expand(g, factors), x) and max(g.shape) <= 3
        assert np.allclose(tensors.expand(*f(np.zeros((2, 3, 1)), 1e-9)), 0)
