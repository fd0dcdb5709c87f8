"""Products, factorisations and other forms of hierarchical matrices against dense NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import dense
from tilewright.operators import clusters as C
from tilewright.operators import hbases, hcodes, hlu
from tilewright.operators import hmatrix as H
from tilewright.operators import hproduct as P

gaussian = lambda x, y: np.exp(-((x[:, None] - y[None]) ** 2).sum(axis=2))  # noqa: E731  a lambda, as tasks cannot import this module
skew = lambda x, y: np.exp(-np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))) * (1 + x[:, None, 0] - 0.5 * y[None, :, 0])
N = 120


@pytest.fixture(scope="module")
def pair(spark):
    """A flat cloud, clustered once; a kernel with strong admissibility and one that is not symmetric with weak, and both as dense arrays."""
    x = np.random.default_rng(4).random((N, 2))
    leaves = C.bisect(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, x array<double>"), 16).cache()
    leaves.count()
    a = H.build(leaves, C.admissible("strong", dim=2), dense.Acc(rel=1e-9), gaussian, dim=2)
    b = H.build(leaves, C.admissible("weak", dim=2), dense.Acc(rel=1e-9), skew, "aca", dim=2)
    return a, b, gaussian(x, x), skew(x, x)


def as_array(vec, n=N):
    out = np.zeros(n)
    for r in vec.collect():
        out[r["i"]] += r["v"]
    return out


def vec(spark, v):
    return spark.createDataFrame([(i, float(y)) for i, y in enumerate(v)], "i long, v double")


@pytest.mark.parametrize("rule", ["weak", "none"])
def test_product(spark, pair, rule):
    """A B in B's partition and all dense; no array is above leaf size."""
    a, b, ka, kb = pair
    c = P.multiply(a, b, F.lit(False) if rule == "none" else C.admissible(rule, dim=2))
    v = np.random.default_rng(5).standard_normal(N)
    for t in (False, True):
        want = (ka @ kb).T @ v if t else ka @ kb @ v
        assert np.abs(as_array(H.matvec(c, vec(spark, v), transposed=t)) - want).max() < 1e-6 * np.abs(want).max()
    assert c.near.agg(F.max(F.size("d"))).first()[0] <= 16 * 16
    covered = H.memory_report(c).first()
    assert covered["area"] == N * N
    assert (c.far.limit(1).count() == 0) == (rule == "none")


def test_sum(spark, pair):
    a, _, ka, _ = pair
    v = np.random.default_rng(6).standard_normal(N)
    s = P.add(a, a, 2.0, -0.5)
    assert np.abs(as_array(H.matvec(s, vec(spark, v))) - 1.5 * ka @ v).max() < 1e-6
    ranks = lambda h: h.far.where("side = 'r'").agg(F.max("k")).first()[0]
    assert ranks(s) <= ranks(a)


def test_triangles(spark):
    """L and U of a matrix that is not symmetric: L U x = A x, solves with A, its transpose and each triangle, and the determinant."""
    n = 96
    x = np.random.default_rng(4).random((n, 2))
    leaves = C.bisect(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, x array<double>"), 24)
    b = H.build(leaves, C.admissible("offdiag", dim=2), dense.Acc(rel=1e-10), skew, "svd", dim=2)
    a = skew(x, x) + 4 * np.eye(n)
    hodlr = H.add_identity(b, 4.0)
    lu = hlu.factorise(hodlr)
    v = np.random.default_rng(8).standard_normal(n)
    assert np.abs(as_array(H.matvec(lu.lower, H.matvec(lu.upper, vec(spark, v))), n) - a @ v).max() < 1e-7
    assert np.abs(as_array(hlu.solve(lu, vec(spark, a @ v)), n) - v).max() < 1e-7
    assert np.abs(as_array(hlu.solve(lu, vec(spark, a.T @ v), transposed=True), n) - v).max() < 1e-7
    order = [i for r in hodlr.leaves.orderBy("leaf").collect() for i in r.ids]
    e = vec(spark, np.eye(n)[:, order[50]])
    lower, upper = (as_array(H.matvec(t, e), n)[order] for t in (lu.lower, lu.upper))
    assert np.allclose(lower[:50], 0) and lower[50] == pytest.approx(1) and np.allclose(upper[51:], 0)
    got = hlu.log_determinant(lu).first()
    sign, size = np.linalg.slogdet(a)
    assert got["sign"] == sign and got["log"] == pytest.approx(size, abs=1e-7)


def test_bases(spark, pair):
    """Uniform form of a given matrix and back, then nested bases from it: products, orthonormal bases, bytes, ranks by level."""
    _, b, _, kb = pair
    v = np.random.default_rng(9).standard_normal(N)
    want = kb @ v
    u = hbases.to_uniform(b, dense.Acc(rel=1e-9))
    for made in (hbases.matvec_uniform(u, vec(spark, v)), H.matvec(hbases.from_uniform(u), vec(spark, v))):
        assert np.abs(as_array(made) - want).max() < 1e-6
    cid = {}
    for r in u.bases.where("side = 'r'").orderBy("leaf").collect():
        cid.setdefault(r.cid, []).append(np.array(r.x).reshape(-1, r.m))
    for parts in cid.values():
        x = np.vstack(parts)
        assert np.allclose(x.T @ x, np.eye(x.shape[1]), atol=1e-9)
    nested = hbases.to_nested(u, dense.Acc(rel=1e-9))
    assert np.abs(as_array(hbases.matvec_nested(nested, vec(spark, v))) - want).max() < 1e-5
    assert nested.transfers.limit(1).count() == 1
    bytes_of = lambda t, c: 8 * sum(len(r[c]) for r in t.select(c).collect())
    assert tuple(hbases.memory(nested).first()) == (bytes_of(nested.leaves, "x") + bytes_of(nested.transfers, "x"), bytes_of(nested.couplings, "s"), bytes_of(b.near, "d"))
    assert hbases.rank_info(u).where("max_rank < min_rank or avg_rank < min_rank").count() == 0 < hbases.rank_info(nested).count()
    coarse = hbases.to_nested(hbases.to_uniform(b, dense.Acc(rel=1e-2)), dense.Acc(rel=1e-2))
    assert 1e-6 < np.abs(as_array(hbases.matvec_nested(coarse, vec(spark, v))) - want).max() < 0.1 * np.abs(want).max()


def test_encoded_columns(spark, pair):
    """U S V factors are orthonormal with falling singular values; products of the encoded table err as asked, in fewer bytes."""
    _, b, _, kb = pair
    v = np.random.default_rng(10).standard_normal(N)
    orth, sigma = hcodes.usv(b)
    s = {(r.rcid, r.ccid): np.array(r.s) for r in sigma.collect()}
    held = {}
    for r in orth.far.orderBy("leaf").collect():
        held.setdefault((r.rcid, r.ccid, r.side), []).append(np.array(r.f).reshape(r.n, r.k))
    for (rcid, ccid, _), parts in held.items():
        x = np.vstack(parts)
        assert np.allclose(x.T @ x, np.eye(x.shape[1]), atol=1e-6) and (np.diff(s[rcid, ccid]) <= 1e-12).all()
    sizes = []
    for delta in (1e-3, 1e-8):
        e = hcodes.encode(b, delta)
        assert np.abs(as_array(hcodes.matvec(e, vec(spark, v))) - kb @ v).max() < 10 * delta * np.abs(kb @ v).max() + 1e-7
        rows = hcodes.bytes_by_level(e).collect()
        assert {r.kind for r in rows} == {"far", "near"}
        sizes.append(sum(r.coded_bytes for r in rows if r.kind == "near"))
        assert sizes[-1] < 0.8 * sum(r.full_bytes for r in rows if r.kind == "near")
    assert sizes[0] < sizes[1]
