"""Hierarchical and tall matrices against dense NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import dense, kernels
from tilewright.operators import blocks as B
from tilewright.operators import clusters as C
from tilewright.operators import hmatrix as H
from tilewright.operators import solvers as S
from tilewright.operators import tall


gaussian = lambda x, y: np.exp(-((x[:, None] - y[None]) ** 2).sum(axis=2))  # noqa: E731  a lambda, as tasks cannot import this module


@pytest.fixture(scope="module")
def cloud(spark):
    """300 points, some of them alike, with the dense kernel."""
    x = np.random.default_rng(2).random((300, 3))
    x[40:44] = x[40]
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, x array<double>"), gaussian(x, x)


def as_array(vec, n):
    out = np.zeros(n)
    for r in vec.collect():
        out[r["i"]] += r["v"]
    return out


def vec(spark, v):
    return spark.createDataFrame([(i, float(y)) for i, y in enumerate(v)], "i long, v double")


@pytest.mark.parametrize("far", ["hca", "interpolation", "aca", "svd"])
def test_products_with_any_vector(spark, cloud, far):
    points, k = cloud
    v = np.random.default_rng(3).standard_normal(300)
    h = H.build(C.bisect(points, 16), C.admissible("strong"), dense.Acc(rel=1e-9), gaussian, far)
    assert h.far.limit(1).count() == 1
    for t in (False, True):
        assert np.allclose(as_array(H.matvec(h, vec(spark, v), transposed=t), 300), k @ v, atol=1e-6)
    r = H.memory_report(h).first()
    assert r["area"] == 300 * 300 and r["full_bytes"] == 8 * 300 * 300


def test_far_blocks_take_less_than_the_square(spark):
    """On a line, bytes of all blocks grow like n log n: twice the points, well below four times the bytes."""
    sizes = []
    for n in (512, 1024):
        points = spark.range(n).select("id", F.array((F.col("id") + 0.5) / n).alias("x"))
        r = H.memory_report(H.build(C.bisect(points, 16), C.admissible("strong", dim=1), dense.Acc(rel=1e-6), gaussian, dim=1)).first()
        sizes.append(r["near_bytes"] + r["far_bytes"])
        assert r["area"] == n * n
    assert sizes[1] < 2.6 * sizes[0] and sizes[1] < 0.2 * 8 * 1024 * 1024


def test_conversions(spark, cloud):
    points, k = cloud
    v = np.random.default_rng(4).standard_normal(300)
    h = H.build(C.bisect(points, 16), C.admissible("strong"), dense.Acc(rel=1e-10), gaussian)
    hodlr = H.converted(h, 80, dense.Acc(rel=1e-9))
    assert np.allclose(as_array(H.matvec(hodlr, vec(spark, v)), 300), k @ v, atol=1e-5)
    assert {(r.rleaf, r.cleaf) for r in hodlr.near.select("rleaf", "cleaf").collect()} == {(r.leaf, r.leaf) for r in h.leaves.select("leaf").collect()}
    one = H.converted(h, 120, dense.Acc(rel=1e-9), whole=True)
    assert {(r.rcid, r.ccid) for r in one.far.select("rcid", "ccid").distinct().collect()} == {(1, 1)} and one.near.isEmpty()
    assert np.allclose(as_array(H.matvec(one, vec(spark, v)), 300), k @ v, atol=1e-5)


def test_hodlr_solves_and_takes_many_vectors(spark, cloud):
    points, k = cloud
    h = H.add_identity(H.build(C.bisect(points, 16), C.admissible("offdiag"), dense.Acc(rel=1e-11), lambda x, y: 0.3 * gaussian(x, y)))
    f = H.hodlr_factors(h)
    for seed in (5, 6):
        v = np.random.default_rng(seed).standard_normal(300)
        assert np.allclose(as_array(H.hodlr_solve(f, vec(spark, v)), 300), np.linalg.solve(np.eye(300) + 0.3 * k, v), atol=1e-6)
    single = H.build(C.bisect(points, 400), C.admissible("offdiag"), dense.Acc(rel=1e-11), gaussian)  # one leaf
    v = np.ones(300)
    assert np.allclose(as_array(H.hodlr_solve(H.hodlr_factors(H.add_identity(single)), vec(spark, v)), 300), np.linalg.solve(np.eye(300) + k, v), atol=1e-8)


def test_nested_bases_of_several_levels(spark, cloud):
    points, k = cloud
    v = np.random.default_rng(8).standard_normal(300)
    got = H.matvec_nested(C.bisect(points, 8), C.admissible("strong"), vec(spark, v), gaussian, order=7)
    assert np.allclose(as_array(got, 300), k @ v, atol=1e-4)


def test_sparse_entries_become_blocks(spark):
    rng = np.random.default_rng(9)
    a = np.where(rng.random((60, 60)) < 0.1, rng.standard_normal((60, 60)), 0)
    a[:, 40:] = 0
    coo = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v double")
    points = spark.range(60).select("id", F.array(F.col("id").cast("double")).alias("x"))
    h = H.from_entries(coo, C.bisect(points, 8), C.admissible("offdiag", dim=1), 32, dense.Acc(rel=1e-12))
    v = rng.standard_normal(60)
    assert np.allclose(as_array(H.matvec(h, vec(spark, v)), 60), a @ v, atol=1e-9)


def test_cross_approximation_finds_what_its_terms_do_not_touch():
    a = np.zeros((60, 50))
    a[:30, :25] = np.outer(np.arange(1, 31), np.ones(25))
    a[30:, 25:] = np.outer(np.ones(30), np.arange(1, 26))
    _, _, u, v = dense.cross(lambda i: a[i], lambda j: a[:, j], 60, 50, dense.Acc(rel=1e-10))
    assert np.allclose(u @ v.T, a)
    rows, _, u, v = dense.cross(lambda i: np.zeros(4), lambda j: np.zeros(3), 3, 4, dense.Acc(rel=1e-10))
    assert not rows and u.shape == (3, 0)


def coo(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v double")


def test_tall_matrices_with_gaps_and_without_full_rank(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((200, 4))
    a[rng.random(a.shape) < 0.4] = 0
    a[7] = 0
    assert np.allclose(np.abs(tall.tsqr(coo(spark, a), 4)), np.abs(np.linalg.qr(a[np.abs(a).sum(axis=1) > 0], mode="r")), atol=1e-9)
    low = a[:, :2] @ rng.standard_normal((2, 4))
    q = tall.q_rows(coo(spark, low), 4)
    r = tall.orthonormal_report(q).first()
    assert r["columns"] == 2 and r["off"] < 1e-12
    u, v = tall.truncated(tall.rows_of(coo(spark, low), 4), tall.rows_of(coo(spark, rng.standard_normal((5, 4)) + 1), 4), dense.Acc(rel=1e-12))
    assert u.agg(F.max("m")).first()[0] == 2 == v.agg(F.max("m")).first()[0]
    tiny = np.array([[1.0, 2.0, 0.0], [2.0, 4.0, 0.0], [0.0, 0.0, 0.0], [3.0, 6.0, 1e-9]])
    x, y = tall.truncated(tall.rows_of(coo(spark, tiny), 3), tall.rows_of(coo(spark, np.eye(3)), 3), dense.Acc(rel=1e-14))
    got = {(r.i, r.j): r.v for r in tall.product(x, y).collect()}
    assert all(abs(got.get((i, j), 0) - tiny[i, j]) < 1e-12 for i in range(4) for j in range(3))


def test_randomised_singular_values_at_a_rank_below_the_columns(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((150, 5)) @ rng.standard_normal((5, 40)) + 1e-6 * rng.standard_normal((150, 40))
    u, v = tall.randsvd(coo(spark, a), 5, power=2)
    got = np.zeros(a.shape)
    for r in tall.product(u, v).collect():
        got[r["i"], r["j"]] = r["v"]
    best = np.sqrt((np.linalg.svd(a, compute_uv=False)[5:] ** 2).sum())
    assert np.linalg.norm(a - got) <= 1.05 * best


def test_many_tall_matrices_side_by_side(spark):
    rng = np.random.default_rng(4)
    all_of = {k: rng.standard_normal((30 + k, 3)) for k in range(6)}
    rows = spark.createDataFrame([(k, 3, row.tolist()) for k, m in all_of.items() for row in m], "key int, m int, x array<double>").repartition(5)
    for r in tall.triangles(rows, ["key"]).collect():
        x = np.array(r["r"]).reshape(3, 3)
        assert np.allclose(x.T @ x, all_of[r["key"]].T @ all_of[r["key"]])


@pytest.mark.parametrize("name", list(kernels.DEFAULTS))
def test_kernels_of_arrays_and_columns_agree(spark, name):
    x = np.random.default_rng(5).random((6, 2))
    points = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, x array<double>")
    a = {(r.i, r.j): r.v for r in kernels.entries(points, name, kernels.DEFAULTS[name]).collect()}
    b = {(r.i, r.j): r.v for r in kernels.entries(points, lambda r: kernels.column(name, r, **kernels.DEFAULTS[name]), {}).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_loops_that_do_not_converge_warn(spark):
    rng = np.random.default_rng(6)
    a = rng.standard_normal((4, 4))
    m = B.to_blocks(coo(spark, a), 4, 4, 2, 2)
    x = B.segments(vec(spark, np.ones(4)), 2, 4)
    with pytest.warns(RuntimeWarning, match="not met its tolerance"):
        S.spectral_norm(lambda v: B.matvec(m, v), lambda v: B.matvec(B.transpose(m), v), x, tol=0.0, maxit=2)
    with pytest.warns(RuntimeWarning, match="not met its tolerance"):
        S.refine(lambda v: B.matvec(m, v), lambda r: r, x, tol=1e-12, maxit=2)


def test_solves_with_blocks_on_either_side(spark):
    rng = np.random.default_rng(7)
    t, b = np.tril(rng.standard_normal((7, 7))) + 5 * np.eye(7), rng.standard_normal((7, 3))
    tri, rhs = B.to_blocks(coo(spark, t), 7, 7, 3, 3), B.to_blocks(coo(spark, b), 7, 3, 3, 2)
    for lower, m in ((True, t), (False, t.T)):
        f = tri if lower else B.transpose(tri)
        for transposed in (False, True):
            want = np.linalg.solve(m.T if transposed else m, b)
            got = {(r.i, r.j): r.v for r in B.to_coo(S.substitute_blocks(f, rhs, lower, transposed, unit=False)).collect()}
            assert all(abs(got[i, j] - want[i, j]) < 1e-9 for i in range(7) for j in range(3))
            right = {(r.i, r.j): r.v for r in B.to_coo(S.substitute_right(f, B.transpose(rhs), lower, transposed, unit=False)).collect()}
            want = np.linalg.solve(m if transposed else m.T, b).T
            assert all(abs(right[j, i] - want[j, i]) < 1e-9 for i in range(7) for j in range(3))


def test_single_precision_factors_are_single(spark):
    rng = np.random.default_rng(8)
    a = rng.standard_normal((6, 6)) + 6 * np.eye(6)
    m = B.to_blocks(coo(spark, a), 6, 6, 3, 3)
    for single in (False, True):
        f = {(r.i, r.j): r.v for r in B.to_coo(S.lu_blocks(m, single=single)).collect()}
        full = np.array([[f[i, j] for j in range(6)] for i in range(6)])
        off = np.abs((np.tril(full, -1) + np.eye(6)) @ np.triu(full) - a).max()
        assert off < 1e-12 if not single else 1e-9 < off < 1e-4
        assert np.array_equal(full, full.astype(np.float32)) == single
