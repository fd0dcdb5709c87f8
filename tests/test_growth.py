"""Findings of round 4: errors of whole queries, and what they write and hold as tables grow."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import dense
from tilewright.operators import blocks as B
from tilewright.operators import clusters as C
from tilewright.operators import hmatrix as H
from tilewright.operators import solvers as S
from tilewright.sources.storage import durable


def _cloud(spark, n, tile=16):
    x = np.random.default_rng(7).random((n, 3))
    points = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, x array<double>")
    return x, points, durable(C.bisect(points, tile), "leaves")


def _square(x, y):
    return ((x[:, None] - y[None]) ** 2).sum(axis=2)


def test_kernel_of_a_matrix_by_default():
    x, y = np.random.default_rng(1).random((7, 3)), np.random.default_rng(2).random((4, 3))
    assert np.allclose(H.gaussian(x, y), np.exp(-_square(x, y)), rtol=1e-14)


def _system(n, tile):
    a = np.eye(n) + 0.1 * np.random.default_rng(3).random((n, n)) / n
    return a, [B.Block(i, j, i * tile, j * tile, *(d := a[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile]).shape, d=d) for i in range(-(-n // tile)) for j in range(-(-n // tile))]


def _table(spark, blocks):
    return durable(spark.createDataFrame([tuple(x.tolist() if isinstance(x, np.ndarray) else x for x in b.row()) for b in blocks], B.SCHEMA), "table")


def _matrix(blocks, n, cols=None):
    out = np.zeros((n, cols or n))
    for r in blocks.collect():
        b = B.Block.of(r)
        out[b.r0 : b.r0 + b.nr, b.c0 : b.c0 + b.nc] += b.dense()
    return out


def test_triangles_by_halves():
    rng = np.random.default_rng(11)
    for n in (1, 63, 64, 65, 200):
        t, b = np.eye(n) + rng.random((n, n)) / n, rng.random((n, 3))
        assert np.allclose(np.tril(t) @ S._forward(np.tril(t), b), b, atol=1e-12) and np.allclose(np.triu(t) @ S._backward(np.triu(t), b[:, 0]), b[:, 0], atol=1e-12)
        assert S._forward(np.tril(t).astype(np.float32), b.astype(np.float32)).dtype == np.float32


def test_blocks_of_a_step_are_updated_in_many_tasks(spark):
    """A join of a panel's column and row by the step's index put all pairs into one task."""
    n, tile = 52, 5
    a, blocks = _system(n, tile)
    m = _table(spark, blocks)
    left, right = m.where("bj = 0 and bi > 0"), m.where("bi = 0 and bj > 0")
    made = S._updated(m.where("bi > 0 and bj > 0"), left, right, 0, dense.TIGHT)
    spread = [r["n"] for r in made.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(spread) == 100 and max(spread) <= 50
    assert np.allclose(_matrix(made, n)[tile:, tile:], a[tile:, tile:] - a[tile:, :tile] @ a[:tile, tile:], atol=1e-13)


def test_factors_are_written_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(S, "durable", lambda df, name="step", under="": seen.append(name) or durable(df, name, under))
    a, blocks = _system(23, 5)
    f = _matrix(S.lu_blocks(_table(spark, blocks)), 23)
    assert np.allclose((np.tril(f, -1) + np.eye(23)) @ np.triu(f), a, atol=1e-13) and "factors" not in seen
    assert np.allclose(_matrix(S.invert(_table(spark, blocks)), 23) @ a, np.eye(23), atol=1e-12)


@pytest.mark.parametrize("tile", [4, 9])
def test_products_by_squares(spark, monkeypatch, tile):
    """Blocks of two tilings, some absent, some of low rank: as the product by inner index, without shuffling a product."""
    monkeypatch.setattr(B, "TILE", 10)
    a, blocks = _system(33, tile)
    b, others = _system(33, tile)
    u, v = np.random.default_rng(4).random((2, blocks[1].nr, 1))
    blocks[1], others[3] = B.Block(*[getattr(blocks[1], x) for x in ("bi", "bj", "r0", "c0", "nr", "nc")], u=u, v=np.resize(v, (blocks[1].nc, 1))), None
    x, y = _table(spark, blocks), _table(spark, [o for o in others if o is not None])
    made = B.matmul(x, y, size=33)
    assert np.allclose(_matrix(made, 33), _matrix(x, 33) @ _matrix(y, 33), atol=1e-12)
    assert made.groupBy("bi", "bj").count().where("count > 1").isEmpty()
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1


def test_eigenvalue_iteration_keeps_one_step(spark, tmp_path, monkeypatch):
    """Products and steps that nothing reads any more are removed, the caller's tables are not."""
    dropped = []
    monkeypatch.setattr(S, "forget", lambda t: dropped.append(t))
    n, tile = 12, 5
    a = np.diag(np.arange(n) + 1.0) + 1e-3 * (np.ones((n, n)) - np.eye(n))
    cut = lambda m: [B.Block(i, j, i * tile, j * tile, *(d := m[i * tile : (i + 1) * tile, j * tile : (j + 1) * tile]).shape, d=d) for i in range(3) for j in range(3)]
    diagonal = B.segments(spark.createDataFrame([(i, i + 1.0) for i in range(n)], "i long, v double"), tile, n)
    values, vectors = S.eigen_ipt_vectors(diagonal, _table(spark, cut(a - np.diag(np.diag(a)))), _table(spark, cut(np.eye(n))))
    got = {r.i: r.v for r in B.flat(values, tile).collect()}
    assert np.allclose(sorted(got.values()), np.linalg.eigvalsh(a), atol=1e-10) and dropped
    v = _matrix(vectors, n)
    assert np.allclose(a @ v, v * np.array([got[i] for i in range(n)]), atol=1e-9)


@pytest.mark.parametrize("far", ["hca", "interpolation"])
def test_a_product_writes_no_blocks(spark, monkeypatch, far):
    """Near blocks and factors are made where they meet the vector; they were written before, many times the points."""
    seen = []
    monkeypatch.setattr(H, "durable", lambda df, name="step", under="": seen.append(name) or durable(df, name, under))
    x, _, leaves = _cloud(spark, 260)
    h = H.build(leaves, C.admissible("strong", eta=4.0), dense.Acc(rel=1e-9), far=far)
    w = spark.range(260).select(F.col("id").alias("i"), (F.col("id") % 3 + 1.0).alias("v"))
    got, flipped = dict(H.matvec(h, w).collect()), dict(H.matvec(h, w, transposed=True).collect())
    want = np.exp(-_square(x, x)) @ (np.arange(260) % 3 + 1.0)
    assert h.parts.where("adm").count() and "pivots" in seen and not {"near", "far"} & set(seen)
    assert np.allclose([got[i] for i in range(260)], want, rtol=1e-7) and np.allclose([flipped[i] for i in range(260)], want, rtol=1e-7)
    one = h.far.where("side = 'c'")._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("MapInPandas") == 1
    kept = H.stored(h)
    assert sorted(H.stored(kept).far.inputFiles()) == sorted(kept.far.inputFiles()) != []
