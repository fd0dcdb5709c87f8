"""What large tables ask for: much work spread over all cores, values made once, arrays instead of objects."""

from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import dense, kernels
from tilewright.operators import blocks as B
from tilewright.operators import clusters as C
from tilewright.operators import hmatrix as H
from tilewright.operators import solvers as S
from tilewright.sources.storage import durable


def _leaves(spark, n=600, tile=16):
    x = np.random.default_rng(5).random((n, 3))
    points = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, x array<double>")
    return x, durable(C.bisect(points, tile), "leaves")


@pytest.fixture
def written(monkeypatch):
    """(name, table) of what hmatrix writes."""
    seen = []

    def run(df, name="step"):
        seen.append((name, df))
        return durable(df, name)

    monkeypatch.setattr(H, "durable", run)
    return seen


def test_pivots_use_all_cores(spark, written):
    """Blocks are small rows with much work: by their bytes alone, all of them met in one task."""
    leaves = _leaves(spark)[1]
    cores = spark.sparkContext.defaultParallelism
    H.build(leaves, C.admissible("strong"), dense.Acc(rel=1e-3))
    assert dict(written)["pivots"].rdd.getNumPartitions() >= 4 * cores
    assert H.memory_plan(leaves, C.admissible("weak"), dense.Acc(rel=1e-3)).rdd.getNumPartitions() >= 4 * cores


def test_gathered_clusters_are_plain_arrays(spark, written):
    """Lists of structs are Python objects in tasks, about ten times the bytes of the points."""
    x, leaves = _leaves(spark, 200)
    h = H.build(leaves, C.admissible("strong", eta=4.0), dense.Acc(rel=1e-9), far="aca")
    assert "struct" not in dict(written)["gathered"].schema.simpleString()[len("struct"):]
    got = dict(H.matvec(h, H.ones(h)).collect())
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2)).sum(axis=1)
    assert h.parts.where("adm").count() and np.allclose([got[i] for i in range(200)], want, atol=1e-6)


def test_nested_product_stores_no_blocks(spark, written):
    x, leaves = _leaves(spark, 300)
    w = spark.range(300).select(F.col("id").alias("i"), (F.col("id") % 3 + 1.0).alias("v"))
    got = dict(H.matvec_nested(leaves, C.admissible("strong"), w, order=8).collect())
    assert not {"near", "far", "pivots"} & {name for name, _ in written}
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2)) @ (np.arange(300) % 3 + 1.0)
    assert np.allclose([got[i] for i in range(300)], want, rtol=1e-6)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 40])
def test_log_kernel_by_diagonals(spark, monkeypatch, n):
    """A value is made once for each diagonal; rows come in runs, without a join of all pairs."""
    monkeypatch.setattr(kernels, "RUN", 3)
    made = kernels.log_kernel_entries(spark, n)
    plan = made._jdf.queryExecution().toString()
    assert "Join" not in plan and "Cartesian" not in plan
    rows = [(r.i, r.j, r.v) for r in made.collect()]
    assert len(rows) == len({r[:2] for r in rows}) == n * n
    q = lambda m: m * m * np.log(m) if m > 0 else 0.0
    for i, j, v in rows:
        m = abs(i - j)
        assert v == pytest.approx((1.5 + np.log(n) - (q(m + 1) + q(abs(m - 1)) - 2 * q(m)) / 2) / n**2, abs=1e-12)


@pytest.mark.parametrize("kernel", sorted(set(kernels.DEFAULTS) - {"thin_plate", "helmholtz"}))
def test_kernel_blocks_need_few_copies(kernel):
    x = np.random.default_rng(2).random((400, 3))
    y = np.vstack([x[:3], x[:397] + 0.25])
    tracemalloc.start()
    got = kernels.array(kernel, x, y, **kernels.DEFAULTS[kernel])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.5 * got.nbytes
    assert np.isfinite(got).all()


@pytest.mark.parametrize("count", [1, 2, 9])
def test_lagrange_reproduces_polynomials(count):
    axis = np.sort(np.random.default_rng(count).random(count))
    x = np.random.default_rng(9).random((20, 2))
    for power in range(count):
        at = dense.grid_points([axis, axis])
        assert np.allclose(dense.lagrange(x, [axis, axis]) @ (at[:, 0] ** power * at[:, 1]) if count > 1 else dense.lagrange(x, [axis, axis])[:, 0], x[:, 0] ** power * x[:, 1] if count > 1 else 1.0, atol=1e-5)


def test_sparse_blocks_stay_entries_where_factors_would_be_larger(spark):
    """Random blocks have full rank: with a rank of at most 3 they were cut, and with a high one factors were many times the entries."""
    rng = np.random.default_rng(8)
    n = 96
    a = np.where(rng.random((n, n)) < 0.04, rng.standard_normal((n, n)), 0.0)
    a[48:72, 72:96] = np.outer(rng.random(24) + 1, rng.random(24) + 1)  # one block of rank 1
    rows = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "i long, j long, v double")
    points = spark.range(n).select("id", F.array(F.col("id").cast("double")).alias("x"))
    h = H.from_entries(rows, C.bisect(points, 12), C.admissible("offdiag", dim=1), 3, dense.Acc(rel=1e-12))
    assert [(r.rcid, r.ccid, r.k) for r in h.far.select("rcid", "ccid", "k").distinct().collect()] == [(6, 7, 1)]
    assert h.light.select(F.sum(F.size("v"))).first()[0] + h.near.count() * 12 <= np.count_nonzero(a) + 8 * 12 * 12
    v = rng.standard_normal(n)
    x = durable(spark.createDataFrame([(i, float(z)) for i, z in enumerate(v)], "i long, v double"), "x")
    for made, want in ((H.matvec(h, x), a @ v), (H.matvec(h, x, transposed=True), a.T @ v), (H.matvec(H.with_dense_tiles(h), x), a @ v)):
        got = dict(made.collect())
        assert np.allclose([got.get(i, 0.0) for i in range(n)], want, atol=1e-9)
    dense_form = H.converted(h, 60, dense.Acc(rel=1e-12))
    got = dict(H.matvec(dense_form, x).collect())
    assert np.allclose([got.get(i, 0.0) for i in range(n)], a @ v, atol=1e-7)


def _triangle_made(spark, monkeypatch, lower):
    """(triangle in tiles of 7 and pieces of 3 whose entries refuse larger ones, the same as an array)."""
    monkeypatch.setattr(S, "PIECE", 3, raising=False)
    monkeypatch.setattr(S, "ACROSS", 2, raising=False)
    x = np.random.default_rng(11).random((45, 3))
    points = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(x)], "id long, x array<double>")

    def entry(i, j, a, b):
        assert max(len(i), len(j)) <= 3, "a block is made as a whole"
        return (i[:, None] == j[None, :]) + 0.1 * a[:, None, 0] * b[None, :, 1]

    def part(b):
        if b.bi == b.bj:
            return b.like(d=np.tril(b.d) if lower else np.triu(b.d))
        return b if (b.bi > b.bj) == lower else None

    whole = np.eye(45) + 0.1 * x[:, :1] * x[:, 1][None]
    return S.kernel_blocks(points, 7, entry).cut(part, "lower" if lower else "upper"), np.tril(whole) if lower else np.triu(whole)


@pytest.mark.parametrize("lower", [True, False])
def test_made_blocks_are_never_whole(spark, monkeypatch, lower):
    """Products and solves make blocks piece by piece; right sides may lack blocks or be of low rank."""
    made, t = _triangle_made(spark, monkeypatch, lower)
    x = durable(B.segments(spark.createDataFrame([(i, i + 1.0) for i in range(45)], "i long, v double"), 7, 45), "x")
    flat = lambda s: np.concatenate([r["x"] for r in sorted(s.collect())])
    right = np.add.outer(np.arange(45.0), np.arange(3.0)) ** 2
    right[14:28] = 0.0
    dense = durable(B.to_blocks(spark.createDataFrame([(i, j, float(right[i, j])) for i in range(45) for j in range(3) if right[i].any()], "i long, j long, v double"), 45, 3, 7, 2), "right")
    assert dense.count() == 10
    for flip in (False, True):
        m, a = (made.transposed(), t.T) if flip else (made, t)
        assert np.allclose(flat(m.matvec(x)), a @ np.arange(1, 46))
        assert np.allclose(flat(S.substitute(made, x, lower, flip, unit=False)), np.linalg.solve(a, np.arange(1, 46)))
        for b in (dense, B.lowrank(dense)):
            for got, want in ((m.matmul(b), a @ right), (S.substitute_blocks(made, b, lower, flip, unit=False), np.linalg.solve(a, right))):
                seen = np.zeros((45, 3))
                for r in B.to_coo(got).collect():
                    seen[r.i, r.j] += r.v
                assert np.allclose(seen, want)


def test_tasks_of_made_products_meet_few_tiles(spark, monkeypatch):
    """All pairs of tiles with their right sides went through as many tasks as there are cores, in batches that grew with their square."""
    made = _triangle_made(spark, monkeypatch, True)[0]
    x = durable(B.segments(spark.createDataFrame([(i, 1.0) for i in range(45)], "i long, v double"), 7, 45), "x")
    met = made.pairs(x.select(F.col("b").alias("bj"), F.col("x").alias("z"))).select("bi", "bj", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.bi, r.bj) for r in met) == [(i, j) for i in range(7) for j in range(i + 1)]
    tasks = {}
    for r in met:
        tasks.setdefault(r.task, []).append(r)
    assert all(len({r.bi for r in rows}) == 1 and len(rows) <= 2 * S.ACROSS for rows in tasks.values())


def test_steps_of_a_solve_do_not_shuffle(spark, monkeypatch):
    made = _triangle_made(spark, monkeypatch, True)[0]
    x = durable(B.segments(spark.createDataFrame([(i, 1.0) for i in range(45)], "i long, v double"), 7, 45), "x")
    plans = []

    def run(df, name="step"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return durable(df, name)

    monkeypatch.setattr(S, "durable", run)
    S.substitute(made, x, lower=True, unit=False)
    steps = [plan for name, plan in plans if name in ("own", "rhs")][1:]
    assert len(steps) == 7 + 6 and not any(re.search(r"Exchange (hash|range|round)", plan) for plan in steps)


@pytest.mark.parametrize("lower", [True, False])
def test_steps_of_a_solve_take_several_tiles(spark, monkeypatch, lower):
    """A step for each of 23 tiles wrote 45 tables of many files; the last step may be shorter, right sides may lack blocks, be mixed or of low rank."""
    base, t = _triangle_made(spark, monkeypatch, lower)
    points = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(np.random.default_rng(11).random((45, 3)))], "id long, x array<double>")
    made, written = S.kernel_blocks(points, 2, base.entry).cut(base.part, base.half), []
    right = np.add.outer(np.arange(45.0), np.arange(3.0)) ** 2
    right[6:11] = 0.0
    dense = durable(B.to_blocks(spark.createDataFrame([(i, j, float(right[i, j])) for i in range(45) for j in range(3) if right[i].any()], "i long, j long, v double"), 45, 3, 2, 2), "right")
    low = B.lowrank(dense)

    def run(df, name="step"):
        written.append(name)
        return durable(df, name)

    monkeypatch.setattr(S, "durable", run)
    for flip, b in ((False, dense), (True, low), (False, dense.where("bi % 2 = 0").unionByName(low.where("bi % 2 = 1")))):
        m, a = (made.transposed(), t.T) if flip else (made, t)
        written.clear()
        seen = np.zeros((45, 3))
        for r in B.to_coo(S.substitute_blocks(made, b, lower, flip, unit=False)).collect():
            seen[r.i, r.j] += r.v
        assert np.allclose(seen, np.linalg.solve(a, right)) and m.steps == 23
        assert written.count("own") == 8 and written.count("rhs") == 8


@pytest.mark.parametrize("kernel", sorted(kernels.DEFAULTS))
def test_expanded_squares_lose_no_digits(kernel):
    """Far from the origin, with copies, near copies and points out of range, strips of expanded squares give what differences give."""
    rng = np.random.default_rng(4)
    x = rng.random((150, 3)) + 1000.0
    y = np.vstack([x[:5], x[5:9] + 1e-7, rng.random((120, 3)) + 1000.0])
    for a, b in ((x, y), (x[:3], x[:3]), (np.vstack([x, [[1e200, 0.0, 0.0]]]), y)):
        square, want = kernels.expanded(a, b), kernels.array(kernel, a, b, **kernels.DEFAULTS[kernel])
        for at in range(0, len(a), kernels.STRIP):
            rows = slice(at, at + kernels.STRIP)
            got = kernels.of_squares(kernel, square(rows), **kernels.DEFAULTS[kernel])
            assert np.allclose(got, want[rows], rtol=1e-11, atol=1e-12, equal_nan=True)


def test_sums_take_squares_by_products(spark, monkeypatch):
    """Differences, nine passes over a block, are left to close points."""
    x = np.random.default_rng(6).random((300, 3))
    p = spark.createDataFrame([(i, z.tolist()) for i, z in enumerate(x)], "id long, x array<double>")
    want = kernels.array("gaussian", x, x, eps=2.0).sum(axis=1)
    monkeypatch.setattr(kernels, "squares", None)
    tile = type("Row", (), {"t": 0, "u": 1, "dim": 3, "xs": x[:150].ravel(), "ys": x[150:].ravel()})
    seen = {}
    monkeypatch.setattr(kernels, "mapped_sum", lambda rows, f, schema: seen.update(f=f) or rows.sparkSession.createDataFrame([], schema))
    kernels.sums(p, "gaussian", {"eps": 2.0})
    (_, rows), (_, cols) = seen["f"](tile)
    some = kernels.of_squares("gaussian", ((x[:150, None] - x[None, 150:]) ** 2).sum(axis=2), eps=2.0)
    assert np.allclose(rows, some.sum(axis=1)) and np.allclose(cols, some.sum(axis=0)) and (want[:150] > rows).all()
