"""Edge cases of the operators on small made tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import dense
from tilewright.operators import blocks as B
from tilewright.operators import clusters as C
from tilewright.operators import coo
from tilewright.operators import solvers as S
from tilewright.sources import storage


def table(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, v double")


def values(df):
    return {tuple(r)[:-1]: r["v"] for r in df.collect()}


def test_empty_tables(spark):
    none = table(spark, [])
    assert coo.matmul(none, none).count() == 0 and coo.add(1.0, none, 1.0, none).count() == 0
    assert coo.csr_row_ptr(none).count() == 0 and coo.norm_frobenius(none).first()["norm"] is None
    assert B.to_blocks(none, 4, 4, 2, 2).count() == 0
    points = spark.createDataFrame([], "id long, x array<double>")
    assert C.grid(points, 4).count() == 0 and C.bisect(points, 4).count() == 0 and C.curve(points, 4).count() == 0


def test_bad_entries_are_flagged(spark):
    a = table(spark, [(0, 0, 1.0), (0, 1, float("nan")), (1, 0, float("-inf")), (1, 1, None)])
    assert coo.bad_entries(a).count() == 3


def test_hot_column(spark):
    """One column holds half of all entries; salting changes nothing in the result."""
    rows = [(i, 7, 1.0) for i in range(500)] + [(i, i % 50, 2.0) for i in range(500)]
    a = table(spark, rows)
    x = spark.createDataFrame([(j, float(j)) for j in range(50)], "i long, v double")
    assert values(coo.matvec(a, x)) == pytest.approx(values(coo.matvec(a, x, salt=8)))


def test_duplicate_points_and_one_cluster(spark):
    p = spark.createDataFrame([(i, [0.5, 0.5, 0.5]) for i in range(20)], "id long, x array<double>")
    assert {r.cid for r in C.grid(p, 4).collect()} == {0}
    sizes = C.bisect(p, 4).groupBy("cid").count().collect()
    assert sum(r["count"] for r in sizes) == 20 and max(r["count"] for r in sizes) <= 4
    assert C.bisect(p, 100).select("cid").distinct().count() == 1


def test_ragged_blocks_and_zero_blocks(spark):
    rng = np.random.default_rng(0)
    d = rng.standard_normal((7, 5))
    d[3:6, 3:5] = 0
    rows = [(i, j, float(d[i, j])) for i in range(7) for j in range(5) if d[i, j]]
    t = B.to_blocks(table(spark, rows), 7, 5, 3, 3)
    assert t.count() == 5  # the zero block is absent
    back = {k: v for k, v in values(B.to_coo(B.lowrank(t))).items() if abs(v) > 1e-12}
    assert back == pytest.approx({(i, j): v for i, j, v in rows})
    one = B.to_blocks(table(spark, [(0, 0, 2.0)]), 1, 1, 3, 3)
    assert values(B.to_coo(B.matmul(one, B.lowrank(one)))) == {(0, 0): 4.0}


def test_zero_pivot_raises():
    with pytest.raises(ZeroDivisionError):
        S._lu(np.array([[0.0, 1.0], [1.0, 0.0]]))


def test_solver_on_a_general_matrix(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((10, 10)) + 10 * np.eye(10)
    t = B.to_blocks(table(spark, [(i, j, float(m[i, j])) for i in range(10) for j in range(10)]), 10, 10, 4, 4)
    b = rng.standard_normal(10)
    rhs = B.segments(spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, v double"), 4, 10)
    f = S.lu_blocks(t)
    for transposed, want in ((False, np.linalg.solve(m, b)), (True, np.linalg.solve(m.T, b))):
        got = values(B.flat(S.lu_solve(f, rhs, transposed), 4))
        assert [got[(i,)] for i in range(10)] == pytest.approx(want.tolist())
    inverse = values(B.to_coo(S.invert(t)))
    assert np.allclose([[inverse[i, j] for j in range(10)] for i in range(10)], np.linalg.inv(m))


def test_triplets_with_wrong_fields_fail(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("row,col,value\n3\n\n1,1,2.5\n3,2,-1e-3\n")
    assert values(storage.read_triplets(spark, str(path))) == {(0, 0): 2.5, (2, 1): -1e-3}
    path.write_text("row,col,value\n3\n1,1\n")
    with pytest.raises(Exception, match="not three fields"):
        storage.read_triplets(spark, str(path)).collect()


def test_structure_errors_are_reported(spark):
    a, b = table(spark, [(0, 0, 1.0), (5, 5, 1.0)]), table(spark, [(0, 0, 1.1)])
    got = {(r.bi, r.bj): r.status for r in coo.compare(a, b, 4, 1e-3).collect()}
    assert got == {(0, 0): "error", (1, 1): "structure"}


def test_owner_needs_a_product(spark):
    blocks = spark.createDataFrame([(0, 0)], "bi int, bj int")
    with pytest.raises(ValueError):
        C.owners(blocks, 7, "cyclic2d")


def test_triplets_with_one_number_in_the_midst_fail(spark, tmp_path):
    path = tmp_path / "m.csv"
    for bad in ("a,1", "5", "1,2,3,4"):
        path.write_text(f"row,col,value\n3\n1,1,2.5\n{bad}\n")
        with pytest.raises(Exception, match="not three fields"):
            storage.read_triplets(spark, str(path)).collect()


def test_triplet_heads_are_told_by_place(spark, tmp_path):
    path = tmp_path / "m.csv"
    for text, wrong in (("1,1,5\nabc\n2,2,6\n7\n3,3,1\n", "no header"), ("row,col,value\n1,1,5\n3\n", "no header"), ("row,col,value\n3\n1,1,5\nabc\n", "not three fields"), ("3\n3\n3\n", "not three fields")):
        path.write_text(text)
        with pytest.raises(Exception, match=wrong):
            storage.read_triplets(spark, str(path)).collect()
    path.write_text("\n7 rows,\n2\n2,2,4\n")  # the first line is the header, whatever it says
    assert values(storage.read_triplets(spark, str(path))) == {(1, 1): 4.0}


def test_raw_tensor_files(spark, tmp_path):
    x = np.arange(24.0).reshape(4, 3, 2)
    (tmp_path / "t.bin").write_bytes(storage.raw_bytes(x))
    got = {(r.i0, r.i1, r.i2): r.v for r in storage.read_raw_files(spark, str(tmp_path / "t.bin"), 4, 3, 2).collect()}
    assert got == {i: x[i] for i in np.ndindex(4, 3, 2)}
    with pytest.raises(Exception, match="wrong length"):
        storage.read_raw_files(spark, str(tmp_path / "t.bin"), 4, 3, 3).collect()


def test_half_precision(spark):
    values_ = [0.0, 1.0, -1.1, 65504.0, 65519.0, 65520.0, -1e6, 6e-8, 1e-8, 3.3e-5, 2049.0, 2051.0]
    rows = coo.to_half(spark.createDataFrame([(i, 0, v) for i, v in enumerate(values_)], "i long, j long, v double")).collect()
    with np.errstate(over="ignore"):
        assert {r.i: r.v for r in rows} == {i: float(np.float16(v)) for i, v in enumerate(values_)}


@pytest.mark.parametrize("how", ["ipt", "jacobi", "swept"])
def test_eigenvectors(spark, how):
    """M V = V E with orthonormal V, for tiles that do not divide the size; the swept form starts far from diagonal."""
    r = np.random.default_rng(6).standard_normal((10, 10))
    m = np.diag(np.arange(10) + 1.0) + (0.002 if how == "ipt" else 0.3) * (r + r.T)
    t = lambda a: B.to_blocks(table(spark, [(i, j, float(a[i, j])) for i in range(10) for j in range(10) if a[i, j]]), 10, 10, 4, 4)
    if how == "ipt":
        diag = B.segments(spark.createDataFrame([(i, float(m[i, i])) for i in range(10)], "i long, v double"), 4, 10)
        e, v = S.eigen_ipt_vectors(diag, t(m - np.diag(np.diag(m))), t(np.eye(10)))
    else:
        e, v = (S.eigen_jacobi_vectors if how == "jacobi" else S.eigen_swept)(t(m))
    vectors, found = np.zeros((10, 10)), np.concatenate([x["x"] for x in e.orderBy("b").collect()])
    for r in B.to_coo(v).collect():
        vectors[r.i, r.j] = r.v
    assert np.allclose(m @ vectors, vectors * found, atol=1e-7) and np.allclose(vectors.T @ vectors, np.eye(10), atol=1e-7)
    assert np.allclose(sorted(found), np.linalg.eigvalsh(m), atol=1e-8)


def test_dense_joins_are_bounded(spark):
    r = np.random.default_rng(1).standard_normal((16, 16))
    t = B.to_blocks(table(spark, [(i, j, float(r[i, j])) for i in range(16) for j in range(16)]), 16, 16, 2, 2)
    got = B.coarsened(t, dense.Acc(rel=1e-12), 4, most=8)
    assert {(b.nr, b.nc) for b in got.collect()} == {(8, 8)}
    back = np.zeros((16, 16))
    for e in B.to_coo(got).collect():
        back[e.i, e.j] = e.v
    assert np.allclose(back, r)


def test_log_lines_keep_their_order_when_sorts_spill(spark, tmp_path):
    """The last value of each kind counts, so lines must be written by event, whatever the writer's sort does."""
    from tilewright.plans import registry

    key = "spark.shuffle.spill.numElementsForceSpillThreshold"
    t = spark.range(3000).select(
        F.col("id").alias("event_id"), F.lit("view").alias("event_type"), (F.col("id") * 3).alias("user_id"), (F.col("id") / 4).alias("value")
    )
    t.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf()  # sorts of a local session read it there
    env.set(key, "50")
    try:
        got = {r["blas"]: (r["time"], r["mem"]) for r in registry.queries()["io10_read_bench_logs"](spark, str(tmp_path)).collect()}
    finally:
        env.remove(key)
    assert got == {str(k): ((2996 + k) / 4, (996 + k) * 1000) for k in range(4)}


def test_frames_of_tasks_are_bounded():
    """However many rows a batch has, what a task makes of them leaves in frames of bounded size."""
    from tilewright.operators import arrays

    half = arrays.FRAME_NUMBERS // 2
    blocks = (B.Block(0, j, 0, 0, 1, half, d=np.zeros((1, half))) for j in range(7))
    assert [len(f) for f in B.frames(blocks)] == [2, 2, 2, 1]


def test_blocks_made_in_tasks_solve_like_stored_ones(spark):
    rng = np.random.default_rng(2)
    x = rng.random((11, 3))
    p = spark.createDataFrame([(i, x[i].tolist()) for i in range(11)], "id long, x array<double>")
    k = S.kernel_blocks(p, 4, lambda i, j, a, b: (i[:, None] == j[None, :]) + 0.1 * a[:, None, 0] * b[None, :, 1])
    a = np.eye(11) + 0.1 * x[:, :1] * x[:, 1][None]
    v = B.segments(spark.createDataFrame([(i, float(i + 1)) for i in range(11)], "i long, v double"), 4, 11)
    right = B.to_blocks(spark.createDataFrame([(i, j, float(i + 2 * j + 1)) for i in range(11) for j in range(3)], "i long, j long, v double"), 11, 3, 4, 3)
    flat = lambda t: np.concatenate([r["x"] for r in sorted(t.collect())])
    assert np.allclose(flat(k.matvec(v)), a @ np.arange(1, 12)) and k.stored().count() == 9 and k.diagonal().count() == 3
    for lower in (True, False):
        part = k.cut(lambda b, lower=lower: (b if b.bi != b.bj else b.like(d=np.tril(b.d) if lower else np.triu(b.d))) if (b.bi >= b.bj if lower else b.bi <= b.bj) else None)
        t = np.tril(a) if lower else np.triu(a)
        for transposed in (False, True):
            m = t.T if transposed else t
            assert np.allclose(flat(S.substitute(part, v, lower, transposed, unit=False)), np.linalg.solve(m, np.arange(1, 12)))
            got = values(B.to_coo(S.substitute_blocks(part, right, lower, transposed, unit=False)))
            want = np.linalg.solve(m, np.add.outer(np.arange(11), 2 * np.arange(3)) + 1.0)
            assert got == pytest.approx({(i, j): want[i, j] for i in range(11) for j in range(3)})


def test_sums_of_many_products(spark):
    """Products of a long inner index are summed as they come, and low-rank sums stay as thin as their side."""
    rng = np.random.default_rng(3)
    a = rng.standard_normal((90, 3))
    t = B.to_blocks(table(spark, [(i, j, float(a[i, j])) for i in range(90) for j in range(3)]), 90, 3, 2, 3)
    for left, right in ((t, t), (B.lowrank(t), t), (B.lowrank(t), B.lowrank(t))):
        made = B.matmul(B.transpose(left), right)
        assert np.allclose(list(values(B.to_coo(made)).values()), list({(i, j): (a.T @ a)[i, j] for i in range(3) for j in range(3)}.values()))
        assert all(r["k"] is None or r["k"] <= 3 for r in made.collect())


def test_all_pairs_meet_once_on_all_cores(spark):
    from tilewright.functions import kernels

    rng = np.random.default_rng(4)
    x = rng.random((60, 3))
    p = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "id long, x array<double>").coalesce(1)
    assert kernels._pairs(p, 4).select(F.spark_partition_id().alias("p")).distinct().count() == spark.sparkContext.defaultParallelism
    n = kernels._pairs(p, 4).count()
    tiles = round(n**0.5)
    assert kernels._pairs(p, 4, once=True).count() == tiles * (tiles + 1) // 2 < n
    want = kernels.array("exponential", x, x, eps=2.0).sum(axis=1)
    got = {r["i"]: r["v"] for r in kernels.sums(p, "exponential", {"eps": 2.0}).collect()}
    assert got == pytest.approx(dict(enumerate(want)))


def test_filled_is_not_shuffled(spark):
    """All pairs of indices, copies and nulls as a join gives them, and no exchange of the dense result."""
    a = table(spark, [(0, 1, 2.0), (0, 1, 3.0), (2, 4099, None), (2, 7, 4.0), (9, 1, 5.0), (None, 1, 6.0)])
    rows = spark.createDataFrame([(0,), (2,), (2,), (None,)], "i long")
    cols = spark.createDataFrame([(1,), (7,), (7,), (4099,), (None,)], "j long")
    want = rows.join(cols, how="cross").join(a, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))
    got = coo.filled(a, rows, cols)
    order = lambda t: sorted(map(str, t.collect()))
    assert order(got) == order(want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = coo.filled(a, rows, cols)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\(i#\d+L?, j#", plan)  # pairs would move by their names
