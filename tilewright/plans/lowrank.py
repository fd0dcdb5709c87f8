"""Queries on block tables: approximation, compression, bases, codecs, block products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tilewright.functions import codecs, dense, kernels
from tilewright.operators import blocks as B
from tilewright.operators import clusters as C
from tilewright.operators import coo, tall
from tilewright.operators import hmatrix as H
from tilewright.operators import reports as R
from tilewright.plans import fixtures as X
from tilewright.plans.registry import query
from tilewright.sources.storage import durable

TR, TC = 64, 32
ENTRIES = f"SELECT i, j, round(v, 6) + 0.0 AS v FROM ({X.DENSE})"


def tiles(spark, d):
    n = X.table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return B.to_blocks(X.features(spark, d), n, 64, TR, TC)


def entries(blocks):
    return X.rounded(B.to_coo(blocks), 6)


query("b1_to_blocks", ENTRIES)(lambda s, d: entries(tiles(s, d)))
query("b2_to_coo_lowrank", ENTRIES)(lambda s, d: entries(B.lowrank(tiles(s, d))))
for _name, _key in {"l1_svd": "svd", "l5_rrqr": "rrqr", "l6_aca_next": "aca_next", "l6_aca_max": "aca_max", "l6_aca_full": "aca_full", "l7_randsvd": "randsvd", "l8_randlr": "randlr", "l9_lanczos": "lanczos", "l10_column_id": "id"}.items():
    query(_name, ENTRIES)(lambda s, d, k=_key: entries(B.lowrank(tiles(s, d), dense.TIGHT, k)))
query("u2_user_approximation", ENTRIES)(lambda s, d: entries(B.lowrank(tiles(s, d), dense.TIGHT, lambda a, acc: (a, np.eye(a.shape[1])))))
query("l1_svd_energy", f"SELECT CAST(i // {TR} AS INTEGER) AS bi, CAST(j // {TC} AS INTEGER) AS bj, round(sum(v * v), 6) AS energy FROM ({X.DENSE}) GROUP BY 1, 2")(
    lambda s, d: X.rounded(B.measured(tiles(s, d), lambda b: (b.bi, b.bj, float((np.linalg.svd(b.d, compute_uv=False) ** 2).sum())), "bi int, bj int, energy double"), 6, "energy"))
_TILES = f"SELECT CAST(count(DISTINCT i) AS INTEGER) AS nr, CAST(count(DISTINCT j) AS INTEGER) AS nc, CAST(least(count(DISTINCT i), count(DISTINCT j)) AS INTEGER) AS k FROM ({X.DENSE}) GROUP BY i // {TR}, j // {TC}"
query("a8_rank_info_tiles", f"SELECT min(k) AS min_rank, CAST(floor(avg(k)) AS INTEGER) AS avg_rank, max(k) AS max_rank FROM ({_TILES})")(lambda s, d: R.rank_info(B.lowrank(tiles(s, d))))
query("a9_rank_hist_tiles", f"SELECT CAST(r AS INTEGER) AS k, count(b.k) AS n FROM (SELECT unnest(range(0, 1 + (SELECT max(k) FROM ({_TILES})))) AS r) t LEFT JOIN ({_TILES}) b ON b.k = t.r GROUP BY r")(lambda s, d: R.rank_hist(durable(B.lowrank(tiles(s, d)), "tiles")))
query("a11_data_bytes_tiles", f"SELECT CAST(sum(8 * k * (nr + nc)) AS BIGINT) AS total, CAST(0 AS BIGINT) AS dense, CAST(sum(8 * k * (nr + nc)) AS BIGINT) AS lowrank, round(sum(8.0 * nr * nc) / sum(8 * k * (nr + nc)), 6) AS rate FROM ({_TILES})")(lambda s, d: X.rounded(R.data_bytes(B.lowrank(tiles(s, d))), 6, "rate"))
query("a12_matvec_cost_tiles", f"SELECT 'R' AS kind, CAST(sum(2 * nc * k + 2 * nc + 2 * nr * k + 2 * nr) AS BIGINT) AS flops, CAST(sum(8 * k * (nr + nc)) AS BIGINT) AS bytes FROM ({_TILES})")(lambda s, d: R.matvec_cost(B.lowrank(tiles(s, d))).select("kind", "flops", "bytes"))
query("l2_truncate", ENTRIES)(lambda s, d: entries(B.retruncated(B.lowrank(tiles(s, d)), dense.TIGHT)))
_TWICE = f"SELECT i, j, round(3 * v, 6) + 0.0 AS v FROM ({X.DENSE})"
query("l3_sum_lowrank", _TWICE)(lambda s, d: entries(B.add_blocks([B.lowrank(tiles(s, d))] * 3)))
query("l4_sum_pairwise", _TWICE)(lambda s, d: entries(B.add_blocks([B.lowrank(tiles(s, d))] * 3, pairwise=True)))
query("e5_hadamard_blocks", f"SELECT i, j, round(v * v * 100, 6) + 0.0 AS v FROM ({X.DENSE})")(lambda s, d: X.rounded(B.to_coo(B.hadamard(B.lowrank(tiles(s, d)), B.lowrank(tiles(s, d)), dense.TIGHT)).withColumn("v", 100 * F.col("v")), 6))
query("e7_transpose_blocks", f"SELECT j AS i, i AS j, round(v, 6) + 0.0 AS v FROM ({X.DENSE})")(lambda s, d: entries(B.transpose(B.lowrank(tiles(s, d)))))
query("a2_norm_blocks", f"SELECT round(sqrt(sum(v * v)), 6) AS norm FROM ({X.DENSE})")(lambda s, d: X.rounded(B.norm_frobenius(B.lowrank(tiles(s, d))), 6, "norm"))
_OK = f"SELECT DISTINCT CAST(i // {TR} AS INTEGER) AS bi, CAST(j // {TC} AS INTEGER) AS bj, true AS ok FROM ({X.DENSE})"


def _fits(approx, eps):
    def run(b):
        u, v = approx(b.d, dense.Acc(rel=eps))
        return b.bi, b.bj, bool(np.linalg.norm(b.d - u @ v.T) <= 1.01 * eps * np.linalg.norm(b.d) and u.shape[1] <= min(b.d.shape))

    return run


query("l1_error_bound", _OK)(lambda s, d: B.measured(tiles(s, d), _fits(dense.svd_lowrank, 0.3), "bi int, bj int, ok boolean"))
query("l5_error_bound", _OK)(lambda s, d: B.measured(tiles(s, d), _fits(dense.rrqr, 0.3), "bi int, bj int, ok boolean"))


def _basis_ok(b):
    w, s = dense.column_basis(b.d, dense.Acc(rel=1e-12))
    return b.bi, b.bj, bool(np.allclose(w.T @ w, np.eye(w.shape[1]), atol=1e-10) and np.allclose(w @ (w.T @ b.d), b.d, atol=1e-9))


query("l12_column_basis", _OK)(lambda s, d: B.measured(tiles(s, d), _basis_ok, "bi int, bj int, ok boolean"))
_ENERGY = f"SELECT CAST(i // {TR} AS INTEGER) AS bi, CAST(j // {TC} AS INTEGER) AS bj, round(sum(v * v), 6) AS energy, CAST(least(count(DISTINCT i), count(DISTINCT j)) AS INTEGER) AS k FROM ({X.DENSE}) GROUP BY 1, 2"


def _projected(how):
    """Squared norm of a block's projection on its basis, and the basis' size."""
    def run(b):
        w, _ = dense.column_basis(b.d, dense.Acc(rel=1e-12), how)
        return b.bi, b.bj, float(np.linalg.norm(w.T @ b.d) ** 2), w.shape[1]

    return run


for _how in ("svd", "rrqr", "randsvd"):
    query(f"l12_projection_{_how}", _ENERGY)(lambda s, d, h=_how: X.rounded(B.measured(tiles(s, d), _projected(h), "bi int, bj int, energy double, k int"), 6, "energy"))
_X = "SELECT CAST(k AS BIGINT) AS i, 1.0 / (k + 1) AS v FROM range(64) t(k)"
_MV = f"SELECT d.i, round(sum(d.v / (d.j + 1)), 6) + 0.0 AS v FROM ({X.DENSE}) d GROUP BY d.i"


def _x(spark):
    return B.segments(spark.range(64).select(F.col("id").alias("i"), (1.0 / (F.col("id") + 1)).alias("v")), TC, 64)


query("j7_matvec_blocks", _MV)(lambda s, d: X.rounded(B.flat(B.matvec(B.lowrank(tiles(s, d)), _x(s)), TR), 6))
query("j7_matvec_blocks_dense", _MV)(lambda s, d: X.rounded(B.flat(B.matvec(tiles(s, d), _x(s)), TR), 6))
_PART = "SELECT CAST(k AS BIGINT) AS k, 1.0 / (k + 1) AS w FROM range(64) t(k)"
query("e6_scale_blocks", f"SELECT i, j, round(v * (i % 5 + 1) / (j + 1), 6) + 0.0 AS v FROM ({X.DENSE})")(
    lambda s, d: entries(B.scale_rows(B.segments(X.features(s, d).select("i", (F.pmod("i", F.lit(5)) + 1).cast("double").alias("v")).distinct(), TR, X.table(s, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1), B.scale_columns(B.lowrank(tiles(s, d)), _x(s)))))
query("e8_diagonal_blocks", f"SELECT i, round(v, 6) + 0.0 AS v FROM ({X.DENSE}) WHERE i = j")(lambda s, d: X.rounded(B.diagonal(B.lowrank(tiles(s, d))), 6))
query("e10_restrict_blocks", f"SELECT i, j, round(v, 6) + 0.0 AS v FROM ({X.DENSE}) WHERE i BETWEEN 50 AND 199 AND j BETWEEN 10 AND 40")(lambda s, d: entries(B.restrict(B.lowrank(tiles(s, d)), (50, 199), (10, 40))))


def _block_diagonal(spark):
    """Tiles of a 64 x 64 block diagonal matrix with entries 1 / (i + j + 1) where i // 32 = j // 32."""
    at = spark.range(64 * TC).select(F.floor(F.col("id") / TC).alias("i"), (F.floor(F.col("id") / (TC * TC)) * TC + F.pmod("id", F.lit(TC))).alias("j"))
    return B.to_blocks(at.select("i", "j", (1.0 / (F.col("i") + F.col("j") + 1)).alias("v")), 64, 64, TC, TC)


query("j12_matmul_block_diagonal", f"SELECT a.i, b.i AS j, round(sum(a.v * b.v / (a.j + b.j + 1)), 6) + 0.0 AS v FROM ({X.DENSE}) a JOIN (SELECT * FROM ({X.DENSE}) WHERE i < 64) b ON a.j // {TC} = b.j // {TC} GROUP BY 1, 2")(
    lambda s, d: entries(B.matmul_block_diagonal(B.lowrank(tiles(s, d)), _block_diagonal(s), B.transpose(B.to_blocks(X.features(s, d).where("i < 64"), 64, 64, TC, TC)))))
query("j8_matvec_joined", _MV)(lambda s, d: X.rounded(B.flat(B.matvec_joined(B.lowrank(tiles(s, d)), _x(s)), TR), 6))
_GRAM = f"SELECT a.j AS i, b.j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM ({X.DENSE}) a JOIN ({X.DENSE}) b ON a.i = b.i GROUP BY 1, 2"
for _n, _a, _b in (("dense", False, False), ("lowrank_dense", True, False), ("dense_lowrank", False, True), ("lowrank", True, True)):
    query(f"j10_matmul_{_n}", _GRAM)(lambda s, d, a=_a, b=_b: entries(B.matmul(B.transpose(B.lowrank(tiles(s, d)) if a else tiles(s, d)), B.lowrank(tiles(s, d)) if b else tiles(s, d))))
query("j11_matmul_pruned", _GRAM)(lambda s, d: entries(B.matmul(B.transpose(B.lowrank(tiles(s, d))), B.lowrank(tiles(s, d)), prune=1e-14)))
_LEVEL = f"SELECT round(sqrt(sum(v * v)), 5) AS norm, count(*) AS cells, true AS ok FROM ({X.DENSE})"


def _compared(spark, d, made, bound):
    got = B.to_coo(made).groupBy("i", "j").agg(F.sum("v").alias("w"))
    both = X.features(spark, d).join(got, ["i", "j"], "left")
    rel = F.sqrt(F.sum(F.pow(F.col("v") - F.coalesce("w", F.lit(0.0)), 2)) / F.sum(F.col("v") * F.col("v")))
    return X.rounded(both.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.count("*").alias("cells"), (rel <= bound).alias("ok")), 5, "norm")


def _square_tiles(spark, d):
    n = X.table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0] + 1
    return B.to_blocks(X.features(spark, d), n, 64, 32, 32)


query("l19_compress_bottom_up", _LEVEL)(lambda s, d: _compared(s, d, B.coarsened(_square_tiles(s, d), dense.Acc(rel=1e-3), 6), 2e-3))
query("l21_coarsen", _LEVEL)(lambda s, d: _compared(s, d, B.coarsened(B.lowrank(_square_tiles(s, d), dense.Acc(rel=0.1)), dense.Acc(rel=1e-2), 6, dense_joins=False), 0.15))
query("l20_compress_top_down", _LEVEL)(lambda s, d: _compared(s, d, B.top_down(_square_tiles(s, d), dense.Acc(rel=1e-3), 8, 8), 2e-3))
query("l30_compress_multilevel", _LEVEL)(lambda s, d: _compared(s, d, B.top_down(_square_tiles(s, d), dense.Acc(rel=1e-6), 4, 8, additive=True), 1e-5))


def _uniform(spark, d):
    t = B.lowrank(tiles(spark, d))
    rows, cols = B.shared_bases(t, dense.TIGHT, "row"), B.shared_bases(t, dense.TIGHT, "col")
    return B.to_uniform(t, rows, cols), rows, cols


query("l23_shared_bases", f"SELECT CAST(i // {TR} AS INTEGER) AS b, CAST(least(64, count(DISTINCT i)) AS INTEGER) AS rank FROM ({X.DENSE}) GROUP BY 1")(lambda s, d: B.shared_bases(B.lowrank(tiles(s, d)), dense.TIGHT, "row").select("b", "rank"))
query("a13_basis_rank_info", f"SELECT min(r) AS min_rank, CAST(floor(avg(r)) AS INTEGER) AS avg_rank, max(r) AS max_rank FROM (SELECT CAST(least(64, count(DISTINCT i)) AS INTEGER) AS r FROM ({X.DENSE}) GROUP BY i // {TR})")(
    lambda s, d: B.shared_bases(B.lowrank(tiles(s, d)), dense.TIGHT, "row").agg(F.min("rank").alias("min_rank"), F.floor(F.avg("rank")).cast("int").alias("avg_rank"), F.max("rank").alias("max_rank")))
query("l24_separate_couplings", ENTRIES)(lambda s, d: (lambda c, r, k: entries(B.from_uniform(B.joined(durable(B.separated(c, dense.TIGHT), "separate")), r, k, TR, TC)))(*_uniform(s, d)))
query("l24_to_uniform_and_back", ENTRIES)(lambda s, d: entries(B.from_uniform(*_uniform(s, d), TR, TC)))
query("l25_matvec_uniform", _MV)(lambda s, d: X.rounded(B.flat(B.matvec_uniform(*_uniform(s, d), _x(s)), TR), 6))
for _codec in codecs.CODECS:
    for _eps in (1e-3, 1e-6):
        query(f"l27_{_codec}_{_eps:.0e}".replace("-0", ""), _OK)(lambda s, d, c=_codec, e=_eps: B.quantized(tiles(s, d), c, e).select("bi", "bj", (F.col("error") <= max(e, 1e-7 if c == "fp32" else 0.0)).alias("ok")))
query("l28_quantize_adaptive", _OK)(lambda s, d: B.quantized_adaptive(tiles(s, d), 1e-5).select("bi", "bj", (F.col("error") <= 1e-5).alias("ok")))
query("l13_tsqr", _GRAM.replace("round(sum(a.v * b.v), 6)", "round(sum(a.v * b.v), 5)"))(lambda s, d: X.rounded(tall.gram_of_r(s, tall.tsqr(X.features(s, d), 64)), 5))
query("l13_tsqr_orthonormal", f"SELECT count(DISTINCT i) AS rows, CAST(least(64, count(DISTINCT i)) AS INTEGER) AS columns, 0.0::DOUBLE AS off FROM ({X.DENSE})")(lambda s, d: X.rounded(tall.orthonormal_report(tall.q_rows(X.features(s, d), 64)), 9, "off"))
query("l13_tsqr_gaps", f"SELECT a.j AS i, b.j, round(sum(a.v * b.v), 2) + 0.0 AS v FROM (SELECT * FROM ({X.A}) WHERE j < 48) a JOIN (SELECT * FROM ({X.A}) WHERE j < 48) b ON a.i = b.i GROUP BY 1, 2")(
    lambda s, d: X.rounded(tall.gram_of_r(s, tall.tsqr(X.matrix_a(s, d).where("j < 48"), 48)).where("abs(v) > 1e-3"), 2))


def _twins(spark, d):
    """Rows of U = [A A] (of half rank) and V = [I 0.9 I], whose product is 1.9 A."""
    rows = tall.rows_of(X.features(spark, d), 64)
    u = rows.select("i", (2 * F.col("m")).alias("m"), F.concat("x", "x").alias("x"))
    at = lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: F.when(j == F.col("id"), c).otherwise(0.0))
    v = spark.range(64).select(F.col("id").alias("i"), F.lit(128).alias("m"), F.concat(at(1.0), at(0.9)).alias("x"))
    return u, v


query("l14_truncate_tall", f"SELECT i, j, round(1.9 * v, 6) + 0.0 AS v FROM ({X.DENSE})")(lambda s, d: X.rounded(tall.product(*tall.truncated(*_twins(s, d), dense.TIGHT)), 6))
query("l14_truncate_tall_rank", "SELECT 64 AS u_rank, 64 AS v_rank")(lambda s, d: (lambda u, v: u.agg(F.max("m").alias("u_rank")).join(v.agg(F.max("m").alias("v_rank"))))(*tall.truncated(*_twins(s, d), dense.TIGHT)))  # one row each
_LOWRANK = f"SELECT d.i, CAST(k AS BIGINT) AS j, sum(d.v / (1 + d.j + k)) AS v FROM ({X.DENSE}) d, range(64) t(k) WHERE d.j < 6 GROUP BY 1, 2"


@query("l15_randsvd_distributed", f"SELECT i, j, round(v, 6) + 0.0 AS v FROM ({_LOWRANK})")
def _l15(s, d):
    """A matrix of rank 6 at rank 6: entries of U V^T."""
    a = X.features(s, d).where("j < 6").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(63)))).groupBy("i", F.col("k").cast("long").alias("j")).agg(F.sum(F.col("v") / (1 + F.col("j") + F.col("k"))).alias("v"))
    return X.rounded(tall.product(*tall.randsvd(durable(a, "a"), 6)), 6)


_SUMS = f"SELECT a.id AS i, round(sum(exp(-(power(a.x-b.x,2) + power(a.y-b.y,2) + power(a.z-b.z,2))) * (b.id % 7 + 1)), 4) AS v FROM ({X.POINTS}) a, ({X.POINTS}) b GROUP BY a.id"


def _weights(h):
    return H.ones(h).withColumn("v", (F.pmod("i", F.lit(7)) + 1).cast("double"))


def _hmatrix(spark, d, adm=None, **how):
    return H.build(C.bisect(X.points(spark, d), 64), C.admissible("strong") if adm is None else adm, **how)


def _product(h):
    return X.rounded(H.matvec(h, _weights(h)), 4)


query("l17_hmatrix_matvec", _SUMS)(lambda s, d: _product(_hmatrix(s, d)))
query("l17_hmatrix_transposed", _SUMS)(lambda s, d: (lambda h: X.rounded(H.matvec(h, _weights(h), transposed=True), 4))(_hmatrix(s, d)))  # the kernel is symmetric
query("l17_hmatrix_weak", _SUMS)(lambda s, d: _product(_hmatrix(s, d, adm=C.admissible("weak"))))
query("l17_hmatrix_aca", _SUMS)(lambda s, d: _product(_hmatrix(s, d, far="aca")))
query("l17_hmatrix_svd", _SUMS)(lambda s, d: _product(_hmatrix(s, d, far="svd")))
query("l11_interpolation", _SUMS)(lambda s, d: _product(_hmatrix(s, d, far="interpolation")))
query("l17_user_kernel", _SUMS)(lambda s, d: _product(_hmatrix(s, d, kernel=lambda x, y: np.exp(-((x[:, None] - y[None]) ** 2).sum(axis=2)))))
query("u4_user_admissibility", _SUMS)(lambda s, d: _product(_hmatrix(s, d, adm=(F.col("rcid") != F.col("ccid")) & (C.gap_squared("r", "c", 3) > 0.01))))
query("e13_near_and_far", _SUMS)(lambda s, d: (lambda h: X.rounded(coo.add(1.0, H.matvec(H.nearfield(h), _weights(h)), 1.0, H.matvec(H.farfield(h), _weights(h)), ("i",)), 4))(_hmatrix(s, d)))
query("u1_user_kernel_column", f"SELECT a.id AS i, round(sum(1.0 / (1.0 + sqrt(power(a.x-b.x,2) + power(a.y-b.y,2) + power(a.z-b.z,2)))), 5) AS v FROM ({X.POINTS}) a, ({X.POINTS}) b GROUP BY a.id")(lambda s, d: X.rounded(kernels.entries(X.points(s, d), lambda r: 1 / (1 + r), {}).groupBy("i").agg(F.sum("v").alias("v")), 5))
_BYTES = f"SELECT CAST(8 * count(*) * count(*) AS BIGINT) AS full_bytes, CAST(count(*) * count(*) AS BIGINT) AS area FROM ({X.POINTS})"
query("l17_covers", _BYTES)(lambda s, d: H.memory_report(_hmatrix(s, d)).select("full_bytes", "area"))
query("l29_memory_plan", f"SELECT 8 * count(*) * count(*) AS dense_bytes, CAST(0 AS BIGINT) AS differs FROM ({X.POINTS})")(lambda s, d: _planned(s, d))


def _planned(s, d):
    """Bytes of all planned blocks as if dense, and by how much the plan's bytes differ from those of the matrix when it is built."""
    leaves, rule, acc = durable(C.bisect(X.points(s, d), 32), "leaves"), C.admissible("weak"), dense.Acc(rel=1e-4)
    plan = durable(H.memory_plan(leaves, rule, acc), "plan")
    made = H.memory_report(H.build(leaves, rule, acc)).select((F.col("near_bytes") + F.col("far_bytes")).alias("made"), F.col("full_bytes").alias("dense_bytes"))
    return made.join(plan.agg(F.sum("bytes").alias("planned"))).select("dense_bytes", (F.col("made") - F.col("planned")).alias("differs"))  # one row each


query("l18_build_from_sparse", f"SELECT i, j, round(v, 4) + 0.0 AS v FROM ({X.A})")(lambda s, d: X.rounded(H.from_sparse(X.matrix_a(s, d), 32, dense.TIGHT).where("abs(v) > 1e-7"), 4))


@query("l18_sparse_partition", f"SELECT i, round(sum(v * (j % 7 + 1)), 3) AS v FROM ({X.A}) GROUP BY i")
def _l18(s, d):
    """Suppliers by parts as one square index set: off-diagonal blocks low-rank at full accuracy; rows without entries give zeros, which go."""
    a = X.matrix_a(s, d)
    rows, cols = a.agg(F.max("i"), F.max("j")).first()
    points = s.range(max(rows, cols) + 1).select("id", F.array(F.col("id").cast("double")).alias("x"))
    h = H.from_entries(a, C.bisect(points, 128), C.admissible("offdiag", dim=1), int(rows) + 1, dense.Acc(rel=1e-13))
    return X.rounded(H.matvec(h, _weights(h)), 3).where(F.col("i") <= F.lit(rows)).join(a.select("i").distinct(), "i", "left_semi")


_SHIFTS = "(VALUES ('face', 1.0, 0.0, 0.0), ('edge', 1.0, 1.0, 0.0), ('vertex', 1.0, 1.0, 1.0), ('apart', 2.0, 0.0, 0.0)) g(geometry, dx, dy, dz)"
query("l16_numerical_ranks", f"SELECT CAST(a.id // 64 AS BIGINT) AS tile, geometry, round(sqrt(sum(1.0 / (power(a.x-b.x-dx,2) + power(a.y-b.y-dy,2) + power(a.z-b.z-dz,2)))), 5) AS norm FROM ({X.POINTS}) a JOIN ({X.POINTS}) b ON a.id // 64 = b.id // 64, {_SHIFTS} GROUP BY 1, 2")(
    lambda s, d: X.rounded(H.rank_study(X.points(s, d), 64, lambda x, y: kernels.array("newton", x, y), dense.Acc(rel=1e-6, norm="spectral")).select("tile", "geometry", "norm"), 5, "norm"))
query("l22_to_hodlr", _SUMS)(lambda s, d: _product(H.converted(_hmatrix(s, d), 150, dense.Acc(rel=1e-12))))
query("l22_to_lowrank", _SUMS)(lambda s, d: _product(H.converted(_hmatrix(s, d), 200, dense.Acc(rel=1e-12), whole=True)))
query("l26_nested_any_depth", _SUMS)(lambda s, d: (lambda p: X.rounded(H.matvec_nested(C.bisect(p, 32), C.admissible("strong"), p.select(F.col("id").alias("i"), (F.pmod("id", F.lit(7)) + 1).cast("double").alias("v"))), 4))(X.points(s, d)))
query("l26_nested_matvec", _MV)(lambda s, d: X.rounded(B.flat(B.matvec_nested(B.lowrank(tiles(s, d)), _x(s), dense.TIGHT), TR), 6))
