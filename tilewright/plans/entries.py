"""Queries on entry tables: element-wise operators, joins and norms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tilewright.functions import dense, kernels
from tilewright.operators import coo, tall
from tilewright.plans import fixtures as X
from tilewright.plans.registry import query


def _simple(name: str, sql: str, build, digits: int = 4):
    query(name, sql)(lambda spark, d: X.rounded(build(spark, d), digits))


A, B, PART, SUPP = X.A, X.B, X.PART, X.SUPP
_R = "round(v, 4) + 0.0 AS v"
_simple("e1_scale", f"SELECT i, j, round(-2.5 * v, 4) + 0.0 AS v FROM ({A})", lambda s, d: coo.scale(X.matrix_a(s, d), -2.5))
_simple("e1_abs", f"SELECT i, round(abs(v), 4) AS v FROM ({SUPP})", lambda s, d: coo.absolute(X.suppliers(s, d)))
_simple("e1_fill", f"SELECT s.i, p.j, round(coalesce(a.v, 0.0), 4) + 0.0 AS v FROM (SELECT s_suppkey AS i FROM supplier) s CROSS JOIN (SELECT p_partkey AS j FROM part) p LEFT JOIN ({A}) a ON a.i = s.i AND a.j = p.j",
        lambda s, d: coo.filled(X.matrix_a(s, d), X.suppliers(s, d), X.parts(s, d).withColumnRenamed("i", "j")))
_simple("e2_add", f"SELECT i, j, round(sum(v), 4) + 0.0 AS v FROM (SELECT i, j, 2.0 * v AS v FROM ({A}) UNION ALL SELECT i, j, -0.5 * v FROM ({B})) GROUP BY i, j", lambda s, d: coo.add(2.0, X.matrix_a(s, d), -0.5, X.matrix_b(s, d)))
_simple("e3_add_identity", f"SELECT i, j, round(sum(v), 4) AS v FROM (SELECT * FROM ({A}) UNION ALL SELECT s_suppkey, s_suppkey, 3.0 FROM supplier) GROUP BY i, j", lambda s, d: coo.add_identity(X.matrix_a(s, d), X.suppliers(s, d), 3.0))
_simple("e3_add_diagonal", f"SELECT i, j, round(sum(v), 4) + 0.0 AS v FROM (SELECT * FROM ({A}) UNION ALL SELECT i, i, v FROM ({SUPP})) GROUP BY i, j", lambda s, d: coo.add_diagonal(X.matrix_a(s, d), X.suppliers(s, d)))
_simple("e4_hadamard", f"SELECT a.i, a.j, round(a.v * b.v, 4) AS v FROM ({A}) a JOIN ({B}) b ON a.i = b.i AND a.j = b.j", lambda s, d: coo.hadamard(X.matrix_a(s, d), X.matrix_b(s, d)))
_simple("e6_scale_rows", f"SELECT a.i, a.j, round(a.v * s.v, 4) + 0.0 AS v FROM ({A}) a JOIN ({SUPP}) s ON a.i = s.i", lambda s, d: coo.scale_rows(X.suppliers(s, d), X.matrix_a(s, d)))
_simple("e6_scale_columns", f"SELECT a.i, a.j, round(a.v * p.v, 4) + 0.0 AS v FROM ({A}) a JOIN ({PART}) p ON a.j = p.i", lambda s, d: coo.scale_columns(X.matrix_a(s, d), X.parts(s, d)))
_simple("e7_transpose", f"SELECT j AS i, i AS j, {_R} FROM ({A})", lambda s, d: coo.transpose(X.matrix_a(s, d)))


@query("e7_adjoint", f"SELECT j AS i, i AS j, round(v, 4) + 0.0 AS re, round(-2 * v, 4) + 0.0 AS im FROM ({A})")
def _adjoint(spark, d):
    a = X.matrix_a(spark, d).withColumn("v", F.struct(F.col("v").alias("re"), (2 * F.col("v")).alias("im")))
    return X.rounded(coo.adjoint(a).select("i", "j", "v.re", "v.im"), 4, "re", "im")


_simple("e8_diagonal", f"SELECT i, {_R} FROM ({A}) WHERE i = j", lambda s, d: coo.diagonal(X.matrix_a(s, d)))
_simple("e9_lower_unit", f"SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE round(v, 4) END + 0.0 AS v FROM ({A}) WHERE i >= j".replace("1.0", "CAST(1 AS DOUBLE)"), lambda s, d: coo.triangle(X.matrix_a(s, d), unit=True))
_simple("e9_upper", f"SELECT i, j, {_R} FROM ({A}) WHERE i <= j", lambda s, d: coo.triangle(X.matrix_a(s, d), upper=True))
_simple("e10_restrict", f"SELECT i, j, {_R} FROM ({A}) WHERE i BETWEEN 10 AND 59 AND j BETWEEN 100 AND 1499", lambda s, d: coo.restrict(X.matrix_a(s, d), (10, 59), (100, 1499)))


@query("e11_permute", f"WITH p AS (SELECT n_nationkey AS e, CAST(row_number() OVER (ORDER BY n_name) - 1 AS BIGINT) AS t FROM nation), m AS (SELECT CAST(c_nationkey AS BIGINT) AS i, CAST(o.k AS BIGINT) AS j, sum(c_acctbal) AS v FROM customer JOIN (SELECT o_custkey, CAST(o_orderkey % 25 AS INTEGER) AS k FROM orders) o ON o.o_custkey = c_custkey GROUP BY 1, 2) SELECT a.t AS i, b.t AS j, round(v, 3) + 0.0 AS v FROM m JOIN p a ON m.i = a.e JOIN p b ON m.j = b.e")
def _permute(spark, d):
    from pyspark.sql.window import Window

    perm = X.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ext"), (F.row_number().over(Window.orderBy("n_name")) - 1).cast("long").alias("int"))  # 25 rows
    o = X.table(spark, d, "orders").select("o_custkey", F.pmod("o_orderkey", F.lit(25)).alias("j"))
    m = X.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").cast("long").alias("i"), "j").agg(F.sum("c_acctbal").alias("v"))
    return X.rounded(coo.permute(m, perm), 3)


_simple("e12_identity", "SELECT s_suppkey AS i, s_suppkey AS j, CAST(1 AS DOUBLE) AS v FROM supplier", lambda s, d: coo.identity(X.suppliers(s, d)))
_simple("e14_single_precision", f"SELECT i, j, round(CAST(CAST(v * 1.1 AS FLOAT) AS DOUBLE), 3) + 0.0 AS v FROM ({A})", lambda s, d: coo.to_float(coo.scale(X.matrix_a(s, d), 1.1)), 3)


_HALF = "CASE WHEN v = 0 THEN v ELSE round_even(v / step, 0) * step END"
_simple("e14_half_precision", f"SELECT i, j, round({_HALF}, 4) + 0.0 AS v FROM (SELECT *, power(2.0::DOUBLE, greatest(floor(log2(abs(v))), -14) - 10) AS step FROM (SELECT i, j, v * 1.1::DOUBLE AS v FROM ({A})))", lambda s, d: coo.to_half(coo.scale(X.matrix_a(s, d), 1.1)))


@query("e15_check_data", f"SELECT count(*) FILTER (WHERE v IS NULL OR isnan(v) OR isinf(v)) AS bad, count(*) AS n FROM (SELECT i, j, CASE WHEN v > 90 THEN CAST('inf' AS DOUBLE) ELSE v END AS v FROM ({A}))")
def _check(spark, d):
    a = X.matrix_a(spark, d).withColumn("v", F.when(F.col("v") > 90, F.lit(float("inf"))).otherwise(F.col("v")))
    return coo.bad_entries(a).agg(F.count("*").alias("bad")).join(a.agg(F.count("*").alias("n")))  # one row each


@query("j1_kernel_entries", f"SELECT a.id AS i, b.id AS j, round(exp(-sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))), 8) AS v FROM ({X.POINTS}) a, ({X.POINTS}) b")
def _kernel(spark, d):
    return X.rounded(kernels.entries(X.points(spark, d), "exponential", {"eps": 1.0}), 8)


_DIST = "sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))"
for _name, _formula in {
    "logarithmic": "CASE WHEN r > 1e-12 THEN ln(r) ELSE 0.0 END", "newton": "CASE WHEN r > 1e-12 THEN 1.0 / r ELSE 0.0 END", "exponential": "exp(-2.0 * r)", "gaussian": "exp(-2.0 * r * r)", "multiquadric": "sqrt(1.0 + 4.0 * r * r)",
    "inverse_multiquadric": "1.0 / sqrt(1.0 + 4.0 * r * r)", "thin_plate": "CASE WHEN r > 1e-12 THEN 4.0 * r * r * ln(2.0 * r) ELSE 0.0 END", "rational_quadratic": "power(1.0 + r * r / (2.0 * 0.5 * 0.5 * 2.0), -2.0)", "helmholtz": "CASE WHEN r > 1e-12 THEN cos(2.0 * r) / r ELSE 0.0 END", "matern_half": "4.0 * exp(-r / 0.5)",
}.items():
    query(f"k1_{_name}", f"SELECT a.id AS i, round(sum({_formula}), 4) + 0.0 AS v FROM (SELECT a.id, {_DIST} AS r FROM ({X.POINTS}) a, ({X.POINTS}) b) a GROUP BY a.id")(
        lambda spark, d, k=_name: X.rounded(kernels.sums(X.points(spark, d), k, kernels.DEFAULTS[k]), 4)
    )


@query("k2_matern", f"SELECT a.id AS i, round(sum(CASE WHEN r > 1e-12 THEN (1 + sqrt(3.0) * r) * exp(-sqrt(3.0) * r) ELSE 1.0 END), 4) AS v FROM (SELECT a.id, {_DIST} AS r FROM ({X.POINTS}) a, ({X.POINTS}) b) a GROUP BY a.id")
def _matern(spark, d):
    """Quadrature of the general order, at 3/2, where a closed form exists."""
    return X.rounded(kernels.matern_sums(X.points(spark, d), nu=1.5, length=1.0, sigma=1.0), 4)


_TERMS = [(a, b) for a in range(4) for b in range(4 - a)]


@query("k3_polynomial_features", "SELECT vec_id AS i, CAST(j AS BIGINT) AS j, round(power(x, a) * power(y, b), 9) + 0.0 AS v FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), (VALUES " + ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(_TERMS)) + ") t(j, a, b)")
def _poly(spark, d):
    p = X.points(spark, d).select(F.col("id").alias("i"), "x")
    return X.rounded(coo.expression_matrix(p, _TERMS, F.col("x")[0], F.col("x")[1]), 9)


@query("k3_numerical_rank", "SELECT CAST(10 AS INTEGER) AS rank, round(sum(power(power(x, a) * power(y, b), 2)), 5) AS energy FROM (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), (VALUES " + ", ".join(f"({a}, {b})" for a, b in _TERMS) + ") t(a, b)")
def _poly_rank(spark, d):
    """Numerical rank of the feature matrix (as many as terms), and its squared norm from the singular values."""
    p = X.points(spark, d).select(F.col("id").alias("i"), "x")
    sv = np.linalg.svd(tall.tsqr(coo.expression_matrix(p, _TERMS, F.col("x")[0], F.col("x")[1]), len(_TERMS)), compute_uv=False)
    return spark.createDataFrame([(dense.trunc_rank(sv, dense.Acc(rel=1e-10, norm="spectral")), round(float((sv**2).sum()), 5))], "rank int, energy double")


@query("k4_codec_sizes", "SELECT CAST(event_id AS BIGINT) AS id, CAST(greatest(1, ceil(-log2(e))) AS INTEGER) AS mantissa, CAST(ceil((1 + greatest(1, ceil(-log2(e))) + 11) / 8.0) * 8 AS INTEGER) AS padded FROM (SELECT event_id, power(10.0, -3 - event_id % 8) AS e FROM events)")
def _codec_sizes(spark, d):
    e = X.table(spark, d, "events").select(F.col("event_id").cast("long").alias("id"), F.pow(F.lit(10.0), F.lit(-3) - F.pmod("event_id", F.lit(8))).alias("e"))
    m = kernels.mantissa_bits(F.col("e"))
    return e.select("id", m.alias("mantissa"), kernels.padded_bits(m + 12).alias("padded"))


_LOGN = "SELECT CAST(p_partkey AS BIGINT) AS c, count(*) OVER () AS n FROM part"


@query("j2_log_kernel", "WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM supplier), c AS (SELECT (s_suppkey - (SELECT min(s_suppkey) FROM supplier)) AS k FROM supplier), e AS (SELECT a.k AS i, b.k AS j, abs(a.k - b.k) AS m, n FROM c a, c b, n) SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(1e6 * (1 / (n * n)) * (1.5 - ln(1 / n) - 0.5 * ((m + 1) * (m + 1) * ln(m + 1) + CASE WHEN m > 1 THEN (m - 1) * (m - 1) * ln(m - 1) ELSE 0 END - CASE WHEN m > 0 THEN 2 * m * m * ln(m) ELSE 0 END)), 5) AS v FROM e")
def _log_kernel(spark, d):
    n = X.suppliers(spark, d).count()
    return kernels.toeplitz(X.rounded(coo.scale(kernels.log_kernel_diagonals(spark, n), 1e6), 5), n)  # scaled and rounded by diagonal


@query("io7_log_kernel_points", "SELECT CAST(k AS BIGINT) AS i, round((k + 0.5) / n, 9) AS mid, round(k / n, 9) AS lo, round((k + 1) / n, 9) AS hi FROM (SELECT (s_suppkey - (SELECT min(s_suppkey) FROM supplier))::DOUBLE AS k, count(*) OVER ()::DOUBLE AS n FROM supplier)".replace("OVER ()::DOUBLE AS n", "OVER () AS n"))
def _log_points(spark, d):
    return X.rounded(kernels.log_kernel_points(spark, X.suppliers(spark, d).count()), 9, "mid", "lo", "hi")


_simple("j6_matvec", f"SELECT a.i, round(sum(a.v * p.v), 2) AS v FROM ({A}) a JOIN ({PART}) p ON a.j = p.i GROUP BY a.i", lambda s, d: coo.matvec(X.matrix_a(s, d), X.parts(s, d)), 2)
_simple("j6_matvec_salted", f"SELECT a.i, round(sum(a.v * p.v), 2) AS v FROM ({A}) a JOIN ({PART}) p ON a.j = p.i GROUP BY a.i", lambda s, d: coo.matvec(X.matrix_a(s, d), X.parts(s, d), salt=4), 2)
_simple("j6_axpy_transposed", f"SELECT i, round(sum(v), 3) + 0.0 AS v FROM (SELECT a.j AS i, 0.5 * a.v * s.v AS v FROM ({A}) a JOIN ({SUPP}) s ON a.i = s.i UNION ALL SELECT * FROM ({PART})) GROUP BY i", lambda s, d: coo.axpy_matvec(0.5, X.matrix_a(s, d), X.suppliers(s, d), X.parts(s, d), transposed=True), 3)
_simple("j9_matmul", f"SELECT a.i, b.j, round(sum(a.v * b.v), 2) AS v FROM ({A}) a JOIN ({B}) b ON a.j = b.i GROUP BY a.i, b.j", lambda s, d: coo.matmul(X.matrix_a(s, d), X.matrix_b(s, d)), 2)
_simple("j12_matmul_diagonal", f"SELECT a.i, b.j, round(sum(a.v * p.v * b.v / 1e6), 3) AS v FROM ({A}) a JOIN ({PART}) p ON a.j = p.i JOIN ({B}) b ON a.j = b.i GROUP BY a.i, b.j", lambda s, d: coo.matmul_diagonal(X.matrix_a(s, d), coo.scale(X.parts(s, d), 1e-6), X.matrix_b(s, d)), 3)


@query("j13_compare", f"WITH a AS ({A}), b AS (SELECT i, j, CASE WHEN j % 7 = 0 THEN v * 1.01 ELSE v END AS v FROM ({A})) SELECT CAST(floor(i / 32) AS INTEGER) AS bi, CAST(floor(j / 32) AS INTEGER) AS bj, round(sqrt(sum((a.v - b.v) * (a.v - b.v)) / sum(b.v * b.v)), 6) AS error, 'error' AS status FROM a JOIN b USING (i, j) GROUP BY 1, 2 HAVING sqrt(sum((a.v - b.v) * (a.v - b.v)) / sum(b.v * b.v)) > 0.004")
def _compare(spark, d):
    a = X.matrix_a(spark, d)
    b = a.withColumn("v", F.when(F.col("j") % 7 == 0, F.col("v") * 1.01).otherwise(F.col("v")))
    return X.rounded(coo.compare(a, b, 32, 0.004), 6, "error")


_simple("j14_khatri_rao", f"SELECT a.i * 16 + b.i AS i, a.j, round(a.v * b.v, 6) + 0.0 AS v FROM ({X.DENSE}) a JOIN (SELECT r_regionkey AS i, CAST(k AS BIGINT) AS j, CAST(r_regionkey + k AS DOUBLE) AS v FROM region, range(64) t(k)) b ON a.j = b.j",
        lambda s, d: coo.khatri_rao(X.features(s, d), X.table(s, d, "region").select(F.col("r_regionkey").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")).select("i", F.col("k").cast("long").alias("j"), (F.col("i") + F.col("k")).cast("double").alias("v")), 16), 6)
query("a1_norm_frobenius", f"SELECT round(sqrt(sum(v * v)), 4) AS norm FROM ({A})")(lambda s, d: X.rounded(coo.norm_frobenius(X.matrix_a(s, d)), 4, "norm"))
query("a1_norm_difference", f"SELECT round(sqrt(sum(v * v)), 2) AS norm FROM (SELECT i, j, sum(v) AS v FROM (SELECT i, j, 2.0 * v AS v FROM ({A}) UNION ALL SELECT i, j, -0.5 * v FROM ({B})) GROUP BY i, j)")(lambda s, d: X.rounded(coo.norm_frobenius(coo.add(2.0, X.matrix_a(s, d), -0.5, X.matrix_b(s, d))), 2, "norm"))
query("a3_norm_one", f"SELECT round(max(s), 3) AS norm FROM (SELECT sum(abs(v)) AS s FROM ({A}) GROUP BY j)")(lambda s, d: X.rounded(coo.norm_one(X.matrix_a(s, d)), 3, "norm"))
query("a3_norm_inf", f"SELECT round(max(s), 3) AS norm FROM (SELECT sum(abs(v)) AS s FROM ({A}) GROUP BY i)")(lambda s, d: X.rounded(coo.norm_inf(X.matrix_a(s, d)), 3, "norm"))
query("a4_extremes", f"SELECT round(max(abs(v)), 4) AS max_abs, round(min(abs(v)), 4) AS min_abs FROM ({A})")(lambda s, d: X.rounded(coo.extremes(X.matrix_a(s, d)), 4, "max_abs", "min_abs"))
query("a5_dot", f"SELECT round(sum(a.v * b.v), 2) AS dot FROM ({PART}) a JOIN (SELECT i, sum(v) AS v FROM ({B}) GROUP BY i) b USING (i)")(lambda s, d: X.rounded(coo.dot(X.parts(s, d), X.matrix_b(s, d).groupBy("i").agg(F.sum("v").alias("v"))), 2, "dot"))
_simple("a6_gram", f"SELECT a.j AS i, b.j, round(sum(a.v * b.v / 1e6), 2) AS v FROM ({B}) a JOIN ({B}) b ON a.i = b.i GROUP BY a.j, b.j", lambda s, d: coo.gram(coo.scale(X.matrix_b(s, d), 1e-3)), 2)
query("w7_csr_row_ptr", f"SELECT i, n, CAST(coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ptr FROM (SELECT i, count(*) AS n FROM ({A}) GROUP BY i)")(lambda s, d: coo.csr_row_ptr(X.matrix_a(s, d)))
_simple("w9_pivot_full", f"SELECT i, j, {_R} FROM ({A}) ORDER BY abs(v) DESC, i, j LIMIT 1", lambda s, d: coo.pivot_full(X.matrix_a(s, d)))
_simple("w9_pivot_rows", f"SELECT i, j, {_R} FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY abs(v) DESC, j) AS r FROM ({A})) WHERE r = 1", lambda s, d: coo.pivot_rows(X.matrix_a(s, d)))
query("w10_off_diagonal_ranking", f"SELECT CAST(floor(i / 16) AS INTEGER) AS bi, CAST(floor(j / 16) AS INTEGER) AS bj, round(sqrt(sum(v * v)), 4) AS norm FROM ({A}) GROUP BY 1, 2 HAVING floor(i / 16) <> floor(j / 16) ORDER BY sqrt(sum(v * v)) DESC, 1, 2 LIMIT 20".replace("HAVING floor(i / 16) <> floor(j / 16)", "HAVING bi <> bj"))(lambda s, d: X.rounded(coo.off_diagonal_ranking(X.matrix_a(s, d), 16, 20), 4, "norm"))
_simple("b3_linear_sum", f"SELECT i, j, round(sum(v), 4) + 0.0 AS v FROM (SELECT i, j, 2 * v AS v FROM ({A}) UNION ALL SELECT i, j, -v FROM ({B}) UNION ALL SELECT j, i, 0.25 * v FROM ({A})) GROUP BY i, j", lambda s, d: coo.linear_sum([(2.0, X.matrix_a(s, d)), (-1.0, X.matrix_b(s, d)), (0.25, coo.transpose(X.matrix_a(s, d)))]))
_simple("b4_product_chain", f"WITH y AS (SELECT a.j AS i, sum(a.v * s.v) AS v FROM ({A}) a JOIN ({SUPP}) s ON a.i = s.i GROUP BY a.j) SELECT a.i, round(sum(a.v * y.v / 1e3), 2) + 0.0 AS v FROM ({A}) a JOIN y ON a.j = y.i GROUP BY a.i", lambda s, d: coo.scale(coo.matvec(X.matrix_a(s, d), coo.matvec(coo.transpose(X.matrix_a(s, d)), X.suppliers(s, d))), 1e-3), 2)
_simple("b6_hstack", f"SELECT i, j, {_R} FROM ({B}) UNION ALL SELECT i, j + 12, round(2 * v, 4) FROM ({B})", lambda s, d: coo.stack(X.matrix_b(s, d), coo.scale(X.matrix_b(s, d), 2.0), 12, "j"))
_simple("b6_vstack", f"SELECT i, j, {_R} FROM ({B}) UNION ALL SELECT i + (SELECT max(i) + 1 FROM ({B})), j, round(v, 4) FROM ({B})", lambda s, d: coo.stack(X.matrix_b(s, d), X.matrix_b(s, d), X.matrix_b(s, d).agg(F.max("i")).first()[0] + 1, "i"))
_simple("b6_zero_extend", f"SELECT i + 5, j + 7 AS j, {_R} FROM ({B})".replace("i + 5,", "i + 5 AS i,"), lambda s, d: coo.zero_extended(X.matrix_b(s, d), 5, 7))
