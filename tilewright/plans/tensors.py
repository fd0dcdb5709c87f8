"""Queries on tensors: index work, products, Tucker and CP forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.functions.dense import Acc
from tilewright.operators import coo
from tilewright.operators import tensors as T
from tilewright.plans import fixtures as X
from tilewright.plans.registry import query

T3, T4 = X.T3, X.T4
def whole(entries: str, modes: int = 3, side: int | None = None) -> str:
    """SQL of a dense result: every cell of the index box, or of each cube of this side that has an entry; absent ones are zero."""
    grids = ", ".join(f"g{m} AS (SELECT CAST(unnest(range({f'(max(i{m}) // {side} + 1) * {side}' if side == 2 else f'max(i{m}) + 1'})) AS INTEGER) AS i{m} FROM t)" for m in range(modes))
    names, of = ", ".join(f"i{m}" for m in range(modes)), ", ".join(f"g{m}" for m in range(modes))
    held = f" WHERE ({', '.join(f'i{m} // {side}' for m in range(modes))}) IN (SELECT ({', '.join(f'i{m} // {side}' for m in range(modes))}) FROM t)" if side else ""
    return f"WITH t AS ({entries}), {grids}, g AS (SELECT {names} FROM {of}) SELECT {names}, round(coalesce(v, 0) / 997.0, 4) + 0.0 AS v FROM (SELECT * FROM g{held}) LEFT JOIN t USING ({names})"


WHOLE, WHOLE4 = whole(T3), whole(T4, 4)


def t3(s, d):
    return X.tensor3(s, d).withColumn("v", F.col("v") / 997.0)


def t4(s, d):
    return X.tensor4(s, d).withColumn("v", F.col("v") / 997.0)


def _back(made):
    return X.rounded(T.multiply_all(*made))


for _m, (_i, _j) in {0: ("i0", "i1 + 8 * i2"), 1: ("i1", "i0 + 8 * i2"), 2: ("i2", "i0 + 8 * i1")}.items():
    query(f"t1_unfold_{_m}", f"SELECT CAST({_i} AS BIGINT) AS i, CAST({_j} AS BIGINT) AS j, round(v / 997.0, 4) AS v FROM ({T3})")(lambda s, d, m=_m: X.rounded(T.unfold(t3(s, d), m)))
query("t2_slice", f"SELECT i0, i2, round(v / 997.0, 4) AS v FROM ({T3}) WHERE i1 = 3")(lambda s, d: X.rounded(T.tensor_slice(t3(s, d), 1, 3)))
query("t2_fiber", f"SELECT i2 AS i, round(v / 997.0, 4) AS v FROM ({T3}) WHERE i0 = 2 AND i1 = 5")(lambda s, d: X.rounded(T.fiber(t3(s, d), 2, (2, 5))))
query("t2_sub_range", f"SELECT i0, i1, i2, round(v / 997.0, 4) AS v FROM ({T3}) WHERE i0 BETWEEN 1 AND 4 AND i1 BETWEEN 0 AND 6 AND i2 BETWEEN 5 AND 11")(lambda s, d: X.rounded(T.sub_range(t3(s, d), [(1, 4), (0, 6), (5, 11)])))
_M = "SELECT CAST(r_regionkey AS INTEGER) AS i, CAST(k AS INTEGER) AS j, CAST(r_regionkey + k + 1 AS DOUBLE) / 10 AS w FROM region, range(12) t(k)"


def _m(s, d):
    return X.table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("j")).select("i", "j", ((F.col("i") + F.col("j") + 1).cast("double") / 10).alias("v"))


query("t3_mode_product", f"SELECT i0, i1, m.i AS i2, round(sum(v / 997.0 * w), 4) AS v FROM ({T3}) t JOIN ({_M}) m ON m.j = t.i2 GROUP BY 1, 2, 3")(lambda s, d: X.rounded(T.mode_product(t3(s, d), _m(s, d), 2)))
query("t3_mode_product_4d", f"SELECT i0, m.i AS i1, i2, i3, round(sum(v / 997.0 * w), 4) AS v FROM ({T4}) t JOIN ({_M}) m ON m.j = t.i1 GROUP BY 1, 2, 3, 4")(lambda s, d: X.rounded(T.mode_product(t4(s, d), _m(s, d), 1)))
query("t4_dwt3", f"SELECT CAST(i0 // 2 AS INTEGER) AS b0, CAST(i1 // 2 AS INTEGER) AS b1, CAST(i2 // 2 AS INTEGER) AS b2, CAST(k AS INTEGER) AS band, round(sum(CASE WHEN ((i0 % 2) * (k % 2) + (i1 % 2) * ((k // 2) % 2) + (i2 % 2) * (k // 4)) % 2 = 0 THEN v ELSE -v END / 997.0), 4) + 0.0 AS v FROM ({T3}), range(8) t(k) GROUP BY 1, 2, 3, 4")(lambda s, d: X.rounded(T.dwt3(t3(s, d))))
query("t4_idwt3", whole(T3, side=2))(lambda s, d: X.rounded(T.idwt3(T.dwt3(t3(s, d)))))
_TIGHT = Acc(rel=1e-13)
query("t5_hosvd", WHOLE)(lambda s, d: _back(T.hosvd(t3(s, d), _TIGHT, ranks=(8, 8, 12))))
query("t5_hosvd_4d", WHOLE4)(lambda s, d: _back(T.hosvd(t4(s, d), _TIGHT, ranks=(8, 8, 12, 4))))
query("t6_sthosvd", WHOLE)(lambda s, d: _back(T.hosvd(t3(s, d), _TIGHT, sequential=True, ranks=(8, 8, 12))))
query("t7_greedy_hosvd", WHOLE)(lambda s, d: _back(T.greedy_hosvd(t3(s, d), 1e-14)))
query("t8_hooi", WHOLE)(lambda s, d: _back(T.hooi(t3(s, d), Acc(rank=12), maxit=1)))


def _error(t, made, bound):
    both = t.join(made.withColumnRenamed("v", "w"), T.indices(t), "left")
    rel = F.sqrt(F.sum(F.pow(F.col("v") - F.coalesce("w", F.lit(0.0)), 2)) / F.sum(F.col("v") * F.col("v")))
    return both.agg(F.count("*").alias("cells"), (rel <= bound).alias("ok"))


_BOUND = f"SELECT count(*) AS cells, true AS ok FROM ({T3})"
query("t5_hosvd_error", _BOUND)(lambda s, d: _error(t3(s, d), T.multiply_all(*T.hosvd(t3(s, d), Acc(rel=0.1))), 0.1))
query("t6_sthosvd_error", _BOUND)(lambda s, d: _error(t3(s, d), T.multiply_all(*T.hosvd(t3(s, d), Acc(rel=0.1), sequential=True)), 0.1))
query("t7_greedy_error", _BOUND)(lambda s, d: _error(t3(s, d), T.multiply_all(*T.greedy_hosvd(t3(s, d), 0.1)), 0.1))
query("t8_hooi_error", _BOUND)(lambda s, d: _error(t3(s, d), T.multiply_all(*T.hooi(t3(s, d), Acc(rel=0.1))), 0.1))
query("t10_tucker_error", _BOUND)(lambda s, d: _error(t3(s, d), T.multiply_all(*T.hosvd(t3(s, d), _TIGHT, ranks=(8, 8, 12))), 1e-12))


def _recompressed(s, d):
    """A Tucker form with factors of full size and the tensor as core is reduced again."""
    core, factors = T.hosvd(t3(s, d), _TIGHT, ranks=(8, 8, 12))
    inner, small = T.hosvd(core, Acc(rel=0.1))
    return T.multiply_all(inner, [f @ g for f, g in zip(factors, small, strict=True)])


query("t10_tucker_recompress", _BOUND)(lambda s, d: _error(t3(s, d), _recompressed(s, d), 0.1))
_F = "SELECT CAST(k AS INTEGER) AS i, CAST(r AS BIGINT) AS r, CAST(k * 3 + r + 1 AS DOUBLE) / 20 AS f FROM range(12) a(k), range(3) b(r)"


def _factor(s):
    k = F.col("id")
    return s.range(36).select(F.floor(k / 3).alias("i"), (k % 3).alias("j"), ((F.floor(k / 3) * 3 + k % 3 + 1).cast("double") / 20).alias("v"))


query("t11_mttkrp", f"SELECT CAST(t.i1 AS BIGINT) AS i, a.r AS j, round(sum(v / 997.0 * a.f * b.f), 3) AS v FROM ({T3}) t JOIN ({_F}) a ON a.i = t.i0 JOIN ({_F}) b ON b.i = t.i2 AND b.r = a.r GROUP BY 1, 2")(lambda s, d: X.rounded(T.mttkrp(t3(s, d), [_factor(s)] * 3, 1), 3))
_RANK1 = f"WITH t AS ({T3}) SELECT a.i0, b.i1, c.i2, round(a.v * b.v * c.v / 1e12, 4) AS v FROM (SELECT i0, sum(v) / 997.0 AS v FROM t GROUP BY 1) a, (SELECT i1, sum(v) / 997.0 AS v FROM t GROUP BY 1) b, (SELECT i2, sum(v) / 997.0 AS v FROM t GROUP BY 1) c"


@query("t12_cp_als", _RANK1)
def _cp(s, d):
    """The outer product of the tensor's margins has rank one, which least squares must find."""
    t = t3(s, d)
    m = [t.groupBy(f"i{k}").agg(F.sum("v").alias(f"m{k}")) for k in range(3)]
    outer = m[0].join(m[1], how="cross").join(m[2], how="cross").select("i0", "i1", "i2", (F.col("m0") * F.col("m1") * F.col("m2") / 1e12).alias("v"))
    return X.rounded(T.cp_entries(s, T.cp_als(outer, 1)))


query("b5_split_and_merge", whole(T3, side=5))(lambda s, d: X.rounded(T.merge_tensor(T.split_tensor(t3(s, d), 5))))
query("t9_tca_full", whole(T3, side=4))(lambda s, d: X.rounded(T.merge_tensor(T.blockwise_tucker(T.split_tensor(t3(s, d), 4), 1e-9, T.local_tca))))
query("t13_blockwise_tucker", whole(T3, side=4))(lambda s, d: X.rounded(T.merge_tensor(T.blockwise_tucker(T.split_tensor(t3(s, d), 4), 1e-9))))


def _block_error(s, d, f, bound):
    t = t3(s, d)
    return _error(t, T.merge_tensor(f(T.split_tensor(t, 4), T.block_tolerance(t, 4, 0.05))), bound)


query("t13_blockwise_error", _BOUND)(lambda s, d: _block_error(s, d, T.blockwise_tucker, 0.05))
query("t13_blockwise_quantised", _BOUND)(lambda s, d: _block_error(s, d, lambda b, tol: T.quantized(T.blockwise_tucker(b, tol), "aflp", 1e-4), 0.051))
query("t14_hierarchical_tucker", _BOUND)(lambda s, d: _block_error(s, d, T.hierarchical_tucker, 0.2))
for _name, _sql, _f in (
    ("a1_norm_tensor", f"SELECT round(sqrt(sum(v * v)) / 997.0, 4) AS norm FROM ({T3})", lambda t: coo.norm_frobenius(t)),
    ("a4_max_tensor", f"SELECT round(max(abs(v)) / 997.0, 4) AS norm FROM ({T3})", lambda t: t.agg(F.max(F.abs("v")).alias("norm"))),
):
    query(_name, _sql)(lambda s, d, f=_f: X.rounded(f(t3(s, d)), 4, "norm"))
query("a5_dot_tensor", f"SELECT round(sum(v * v * 2) / 994009.0, 2) AS dot FROM ({T3})")(lambda s, d: X.rounded(coo.dot(t3(s, d), coo.scale(t3(s, d), 2.0), ("i0", "i1", "i2")), 2, "dot"))
query("e2_add_tensor", f"SELECT i0, i1, i2, round(2.5 * v / 997.0, 4) AS v FROM ({T3})")(lambda s, d: X.rounded(coo.add(2.0, t3(s, d), 0.5, t3(s, d), ("i0", "i1", "i2"))))
query("e4_hadamard_tensor", f"SELECT i0, i1, i2, round(v * v / 994009.0, 3) AS v FROM ({T3})")(lambda s, d: X.rounded(coo.hadamard(t3(s, d), t3(s, d), ("i0", "i1", "i2")), 3))
query("e1_scale_tensor", f"SELECT i0, i1, i2, round(-1.5 * v / 997.0, 4) AS v FROM ({T3})")(lambda s, d: X.rounded(coo.scale(t3(s, d), -1.5)))
