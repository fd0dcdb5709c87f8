"""Queries on clusters and block partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewright.operators import clusters as C
from tilewright.plans import fixtures as X
from tilewright.plans.registry import query

P = X.POINTS
_CELL = " * 4 + ".join(f"CAST(least(3, floor(({a} - (SELECT min({a}) FROM p)) / (((SELECT max({a}) FROM p) - (SELECT min({a}) FROM p)) / 4))) AS BIGINT)" for a in "xyz").replace("CAST(least(3, floor((x", "(CAST(least(3, floor((x", 1).replace(" * 4 + CAST(least(3, floor((z", ") * 4 + CAST(least(3, floor((z", 1)
GRID = f"WITH p AS ({P}), g AS (SELECT *, {_CELL} AS cell FROM p), k AS (SELECT id, x, y, z, CAST(dense_rank() OVER (ORDER BY cell) - 1 AS BIGINT) AS cid, CAST(row_number() OVER (ORDER BY cell, id) - 1 AS BIGINT) AS pos FROM g)"


def _grid(spark, d):
    return C.grid(X.points(spark, d), 4)


def _grid_boxes(spark, d):
    return C.bbox(_grid(spark, d), "cid")


BOXES = f"{GRID}, b AS (SELECT cid, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1, count(*) AS n FROM k GROUP BY cid)"
_GAP = " + ".join(f"power(greatest(r.{a}0 - c.{a}1, c.{a}0 - r.{a}1, 0.0), 2)" for a in "xyz")
_DIAM = "least(" + ", ".join("(" + " + ".join(f"power({t}.{a}1 - {t}.{a}0, 2)" for a in "xyz") + ")" for t in "rc") + ")"
_AXES = " + ".join(f"CASE WHEN least(r.{a}1, c.{a}1) - greatest(r.{a}0, c.{a}0) <= 0 THEN 1 ELSE 0 END" for a in "xyz")
_STRONG = f"({_DIAM} <= 4.0 * ({_GAP}) AND ({_GAP}) > 0)"

query("a7_bbox", f"SELECT round(min(x), 8) AS x0, round(max(x), 8) AS x1, count(*) AS n FROM ({P})")(lambda s, d: X.rounded(C.bbox(X.points(s, d)).select(F.col("bbmin")[0].alias("x0"), F.col("bbmax")[0].alias("x1"), "n"), 8, "x0", "x1"))
query("a7_bbox_by_cluster", f"{BOXES} SELECT cid, round(x0, 8) + 0.0 AS x0, round(y1, 8) + 0.0 AS y1, n FROM b")(lambda s, d: X.rounded(_grid_boxes(s, d).select("cid", F.col("bbmin")[0].alias("x0"), F.col("bbmax")[1].alias("y1"), "n"), 8, "x0", "y1"))
query("w4_tensor_grid", f"{GRID} SELECT id, cid, pos FROM k")(lambda s, d: _grid(s, d).select("id", "cid", "pos"))
for _kind, _rule in {"strong": _STRONG, "weak": f"({_STRONG} OR ({_AXES}) >= 1)", "vertex": f"({_STRONG} OR ({_AXES}) >= 3)", "offdiag": "TRUE", "none": f"{_DIAM} = 0"}.items():
    query(f"j3_admissible_{_kind}", f"{BOXES} SELECT r.cid AS rcid, c.cid AS ccid, (r.cid <> c.cid AND {_rule}) AS adm FROM b r, b c")(
        lambda s, d, k=_kind: C.pairs(_grid_boxes(s, d), C.admissible(k)).select("rcid", "ccid", "adm")
    )


@query("a17_admissible_counts", f"{BOXES}, q AS (SELECT r.cid AS rcid, c.cid AS ccid, {_STRONG} AS strong, {_AXES} AS axes FROM b r, b c WHERE r.cid <> c.cid) SELECT CAST(3 - axes AS INTEGER) AS overlap, strong, count(*) AS n FROM q GROUP BY 1, 2")
def _counts(spark, d):
    q = C.pairs(_grid_boxes(spark, d), C.admissible("strong")).where("rcid <> ccid")
    return q.groupBy((3 - C.disjoint_axes(3)).cast("int").alias("overlap"), F.col("adm").alias("strong")).agg(F.count("*").alias("n"))


@query("a17_sparsity_constant", f"{BOXES}, q AS (SELECT r.cid AS rcid, count(*) AS n FROM b r, b c WHERE r.cid <> c.cid AND {_STRONG} GROUP BY 1) SELECT max(n) AS c_sp FROM q")
def _csp(spark, d):
    q = C.pairs(_grid_boxes(spark, d), C.admissible("strong")).where("adm")
    return q.groupBy("rcid").agg(F.count("*").alias("n")).unionByName(q.groupBy(F.col("ccid").alias("rcid")).agg(F.count("*").alias("n"))).agg(F.max("n").alias("c_sp"))


_BSP_ONE = f"WITH p AS ({P}), w AS (SELECT CASE WHEN max(x) - min(x) >= greatest(max(y) - min(y), max(z) - min(z)) THEN 0 WHEN max(y) - min(y) >= max(z) - min(z) THEN 1 ELSE 2 END AS a FROM p), k AS (SELECT id, row_number() OVER (ORDER BY CASE a WHEN 0 THEN x WHEN 1 THEN y ELSE z END, id) AS r, count(*) OVER () AS n FROM p, w) SELECT id, CAST(CASE WHEN r <= (n + 1) // 2 THEN 2 ELSE 3 END AS BIGINT) AS cid FROM k"


@query("w1_bisect_one_level", _BSP_ONE)
def _bisect_one(spark, d):
    p = X.points(spark, d)
    n = p.count()
    return C.bisect(p, (n + 1) // 2, small=max(1, n - 1)).select("id", "cid")


_LEAVES = f"SELECT count(*) AS n, true AS small, true AS balanced FROM ({P})"


def _leaf_report(spark, d, **how):
    leaves = C.bisect(X.points(spark, d), 32, **how)
    sizes = leaves.groupBy("cid").agg(F.count("*").alias("m"))
    return sizes.agg(F.sum("m").alias("n"), (F.max("m") <= 32).alias("small"), (F.min("m") >= (16 if how.get("by", "card") == "card" else 1)).alias("balanced"))


query("w1_bisect_cardinality", _LEAVES)(lambda s, d: _leaf_report(s, d))
query("w1_bisect_volume", _LEAVES)(lambda s, d: _leaf_report(s, d, by="vol"))
query("w1_bisect_distributed", _LEAVES)(lambda s, d: _leaf_report(s, d, small=200))
query("w2_pca_cardinality", _LEAVES)(lambda s, d: _leaf_report(s, d, how="pca"))
query("w2_pca_volume", _LEAVES)(lambda s, d: _leaf_report(s, d, how="pca", by="vol"))


@query("w3_curve", f"SELECT count(*) AS n, count(DISTINCT id // 32) AS tiles, true AS small FROM (SELECT row_number() OVER (ORDER BY id) - 1 AS id FROM ({P}))")
def _curve(spark, d):
    sizes = C.curve(X.points(spark, d), 32).groupBy("cid").agg(F.count("*").alias("m"))
    return sizes.agg(F.sum("m").alias("n"), F.count("*").alias("tiles"), (F.max("m") <= 32).alias("small"))


@query("w5_flat_level", f"SELECT count(*) AS n, CAST(8 AS BIGINT) AS clusters FROM ({P})")
def _flat(spark, d):
    leaves = C.ancestors(C.bisect(X.points(spark, d), 32), 3)
    return leaves.agg(F.count("*").alias("n"), F.countDistinct("top").alias("clusters"))


def tree(spark, d, ntile=32):
    return C.cluster_table(C.bisect(X.points(spark, d), ntile))


@query("w6_tiles_of", f"SELECT count(*) AS n, true AS covered FROM ({P})")
def _tiles_of(spark, d):
    t = C.durable(tree(spark, d), "tree")
    inner = t.where("level = 2").select(F.col("cid").alias("top"), F.col("lo").alias("plo"), F.col("hi").alias("phi"))
    own = C.range_lookup(t.where("leaf").select(F.col("cid").alias("tile"), F.col("lo").alias("i"), F.col("n")), inner.select(F.col("top").alias("cid"), F.col("plo").alias("lo"), F.col("phi").alias("hi")))
    per = own.groupBy("cid", "lo", "hi").agg(F.sum("n").alias("m"))
    return per.agg(F.sum("m").alias("n"), F.min(F.col("m") == F.col("hi") - F.col("lo") + 1).alias("covered"))


@query("j4_block_partition", f"SELECT CAST(power(count(*), 2) AS BIGINT) AS area, true AS disjoint FROM ({P})")
def _partition(spark, d):
    t = C.durable(tree(spark, d), "tree")
    leaves = C.block_partition(t, C.admissible("strong"))
    size = t.select("cid", "n")
    sized = leaves.join(size.select(F.col("cid").alias("rcid"), F.col("n").alias("rn")), "rcid").join(size.select(F.col("cid").alias("ccid"), F.col("n").alias("cn")), "ccid")
    return sized.agg(F.sum(F.col("rn") * F.col("cn")).cast("long").alias("area"), (F.count("*") == F.countDistinct("rcid", "ccid")).alias("disjoint"))


@query("e16_partition_coverage", f"SELECT CAST(power(count(*), 2) AS BIGINT) AS area, CAST(0 AS BIGINT) AS overlapping FROM ({P})")
def _coverage(spark, d):
    t = C.durable(tree(spark, d), "tree")
    parts = C.durable(C.block_partition(t, C.admissible("weak")), "parts")
    size = t.select("cid", "n")
    sized = parts.join(size.select(F.col("cid").alias("rcid"), F.col("n").alias("rn")), "rcid").join(size.select(F.col("cid").alias("ccid"), F.col("n").alias("cn")), "ccid")
    return sized.agg(F.sum(F.col("rn") * F.col("cn")).cast("long").alias("area")).join(C.overlaps(parts).agg(F.count("*").alias("overlapping")))  # one row each


query("w5_multi_level", f"SELECT CAST(l AS INTEGER) AS level, count(*) AS n, CAST(power(2, l) AS BIGINT) AS clusters, CAST(CASE WHEN l = 0 THEN 1 ELSE power(2, p) END AS BIGINT) AS tops FROM ({P}), (VALUES (0, 0), (1, 0), (3, 1)) t(l, p) GROUP BY l, p")(
    lambda s, d: C.collapsed(C.durable(tree(s, d), "tree"), [0, 1, 3]).where("level <= 3").groupBy("level").agg(F.sum("n").alias("n"), F.countDistinct("cid").alias("clusters"), F.count_distinct(F.coalesce("top", "cid")).alias("tops")))
query("io9_export_clusters", f"{BOXES} SELECT cid, n, round(x0, 8) + 0.0 AS x0, round(y0, 8) + 0.0 AS y0, round(z0, 8) + 0.0 AS z0, round(x1, 8) + 0.0 AS x1, round(y1, 8) + 0.0 AS y1, round(z1, 8) + 0.0 AS z1 FROM b")(
    lambda s, d: X.rounded(_grid_boxes(s, d).select("cid", "n", *[F.col(f"bb{m}")[k].alias(f"{a}{e}") for e, m in enumerate(("min", "max")) for k, a in enumerate("xyz")]), 8, *[f"{a}{e}" for e in (0, 1) for a in "xyz"]))


@query("j5_range_lookup", f"WITH a AS ({X.A}) SELECT CAST(i // 25 AS BIGINT) AS cid, count(*) AS n, round(sum(v), 2) AS v FROM a GROUP BY 1")
def _lookup(spark, d):
    a = X.matrix_a(spark, d)
    top = a.agg(F.max("i")).first()[0]
    cuts = spark.range(top // 25 + 1).select(F.col("id").alias("cid"), (F.col("id") * 25).alias("lo"), (F.col("id") * 25 + 24).alias("hi"))
    return X.rounded(C.range_lookup(a, cuts).groupBy("cid").agg(F.count("*").alias("n"), F.sum("v").alias("v")), 2)


for _how, _sql in {"cyclic2d": "CAST((bi % 2) * 4 + bj % 4 AS INTEGER)", "cyclic1d": "CAST(bj % 8 AS INTEGER)", "shifted": "CAST((bi + bj) % 8 AS INTEGER)"}.items():
    query(f"a16_owner_load_{_how}", f"SELECT {_sql} AS owner, count(*) AS blocks, CAST(sum(8 * n) AS BIGINT) AS bytes FROM (SELECT i // 16 AS bi, j // 16 AS bj, count(*) AS n FROM ({X.A}) GROUP BY 1, 2) GROUP BY 1")(
        lambda s, d, h=_how: C.owners(X.matrix_a(s, d).groupBy(F.floor(F.col("i") / 16).cast("int").alias("bi"), F.floor(F.col("j") / 16).cast("int").alias("bj")).agg(F.count("*").alias("n")), 8, h)
        .groupBy("owner").agg(F.count("*").alias("blocks"), (8 * F.sum("n")).cast("long").alias("bytes"))
    )


@query("e16_check_structure", f"SELECT count(*) AS n, CAST(0 AS BIGINT) AS orphans, CAST(0 AS BIGINT) AS uneven FROM ({P})")
def _structure(spark, d):
    t = C.durable(tree(spark, d), "tree")
    orphans = t.where("level > 0").join(t.select(F.col("cid").alias("parent")), "parent", "left_anti").agg(F.count("*").alias("orphans"))
    sons = t.where("level > 0").groupBy(F.col("parent").alias("cid")).agg(F.sum("n").alias("m"))
    uneven = t.join(sons, "cid").where("n <> m").agg(F.count("*").alias("uneven"))
    return t.where("leaf").agg(F.sum("n").alias("n")).join(orphans).join(uneven)  # one row each


@query("io9_export_points", f"{GRID} SELECT id, round(x, 8) + 0.0 AS x, round(y, 8) + 0.0 AS y, round(z, 8) + 0.0 AS z, cid FROM k")
def _export(spark, d):
    g = _grid(spark, d)
    return X.rounded(g.select("id", *[F.col("x")[k].alias(n) for k, n in enumerate("xyz")], "cid"), 8, "x", "y", "z")
