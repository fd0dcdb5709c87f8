"""Reports on block tables and runs, ranks from singular values, and made inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.operators.clusters import global_rank
from tilewright.operators.coo import running_before


def block_bytes() -> Column:
    k = F.coalesce("k", F.lit(0))
    return F.when(F.col("kind") == "D", 8 * F.col("nr") * F.col("nc")).otherwise(8 * k * (F.col("nr") + F.col("nc"))).cast("long")


def rank_info(blocks: DataFrame) -> DataFrame:
    """Least, mean (whole) and largest rank of low-rank blocks; rank 0 does not count."""
    return blocks.where("kind = 'R' and k > 0").agg(F.min("k").alias("min_rank"), F.floor(F.avg("k")).cast("int").alias("avg_rank"), F.max("k").alias("max_rank"))


def rank_hist(blocks: DataFrame) -> DataFrame:
    """Blocks for each rank up to the largest, gaps included."""
    ranks = blocks.where("kind = 'R'").groupBy("k").agg(F.count("*").alias("n"))
    every = ranks.agg(F.explode(F.sequence(F.lit(0), F.max("k"))).alias("k"))
    return every.join(ranks, "k", "left").select("k", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def mem_by_level(blocks: DataFrame) -> DataFrame:
    size = block_bytes()
    return blocks.rollup("level").agg(F.sum(F.when(F.col("kind") == "D", size).otherwise(0)).alias("dense"), F.sum(F.when(F.col("kind") == "R", size).otherwise(0)).alias("lowrank"), F.sum(size).alias("total"))


def data_bytes(blocks: DataFrame) -> DataFrame:
    size = block_bytes()
    return blocks.agg(
        F.sum(size).alias("total"), F.sum(F.when(F.col("kind") == "D", size).otherwise(0)).alias("dense"), F.sum(F.when(F.col("kind") == "R", size).otherwise(0)).alias("lowrank"),
        (F.sum(8.0 * F.col("nr") * F.col("nc")) / F.sum(size)).alias("rate"),
    )


def matvec_cost(blocks: DataFrame) -> DataFrame:
    """Floating-point operations and bytes of a product with a vector, by block kind; gemv(m, n) takes 2mn + 2m."""
    nr, nc, k = F.col("nr"), F.col("nc"), F.coalesce("k", F.lit(0))
    flops = F.when(F.col("kind") == "D", 2 * nr * nc + 2 * nr).otherwise(2 * nc * k + 2 * nc + 2 * nr * k + 2 * nr)
    out = blocks.groupBy("kind").agg(F.sum(flops).cast("long").alias("flops"), F.sum(block_bytes()).alias("bytes"))
    return out.withColumn("intensity", F.col("flops") / F.col("bytes"))


def bench_best(runs: DataFrame) -> DataFrame:
    best = runs.groupBy("processor", "app", "program", "framework").agg(F.min("time").alias("best"))
    return best.withColumn("overall", F.col("best") == F.min("best").over(Window.partitionBy("processor", "app", "program")))


def bench_wide(runs: DataFrame, blas: list[str]) -> DataFrame:
    """Best time by framework (rows) and BLAS (columns b<name>); absent combinations are null."""
    wide = runs.groupBy("app", "framework").pivot("blas", blas).agg(F.min("time"))
    return wide.select("app", "framework", *[F.col(b).alias(f"b{b}") for b in blas])


def time_summary(runs: DataFrame) -> DataFrame:
    return runs.groupBy("app").agg(F.min("time").alias("min_s"), F.percentile("time", F.lit(0.5)).alias("median_s"), F.max("time").alias("max_s"))


def trunc_ranks(sigmas: DataFrame, rel: float) -> DataFrame:
    """sigmas(b, k, s), k from 0 in falling order: the least rank whose tail is at most rel times the whole, by block."""
    down = Window.partitionBy("b").orderBy(F.desc("k"))
    tails = sigmas.withColumn("tail", F.sqrt(F.sum(F.col("s") * F.col("s")).over(down))).withColumn("whole", F.sqrt(F.sum(F.col("s") * F.col("s")).over(Window.partitionBy("b"))))
    return tails.groupBy("b").agg(F.coalesce(F.min(F.when(F.col("tail") <= rel * F.col("whole"), F.col("k"))), F.count("*")).cast("long").alias("rank"))


def greedy_ranks(sigmas: DataFrame, rel: float) -> DataFrame:
    """Ranks by mode b that take singular values in falling order over all modes until the squares left are at most (rel * whole)^2.

    Each mode keeps at least one. Rows are ranked and summed in parts of the order, not in one task.
    """
    ranked = global_rank(sigmas, "s", F.desc("b"), F.desc("k")).withColumn("_sq", F.col("s") * F.col("s"))
    whole = ranked.agg(F.sum("_sq").alias("whole"))
    rows = running_before(ranked, "rank", "_sq", "_before", kind="double").join(F.broadcast(whole), how="cross")  # one row
    return rows.groupBy("b").agg(F.count(F.when((F.col("k") == 0) | (F.col("_before") + F.col("_sq") > rel * rel * F.col("whole")), 1)).alias("rank"))


def tensor_cube(spark: SparkSession, n: int) -> DataFrame:
    k = F.col("id")
    axes = [F.pmod(k, F.lit(n)), F.pmod(F.floor(k / n), F.lit(n)), F.floor(k / (n * n))]
    return spark.range(n**3).select("id", F.array(*[a.cast("double") / (n - 1) for a in axes]).alias("x"))


def random_points(spark: SparkSession, shape: str, n: int, seed: int) -> DataFrame:
    """points(id, x): n points in the unit cube, on the sphere, in the ball, on the cylinder, or a jittered cube.

    The ball takes directions times the cube root of a uniform radius, which needs no rejection.
    """
    r = spark.range(n)
    u = [F.rand(seed + d) for d in range(3)]
    g = [F.randn(seed + 10 + d) for d in range(3)]
    if shape == "cube":
        return r.select("id", F.array(*u).alias("x"))
    if shape == "jitter":
        side = max(2, round(n ** (1 / 3) + 0.499))
        at = [F.pmod(F.col("id"), F.lit(side)), F.pmod(F.floor(F.col("id") / side), F.lit(side)), F.floor(F.col("id") / (side * side))]
        return r.select("id", F.array(*[(a + 0.5 * v) / side for a, v in zip(at, u, strict=True)]).alias("x"))
    if shape == "cylinder":
        return r.select("id", (u[0] * 6.283185307179586).alias("t"), u[1].alias("z")).select("id", F.array(F.cos("t"), F.sin("t"), F.col("z")).alias("x"))
    raw = r.select("id", *[c.alias(f"g{d}") for d, c in enumerate(g)], u[0].alias("u"))
    size = F.sqrt(sum((F.col(f"g{d}") * F.col(f"g{d}") for d in range(3)), F.lit(0.0)))
    radius = F.lit(1.0) if shape == "sphere" else F.pow("u", F.lit(1 / 3))
    return raw.select("id", F.array(*[F.col(f"g{d}") / size * radius for d in range(3)]).alias("x"))


def points_inside(points: DataFrame, shape: str) -> DataFrame:
    x, y, z = (F.col("x")[d] for d in range(3))
    norm = F.sqrt(x * x + y * y + z * z)
    unit = (x >= 0) & (x <= 1) & (y >= 0) & (y <= 1) & (z >= 0) & (z <= 1)
    rule = {"cube": unit, "jitter": unit, "sphere": F.abs(norm - 1) < 1e-12, "ball": norm <= 1 + 1e-12, "cylinder": (F.abs(F.sqrt(x * x + y * y) - 1) < 1e-12) & z.between(0, 1)}[shape]
    return points.agg(F.count("*").alias("n"), F.min(rule).alias("inside"))


CP_RANK = 3


def random_factor(mode: int, i: Column, r: int) -> Column:
    """Entry of a CP factor in [0, 1): a linear congruence of mode, index and term, the same on every run."""
    return F.pmod(i * 7919 + 104729 * r + 1299709 * mode + 31, F.lit(10007)) / 10007


def made_tensor(spark: SparkSession, kind: str, n: int) -> DataFrame:
    """ten3 of side n by a formula in its indices."""
    k = F.col("id")
    base = spark.range(n**3).select(F.pmod(k, F.lit(n)).cast("int").alias("i0"), F.pmod(F.floor(k / n), F.lit(n)).cast("int").alias("i1"), F.floor(k / (n * n)).cast("int").alias("i2"))
    a, b, c = F.col("i0"), F.col("i1"), F.col("i2")
    value = {
        "iota": (a + n * b + n * n * c).cast("double"),
        "coulomb": 1 / F.sqrt(F.pow(a + 1.0, 2) + F.pow(b + 1.0, 2) + F.pow(c + 1.0, 2)),
        "sincos": F.sin(a + 1.0) * F.cos(b + 2.0) + F.sin(c * 0.5),
        "cp": sum((random_factor(0, a, r) * random_factor(1, b, r) * random_factor(2, c, r) for r in range(CP_RANK)), F.lit(0.0)),
    }[kind]
    return base.select("i0", "i1", "i2", value.alias("v"))
