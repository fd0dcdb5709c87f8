"""Queries that report on blocks and runs, and round trips through storage."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.operators import reports as R
from tilewright.plans import fixtures as X
from tilewright.plans.registry import query
from tilewright.sources import storage as S

A = X.A
#: A block table from the tiles of A: thin tiles low-rank with a rank from their entries, others dense; two levels.
BLOCKS = f"SELECT CAST(bi % 2 AS INTEGER) AS level, CAST(bi AS INTEGER) AS bi, CAST(bj AS INTEGER) AS bj, 16 AS nr, 16 AS nc, CASE WHEN n % 3 = 0 THEN 'D' ELSE 'R' END AS kind, CAST(CASE WHEN n % 3 = 0 THEN NULL ELSE n % 9 END AS INTEGER) AS k FROM (SELECT i // 16 AS bi, j // 16 AS bj, count(*) AS n FROM ({A}) GROUP BY 1, 2)"


def blocks(spark, d):
    t = X.matrix_a(spark, d).groupBy(F.floor(F.col("i") / 16).cast("int").alias("bi"), F.floor(F.col("j") / 16).cast("int").alias("bj")).agg(F.count("*").alias("n"))
    dense = F.col("n") % 3 == 0
    return t.select(F.pmod("bi", F.lit(2)).alias("level"), "bi", "bj", F.lit(16).alias("nr"), F.lit(16).alias("nc"), F.when(dense, "D").otherwise("R").alias("kind"), F.when(~dense, F.col("n") % 9).cast("int").alias("k"))


query("a8_rank_info", f"SELECT min(k) AS min_rank, CAST(floor(avg(k)) AS INTEGER) AS avg_rank, max(k) AS max_rank FROM ({BLOCKS}) WHERE kind = 'R' AND k > 0")(lambda s, d: R.rank_info(blocks(s, d)))
query("a9_rank_hist", f"SELECT CAST(r AS INTEGER) AS k, count(b.k) AS n FROM (SELECT unnest(range(0, 1 + (SELECT max(k) FROM ({BLOCKS})))) AS r) t LEFT JOIN ({BLOCKS}) b ON b.k = t.r GROUP BY r")(lambda s, d: R.rank_hist(blocks(s, d)))
_BYTES = "CASE WHEN kind = 'D' THEN 8 * nr * nc ELSE 8 * k * (nr + nc) END"
query("a10_mem_by_level", f"SELECT level, CAST(sum(CASE WHEN kind = 'D' THEN {_BYTES} ELSE 0 END) AS BIGINT) AS dense, CAST(sum(CASE WHEN kind = 'R' THEN {_BYTES} ELSE 0 END) AS BIGINT) AS lowrank, CAST(sum({_BYTES}) AS BIGINT) AS total FROM ({BLOCKS}) GROUP BY ROLLUP (level)")(lambda s, d: R.mem_by_level(blocks(s, d)))
query("a11_data_bytes", f"SELECT CAST(sum({_BYTES}) AS BIGINT) AS total, CAST(sum(CASE WHEN kind = 'D' THEN {_BYTES} ELSE 0 END) AS BIGINT) AS dense, CAST(sum(CASE WHEN kind = 'R' THEN {_BYTES} ELSE 0 END) AS BIGINT) AS lowrank, round(sum(8.0 * nr * nc) / sum({_BYTES}), 6) AS rate FROM ({BLOCKS})")(lambda s, d: X.rounded(R.data_bytes(blocks(s, d)), 6, "rate"))
query("a12_matvec_cost", f"SELECT kind, CAST(sum(CASE WHEN kind = 'D' THEN 2 * nr * nc + 2 * nr ELSE 2 * nc * k + 2 * nc + 2 * nr * k + 2 * nr END) AS BIGINT) AS flops, CAST(sum({_BYTES}) AS BIGINT) AS bytes FROM ({BLOCKS}) GROUP BY kind")(lambda s, d: R.matvec_cost(blocks(s, d)).select("kind", "flops", "bytes"))
query("e13_nearfield", f"SELECT bi, bj FROM ({BLOCKS}) WHERE kind = 'D'")(lambda s, d: blocks(s, d).where("kind = 'D'").select("bi", "bj"))
query("io9_export_blocks", f"SELECT level, bi, bj, coalesce(k, 0) AS rank, CAST({_BYTES} AS BIGINT) AS bytes FROM ({BLOCKS})")(lambda s, d: blocks(s, d).select("level", "bi", "bj", F.coalesce("k", F.lit(0)).alias("rank"), R.block_bytes().alias("bytes")))

RUNS = "SELECT event_type AS app, 'mul' AS program, CAST(user_id % 3 AS VARCHAR) AS framework, CAST(event_id % 4 AS VARCHAR) AS blas, 'p' || CAST(user_id % 2 AS VARCHAR) AS processor, value AS time, event_id FROM events"


def runs(spark, d):
    e = X.table(spark, d, "events")
    return e.select(
        F.col("event_type").alias("app"), F.lit("mul").alias("program"), F.pmod("user_id", F.lit(3)).cast("string").alias("framework"), F.pmod("event_id", F.lit(4)).cast("string").alias("blas"),
        F.concat(F.lit("p"), F.pmod("user_id", F.lit(2)).cast("string")).alias("processor"), F.col("value").alias("time"), "event_id",
    )


query("a14_bench_best", f"WITH m AS (SELECT processor, app, program, framework, round(min(time), 6) AS best FROM ({RUNS}) GROUP BY 1, 2, 3, 4) SELECT *, best = min(best) OVER (PARTITION BY processor, app, program) AS overall FROM m")(lambda s, d: R.bench_best(runs(s, d).withColumn("time", F.round("time", 6))))
query("a14_bench_wide", f"SELECT app, framework, round(min(time) FILTER (WHERE blas = '0'), 6) AS b0, round(min(time) FILTER (WHERE blas = '1'), 6) AS b1, round(min(time) FILTER (WHERE blas = '2'), 6) AS b2, round(min(time) FILTER (WHERE blas = '3'), 6) AS b3 FROM ({RUNS}) GROUP BY 1, 2")(lambda s, d: X.rounded(R.bench_wide(runs(s, d), ["0", "1", "2", "3"]), 6, "b0", "b1", "b2", "b3"))
query("a15_time_summary", f"SELECT app, round(min(time), 6) AS min_s, round(median(time), 6) AS median_s, round(max(time), 6) AS max_s FROM ({RUNS}) GROUP BY app")(lambda s, d: X.rounded(R.time_summary(runs(s, d)), 6, "min_s", "median_s", "max_s"))


@query("io10_read_bench_logs", f"SELECT app, program, framework, blas, max_by(processor, event_id) AS processor, max_by(round(time, 4), event_id) AS time, CAST(max_by(event_id % 1000, event_id) * 1000 AS BIGINT) AS mem, CAST(0.5 AS DOUBLE) AS error FROM ({RUNS}) GROUP BY 1, 2, 3, 4")
def _logs(spark, d):
    """Log files are written from events, one for each combination, and parsed."""
    r = runs(spark, d)
    lines = r.select(
        F.concat_ws("--", "app", "program", "framework", "blas").alias("name"), "event_id",
        F.posexplode(F.array(F.concat(F.lit("processor : "), "processor"), F.format_string(" runtime = %.4f s / 9.0 s / 9.5 s", "time"), F.format_string("mem = %d.0 GB", F.pmod("event_id", F.lit(1000))), F.lit("error = 5.0e-01"), F.lit(""))).alias("k", "value"),
    )
    path = S.shared_path(spark, "logs")
    named = lines.withColumn("file", F.concat("name", F.lit(".log")))
    one = named.repartition("file").sortWithinPartitions("file", "event_id", "k").select("value", "file")  # begins with the writer's own order, so that it sorts no more: its sort keeps no order of lines once it spills
    one.write.partitionBy("file").text(path)
    return S.read_bench_logs(spark, path)


_TRIPLETS = f"SELECT i, j, round(v, 4) + 0.0 AS v FROM ({A})"


@query("io1_read_triplets", _TRIPLETS)
def _triplets(spark, d):
    path = S.shared_path(spark, "triplets")
    S.write_triplets(X.matrix_a(spark, d), path)
    return X.rounded(S.read_triplets(spark, path))


query("io2_matrix_round_trip", f"SELECT CAST(i % 4 AS BIGINT) AS level, i, j, round(v, 4) + 0.0 AS v FROM ({A})")(lambda s, d: X.rounded(S.round_trip(X.matrix_a(s, d).withColumn("level", F.pmod("i", F.lit(4)).cast("long")), "matrix", "level")).select("level", "i", "j", "v"))
query("io4_tensor3_round_trip", f"SELECT i0, i1, i2, round(v, 2) AS v FROM ({X.T3})")(lambda s, d: X.rounded(S.round_trip(X.tensor3(s, d), "ten3"), 2))
query("io4_tensor4_round_trip", f"SELECT i0, i1, i2, i3, round(v, 2) AS v FROM ({X.T4})")(lambda s, d: X.rounded(S.round_trip(X.tensor4(s, d), "ten4"), 2))


@query("io3_raw_tensor", f"SELECT i0, i1, i2, round(v, 2) AS v FROM ({X.T3})")
def _raw(spark, d):
    """Slabs of the last index become flat column-major float64 data and are read back."""
    stored = S.round_trip(S.raw_slabs(X.tensor3(spark, d), 8, 8), "raw")
    return X.rounded(S.read_raw_tensor(stored, 8, 8).where("v <> 0"), 2)  # absent entries are stored as zeros


query("io6_read_points", f"SELECT id, round(x, 8) + 0.0 AS x, round(y, 8) + 0.0 AS y, round(z, 8) + 0.0 AS z FROM ({X.POINTS})")(lambda s, d: X.rounded(X.points(s, d).select("id", *[F.col("x")[k].alias(n) for k, n in enumerate("xyz")]), 8, "x", "y", "z"))


#: Sides of made cubes: as many cells as parts, about.
_SIDE = "SELECT CAST(floor(power(count(*), 1 / 3.0) + 0.5) AS BIGINT) + 1 AS n FROM part"


def _side(spark, d):
    return int(X.parts(spark, d).count() ** (1 / 3) + 0.5) + 1


@query("io5_tensor_cube", f"SELECT k AS id, round(CAST(k % n AS DOUBLE) / (n - 1), 9) AS x, round(CAST((k // n) % n AS DOUBLE) / (n - 1), 9) AS y, round(CAST(k // (n * n) AS DOUBLE) / (n - 1), 9) AS z FROM (SELECT n, unnest(range(n * n * n)) AS k FROM ({_SIDE}))")
def _cube(spark, d):
    return X.rounded(R.tensor_cube(spark, _side(spark, d)).select("id", *[F.col("x")[k].alias(m) for k, m in enumerate("xyz")]), 9, "x", "y", "z")


for _shape in ("cube", "sphere", "ball", "cylinder", "jitter"):
    query(f"io5_random_{_shape}", "SELECT count(*) AS n, true AS inside FROM supplier")(lambda s, d, g=_shape: R.points_inside(R.random_points(s, g, X.suppliers(s, d).count(), 1), g))


_CP = " + ".join("(" + " * ".join(f"(((i{m} * 7919 + {104729 * r + 1299709 * m + 31}) % 10007) / 10007.0::DOUBLE)" for m in range(3)) + ")" for r in range(R.CP_RANK))
for _kind, _f in {"iota": "i0 + n * i1 + n * n * i2", "coulomb": "1 / sqrt(power(i0 + 1.0, 2) + power(i1 + 1.0, 2) + power(i2 + 1.0, 2))", "sincos": "sin(i0 + 1.0) * cos(i1 + 2.0) + sin(i2 * 0.5)", "cp": _CP}.items():
    query(f"io8_tensor_{_kind}", f"SELECT CAST(i0 AS INTEGER) AS i0, CAST(i1 AS INTEGER) AS i1, CAST(i2 AS INTEGER) AS i2, round(CAST({_f} AS DOUBLE), 8) + 0.0 AS v FROM (SELECT k % n AS i0, (k // n) % n AS i1, k // (n * n) AS i2, n FROM (SELECT n, unnest(range(n * n * n)) AS k FROM ({_SIDE})))")(
        lambda s, d, k=_kind: X.rounded(R.made_tensor(s, k, _side(s, d)), 8)
    )

_SV = f"SELECT CAST(i // 25 AS INTEGER) AS b, row_number() OVER (PARTITION BY i // 25 ORDER BY s DESC, i) - 1 AS k, s FROM (SELECT i, sqrt(sum(v * v)) AS s FROM ({A}) GROUP BY i)"


def sigmas(spark, d):
    s = X.matrix_a(spark, d).groupBy("i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("s"))
    return s.select(F.floor(F.col("i") / 25).cast("int").alias("b"), "i", "s").withColumn("k", (F.row_number().over(Window.partitionBy("b").orderBy(F.desc("s"), "i")) - 1).cast("long")).drop("i")


query("w8_trunc_rank", f"WITH t AS (SELECT b, k, sqrt(sum(s * s) OVER (PARTITION BY b ORDER BY k DESC)) AS tail, sqrt(sum(s * s) OVER (PARTITION BY b)) AS whole FROM ({_SV})) SELECT b, CAST(coalesce(min(k) FILTER (WHERE tail <= 0.5 * whole), count(*)) AS BIGINT) AS rank FROM t GROUP BY b")(lambda s, d: R.trunc_ranks(sigmas(s, d), 0.5))
query("w11_greedy_ranks", f"WITH t AS (SELECT b, k, s, sum(s * s) OVER (ORDER BY s, b DESC, k DESC) AS tail, sum(s * s) OVER () AS whole FROM ({_SV})) SELECT b, count(*) FILTER (WHERE k = 0 OR tail > 0.01 * whole) AS rank FROM t GROUP BY b")(lambda s, d: R.greedy_ranks(sigmas(s, d), 0.1))
