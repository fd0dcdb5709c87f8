"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows start in lanes (input partitions, folded to at most MAX_LANES). How many rows of a lane go to a shard is drawn
exactly as a uniform shuffle would make it: multivariate hypergeometric, lane after lane, on what the shards still
need. Then rows are permuted within their lane, cut into the drawn counts, exchanged, and permuted within the shard.
The matrix has MAX_LANES x shards entries at most, whatever the input.

The law is `rows`: shard sizes differ by one at most. Places of rows are fixed in a durable table before any draw, so a
task that runs again gives the same rows. Null ids and texts count like others (null text: no bytes), repeated rows
are separate rows, ties in random order are broken by place, an empty table gives no rows, and other columns of the
input do not matter (inner columns are named `_s_*`).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.llm.common import durable

MAX_LANES = 2048
#: A shard's order is made in so many slices by random key, so that no task sorts a whole shard.
SLICES = 16


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among draws from good + bad without replacement; exact at any size.

    numpy's own generator serves up to its limit of 10^9. Beyond, rejection from a uniform pair under the scaled
    density (ratio of uniforms, Stadlober 1990), which needs the density only up to a factor.
    """
    if draws <= 0 or good <= 0:
        return 0
    if bad <= 0 or draws >= good + bad:
        return min(good, draws)
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    lg = math.lgamma

    def logp(k: int) -> float:
        return -(lg(k + 1) + lg(good - k + 1) + lg(draws - k + 1) + lg(bad - draws + k + 1))

    top = logp(mode)
    spread = math.sqrt(draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1)) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(mode + 0.5 + width * (v - 0.5) / max(u, 1e-300))
        if low <= k <= high and 2 * math.log(max(u, 1e-300)) <= logp(k) - top:
            return k


def communication_matrix(lane_sizes: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Counts by lane and shard of a uniform shuffle; rows sum to lane_sizes, columns to shard_sizes."""
    rng = np.random.default_rng(seed)
    need = list(shard_sizes)
    out = np.zeros((len(lane_sizes), len(shard_sizes)), dtype=np.int64)
    for i, left in enumerate(lane_sizes):
        rest = sum(need)
        for j, n in enumerate(need):
            out[i, j] = k = hypergeometric(rng, n, rest - n, left)
            rest -= n
            left -= k
        need = [n - int(k) for n, k in zip(need, out[i], strict=True)]
    return out


def shard_rows(rows: DataFrame, shards: int = 40, seed: int = 1) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 within the shard)."""
    spark = rows.sparkSession
    placed = durable(
        rows.withColumns({"_s_lane": F.pmod(F.spark_partition_id(), F.lit(MAX_LANES)), "_s_place": F.monotonically_increasing_id()}), "shard-places"
    )
    sizes = {r[0]: r[1] for r in placed.groupBy("_s_lane").count().collect()}  # MAX_LANES rows at most
    lanes = sorted(sizes)
    total = sum(sizes.values())
    targets = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([sizes[x] for x in lanes], targets, seed)
    ends = spark.createDataFrame(
        [(lane, np.cumsum(matrix[i]).tolist()) for i, lane in enumerate(lanes)], "_s_lane int, _s_ends array<bigint>"
    )
    first = F.xxhash64(F.lit(seed), F.lit("lane"), "_s_place")
    second = F.xxhash64(F.lit(seed), F.lit("shard"), "_s_place")
    local = Window.partitionBy("_s_lane").orderBy(first, "_s_place")
    sent = (
        placed.withColumn("_s_rank", F.row_number().over(local))
        .join(F.broadcast(ends), "_s_lane")  # MAX_LANES rows
        .withColumn("shard", F.size(F.filter("_s_ends", lambda e: e < F.col("_s_rank"))))
        .withColumn("_s_key", second)
        .withColumn("_s_slice", F.shiftrightunsigned("_s_key", 60).cast("int"))
        .drop("_s_ends", "_s_rank", "_s_lane")
    )
    sent = durable(sent, "shard-sent")
    counts = sent.groupBy("shard", "_s_slice").count()
    before = Window.partitionBy("shard").orderBy(F.col("_s_slice")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_s_slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s_before"))
    order = Window.partitionBy("shard", "_s_slice").orderBy("_s_key", "_s_place")
    return (
        sent.join(F.broadcast(counts), ["shard", "_s_slice"])  # shards x SLICES rows
        .withColumn("slot", (F.col("_s_before") + F.row_number().over(order) - 1).cast("long"))
        .drop("_s_before", "_s_slice", "_s_key", "_s_place")
    )
