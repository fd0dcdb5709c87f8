"""Clusters of points and pairs of clusters: grids, bisections, space-filling curves, admissibility, block partitions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tilewright.functions.dense import hilbert_key
from tilewright.operators.coo import running_before
from tilewright.sources.storage import durable

#: A cluster of at most so many points is finished within one task.
SMALL = 50_000


def bbox(points: DataFrame, by: str | None = None, dim: int = 3) -> DataFrame:
    """Box of all points, or of each cluster."""
    low = F.array(*[F.min(F.col("x")[d]) for d in range(dim)]).alias("bbmin")
    high = F.array(*[F.max(F.col("x")[d]) for d in range(dim)]).alias("bbmax")
    return (points.groupBy(by) if by else points.groupBy()).agg(low, high, F.count("*").alias("n"))


def global_rank(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with `rank` from 0 in the given order: range partitions are sorted alone and shifted by the counts before them."""
    cols = list(order)
    sorted_rows = durable(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    counts = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row for each partition
    out = sorted_rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn("rank", (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_part", "_start", "_at")


def grid(points: DataFrame, side: int, dim: int = 3) -> DataFrame:
    """points with cid (cube in a side^dim grid over their box, empty ones passed over) and pos, the new index by cube and id."""
    box = bbox(points, dim=dim).first()
    if not box["n"]:
        return points.select("*", F.lit(0).cast("long").alias("cid"), F.lit(0).cast("long").alias("pos"))
    cell = F.lit(0).cast("long")
    for d in range(dim):
        lo, h = box["bbmin"][d], (box["bbmax"][d] - box["bbmin"][d]) / side
        at = F.least(F.lit(side - 1), F.floor((F.col("x")[d] - F.lit(lo)) / F.lit(h))) if h > 0 else F.lit(0)
        cell = cell * side + at.cast("long")
    placed = points.withColumn("_cell", cell)
    starts = running_before(placed.groupBy("_cell").agg(F.count("*").alias("_n"), F.lit(1).cast("long").alias("_one")), "_cell", "_n", "_start")
    starts = running_before(starts, "_cell", "_one", "cid").drop("_n", "_one")
    within = F.row_number().over(Window.partitionBy("_cell").orderBy("id"))
    return placed.join(starts, "_cell").withColumn("pos", (F.col("_start") + within - 1).cast("long")).drop("_cell", "_start")


def _direction(x: np.ndarray, how: str) -> np.ndarray:
    if how == "pca":
        c = x - x.mean(axis=0)
        v = np.linalg.eigh(c.T @ c)[1][:, -1]
        return v * np.sign(v[np.abs(v).argmax()])
    axis = np.zeros(x.shape[1])
    axis[int((x.max(axis=0) - x.min(axis=0)).argmax())] = 1.0
    return axis


def _finish(ntile: int, how: str, by: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Bisects one cluster down to its leaves. Cluster names follow the path: sons of c are 2c and 2c + 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.array(pdf["x"].tolist(), dtype=float), pdf["id"].to_numpy()
        cid = pdf["cid"].to_numpy().copy()
        todo = [np.arange(len(ids))]
        while todo:
            at = todo.pop()
            if len(at) <= ntile:
                continue
            key = x[at] @ _direction(x[at], how)
            order = at[np.lexsort((ids[at], key))]
            half = (len(at) + 1) // 2
            if by == "vol":
                sorted_key = np.sort(key)
                half = int(np.searchsorted(sorted_key, (sorted_key[0] + sorted_key[-1]) / 2, side="right"))
                half = half if 0 < half < len(at) else (len(at) + 1) // 2
            left, right = order[:half], order[half:]
            cid[left], cid[right] = 2 * cid[left], 2 * cid[right] + 1
            todo += [left, right]
        return pd.DataFrame({"id": ids, "x": pdf["x"], "cid": cid})

    return run


def bisect(points: DataFrame, ntile: int, how: str = "axis", by: str = "card", small: int = SMALL) -> DataFrame:
    """points(id, x) with cid, the leaf's path name (root 1), after splitting along the widest axis or principal axis.

    Clusters above `small` points are split level by level over all executors by a global rank; from there on a cluster
    is finished within a task. by: 'card' halves the points, 'vol' the extent.
    """
    now = points.select("id", "x", F.lit(1).cast("long").alias("cid"))
    dim = int(points.select(F.max(F.size("x"))).first()[0] or 0)
    while True:
        means = [F.avg(F.col("x")[d]).alias(f"m{d}") for d in range(dim)]
        second = [F.avg(F.col("x")[a] * F.col("x")[b]).alias(f"s{a}_{b}") for a in range(dim) for b in range(dim)]
        ends = [f(F.col("x")[d]).alias(f"{n}{d}") for d in range(dim) for n, f in (("lo", F.min), ("hi", F.max))]
        large = now.groupBy("cid").agg(F.count("*").alias("n"), *means, *second, *ends).where(F.col("n") > small).collect()  # at most points / small rows
        if not large:
            break
        cuts = []
        for r in large:
            if how == "pca":
                c = np.array([[r[f"s{a}_{b}"] - r[f"m{a}"] * r[f"m{b}"] for b in range(dim)] for a in range(dim)])
                v = np.linalg.eigh(c)[1][:, -1]
                v = v * np.sign(v[np.abs(v).argmax()])
            else:
                v = np.zeros(dim)
                v[int(np.argmax([r[f"hi{d}"] - r[f"lo{d}"] for d in range(dim)]))] = 1.0
            cuts.append((r["cid"], v.tolist(), float(sum(v[d] * (r[f"lo{d}"] + r[f"hi{d}"]) / 2 for d in range(dim))), r["n"]))
        table = now.sparkSession.createDataFrame(cuts, "cid long, dir array<double>, mid double, n long")
        keyed = now.join(F.broadcast(table), "cid", "left").withColumn("key", F.aggregate(F.zip_with("x", "dir", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t))
        if by == "vol":
            right = F.col("key") > F.col("mid")
        else:
            keyed = global_rank(keyed, "cid", "key", "id")
            first = keyed.groupBy("cid").agg(F.min("rank").alias("first"))
            keyed = keyed.join(first, "cid")
            right = F.col("rank") - F.col("first") >= F.ceil(F.col("n") / 2)
        now = durable(keyed.select("id", "x", F.when(F.col("dir").isNull(), F.col("cid")).otherwise(2 * F.col("cid") + F.when(right, 1).otherwise(0)).alias("cid")), "bisect")
    return now.groupBy("cid").applyInPandas(_finish(ntile, how, by), "id long, x array<double>, cid long")


def curve(points: DataFrame, ntile: int, bits: int = 10, dim: int = 3) -> DataFrame:
    """points with pos along a Hilbert curve over their box and cid = pos div ntile."""
    box = bbox(points, dim=dim).first()
    if not box["n"]:
        return points.select("*", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("cid"))
    lo, hi = np.array(box["bbmin"]), np.array(box["bbmax"])
    width = np.where(hi > lo, hi - lo, 1.0)

    @F.pandas_udf("long")
    def key(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int64")
        cells = np.minimum(((np.array(x.tolist()) - lo) / width * (1 << bits)).astype(np.int64), (1 << bits) - 1)
        return pd.Series(hilbert_key(cells, bits))

    ranked = global_rank(points.withColumn("key", key("x")), "key", "id")
    return ranked.withColumnRenamed("rank", "pos").withColumn("cid", F.floor(F.col("pos") / ntile).cast("long"))


def ancestors(leaves: DataFrame, level: int) -> DataFrame:
    """leaves(cid paths) with `top`, the ancestor at a level: the flat clustering of that level."""
    depth = F.floor(F.log2(F.col("cid").cast("double")) + 1e-9).cast("int")
    return leaves.withColumn("top", F.when(depth > level, F.floor(F.col("cid") / F.pow(F.lit(2.0), (depth - level).cast("double"))).cast("long")).otherwise(F.col("cid")))


def collapsed(tree: DataFrame, levels: list[int]) -> DataFrame:
    """(level, cid, top, n, leaf): the clusters of some levels and all leaves, each with its nearest ancestor among them.

    One level and the leaves are a flat or Tile-H form, several levels a multi-level block low-rank one.
    """
    kept = tree.where(F.col("level").isin(levels) | F.col("leaf"))
    above = F.filter(F.sequence(F.lit(1), F.col("level")), lambda up: F.array_contains(F.array(*[F.lit(x) for x in levels]), F.col("level") - up))
    up = F.when(F.col("level") > 0, F.get(above, F.lit(0)))
    return kept.select("level", "cid", F.call_function("shiftright", F.col("cid"), up).alias("top"), "n", "leaf")


def overlaps(parts: DataFrame) -> DataFrame:
    """Blocks (rcid, ccid) of one level pair that lie inside another block of the table."""
    deep = F.least(*[F.floor(F.log2(F.col(c).cast("double")) + 1e-9).cast("int") for c in ("rcid", "ccid")])
    up = parts.where("rcid > 1 and ccid > 1").select("rcid", "ccid", F.explode(F.sequence(F.lit(1), deep)).alias("k"))
    above = up.select(F.col("rcid").alias("r"), F.col("ccid").alias("c"), F.call_function("shiftright", F.col("rcid"), F.col("k")).alias("rcid"), F.call_function("shiftright", F.col("ccid"), F.col("k")).alias("ccid"))
    return above.join(parts.select("rcid", "ccid"), ["rcid", "ccid"], "left_semi").select(F.col("r").alias("rcid"), F.col("c").alias("ccid"))


def cluster_table(leaves: DataFrame, dim: int = 3) -> DataFrame:
    """clusters(level, cid, parent, lo, hi, n, bbmin, bbmax, leaf) of all levels from points with leaf paths.

    Positions number points by leaf from left to right. Each point counts for the ancestors on its path, at most as many
    as there are levels; sums combine before they move.
    """
    depth = F.floor(F.log2(F.col("cid").cast("double")) + 1e-9).cast("int")
    deep = int(leaves.select(F.max(depth)).first()[0] or 0)
    order = (F.col("cid") * F.pow(F.lit(2.0), (F.lit(deep) - depth).cast("double"))).cast("long")
    ranked = global_rank(leaves.withColumn("_order", order), "_order", "id").drop("_order").withColumnRenamed("rank", "pos")
    up = ranked.withColumn("_depth", depth).select("pos", "x", "cid", "_depth", F.explode(F.sequence(F.lit(0), F.col("_depth"))).alias("level"))
    up = up.withColumn("node", F.floor(F.col("cid") / F.pow(F.lit(2.0), (F.col("_depth") - F.col("level")).cast("double"))).cast("long"))
    low = F.array(*[F.min(F.col("x")[d]) for d in range(dim)]).alias("bbmin")
    high = F.array(*[F.max(F.col("x")[d]) for d in range(dim)]).alias("bbmax")
    return up.groupBy("level", F.col("node").alias("cid")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"), low, high, F.max(F.col("cid") == F.col("node")).alias("leaf")).withColumn("parent", F.floor(F.col("cid") / 2).cast("long"))


def gap_squared(a: str, b: str, dim: int) -> Column:
    """Squared distance of two boxes given by column prefixes."""
    total = F.lit(0.0)
    for d in range(dim):
        g = F.greatest(F.col(f"{a}min")[d] - F.col(f"{b}max")[d], F.col(f"{b}min")[d] - F.col(f"{a}max")[d], F.lit(0.0))
        total = total + g * g
    return total


def diameter_squared(a: str, dim: int) -> Column:
    total = F.lit(0.0)
    for d in range(dim):
        total = total + F.pow(F.col(f"{a}max")[d] - F.col(f"{a}min")[d], 2)
    return total


def disjoint_axes(dim: int, allow: float = 0.0) -> Column:
    """Along how many axes boxes r and c are disjoint; touching counts, as does an overlap of `allow`."""
    total = F.lit(0)
    for d in range(dim):
        over = F.least(F.col("rmax")[d], F.col("cmax")[d]) - F.greatest(F.col("rmin")[d], F.col("cmin")[d])
        total = total + F.when(over <= allow, 1).otherwise(0)
    return total


def admissible(kind: str = "strong", eta: float = 2.0, codim: int = 1, dim: int = 3, allow: float = 0.0) -> Column:
    """Condition on box columns rmin, rmax, cmin, cmax and names rcid, ccid. Identical clusters are never admissible."""
    dist = gap_squared("r", "c", dim)
    strong = F.least(diameter_squared("r", dim), diameter_squared("c", dim)) <= F.lit(eta * eta) * dist
    strong = strong & (dist > 0) if eta > 0 else F.least(diameter_squared("r", dim), diameter_squared("c", dim)) == 0
    rule = {
        "strong": strong,
        "weak": strong | (disjoint_axes(dim, allow) >= (1 if dim == 1 else codim)),
        "vertex": strong | (disjoint_axes(dim, allow) >= dim),
        "offdiag": F.lit(True),
        "none": F.least(diameter_squared("r", dim), diameter_squared("c", dim)) == 0,
    }[kind]
    return (F.col("rcid") != F.col("ccid")) & rule


def boxes(clusters: DataFrame, side: str) -> DataFrame:
    return clusters.select(F.col("cid").alias(f"{side}cid"), F.col("bbmin").alias(f"{side}min"), F.col("bbmax").alias(f"{side}max"), F.col("n").alias(f"{side}n"))


def pairs(clusters: DataFrame, rule: Column) -> DataFrame:
    """(rcid, ccid, adm) of all pairs of one flat clustering: a theta join over clusters, of which there are few beside points."""
    return boxes(clusters, "r").join(boxes(clusters, "c"), how="cross").withColumn("adm", rule)


def block_partition(clusters: DataFrame, rule: Column) -> DataFrame:
    """Leaves (level, rcid, ccid, adm) of the block cluster tree: level by level, only inadmissible pairs go to sons x sons."""
    clusters = durable(clusters, "clusters")
    info = [clusters.select(F.col("cid").alias(f"{s}cid"), F.col("bbmin").alias(f"{s}min"), F.col("bbmax").alias(f"{s}max"), F.col("n").alias(f"{s}n"), F.col("leaf").alias(f"{s}leaf")) for s in "rc"]
    sons = [clusters.where("level > 0").select(F.col("parent").alias(f"{s}p"), F.col("cid").alias(f"{s}cid")) for s in "rc"]
    level, done = 0, None
    now = clusters.where("level = 0").select(F.col("cid").alias("rcid"), F.col("cid").alias("ccid"))
    while True:
        judged = durable(now.join(info[0], "rcid").join(info[1], "ccid").select("rcid", "ccid", rule.alias("adm"), (F.col("rleaf") | F.col("cleaf")).alias("end")), "pairs")
        stop = judged.where("adm or end").select(F.lit(level).alias("level"), "rcid", "ccid", "adm")
        done = stop if done is None else done.unionByName(stop)
        rest = judged.where("not adm and not end").select(F.col("rcid").alias("rp"), F.col("ccid").alias("cp"))
        if rest.isEmpty():
            return done
        now = rest.join(sons[0], "rp").join(sons[1], "cp").select("rcid", "ccid")
        level += 1


def range_lookup(rows: DataFrame, intervals: DataFrame, index: str = "i", tile: int = 1024) -> DataFrame:
    """rows joined to the interval (cid, lo, hi) that holds their index; both meet by tile, so that no range join is needed."""
    spread = intervals.withColumn("_t", F.explode(F.sequence(F.floor(F.col("lo") / tile), F.floor(F.col("hi") / tile))))
    keyed = rows.withColumn("_t", F.floor(F.col(index) / tile))
    return keyed.join(spread, "_t").where(F.col(index).between(F.col("lo"), F.col("hi"))).drop("_t")


def owners(blocks: DataFrame, procs: int, how: str) -> DataFrame:
    """blocks(bi, bj) with their owner under a cyclic distribution."""
    if how == "cyclic2d":
        p = int(np.sqrt(procs))
        if p * (procs // p) != procs:
            raise ValueError(f"{procs} is no product of {p} and a whole number")
        return blocks.withColumn("owner", (F.pmod("bi", F.lit(p)) * (procs // p) + F.pmod("bj", F.lit(procs // p))).cast("int"))
    key = F.col("bj") if how == "cyclic1d" else F.col("bi") + F.col("bj")
    return blocks.withColumn("owner", F.pmod(key, F.lit(procs)).cast("int"))
