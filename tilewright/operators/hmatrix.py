"""Hierarchical kernel matrices over clusters of points: build, product, conversion, factorisation.

Points are held by leaf (at most ntile of them to a row), and so are the factors of a far block: a row for each block, side and
leaf, with the leaf's rows of U or V. No task sees a whole high cluster. Far blocks come from points on the clusters' boxes
(cross pivots, interpolation), so that they are never formed, or from kernel rows and columns of clusters up to SMALL points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import dense, kernels
from tilewright.operators import blocks as B
from tilewright.operators import clusters as C
from tilewright.operators import tall
from tilewright.operators.arrays import framed, mapped_sum, summed
from tilewright.sources.storage import durable, held

#: Far blocks of more points on a side are not made from their own rows and columns; such pairs are split first.
SMALL = 2048
#: The segments of one vector, whose rows were counted, go to all tasks up to so many leaves: blocks and factors then stay where they are.
MANY = 16384
PIECE = "rcid long, ccid long, side string, leaf long, n int, k int, f array<double>"
NEARBY = "rleaf long, cleaf long, nr int, nc int, d array<double>"
LIGHT = ["rleaf", "cleaf", "nr", "nc", "p", "q", "v"]


@dataclass(frozen=True)
class HMatrix:
    """leaves(leaf, ids, xs, dim): points by leaf, in the order of all arrays; far(rcid, ccid, side r|c, leaf, n, k, f): factor rows;
    near(rleaf, cleaf, nr, nc, d): dense blocks of leaves; parts(rcid, ccid, adm, nr, nc): the block partition; tree: its clusters;
    light(rleaf, cleaf, nr, nc, p, q, v): blocks of leaves held as entries v at rows p and columns q, if the matrix is sparse.

    Blocks and factors of build() are made where they are read, from points and pivots: a product writes neither. What reads them often stores them first."""

    leaves: DataFrame
    far: DataFrame
    near: DataFrame
    parts: DataFrame
    tree: DataFrame
    light: DataFrame | None = None


def gaussian(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The kernel of matrices for which none is given."""
    return kernels.array("gaussian", x, y, eps=1.0)


def stored(h: HMatrix) -> HMatrix:
    """h whose blocks and factors are tables, for operators that read them many times."""
    return replace(h, far=held(h.far, "far")[0], near=held(h.near, "near")[0])


def _mapped(rows: DataFrame, f: Callable, schema: str) -> DataFrame:
    """Rows of f(row), which yields tuples."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield from framed((x for r in t.itertuples() for x in f(r)), names)

    return rows.mapInPandas(run, schema)


def _spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Small rows that mean much work each, over all cores: by their bytes alone they would meet in a few tasks."""
    return rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def _array(x, *shape: int) -> np.ndarray:
    return np.asarray(x, float).reshape(shape)


def _depth(c: Column) -> Column:
    return F.floor(F.log2(c.cast("double")) + 1e-9).cast("int")


def paths(leaves: DataFrame) -> DataFrame:
    """(leaf, cid) for each leaf and every cluster that holds it."""
    up = F.transform(F.sequence(F.lit(0), _depth(F.col("leaf"))), lambda d: F.call_function("shiftright", F.col("leaf"), d))
    return leaves.select("leaf", F.explode(up).alias("cid"))


def build(leaves: DataFrame, rule: Column, acc: dense.Acc = dense.Acc(rel=1e-10), kernel: Callable | None = None, far: str = "hca", order: int = 4, dim: int = 3) -> HMatrix:
    """H-matrix of a kernel f(x, y) -> |x| x |y| array over points (id, x, cid) with leaf paths.

    far: 'hca' picks pivots on Chebyshev grids of both boxes, whose order grows from the given one with the accuracy, and then takes
    kernel values at points and pivots alone;
    'interpolation' compresses the kernel between the grids; 'aca', or a name of dense.APPROX, works on the points of clusters
    up to SMALL, the former by entries alone.
    """
    f = kernel or gaussian
    by_points = far not in ("hca", "interpolation")
    table, up, parts, tree = _partitioned(leaves, rule & (F.col("rn") <= SMALL) & (F.col("cn") <= SMALL) if by_points else rule, dim)
    pieces = (_far_by_points if by_points else _far_by_boxes)(parts.where("adm"), table, up, tree, f, acc, far, order)
    return HMatrix(table, durable(pieces, "far") if by_points else pieces, _near(parts.where("not adm"), table, up, f), parts, tree)


def _partitioned(leaves: DataFrame, rule: Column, dim: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(points by leaf, paths, parts, tree) of points (id, x, cid) with leaf paths."""
    leaves = durable(leaves, "leaves")
    tree = durable(C.cluster_table(leaves, dim), "tree")
    parts = C.block_partition(tree, rule)
    size = tree.select("cid", "n")
    parts = parts.join(size.select(F.col("cid").alias("rcid"), F.col("n").alias("nr")), "rcid").join(size.select(F.col("cid").alias("ccid"), F.col("n").alias("nc")), "ccid")
    parts = durable(parts.select("rcid", "ccid", "adm", "nr", "nc"), "parts")
    table = leaves.groupBy(F.col("cid").alias("leaf")).agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("p"), F.first(F.size("x")).alias("dim"))
    table = durable(table.select("leaf", F.transform("p", lambda s: s["id"]).alias("ids"), F.flatten(F.transform("p", lambda s: s["x"])).alias("xs"), "dim"), "points")
    return table, durable(paths(table), "paths"), parts, tree


def _meeting(pairs: DataFrame, table: DataFrame, up: DataFrame) -> DataFrame:
    """(rleaf, rx, cleaf, cx, dim): the leaves of pairs that are not admissible (one of them may be no leaf)."""
    r = up.join(table, "leaf").select(F.col("cid").alias("rcid"), F.col("leaf").alias("rleaf"), F.col("xs").alias("rx"), "dim")
    c = up.join(table, "leaf").select(F.col("cid").alias("ccid"), F.col("leaf").alias("cleaf"), F.col("xs").alias("cx"))
    return pairs.join(r, "rcid").join(c, "ccid")


def _near(pairs: DataFrame, table: DataFrame, up: DataFrame, f: Callable) -> DataFrame:
    """Dense blocks between the leaves of pairs that are not admissible."""

    def entries(row) -> Iterator[tuple]:
        d = f(_array(row.rx, -1, row.dim), _array(row.cx, -1, row.dim))
        yield row.rleaf, row.cleaf, *d.shape, d.ravel()

    return _mapped(_spread(_meeting(pairs, table, up), "rleaf", "cleaf"), entries, NEARBY)


def _flat(axes: list[np.ndarray]) -> tuple[list[int], np.ndarray]:
    return [len(a) for a in axes], np.concatenate(axes)


def _pivots(f: Callable, rows: tuple, cols: tuple, acc: dense.Acc, order: int) -> tuple:
    """Grids on two boxes and a cross approximation between them, no tighter than the grids interpolate (tighter pivots would be noise)."""
    a, b, off = dense.fitting_grids(f, rows, cols, acc, order)
    gr, gc = dense.grid_points(a), dense.grid_points(b)
    held = acc if acc.rank is not None else replace(acc, rel=max(acc.rel, 4 * off))
    found = dense.cross(lambda i: f(gr[i : i + 1], gc)[0], lambda j: f(gr, gc[j : j + 1])[:, 0], len(gr), len(gc), held)
    return gr, gc, *found, (a, b)


def _far_by_boxes(pairs: DataFrame, table: DataFrame, up: DataFrame, tree: DataFrame, f: Callable, acc: dense.Acc, far: str, order: int) -> DataFrame:
    info = [C.boxes(tree, s).drop(f"{s}n") for s in "rc"]

    def pivots(row) -> Iterator[tuple]:
        gr, gc, rows, cols, u, v, orders = _pivots(f, (row.rmin, row.rmax), (row.cmin, row.cmax), acc, order)
        if not rows:
            return
        if far == "hca":
            core = f(gr[rows], gc[cols])
            yield row.rcid, row.ccid, "r", len(rows), gc[cols].ravel(), core.ravel(), None, None
            yield row.rcid, row.ccid, "c", len(rows), gr[rows].ravel(), None, None, None
        else:
            yield row.rcid, row.ccid, "r", len(rows), None, u.ravel(), *_flat(orders[0])
            yield row.rcid, row.ccid, "c", len(rows), None, v.ravel(), *_flat(orders[1])

    found = _mapped(_spread(pairs.select("rcid", "ccid").join(info[0], "rcid").join(info[1], "ccid"), "rcid", "ccid"), pivots, "rcid long, ccid long, side string, k int, p array<double>, m array<double>, counts array<int>, axes array<double>")
    found = durable(found, "pivots")
    def factors(row) -> Iterator[tuple]:
        x = _array(row.xs, -1, row.dim)
        if far == "interpolation":
            axes = np.split(np.asarray(row.axes, float), np.cumsum(row.counts)[:-1])
            part = dense.lagrange(x, axes) @ _array(row.m, -1, row.k)
        elif row.side == "r":
            part = np.linalg.solve(_array(row.m, row.k, row.k).T, f(x, _array(row.p, row.k, row.dim)).T).T
        else:
            part = f(_array(row.p, row.k, row.dim), x).T
        yield row.rcid, row.ccid, row.leaf, len(x), row.k, part.ravel()

    def made(side: str) -> DataFrame:
        """The factors of one side: its name stands outside of the map, so that who asks for one side makes one."""
        at = found.where(F.col("side") == side).withColumn("cid", F.col(f"{side}cid")).join(up, "cid").join(table, "leaf")
        out = _mapped(at, factors, PIECE.replace("side string, ", ""))
        return out.select("rcid", "ccid", F.lit(side).alias("side"), "leaf", "n", "k", "f")

    return made("r").unionByName(made("c"))


def _far_by_points(pairs: DataFrame, table: DataFrame, up: DataFrame, tree: DataFrame, f: Callable, acc: dense.Acc, far: str, order: int) -> DataFrame:
    used = pairs.select(F.explode(F.array("rcid", "ccid")).alias("cid")).distinct()
    held = up.join(used, "cid").join(table, "leaf").groupBy("cid").agg(F.collect_list(F.struct("leaf", F.size("ids").alias("n"), "xs")).alias("of"), F.first("dim").alias("dim"))  # at most SMALL points each
    # plain arrays of numbers: structs would be Python objects in the tasks, many times as large
    held = durable(held.select("cid", "dim", F.col("of.leaf").alias("leaf"), F.col("of.n").alias("n"), F.flatten("of.xs").alias("xs")), "gathered")
    side = lambda s: held.select(F.col("cid").alias(f"{s}cid"), *[F.col(c).alias(f"{s}{c}") for c in ("leaf", "n", "xs")], *(["dim"] if s == "r" else []))
    both = pairs.select("rcid", "ccid").join(side("r"), "rcid").join(side("c"), "ccid").repartition(F.xxhash64("rcid", "ccid"))

    def factors(row) -> Iterator[tuple]:
        x, y = _array(row.rxs, -1, row.dim), _array(row.cxs, -1, row.dim)
        if far == "aca":
            _, _, u, v = dense.cross(lambda i: f(x[i : i + 1], y)[0], lambda j: f(x, y[j : j + 1])[:, 0], len(x), len(y), acc)
            u, v = dense.truncate(u, v, acc)
        else:
            u, v = dense.APPROX[far](f(x, y), acc)
        for side, whole, leaves, sizes in (("r", u, row.rleaf, row.rn), ("c", v, row.cleaf, row.cn)):
            at = 0
            for leaf, n in zip(leaves, sizes, strict=True):
                if whole.shape[1]:
                    yield row.rcid, row.ccid, side, leaf, n, whole.shape[1], whole[at : at + n].ravel()
                at += n

    return _mapped(both, factors, PIECE)


def add_identity(h: HMatrix, value: float = 1.0) -> HMatrix:
    def run(r) -> Iterator[tuple]:
        d = _array(r.d, r.nr, r.nc)
        yield r.rleaf, r.cleaf, r.nr, r.nc, (d + value * np.eye(r.nr) if r.rleaf == r.cleaf else d).ravel()

    return replace(h, near=_mapped(h.near, run, NEARBY))


def transpose(h: HMatrix) -> HMatrix:
    far = h.far.select(F.col("ccid").alias("rcid"), F.col("rcid").alias("ccid"), F.when(F.col("side") == "r", "c").otherwise("r").alias("side"), "leaf", "n", "k", "f")
    near = _mapped(h.near, lambda r: [(r.cleaf, r.rleaf, r.nc, r.nr, _array(r.d, r.nr, r.nc).T.ravel())], NEARBY)
    parts = h.parts.select(F.col("ccid").alias("rcid"), F.col("rcid").alias("ccid"), "adm", F.col("nc").alias("nr"), F.col("nr").alias("nc"))
    light = None if h.light is None else h.light.select(*[F.col(a).alias(b) for a, b in zip(("cleaf", "rleaf", "nc", "nr", "q", "p", "v"), LIGHT, strict=True)])
    return HMatrix(h.leaves, far, near, parts, h.tree, light)


def with_dense_tiles(h: HMatrix) -> HMatrix:
    """h whose blocks of entries, if it has any, are dense blocks: for operators that make every block dense anyway."""
    if h.light is None:
        return h

    def fill(r) -> Iterator[tuple]:
        yield r.rleaf, r.cleaf, r.nr, r.nc, _tile_times(r, np.eye(r.nc)).ravel()

    return replace(h, near=h.near.unionByName(_mapped(h.light, fill, NEARBY)), light=None)


def _tile_times(r, x: np.ndarray, flip: bool = False) -> np.ndarray:
    """A block of two leaves (transposed, if flip) times x: a row of dense numbers d, or of entries v at p and q."""
    if hasattr(r, "d"):
        d = _array(r.d, r.nr, r.nc)
        return (d.T if flip else d) @ x
    into, of = (r.q, r.p) if flip else (r.p, r.q)
    out = np.zeros((r.nc if flip else r.nr, x.shape[1]))
    np.add.at(out, into, np.asarray(r.v, float)[:, None] * x[of])
    return out


def nearfield(h: HMatrix) -> HMatrix:
    return replace(h, far=h.far.where(F.lit(False)))


def farfield(h: HMatrix) -> HMatrix:
    return replace(h, near=h.near.where(F.lit(False)), light=None)


# Segments: (leaf, m, x) with m columns for the points of a leaf, row by row.
SEGMENT = "leaf long, m int, x array<double>"


def segments(h: HMatrix, x: DataFrame) -> DataFrame:
    """Segments of vec(i, v); missing values are 0."""
    rows = h.leaves.select("leaf", F.posexplode("ids").alias("at", "i")).join(x, "i", "left")
    held = rows.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("v", F.lit(0.0)).alias("v")))).alias("s"))
    return held.select("leaf", F.lit(1).alias("m"), F.transform("s", lambda s: s["v"]).alias("x"))


def vector(h: HMatrix, segs: DataFrame) -> DataFrame:
    return h.leaves.join(segs, "leaf").select(F.explode(F.arrays_zip("ids", "x")).alias("e")).select(F.col("e.ids").alias("i"), F.col("e.x").alias("v"))


def apply_segments(h: HMatrix, segs: DataFrame) -> DataFrame:
    """Segments of H X for segments of X: coefficients of far blocks are summed over their leaves, then spread over the other side's."""
    near = mapped_sum(h.near.join(segs.withColumnRenamed("leaf", "cleaf"), "cleaf"), lambda r: [(r.rleaf, r.m, (_array(r.d, r.nr, r.nc) @ _array(r.x, r.nc, r.m)).ravel())], SEGMENT)
    down = h.far.where("side = 'c'").join(segs, "leaf")
    coef = mapped_sum(down, lambda r: [(r.rcid, r.ccid, r.m, (_array(r.f, r.n, r.k).T @ _array(r.x, r.n, r.m)).ravel())], "rcid long, ccid long, m int, x array<double>")
    up = h.far.where("side = 'r'").join(coef, ["rcid", "ccid"])
    far = mapped_sum(up, lambda r: [(r.leaf, r.m, (_array(r.f, r.n, r.k) @ _array(r.x, r.k, r.m)).ravel())], SEGMENT)
    if h.light is not None:
        met = h.light.join(segs.withColumnRenamed("leaf", "cleaf"), "cleaf")
        near = near.unionByName(mapped_sum(met, lambda r: [(r.rleaf, r.m, _tile_times(r, _array(r.x, r.nc, r.m)).ravel())], SEGMENT))
    return summed(near.unionByName(far), ["leaf", "m"])


def matvec(h: HMatrix, x: DataFrame, transposed: bool = False) -> DataFrame:
    """vec(i, v) of H x or H^T x."""
    segs = durable(segments(h, x), "segments")
    few = segs.count() <= MANY
    return vector(h, apply_segments(transpose(h) if transposed else h, F.broadcast(segs) if few else segs))


def ones(h: HMatrix) -> DataFrame:
    return h.leaves.select(F.explode("ids").alias("i"), F.lit(1.0).alias("v"))


def memory_report(h: HMatrix) -> DataFrame:
    """One row: bytes of a dense matrix of all points, of the near blocks (as dense ones) and of the factors, and entries that the partition covers."""
    h = with_dense_tiles(h)
    near = h.near.agg(F.coalesce(F.sum(8 * F.col("nr").cast("long") * F.col("nc")), F.lit(0)).alias("near_bytes"))
    far = h.far.agg(F.coalesce(F.sum(8 * F.col("n").cast("long") * F.col("k")), F.lit(0)).alias("far_bytes"))
    whole = h.leaves.agg(F.sum(F.size("ids")).alias("points")).select((8 * F.col("points") * F.col("points")).alias("full_bytes"))
    area = h.parts.agg(F.sum(F.col("nr") * F.col("nc")).alias("area"))
    return whole.join(near).join(far).join(area)  # one row each


def memory_plan(leaves: DataFrame, rule: Column, acc: dense.Acc, kernel: Callable | None = None, order: int = 4, dim: int = 3) -> DataFrame:
    """(level, rcid, ccid, adm, k, bytes) of each block that build() would make, from boxes and counts alone: no point meets another."""
    f = kernel or gaussian
    tree = durable(C.cluster_table(leaves, dim), "tree")
    parts = durable(C.block_partition(tree, rule), "parts")
    both = _spread(parts.join(C.boxes(tree, "r"), "rcid").join(C.boxes(tree, "c"), "ccid"), "rcid", "ccid")

    def size(r) -> Iterator[tuple]:
        k = 0
        if r.adm:
            k = len(_pivots(f, (r.rmin, r.rmax), (r.cmin, r.cmax), acc, order)[2])
        yield r.level, r.rcid, r.ccid, r.adm, k, 8 * (k * (r.rn + r.cn) if r.adm else r.rn * r.cn)

    return _mapped(both, size, "level int, rcid long, ccid long, adm boolean, k int, bytes long")


# Conversion to other partitions.


def _target(r: str, c: str) -> tuple[Column, Column]:
    """The off-diagonal pair of sons that holds a pair of clusters: where their paths part."""
    depth = F.least(_depth(F.col(r)), _depth(F.col(c)))
    cut = [F.call_function("shiftright", F.col(x), _depth(F.col(x)) - depth) for x in (r, c)]
    apart = F.floor(F.log2(cut[0].bitwiseXOR(cut[1]).cast("double")) + 1e-9).cast("int")
    return tuple(F.call_function("shiftright", x, apart) for x in cut)


def _compressed(leaves: DataFrame, near: DataFrame, far: DataFrame, rank: int, acc: dense.Acc, over: int = 10, seed: int = 3) -> DataFrame:
    """Factor pieces of new low-rank blocks (tr, tc), each the sum of the near and far blocks that name it.

    Ranges of all new blocks are found at once by products of the old blocks with random segments; their orthonormal bases come
    from QR factors stacked over leaves, and the bases' products with the old blocks, truncated, give the other factors.
    """
    width = rank + over
    keys = "tr long, tc long, leaf long, m int, x array<double>"

    def product(segs: DataFrame, into: str, out: str, by: list[str]) -> DataFrame:
        """(tr, tc, leaf, m, x): old blocks times segments of side `into`; by: how segments meet them."""
        flip = into == "r"
        met = near.withColumnsRenamed({"rleaf": "leaf", "cleaf": "to"} if flip else {"cleaf": "leaf", "rleaf": "to"}).join(segs, by)
        a = mapped_sum(met, lambda r: [(r.tr, r.tc, r.to, r.m, _tile_times(r, _array(r.x, -1, r.m), flip).ravel())], keys)
        down = _mapped(far.where(F.col("side") == into).join(segs, by), lambda r: [(r.tr, r.tc, r.rcid, r.ccid, r.m, (_array(r.f, r.n, r.k).T @ _array(r.x, r.n, r.m)).ravel())], "tr long, tc long, rcid long, ccid long, m int, x array<double>")
        coef = summed(down, ["rcid", "ccid", "m"])
        b = _mapped(far.where(F.col("side") == out).join(coef, ["rcid", "ccid"]), lambda r: [(r.tr, r.tc, r.leaf, r.m, (_array(r.f, r.n, r.k) @ _array(r.x, r.k, r.m)).ravel())], keys)
        return durable(summed(a.unionByName(b), ["tr", "tc", "leaf", "m"]), "range")

    sample = _mapped(leaves, lambda r: [(r.leaf, width, np.random.default_rng([seed, r.leaf]).standard_normal((len(r.ids), width)).ravel())], SEGMENT)
    y = product(sample, "c", "r", ["leaf"])
    for _ in range(2):  # the second pass makes the basis orthonormal to rounding
        y = tall.orthonormal(y, ["tr", "tc"])
    z = product(y.select("tr", "tc", "leaf", "m", "x"), "r", "c", ["tr", "tc", "leaf"])
    small = tall.singular(z, ["tr", "tc"], acc, rank)

    def turned(t: DataFrame, side: str) -> DataFrame:
        met = t.join(small, ["tr", "tc"])
        return _mapped(met, lambda r: [(r.tr, r.tc, side, r.leaf, len(r.x) // r.m, r.k, (_array(r.x, -1, r.m) @ _array(r.w, r.m, r.k)).ravel())] if r.k else [], PIECE)

    return durable(turned(y, "r").unionByName(turned(z, "c")), "far")


def _parts_of(pieces: DataFrame, near: DataFrame) -> DataFrame:
    size = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
    far = pieces.groupBy("rcid", "ccid").agg(F.lit(True).alias("adm"), size("r").alias("nr"), size("c").alias("nc"))
    return far.unionByName(near.select(F.col("rleaf").alias("rcid"), F.col("cleaf").alias("ccid"), F.lit(False).alias("adm"), F.col("nr").cast("long").alias("nr"), F.col("nc").cast("long").alias("nc")))


def converted(h: HMatrix, rank: int, acc: dense.Acc, whole: bool = False) -> HMatrix:
    """HODLR form (every pair of sibling clusters low-rank, leaves of the diagonal dense), or, if whole, one low-rank block."""
    h = with_dense_tiles(h)
    diag = F.col("rleaf") == F.col("cleaf")
    one = F.lit(1).cast("long")
    place = (lambda r, c: (one, one)) if whole else _target
    (fr, fc), (nr, nc) = place("rcid", "ccid"), place("rleaf", "cleaf")
    far = durable(h.far.withColumns({"tr": fr, "tc": fc}), "placed")
    near = durable((h.near if whole else h.near.where(~diag)).withColumns({"tr": nr, "tc": nc}), "placed")
    pieces = _compressed(h.leaves, near, far, rank, acc)
    rest = h.near.where(F.lit(False) if whole else diag)
    return HMatrix(h.leaves, pieces, rest, _parts_of(pieces, rest), h.tree)


def from_entries(a: DataFrame, leaves: DataFrame, rule: Column, rank: int, acc: dense.Acc, dim: int = 1) -> HMatrix:
    """H-matrix of sparse coo(i, j, v) over clusters of its indices (points id with leaf paths): entries meet by pairs of leaves, those of an admissible
    block become one low-rank block where that holds it at the accuracy (at a rank of at most `rank`) in no more numbers than its entries take; the
    other blocks keep their entries, by pairs of leaves, as dense tiles where those are smaller. No table grows faster than the entries."""
    leaves = durable(leaves, "leaves")
    tree = durable(C.cluster_table(leaves, dim), "tree")
    parts = durable(C.block_partition(tree, rule).select("rcid", "ccid", "adm"), "parts")
    table = leaves.groupBy(F.col("cid").alias("leaf")).agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("p"), F.first(F.size("x")).alias("dim"))
    table = durable(table.select("leaf", F.transform("p", lambda s: s["id"]).alias("ids"), F.flatten(F.transform("p", lambda s: s["x"])).alias("xs"), "dim"), "points")
    at = table.select("leaf", F.size("ids").alias("n"), F.posexplode("ids").alias("p", "id"))
    row = at.select(F.col("id").alias("i"), F.col("leaf").alias("rleaf"), F.col("p"), F.col("n").alias("nr"))
    col = at.select(F.col("id").alias("j"), F.col("leaf").alias("cleaf"), F.col("p").alias("q"), F.col("n").alias("nc"))

    at = a.join(row, "i").join(col, "j").groupBy("rleaf", "cleaf").agg(F.first("nr").alias("nr"), F.first("nc").alias("nc"), F.collect_list(F.struct(F.col("p"), F.col("q"), F.col("v").cast("double").alias("v"))).alias("e"))
    tiles = durable(at.select("rleaf", "cleaf", "nr", "nc", *[F.col(f"e.{c}").alias(c) for c in "pqv"]), "tiles")
    up = lambda c: F.call_function("shiftright", F.col(c), _depth(F.col(c)) - F.col("level"))
    levels = tiles.select("rleaf", "cleaf", F.explode(F.sequence(F.lit(0), F.least(_depth(F.col("rleaf")), _depth(F.col("cleaf"))))).alias("level"))
    found = levels.select("rleaf", "cleaf", up("rleaf").alias("rcid"), up("cleaf").alias("ccid")).join(parts, ["rcid", "ccid"])
    placed = durable(tiles.join(found, ["rleaf", "cleaf"]), "placed")
    far = placed.where("adm").withColumnsRenamed({"rcid": "tr", "ccid": "tc"}).drop("adm")
    sizes = [far.groupBy("tr", "tc", f"{s}leaf").agg(F.first(f"n{s}").alias("n")).groupBy("tr", "tc").agg(F.sum("n").alias(f"n{s}")) for s in "rc"]
    counts = far.groupBy("tr", "tc").agg(F.sum(F.size("v")).alias("count")).join(sizes[0], ["tr", "tc"]).join(sizes[1], ["tr", "tc"])
    most = F.least(F.lit(rank), F.floor(2 * F.col("count") / (F.col("nr") + F.col("nc")))).cast("int")  # an entry takes two numbers: its value and its place
    tried = durable(counts.select("tr", "tc", most.alias("most")).where("most > 0"), "tried")
    widest = tried.agg(F.max("most")).first()[0]
    none = a.sparkSession.createDataFrame([], PIECE)
    pieces, light = none, placed
    if widest:
        nothing = a.sparkSession.createDataFrame([], PIECE + ", tr long, tc long")
        # one rank more than any block may have: a block that reaches it is not held by its factors
        made = _compressed(table, far.join(tried.select("tr", "tc"), ["tr", "tc"], "left_semi"), nothing, widest + 1, acc)
        held = made.select("rcid", "ccid", "k").distinct().join(tried.select(F.col("tr").alias("rcid"), F.col("tc").alias("ccid"), "most"), ["rcid", "ccid"]).where("k <= most").select("rcid", "ccid")
        held = durable(held, "held")
        pieces, light = durable(made.join(held, ["rcid", "ccid"], "left_semi"), "far"), placed.join(held, ["rcid", "ccid"], "left_anti")
    solid = (F.col("rleaf") == F.col("cleaf")) | (2 * F.size("v") >= F.col("nr") * F.col("nc"))
    near = durable(_mapped(light.where(solid), lambda r: [(r.rleaf, r.cleaf, r.nr, r.nc, _tile_times(r, np.eye(r.nc)).ravel())], NEARBY), "near")
    light = durable(light.where(~solid).select(LIGHT), "light")
    return HMatrix(table, pieces, near, _parts_of(pieces, near.drop("d").unionByName(light.select("rleaf", "cleaf", "nr", "nc"))), tree, light)


# Factorisation of a HODLR form.


@dataclass(frozen=True)
class HodlrFactors:
    """inverse(leaf, n, d): inverses of the diagonal leaves; levels, the deepest first: (rows, cols, core), where rows(p, half, leaf, n, k, f)
    are the left factors with the levels below already solved, cols(p, half, ...) the right factors that meet them, and core(p, k0, k1, s) the
    inverse of the small system of node p."""

    h: HMatrix
    inverse: DataFrame
    levels: tuple


def hodlr_factors(h: HMatrix) -> HodlrFactors:
    """Product form of a HODLR matrix by 2 x 2 recursion: [A, U V^T; X Y^T, B] is diag(A, B) times a low-rank change of the identity.

    Levels are done from the leaves up, all nodes of a level at once; each step solves what is below for the factors above
    (the low-rank Schur update) by joins on leaves and sums by node.
    """
    h = replace(with_dense_tiles(h), far=held(h.far, "far")[0])
    inverse = durable(_mapped(h.near, lambda r: [(r.rleaf, r.nr, np.linalg.inv(_array(r.d, r.nr, r.nc)).ravel())], "leaf long, n int, d array<double>"), "inverse")
    far = h.far.withColumns({"p": F.shiftright("rcid", 1), "half": (F.col("rcid") % 2).cast("int"), "depth": _depth(F.shiftright("rcid", 1))})
    rows = far.where("side = 'r'").select("p", "half", "depth", "leaf", F.col("k").alias("m"), F.col("f").alias("x"))
    rows = durable(_leaf_solved(rows, inverse), "solved")
    deepest = rows.agg(F.max("depth")).first()[0]
    levels = []
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        own = durable(rows.where(F.col("depth") == depth).select("p", "half", "leaf", F.col("m").alias("k"), F.col("x").alias("f")), "own")
        cols = durable(far.where((F.col("side") == "c") & (F.col("depth") == depth)).select("p", "half", "leaf", "k", "f"), "cols")
        core = durable(_core(own, cols), "core")
        level = (own, cols, core)
        levels.append(level)
        rest = rows.where(F.col("depth") < depth)
        if depth:
            rows = durable(_changed(rest.withColumnsRenamed({"p": "q", "half": "h"}), level, ["q", "h", "depth"]).withColumnsRenamed({"q": "p", "h": "half"}), "changed")
    return HodlrFactors(h, inverse, tuple(levels))


def _leaf_solved(rows: DataFrame, inverse: DataFrame) -> DataFrame:
    keep = [c for c in rows.columns if c not in ("leaf", "m", "x")]
    schema = ", ".join([*(f"{c} {dict(rows.dtypes)[c].replace('bigint', 'long')}" for c in keep), SEGMENT])
    return _mapped(rows.join(inverse, "leaf"), lambda r: [(*(getattr(r, c) for c in keep), r.leaf, r.m, (_array(r.d, r.n, r.n) @ _array(r.x, r.n, r.m)).ravel())], schema)


def _core(own: DataFrame, cols: DataFrame) -> DataFrame:
    """(p, k0, k1, s): inverse of [I, V0^T W1; V1^T W0, I], where W0, W1 are the left factors on the first and second son."""
    met = cols.select("p", "half", "leaf", "k", "f").join(own.select("p", "leaf", F.col("half").alias("other"), F.col("k").alias("m"), F.col("f").alias("x")), ["p", "leaf"])
    got = mapped_sum(met, lambda r: [(r.p, r.half, r.k, r.m, (_array(r.f, -1, r.k).T @ _array(r.x, -1, r.m)).ravel())], "p long, half int, k int, m int, x array<double>")
    sizes = own.groupBy("p").agg(F.coalesce(F.max(F.when(F.col("half") == 0, F.col("k"))), F.lit(0)).alias("k0"), F.coalesce(F.max(F.when(F.col("half") == 1, F.col("k"))), F.lit(0)).alias("k1"))
    held = sizes.join(got.groupBy("p").agg(F.collect_list(F.struct("half", "x")).alias("of")), "p", "left")

    def solve(r) -> Iterator[tuple]:
        s = np.eye(r.k0 + r.k1)
        for part in r.of if r.of is not None else []:
            if part["half"] == 0:
                s[: r.k0, r.k0 :] = _array(part["x"], r.k0, r.k1)
            else:
                s[r.k0 :, : r.k0] = _array(part["x"], r.k1, r.k0)
        yield r.p, r.k0, r.k1, np.linalg.inv(s).ravel()

    return _mapped(held, solve, "p long, k0 int, k1 int, s array<double>")


def _changed(rows: DataFrame, level: tuple, keys: list[str]) -> DataFrame:
    """rows(keys, leaf, m, x) less W S^-1 V^T rows of the level's nodes; leaves below no node of the level stay as they are."""
    own, cols, core = level
    kind = ", ".join(f"{c} {dict(rows.dtypes)[c].replace('bigint', 'long')}" for c in keys)
    seen = _mapped(cols.join(rows, "leaf"), lambda r: [(r.p, r.half, r.k, *(getattr(r, c) for c in keys), r.m, (_array(r.f, -1, r.k).T @ _array(r.x, -1, r.m)).ravel())], f"p long, half int, k int, {kind}, m int, x array<double>")
    seen = summed(seen, ["p", "half", "k", *keys, "m"]).groupBy("p", *keys, "m").agg(F.collect_list(F.struct("half", "x")).alias("of"))

    def solve(r) -> Iterator[tuple]:
        y = np.zeros((r.k0 + r.k1, r.m))
        for part in r.of:
            at = slice(0, r.k0) if part["half"] == 0 else slice(r.k0, None)
            y[at] = _array(part["x"], -1, r.m)
        c = _array(r.s, len(y), len(y)) @ y
        for half, at in ((0, slice(0, r.k0)), (1, slice(r.k0, None))):
            if c[at].size:
                yield r.p, half, *(getattr(r, k) for k in keys), c[at].ravel()

    coef = _mapped(seen.join(core, "p"), solve, f"p long, half int, {kind}, c array<double>")
    met = own.join(coef, ["p", "half"])
    less = _mapped(met, lambda r: [(*(getattr(r, k) for k in keys), r.leaf, len(r.c) // r.k, -(_array(r.f, -1, r.k) @ _array(r.c, r.k, -1)).ravel())], f"{kind}, {SEGMENT}")
    return summed(rows.select(*keys, "leaf", "m", "x").unionByName(less), [*keys, "leaf", "m"])


def hodlr_solve(factors: HodlrFactors, b: DataFrame) -> DataFrame:
    """vec(i, v) of A^-1 b."""
    x = durable(_leaf_solved(segments(factors.h, b).withColumn("one", F.lit(1)), factors.inverse), "solved")
    for level in factors.levels:
        x = durable(_changed(x, level, ["one"]), "changed")
    return vector(factors.h, x)


# Nested bases of any depth.


def matvec_nested(leaves: DataFrame, rule: Column, x: DataFrame, kernel: Callable | None = None, order: int = 6, dim: int = 3) -> DataFrame:
    """vec(i, v) of a kernel matrix times x with nested bases: interpolation at leaves, transfers from sons to parents, couplings of boxes.

    Up, level by level: a parent's coefficients are its sons' through Lagrange values of its grid at theirs. Couplings are kernel values between
    grids; down again the same way. Every cluster holds at most order^dim numbers, whatever its size.
    """
    f = kernel or gaussian
    table, up, parts, clusters = _partitioned(leaves, rule, dim)
    none = table.sparkSession.createDataFrame([], PIECE)
    near = parts.where("not adm")
    h = HMatrix(table, none, _near(near, table, up, f), parts, clusters)  # near blocks are made where they meet the vector, below
    tree = h.tree.select("level", "cid", "parent", "leaf", "bbmin", "bbmax")
    grid = lambda lo, hi: dense.grid_axes(np.asarray(lo), np.asarray(hi), order)
    segs = durable(segments(h, x), "segments")
    points = h.leaves.join(tree.select(F.col("cid").alias("leaf"), "bbmin", "bbmax", "level"), "leaf")
    now = _mapped(points.join(segs, "leaf"), lambda r: [(r.level, r.leaf, (dense.lagrange(_array(r.xs, -1, r.dim), grid(r.bbmin, r.bbmax)).T @ np.asarray(r.x)).ravel())], "level int, cid long, x array<double>")
    now = durable(now, "up")
    deepest = tree.agg(F.max("level")).first()[0] or 0
    every, family = now, tree.join(tree.select(F.col("cid").alias("parent"), F.col("bbmin").alias("pmin"), F.col("bbmax").alias("pmax")), "parent")
    for level in range(deepest, 0, -1):
        sons = every.where(F.col("level") == level).select("cid", "x").join(family, "cid")
        lifted = _mapped(sons, lambda r: [(r.level - 1, r.parent, (dense.lagrange(dense.grid_points(grid(r.bbmin, r.bbmax)), grid(r.pmin, r.pmax)).T @ np.asarray(r.x)).ravel())], "level int, cid long, x array<double>")
        every = durable(every.unionByName(summed(lifted, ["level", "cid"])), "up")
    far = h.parts.where("adm").join(C.boxes(h.tree, "r"), "rcid").join(C.boxes(h.tree, "c"), "ccid").join(every.select(F.col("cid").alias("ccid"), "x"), "ccid")
    far = _spread(far, "rcid", "ccid")
    met = _mapped(far, lambda r: [(r.rcid, (f(dense.grid_points(grid(r.rmin, r.rmax)), dense.grid_points(grid(r.cmin, r.cmax))) @ np.asarray(r.x)).ravel())], "cid long, x array<double>")
    down = durable(summed(met, ["cid"]).join(tree.select("cid", "level"), "cid").select("level", "cid", "x"), "down")
    for level in range(1, deepest + 1):
        parents = down.where(F.col("level") == level - 1).select(F.col("cid").alias("parent"), "x").join(family, "parent")
        lowered = _mapped(parents, lambda r: [(r.level, r.cid, (dense.lagrange(dense.grid_points(grid(r.bbmin, r.bbmax)), grid(r.pmin, r.pmax)) @ np.asarray(r.x)).ravel())], "level int, cid long, x array<double>")
        down = durable(summed(down.unionByName(lowered), ["level", "cid"]), "down")
    out = _mapped(points.join(down.select(F.col("cid").alias("leaf"), "x"), "leaf"), lambda r: [(r.leaf, 1, (dense.lagrange(_array(r.xs, -1, r.dim), grid(r.bbmin, r.bbmax)) @ np.asarray(r.x)).ravel())], SEGMENT)
    beside = _meeting(near, table, up).join(segs.withColumnRenamed("leaf", "cleaf"), "cleaf")
    direct = mapped_sum(beside, lambda r: [(r.rleaf, r.m, (f(_array(r.rx, -1, r.dim), _array(r.cx, -1, r.dim)) @ _array(r.x, -1, r.m)).ravel())], SEGMENT)
    return vector(h, summed(direct.unionByName(out), ["leaf", "m"]))


# Sparse matrices and geometry studies.


def from_sparse(a: DataFrame, tile: int, acc: dense.Acc) -> DataFrame:
    """coo of a block matrix from sparse entries: off-diagonal tiles low-rank where that is smaller, empty ones absent."""
    rows, cols = (int(x) + 1 for x in a.agg(F.max("i"), F.max("j")).first())
    return B.to_coo(B.each(B.to_blocks(a, rows, cols, tile, tile), lambda b: [b] if b.bi == b.bj else [b.smaller(acc)]))


#: Where the second of two unit cubes lies to the first.
CONTACT = {"face": (1.0, 0.0, 0.0), "edge": (1.0, 1.0, 0.0), "vertex": (1.0, 1.0, 1.0), "apart": (2.0, 0.0, 0.0)}


def rank_study(points: DataFrame, tile: int, kernel: Callable, acc: dense.Acc) -> DataFrame:
    """(tile, geometry, norm, k): norm from the singular values, and the numerical rank, of the kernel between each tile of points (ids) in a unit
    cube and the same points in a cube that shares a face, an edge or a vertex with it, or lies apart."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["x"].tolist(), float)
        out = []
        for name, shift in CONTACT.items():
            s = np.linalg.svd(kernel(x, x + np.array(shift)[: x.shape[1]]), compute_uv=False)
            out.append((int(pdf["tile"].iloc[0]), name, float(np.sqrt((s**2).sum())), dense.trunc_rank(s, acc)))
        return pd.DataFrame(out, columns=["tile", "geometry", "norm", "k"])

    return points.withColumn("tile", F.floor(F.col("id") / tile).cast("long")).groupBy("tile").applyInPandas(run, "tile long, geometry string, norm double, k int")
