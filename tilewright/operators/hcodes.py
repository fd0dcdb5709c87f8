"""Hierarchical matrices in U S V form and with encoded columns, and products that decode as they go.

Each far block becomes orthonormal factors and singular values; each column of a factor is then encoded for itself, at the precision that its
singular value leaves it (small ones need few bits), and near blocks at the precision of the whole. The table of encoded pieces is all that
a product reads: bytes are decoded within the task that uses them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import codecs, dense
from tilewright.operators import tall
from tilewright.operators.arrays import mapped_sum, summed
from tilewright.operators.hmatrix import PIECE, SEGMENT, HMatrix, _array, _depth, _mapped, segments, vector, stored, with_dense_tiles
from tilewright.sources.storage import durable

KEYS = ["rcid", "ccid"]
HEAD = "bits array<int>, m array<int>, scale array<double>, z array<binary>"
CODED = f"rcid long, ccid long, side string, leaf long, n int, k int, {HEAD}"
CODED_NEAR = "rleaf long, cleaf long, nr int, nc int, bits int, m int, scale double, z binary"


@dataclass(frozen=True)
class Encoded:
    """h: points and partition; far (CODED rows: the columns of a piece one by one), sigma(rcid, ccid, s) and near (CODED_NEAR rows)."""

    h: HMatrix
    far: DataFrame
    sigma: DataFrame
    near: DataFrame


def usv(h: HMatrix, acc: dense.Acc = dense.Acc(rel=1e-12)) -> tuple[HMatrix, DataFrame]:
    """h with orthonormal factors on both sides of each far block, and sigma(rcid, ccid, s): the block is U diag(s) V^T; columns beyond the accuracy go."""
    h = stored(with_dense_tiles(h))
    side = lambda s: h.far.where((F.col("side") == s) & (F.col("k") > 0)).select(*KEYS, "leaf", F.col("k").alias("m"), F.col("f").alias("x"))
    u, v = side("r"), side("c")
    q = tall.orthonormal(tall.orthonormal(v, KEYS), KEYS)
    both = q.select(*KEYS, "leaf", F.col("m").alias("k"), F.col("x").alias("f")).join(v, [*KEYS, "leaf"])
    turn = mapped_sum(both, lambda r: [(r.rcid, r.ccid, r.k, r.m, (_array(r.f, -1, r.k).T @ _array(r.x, -1, r.m)).ravel())], "rcid long, ccid long, k int, m0 int, x array<double>")
    z = _mapped(u.join(turn.withColumnRenamed("x", "t"), KEYS), lambda r: [(r.rcid, r.ccid, r.leaf, r.k, (_array(r.x, -1, r.m) @ _array(r.t, r.k, r.m0).T).ravel())], "rcid long, ccid long, leaf long, m int, x array<double>")
    z = durable(z, "left")

    def make(r: np.ndarray) -> np.ndarray:
        """Right singular vectors with the singular values as one more row."""
        _, s, wt = np.linalg.svd(r)
        k = min(dense.trunc_rank(s, acc), int((s > 1e-15 * s[0]).sum()) if len(s) and s[0] > 0 else 0)
        return np.vstack([wt[:k].T, s[:k]])

    found = tall._from_triangles(z, KEYS, make).where("k > 0")
    sigma = durable(_mapped(found, lambda r: [(r.rcid, r.ccid, _array(r.w, -1, r.k)[-1])], "rcid long, ccid long, s array<double>"), "sigma")

    def turned(r) -> Iterator[tuple]:
        w = _array(r.w, r.m + 1, r.k)
        x = _array(r.x, -1, r.m) @ w[:-1]
        yield r.rcid, r.ccid, r.side, r.leaf, len(x), r.k, (x / w[-1] if r.side == "r" else x).ravel()

    sided = z.withColumn("side", F.lit("r")).unionByName(q.withColumn("side", F.lit("c")))
    far = durable(_mapped(sided.join(found, KEYS), turned, PIECE), "far")
    return HMatrix(h.leaves, far, h.near, h.parts, h.tree), sigma


def encode(h: HMatrix, delta: float = 1e-6, codec: str = "aflp") -> Encoded:
    """Far blocks err by about delta of their sum of singular values, near blocks by delta of each value."""
    h = stored(with_dense_tiles(h))
    orth, sigma = usv(h, dense.Acc(rel=delta / 8))

    def columns(r) -> Iterator[tuple]:
        x, s = _array(r.f, r.n, r.k), np.asarray(r.s, float)
        tol = codecs.column_tolerances(s / s.sum(), delta / 4)
        coded = [codecs.encode(x[:, j], codec, min(0.5, float(t))) for j, t in enumerate(tol)]
        yield r.rcid, r.ccid, r.side, r.leaf, r.n, r.k, [c["bits"] for _, c in coded], [c["m"] for _, c in coded], [c["scale"] for _, c in coded], [z for z, _ in coded]

    def block(r) -> Iterator[tuple]:
        z, head = codecs.encode(np.asarray(r.d, float), codec, delta)
        yield r.rleaf, r.cleaf, r.nr, r.nc, head["bits"], head["m"], head["scale"], z

    far = durable(_mapped(orth.far.join(sigma, KEYS), columns, CODED), "coded")
    return Encoded(h, far, sigma, durable(_mapped(h.near, block, CODED_NEAR), "coded"))


def _columns(r) -> np.ndarray:
    """The n x k array of a CODED row."""
    return np.column_stack([codecs.decode(z, {"codec": "aflp", "n": r.n, "bits": b, "m": m, "scale": s}) for z, b, m, s in zip(r.z, r.bits, r.m, r.scale, strict=True)])


def matvec(e: Encoded, x: DataFrame) -> DataFrame:
    """vec(i, v) of A x from the encoded table."""
    segs = durable(segments(e.h, x), "segments").withColumnRenamed("m", "width")
    near = e.near.join(segs.withColumnRenamed("leaf", "cleaf"), "cleaf")
    one = _mapped(near, lambda r: [(r.rleaf, r.width, (codecs.decode(r.z, {"codec": "aflp", "n": r.nr * r.nc, "bits": r.bits, "m": r.m, "scale": r.scale}).reshape(r.nr, r.nc) @ _array(r.x, r.nc, r.width)).ravel())], SEGMENT)
    down = e.far.where("side = 'c'").join(segs, "leaf")
    coef = mapped_sum(down, lambda r: [(r.rcid, r.ccid, r.width, (_columns(r).T @ _array(r.x, r.n, r.width)).ravel())], "rcid long, ccid long, width int, x array<double>")
    up = e.far.where("side = 'r'").join(coef.join(e.sigma, KEYS), KEYS)
    two = _mapped(up, lambda r: [(r.leaf, r.width, (_columns(r) @ (np.asarray(r.s)[:, None] * _array(r.x, r.k, r.width))).ravel())], SEGMENT)
    return vector(e.h, summed(one.unionByName(two), ["leaf", "m"]))


def bytes_by_level(e: Encoded) -> DataFrame:
    """(level, kind, full_bytes, coded_bytes) of far factors (with singular values and column headers) and near blocks."""
    far = e.far.select(_depth(F.col("rcid")).alias("level"), F.lit("far").alias("kind"), (8 * F.col("n").cast("long") * F.col("k")).alias("full"), F.aggregate("z", F.lit(0).cast("long"), lambda s, z: s + F.octet_length(z) + 16).alias("coded"))
    s = e.sigma.select(_depth(F.col("rcid")).alias("level"), F.lit("far").alias("kind"), F.lit(0).cast("long").alias("full"), (8 * F.size("s")).cast("long").alias("coded"))
    near = e.near.select(_depth(F.col("rleaf")).alias("level"), F.lit("near").alias("kind"), (8 * F.col("nr").cast("long") * F.col("nc")).alias("full"), (F.octet_length("z") + 16).cast("long").alias("coded"))
    return far.unionByName(s).unionByName(near).groupBy("level", "kind").agg(F.sum("full").alias("full_bytes"), F.sum("coded").alias("coded_bytes"))
