"""Shared and nested bases of a given hierarchical matrix.

Uniform form: every cluster of every level has one orthonormal basis for all its far blocks, held in leaf pieces, and a far block
is a small coupling between two bases. Bases come from the blocks' factors, weighted by the triangle of the other side and put
side by side, through stacked QR factors. Nested form: only leaves keep bases; a cluster's basis is its sons' times transfer
matrices. They are found from the leaves up; what a cluster's basis must hold are its own shared basis and those of all clusters
above, restricted to it and weighted by what they are used for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import dense
from tilewright.operators import tall
from tilewright.operators.arrays import mapped_sum, summed
from tilewright.operators.hmatrix import PIECE, SEGMENT, HMatrix, _array, _depth, _mapped, apply_segments, nearfield, segments, vector, stored, with_dense_tiles
from tilewright.sources.storage import durable

BASIS = "side string, cid long, leaf long, m int, x array<double>"
COUPLING = "rcid long, ccid long, kr int, kc int, s array<double>"


@dataclass(frozen=True)
class Uniform:
    """h: the matrix (its near blocks, points and partition are used); bases(side, cid, leaf, m, x): rows of each cluster's orthonormal basis;
    couplings(rcid, ccid, kr, kc, s)."""

    h: HMatrix
    bases: DataFrame
    couplings: DataFrame


@dataclass(frozen=True)
class Nested:
    """h as in Uniform; leaves(side, leaf, m, x): bases of leaves; transfers(side, cid, parent, level, k, m, x): a son's k rows of its parent's transfer
    matrix with m columns; couplings(rcid, ccid, kr, kc, s)."""

    h: HMatrix
    leaves: DataFrame
    transfers: DataFrame
    couplings: DataFrame


def _sided(far: DataFrame) -> DataFrame:
    """far with cid, the cluster of the piece's side."""
    return far.withColumn("cid", F.when(F.col("side") == "r", F.col("rcid")).otherwise(F.col("ccid")))


def shared_bases(h: HMatrix, acc: dense.Acc = dense.Acc(rel=1e-8)) -> DataFrame:
    """BASIS rows: for each row ('r') and column ('c') cluster of a far block an orthonormal basis of the range of all its blocks, up to the accuracy."""
    h = stored(with_dense_tiles(h))
    far = _sided(h.far).where("k > 0")
    pieces = far.select("rcid", "ccid", "side", "cid", "leaf", "n", F.col("k").alias("m"), F.col("f").alias("x"))
    # the weight of a block's factor is the triangle of its other factor
    r = durable(tall.triangles(pieces.select("rcid", "ccid", "side", "m", "x"), ["rcid", "ccid", "side"]), "weights")
    other = r.select("rcid", "ccid", F.when(F.col("side") == "r", "c").otherwise("r").alias("side"), F.col("r").alias("w"))
    weighed = _mapped(pieces.join(other, ["rcid", "ccid", "side"]), lambda t: [(t.side, t.cid, t.rcid if t.side == "c" else t.ccid, t.leaf, t.n, t.m, (_array(t.x, t.n, t.m) @ _array(t.w, t.m, t.m).T).ravel())], "side string, cid long, other long, leaf long, n int, m int, x array<double>")

    def beside(pdf: pd.DataFrame) -> pd.DataFrame:
        """All factors of a cluster on one leaf, in the order of the other clusters; so many as the partition has blocks for a cluster."""
        first, pdf = pdf.iloc[0], pdf.sort_values("other")
        x = np.hstack([_array(x, first["n"], m) for x, m in zip(pdf["x"], pdf["m"], strict=True)])
        return pd.DataFrame([(first["side"], first["cid"], first["leaf"], x.shape[1], x.ravel())], columns=["side", "cid", "leaf", "m", "x"])

    rows = durable(weighed.groupBy("side", "cid", "leaf").applyInPandas(beside, BASIS), "beside")
    return _ranges(rows, ["side", "cid"], acc)


def _ranges(rows: DataFrame, keys: list[str], acc: dense.Acc) -> DataFrame:
    """rows of an orthonormal basis of each matrix's range up to the accuracy; the second pass makes it orthonormal to rounding."""

    def make(r: np.ndarray) -> np.ndarray:
        _, s, zt = np.linalg.svd(r)
        k = min(dense.trunc_rank(s, acc), int((s > 1e-14 * s[0]).sum()) if len(s) and s[0] > 0 else 0)
        return zt[:k].T / s[:k]

    cut = durable(tall.multiplied(rows, tall._from_triangles(rows, keys, make), keys).where("m > 0"), "range")
    return tall.orthonormal(cut, keys)


def to_uniform(h: HMatrix, acc: dense.Acc = dense.Acc(rel=1e-8)) -> Uniform:
    h = stored(with_dense_tiles(h))
    bases = shared_bases(h, acc)
    met = _sided(h.far).join(bases.select("side", "cid", "leaf", F.col("m").alias("kb"), "x"), ["side", "cid", "leaf"])
    seen = mapped_sum(met, lambda t: [(t.rcid, t.ccid, t.side, t.kb, t.k, (_array(t.x, t.n, t.kb).T @ _array(t.f, t.n, t.k)).ravel())], "rcid long, ccid long, side string, kb int, k int, x array<double>")
    seen = durable(seen, "seen")
    r = seen.where("side = 'r'").select("rcid", "ccid", "k", F.col("kb").alias("kr"), F.col("x").alias("a"))
    c = seen.where("side = 'c'").select("rcid", "ccid", F.col("kb").alias("kc"), F.col("x").alias("b"))
    both = r.join(c, ["rcid", "ccid"])
    couplings = _mapped(both, lambda t: [(t.rcid, t.ccid, t.kr, t.kc, (_array(t.a, t.kr, t.k) @ _array(t.b, t.kc, t.k).T).ravel())], COUPLING)
    return Uniform(h, bases, durable(couplings, "couplings"))


def from_uniform(u: Uniform) -> HMatrix:
    """The hierarchical matrix again: factors are W S and X."""
    w = u.couplings.join(u.bases.where("side = 'r'").select(F.col("cid").alias("rcid"), "leaf", "m", "x"), "rcid")
    left = _mapped(w, lambda t: [(t.rcid, t.ccid, "r", t.leaf, len(t.x) // t.m, t.kc, (_array(t.x, -1, t.m) @ _array(t.s, t.kr, t.kc)).ravel())], PIECE)
    x = u.couplings.select("rcid", "ccid").join(u.bases.where("side = 'c'").select(F.col("cid").alias("ccid"), "leaf", "m", "x"), "ccid")
    right = x.select("rcid", "ccid", F.lit("c").alias("side"), "leaf", (F.size("x") / F.col("m")).cast("int").alias("n"), F.col("m").alias("k"), F.col("x").alias("f"))
    return HMatrix(u.h.leaves, durable(left.unionByName(right), "far"), u.h.near, u.h.parts, u.h.tree)


def _coupled(couplings: DataFrame, coef: DataFrame) -> DataFrame:
    """(cid, m, x): sums of couplings times coefficients of column clusters, by row cluster."""
    met = couplings.join(coef.withColumnRenamed("cid", "ccid"), "ccid")
    return mapped_sum(met, lambda t: [(t.rcid, t.m, (_array(t.s, t.kr, t.kc) @ _array(t.x, t.kc, t.m)).ravel())], "cid long, m int, x array<double>")


def matvec_uniform(u: Uniform, x: DataFrame) -> DataFrame:
    """vec(i, v) of A x: forward to coefficients of all column clusters, couplings, back to the leaves; near blocks as they are."""
    segs = durable(segments(u.h, x), "segments")
    columns = u.bases.where("side = 'c'").select("cid", "leaf", F.col("m").alias("k"), F.col("x").alias("b")).join(segs, "leaf")
    coef = mapped_sum(columns, lambda t: [(t.cid, t.m, (_array(t.b, -1, t.k).T @ _array(t.x, -1, t.m)).ravel())], "cid long, m int, x array<double>")
    rows = u.bases.where("side = 'r'").select("cid", "leaf", F.col("m").alias("k"), F.col("x").alias("b")).join(_coupled(u.couplings, coef), "cid")
    far = _mapped(rows, lambda t: [(t.leaf, t.m, (_array(t.b, -1, t.k) @ _array(t.x, t.k, t.m)).ravel())], SEGMENT)
    return vector(u.h, summed(apply_segments(nearfield(u.h), segs).unionByName(far), ["leaf", "m"]))


def to_nested(u: Uniform, acc: dense.Acc = dense.Acc(rel=1e-8)) -> Nested:
    """Nested bases from shared ones, level by level from the leaves up.

    What a cluster has to hold comes from itself and all clusters above: the rows of their bases times the triangle of their couplings. A
    task gets one cluster's rows: its sons' ranks times the sum of those clusters' ranks, which the depth of the tree bounds.
    """
    # weights: of each cluster the triangle of its couplings put side by side
    c = u.couplings
    both = c.select(F.lit("r").alias("side"), F.col("rcid").alias("cid"), F.col("kr").alias("m"), "kr", "kc", "s").unionByName(c.select(F.lit("c").alias("side"), F.col("ccid").alias("cid"), F.col("kc").alias("m"), "kr", "kc", "s"))
    rows = _mapped(both, lambda t: [(t.side, t.cid, t.m, (_array(t.s, t.kr, t.kc).T if t.side == "r" else _array(t.s, t.kr, t.kc)).ravel())], "side string, cid long, m int, x array<double>")
    weights = durable(tall.triangles(rows, ["side", "cid"]).select("side", "cid", F.col("r").alias("w")), "weights")
    # state: for a cluster `at` and a cluster `cid` at or above it, the rows of cid's basis on it, in at's own basis (on leaves: in points)
    state = u.bases.select("side", F.col("leaf").alias("at"), "cid", "m", (F.size("x") / F.col("m")).cast("int").alias("n"), "x")
    deepest = u.h.tree.agg(F.max("level")).first()[0] or 0
    schema = "side string, at long, cid long, m int, n int, x array<double>, basis array<double>"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        """Stacks what the sons have (or takes a leaf's rows), finds the basis, and gives every cid's rows in it."""
        side, at = pdf["side"].iloc[0], int(pdf["at"].iloc[0])
        sons = sorted({(int(s), int(n)) for s, n in zip(pdf["son"], pdf["n"], strict=True)})
        start, total = {}, 0
        for s, n in sons:
            start[s], total = total, total + n
        held, used = {}, {}
        for s, cid, m, n, x, w in pdf[["son", "cid", "m", "n", "x", "w"]].itertuples(index=False):
            held.setdefault(int(cid), np.zeros((total, m)))[start[int(s)] : start[int(s)] + n] = _array(x, n, m)
            used[int(cid)] = _array(w, m, m).T
        whole = np.hstack([held[k] @ used[k] for k in sorted(held)])
        v, s, _ = np.linalg.svd(whole, full_matrices=False)
        v = v[:, : dense.trunc_rank(s, acc)] if len(s) and s[0] > 0 else v[:, :0]
        out = [(side, at, k, held[k].shape[1], v.shape[1], (v.T @ held[k]).ravel(), None) for k in sorted(held)]
        return pd.DataFrame([*out, (side, at, -1, v.shape[1], total, None, v.ravel())], columns=["side", "at", "cid", "m", "n", "x", "basis"])

    leaf_bases, transfers, own = None, None, None
    now = last = None
    for level in range(deepest, -1, -1):
        here = state.where(_depth(F.col("at")) == level).select("side", "at", F.lit(0).cast("long").alias("son"), "cid", "m", "n", "x")
        if now is not None:
            up = now.where("cid >= 0 and cid <> at").select("side", F.shiftright("at", 1).alias("at"), F.col("at").alias("son"), "cid", "m", "n", "x")
            here = here.unionByName(up)
        now = durable(here.join(weights, ["side", "cid"]).groupBy("side", "at").applyInPandas(step, schema), "level")
        made = now.where("cid < 0")
        leaves = made.where("basis is not null").join(u.h.leaves.select(F.col("leaf").alias("at")), "at").select("side", F.col("at").alias("leaf"), "m", F.col("basis").alias("x"))
        inner = made.join(u.h.leaves.select(F.col("leaf").alias("at")), "at", "left_anti")
        if level < deepest and last is not None:
            # rows of the transfer matrix by son: sons in order, each with as many rows as its basis has columns
            ranks = last.where("cid < 0").select("side", F.col("at").alias("son"), F.shiftright("at", 1).alias("at"), F.col("m").alias("k"))
            met = inner.join(ranks, ["side", "at"])
            first = ranks.where("son % 2 = 0").select("side", "at", F.col("k").alias("before"))
            met = met.join(first, ["side", "at"], "left")
            cut = _mapped(met, lambda t: [(t.side, t.son, t.at, t.k, t.m, _array(t.basis, t.n, t.m)[(int(t.before) if t.son % 2 and t.before == t.before and t.before is not None else 0) :][: t.k].ravel())], "side string, cid long, parent long, k int, m int, x array<double>").withColumn("level", F.lit(level))
            transfers = cut if transfers is None else transfers.unionByName(cut)
        done = now.where("cid = at").select("side", "cid", "m", "n", "x")
        leaf_bases = leaves if leaf_bases is None else leaf_bases.unionByName(leaves)
        own = done if own is None else own.unionByName(done)
        last = now
    turn = durable(own, "own")  # of each cluster: its shared basis in the nested one, n x m
    r, col = (turn.where(F.col("side") == s).select(F.col("cid").alias(f"{s}cid"), F.col("n").alias(f"n{s}"), F.col("x").alias(f"t{s}")) for s in "rc")
    couplings = _mapped(c.join(r, "rcid").join(col, "ccid"), lambda t: [(t.rcid, t.ccid, t.nr, t.nc, (_array(t.tr, t.nr, t.kr) @ _array(t.s, t.kr, t.kc) @ _array(t.tc, t.nc, t.kc).T).ravel())], COUPLING)
    none = _mapped(u.h.leaves.where(F.lit(False)), lambda t: [], "side string, cid long, parent long, k int, m int, x array<double>").withColumn("level", F.lit(0))
    return Nested(u.h, durable(leaf_bases, "leaf-bases"), durable(none if transfers is None else transfers, "transfers"), durable(couplings, "couplings"))


def matvec_nested(nested: Nested, x: DataFrame) -> DataFrame:
    """vec(i, v) of A x: up by transfers from sons to parents, couplings, down again; near blocks as they are."""
    segs = durable(segments(nested.h, x), "segments")
    base = nested.leaves.select("side", "leaf", F.col("m").alias("k"), F.col("x").alias("b"))
    first = _mapped(base.where("side = 'c' and k > 0").join(segs, "leaf"), lambda t: [(t.leaf, t.m, (_array(t.b, -1, t.k).T @ _array(t.x, -1, t.m)).ravel())], "cid long, m int, x array<double>")
    every = durable(first, "up")
    t = nested.transfers.where("k > 0 and m > 0").select("side", "level", "cid", "parent", "k", F.col("m").alias("kp"), F.col("x").alias("e"))
    span = t.agg(F.min("level"), F.max("level")).first()
    levels = range(span[1], span[0] - 1, -1) if span[0] is not None else range(0)
    for level in levels:
        met = t.where((F.col("side") == "c") & (F.col("level") == level)).join(every, "cid")
        lifted = mapped_sum(met, lambda r: [(r.parent, r.m, (_array(r.e, r.k, r.kp).T @ _array(r.x, r.k, r.m)).ravel())], "cid long, m int, x array<double>")
        every = durable(every.unionByName(lifted), "up")
    down = durable(_coupled(nested.couplings, every), "down")
    for level in reversed(levels):
        met = t.where((F.col("side") == "r") & (F.col("level") == level)).join(down.withColumnRenamed("cid", "parent"), "parent")
        lowered = _mapped(met, lambda r: [(r.cid, r.m, (_array(r.e, r.k, r.kp) @ _array(r.x, r.kp, r.m)).ravel())], "cid long, m int, x array<double>")
        down = durable(summed(down.unionByName(lowered), ["cid", "m"]), "down")
    far = _mapped(base.where("side = 'r' and k > 0").join(down.withColumnRenamed("cid", "leaf"), "leaf"), lambda r: [(r.leaf, r.m, (_array(r.b, -1, r.k) @ _array(r.x, r.k, r.m)).ravel())], SEGMENT)
    return vector(nested.h, summed(apply_segments(nearfield(nested.h), segs).unionByName(far), ["leaf", "m"]))


def rank_info(form: Uniform | Nested) -> DataFrame:
    """(side, level, clusters, min_rank, avg_rank, max_rank) of cluster bases, ranks of 0 left out."""
    if isinstance(form, Uniform):
        ranks = form.bases.select("side", "cid", F.col("m").alias("rank")).distinct()
    else:
        ranks = form.leaves.select("side", F.col("leaf").alias("cid"), F.col("m").alias("rank")).unionByName(form.transfers.select("side", F.col("parent").alias("cid"), F.col("m").alias("rank")).distinct())
    by = ranks.where("rank > 0").withColumn("level", _depth(F.col("cid"))).groupBy("side", "level")
    return by.agg(F.count("*").alias("clusters"), F.min("rank").alias("min_rank"), F.floor(F.avg("rank")).cast("int").alias("avg_rank"), F.max("rank").alias("max_rank"))


def memory(form: Uniform | Nested) -> DataFrame:
    """One row: bytes of bases (and transfers), of couplings and of near blocks."""
    bytes_of = lambda t, c: t.agg(F.coalesce(8 * F.sum(F.size(c)), F.lit(0)).cast("long").alias("b"))
    bases = bytes_of(form.bases, "x") if isinstance(form, Uniform) else bytes_of(form.leaves.select("x").unionByName(form.transfers.select("x")), "x")
    return bases.withColumnRenamed("b", "basis_bytes").join(bytes_of(form.couplings, "s").withColumnRenamed("b", "coupling_bytes")).join(bytes_of(form.h.near, "d").withColumnRenamed("b", "near_bytes"))  # one row each
