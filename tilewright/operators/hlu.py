"""LU factorisation of HODLR matrices with real triangular factors, all nodes of a level at once.

The diagonal block of a cluster, once everything left of it is eliminated, is the given one plus a low-rank change P Q^T. From
the root down, each node hands its left son the change it has, and its right son the truncated Schur update; the left
son's inverse in that update comes from the product form of the given matrix and a small system (Woodbury). Leaves are
then factorised side by side. From the leaves up, the off-diagonal factors of all nodes above are solved with the triangles
found so far, which gives L and U as hierarchical matrices, and, with both halves solved, forms whose solves also go level by
level and not leaf after leaf. No pivots are sought: leaves need nonsingular leading blocks, as for any block LU.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import dense
from tilewright.operators import tall
from tilewright.operators.arrays import mapped_sum, summed
from tilewright.operators.hmatrix import PIECE, SEGMENT, HMatrix, HodlrFactors, _array, _changed, _depth, _leaf_solved, _mapped, _parts_of, hodlr_factors, segments, vector, stored, with_dense_tiles
from tilewright.operators.solvers import _lu
from tilewright.sources.storage import durable

#: Of a node's leaves: rows of the left factor (m1 columns) and of the right factor (m2), the last m of each from the Schur update.
NODE = "p long, half int, leaf long, n int, m int, m1 int, x1 array<double>, m2 int, x2 array<double>"
CHANGE = "cid long, leaf long, n int, m int, px array<double>, qx array<double>"
SOLVED = "system string, p long, depth int, half int, leaf long, m int, x array<double>"


@dataclass(frozen=True)
class HodlrLU:
    """lower, upper: L (unit diagonal) and U as hierarchical matrices; diagonal(leaf, n, lo, up): their leaves;
    levels, the deepest first: SOLVED rows of a depth's nodes, system 'L' and 'U': left halves are the other triangle's factors, right halves
    are solved with their own."""

    lower: HMatrix
    upper: HMatrix
    diagonal: DataFrame
    levels: tuple


def _beside(a, b, n: int) -> np.ndarray:
    return np.hstack([np.asarray(x, float).reshape(n, -1) if x is not None and len(x) else np.zeros((n, 0)) for x in (a, b)])


def _node_rows(h: HMatrix, changes: DataFrame, depth: int) -> DataFrame:
    """NODE rows of all nodes of a depth that have sons: given factors beside those of the change."""
    far = h.far.where(_depth(F.col("rcid")) == depth + 1).withColumns({"p": F.shiftright("rcid", 1), "half": (F.col("rcid") % 2).cast("int")})
    # of block (son, other son): rows of U lie on the son's leaves, those of V on the other's
    u = far.where("side = 'r'").select("p", "half", "leaf", F.col("f").alias("u"))
    v = far.where("side = 'c'").select("p", (1 - F.col("half")).alias("half"), "leaf", F.col("f").alias("v"))
    son = F.call_function("shiftright", F.col("leaf"), F.greatest(_depth(F.col("leaf")) - depth - 1, F.lit(0)))
    own = h.leaves.where(_depth(F.col("leaf")) > depth).select(F.shiftright(son, 1).alias("p"), (son % 2).cast("int").alias("half"), "leaf", F.size("ids").alias("n"))
    q = changes.select(F.col("cid").alias("p"), "leaf", "m", "px", "qx")
    met = own.join(u, ["p", "half", "leaf"], "left").join(v, ["p", "half", "leaf"], "left").join(q, ["p", "leaf"], "left")

    def both(r) -> Iterator[tuple]:
        x1, x2 = _beside(r.u, r.px, r.n), _beside(r.v, r.qx, r.n)
        m = 0 if r.px is None else len(r.px) // r.n
        yield r.p, r.half, r.leaf, r.n, m, x1.shape[1], x1.ravel(), x2.shape[1], x2.ravel()

    return durable(_mapped(met, both, NODE), "nodes")


def _schur(rows: DataFrame, factors: HodlrFactors, depth: int, deepest: int, acc: dense.Acc) -> DataFrame:
    """CHANGE rows of the sons of a depth's nodes."""
    left, right = rows.where("half = 0"), rows.where("half = 1")
    # A_l^-1 G by the product form of the levels below
    x = _leaf_solved(left.where("m1 > 0").select(F.col("p").alias("node"), "leaf", F.col("m1").alias("m"), F.col("x1").alias("x")), factors.inverse)
    for k, level in enumerate(factors.levels):
        if deepest - k > depth:
            x = durable(_changed(durable(x, "solved"), level, ["node"]).select("node", "leaf", "m", "x"), "solved")
    met = left.where("m1 > 0 and m2 > 0").select("p", "leaf", "n", F.col("m").alias("shared"), "m2", "x2").join(x.withColumnRenamed("node", "p"), ["p", "leaf"])
    t = mapped_sum(met, lambda r: [(r.p, r.shared, r.m2, r.m, (_array(r.x2, r.n, r.m2).T @ _array(r.x, r.n, r.m)).ravel())], "p long, shared int, m2 int, m1 int, x array<double>")

    def middle(r) -> Iterator[tuple]:
        t, k2, k1 = _array(r.x, r.m2, r.m1), r.m2 - r.shared, r.m1 - r.shared
        out = np.zeros((r.m2, r.m1))
        if r.shared:
            out[k2:, k1:] = np.eye(r.shared)
            t = t - t[:, k1:] @ np.linalg.solve(np.eye(r.shared) + t[k2:, k1:], t[k2:])
        yield r.p, r.m2, r.m1, (out - t).ravel()

    core = durable(_mapped(t, middle, "p long, k2 int, k1 int, s array<double>"), "core")
    # right sons: E S^T-part, with E the left factor (of the block below the diagonal) and H the right factor of the block above: P Q^T = E S H^T
    met = right.where("m1 > 0 and m2 > 0").join(core, "p")
    e = met.select((2 * F.col("p") + 1).alias("cid"), "leaf", F.col("m1").alias("m"), F.col("x1").alias("x"))
    z = _mapped(met, lambda r: [(2 * r.p + 1, r.leaf, r.m1, (_array(r.x2, r.n, r.m2) @ _array(r.s, r.k2, r.k1).T).ravel())], "cid long, leaf long, m int, x array<double>")
    e, z = durable(e, "left"), durable(z, "right")
    q = tall.orthonormal(e, ["cid"])
    both = q.select("cid", "leaf", F.col("m").alias("k"), F.col("x").alias("f")).join(e, ["cid", "leaf"])
    turn = mapped_sum(both, lambda r: [(r.cid, r.k, r.m, (_array(r.f, -1, r.k).T @ _array(r.x, -1, r.m)).ravel())] if r.k else [], "cid long, k int, m int, x array<double>")
    z = _mapped(z.join(turn.withColumnsRenamed({"x": "t", "m": "m0"}), "cid"), lambda r: [(r.cid, r.leaf, r.k, (_array(r.x, -1, r.m) @ _array(r.t, r.k, r.m0).T).ravel())], "cid long, leaf long, m int, x array<double>")
    z = durable(z, "right")
    w = tall.singular(z, ["cid"], acc).withColumnRenamed("k", "kept")
    held = q.join(z.withColumnsRenamed({"x": "y", "m": "my"}), ["cid", "leaf"]).join(w, "cid").where("kept > 0")

    def turned(r) -> Iterator[tuple]:
        w = _array(r.w, r.m, r.kept)
        px, qx = _array(r.x, -1, r.m) @ w, _array(r.y, -1, r.m) @ w
        yield r.cid, r.leaf, len(px), r.kept, px.ravel(), qx.ravel()

    def passed(r) -> Iterator[tuple]:
        x1, x2 = _array(r.x1, r.n, r.m1), _array(r.x2, r.n, r.m2)
        yield 2 * r.p, r.leaf, r.n, r.m, x1[:, r.m1 - r.m :].ravel(), x2[:, r.m2 - r.m :].ravel()

    return durable(_mapped(held, turned, CHANGE).unionByName(_mapped(left.where("m > 0"), passed, CHANGE)), "changes")


def _met(state: DataFrame, level: DataFrame, transposed: bool) -> DataFrame:
    """(keys..., leaf, m, x) of what a level's nodes take off: on right halves, from sums over left ones (or, transposed, the other way round).

    state(system, key, leaf, m, x); on the side that is summed the factors are those of the other triangle.
    """
    a, b = (1, 0) if transposed else (0, 1)
    flip = F.when(F.col("system") == "L", "U").otherwise("L")
    # transposed solves sum the own triangle's solved right half and spread the other's left half
    source = level.where(F.col("half") == a).select((F.col("system") if transposed else flip).alias("system"), F.col("p").alias("node"), "leaf", F.col("m").alias("k"), F.col("x").alias("f"))
    target = level.where(F.col("half") == b).select((flip if transposed else F.col("system")).alias("system"), F.col("p").alias("node"), "leaf", F.col("m").alias("k"), F.col("x").alias("f"))
    got = _mapped(source.join(state, ["system", "leaf"]).where("k > 0"), lambda r: [(r.system, r.node, r.key, r.m, (_array(r.f, -1, r.k).T @ _array(r.x, -1, r.m)).ravel())], "system string, node long, key long, m int, x array<double>")
    coef = summed(got, ["system", "node", "key", "m"])
    spread = lambda r: [(r.system, r.key, r.leaf, r.m, -(_array(r.f, -1, r.k) @ _array(r.x, r.k, r.m)).ravel())] if r.k else []
    return _mapped(target.join(coef, ["system", "node"]), spread, f"system string, key long, {SEGMENT}")


def _without(state: DataFrame, level: DataFrame, transposed: bool = False) -> DataFrame:
    keys = ["system", "key", "leaf", "m"]
    return durable(summed(state.select(*keys, "x").unionByName(_met(state, level, transposed)), keys), "solved")


def _triangular(r, system: str, transposed: bool, x: np.ndarray) -> np.ndarray:
    """Leaf solves: L and U^T forwards, their transposes backwards."""
    d = _array(r.lo, r.n0, r.n0) if system == "L" else _array(r.up, r.n0, r.n0).T
    return np.linalg.solve(d.T if transposed else d, x)


def _on_leaves(state: DataFrame, diagonal: DataFrame, transposed: bool) -> DataFrame:
    met = state.join(diagonal.withColumnRenamed("n", "n0"), "leaf")
    return durable(_mapped(met, lambda r: [(r.system, r.key, r.leaf, r.m, _triangular(r, r.system, transposed, _array(r.x, r.n0, r.m)).ravel())], f"system string, key long, {SEGMENT}"), "solved")


def factorise(h: HMatrix, acc: dense.Acc = dense.Acc(rel=1e-12)) -> HodlrLU:
    """L and U of a HODLR matrix (see converted); Schur updates are truncated to the accuracy."""
    h = stored(with_dense_tiles(h))
    factors = hodlr_factors(h)
    deepest = len(factors.levels) - 1
    changes = durable(_mapped(h.leaves.where(F.lit(False)), lambda r: [], CHANGE), "changes")
    nodes, done = [], []
    for depth in range(deepest + 1):
        rows = _node_rows(h, changes, depth)
        nodes.append(rows)
        done.append(changes.where("cid = leaf"))
        changes = _schur(rows, factors, depth, deepest, acc)
    ended = done[0]
    for more in [*done[1:], changes.where("cid = leaf")]:
        ended = ended.unionByName(more)
    met = h.near.select(F.col("rleaf").alias("leaf"), F.col("nr").alias("n"), "d").join(ended.select("leaf", "m", "px", "qx"), "leaf", "left")

    def leaf(r) -> Iterator[tuple]:
        s = _array(r.d, r.n, r.n)
        if r.px is not None:
            s = s + _array(r.px, r.n, -1) @ _array(r.qx, r.n, -1).T
        lo, up = _lu(s)
        yield r.leaf, r.n, lo.ravel(), up.ravel()

    diagonal = durable(_mapped(met, leaf, "leaf long, n int, lo array<double>, up array<double>"), "diagonal")

    every = None
    for depth, rows in enumerate(nodes):
        here = [rows.select(F.lit(s).alias("system"), F.col("p").alias("key"), F.lit(depth).alias("depth"), "half", "leaf", F.col(f"m{k}").alias("m"), F.col(f"x{k}").alias("x")).where("m > 0") for k, s in ((1, "L"), (2, "U"))]
        for t in here:
            every = t if every is None else every.unionByName(t)
    levels, pieces = [], {"L": [], "U": []}
    if every is not None:
        node = durable(every.select("key", "depth").distinct(), "depths")
        state = _on_leaves(every, diagonal, False)
        for depth in range(deepest, -1, -1):
            side = F.call_function("shiftright", F.col("leaf"), _depth(F.col("leaf")) - depth - 1)
            own = state.join(node.where(F.col("depth") == depth), "key").select("system", F.col("key").alias("p"), "depth", (side % 2).cast("int").alias("half"), "leaf", "m", "x")
            own = durable(own, "level")
            levels.append(own)
            rest = state.join(node.where(F.col("depth") < depth).select("key"), "key")
            state = _without(rest, own) if depth else state
        for s, other in (("L", "U"), ("U", "L")):
            for own, rows in zip(levels, reversed(nodes), strict=True):
                k = 1 if s == "L" else 2
                raw = rows.where("half = 1").select("p", "leaf", "n", F.col(f"m{k}").alias("k"), F.col(f"x{k}").alias("f")).where("k > 0")
                solved = own.where((F.col("system") == other) & (F.col("half") == 0)).select("p", "leaf", (F.size("x") / F.col("m")).cast("int").alias("n"), F.col("m").alias("k"), F.col("x").alias("f"))
                # L has E Fhat^T at (right, left), U has Ghat H^T at (left, right)
                right_rows = s == "L"
                name = {"rcid": 2 * F.col("p") + (1 if right_rows else 0), "ccid": 2 * F.col("p") + (0 if right_rows else 1)}
                for t, side in ((raw, "r" if right_rows else "c"), (solved, "c" if right_rows else "r")):
                    pieces[s].append(t.withColumns(name).select("rcid", "ccid", F.lit(side).alias("side"), "leaf", "n", "k", "f"))
    made = {}
    for s, column in (("L", "lo"), ("U", "up")):
        far = _mapped(h.leaves.where(F.lit(False)), lambda r: [], PIECE)
        for t in pieces[s]:
            far = far.unionByName(t)
        near = diagonal.select(F.col("leaf").alias("rleaf"), F.col("leaf").alias("cleaf"), F.col("n").alias("nr"), F.col("n").alias("nc"), F.col(column).alias("d"))
        far = durable(far, "far")
        made[s] = HMatrix(h.leaves, far, near, _parts_of(far, near), h.tree)
    return HodlrLU(made["L"], made["U"], diagonal, tuple(levels))


def solve_triangle(lu: HodlrLU, segs: DataFrame, system: str, transposed: bool = False) -> DataFrame:
    """Segments of L^-1 X ('L') or U^-T X ('U'); transposed: of L^-T X or U^-1 X."""
    state = segs.select(F.lit(system).alias("system"), F.lit(0).cast("long").alias("key"), "leaf", "m", "x")
    if not transposed:
        state = _on_leaves(state, lu.diagonal, False)
        for level in lu.levels:
            state = _without(state, level)
    else:
        for level in reversed(lu.levels):
            state = _without(state, level, True)
        state = _on_leaves(state, lu.diagonal, True)
    return state.select("leaf", "m", "x")


def solve(lu: HodlrLU, b: DataFrame, transposed: bool = False) -> DataFrame:
    """vec(i, v) of A^-1 b or A^-T b by the two triangles."""
    first, second = ("U", "L") if transposed else ("L", "U")
    x = solve_triangle(lu, durable(segments(lu.lower, b), "rhs"), first)
    return vector(lu.lower, solve_triangle(lu, x, second, True))


def log_determinant(lu: HodlrLU) -> DataFrame:
    """One row: the sign of the determinant and the logarithm of its size, from the leaves of U."""
    parts = _mapped(lu.diagonal, lambda r: [(float(np.prod(np.sign(np.diag(_array(r.up, r.n, r.n))))), float(np.log(np.abs(np.diag(_array(r.up, r.n, r.n)))).sum()))], "sign double, log double")
    return parts.agg(F.product("sign").alias("sign"), F.sum("log").alias("log"))
