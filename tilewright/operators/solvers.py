"""Factorisations, solves, norms and eigenvalues of block matrices.

Loops run on the driver over block steps; each step's table is written to the shared folder, so lineage stays short and a
lost executor costs one step. The driver sees counts, norms and block names only: pivots meet the blocks they change by joins.
Loops that end without their tolerance warn.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.dense import TIGHT, Acc
from tilewright.operators import blocks as B
from tilewright.operators.arrays import framed, mapped_sum, summed
from tilewright.operators.blocks import Block
from tilewright.sources.storage import durable, forget, held, shared_path, whole


#: A task makes a block in pieces of at most so many rows and columns, which stay in a core's cache.
PIECE = 256
#: A task of a product takes one tile of rows and about so many tiles of columns, however many there are.
ACROSS = 16
#: A step of a solve takes up to so many tiles, as long as there are so many steps: each step writes its tables anew, and the local file system starts a process for each file.
SPAN, LEAST_STEPS = 4, 6


@dataclass(frozen=True)
class KernelBlocks:
    """Dense blocks of entry(ids_i, ids_j, x_i, x_j) over points with ids 0..n-1, in tiles(b, ids, xs) of ids: a task makes a block where it uses it,
    so that no table holds n^2 numbers. Products and solves make it piece by piece, so tiles may be large. part cuts a block or piece, by how its
    bi and bj compare, or drops it (None); those above (below) the diagonal are not made where half is lower (upper)."""

    tiles: DataFrame
    tile: int
    entry: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    steps: int
    part: Callable[[Block], Block | None] = lambda b: b
    half: str = ""

    def pairs(self, right: DataFrame) -> DataFrame:
        """(bi, i, x, bj, j, y, ...): tiles of rows beside tiles of columns and what right has for these by bj; a task has one tile of rows, so its input is bounded."""
        r, c = self.tiles.select(F.col("b").alias("bi"), F.col("ids").alias("i"), F.col("xs").alias("x")), self.tiles.select(F.col("b").alias("bj"), F.col("ids").alias("j"), F.col("xs").alias("y"))
        r, c = r.repartitionByRange(self.steps, "bi"), c.join(right, "bj").repartitionByRange(-(-self.steps // ACROSS), "bj")
        met = {"lower": F.col("bi") >= F.col("bj"), "upper": F.col("bi") <= F.col("bj")}.get(self.half, F.lit(True))
        return r.hint("shuffle_replicate_nl").join(c, met)

    def of(self) -> Callable:
        """The block of a row of pairs; holds no table, so that tasks can have it."""
        tile, entry, part = self.tile, self.entry, self.part

        def block(row) -> Block | None:
            i, j = np.asarray(row.i), np.asarray(row.j)
            d = entry(i, j, np.asarray(row.x, float).reshape(len(i), -1), np.asarray(row.y, float).reshape(len(j), -1))
            return part(Block(row.bi, row.bj, row.bi * tile, row.bj * tile, *d.shape, d=d))

        return block

    def pieces(self) -> Callable:
        """For two tiles, a function of two offsets in them: the piece there, or None. Holds no table."""
        tile, entry, part, half, size = self.tile, self.entry, self.part, self.half, PIECE
        each = -(-tile // size)

        def of(bi, i, x, bj, j, y) -> Callable[[int, int], np.ndarray | None]:
            i, j = np.asarray(i), np.asarray(j)
            x, y = np.asarray(x, float).reshape(len(i), -1), np.asarray(y, float).reshape(len(j), -1)

            def piece(p: int, q: int) -> np.ndarray | None:
                at, over = bi * each + p // size, bj * each + q // size
                if (half == "lower" and at < over) or (half == "upper" and at > over):
                    return None
                d = entry(i[p : p + size], j[q : q + size], x[p : p + size], y[q : q + size])
                b = part(Block(at, over, bi * tile + p, bj * tile + q, *d.shape, d=d))
                return None if b is None else b.dense()

            return piece

        return of

    def cut(self, part: Callable[[Block], Block | None], half: str = "") -> KernelBlocks:
        return replace(self, part=lambda b, first=self.part: None if (now := first(b)) is None else part(now), half=half or self.half)

    def transposed(self) -> KernelBlocks:
        swap = lambda b: Block(b.bj, b.bi, b.c0, b.r0, b.nc, b.nr, d=b.d.T)
        half = {"lower": "upper", "upper": "lower"}.get(self.half, "")
        return replace(self, entry=lambda i, j, x, y, f=self.entry: f(j, i, y, x).T, part=lambda b, f=self.part: None if (now := f(swap(b))) is None else swap(now), half=half)

    def stored(self) -> DataFrame:
        """All blocks as a block table."""
        r, c = self.tiles.select(F.col("b").alias("bi"), F.col("ids").alias("i"), F.col("xs").alias("x")), self.tiles.select(F.col("b").alias("bj"), F.col("ids").alias("j"), F.col("xs").alias("y"))
        return _made(self, _dealt(r.join(c, how="cross")))  # by their bytes alone these small rows would meet in one or two tasks

    def diagonal(self) -> DataFrame:
        return _made(self, self.tiles.select(F.col("b").alias("bi"), F.col("ids").alias("i"), F.col("xs").alias("x"), F.col("b").alias("bj"), F.col("ids").alias("j"), F.col("xs").alias("y")))

    def matvec(self, x: DataFrame) -> DataFrame:
        """Segments of the matrix times x, summed by entry."""
        met, pieces, size = self.pairs(x.select(F.col("b").alias("bj"), F.col("x").alias("z"))), self.pieces(), PIECE
        return mapped_sum(met, lambda r: [(r.bi, _times(pieces(r.bi, r.i, r.x, r.bj, r.j, r.y), len(r.i), np.asarray(r.z, float)[:, None], size)[:, 0])], "b int, x array<double>")

    def matmul(self, b: DataFrame) -> DataFrame:
        """Blocks of the matrix times a table of blocks."""
        met, pieces, tile, size = self.pairs(b.select(F.col("bi").alias("bj"), *[F.col(c).alias(f"o_{c}") for c in B.FIELDS])), self.pieces(), self.tile, PIECE

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for t in batches:
                other = t[[f"o_{c}" for c in B.FIELDS]].set_axis(B.FIELDS, axis=1)
                for r, o in zip(t.itertuples(), other.itertuples(), strict=True):
                    y = Block.of(o)
                    z = _times(pieces(r.bi, r.i, r.x, r.bj, r.j, r.y), len(r.i), y.d if y.d is not None else y.u, size)
                    yield B.frame([Block(r.bi, y.bj, r.bi * tile, y.c0, len(r.i), y.nc, *((z,) if y.d is not None else (None, z, y.v)))])

        return B.summed_blocks(met.mapInPandas(run, B.SCHEMA))


def _times(piece: Callable, rows: int, z: np.ndarray, size: int, cast: Callable = lambda m: m) -> np.ndarray:
    out = np.zeros((rows, z.shape[1]))
    for p in range(0, rows, size):
        for q in range(0, len(z), size):
            if (d := piece(p, q)) is not None:
                out[p : p + size] += cast(d) @ cast(z[q : q + size])
    return out


def _solved(piece: Callable, z: np.ndarray, forward: bool, unit: bool, size: int, cast: Callable) -> np.ndarray:
    """T^-1 z for the triangle T of a diagonal block, piece after piece."""
    z = z.copy()
    order = range(0, len(z), size) if forward else range(0, len(z), size)[::-1]
    for k, q in enumerate(order):
        z[q : q + size] = np.linalg.solve(cast(_triangle(piece(q, q), forward, unit)), cast(z[q : q + size]))
        for p in order[k + 1 :]:
            if (d := piece(p, q)) is not None:
                z[p : p + size] -= cast(d) @ cast(z[q : q + size])
    return z


def _made(made: KernelBlocks, pairs: DataFrame) -> DataFrame:
    block = made.of()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield from B.frames(b for r in f.itertuples() if (b := block(r)) is not None)

    return pairs.mapInPandas(run, B.SCHEMA)


def _swept(made: KernelBlocks, rhs: DataFrame, forward: bool, unit: bool, cast: Callable = lambda m: m) -> DataFrame:
    """Blocks of T^-1 B for the triangle T of made blocks. Points travel beside the blocks of B, dealt over all cores by their tile, so a step is two passes
    without a shuffle: one task solves the step's tiles, block column after block column, and each block that is left meets these alone."""
    pieces, size, cores = made.pieces(), PIECE, made.tiles.sparkSession.sparkContext.defaultParallelism
    span = max(1, min(SPAN, made.steps // LEAST_STEPS))
    names = made.tiles.select(F.col("b").alias("bi"), "ids", "xs").join(rhs.select("bj", "c0", "nc").distinct(), how="cross")
    none = F.when(F.col("kind").isNull(), F.array().cast("array<double>"))  # an absent block is one of rank 0
    held = names.join(rhs.drop("c0", "nc", "r0", "nr"), ["bi", "bj"], "left").select(
        "bi", "bj", (F.col("bi").cast("long") * made.tile).alias("r0"), "c0", F.size("ids").alias("nr"), "nc", F.coalesce("kind", F.lit("R")).alias("kind"),
        F.when(F.col("kind").isNull(), 0).otherwise(F.col("k")).alias("k"), "d", F.coalesce("u", none).alias("u"), F.coalesce("v", none).alias("v"), "ids", "xs",
    )
    rest, done = durable(held.repartitionByRange(cores, F.pmod("bi", F.lit(cores))), "rhs"), []
    fields, schema = [*B.FIELDS, "ids", "xs"], B.SCHEMA + ", ids array<bigint>, xs array<double>"

    def product(r, y: Block, o) -> Block | None:
        """Less the made block of two rows times what is solved."""
        z = y.d if y.d is not None else y.u
        if not z.shape[1]:
            return None
        z = -_times(pieces(r.bi, r.ids, r.xs, o.bi, o.ids, o.xs), len(r.ids), z, size, cast)
        at = Block(r.bi, r.bj, r.r0, r.c0, r.nr, r.nc)
        return at.like(d=z) if y.d is not None else at.like(u=z, v=y.v)

    def total(parts: list[Block]) -> Block:
        return B._sum(parts, TIGHT) if len(parts) > 1 else parts[0]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = []  # the step's tiles of this block column that are solved
        for f in batches:
            for r in f.itertuples():
                before = before if before and before[0][1].bj == r.bj else []
                b = total([Block.of(r), *(z for y, o in before if (z := product(r, y, o)) is not None)])
                z = _solved(pieces(r.bi, r.ids, r.xs, r.bi, r.ids, r.xs), b.d if b.d is not None else b.u, forward, unit, size, cast)
                before.append((b.like(d=z) if b.d is not None else b.like(u=z, v=b.v), r))
                yield _with_points(before[-1:], fields)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, last = [], None  # of one block that is left, whose rows follow each other; the block itself is in one of them
        for f in batches:
            other = f[[f"o_{c}" for c in fields]].set_axis(fields, axis=1)
            for r, o in zip(f.itertuples(), other.itertuples(), strict=True):
                if last is not None and (last.bi, last.bj) != (r.bi, r.bj):
                    yield _with_points([(total(parts), last)], fields)
                    parts = []
                last = r
                parts += [Block.of(r)] if r.first else []
                parts += [z] if (z := product(r, Block.of(o), o)) is not None else []
        if last is not None:
            yield _with_points([(total(parts), last)], fields)

    starts = range(0, made.steps, span) if forward else range(made.steps, 0, -span)
    for k in starts:
        low, high = (k, min(k + span, made.steps)) if forward else (max(k - span, 0), k)
        step = rest.where((F.col("bi") >= low) & (F.col("bi") < high)).select(fields).coalesce(1)
        own = durable(step.sortWithinPartitions("bj", F.col("bi") if forward else F.col("bi").desc()).mapInPandas(solve, schema), "own")
        done.append(own)
        left = rest.where(F.col("bi") >= high if forward else F.col("bi") < low)
        if (high < made.steps) if forward else (low > 0):
            first = F.col("o_bi") == low
            met = left.join(F.broadcast(own.select(*[F.col(c).alias(f"o_{c}") for c in fields])), F.col("bj") == F.col("o_bj"))  # the step's block rows of B
            met = met.withColumns({c: F.when(first, F.col(c)) for c in ("d", "u", "v")} | {"first": first})
            old, rest = rest, durable(met.mapInPandas(apply, schema), "rhs")
            forget(old)
    forget(rest)
    out = done[0]
    for own in done[1:]:
        out = out.unionByName(own)
    solved = durable(out.where("kind = 'D' OR k > 0").select(B.FIELDS), "solved")
    for own in done:
        forget(own)
    return solved


def _with_points(blocks: list[tuple], fields: list[str]) -> pd.DataFrame:
    out = pd.DataFrame([(*b.row(), np.asarray(r.ids), np.asarray(r.xs)) for b, r in blocks], columns=fields)
    out["k"] = out["k"].astype("Int32")
    return out


def kernel_blocks(points: DataFrame, tile: int, entry: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> KernelBlocks:
    t = points.groupBy(F.floor(F.col("id") / tile).cast("int").alias("b")).agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("p"))
    t = t.select("b", F.transform("p", lambda s: s["id"]).alias("ids"), F.flatten(F.transform("p", lambda s: s["x"])).alias("xs"))
    t = durable(t.repartition(t.sparkSession.sparkContext.defaultParallelism), "tiles")  # a small table whose rows mean much work
    return KernelBlocks(t, tile, entry, int(t.agg(F.max("b")).first()[0]) + 1)


def kernel_system(points: DataFrame, tile: int, entry: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Dense blocks of entry(ids_i, ids_j, x_i, x_j) over points with ids 0..n-1, in tiles of ids."""
    return kernel_blocks(points, tile, entry).stored()


#: Triangles up to so many rows are solved as any matrix; larger ones by halves, at the work of a product instead of a factorisation.
HALVES = 64


def _forward(low: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L^-1 b for a lower triangle L."""
    if len(low) <= HALVES:
        return np.linalg.solve(low, b)
    h = len(low) // 2
    x = _forward(low[:h, :h], b[:h])
    return np.concatenate([x, _forward(low[h:, h:], b[h:] - low[h:, :h] @ x)])


def _backward(up: np.ndarray, b: np.ndarray) -> np.ndarray:
    """U^-1 b for an upper triangle U."""
    if len(up) <= HALVES:
        return np.linalg.solve(up, b)
    h = len(up) // 2
    x = _backward(up[h:, h:], b[h:])
    return np.concatenate([_backward(up[:h, :h], b[:h] - up[:h, h:] @ x), x])


def _lu(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unpivoted LU of one tile; L has a unit diagonal."""
    a = a.astype(a.dtype if a.dtype == np.float32 else float)
    n = len(a)
    if n > 32:  # halves: two triangular solves and one product, the rest by the same rule
        h = n // 2
        l1, u1 = _lu(a[:h, :h])
        if not np.diag(u1).all():
            raise ZeroDivisionError("zero pivot")
        right, below = _forward(l1, a[:h, h:]), _forward(u1.T, a[h:, :h].T).T
        l2, u2 = _lu(a[h:, h:] - below @ right)
        zero = np.zeros((h, n - h), dtype=a.dtype)
        return np.block([[l1, zero], [below, l2]]), np.block([[u1, right], [zero.T, u2]])
    low = np.eye(n, dtype=a.dtype)
    for k in range(n - 1):
        if a[k, k] == 0:
            raise ZeroDivisionError("zero pivot")
        low[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
        a[k + 1 :, k:] -= np.outer(low[k + 1 :, k], a[k, k:])
    return low, np.triu(a)


def _steps(blocks: DataFrame) -> int:
    return int(blocks.agg(F.max("bi")).first()[0]) + 1


def _minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(B.each(b, lambda x: [x.like(d=None if x.d is None else -x.d, u=None if x.u is None else -x.u, v=x.v)]))


def _beside(blocks: DataFrame, pivot: DataFrame, f: Callable[[Block, Block], list[Block]]) -> DataFrame:
    """f of each block and the one pivot tile, which goes to every task."""
    right = pivot.select(*[F.col(c).alias(f"o_{c}") for c in B.FIELDS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            mine, other = t[B.FIELDS], t[[f"o_{c}" for c in B.FIELDS]].set_axis(B.FIELDS, axis=1)
            yield from B.frames(z for x, y in zip(mine.itertuples(), other.itertuples(), strict=True) for z in f(Block.of(x), Block.of(y)))

    return blocks.select(B.FIELDS).join(F.broadcast(right), how="cross").mapInPandas(run, B.SCHEMA)  # one tile, at most TILE x TILE


def _rounded(single: bool) -> Callable[[np.ndarray], np.ndarray]:
    return (lambda x: x.astype(np.float32)) if single else (lambda x: x)


def lu_blocks(a: DataFrame, acc: Acc = TIGHT, single: bool = False) -> DataFrame:
    """Right-looking block LU of dense or low-rank blocks: strictly lower blocks hold L, others U; diagonal tiles hold both parts.

    Step k: the diagonal tile is factorised in a task, its panels are solved in a map, and each trailing block meets its two panel
    blocks in one group. The part that is done leaves the loop. single: all arithmetic in single precision.
    """
    (rest, ours), cast, under = held(a, "lu"), _rounded(single), shared_path(a.sparkSession, "factors")

    def pivot(b: Block) -> list[Block]:
        low, up = _lu(cast(b.dense()))
        return [b.like(d=(low - np.eye(len(low)) + up).astype(float))]

    def panel(b: Block, p: Block, k: int) -> list[Block]:
        if b.bj == k:  # X U = B
            up = cast(np.triu(p.d)).T
            return [b.like(d=_forward(up, cast(b.d).T).T.astype(float)) if b.d is not None else b.like(u=b.u, v=_forward(up, cast(b.v)).astype(float))]
        low = cast(np.tril(p.d, -1) + np.eye(p.nr))
        return [b.like(d=_forward(low, cast(b.d)).astype(float)) if b.d is not None else b.like(u=_forward(low, cast(b.u)).astype(float), v=b.v)]

    steps = _steps(rest)
    for k in range(steps):
        own = durable(B.each(rest.where((F.col("bi") == k) & (F.col("bj") == k)), pivot), "pivot", under)
        sides = rest.where(((F.col("bi") == k) | (F.col("bj") == k)) & (F.col("bi") != F.col("bj")))
        ready = durable(_beside(_dealt(sides), own, lambda b, p, k=k: panel(b, p, k)), "panel", under)
        old, rest = rest, durable(_updated(rest.where((F.col("bi") > k) & (F.col("bj") > k)), ready.where(F.col("bi") > k), ready.where(F.col("bj") > k), k, acc, cast), "lu")
        if ours:
            forget(old)
        ours = True
    return whole(a.select(B.FIELDS), under)


def _dealt(blocks: DataFrame, *names: str) -> DataFrame:
    """A few large blocks, over all cores: files and hashes alone would put many of them into one task."""
    return blocks.repartition(4 * blocks.sparkSession.sparkContext.defaultParallelism, *(names or ("bi", "bj")))


def _updated(rest: DataFrame, left: DataFrame, right: DataFrame, k: int, acc: Acc, cast: Callable = lambda m: m) -> DataFrame:
    """Blocks ij of rest less left_ik right_kj. A block and the two that change it meet in one group by its name; in a join by k all pairs would be one task's."""
    at = lambda t, i, j: t.select(B.FIELDS + [F.col(i).alias("ti"), F.col(j).alias("tj")])
    rows, cols = (F.broadcast(t.select(F.col(c).alias("to")).distinct()) for t, c in ((left, "bi"), (right, "bj")))  # names of one block column and row
    parts = at(rest, "bi", "bj").unionByName(at(left.join(cols, how="cross"), "bi", "to")).unionByName(at(right.join(rows, how="cross"), "to", "bj"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bs = [Block.of(r) for r in pdf[B.FIELDS].itertuples()]
        x, y = [b for b in bs if b.bj == k], [b for b in bs if b.bi == k]
        own = [b for b in bs if b.bi != k and b.bj != k]
        for p in (_product(a, b, cast) for a in x for b in y):
            own.append(p.like(d=None if p.d is None else -p.d, u=None if p.u is None else -p.u, v=p.v))
        return B.frame([_summed(own, acc, cast)] if own else [])

    return _dealt(parts, "ti", "tj").groupBy("ti", "tj").applyInPandas(run, B.SCHEMA)


def _summed(bs: list[Block], acc: Acc, cast: Callable) -> Block:
    out = B._sum(bs, acc)
    return out.like(d=None if out.d is None else cast(out.d).astype(float), u=None if out.u is None else cast(out.u).astype(float), v=None if out.v is None else cast(out.v).astype(float))


def _product(x: Block, y: Block, cast: Callable = lambda m: m) -> Block:
    at = Block(x.bi, y.bj, x.r0, y.c0, x.nr, y.nc)
    if x.d is not None and y.d is not None:
        return at.like(d=(cast(x.d) @ cast(y.d)).astype(float))
    if x.d is None:
        return at.like(u=x.u, v=(cast(y.dense()).T @ cast(x.v)).astype(float))
    return at.like(u=(cast(x.d) @ cast(y.u)).astype(float), v=y.v)


def ldu_blocks(a: DataFrame, acc: Acc = TIGHT) -> tuple[DataFrame, DataFrame]:
    """(factors, diagonal): L and U with unit block diagonals, D as the diagonal tiles."""
    f = lu_blocks(a, acc)
    diag = B.each(f.where("bi = bj"), lambda b: [b.like(d=(np.tril(b.d, -1) + np.eye(b.nr)) @ np.triu(b.d))])

    def scaled(x: Block, y: Block) -> Block:
        low, up = np.tril(y.d, -1) + np.eye(y.nr), np.triu(y.d)
        if x.bi > x.bj:  # L_ik: times the inverse of the tile's own L part
            return x.like(d=_backward(low.T, x.d.T).T) if x.d is not None else x.like(u=x.u, v=_backward(low.T, x.v))
        return x.like(d=_backward(up, x.d)) if x.d is not None else x.like(u=_backward(up, x.u), v=x.v)

    tiles = f.where("bi = bj")
    lower = B._paired(f.where("bi > bj"), tiles, ["bj"], ["bi"], scaled)
    upper = B._paired(f.where("bi < bj"), tiles, ["bi"], ["bi"], scaled)
    return durable(lower.unionByName(upper), "ldu"), durable(diag, "diag")


def _triangle(d: np.ndarray, lower: bool, unit: bool) -> np.ndarray:
    if lower:
        return np.tril(d, -1) + np.eye(len(d)) if unit else np.tril(d)
    return np.triu(d, 1) + np.eye(len(d)) if unit else np.triu(d)


def substitute(factors: DataFrame | KernelBlocks, rhs: DataFrame, lower: bool, transposed: bool = False, unit: bool | None = None, single: bool = False) -> DataFrame:
    """Segments of T^-1 b for a triangle T of factors (or its transpose), block after block; one table a step.

    unit: the triangle's diagonal is one (so for L by default). single: solves in single precision.
    """
    unit, forward, cast = lower if unit is None else unit, lower != transposed, _rounded(single)
    if isinstance(factors, KernelBlocks):
        made = factors.transposed() if transposed else factors
        none = F.lit(None).cast("array<double>")
        column = rhs.select(
            F.col("b").alias("bi"), F.lit(0).alias("bj"), (F.col("b").cast("long") * made.tile).alias("r0"), F.lit(0).cast("long").alias("c0"), F.size("x").alias("nr"), F.lit(1).alias("nc"),
            F.lit("D").alias("kind"), F.lit(None).cast("int").alias("k"), F.col("x").alias("d"), none.alias("u"), none.alias("v"),
        )
        return _swept(made, column, forward, unit, cast).select(F.col("bi").alias("b"), F.col("d").alias("x"))
    n = _steps(factors)
    side, other = ("bi", "bj") if transposed else ("bj", "bi")
    outside = F.col(other) > F.col(side) if forward else F.col(other) < F.col(side)
    rest = durable(rhs.select("b", "x", F.lit(False).alias("done")), "rhs")

    def strip(k: int, where: Column, x: DataFrame) -> DataFrame:
        """Blocks of one block column (row, if transposed) with the segment z that they meet."""
        blocks = factors.where((F.col(side) == k) & where).select(B.FIELDS)
        return blocks.join(F.broadcast(x.select(F.col("b").alias(side), F.col("x").alias("z"))), side)  # one segment

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for r in f.itertuples():
                d = Block.of(r).dense()
                t = _triangle(d.T if transposed else d, forward, unit)
                yield pd.DataFrame({"b": [getattr(r, side)], "x": [np.linalg.solve(cast(t), cast(np.asarray(r.z, float))).astype(float)]})

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            met = ((getattr(r, other), cast(Block.of(r).dense()), cast(np.asarray(r.z, float))) for r in f.itertuples())
            yield from framed(((at, -((m.T if transposed else m) @ z).astype(float)) for at, m, z in met), ["b", "x"])

    for k in range(n) if forward else range(n - 1, -1, -1):
        own = durable(strip(k, F.col("bi") == F.col("bj"), rest.where(F.col("b") == k)).mapInPandas(solve, "b int, x array<double>"), "own")
        changed = B.sum_segments(rest.where((F.col("b") != k) & ~F.col("done")).select("b", "x").unionByName(strip(k, outside, own).mapInPandas(apply, "b int, x array<double>")))
        old, rest = rest, durable(rest.where("done").unionByName(own.withColumn("done", F.lit(True))).unionByName(changed.withColumn("done", F.lit(False))), "rhs")
        forget(old)
        forget(own)
    return rest.select("b", "x")


def substitute_blocks(factors: DataFrame | KernelBlocks, rhs: DataFrame, lower: bool, transposed: bool = False, unit: bool | None = None) -> DataFrame:
    """Blocks of T^-1 B (or T^-T B) for a triangle T of factors and any block table B."""
    unit, forward = lower if unit is None else unit, lower != transposed
    if isinstance(factors, KernelBlocks):
        return _swept(factors.transposed() if transposed else factors, rhs, forward, unit)
    tri = factors.where("bi >= bj" if lower else "bi <= bj")
    tri = B.each(tri, lambda b: [b.like(d=_triangle(b.dense(), lower, unit))] if b.bi == b.bj else [b])
    tri = durable(B.transpose(tri) if transposed else tri, "triangle")
    rest, done = durable(rhs, "rhs"), None

    def solved(b: Block, p: Block) -> Block:
        t = _triangle(p.dense(), forward, unit)
        return b.like(d=np.linalg.solve(t, b.d)) if b.d is not None else b.like(u=np.linalg.solve(t, b.u), v=b.v)

    order = range(_steps(factors))
    for k in order if forward else reversed(order):
        here = rest.where(F.col("bi") == k)
        own = durable(_beside(here, tri.where((F.col("bi") == k) & (F.col("bj") == k)), lambda b, p: [solved(b, p)]), "own")
        update = B._paired(tri.where((F.col("bj") == k) & (F.col("bi") != k)), own, ["bj"], ["bi"], _product)
        done = own if done is None else done.unionByName(own)
        old, rest = rest, durable(B.grouped(_minus(rest.where(F.col("bi") != k), update), ["bi", "bj"], lambda bs: [B._sum(bs, TIGHT)]), "rhs")
        forget(old)
    return durable(done, "solved")


def substitute_right(factors: DataFrame, rhs: DataFrame, lower: bool, transposed: bool = False, unit: bool | None = None) -> DataFrame:
    """Blocks of B T^-1 (or B T^-T): the solve from the left of the transposed system."""
    unit = lower if unit is None else unit
    return B.transpose(substitute_blocks(factors, B.transpose(rhs), lower, not transposed, unit))


def lu_solve(factors: DataFrame, rhs: DataFrame, transposed: bool = False, single: bool = False) -> DataFrame:
    if transposed:
        return substitute(factors, substitute(factors, rhs, lower=False, transposed=True, single=single), lower=True, transposed=True, single=single)
    return substitute(factors, substitute(factors, rhs, lower=True, single=single), lower=False, single=single)


def ldu_solve(factors: DataFrame, diagonal: DataFrame, rhs: DataFrame, transposed: bool = False) -> DataFrame:
    """Segments of (L D U)^-1 b, or of its transpose, for unit block triangles and diagonal tiles of ldu_blocks()."""
    eye = B.each(diagonal, lambda b: [b.like(d=np.eye(b.nr))])
    both = durable(factors.unionByName(eye), "unit")
    inverse = B.each(diagonal, lambda b: [b.like(d=np.linalg.inv(b.d.T if transposed else b.d))])
    x = substitute(both, rhs, lower=not transposed, transposed=transposed, unit=True)
    return substitute(both, durable(B.matvec(inverse, x), "scaled"), lower=transposed, transposed=transposed, unit=True)


def invert(a: DataFrame) -> DataFrame:
    """Inverse by block Gauss-Jordan elimination."""
    now, ours = held(a, "invert")
    for k in range(_steps(now)):
        at = (F.col("bi") == k) & (F.col("bj") == k)
        own = durable(B.each(now.where(at), lambda b: [b.like(d=np.linalg.inv(b.dense()))]), "pivot")
        row = durable(_beside(_dealt(now.where((F.col("bi") == k) & (F.col("bj") != k))), own, lambda b, p: [b.like(d=p.d @ b.dense())]), "row")
        col = now.where((F.col("bj") == k) & (F.col("bi") != k))
        inner = _updated(now.where((F.col("bi") != k) & (F.col("bj") != k)), col, row, k, TIGHT)
        left = _beside(_dealt(col), own, lambda b, p: [b.like(d=-b.dense() @ p.d)])
        old, now = now, durable(inner.unionByName(row).unionByName(own).unionByName(left), "invert")
        if ours:
            forget(old)
        ours = True
    return now


def _unconverged(what: str, value: float, steps: int) -> None:
    warnings.warn(f"{what} has not met its tolerance after {steps} steps (at {value:.1e})", RuntimeWarning, stacklevel=3)


def dot(x: DataFrame, y: DataFrame) -> float:
    both = x.join(y.select("b", F.col("x").alias("y")), "b")
    return float(both.agg(F.sum(F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t))).first()[0] or 0.0)


def combine(alpha: float, x: DataFrame, beta: float, y: DataFrame) -> DataFrame:
    scaled = lambda t, c: t.select("b", F.transform("x", lambda v: v * F.lit(c)).alias("x"))
    return B.sum_segments(scaled(x, alpha).unionByName(scaled(y, beta)))


def spectral_norm(op: Callable[[DataFrame], DataFrame], adjoint: Callable[[DataFrame], DataFrame], start: DataFrame, tol: float = 1e-3, maxit: int = 50) -> float:
    """Largest singular value of any operator on segments, by power iteration on its normal operator; stops on relative change."""
    x, before, change = start, 0.0, 0.0
    for _ in range(maxit):
        size = dot(x, x) ** 0.5
        if size == 0:
            return 0.0
        x = durable(combine(1 / size, x, 0.0, x), "power")
        y = durable(op(x), "power")
        now = dot(y, y) ** 0.5
        if abs(now - before) <= tol * now:
            return now
        before, x, change = now, durable(adjoint(y), "power"), abs(now - before) / now if now else 0.0
    _unconverged("power iteration", change, maxit)
    return before


def refine(op: Callable[[DataFrame], DataFrame], solve: Callable[[DataFrame], DataFrame], rhs: DataFrame, tol: float = 1e-8, maxit: int = 100) -> tuple[DataFrame, list[float]]:
    """x <- x - W(A x - b) from x = 0; the solution's segments and the residual norm of each step."""
    x, sizes, target = None, [], dot(rhs, rhs) ** 0.5
    for _ in range(maxit):
        r = durable(combine(1.0, op(x), -1.0, rhs) if x is not None else combine(-1.0, rhs, 0.0, rhs), "residual")
        sizes.append(dot(r, r) ** 0.5)
        if sizes[-1] <= tol * target:
            break
        c = solve(r)
        x = durable(combine(-1.0, c, 0.0, c) if x is None else combine(1.0, x, -1.0, c), "refine")
    else:
        _unconverged("refinement", sizes[-1] / target if target else 0.0, maxit)
    return x, sizes


def eigen_batched(blocks: DataFrame) -> DataFrame:
    """(bi, bj, trace, squares, residual) of the Gram matrix of each block, from its eigenvalues."""

    def run(b: Block) -> tuple:
        m = b.dense().T @ b.dense()
        e, v = np.linalg.eigh(m)
        scale = np.abs(m).sum(axis=0).max() * np.abs(v).sum(axis=0).max() or 1.0
        return b.bi, b.bj, float(e.sum()), float((e**2).sum()), float(np.linalg.norm(m @ v - v * e) / scale)

    return B.measured(blocks, run, "bi int, bj int, trace double, squares double, residual double")


def svd_batched(blocks: DataFrame) -> DataFrame:
    """(bi, bj, k, squares, residual) of each block: its rank, the sum of squared singular values, and |M V - U S| over |M|."""

    def run(b: Block) -> tuple:
        m = b.dense()
        u, s, vt = np.linalg.svd(m, full_matrices=False)
        return b.bi, b.bj, int((s > 1e-12 * s[0]).sum()) if len(s) and s[0] > 0 else 0, float((s**2).sum()), float(np.linalg.norm(m @ vt.T - u * s) / (np.linalg.norm(m) or 1.0))

    return B.measured(blocks, run, "bi int, bj int, k int, squares double, residual double")


def eigen_ipt(diagonal: DataFrame, rest: DataFrame, eye: DataFrame, tol: float = 1e-12, maxit: int = 30) -> DataFrame:
    """(b, x): eigenvalues of diag + rest by the fixed point V <- I + G o (V diag(W) - W), W = rest V, G_ij = 1 / (d_i - d_j).

    Stops on tol, on a value that is not finite, or when the change grows tenfold.
    """
    return _ipt(diagonal, rest, eye, tol, maxit)[0]


def eigen_ipt_vectors(diagonal: DataFrame, rest: DataFrame, eye: DataFrame, tol: float = 1e-12, maxit: int = 30) -> tuple[DataFrame, DataFrame]:
    """(eigenvalues (b, x), eigenvector blocks with columns of length one) by the same iteration."""
    values, v = _ipt(diagonal, rest, eye, tol, maxit)
    return values, unit_columns(v)


def unit_columns(blocks: DataFrame) -> DataFrame:
    """Blocks with each column of the whole matrix scaled to length one."""
    squares = B.measured(blocks, lambda b: (b.bj, (b.dense() ** 2).sum(axis=0)), "b int, x array<double>")
    lengths = durable(summed(squares, ["b"]), "lengths")
    return durable(B.scale_columns(blocks, lengths.select("b", F.transform("x", lambda q: F.when(q > 0, 1 / F.sqrt(q)).otherwise(0.0)).alias("x"))), "unit")


def eigen_swept(m: DataFrame, dominance: float = 1e-3, tol: float = 1e-12, sweeps: int = 6) -> tuple[DataFrame, DataFrame]:
    """(eigenvalues, eigenvector blocks) of a symmetric block matrix: Jacobi rounds until what is off the diagonal blocks is below dominance, one
    rotation within each diagonal block, then the fixed point."""
    a, q = _jacobi(m, dominance, sweeps, True)
    own = durable(B.each(a.where("bi = bj"), lambda b: [b.like(d=np.linalg.eigh((b.dense() + b.dense().T) / 2)[1])]), "own")
    a, q = durable(B.matmul(durable(B.matmul(B.transpose(own), a), "half"), own), "swept"), durable(B.matmul(q, own), "rotation")
    rest = durable(B.each(a, lambda b: [b.like(d=b.dense() - np.diag(np.diag(b.dense())))] if b.bi == b.bj else [b]), "rest")
    eye = B.each(a.where("bi = bj"), lambda b: [b.like(d=np.eye(b.nr))])
    values, v = _ipt(_diagonal(a), rest, eye, tol, 30)
    return values, unit_columns(durable(B.matmul(q, v), "vectors"))


def _ipt(diagonal: DataFrame, rest: DataFrame, eye: DataFrame, tol: float, maxit: int) -> tuple[DataFrame, DataFrame]:
    v, before = durable(eye, "ipt"), None
    d = durable(diagonal, "diag")
    size = int(d.agg(F.sum(F.size("x"))).first()[0] or 0)
    while True:
        w = durable(B.matmul(rest, v, size=size), "ipt")
        wd = durable(_diagonal(w), "wd")
        maxit -= 1
        met = _with_segments(_with_segments(_with_segments(w.withColumn("tag", F.lit("w")).unionByName(v.withColumn("tag", F.lit("v"))), d, "bi", "di"), d, "bj", "dj"), wd, "bj", "wj")

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            got = {r.tag: Block.of(r) for r in pdf[[*B.FIELDS, "tag"]].itertuples()}
            first, ref = pdf.iloc[0], next(iter(got.values()))
            a = got["w"].dense() if "w" in got else np.zeros((ref.nr, ref.nc))
            x = got["v"].dense() if "v" in got else np.zeros((ref.nr, ref.nc))
            gap = np.asarray(first["di"], float)[:, None] - np.asarray(first["dj"], float)[None, :]
            same = gap == 0
            new = np.where(same, 0.0, (x * np.asarray(first["wj"], float)[None, :] - a) / np.where(same, 1.0, gap))
            if ref.bi == ref.bj:
                new[np.arange(ref.nr), np.arange(ref.nr)] = 1.0
            return B.frame([ref.like(d=new)]).assign(sq=float(np.linalg.norm(new - x) ** 2))

        new = durable(_dealt(met).groupBy("bi", "bj").applyInPandas(step, B.SCHEMA + ", sq double"), "ipt")
        change = new.agg(F.sqrt(F.sum("sq"))).first()[0]
        forget(w)
        forget(v)
        v = new.drop("sq")
        if not np.isfinite(change) or change <= tol or maxit <= 0 or (before is not None and change > 10 * before):
            if not change <= tol:
                _unconverged("eigenvalue iteration", change, maxit)
            break
        before = change
    return combine(1.0, d, 1.0, _diagonal(durable(B.matmul(rest, v, size=size), "ipt"))), v


def _diagonal(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            yield pd.DataFrame([(r.bi, np.diag(Block.of(r).dense())) for r in f[B.FIELDS].itertuples()], columns=["b", "x"])

    return blocks.where("bi = bj").select(B.FIELDS).mapInPandas(run, "b int, x array<double>")


def _with_segments(blocks: DataFrame, segs: DataFrame, key: str, name: str) -> DataFrame:
    return blocks.join(F.broadcast(segs.select(F.col("b").alias(key), F.col("x").alias(name))), key)  # one vector, beside a table of n^2 numbers


def eigen_jacobi(m: DataFrame, tol: float = 1e-9, sweeps: int = 6) -> DataFrame:
    """(b, x): eigenvalues of a symmetric block matrix by block Jacobi: each round solves disjoint pairs of block indices, the
    pairs with the largest off-diagonal blocks first, and applies the rotations from both sides."""
    return _diagonal(_jacobi(m, tol, sweeps, False)[0])


def eigen_jacobi_vectors(m: DataFrame, tol: float = 1e-9, sweeps: int = 6) -> tuple[DataFrame, DataFrame]:
    """(eigenvalues (b, x), orthonormal eigenvector blocks): the rotations of all rounds, multiplied."""
    a, v = _jacobi(m, tol, sweeps, True)
    return _diagonal(a), v


def _jacobi(m: DataFrame, tol: float, sweeps: int, vectors: bool) -> tuple[DataFrame, DataFrame | None]:
    a = durable(m, "jacobi")
    turned = durable(B.each(a.where("bi = bj"), lambda b: [b.like(d=np.eye(b.nr))]), "vectors") if vectors else None
    whole = B.norm_frobenius(a).first()[0]
    n = _steps(a)
    left, steps = 0.0, sweeps * max(1, n - 1)
    for step in range(steps + 1):
        sizes = durable(B.measured(a.where("bi < bj"), lambda b: (b.bi, b.bj, B.norm(b)), "bi int, bj int, s double"), "sizes")
        left = (2 * (sizes.agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0)) ** 0.5
        if left <= tol * whole:
            break
        if step == steps:
            _unconverged("Jacobi sweeps", left / whole, steps)
            break
        used, pairs = set(), []
        for r in sizes.orderBy(F.desc("s"), "bi", "bj").limit(4 * n).collect():  # a bounded look at the largest; the others wait
            if not {r["bi"], r["bj"]} & used and r["s"] > 0:
                used |= {r["bi"], r["bj"]}
                pairs.append((r["bi"], r["bj"], len(pairs)))
        names = F.broadcast(a.sparkSession.createDataFrame([(b, g) for p, q, g in pairs for b in (p, q)], "b int, g int"))  # n rows at most
        a = a.join(names.select(F.col("b").alias("bi"), F.col("g").alias("_gi")), "bi", "left").join(names.select(F.col("b").alias("bj"), F.col("g").alias("_gj")), "bj", "left")
        own = a.withColumn("g", F.col("_gi")).where(F.col("g") == F.col("_gj"))

        def rotate(pdf: pd.DataFrame) -> pd.DataFrame:
            bs = {(b.bi, b.bj): b for b in (Block.of(r) for r in pdf[B.FIELDS].itertuples())}
            p, q = min(k[0] for k in bs), max(k[0] for k in bs)
            np_, nq = bs[p, p].nr, bs[q, q].nr
            get = lambda i, j, s: bs[i, j].dense() if (i, j) in bs else np.zeros(s)
            s = np.block([[get(p, p, (np_, np_)), get(p, q, (np_, nq))], [get(q, p, (nq, np_)), get(q, q, (nq, nq))]])
            v = np.linalg.eigh((s + s.T) / 2)[1]
            at, offset = {p: slice(0, np_), q: slice(np_, np_ + nq)}, {p: bs[p, p].r0, q: bs[q, q].r0}
            return B.frame([Block(i, j, offset[i], offset[j], at[i].stop - at[i].start, at[j].stop - at[j].start, d=v[at[i], at[j]]) for i in (p, q) for j in (p, q)])

        turn = own.groupBy("g").applyInPandas(rotate, B.SCHEMA)
        idle = B.each(a.where((F.col("bi") == F.col("bj")) & F.col("_gi").isNull()), lambda b: [b.like(d=np.eye(b.nr))])
        q = durable(turn.unionByName(idle), "rotation")
        a = durable(B.matmul(durable(B.matmul(B.transpose(q), a), "half"), q), "jacobi")
        turned = durable(B.matmul(turned, q), "vectors") if vectors else None
    return a, turned
