"""Block tables: a row for each block with row-major arrays, NumPy inside tasks.

blocks(bi, bj, r0, c0, nr, nc, kind, k, d, u, v): kind D has d (nr x nc), kind R has u (nr x k) and v (nc x k), the block
being u v^T. Zero blocks are absent rows. Blocks are at most TILE on a side, so a row stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions import codecs
from tilewright.functions.dense import APPROX, TIGHT, Acc, column_basis, lowrank_singular_values, sum_lowrank, sum_lowrank_pairwise, svd_lowrank, truncate
from tilewright.operators import tall
from tilewright.operators.arrays import NUMBERS, framed, summed
from tilewright.sources.storage import durable

TILE = 4096
SCHEMA = "bi int, bj int, r0 long, c0 long, nr int, nc int, kind string, k int, d array<double>, u array<double>, v array<double>"
FIELDS = ["bi", "bj", "r0", "c0", "nr", "nc", "kind", "k", "d", "u", "v"]


class Block:
    """One block within a task."""

    __slots__ = ("bi", "bj", "r0", "c0", "nr", "nc", "d", "u", "v")

    def __init__(self, bi, bj, r0, c0, nr, nc, d=None, u=None, v=None):
        self.bi, self.bj, self.r0, self.c0, self.nr, self.nc, self.d, self.u, self.v = int(bi), int(bj), int(r0), int(c0), int(nr), int(nc), d, u, v

    @classmethod
    def of(cls, row) -> Block:
        if row.kind == "D":
            return cls(row.bi, row.bj, row.r0, row.c0, row.nr, row.nc, d=np.asarray(row.d, float).reshape(row.nr, row.nc))
        k = int(row.k)
        return cls(row.bi, row.bj, row.r0, row.c0, row.nr, row.nc, u=np.asarray(row.u, float).reshape(row.nr, k), v=np.asarray(row.v, float).reshape(row.nc, k))

    def dense(self) -> np.ndarray:
        return self.d if self.d is not None else self.u @ self.v.T

    def like(self, d=None, u=None, v=None) -> Block:
        return Block(self.bi, self.bj, self.r0, self.c0, self.nr, self.nc, d, u, v)

    def smaller(self, acc: Acc, approx: Callable = svd_lowrank) -> Block:
        """Low-rank if that takes fewer numbers."""
        u, v = approx(self.dense(), acc)
        return self.like(u=u, v=v) if u.size + v.size < self.nr * self.nc else self.like(d=self.dense())

    def row(self) -> tuple:
        flat = lambda x: None if x is None else np.ascontiguousarray(x).ravel()
        return (self.bi, self.bj, self.r0, self.c0, self.nr, self.nc, "D" if self.d is not None else "R", None if self.d is not None else self.u.shape[1], flat(self.d), flat(self.u), flat(self.v))


def frame(blocks: list[Block]) -> pd.DataFrame:
    out = pd.DataFrame([b.row() for b in blocks], columns=FIELDS)
    out["k"] = out["k"].astype("Int32")
    return out


def frames(blocks: Iterable[Block]) -> Iterator[pd.DataFrame]:
    """Blocks as frames of bounded size, made as they come."""
    for out in framed((b.row() for b in blocks), FIELDS):
        out["k"] = out["k"].astype("Int32")
        yield out


def each(blocks: DataFrame, f: Callable[[Block], list[Block]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from frames(x for row in b[FIELDS].itertuples() for x in f(Block.of(row)))

    return blocks.select(FIELDS).mapInPandas(run, SCHEMA)


def measured(blocks: DataFrame, f: Callable[[Block], tuple], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from framed((f(Block.of(row)) for row in b[FIELDS].itertuples()), names)

    return blocks.select(FIELDS).mapInPandas(run, schema)


def grouped(blocks: DataFrame, keys: list[Column], f: Callable[[list[Block]], list[Block]]) -> DataFrame:
    """Blocks gathered by keys; a group's size is bounded by the tiling (sons of one parent, or one tile's partial products)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return frame(f([Block.of(row) for row in pdf.itertuples()]))

    return blocks.groupBy(*keys).applyInPandas(run, SCHEMA)


def to_blocks(a: DataFrame, rows: int, cols: int, tile_r: int, tile_c: int) -> DataFrame:
    """Dense blocks of coo; tiles without entries are absent, the last ones may be smaller."""
    tiled = a.select(F.floor(F.col("i") / tile_r).cast("int").alias("bi"), F.floor(F.col("j") / tile_c).cast("int").alias("bj"), F.pmod("i", F.lit(tile_r)).cast("int").alias("p"), F.pmod("j", F.lit(tile_c)).cast("int").alias("q"), "v")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0])
        d = np.zeros((min(tile_r, rows - bi * tile_r), min(tile_c, cols - bj * tile_c)))
        np.add.at(d, (pdf["p"].to_numpy(), pdf["q"].to_numpy()), pdf["v"].to_numpy())
        return frame([Block(bi, bj, bi * tile_r, bj * tile_c, *d.shape, d=d)])

    return tiled.groupBy("bi", "bj").applyInPandas(fill, SCHEMA)


def to_coo(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b[FIELDS].itertuples():
                x = Block.of(row)
                i, j = np.indices((x.nr, x.nc))
                yield pd.DataFrame({"i": x.r0 + i.ravel(), "j": x.c0 + j.ravel(), "v": x.dense().ravel()})

    return blocks.select(FIELDS).mapInPandas(run, "i long, j long, v double")


def lowrank(blocks: DataFrame, acc: Acc = TIGHT, approx: str | Callable = "svd") -> DataFrame:
    """Every block as U V^T by a named approximation or any function (array, Acc) -> (U, V)."""
    f = APPROX[approx] if isinstance(approx, str) else approx

    def run(b: Block) -> list[Block]:
        u, v = f(b.dense(), acc)
        return [b.like(u=u, v=v)] if u.shape[1] else []

    return each(blocks, run)


def retruncated(blocks: DataFrame, acc: Acc) -> DataFrame:
    def run(b: Block) -> list[Block]:
        if b.d is not None:
            return [b]
        u, v = truncate(b.u, b.v, acc)
        return [b.like(u=u, v=v)] if u.shape[1] else []

    return each(blocks, run)


def add_blocks(parts: list[DataFrame], acc: Acc = TIGHT, pairwise: bool = False) -> DataFrame:
    """Sum of block tables of one tiling, blocks meeting by (bi, bj)."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return grouped(whole, ["bi", "bj"], lambda bs: [_sum(bs, acc, pairwise)])


def _sum(bs: list[Block], acc: Acc, pairwise: bool = True) -> Block:
    if any(b.d is not None for b in bs):
        return bs[0].like(d=sum(b.dense() for b in bs))
    u, v = (sum_lowrank_pairwise if pairwise else sum_lowrank)([(b.u, b.v) for b in bs], acc)
    return bs[0].like(u=u, v=v)


def transpose(blocks: DataFrame) -> DataFrame:
    return each(blocks, lambda b: [Block(b.bj, b.bi, b.c0, b.r0, b.nc, b.nr, d=None if b.d is None else b.d.T, u=b.v, v=b.u)])


def hadamard(a: DataFrame, b: DataFrame, acc: Acc) -> DataFrame:
    """Entry-wise product; of two low-rank blocks by row-wise products of the factors, then truncated."""

    def product(x: Block, y: Block) -> Block:
        if x.d is not None or y.d is not None:
            return x.like(d=x.dense() * y.dense())
        u = (x.u[:, :, None] * y.u[:, None, :]).reshape(x.nr, -1)
        v = (x.v[:, :, None] * y.v[:, None, :]).reshape(x.nc, -1)
        return x.like(*(None, *truncate(u, v, acc)))

    return _paired(a, b, ["bi", "bj"], ["bi", "bj"], product)


def _paired(a: DataFrame, b: DataFrame, ka: list[str], kb: list[str], f: Callable[[Block, Block], Block | None]) -> DataFrame:
    """f of each pair of blocks whose keys agree; the join is Spark's, the products stay in its tasks."""
    right = b.select(*[F.col(c).alias(f"o_{c}") for c in FIELDS])
    on = [a[x] == right[f"o_{y}"] for x, y in zip(ka, kb, strict=True)]
    both = a.select(FIELDS).join(right, on)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            mine = t[FIELDS]
            other = t[[f"o_{c}" for c in FIELDS]].set_axis(FIELDS, axis=1)
            yield from frames(z for x, y in zip(mine.itertuples(), other.itertuples(), strict=True) if (z := f(Block.of(x), Block.of(y))) is not None)

    return both.mapInPandas(run, SCHEMA)


def matmul(a: DataFrame, b: DataFrame, acc: Acc = TIGHT, prune: float = 0.0, size: int = 0) -> DataFrame:
    """A B by blocks: pairs meet on the inner index, products keep low rank, sums truncate. prune drops products whose norms multiply to less.

    size: the rows of A and columns of B, if both are many. Then products are not shuffled: a task makes one square of A B, of TILE on a side at most, and
    goes through the blocks of its rows of A and columns of B by their inner index.
    """

    def product(x: Block, y: Block) -> Block | None:
        low = x.d is None or y.d is None
        if prune and low and norm(x) * norm(y) < prune:
            return None
        at = Block(x.bi, y.bj, x.r0, y.c0, x.nr, y.nc)
        if not low:
            return at.like(d=x.d @ y.d)
        if x.d is None:
            right = y.dense().T @ x.v if y.d is not None else y.v @ (y.u.T @ x.v)
            return at.like(u=x.u, v=right)
        return at.like(u=x.d @ y.u, v=y.v)

    return _squares(a, b, product, acc, size) if size else summed_blocks(_paired(a, b, ["bj"], ["bi"], product), acc)


def _squares(a: DataFrame, b: DataFrame, product: Callable[[Block, Block], Block | None], acc: Acc, size: int) -> DataFrame:
    cores = a.sparkSession.sparkContext.defaultParallelism
    n = max(-(-size // TILE), int(np.ceil(cores**0.5)))
    side = -(-size // n)
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c: F.least(F.floor(F.col(c) / side), F.lit(n - 1)).cast("int")
    left = a.select(*FIELDS, place("r0").alias("p"), every.alias("q"), F.col("bj").alias("inner"), F.lit(0).alias("side"))
    right = b.select(*FIELDS, every.alias("p"), place("c0").alias("q"), F.col("bi").alias("inner"), F.lit(1).alias("side"))

    def nothing(x: Block, y: Block) -> bool:
        """Of two dense blocks: whether the first is zero, so that their product need not be made."""
        return x.d is not None and y.d is not None and not x.d.any() and bool(np.isfinite(y.d).all())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, beside, held = None, [], {}
        for t in batches:
            for row, (p, q, inner, side) in zip(t[FIELDS].itertuples(), t[["p", "q", "inner", "side"]].itertuples(index=False), strict=True):
                if now is None or now[:2] != (p, q):
                    yield from frames(_shorter(x, 0, acc) for x in held.values())
                    held = {}
                if now != (p, q, inner):
                    now, beside = (p, q, inner), []
                y = Block.of(row)
                if side == 0:
                    beside.append(y.like(*(None if m is None else m.copy() for m in (y.d, y.u, y.v))))  # no views of the whole batch
                    continue
                for x in beside:
                    if nothing(x, y) or nothing(y, x):
                        if (x.bi, y.bj) not in held:
                            held[x.bi, y.bj] = Block(x.bi, y.bj, x.r0, y.c0, x.nr, y.nc, d=np.zeros((x.nr, y.nc)))
                    elif (z := product(x, y)) is not None:
                        held[z.bi, z.bj] = _added(held.get((z.bi, z.bj)), z)
        yield from frames(_shorter(x, 0, acc) for x in held.values())

    met = left.unionByName(right).repartitionById(n * n, F.col("p") * n + F.col("q")).sortWithinPartitions("p", "q", "inner", "side")
    return met.mapInPandas(run, SCHEMA)


def _added(one: Block | None, b: Block) -> Block:
    if one is None:
        return b.like(d=b.d.copy()) if b.d is not None else b
    if one.d is not None:
        one.d += b.dense()
        return one
    if b.d is not None:
        return one.like(d=one.dense() + b.d)
    return _shorter(one.like(u=np.hstack([one.u, b.u]), v=np.hstack([one.v, b.v])), 2 * min(b.nr, b.nc))


def _shorter(b: Block, most: int = 0, to: Acc = TIGHT) -> Block:
    """The caller's accuracy holds once, for the whole sum; parts of it are kept to rounding."""
    return b if b.d is not None or b.u.shape[1] < most else b.like(*(None, *truncate(b.u, b.v, to)))


def summed_blocks(parts: DataFrame, acc: Acc = TIGHT) -> DataFrame:
    """Sums of the blocks of each (bi, bj), however many: within a task before they move, and behind the shuffle as sorted names go by."""
    add, shorter = _added, _shorter
    size = lambda b: 0 if b is None else b.d.size if b.d is not None else b.u.size + b.v.size

    def before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, numbers = {}, 0
        for t in batches:
            for row in t[FIELDS].itertuples():
                b = Block.of(row)
                old = held.get((b.bi, b.bj))
                numbers -= size(old)
                held[b.bi, b.bj] = add(old, b)
                numbers += size(held[b.bi, b.bj])
                if numbers > NUMBERS:
                    yield from frames(shorter(x, 1 + min(x.nr, x.nc)) for x in held.values())
                    held, numbers = {}, 0
        yield from frames(shorter(x, 1 + min(x.nr, x.nc)) for x in held.values())

    def behind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def sums() -> Iterator[Block]:
            now = None
            for t in batches:
                for row in t[FIELDS].itertuples():
                    b = Block.of(row)
                    if now is not None and (now.bi, now.bj) != (b.bi, b.bj):
                        yield shorter(now, 0, acc)
                        now = None
                    now = add(now, b)
            if now is not None:
                yield shorter(now, 0, acc)

        yield from frames(sums())

    return parts.select(FIELDS).mapInPandas(before, SCHEMA).repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInPandas(behind, SCHEMA)


def norm(b: Block) -> float:
    return float(np.linalg.norm(b.d if b.d is not None else lowrank_singular_values(b.u, b.v)))


def norm_frobenius(blocks: DataFrame) -> DataFrame:
    return measured(blocks, lambda b: (norm(b) ** 2,), "sq double").agg(F.sqrt(F.sum("sq")).alias("norm"))


def segments(x: DataFrame, tile: int, size: int) -> DataFrame:
    """vblk(b, x) of vec(i, v): values of each tile in order, absent ones zero."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["b"].iloc[0])
        out = np.zeros(min(tile, size - b * tile))
        out[pdf["p"].to_numpy()] = pdf["v"].to_numpy()
        return pd.DataFrame({"b": [b], "x": [out]})

    return x.select(F.floor(F.col("i") / tile).cast("int").alias("b"), F.pmod("i", F.lit(tile)).cast("int").alias("p"), "v").groupBy("b").applyInPandas(fill, "b int, x array<double>")


def flat(segs: DataFrame, tile: int) -> DataFrame:
    return segs.select("b", F.posexplode("x").alias("p", "v")).select((F.col("b").cast("long") * tile + F.col("p")).alias("i"), "v")


def matvec(blocks: DataFrame, x: DataFrame) -> DataFrame:
    """y segments of A x: partial products per block, summed by entry."""
    both = blocks.select(FIELDS).join(x.select(F.col("b").alias("bj"), "x"), "bj")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            met = ((Block.of(r), np.asarray(r.x, float)) for r in t.itertuples())
            yield from framed(((b.bi, b.d @ z if b.d is not None else b.u @ (b.v.T @ z)) for b, z in met), ["b", "x"])

    return sum_segments(both.mapInPandas(run, "b int, x array<double>"))


def sum_segments(parts: DataFrame) -> DataFrame:
    """Sum of arrays by b, entry-wise, combined before they move."""
    return summed(parts, ["b"])


def matvec_joined(blocks: DataFrame, x: DataFrame) -> DataFrame:
    """As matvec, with the low-rank blocks of a block row put side by side first."""
    both = blocks.select(FIELDS).join(x.select(F.col("b").alias("bj"), "x"), "bj")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bs = [(Block.of(r), np.asarray(r.x, float)) for r in pdf.itertuples()]
        y = sum((b.d @ z for b, z in bs if b.d is not None), np.zeros(bs[0][0].nr))
        low = [(b, z) for b, z in bs if b.d is None]
        if low:
            y = y + np.hstack([b.u for b, _ in low]) @ np.concatenate([b.v.T @ z for b, z in low])
        return pd.DataFrame({"b": [bs[0][0].bi], "x": [y]})

    return both.groupBy("bi").applyInPandas(run, "b int, x array<double>")


def coarsened(blocks: DataFrame, acc: Acc, levels: int, dense_joins: bool = True, most: int = TILE) -> DataFrame:
    """Bottom-up compression: leaves take the smaller form; where all sons of a parent are low-rank, a merged low-rank block replaces them if it is not larger.
    Dense sons join as long as no side is above `most`.

    One shuffle a level by the parent's key; levels end where nothing merged.
    """
    now, done = each(blocks, lambda b: [b.smaller(acc)]), None
    for level in range(1, levels + 1):
        def merge(bs: list[Block]) -> list[Block]:
            r0, c0 = min(b.r0 for b in bs), min(b.c0 for b in bs)
            nr, nc = max(b.r0 + b.nr for b in bs) - r0, max(b.c0 + b.nc for b in bs) - c0
            full = sum(b.nr * b.nc for b in bs) == nr * nc and len(bs) > 1
            at = Block(bs[0].bi >> 1, bs[0].bj >> 1, r0, c0, nr, nc)
            if full and dense_joins and max(nr, nc) <= most and all(b.d is not None for b in bs):
                d = np.zeros((nr, nc))
                for b in bs:
                    d[b.r0 - r0 : b.r0 - r0 + b.nr, b.c0 - c0 : b.c0 - c0 + b.nc] = b.d
                return [at.like(d=d)]
            if full and all(b.d is None for b in bs):
                parts = []
                for b in bs:
                    u, v = np.zeros((nr, b.u.shape[1])), np.zeros((nc, b.v.shape[1]))
                    u[b.r0 - r0 : b.r0 - r0 + b.nr], v[b.c0 - c0 : b.c0 - c0 + b.nc] = b.u, b.v
                    parts.append((u, v))
                u, v = sum_lowrank(parts, acc)
                if u.size + v.size <= sum(b.u.size + b.v.size for b in bs):
                    return [at.like(u=u, v=v)]
            return [Block(-1 - b.bi, -1 - b.bj, b.r0, b.c0, b.nr, b.nc, b.d, b.u, b.v) for b in bs]  # settled: marked by negative names

        merged = grouped(now, [F.shiftright("bi", 1), F.shiftright("bj", 1)], merge)
        from tilewright.sources.storage import durable

        merged = durable(merged, "coarsen")
        settled = merged.where("bi < 0")
        done = settled if done is None else done.unionByName(settled)
        now = merged.where("bi >= 0")
        if now.isEmpty():
            return done
    return now if done is None else done.unionByName(now)


def top_down(whole: DataFrame, acc: Acc, max_rank: int, min_side: int, additive: bool = False) -> DataFrame:
    """Top-down compression by cross approximation: a block that needs more than max_rank is split in four.

    additive: the approximation found at a level is kept and the rest goes on, so that the sum over levels is the
    matrix. A block of at most min_side is settled as it is.
    """
    from tilewright.sources.storage import durable

    todo, done = whole, None
    approx = APPROX["aca_full"]
    while True:
        def step(b: Block) -> list[Block]:
            u, v = approx(b.d, Acc(rank=max_rank, rel=acc.rel, abs=acc.abs))
            rest = b.d - u @ v.T
            settled = lambda **x: Block(-1 - b.bi, -1 - b.bj, b.r0, b.c0, b.nr, b.nc, **x)
            if np.linalg.norm(rest) <= max(acc.rel * np.linalg.norm(b.d), acc.abs):
                return [settled(u=u, v=v)] if u.shape[1] else []
            if min(b.nr, b.nc) <= min_side:
                return [settled(d=b.d)]
            out = [settled(u=u, v=v)] if additive else []
            d = rest if additive else b.d
            hr, hc = b.nr // 2, b.nc // 2
            for p, (ra, rb) in enumerate(((0, hr), (hr, b.nr))):
                for q, (ca, cb) in enumerate(((0, hc), (hc, b.nc))):
                    out.append(Block(2 * b.bi + p, 2 * b.bj + q, b.r0 + ra, b.c0 + ca, rb - ra, cb - ca, d=d[ra:rb, ca:cb]))
            return out

        stepped = durable(each(todo, step), "topdown")
        settled = stepped.where("bi < 0")
        done = settled if done is None else done.unionByName(settled)
        todo = stepped.where("bi >= 0")
        if todo.isEmpty():
            return done


def shared_bases(blocks: DataFrame, acc: Acc, side: str) -> DataFrame:
    """(b, rank, basis): an orthonormal basis for each block row ('row') or column of the low-rank blocks.

    Factors are condensed block by block; the condensed ones of a row or column are one tall matrix, whose QR factors are stacked
    over tasks, so no task sees a whole row of blocks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for r in t.itertuples():
                b = Block.of(r)
                x, y = (b.u, b.v) if side == "row" else (b.v, b.u)
                out.append((b.bi if side == "row" else b.bj, len(x), (np.linalg.qr(y)[1] @ x.T).ravel()))
            yield pd.DataFrame(out, columns=["b", "m", "x"])

    rows = blocks.where("kind = 'R'").select(FIELDS).mapInPandas(run, "b int, m int, x array<double>")
    return tall.singular(rows, ["b"], acc).select("b", F.col("k").alias("rank"), F.col("w").alias("basis"))


def to_uniform(blocks: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """Couplings (bi, bj, kr, kc, s): s = W^T (U V^T) X for the bases W, X of the block's row and column."""
    r = rows.select(F.col("b").alias("bi"), F.col("rank").alias("kr"), F.col("basis").alias("w"))
    c = cols.select(F.col("b").alias("bj"), F.col("rank").alias("kc"), F.col("basis").alias("x"))
    both = blocks.where("kind = 'R'").join(r, "bi").join(c, "bj")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for row in t.itertuples():
                b = Block.of(row)
                w, x = np.asarray(row.w).reshape(b.nr, row.kr), np.asarray(row.x).reshape(b.nc, row.kc)
                out.append((b.bi, b.bj, row.kr, row.kc, ((w.T @ b.u) @ (b.v.T @ x)).ravel()))
            yield pd.DataFrame(out, columns=["bi", "bj", "kr", "kc", "s"])

    return both.mapInPandas(run, "bi int, bj int, kr int, kc int, s array<double>")


def _applied(table: DataFrame, f: Callable, name: str = "x") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield pd.DataFrame([f(r) for r in t.itertuples()], columns=["b", name])

    return table.mapInPandas(run, f"b int, {name} array<double>")


def matvec_uniform(couplings: DataFrame, rows: DataFrame, cols: DataFrame, x: DataFrame) -> DataFrame:
    """Forward (X^T x), couple, backward: three joins that move coefficients only."""
    forward = _applied(cols.join(x, "b"), lambda r: (r.b, np.asarray(r.basis).reshape(-1, r.rank).T @ np.asarray(r.x)))
    met = couplings.join(forward.withColumnRenamed("b", "bj"), "bj")
    middle = sum_segments(_applied(met, lambda r: (r.bi, np.asarray(r.s).reshape(r.kr, r.kc) @ np.asarray(r.x))))
    return _applied(rows.join(middle, "b"), lambda r: (r.b, np.asarray(r.basis).reshape(-1, r.rank) @ np.asarray(r.x)))


def separated(couplings: DataFrame, acc: Acc) -> DataFrame:
    """(bi, bj, kr, kc, k, sr, sc): couplings as s = sr sc^T, both kept apart."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for r in t.itertuples():
                u, v = svd_lowrank(np.asarray(r.s, float).reshape(r.kr, r.kc), acc)
                out.append((r.bi, r.bj, r.kr, r.kc, u.shape[1], u.ravel(), v.ravel()))
            yield pd.DataFrame(out, columns=["bi", "bj", "kr", "kc", "k", "sr", "sc"])

    return couplings.mapInPandas(run, "bi int, bj int, kr int, kc int, k int, sr array<double>, sc array<double>")


def joined(separate: DataFrame) -> DataFrame:
    """Couplings from separated ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = [(r.bi, r.bj, r.kr, r.kc, (np.asarray(r.sr, float).reshape(r.kr, r.k) @ np.asarray(r.sc, float).reshape(r.kc, r.k).T).ravel()) for r in t.itertuples()]
            yield pd.DataFrame(out, columns=["bi", "bj", "kr", "kc", "s"])

    return separate.mapInPandas(run, "bi int, bj int, kr int, kc int, s array<double>")


def scale_rows(segs: DataFrame, blocks: DataFrame) -> DataFrame:
    """D A for a diagonal D in segments: of low-rank blocks only U changes."""
    return _scaled(blocks, segs, "bi", lambda b, x: b.like(d=x[:, None] * b.d) if b.d is not None else b.like(u=x[:, None] * b.u, v=b.v))


def scale_columns(blocks: DataFrame, segs: DataFrame) -> DataFrame:
    """A D for a diagonal D in segments: of low-rank blocks only V changes."""
    return _scaled(blocks, segs, "bj", lambda b, x: b.like(d=b.d * x[None]) if b.d is not None else b.like(u=b.u, v=x[:, None] * b.v))


def _scaled(blocks: DataFrame, segs: DataFrame, key: str, f: Callable) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield from frames(f(Block.of(r), np.asarray(r.x, float)) for r in t.itertuples())

    return blocks.select(FIELDS).join(segs.select(F.col("b").alias(key), "x"), key).mapInPandas(run, SCHEMA)


def matmul_block_diagonal(a: DataFrame, diagonal: DataFrame, b: DataFrame, acc: Acc = TIGHT) -> DataFrame:
    """A D B for a block diagonal D: each block of A meets one tile of D, and the result meets B."""

    def product(x: Block, y: Block) -> Block:
        return x.like(d=x.d @ y.dense()) if x.d is not None else x.like(u=x.u, v=y.dense().T @ x.v)

    return matmul(_paired(a, diagonal.where("bi = bj"), ["bj"], ["bi"], product), b, acc)


def diagonal(blocks: DataFrame) -> DataFrame:
    """vec(i, v) of the diagonal; of low-rank blocks by products of rows of U and V."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for row in t[FIELDS].itertuples():
                b = Block.of(row)
                lo, hi = max(b.r0, b.c0), min(b.r0 + b.nr, b.c0 + b.nc)
                i = np.arange(lo, max(lo, hi))
                v = b.d[i - b.r0, i - b.c0] if b.d is not None else np.einsum("ik,ik->i", b.u[i - b.r0], b.v[i - b.c0])
                yield pd.DataFrame({"i": i, "v": v})

    meets = (F.col("r0") < F.col("c0") + F.col("nc")) & (F.col("c0") < F.col("r0") + F.col("nr"))
    return blocks.where(meets).select(FIELDS).mapInPandas(run, "i long, v double")


def restrict(blocks: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Blocks of the index ranges (ends included), cut where they reach over; of low-rank blocks factor rows are cut. Offsets stay those of the whole."""

    def cut(b: Block) -> list[Block]:
        r = slice(max(0, rows[0] - b.r0), max(0, min(b.nr, rows[1] + 1 - b.r0)))
        c = slice(max(0, cols[0] - b.c0), max(0, min(b.nc, cols[1] + 1 - b.c0)))
        d, u, v = (b.d[r, c], None, None) if b.d is not None else (None, b.u[r], b.v[c])
        return [Block(b.bi, b.bj, b.r0 + r.start, b.c0 + c.start, r.stop - r.start, c.stop - c.start, d, u, v)]

    inside = (F.col("r0") <= rows[1]) & (F.col("r0") + F.col("nr") > rows[0]) & (F.col("c0") <= cols[1]) & (F.col("c0") + F.col("nc") > cols[0])
    return each(blocks.where(inside), cut)


def from_uniform(couplings: DataFrame, rows: DataFrame, cols: DataFrame, tile_r: int, tile_c: int) -> DataFrame:
    r = rows.select(F.col("b").alias("bi"), F.col("basis").alias("w"))
    c = cols.select(F.col("b").alias("bj"), F.col("basis").alias("x"))
    both = couplings.join(r, "bi").join(c, "bj")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for row in t.itertuples():
                w, x, s = np.asarray(row.w).reshape(-1, row.kr), np.asarray(row.x).reshape(-1, row.kc), np.asarray(row.s).reshape(row.kr, row.kc)
                out.append(Block(row.bi, row.bj, row.bi * tile_r, row.bj * tile_c, len(w), len(x), u=w @ s, v=x))
            if out:
                yield frame(out)

    return both.mapInPandas(run, SCHEMA)


def quantized(blocks: DataFrame, codec: str, eps: float) -> DataFrame:
    """(bi, bj, codec, bits, n, z, header parts, error): block data encoded, with the relative error after decoding."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            out = []
            for row in t[FIELDS].itertuples():
                b = Block.of(row)
                x = b.d.ravel() if b.d is not None else np.concatenate((b.u.ravel(), b.v.ravel()))
                z, head = codecs.encode(x, codec, eps)
                y = codecs.decode(z, head)
                size = np.linalg.norm(x)
                out.append((b.bi, b.bj, codec, head["bits"], x.size, z, head["scale"], head["m"], float(np.linalg.norm(x - y) / size) if size else 0.0))
            yield pd.DataFrame(out, columns=["bi", "bj", "codec", "bits", "n", "z", "scale", "m", "error"])

    return blocks.select(FIELDS).mapInPandas(run, "bi int, bj int, codec string, bits int, n int, z binary, scale double, m int, error double")


def quantized_adaptive(blocks: DataFrame, delta: float) -> DataFrame:
    """(bi, bj, bytes, error): U diag(s) V^T with each column at its own precision, so that the whole errs by about delta."""

    def run(b: Block) -> tuple:
        u, s, vt = np.linalg.svd(b.dense(), full_matrices=False)
        keep = s > 1e-14 * max(s[0], 1e-300)
        u, s, vt = u[:, keep], s[keep], vt[keep]
        if not len(s):
            return b.bi, b.bj, 0, 0.0
        tol = codecs.column_tolerances(s / s.sum(), delta / 4)
        size, parts = 0, []
        for x in (u, vt.T):
            cols = []
            for i in range(x.shape[1]):
                z, head = codecs.encode(x[:, i], "aflp", min(0.5, float(tol[i])))
                size += len(z)
                cols.append(codecs.decode(z, head))
            parts.append(np.array(cols).T)
        y = (parts[0] * s) @ parts[1].T
        return b.bi, b.bj, size, float(np.linalg.norm(b.dense() - y, 2) / s.sum())

    return measured(blocks, run, "bi int, bj int, bytes long, error double")


def matvec_nested(t: DataFrame, x: DataFrame, acc: Acc) -> DataFrame:
    """Product with nested bases of two levels: leaf bases, transfers to pairs of leaves, couplings between the pairs.

    Up: coefficients of leaf bases, then of their parents. Couple at the parents. Down: to the leaves and the rows.
    """
    rows, cols = durable(shared_bases(t, acc, "row"), "bases"), durable(shared_bases(t, acc, "col"), "bases")
    s = to_uniform(t, rows, cols)

    def parent_basis(bases: DataFrame, key: str, other: str) -> DataFrame:
        """(p, sons, ranks, transfer): an orthonormal basis of the stacked couplings of two neighbouring leaves."""
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            sons = sorted(set(pdf[key]))
            ranks = [int(pdf.loc[pdf[key] == b, "kr" if key == "bi" else "kc"].iloc[0]) for b in sons]
            parts = []
            for o in sorted(set(pdf[other])):
                stack = []
                wide = None
                for b, k in zip(sons, ranks, strict=True):
                    hit = pdf[(pdf[key] == b) & (pdf[other] == o)]
                    if len(hit):
                        m = np.asarray(hit["s"].iloc[0]).reshape(int(hit["kr"].iloc[0]), int(hit["kc"].iloc[0]))
                        m = m if key == "bi" else m.T
                        wide = m.shape[1]
                        stack.append(m)
                    else:
                        stack.append((k,))
                parts.append(np.vstack([m if isinstance(m, np.ndarray) else np.zeros((m[0], wide)) for m in stack]))
            e, _ = column_basis(np.hstack(parts), acc)
            return pd.DataFrame({"p": [int(sons[0]) >> 1], "sons": [sons], "ranks": [ranks], "k": [e.shape[1]], "e": [e.ravel()]})

        return s.groupBy(F.shiftright(key, 1)).applyInPandas(run, "p int, sons array<int>, ranks array<int>, k int, e array<double>")

    up, down = durable(parent_basis(cols, "bj", "bi"), "transfer"), durable(parent_basis(rows, "bi", "bj"), "transfer")

    def cut(table: DataFrame) -> DataFrame:
        """Transfers by son: (b, p, k, e)."""
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in batches:
                out = []
                for r in f.itertuples():
                    e, at = np.asarray(r.e).reshape(-1, r.k), 0
                    for b, n in zip(r.sons, r.ranks, strict=True):
                        out.append((b, r.p, r.k, e[at : at + n].ravel()))
                        at += n
                yield pd.DataFrame(out, columns=["b", "p", "k", "e"])

        return table.mapInPandas(run, "b int, p int, k int, e array<double>")

    er, ec = cut(down), cut(up)
    coefs = _applied(cols.join(x, "b"), lambda r: (r.b, np.asarray(r.basis).reshape(-1, r.rank).T @ np.asarray(r.x)))
    lifted = sum_segments(_applied(ec.join(coefs, "b"), lambda r: (r.p, np.asarray(r.e).reshape(-1, r.k).T @ np.asarray(r.x))))
    met = s.join(er.select(F.col("b").alias("bi"), F.col("p").alias("rp"), F.col("k").alias("rk"), F.col("e").alias("re")), "bi").join(ec.select(F.col("b").alias("bj"), F.col("p").alias("cp"), F.col("k").alias("ck"), F.col("e").alias("ce")), "bj")
    coupled = met.join(lifted.select(F.col("b").alias("cp"), "x"), "cp")
    mid = sum_segments(_applied(coupled, lambda r: (r.rp, np.asarray(r.re).reshape(r.kr, r.rk).T @ (np.asarray(r.s).reshape(r.kr, r.kc) @ (np.asarray(r.ce).reshape(r.kc, r.ck) @ np.asarray(r.x))))))
    leaf = _applied(er.join(mid.select(F.col("b").alias("p"), "x"), "p"), lambda r: (r.b, np.asarray(r.e).reshape(-1, r.k) @ np.asarray(r.x)))
    return _applied(rows.join(leaf, "b"), lambda r: (r.b, np.asarray(r.basis).reshape(-1, r.rank) @ np.asarray(r.x)))
