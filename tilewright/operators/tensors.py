"""Dense tensors as entry tables ten(i0, i1, i2[, i3], v), and as blocks for Tucker forms.

Whole-tensor forms use joins and groupings for products and stacked QR for mode bases; only n_d x n_d triangles reach the driver.
Blockwise forms cut the tensor once and work within tasks. Results are dense where the work is: expanded Tucker forms have
every cell of the index box, inverse transforms every cell of a 2x2x2 cube with an entry, merged blocks every cell of a block with
an entry; cells that the input lacks are zeros there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions import codecs
from tilewright.functions.dense import Acc, trunc_rank
from tilewright.operators import tall
from tilewright.sources.storage import durable


def indices(t: DataFrame) -> list[str]:
    return [c for c in t.columns if c != "v"]


def shape(t: DataFrame) -> list[int]:
    row = t.agg(*[F.max(i) for i in indices(t)]).first()
    return [int(x) + 1 if x is not None else 0 for x in row]


def unfold(t: DataFrame, mode: int) -> DataFrame:
    """coo of the mode's unfolding; among the other indices the lower one runs fastest."""
    names, n = indices(t), shape(t)
    col, step = F.lit(0).cast("long"), 1
    for d, name in enumerate(names):
        if d != mode:
            col = col + F.col(name) * F.lit(step)
            step *= n[d]
    return t.select(F.col(names[mode]).cast("long").alias("i"), col.cast("long").alias("j"), "v")


def tensor_slice(t: DataFrame, mode: int, at: int) -> DataFrame:
    names = indices(t)
    return t.where(F.col(names[mode]) == at).drop(names[mode])


def fiber(t: DataFrame, mode: int, fixed: Sequence[int]) -> DataFrame:
    """Entries along a mode with the other indices fixed, in their order."""
    names = indices(t)
    rest = [n for d, n in enumerate(names) if d != mode]
    for n, at in zip(rest, fixed, strict=True):
        t = t.where(F.col(n) == at)
    return t.select(F.col(names[mode]).alias("i"), "v")


def sub_range(t: DataFrame, bounds: Sequence[tuple[int, int]]) -> DataFrame:
    for n, (lo, hi) in zip(indices(t), bounds, strict=True):
        t = t.where(F.col(n).between(lo, hi))
    return t


def mode_product(t: DataFrame, m: DataFrame, mode: int) -> DataFrame:
    """t x_mode M for coo M(i, j, v): index j meets the mode, i replaces it."""
    names = indices(t)
    right = m.select(F.col("i").cast("int").alias("_i"), F.col("j").cast("int").alias(names[mode]), F.col("v").alias("_w"))
    met = t.join(right, names[mode]).drop(names[mode]).withColumnRenamed("_i", names[mode])
    return met.groupBy(*names).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def matrix_table(spark, m: np.ndarray) -> DataFrame:
    """coo of a small matrix (n_d x k)."""
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, v double")


def multiply_all(t: DataFrame, factors: Sequence[np.ndarray], transposed: bool = False) -> DataFrame:
    for d, x in enumerate(factors):
        t = mode_product(t, matrix_table(t.sparkSession, x.T if transposed else x), d)
    return t


def dwt3(t: DataFrame) -> DataFrame:
    """Haar sums and differences of 2x2x2 cells, unnormalised: (b0, b1, b2, band, v); odd axes count as padded with zeros."""
    cells = t.select(*[F.floor(F.col(f"i{d}") / 2).cast("int").alias(f"b{d}") for d in range(3)], *[(F.col(f"i{d}") % 2).alias(f"p{d}") for d in range(3)], "v")
    signs = [F.sum(F.when(sum(((F.col(f"p{d}") * ((band >> d) & 1)) for d in range(3)), F.lit(0)) % 2 == 0, F.col("v")).otherwise(-F.col("v"))) for band in range(8)]
    return cells.groupBy("b0", "b1", "b2").agg(F.array(*signs).alias("w")).select("b0", "b1", "b2", F.posexplode("w").alias("band", "v"))


def idwt3(bands: DataFrame) -> DataFrame:
    """Inverse of dwt3: entries from the eight bands of a cell, divided by 8. Padding stays in as zeros."""
    cell = bands.groupBy("b0", "b1", "b2").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "v"))), lambda s: s["v"]).alias("w"))
    value = [sum((F.col("w")[band] * (-1.0) ** bin(band & p).count("1") for band in range(8)), F.lit(0.0)) / 8 for p in range(8)]
    out = cell.select("b0", "b1", "b2", F.posexplode(F.array(*value)).alias("p", "v"))
    return out.select(*[(2 * F.col(f"b{d}") + F.shiftright("p", d).bitwiseAND(1)).cast("int").alias(f"i{d}") for d in range(3)], "v")


#: Modes above this are not for whole-tensor forms, whose n_d x n_d triangles reach the driver; blockwise forms have no such bound.
MODE_LIMIT = 4096


def mode_basis(t: DataFrame, mode: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal basis (falling singular values) of a mode, and those values, by QR of the transposed unfolding.

    Fibers of the mode are rows of a tall matrix, whose triangles are stacked over tasks: no self-join, and no squaring of small values.
    """
    names = indices(t)
    n = shape(t)[mode]
    if n > MODE_LIMIT:
        raise ValueError(f"mode {mode} has {n} indices, more than {MODE_LIMIT}")
    held = t.groupBy(*[x for d, x in enumerate(names) if d != mode]).agg(F.map_from_entries(F.collect_list(F.struct(F.col(names[mode]).cast("int"), F.col("v").cast("double")))).alias("e"))
    rows = held.select(F.lit(n).alias("m"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.coalesce(F.try_element_at("e", j), F.lit(0.0))).alias("x"))
    found = tall.triangles(rows, []).first()
    _, s, vt = np.linalg.svd(np.asarray(found["r"], float).reshape(n, n) if found else np.zeros((n, n)))
    return vt.T, s


def hosvd(t: DataFrame, acc: Acc, sequential: bool = False, ranks: Sequence[int] | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """Core and factors. The tolerance is shared over the d modes by 1 / sqrt(d); sequential truncates the core as it goes."""
    d = len(indices(t))
    part = Acc(acc.rank, acc.rel / d**0.5, acc.abs / d**0.5, acc.norm)
    t = durable(t, "tensor")
    core, factors = t, []
    for mode in range(d):
        u, s = mode_basis(core if sequential else t, mode)
        k = max(1, ranks[mode] if ranks else trunc_rank(s, part))
        factors.append(u[:, :k])
        if sequential:
            core = durable(mode_product(core, matrix_table(t.sparkSession, u[:, :k].T), mode), "core")
    return (core if sequential else multiply_all(t, factors, transposed=True)), factors


def greedy_hosvd(t: DataFrame, rel: float) -> tuple[DataFrame, list[np.ndarray]]:
    """Ranks from one falling order of all modes' singular values, until the squares left are at most (rel |t|)^2."""
    t = durable(t, "tensor")
    bases = [mode_basis(t, m) for m in range(len(indices(t)))]
    order = sorted(((s, m, k) for m, (_, sig) in enumerate(bases) for k, s in enumerate(sig) if k), reverse=True)
    ranks, left = [1] * len(bases), sum(s * s for s, _, _ in order)
    whole = float((bases[0][1] ** 2).sum())
    for s, m, _ in order:
        if left <= rel * rel * whole:
            break
        ranks[m] += 1
        left -= s * s
    factors = [u[:, :k] for (u, _), k in zip(bases, ranks, strict=True)]
    return multiply_all(t, factors, transposed=True), factors


def hooi(t: DataFrame, acc: Acc, maxit: int = 3, tol: float = 1e-10) -> tuple[DataFrame, list[np.ndarray]]:
    """Alternates mode bases of the tensor projected on the other modes until the core's norm changes by less than tol."""
    t = durable(t, "tensor")
    _, factors = hosvd(t, acc)
    before, core = 0.0, t
    for _ in range(maxit):
        for mode in range(len(factors)):
            part = t
            for d, x in enumerate(factors):
                if d != mode:
                    part = mode_product(part, matrix_table(t.sparkSession, x.T), d)
            factors[mode] = mode_basis(durable(part, "part"), mode)[0][:, : factors[mode].shape[1]]
        core = durable(multiply_all(t, factors, transposed=True), "core")
        norm = core.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0
        if abs(norm - before) <= tol * norm:
            break
        before = norm
    return core, factors


def mttkrp(t: DataFrame, factors: Sequence[DataFrame], mode: int) -> DataFrame:
    """coo (index of mode, r): t unfolded times the Khatri-Rao product of the other factors coo(i, j, v)."""
    names = indices(t)
    met = t
    keys = []
    for d, n in enumerate(names):
        if d != mode:
            met = met.join(factors[d].select(F.col("i").cast("int").alias(n), F.col("j").alias("_r"), F.col("v").alias(f"_f{d}")), [n, *keys])
            keys = ["_r"]
    value = F.col("v")
    for d in range(len(names)):
        if d != mode:
            value = value * F.col(f"_f{d}")
    return met.groupBy(F.col(names[mode]).cast("long").alias("i"), F.col("_r").alias("j")).agg(F.sum(value).alias("v"))


def cp_als(t: DataFrame, rank: int, maxit: int = 4, seed: int = 3) -> list[np.ndarray]:
    """CP factors by alternating least squares; each half-step is an mttkrp on Spark and a rank x rank solve here."""
    t = durable(t, "tensor")
    n, rng = shape(t), np.random.default_rng(seed)
    factors = [rng.random((k, rank)) + 0.1 for k in n]
    for _ in range(maxit):
        for mode in range(len(n)):
            rows = mttkrp(t, [matrix_table(t.sparkSession, f) for f in factors], mode).collect()  # n_d x rank
            m = np.zeros((n[mode], rank))
            for r in rows:
                m[r["i"], r["j"]] = r["v"]
            g = np.ones((rank, rank))
            for d, f in enumerate(factors):
                if d != mode:
                    g = g * (f.T @ f)
            factors[mode] = m @ np.linalg.pinv(g)
    return factors


def cp_entries(spark, factors: Sequence[np.ndarray]) -> DataFrame:
    out = None
    for d, f in enumerate(factors):
        m = matrix_table(spark, f).select(F.col("i").cast("int").alias(f"i{d}"), F.col("j").alias("_r"), F.col("v").alias(f"_f{d}"))
        out = m if out is None else out.join(m, "_r")
    value = F.lit(1.0)
    for d in range(len(factors)):
        value = value * F.col(f"_f{d}")
    return out.groupBy(*[f"i{d}" for d in range(len(factors))]).agg(F.sum(value).alias("v"))


# Blocks.

TBLOCK = "b0 int, b1 int, b2 int, o0 int, o1 int, o2 int, n0 int, n1 int, n2 int, kind string, data array<double>, g array<double>, x0 array<double>, x1 array<double>, x2 array<double>, k0 int, k1 int, k2 int, bytes long"
TFIELDS = [f.split()[0] for f in TBLOCK.split(", ")]


def local_hosvd(x: np.ndarray, tol: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tucker form of a block with absolute error at most tol: sequentially truncated, from SVDs of the unfoldings."""
    core, factors = x, []
    for mode in range(x.ndim):
        m = np.moveaxis(core, mode, 0).reshape(core.shape[mode], -1)
        u, s, _ = np.linalg.svd(m, full_matrices=False)
        k = max(1, trunc_rank(s, Acc(abs=tol / x.ndim**0.5)))
        factors.append(u[:, :k])
        core = np.moveaxis(np.tensordot(u[:, :k].T, core, axes=(1, mode)), 0, mode)
    return core, factors


def local_tca(x: np.ndarray, tol: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tucker form by cross approximation: rank-1 terms through the largest entry's fibers, then recompressed."""
    rest, fibers = x.astype(float).copy(), [[], [], []]
    for _ in range(min(x.shape) * 4):
        at = np.unravel_index(np.abs(rest).argmax(), x.shape)
        if abs(rest[at]) <= 1e-300 or np.linalg.norm(rest) <= tol / 2:
            break
        a, b, c = rest[:, at[1], at[2]].copy(), rest[at[0], :, at[2]] / rest[at], rest[at[0], at[1], :] / rest[at]
        for f, v in zip(fibers, (a, b, c), strict=True):
            f.append(v)
        rest -= np.einsum("i,j,k->ijk", a, b, c)
    if np.linalg.norm(rest) > tol / 2 or not fibers[0]:
        return local_hosvd(x, tol)
    qs = [np.linalg.qr(np.array(f).T) for f in fibers]
    core = np.einsum("ir,jr,kr->ijk", *(r for _, r in qs))
    g, ys = local_hosvd(core, tol / 2)
    return g, [q @ y for (q, _), y in zip(qs, ys, strict=True)]


def expand(g: np.ndarray, factors: Sequence[np.ndarray]) -> np.ndarray:
    for mode, x in enumerate(factors):
        g = np.moveaxis(np.tensordot(x, g, axes=(1, mode)), 0, mode)
    return g


def _row(b: tuple, o: tuple, x: np.ndarray | None, tucker: tuple | None) -> tuple:
    if tucker is None:
        return (*b, *o, *x.shape, "D", x.ravel(), None, None, None, None, 0, 0, 0, 8 * x.size)
    g, f = tucker
    return (*b, *o, *(y.shape[0] for y in f), "T", None, g.ravel(), *(y.ravel() for y in f), *g.shape, 8 * (g.size + sum(y.size for y in f)))


def _of(r) -> tuple[np.ndarray | None, tuple | None]:
    if r.kind == "D":
        return np.asarray(r.data, float).reshape(r.n0, r.n1, r.n2), None
    ks, ns = (r.k0, r.k1, r.k2), (r.n0, r.n1, r.n2)
    return None, (np.asarray(r.g, float).reshape(ks), [np.asarray(x, float).reshape(n, k) for x, n, k in zip((r.x0, r.x1, r.x2), ns, ks, strict=True)])


def full(r) -> np.ndarray:
    x, t = _of(r)
    return x if t is None else expand(*t)


def split_tensor(t: DataFrame, ntile: int) -> DataFrame:
    """Dense blocks of side ntile, ragged at the ends; blocks without entries are absent."""
    n = shape(t)
    keyed = t.select(*[F.floor(F.col(f"i{d}") / ntile).cast("int").alias(f"b{d}") for d in range(3)], "i0", "i1", "i2", "v")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        b = tuple(int(pdf[f"b{d}"].iloc[0]) for d in range(3))
        o = tuple(x * ntile for x in b)
        x = np.zeros([min(ntile, n[d] - o[d]) for d in range(3)])
        np.add.at(x, tuple(pdf[f"i{d}"].to_numpy() - o[d] for d in range(3)), pdf["v"].to_numpy())
        return pd.DataFrame([_row(b, o, x, None)], columns=TFIELDS)

    return keyed.groupBy("b0", "b1", "b2").applyInPandas(fill, TBLOCK)


def merge_tensor(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for r in t.itertuples():
                x = full(r)
                i = np.indices(x.shape).reshape(3, -1)
                yield pd.DataFrame({"i0": i[0] + r.o0, "i1": i[1] + r.o1, "i2": i[2] + r.o2, "v": x.ravel()})

    return blocks.mapInPandas(run, "i0 int, i1 int, i2 int, v double")


def _mapped(blocks: DataFrame, f: Callable) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            yield pd.DataFrame([f(r) for r in t.itertuples()], columns=TFIELDS)

    return blocks.mapInPandas(run, TBLOCK)


def blockwise_tucker(blocks: DataFrame, tol: float, approx: Callable = local_hosvd) -> DataFrame:
    """Each block as a Tucker form if that takes fewer numbers; tol is the absolute error of a block."""

    def run(r) -> tuple:
        x = full(r)
        g, f = approx(x, tol)
        small = g.size + sum(y.size for y in f) < x.size
        return _row((r.b0, r.b1, r.b2), (r.o0, r.o1, r.o2), x, (g, f) if small else None)

    return _mapped(blocks, run)


def block_tolerance(t: DataFrame, ntile: int, rel: float) -> float:
    """rel |t|_F shared evenly over the blocks."""
    norm = t.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0
    count = int(np.prod([-(-k // ntile) for k in shape(t)])) or 1
    return rel * norm / count**0.5


def hierarchical_tucker(blocks: DataFrame, tol: float) -> DataFrame:
    """Merges eight sons into one Tucker block where that takes fewer bytes than the sons and than the full block; one shuffle a level."""
    now, done = blockwise_tucker(blocks, tol), None
    while True:
        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = list(pdf[TFIELDS].itertuples())
            o = [min(getattr(r, f"o{d}") for r in rows) for d in range(3)]
            n = [max(getattr(r, f"o{d}") + getattr(r, f"n{d}") for r in rows) - o[d] for d in range(3)]
            if len(rows) > 1 and sum(r.n0 * r.n1 * r.n2 for r in rows) == np.prod(n):
                x = np.zeros(n)
                for r in rows:
                    x[r.o0 - o[0] : r.o0 - o[0] + r.n0, r.o1 - o[1] : r.o1 - o[1] + r.n1, r.o2 - o[2] : r.o2 - o[2] + r.n2] = full(r)
                made = _row((rows[0].b0 >> 1, rows[0].b1 >> 1, rows[0].b2 >> 1), tuple(o), x, local_hosvd(x, tol))
                if made[-1] < min(sum(r.bytes for r in rows), 8 * x.size):
                    return pd.DataFrame([made], columns=TFIELDS)
            return pd.DataFrame([(-1 - r.b0, *tuple(r)[2:]) for r in rows], columns=TFIELDS)  # settled

        merged = durable(now.groupBy(*[F.shiftright(f"b{d}", 1) for d in range(3)]).applyInPandas(merge, TBLOCK), "tucker")
        settled = merged.where("b0 < 0")
        done = settled if done is None else done.unionByName(settled)
        now = merged.where("b0 >= 0")
        if now.limit(2).count() < 2:
            return done.unionByName(now)


def quantized(blocks: DataFrame, codec: str, eps: float) -> DataFrame:
    """Blocks whose numbers went through a codec, with `bytes` of the encoded form."""

    def run(r) -> tuple:
        x, t = _of(r)
        size, parts = 0, []
        for p in [x] if t is None else [t[0], *t[1]]:
            z, head = codecs.encode(p, codec, eps)
            size += len(z)
            parts.append(codecs.decode(z, head).reshape(p.shape))
        row = _row((r.b0, r.b1, r.b2), (r.o0, r.o1, r.o2), parts[0] if t is None else None, None if t is None else (parts[0], parts[1:]))
        return (*row[:-1], size)

    return _mapped(blocks, run)
