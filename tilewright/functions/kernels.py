"""Kernel functions of distances: as column expressions, and as NumPy functions for blocks of points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.dense import bessel_k
from tilewright.operators.arrays import mapped_sum
from tilewright.sources.storage import durable

#: Rows of a block that are taken at once where only sums of it are wanted.
STRIP = 64
#: Squared distances below this share of the points' own squares are taken by differences: expanded squares have lost two digits there, and more below.
CLOSE = 1e-2
#: Below this distance a singular kernel takes its value at zero.
NEAR = 1e-12
DEFAULTS = {
    "logarithmic": {}, "newton": {}, "exponential": {"eps": 2.0}, "gaussian": {"eps": 2.0}, "multiquadric": {"eps": 2.0}, "inverse_multiquadric": {"eps": 2.0}, "thin_plate": {"eps": 2.0},
    "rational_quadratic": {"alpha": 2.0, "length": 0.5}, "helmholtz": {"kappa": 2.0}, "matern_half": {"length": 0.5, "sigma": 2.0},
}


def column(kernel: str, r: Column, eps: float = 1.0, alpha: float = 1.0, length: float = 1.0, kappa: float = 1.0, sigma: float = 1.0) -> Column:
    """A kernel of the distance column r."""
    far, er = r > NEAR, F.lit(eps) * r
    return {
        "logarithmic": lambda: F.when(far, F.log(r)).otherwise(0.0),
        "newton": lambda: F.when(far, 1 / r).otherwise(0.0),
        "exponential": lambda: F.exp(-er),
        "gaussian": lambda: F.exp(-er * r),
        "multiquadric": lambda: F.sqrt(1 + er * er),
        "inverse_multiquadric": lambda: 1 / F.sqrt(1 + er * er),
        "thin_plate": lambda: F.when(far, er * er * F.log(er)).otherwise(0.0),
        "rational_quadratic": lambda: F.pow(1 + r * r / F.lit(2 * alpha * length * length), F.lit(-alpha)),
        "helmholtz": lambda: F.when(far, F.cos(F.lit(kappa) * r) / r).otherwise(0.0),
        "matern_half": lambda: F.lit(sigma * sigma) * F.exp(-r / F.lit(length)),
    }[kernel]()


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of two point sets, an axis at a time, so that no array has all axes."""
    out, gap = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), strict=True):
        np.subtract(a[:, None], b, out=gap)
        gap *= gap
        out += gap
    return out


def expanded(x: np.ndarray, y: np.ndarray) -> Callable[[slice], np.ndarray]:
    """Squared distances of up to STRIP rows of x to all of y, in an array that the next strip overwrites: one matrix product |x|^2 - 2 x.y + |y|^2 about the
    mean of x; close points, where that would lose digits, by differences, and so everything where many are close or numbers are out of range."""
    p, q = x - x.mean(axis=0), y - x.mean(axis=0)
    pp, qq = (p * p).sum(axis=1), (q * q).sum(axis=1)
    limit = CLOSE * (pp.max() + qq.max())
    if not np.isfinite(limit):
        return lambda rows: squares(x[rows], y)
    left, right = np.column_stack([p, pp, np.ones(len(p))]), np.vstack([-2 * q.T, np.ones(len(q)), qq])
    held = np.empty((min(STRIP, len(x)), len(y)))

    def strip(rows: slice) -> np.ndarray:
        out = np.matmul(left[rows], right, out=held[: len(left[rows])])
        close = np.flatnonzero(out <= limit)
        if len(close) > out.size // 8:
            return squares(x[rows], y)
        i, j = np.divmod(close, len(y))
        gap = x[rows][i] - y[j]
        out.ravel()[close] = (gap * gap).sum(axis=1)
        return out

    return strip


def array(kernel: str, x: np.ndarray, y: np.ndarray, **params: float) -> np.ndarray:
    """Kernel block between two point sets."""
    return of_squares(kernel, squares(x, y), **params)


def of_squares(kernel: str, square: np.ndarray, eps: float = 1.0, alpha: float = 1.0, length: float = 1.0, kappa: float = 1.0, sigma: float = 1.0) -> np.ndarray:
    """A kernel of squared distances, whose array is overwritten."""

    def scaled(by: float, plus: float = 0.0) -> np.ndarray:
        out = np.multiply(square, by, out=square)
        return np.add(out, plus, out=out) if plus else out

    def root(of: np.ndarray) -> np.ndarray:
        return np.sqrt(of, out=of)

    def singular(f) -> np.ndarray:
        r = root(square)
        if r.size == 0 or not r.min() <= NEAR:
            return f(r)
        near = r <= NEAR
        r[near] = 1.0
        v = f(r)
        v[near] = 0.0
        return v

    def inverse(of: np.ndarray) -> np.ndarray:
        return np.divide(1.0, of, out=of)

    return {
        "logarithmic": lambda: singular(lambda r: np.log(r, out=r)),
        "newton": lambda: singular(inverse),
        "exponential": lambda: np.exp(-eps * root(square)),
        "gaussian": lambda: np.exp(scaled(-eps), out=square),
        "multiquadric": lambda: root(scaled(eps * eps, 1.0)),
        "inverse_multiquadric": lambda: inverse(root(scaled(eps * eps, 1.0))),
        "thin_plate": lambda: singular(lambda r: (eps * r) ** 2 * np.log(eps * r)),
        "rational_quadratic": lambda: scaled(1 / (2 * alpha * length * length), 1.0) ** -alpha,
        "helmholtz": lambda: singular(lambda r: np.cos(kappa * r) / r),
        "matern_half": lambda: sigma * sigma * np.exp(root(square) / -length),
    }[kernel]()


def distance(x: Column, y: Column, dim: int | None = None) -> Column:
    """Of two array columns; with their length given, as plain arithmetic."""
    if dim:
        total = F.lit(0.0)
        for d in range(dim):
            total = total + (x[d] - y[d]) * (x[d] - y[d])
        return F.sqrt(total)
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))


def tiles(points: DataFrame, side: int = 1024) -> DataFrame:
    """(t, ids, xs): points gathered into tiles of at most about `side`, by a hash of their id; spread over all cores, as a row means much work."""
    n = max(1, -(-points.count() // side))
    found = points.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("t")).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("x")).alias("xs"), F.first(F.size("x")).alias("dim"))
    return found.repartition(points.sparkSession.sparkContext.defaultParallelism)


def _pairs(points: DataFrame, side: int, once: bool = False) -> DataFrame:
    """Pairs of tiles (t, ids, xs, dim, u, jds, ys); once: each two tiles meet in one pair only."""
    t = durable(tiles(points, side), "tiles")
    met = t.join(t.select(F.col("t").alias("u"), F.col("ids").alias("jds"), F.col("xs").alias("ys")), how="cross")
    # of two tiles either may come first, by the parity of their sum, so that each tile leads about half of its pairs
    return met.where(F.when((F.col("t") + F.col("u")) % 2 == 0, F.col("t") <= F.col("u")).otherwise(F.col("t") > F.col("u"))) if once else met


def _points(row) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.asarray(z, float).reshape(-1, row.dim) for z in (row.xs, row.ys))


def entries(points: DataFrame, kernel, params: dict) -> DataFrame:
    """coo of k(|x_i - x_j|) for all pairs, which is this operator's result: tiles of points meet, and each pair of tiles is one array.

    kernel is a name, or any function of a distance column; the latter is taken row by row.
    """
    if callable(kernel):
        low, high = points.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
        a = points.select(F.col("id").alias("i"), F.col("x").alias("xi")).repartition(points.sparkSession.sparkContext.defaultParallelism)
        b = points.select(F.col("id").alias("j"), F.col("x").alias("xj"))
        return a.join(b, how="cross").select("i", "j", kernel(distance(F.col("xi"), F.col("xj"), high if low == high else None)).alias("v"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            for row in t.itertuples():
                v = array(kernel, *_points(row), **params)
                yield pd.DataFrame({"i": np.repeat(np.asarray(row.ids), v.shape[1]), "j": np.tile(np.asarray(row.jds), v.shape[0]), "v": v.ravel()})

    return _pairs(points, 256).mapInPandas(run, "i long, j long, v double")


def sums(points: DataFrame, kernel: str, params: dict) -> DataFrame:
    """vec(i, v): row sums of a kernel over all points. Kernels of a distance are symmetric: each two tiles meet once and give sums of rows and columns,
    which are added within tasks before they move. A task works on strips of a block that stay in a core's cache."""

    def run(row) -> Iterator[tuple]:
        x, y = _points(row)
        rows, cols, square = np.empty(len(x)), np.zeros(len(y)), expanded(x, y)
        for at in range(0, len(x), STRIP):
            v = of_squares(kernel, square(slice(at, at + STRIP)), **params)
            rows[at : at + STRIP] = v.sum(axis=1)
            cols += v.sum(axis=0)
        yield row.t, rows
        if row.t != row.u:
            yield row.u, cols

    pairs = _pairs(points, 512, once=True)
    held = pairs.select("t", "ids").where("t = u")
    found = mapped_sum(pairs.select("t", "u", "xs", "ys", "dim"), run, "t long, x array<double>").join(held, "t")
    return found.select(F.explode(F.arrays_zip("ids", "x")).alias("e")).select(F.col("e.ids").alias("i"), F.col("e.x").alias("v"))


def matern_sums(points: DataFrame, nu: float, length: float, sigma: float) -> DataFrame:
    """Row sums of the Matern kernel, whose Bessel function is taken by quadrature inside blocks."""
    from math import gamma

    pairs = _pairs(points, 256)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                x, y = _points(row)
                r = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
                z = np.sqrt(2 * nu) * r / length
                some, index = np.unique(np.round(z, 12), return_inverse=True)
                value = np.full(len(some), sigma**2)
                far = some > NEAR
                for at in np.array_split(np.flatnonzero(far), max(1, far.sum() // 2000)):
                    value[at] = sigma**2 * 2 ** (1 - nu) / gamma(nu) * some[at] ** nu * bessel_k(nu, some[at])
                yield pd.DataFrame({"i": np.asarray(row.ids), "v": value[index.reshape(r.shape)].sum(axis=1)})

    return pairs.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))


def log_kernel_points(spark: SparkSession, n: int) -> DataFrame:
    """Midpoints and supports of n equal cells of [0, 1]."""
    return spark.range(n).select(F.col("id").alias("i"), ((F.col("id") + 0.5) / n).alias("mid"), (F.col("id") / n).alias("lo"), ((F.col("id") + 1) / n).alias("hi"))


def log_kernel_diagonals(spark: SparkSession, n: int) -> DataFrame:
    """(d, v): the entry of each diagonal d = j - i of log_kernel_entries."""
    h = 1.0 / n if n else 0.0
    m = F.abs("d").cast("double")

    def q(c: Column) -> Column:
        return F.when(c > 0, c * c * F.log(c)).otherwise(0.0)

    value = F.lit(h * h) * (F.lit(1.5 - np.log(h or 1.0)) - (q(m + 1) + q(F.abs(m - 1)) - 2 * q(m)) / 2)
    return spark.range(1 - n, n).withColumnRenamed("id", "d").select("d", value.alias("v"))


#: A task takes up to so many entries of a diagonal at once.
RUN = 16384


def toeplitz(diagonals: DataFrame, n: int) -> DataFrame:
    """coo of the n x n matrix whose diagonals are given as (d, v), d = j - i: n^2 rows by definition, but a value is made once, not for each of its entries."""
    lo, hi = F.greatest(F.lit(0), -F.col("d")), F.least(F.lit(n), n - F.col("d")) - 1
    runs = diagonals.select("d", "v", hi.alias("hi"), F.explode(F.sequence(lo, hi, F.lit(RUN).cast("long"))).alias("lo"))
    runs = runs.repartition(8 * diagonals.sparkSession.sparkContext.defaultParallelism, "d", "lo")
    at = runs.select("d", "v", F.explode(F.sequence("lo", F.least(F.col("hi"), F.col("lo") + (RUN - 1)))).alias("i"))
    return at.select("i", (F.col("i") + F.col("d")).alias("j"), "v")


def log_kernel_entries(spark: SparkSession, n: int) -> DataFrame:
    """Galerkin entries of -log|x - y| between n cells of width h = 1/n.

    With m = |i - j| and q(m) = m^2 log m (0 at 0): h^2 (3/2 - log h - (q(m+1) + q(m-1) - 2 q(m)) / 2).
    """
    return toeplitz(log_kernel_diagonals(spark, n), n)


def mantissa_bits(eps: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(-F.log2(eps))).cast("int")


def padded_bits(bits: Column) -> Column:
    return (F.ceil(bits / 8) * 8).cast("int")
