"""Matrices, vectors and tensors as tables of entries: coo(i, j, v), vec(i, v). Absent entries are zero.

All are plain joins and groupings that Catalyst plans; sums combine before they shuffle, and skewed keys are left to
adaptive execution or, in matmul and matvec, to a salt the caller may ask for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IJ = ("i", "j")


def scale(a: DataFrame, alpha: float) -> DataFrame:
    return a.withColumn("v", F.lit(alpha) * F.col("v"))


def absolute(a: DataFrame) -> DataFrame:
    return a.withColumn("v", F.abs("v"))


#: filled() makes a row of the matrix in pieces of so many columns, and gives index tables of up to so many columns to every task.
FILLED, SHARED = 4096, 8_000_000


def filled(a: DataFrame, rows: DataFrame, cols: DataFrame, value: float = 0.0) -> DataFrame:
    """Every (i, j) of the index tables rows(i) and cols(j), with `value` where a has no entry. Dense by definition.

    The result is never shuffled: entries are joins of the given tables; what is absent is made by row and piece of columns, less the entries there.
    """
    parts = 4 * a.sparkSession.sparkContext.defaultParallelism  # few bytes go in, many rows come out
    piece = F.floor(F.col("j") / FILLED)
    named = cols.select("j").where("j is not null").withColumn("copy", F.row_number().over(Window.partitionBy("j").orderBy("j")))  # an index named twice counts twice
    named = named.groupBy(piece.alias("b"), "copy").agg(F.collect_list("j").alias("js"))
    held = a.where("i is not null and j is not null").groupBy("i", piece.alias("b")).agg(F.collect_set("j").alias("e")).repartition(parts, "i", "b")
    spread = rows.select("i").join(named.select("b", "copy"), how="cross").repartition(parts, "i", "b").join(held, ["i", "b"], "left")
    left = F.when(F.col("e").isNull(), F.col("js")).otherwise(F.array_except("js", "e"))
    absent = spread.join(F.broadcast(named) if cols.count() <= SHARED else named, ["b", "copy"]).select("i", F.explode(left).alias("j"), F.lit(value).alias("v"))
    present = rows.select("i").join(a.select("i", "j", "v"), "i").join(cols.select("j"), "j").select("i", "j", F.coalesce("v", F.lit(value)).alias("v"))
    nameless = rows.select("i").join(cols.select("j").where("j is null"), how="cross").select("i", "j", F.lit(value).alias("v"))
    return present.unionByName(absent).unionByName(nameless)


def add(alpha: float, a: DataFrame, beta: float, b: DataFrame, keys: Sequence[str] = IJ) -> DataFrame:
    """alpha A + beta B; `keys` names the indices of a vector, matrix or tensor."""
    return scale(a, alpha).select(*keys, "v").unionByName(scale(b, beta).select(*keys, "v")).groupBy(*keys).agg(F.sum("v").alias("v"))


def linear_sum(terms: Sequence[tuple[float, DataFrame]], keys: Sequence[str] = IJ) -> DataFrame:
    """Sum of alpha_k A_k with one grouping for all of them."""
    parts = [scale(a, alpha).select(*keys, "v") for alpha, a in terms]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(*keys).agg(F.sum("v").alias("v"))


def identity(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))


def add_identity(a: DataFrame, rows: DataFrame, lam: float) -> DataFrame:
    return add(1.0, a, lam, identity(rows))


def add_diagonal(a: DataFrame, d: DataFrame) -> DataFrame:
    return add(1.0, a, 1.0, d.select("i", F.col("i").alias("j"), "v"))


def hadamard(a: DataFrame, b: DataFrame, keys: Sequence[str] = IJ) -> DataFrame:
    return a.join(b.withColumnRenamed("v", "w"), list(keys)).select(*keys, (F.col("v") * F.col("w")).alias("v"))


def scale_rows(d: DataFrame, a: DataFrame) -> DataFrame:
    return a.join(d.select("i", F.col("v").alias("w")), "i").select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def scale_columns(a: DataFrame, d: DataFrame) -> DataFrame:
    return a.join(d.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").select("i", "j", (F.col("v") * F.col("w")).alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def adjoint(a: DataFrame) -> DataFrame:
    """Of complex entries struct<re, im>: swapped indices, imaginary parts negated."""
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), F.struct(F.col("v.re").alias("re"), (-F.col("v.im")).alias("im")).alias("v"))


def diagonal(a: DataFrame) -> DataFrame:
    return a.where("i = j").select("i", "v")


def triangle(a: DataFrame, upper: bool = False, unit: bool = False) -> DataFrame:
    """Lower or upper part; unit: the diagonal entries present become 1."""
    part = a.where("i <= j" if upper else "i >= j")
    return part.withColumn("v", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("v"))) if unit else part


def restrict(a: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    return a.where(F.col("i").between(*rows) & F.col("j").between(*cols))


def permute(a: DataFrame, perm: DataFrame) -> DataFrame:
    """Entries moved from external to internal indices by perm(ext, int) on both sides."""
    p = perm.select(F.col("ext").alias("i"), F.col("int").alias("pi"))
    q = perm.select(F.col("ext").alias("j"), F.col("int").alias("pj"))
    return a.join(p, "i").join(q, "j").select(F.col("pi").alias("i"), F.col("pj").alias("j"), "v")


def to_float(a: DataFrame) -> DataFrame:
    """Through single precision and back."""
    return a.withColumn("v", F.col("v").cast("float").cast("double"))


def to_half(a: DataFrame) -> DataFrame:
    """Through half precision and back: 11 significant bits, steps of 2^-24 below 2^-14, infinite from 65520 on; ties to even."""
    size = F.abs("v")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(size)), F.lit(-14)) - 10)
    kept = F.when(F.col("v") == 0, F.col("v")).when(size >= 65520, F.signum("v") * float("inf")).otherwise(F.rint(F.col("v") / step) * step)
    return a.withColumn("v", kept)


def bad_entries(a: DataFrame) -> DataFrame:
    """Entries that are null, not a number or infinite."""
    return a.where(F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf")))


def _salted(a: DataFrame, b: DataFrame, key: str, salt: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Splits each key of a over `salt` parts, with b copied to each, for keys that hold much of a."""
    if salt <= 1:
        return a, b, [key]
    return a.withColumn("s", F.pmod(F.xxhash64(*a.columns), F.lit(salt))), b.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long")))), [key, "s"]


def matvec(a: DataFrame, x: DataFrame, salt: int = 1) -> DataFrame:
    left, right, keys = _salted(a, x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j", salt)
    return left.join(right, keys).groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def axpy_matvec(alpha: float, a: DataFrame, x: DataFrame, y: DataFrame, transposed: bool = False) -> DataFrame:
    """y + alpha op(A) x."""
    return add(alpha, matvec(transpose(a) if transposed else a, x), 1.0, y, ("i",))


def matmul(a: DataFrame, b: DataFrame, salt: int = 1) -> DataFrame:
    left, right, keys = _salted(a.select("i", F.col("j").alias("k"), "v"), b.select(F.col("i").alias("k"), "j", F.col("v").alias("w")), "k", salt)
    return left.join(right, keys).groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def matmul_diagonal(a: DataFrame, d: DataFrame, b: DataFrame) -> DataFrame:
    return matmul(scale_columns(a, d), b)


def gram(a: DataFrame) -> DataFrame:
    return matmul(transpose(a), a)


def khatri_rao(a: DataFrame, b: DataFrame, rows_b: int) -> DataFrame:
    return a.join(b.select(F.col("i").alias("ib"), "j", F.col("v").alias("w")), "j").select((F.col("i") * rows_b + F.col("ib")).alias("i"), "j", (F.col("v") * F.col("w")).alias("v"))


def compare(a: DataFrame, b: DataFrame, tile: int, eps: float) -> DataFrame:
    """Relative Frobenius difference by tile of A against B; only offenders, and tiles that one side lacks."""
    tiles = [F.floor(F.col(k) / tile).cast("int").alias(f"b{k}") for k in IJ]
    both = a.select("i", "j", F.col("v").alias("x")).join(b.select("i", "j", F.col("v").alias("y")), list(IJ), "full")
    sums = both.groupBy(*tiles).agg(
        F.sum(F.pow(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)), 2)).alias("d"), F.sum(F.pow(F.coalesce("y", F.lit(0.0)), 2)).alias("r"),
        F.count("x").alias("nx"), F.count("y").alias("ny"),
    )
    rel = F.when(F.col("r") > 0, F.sqrt(F.col("d") / F.col("r"))).otherwise(F.sqrt("d"))
    status = F.when((F.col("nx") == 0) | (F.col("ny") == 0), "structure").otherwise("error")
    return sums.select("bi", "bj", rel.alias("error"), status.alias("status")).where((F.col("error") > eps) | (F.col("status") == "structure"))


def norm_frobenius(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def norm_one(a: DataFrame) -> DataFrame:
    return a.groupBy("j").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm"))


def norm_inf(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(F.max("s").alias("norm"))


def extremes(a: DataFrame) -> DataFrame:
    return a.agg(F.max(F.abs("v")).alias("max_abs"), F.min(F.abs("v")).alias("min_abs"))


def dot(x: DataFrame, y: DataFrame, keys: Sequence[str] = ("i",)) -> DataFrame:
    return hadamard(x, y, keys).agg(F.sum("v").alias("dot"))


def stack(a: DataFrame, b: DataFrame, offset: int, index: str) -> DataFrame:
    """b after a along one index, shifted by the size of a there."""
    return a.unionByName(b.withColumn(index, F.col(index) + F.lit(offset)))


def zero_extended(a: DataFrame, rows: int, cols: int) -> DataFrame:
    """A placed after `rows` zero rows and `cols` zero columns."""
    return a.select((F.col("i") + rows).alias("i"), (F.col("j") + cols).alias("j"), "v")


def running_before(counts: DataFrame, key: str, value: str, out: str, parts: int = 64, kind: str = "long") -> DataFrame:
    """Exclusive prefix sum of value by key order, without one task for all rows.

    Keys are ranged into parts; each part sums alone, and a table of at most `parts` sums gives its start.
    """
    lo, hi = counts.agg(F.min(key), F.max(key)).first()
    if lo is None:
        return counts.withColumn(out, F.lit(None).cast(kind))
    part = F.least(F.floor((F.col(key) - lo) * parts / F.lit(hi - lo + 1)), F.lit(parts - 1)).cast("int")
    cut = counts.withColumn("_rb_part", part)
    starts = cut.groupBy("_rb_part").agg(F.sum(value).alias("_rb_sum"))
    before = Window.orderBy("_rb_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_rb_part", F.coalesce(F.sum("_rb_sum").over(before), F.lit(0)).alias("_rb_start"))  # at most `parts` rows
    within = Window.partitionBy("_rb_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(F.broadcast(starts), "_rb_part").withColumn(out, (F.col("_rb_start") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast(kind)).drop("_rb_part", "_rb_start")


def csr_row_ptr(a: DataFrame) -> DataFrame:
    return running_before(a.groupBy("i").agg(F.count("*").alias("n")), "i", "n", "ptr")


def pivot_full(a: DataFrame) -> DataFrame:
    """The largest entry by magnitude; ties go to the smaller row, then column."""
    return a.agg(F.max_by(F.struct("i", "j", "v"), F.struct(F.abs("v"), -F.col("i"), -F.col("j"))).alias("p")).select("p.i", "p.j", "p.v")


def pivot_rows(a: DataFrame) -> DataFrame:
    return a.groupBy("i").agg(F.max_by(F.struct("j", "v"), F.struct(F.abs("v"), -F.col("j"))).alias("p")).select("i", "p.j", "p.v")


def tile_norms(a: DataFrame, tile: int) -> DataFrame:
    return a.groupBy(F.floor(F.col("i") / tile).cast("int").alias("bi"), F.floor(F.col("j") / tile).cast("int").alias("bj")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def off_diagonal_ranking(a: DataFrame, tile: int, top: int) -> DataFrame:
    """The `top` largest off-diagonal tiles; a report, so the limit is its purpose."""
    return tile_norms(a, tile).where("bi <> bj").orderBy(F.desc("norm"), "bi", "bj").limit(top)


def expression_matrix(rows: DataFrame, terms: Sequence[tuple[int, int]], f1: Column, f2: Column) -> DataFrame:
    """Feature entries f1^a f2^b for each row(i) and exponent pair, the pairs being columns 0, 1, ..."""
    table = F.array(*[F.pow(f1, F.lit(a)) * F.pow(f2, F.lit(b)) for a, b in terms])
    return rows.select("i", F.posexplode(table).alias("j", "v")).withColumn("j", F.col("j").cast("long"))
