"""Reading and writing entries, blocks, tensors and logs; durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir; made here where it is unset and all runs on this machine)."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows may hold arrays of MB: the writer looks at its size after each (after 100 otherwise), and a row group, which readers hold at once, is small.
#: Numbers of blocks and factors do not repeat: a dictionary of them would be built and thrown away for each row group.
ROW_GROUPS = {"parquet.page.size.row.check.min": 1, "parquet.block.size": 32 << 20} | {f"parquet.enable.dictionary#{c}.list.element": "false" for c in "duvfx"}


def durable(df: DataFrame, name: str = "step", under: str = "") -> DataFrame:
    """df written and read back: iterations start from it, without its lineage. under: a folder of whole() that it is to be a part of."""
    path = f"{under}/{name}-{uuid.uuid4().hex}" if under else shared_path(df.sparkSession, name)
    df.write.options(**ROW_GROUPS).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.is_durable = True
    return out


def held(df: DataFrame, name: str = "step") -> tuple[DataFrame, bool]:
    """(df as a durable table, whether it was written here): a table that is one already is not written again, and is not ours to remove."""
    return (df, False) if getattr(df, "is_durable", False) else (durable(df, name), True)


def whole(like: DataFrame, under: str) -> DataFrame:
    """All durable tables under a folder as one, which no one has to write again."""
    return like.sparkSession.read.schema(like.schema).option("recursiveFileLookup", "true").parquet(under)


def forget(table: DataFrame | None) -> None:
    """Remove a durable table that nothing reads any more, so that loops do not fill the shared folder."""
    files = table.inputFiles() if table is not None else []
    if files:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """coo from 1-based 'row,col,value' lines after a header line and a line with the number of rows.

    The header is the first line of a file that is not blank, and the count the second; both are told by their place alone. A file whose second
    line is no whole number, or whose header is a line of data, is an error, as is any later line that is not three numbers, raised by
    the task that meets it. Blank lines are skipped.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("at"))
    kept = lines.where(F.trim("value") != "")
    first = kept.groupBy("file").agg(F.min(F.struct("at", "value")).alias("head"))
    second = kept.join(F.broadcast(first), "file").where(F.col("at") > F.col("head.at")).groupBy("file", "head").agg(F.min(F.struct("at", "value")).alias("count"))  # a row for each file
    number = r"\s*[-+]?[0-9.]+([eE][-+]?[0-9]+)?\s*"
    bad = F.col("head.value").rlike(f"^({number},){{2}}{number}$") | ~F.col("count.value").rlike(r"^\s*[0-9]+\s*$")
    start = F.when(bad, F.raise_error(F.concat(F.lit("no header line and count at the start of "), F.col("file"))).cast("struct<block:bigint,at:bigint>")).otherwise(F.col("count.at"))
    data = kept.join(F.broadcast(second.select("file", start.alias("start"))), "file").where(F.col("at") > F.col("start"))
    fields = F.split("value", ",")
    checked = F.when(F.size(fields) == 3, fields).otherwise(F.raise_error(F.concat(F.lit("not three fields: "), F.col("value"))).cast("array<string>"))
    f = data.select(checked.alias("f"))
    return f.select((F.trim(F.col("f")[0]).cast("long") - 1).alias("i"), (F.trim(F.col("f")[1]).cast("long") - 1).alias("j"), F.trim(F.col("f")[2]).cast("double").alias("v"))


def write_triplets(a: DataFrame, path: str) -> None:
    """coo as 'row,col,value' lines; each file starts with a header and the number of rows of the matrix."""
    rows = (a.agg(F.max("i")).first()[0] or 0) + 1

    def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for t in batches:
            if first and len(t):
                yield pd.DataFrame({"value": ["row,col,value", str(rows)]})
                first = False
            yield t

    a.select(F.concat_ws(",", F.col("i") + 1, F.col("j") + 1, F.col("v")).alias("value")).mapInPandas(headed, "value string").write.text(path)


def round_trip(a: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table as Parquet, partitioned if asked, and read it again."""
    path = shared_path(a.sparkSession, name)
    (a.write.partitionBy(by) if by else a.write).parquet(path)
    return a.sparkSession.read.schema(a.schema).parquet(path)


def raw_bytes(values: np.ndarray) -> bytes:
    return np.asarray(values, "<f8").ravel(order="F").tobytes()


def read_raw_tensor(files: DataFrame, n0: int, n1: int, content: str = "content") -> DataFrame:
    """ten3 from files(first, content): flat column-major float64 slabs whose last index starts at `first`; the length must fit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, raw in zip(b["first"], b[content], strict=True):
                x = np.frombuffer(raw, "<f8")
                if x.size % (n0 * n1):
                    raise ValueError(f"{x.size} values do not fill slabs of {n0} x {n1}")
                k = np.arange(x.size)
                yield pd.DataFrame({"i0": k % n0, "i1": k // n0 % n1, "i2": first + k // (n0 * n1), "v": x})

    return files.select("first", content).mapInPandas(run, "i0 int, i1 int, i2 int, v double")


def raw_slabs(t: DataFrame, n0: int, n1: int) -> DataFrame:
    """(first, content): a flat column-major float64 slab for each last index of ten3."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((n0, n1))
        x[pdf["i0"].to_numpy(), pdf["i1"].to_numpy()] = pdf["v"].to_numpy()
        return pd.DataFrame({"first": [int(pdf["i2"].iloc[0])], "content": [raw_bytes(x)]})

    return t.groupBy("i2").applyInPandas(run, "first int, content binary")


def read_raw_files(spark: SparkSession, path: str, n0: int, n1: int, n2: int) -> DataFrame:
    """ten3 of flat column-major little-endian float64 files, whole tensors of the given shape; the length must match.

    A file is one row of Spark's reader, so it has at most 2 GB; larger tensors come as slabs (read_raw_tensor).
    """
    files = spark.read.format("binaryFile").load(path)
    fits = F.col("length") == 8 * n0 * n1 * n2
    checked = F.when(fits, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("wrong length: "), F.col("path"))).cast("binary"))
    return read_raw_tensor(files.select(F.lit(0).alias("first"), checked.alias("content")), n0, n1)


def read_bench_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each log under path: names from 'app--program--framework--blas.log', and the last value of each line kind.

    A time line may give one time or 'a s / b s / c s', of which the first counts; GB are 1000 MB.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.regexp_extract(F.col("_metadata.file_path"), r"file=([^/]+)", 1).alias("file"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("at"))
    number = r"([0-9.]+(?:e[+-]?[0-9]+)?)"
    found = lines.select(
        "file", "at", F.regexp_extract("value", r"^processor : (.*)$", 1).alias("processor"), F.regexp_extract("value", rf"(?:\bin|runtime =) {number} s", 1).alias("time"),
        F.regexp_extract("value", rf"mem = {number} (?:MB|GB)", 1).alias("mem"), F.regexp_extract("value", r"mem = \S+ (MB|GB)", 1).alias("unit"), F.regexp_extract("value", rf"error = {number}", 1).alias("error"),
    )

    def last(c: str):
        return F.max_by(c, F.when(F.col(c) != "", F.col("at")))

    names = F.split(F.regexp_replace("file", r"\.log$", ""), "--")
    rows = found.groupBy("file").agg(*[last(c).alias(c) for c in ("processor", "time", "mem", "unit", "error")])
    return rows.select(
        *[names[k].alias(n) for k, n in enumerate(("app", "program", "framework", "blas"))], "processor", F.col("time").cast("double").alias("time"),
        (F.col("mem").cast("double") * F.when(F.col("unit") == "GB", 1000).otherwise(1)).cast("long").alias("mem"), F.col("error").cast("double").alias("error"),
    )
