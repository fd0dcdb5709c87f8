"""Points, matrices, vectors and tensors derived from the given tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """points(id, x array<double>): the first three coordinates of each embedding."""
    e = table(spark, d, "embeddings").where(F.size("embedding") >= 3)
    return e.select(F.col("vec_id").cast("long").alias("id"), F.slice("embedding", 1, 3).cast("array<double>").alias("x"))


POINTS = "SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"


def matrix_a(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


A = "SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2"


def matrix_b(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("i"), (F.month("l_shipdate") - 1).cast("long").alias("j")).agg(F.sum("l_extendedprice").alias("v"))


B = "SELECT l_partkey AS i, CAST(month(l_shipdate) - 1 AS BIGINT) AS j, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2"


def features(spark: SparkSession, d: str) -> DataFrame:
    """The dense matrix of embeddings: a row for each vector, 64 columns."""
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("i"), F.posexplode("embedding").alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


DENSE = "SELECT CAST(vec_id AS BIGINT) AS i, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))


SUPP = "SELECT s_suppkey AS i, s_acctbal AS v FROM supplier"


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v"))


PART = "SELECT p_partkey AS i, p_retailprice AS v FROM part"


def tensor3(spark: SparkSession, d: str) -> DataFrame:
    """ten3(i0, i1, i2, v): revenue by supplier mod 8, part mod 8 and month, summed over all lines."""
    return table(spark, d, "lineitem").groupBy(
        F.pmod("l_suppkey", F.lit(8)).cast("int").alias("i0"), F.pmod("l_partkey", F.lit(8)).cast("int").alias("i1"), (F.month("l_shipdate") - 1).alias("i2")
    ).agg(F.sum("l_extendedprice").alias("v"))


T3 = "SELECT CAST(l_suppkey % 8 AS INTEGER) AS i0, CAST(l_partkey % 8 AS INTEGER) AS i1, CAST(month(l_shipdate) - 1 AS INTEGER) AS i2, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3"


def tensor4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(
        F.pmod("l_suppkey", F.lit(8)).cast("int").alias("i0"), F.pmod("l_partkey", F.lit(8)).cast("int").alias("i1"), (F.month("l_shipdate") - 1).alias("i2"), F.pmod("l_linenumber", F.lit(4)).alias("i3")
    ).agg(F.sum("l_extendedprice").alias("v"))


T4 = "SELECT CAST(l_suppkey % 8 AS INTEGER) AS i0, CAST(l_partkey % 8 AS INTEGER) AS i1, CAST(month(l_shipdate) - 1 AS INTEGER) AS i2, CAST(l_linenumber % 4 AS INTEGER) AS i3, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2, 3, 4"


def rounded(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    """Named columns (v by default) rounded, without negative zeros."""
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names or ("v",)})
