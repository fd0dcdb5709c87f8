"""What several training-data operators share: durable intermediate tables, span positions, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, and the controls from tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Up to so many edges, a round of the components job broadcasts its sums by node.
BROADCAST_EDGES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Only A-Z change; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the maximal runs of non-blank characters; null text gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one made here where that is unset and all runs on this machine."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(root)
    return root


def durable(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame | None) -> None:
    """Remove a durable table that nothing reads any more, so that loops do not fill the shared folder."""
    files = table.inputFiles() if table is not None else []
    if files:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sized(small: DataFrame, most: int = 200_000, size: int = 1 << 26) -> DataFrame:
    """For a broadcast only if its rows and the bytes of its strings are counted and few; else a shuffle join, whose hot keys adaptive execution splits."""
    long = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, kind in small.dtypes if kind in ("string", "binary")]
    rows, text = small.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(sum(long, F.lit(0).cast("long"))), F.lit(0))).first()
    return F.broadcast(small) if rows <= most and text <= size else small


def slices(batch: pa.RecordBatch, column: int | str, rows: int = 256, size: int = 1 << 26) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and about so many bytes of a column, so that what a part is turned into stays bounded."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (i - start >= rows or total + n > size):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value as one variable: a Column that is used many times would be computed as often."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def scanned(items: Column, start: Column, step: Callable, emit: Callable, kind: str) -> Column:
    """Array of emit(state, item) of type kind, with the state before each item: start, then step(state, item).

    Appending to an array copies it, so one loop over n items would cost n^2. Blocks of about sqrt(n) items append within
    themselves, and the outer loop appends whole blocks: n^1.5 copies of references at most.
    """
    none, nested = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def block_of(at: Column, block: Column) -> Column:
        return F.aggregate(
            block, F.struct(at.alias("at"), none.alias("out")),
            lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x))).alias("out")),
        )

    def whole(all_items: Column, side: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_items) - 1) / side).cast("int")), lambda b: F.slice(all_items, b * side + 1, side))
        return F.flatten(F.aggregate(
            blocks, F.struct(start.alias("at"), nested.alias("out")),
            lambda acc, block: let(block_of(acc["at"], block), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out"))),
            lambda acc: acc["out"],
        ))

    return let(items, lambda x: F.when(F.size(x) > 0, let(F.ceil(F.sqrt(F.size(x))).cast("int"), lambda side: whole(x, side))).otherwise(none))


def match_spans(text: Column, pattern: str, context: int = 0) -> Column:
    """array<struct<start,end,hit[,left,next]>> of the leftmost non-overlapping matches of a Java pattern; code points, end exclusive.

    The pieces between matches give the positions: match k starts after pieces 0..k and matches 0..k-1. With a context,
    left has up to so many characters of the piece before, and next the first character of the piece after.
    """
    more = ",left:string,next:string" if context else ""
    kind = f"struct<start:int,end:int,hit:string{more}>"
    none = F.expr(f"cast(array() as array<{kind}>)")

    def sides(p: Column) -> list[Column]:
        return [F.right(p["gap"], F.lit(context)).alias("left"), F.substring(F.coalesce(p["after"], F.lit("")), 1, 1).alias("next")] if context else []

    def placed(gaps: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        pairs = F.filter(F.arrays_zip(gaps.alias("gap"), F.slice(gaps, 2, F.size(gaps)).alias("after"), hits.alias("hit")), lambda p: p["hit"].isNotNull())
        sized = F.transform(pairs, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("n"), p["hit"].alias("hit"), *sides(p)))
        return scanned(
            sized, F.lit(0), lambda at, p: at + p["gap"] + p["n"],
            lambda at, p: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["n"]).alias("end"), p["hit"].alias("hit"), *[p[c].alias(c) for c in ("left", "next") if context]), kind,
        )

    return F.when(F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)) > 0, let(F.split(text, pattern, -1), placed)).otherwise(none)


def spans_text(spans: Column) -> Column:
    """'kind:start:end' joined by commas, from array<struct<start,rank,end,kind>>, by start and then rank."""
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _minimum(a: Column, b: Column) -> Column:
    return F.least(a, b)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node that can be reached.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): each round joins a node's neighbours with the
    smallest of them, so no neighbour list is ever gathered in one place. Rounds end when the edges no longer change.
    Edges with a null end are ignored; a loop gives its node alone. Raises RuntimeError if max_rounds did not suffice.
    """
    start = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct()
    start = durable(start, "cc-edges")
    now, seen, last = start.where("a <> b"), None, None
    size = now.count()
    for _ in range(max_rounds):
        held = F.broadcast if size <= BROADCAST_EDGES else (lambda t: t)  # at most twice as many nodes as edges; beyond it, hot nodes are split by adaptive execution
        both = now.union(now.select("b", "a"))  # twice the same edge does no harm within a round
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", _minimum(F.col("a"), F.col("m")).alias("m"))
        large = both.join(held(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(held(least), "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = durable(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "cc-round")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(last)
        last = now
        if mark == seen:
            break
        seen, size = mark, mark[0]
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    nodes = start.select("a").union(start.select("b")).distinct().select(F.col("a").alias("node"))
    found = now.groupBy("a").agg(F.min("b").alias("m"))
    return nodes.join(found, nodes["node"] == found["a"], "left").select("node", F.coalesce("m", "node").alias("component"))
