"""Documents drawn by how much their words look like a target's: hashed n-grams, log ratios of buckets, Gumbel top-k.

A Split pre-tokeniser of the tokenizers library, given by a regular expression and never trained, cuts the ASCII-lowered
text into words with offsets. Pairs of offsets, of a window's first and last word, give the features; their CRC-32 modulo
the number of buckets counts them. A document is kept as its buckets in order, two bytes a feature, so that texts are read
once. Histograms are summed within tasks, a row for each bucket of a task, and shuffled by bucket. The gains of all buckets
(BUCKETS rows at most) reach the tasks as one array. Scores are whole numbers in a range that the formula bounds, so ranks
need no sort of all documents in one place: counts by score give each score's first rank, and documents of one score are
ranked among themselves.

Null, empty and wordless texts have no features and weight 0. A null id is hashed as the empty string. Ties in score go to
the smaller id (null first), then to any order among equal rows; repeated rows are drawn each. An empty corpus or target
counts as zeros. Columns of the input other than id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tilewright.llm.common import durable, sized, slices

#: Words, the lengths of windows, buckets, the draw and who takes part in it.
WORD, LENGTHS, BUCKETS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (1, 1), 10_000
SEED, PERCENT, LEAST_WORDS = 2024, 10, 20
SCALE = 1000
#: Buckets of so many words are remembered in a task.
REMEMBERED = 1 << 18


class Buckets:
    """The buckets of a text's features, in order of their windows."""

    def __init__(self, lengths: tuple[int, int] = LENGTHS, buckets: int = BUCKETS):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
        self.lengths, self.buckets, self.known = lengths, buckets, {}

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        """(words, buckets of all features)."""
        words = self.split.pre_tokenize_str(text.encode().lower().decode())  # bytes.lower changes A-Z alone
        out = []
        for n in range(self.lengths[0], self.lengths[1] + 1):
            out += self._single(words) if n == 1 else self._windows(words, n)
        return len(words), np.array(out, dtype=np.uint16 if self.buckets <= 1 << 16 else np.uint32)

    def _single(self, words: list[tuple[str, tuple[int, int]]]) -> list[int]:
        known, out = self.known, []
        for w, _ in words:
            b = known.get(w)
            if b is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                b = known[w] = zlib.crc32(w.encode()) % self.buckets
            out.append(b)
        return out

    def _windows(self, words: list[tuple[str, tuple[int, int]]], n: int) -> list[int]:
        """Windows of n words as slices of one buffer, from the first word's start to the last one's end."""
        raw = [w.encode() for w, _ in words]
        buffer = memoryview(b" ".join(raw))
        ends = np.cumsum([len(w) + 1 for w in raw]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(raw) else ends
        return [zlib.crc32(buffer[a:b]) % self.buckets for a, b in zip(starts[: len(raw) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)] if len(raw) >= n else []


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", lengths: tuple[int, int] = LENGTHS, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, buckets): each document's features as little-endian bucket numbers."""
    rows = docs.select(key, text)
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL("n_words long, n_features long, buckets binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Buckets(lengths, buckets)
        for whole in batches:
            for batch in slices(whole, 1, size=1 << 24):
                found = [cut(x or "") for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(b) for _, b in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary()),
                ], names=schema.names)

    return rows.mapInArrow(run, schema)


def _kind(buckets: int) -> np.dtype:
    return np.dtype("<u2" if buckets <= 1 << 16 else "<u4")


def histogram(made: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how often all documents have it; each task sums first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer() or b"", dtype=_kind(buckets)), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return made.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) by bucket, from two histograms of at most `buckets` rows."""
    s, t = [0] * buckets, [0] * buckets
    for counts, table in ((s, source), (t, target)):
        for bucket, n in table.collect():
            counts[bucket] = n
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return np.array([math.floor(SCALE * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], dtype=np.int64)


def weighted(made: DataFrame, gain: np.ndarray, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, weight): the floored mean of the gains over a document's features, 0 without any."""
    rows = made.select(key, "n_words", "n_features", "buckets")
    schema = T.StructType([*rows.drop("buckets").schema.fields, T.StructField("weight", T.LongType())])
    held = rows.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(held.value[np.frombuffer(x.as_buffer() or b"", dtype=_kind(buckets))].sum()) for x in batch.column(3)]
            weights = [total // n if n else 0 for total, n in zip(sums, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def drawn(weights: DataFrame, key: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weights with score and rank: the highest scores of percent of those with enough words are drawn, others have no rank."""
    hashed = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-SCALE * F.log(-F.log((hashed + 0.5) / F.lit(4294967296.0))))
    rows = durable(weights.withColumn("score", (F.col("weight") + noise).cast("long")), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    # scores are whole numbers between about -50,000 and 70,000 for any 64-bit counts: the table by score is bounded
    counts = durable(able.groupBy("score").agg(F.count("*").alias("n")), "scores")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = percent * total // 100
    higher = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_before", F.coalesce(F.sum("n").over(higher), F.lit(0))).where(F.col("_before") < most).select("score", "_before")
    within = Window.partitionBy("score").orderBy(F.col(key).asc_nulls_first())
    in_play = (F.col("n_words") >= least_words) & F.col("_before").isNotNull()
    joined = rows.join(sized(first), "score", "left")
    ranks = joined.where(in_play).withColumn("_rank", F.col("_before") + F.row_number().over(within))
    rest = joined.where(~in_play).withColumn("_rank", F.lit(None).cast("long"))
    return ranks.unionByName(rest).withColumn("rank", F.when(F.col("_rank") <= most, F.col("_rank"))).drop("_rank", "_before").select(*rows.columns, "rank")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", lengths: tuple[int, int] = LENGTHS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document."""
    made = durable(features(docs, key, text, lengths, buckets), "features", compression="zstd")
    wanted = features(target.select(F.lit(0).alias("_"), F.col(target_text).alias("text")), "_", "text", lengths, buckets)
    gain = gains(histogram(made, buckets), histogram(wanted, buckets), buckets)
    return drawn(weighted(made, gain, key, buckets), key, percent, least_words, seed)
