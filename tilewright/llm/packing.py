"""Sequence packing by non-negative least squares over shallow length combinations.

Documents become token ids and a closing id, cut at the window. The histogram of piece lengths (at most `window`
numbers) is all that the driver sees: it enumerates combinations of few lengths that fill a window, solves their repeat
counts by non-negative least squares against the histogram, rounds down, and packs the rest greedily, largest first. Each
piece finds its sequence from its length and its rank among pieces of that length: ranks are counted within the tasks
that cut the pieces and shifted by the counts of the tasks before.

Null text is empty text: one piece with the closing id. Repeated rows are packed each, ties among equal lengths go by
task and place in a durable table, an empty table gives no pieces, and only the id and text columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tilewright.llm.common import durable, slices

#: The window of a sequence and the closing id of a document.
WINDOW, CLOSE = 1024, 0
BROADCAST_COUNTS = 200_000
FIELDS = "start long, length long, doc_tokens long, ids binary, _k_task int, _k_rank long"


def byte_names() -> dict[str, int]:
    """The characters under which byte-level vocabularies list bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Fixed value: the split pattern that belongs to this public vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranked_bytes(spec: dict, special: dict) -> bool:
    """Whether a file says what the fast encoder assumes: bytes as listed, split by the pattern of byte-level files, merges in the order of ids."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model.get("vocab", {})
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
    if model.get("type", "BPE") != "BPE" or not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return False
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    first = sorted((t for t in vocab if t not in special), key=vocab.get)[: len(vocab) - len(merged) - sum(t in special for t in vocab)]
    return set(first) == set(byte_names()) and [vocab[t] for t in merged] == list(range(len(first), len(first) + len(merged)))


@lru_cache(maxsize=2)
def encoder(path: str):
    """texts -> list of uint32 arrays, as the tokenizers library gives from the file at path.

    A byte-level vocabulary with its merges in rank order can be encoded by a byte-pair encoder over the same ranks, which gives the
    same ids several times faster; what that one refuses, and any file of another kind, goes to the tokenizers library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    whole = Tokenizer.from_file(path)
    by_library = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if not _ranked_bytes(spec, special):
        return by_library
    names = byte_names()
    ranks = {bytes(names[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("pack", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as e:  # the encoder's panics derive from BaseException
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return by_library(text)

    return encode


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, start, length, doc_tokens, ids, task, rank in the task among this length) as a durable table."""
    rows = docs.select(key, text)
    schema = T.StructType([rows.schema[key], *T.StructType.fromDDL(FIELDS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, dtype=np.int64)
        for whole in batches:
            for batch in slices(whole, 1, 512):
                take, out = [], {n: [] for n in ("start", "length", "doc_tokens", "ids", "_k_rank")}
                for row, x in enumerate(batch.column(1).to_pylist()):
                    ids = np.append(encode(x or ""), np.uint32(CLOSE)).astype("<u4")
                    raw = memoryview(ids.tobytes())
                    for start in range(0, len(ids), window):
                        n = min(window, len(ids) - start)
                        take.append(row)
                        out["start"].append(start)
                        out["length"].append(n)
                        out["doc_tokens"].append(len(ids))
                        out["ids"].append(bytes(raw[4 * start : 4 * (start + n)]))
                        out["_k_rank"].append(int(seen[n]))
                        seen[n] += 1
                size = len(take)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(take, pa.int64())), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["doc_tokens"], pa.int64()),
                    pa.array(out["ids"], pa.binary()), pa.array([task] * size, pa.int32()), pa.array(out["_k_rank"], pa.int64()),
                ], names=[key, "start", "length", "doc_tokens", "ids", "_k_task", "_k_rank"])

    return durable(rows.mapInArrow(run, schema), "pieces", compression="zstd")


def combinations(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[int, ...]]:
    """Sorted length tuples of up to four pieces that fill the window, from lengths that occur.

    All single lengths and pairs; of three, those with two equal lengths or one on a grid of window/16; of four, those with three
    equal lengths. At most about 8 x window of them.
    """
    have = [n for n in range(1, window + 1) if histogram[n]]
    there, out = set(have), set()
    grid = [n for n in range(window // 16, window, window // 16) if n in there]
    for a in have:
        tries = [(a,), (a, window - a), (a, a, window - 2 * a), (a, a, a, window - 3 * a), *((a, g, window - a - g) for g in grid)]
        out.update(tuple(sorted(t)) for t in tries if sum(t) == window and all(x in there for x in t))
    return sorted(out)


def repeats_nnls(combos: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|, A having each combination's length counts: cyclic coordinate descent."""
    rest, x = histogram.astype(float).copy(), np.zeros(len(combos))
    parts = [np.unique(c, return_counts=True) for c in combos]
    norms = [float((m * m).sum()) for _, m in parts]
    for _ in range(sweeps):
        most = 0.0
        for j, (n, m) in enumerate(parts):
            new = max(0.0, x[j] + float(rest[n] @ m) / norms[j])
            if (d := new - x[j]) != 0.0:
                rest[n] -= d * m
                x[j] = new
                most = max(most, abs(d))
        if most < 0.25:
            break
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), using up the histogram exactly."""
    left, out = histogram.astype(np.int64).copy(), []
    combos = combinations(left, window)
    x = repeats_nnls(combos, left)
    for j in np.argsort(-x, kind="stable"):
        n, m = np.unique(combos[j], return_counts=True)
        k = int(min(np.floor(x[j] + 1e-9), (left[n] // m).min()))
        if k > 0:
            left[n] -= k * m
            out.append((combos[j], k))
    while (at := np.flatnonzero(left)).size:  # each turn uses up at least one length
        have, free, chosen = left.copy(), window, []
        for n in at[::-1]:
            k = int(min(have[n], free // n))
            chosen += [int(n)] * k
            free -= k * int(n)
        n, m = np.unique(chosen, return_counts=True)
        k = int((left[n] // m).min())
        left[n] -= k * m
        out.append((tuple(chosen), k))
    return out


def places(made: list[tuple[tuple[int, ...], int]], window: int = WINDOW) -> dict[str, np.ndarray]:
    """The plan as intervals of (length, rank): first rank, first sequence and offset, sorted by length and rank."""
    at, base, rows = np.zeros(window + 1, dtype=np.int64), 0, []
    for lengths, k in made:
        offset = 0
        for n in lengths:
            rows.append((n, at[n], base, offset))
            at[n] += k
            offset += n
        base += k
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), a.T, strict=True))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, start, length, doc_tokens, ids, sequence_id, offset): each piece with its token ids (little-endian uint32) and its place."""
    spark, cut = docs.sparkSession, pieces(docs, tokenizer, key, text, window)
    counts = cut.groupBy("_k_task", "length").count()
    before = Window.partitionBy("length").orderBy("_k_task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = durable(counts.select("_k_task", "length", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_k_shift")), "shifts")
    histogram = np.zeros(window + 1, dtype=np.int64)
    for n, c in shifts.groupBy("length").agg(F.sum("count")).collect():  # window rows at most
        histogram[n] = c
    found = spark.sparkContext.broadcast(places(plan(histogram, window), window))  # bounded by the number of combinations
    small = shifts.limit(BROADCAST_COUNTS + 1).count() <= BROADCAST_COUNTS
    shifts = shifts.drop("count")
    ranked = cut.join(F.broadcast(shifts) if small else shifts, ["_k_task", "length"])
    ranked = ranked.select(key, "start", "length", "doc_tokens", "ids", (F.col("_k_rank") + F.col("_k_shift")).alias("_k_rank"))
    schema = T.StructType([*ranked.drop("_k_rank").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, wide = found.value, 1 << 50
        starts = p["length"] * wide + p["rank"]
        for b in batches:
            n, r = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 5))
            i = np.searchsorted(starts, n * wide + r, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(p["sequence"][i] + r - p["rank"][i]), pa.array(p["offset"][i])], names=schema.names)

    return ranked.mapInArrow(place, schema)
