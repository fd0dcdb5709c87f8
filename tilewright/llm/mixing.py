"""Mixing sources to target weights by iterative proportional fitting of token weights, and calibrated sampling.

Tokens are summed by cell (source, language, topic). Raking scales the cells until the sums over each source, language
and topic meet their targets; a document's probability is its cell's weight over the largest weight, so the expected
tokens of the sample have the target shares in all three margins; a wanted number of tokens can be given instead. A document is sampled if a hash of its id and text, as
a number in [0, 1), is below its probability.

Texts are read once, by measured(): tokens, that hash, and a sketch of the words (DIMS counters, a word adds or takes one in the
one its hash names; scaled to whole numbers up to 127). Topics come from the sketches of all documents: less the mean of
their language, on which side of zero they lie along each of the PLANES directions of largest variance. Sums of whole
numbers are exact, so the directions do not depend on the order of rows.

Cells, not documents, are raked: on the driver up to MAX_CELLS of them, beyond that by the same rounds on Spark. Both end
when every margin was within CLOSE_TO of its target, and warn if ROUNDS did not suffice for that. Without
given targets a margin aims at its natural shares raised to TEMPER and scaled to one, which lifts small classes. Targets that
no class of a margin has raise ValueError.

Null source or language counts as the class '' (as the empty string does); null, empty or blank text has one token, so
that it has a weight, and the topic 'none'. Repeated rows share one fate, ties cannot matter, an empty table gives an empty
result, and columns of the input pass through (inner columns are named `_m_*`; existing topic, tokens, weight, probability,
sampled are replaced).
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import durable, forget

MARGINS = ("_m_source", "_m_lang", "_m_topic")
MAX_CELLS = 200_000
TEMPER = 0.7
ROUNDS, CLOSE_TO = 200, 1e-10
SEED = 7
#: Scales tried in one pass over the cells, and passes, when a budget of tokens is given.
TRIES, PASSES = 64, 4
DIMS, PLANES = 64, 3
#: Bytes of text whose words are hashed at once.
BLOCK = 1 << 22
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Odd multipliers of the rolling sums that hash a word.
_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _word_codes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the bytes, and where it starts: running sums of bytes times powers, less those before, rescaled by length."""
    dark = np.concatenate(([False], ~_BLANK[raw], [False]))
    edge = np.flatnonzero(dark[1:] != dark[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))) if starts[0] == 0 else np.concatenate((np.zeros(starts[0], int), np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))))
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int((ends - starts).max()), _BASE))), dtype=np.uint64)
    term = np.where(_BLANK[raw], np.uint64(0), (_FOLD[raw].astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)])
    h = np.add.reduceat(term, starts) * _SPREAD
    return h ^ (h >> np.uint64(29)), starts


def sketches(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, DIMS whole numbers) of each text; all zero where it has no words."""
    tokens, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), DIMS), np.int64)
    group: list[tuple[int, bytes]] = []

    def flush() -> None:
        h, starts = _word_codes(np.frombuffer(b"\n".join(x for _, x in group), np.uint8))
        ends = np.cumsum([len(x) + 1 for _, x in group])
        owner = np.searchsorted(ends, starts, side="right")
        n = np.bincount(owner, minlength=len(group))
        h = h * _SPREAD
        at, sign = (h >> np.uint64(58)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
        sums = np.bincount(owner * DIMS + at, weights=sign, minlength=len(group) * DIMS).reshape(-1, DIMS)
        for k, (row, _) in enumerate(group):
            tokens[row] += n[k]
            out[row] += sums[k].astype(np.int64)
        group.clear()

    size = 0
    for row, text in enumerate(texts):
        data = (text or "").encode()
        at = 0
        while at < len(data) or at == 0:
            end = min(at + BLOCK, len(data))
            while end < len(data) and not _BLANK[data[end]]:
                end += 1
            group.append((row, data[at:end]))
            size += end - at
            at = max(end, 1)
            if size >= BLOCK:
                flush()
                size = 0
    if group:
        flush()
    length = np.sqrt((out.astype(float) ** 2).sum(axis=1, keepdims=True))
    return tokens, np.rint(127 * out / np.where(length > 0, length, 1)).astype(np.int8)


def measured(docs: DataFrame, text: str = "text", source: str = "source", lang: str = "lang", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """docs with tokens, _m_source, _m_lang, _m_unit (the number that the probability meets), _m_sketch (bytes) and _m_blank (no words)."""

    @F.arrow_udf("struct<tokens:bigint,sketch:binary,blank:boolean>")
    def read(texts: pa.Array) -> pa.Array:
        parts = []
        for i in range(0, len(texts), 1024):
            n, x = sketches(texts.slice(i, 1024).to_pylist())
            parts.append(pa.StructArray.from_arrays([pa.array(np.maximum(n, 1)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(n == 0)], names=["tokens", "sketch", "blank"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("tokens", pa.int64()), ("sketch", pa.binary()), ("blank", pa.bool_())]))

    rows = docs.drop("topic", "tokens", "weight", "probability", "sampled").withColumns({
        "_m_source": F.coalesce(F.col(source).cast("string"), F.lit("")), "_m_lang": F.coalesce(F.col(lang).cast("string"), F.lit("")),
        "_m_unit": F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, text), 11) / F.lit(float(1 << 53)), "_m_read": read(F.col(text)),
    })
    return rows.withColumns({"tokens": F.col("_m_read.tokens"), "_m_sketch": F.col("_m_read.sketch"), "_m_blank": F.col("_m_read.blank")}).drop("_m_read")


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, DIMS).astype(np.float64)


def directions(rows: DataFrame, sums: DataFrame) -> np.ndarray:
    """PLANES x DIMS: the leading directions of the sketches about their language's mean; DIMS x DIMS sums reach the driver."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIMS, DIMS))
        for b in batches:
            x = _vectors(b.column(0))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS * DIMS)), pa.array(total.ravel())], names=["at", "v"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIMS, DIMS))
        for b in batches:
            s = np.array(b.column(1).to_pylist(), float).reshape(-1, DIMS)
            total += (s / np.array(b.column(0), float)[:, None]).T @ s
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS * DIMS)), pa.array(total.ravel())], names=["at", "v"])

    def gathered(table: DataFrame, run) -> np.ndarray:
        out = np.zeros(DIMS * DIMS)
        for r in table.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"]
        return out.reshape(DIMS, DIMS)

    values, vectors = np.linalg.eigh(gathered(rows.select("_m_sketch"), products) - gathered(sums.select("n", "s"), means))
    top = vectors[:, ::-1][:, :PLANES].T
    return top * np.sign(top[np.arange(PLANES), np.abs(top).argmax(axis=1)])[:, None]


def with_topics(rows: DataFrame) -> DataFrame:
    """rows of measured() with topic: 'none', or t and the sides of the PLANES directions as a number."""

    def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, inverse = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
            total = np.zeros((len(names), DIMS))
            np.add.at(total, inverse, _vectors(b.column(1)))
            n = np.bincount(inverse, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names.tolist(), pa.string()), pa.array(n), pa.array(list(total), pa.list_(pa.float64()))], names=["_m_lang", "n", "s"])

    parts = rows.select("_m_lang", "_m_sketch").mapInArrow(by_language, "_m_lang string, n long, s array<double>")
    sums = parts.groupBy("_m_lang").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[d]) for d in range(DIMS)]).alias("s"))
    sums = durable(sums, "language-sums")
    planes = directions(rows, sums)
    middle = durable(sums.select("_m_lang", (F.col("s")[0] * 0).alias("_m_zero"), F.array(*[sum((F.col("s")[d] * float(p[d]) for d in range(DIMS)), F.lit(0.0)) / F.col("n") for p in planes]).alias("_m_mid")).drop("_m_zero"), "language-means")

    @F.arrow_udf("array<double>")
    def placed(sketch: pa.Array) -> pa.Array:
        return pa.array(list(_vectors(sketch) @ planes.T), pa.list_(pa.float64()))

    sides = sum((F.when(F.col("_m_at")[k] > F.col("_m_mid")[k], 1 << k).otherwise(0) for k in range(PLANES)), F.lit(0))
    out = rows.withColumn("_m_at", placed("_m_sketch")).join(sized(middle), "_m_lang")
    return out.withColumn("topic", F.when(F.col("_m_blank"), "none").otherwise(F.concat(F.lit("t"), sides.cast("string")))).drop("_m_at", "_m_mid")


def sized(small: DataFrame) -> DataFrame:
    """Broadcast only what is counted and small."""
    return F.broadcast(small) if small.limit(MAX_CELLS + 1).count() <= MAX_CELLS else small


def targets(sums: dict, given: dict | None) -> dict:
    """Share by class of a margin: given ones for classes that occur, else tempered natural ones; scaled to one."""
    raw = {k: float((given or {}).get(k, 0.0)) for k in sums} if given else {k: float(v) ** TEMPER for k, v in sums.items()}
    return {k: v / _above_zero(sum(raw.values())) for k, v in raw.items()}


def _above_zero(whole: float | None) -> float:
    if not whole or whole <= 0:
        raise ValueError("no class of this margin has a target above zero")
    return whole


def rake(keys: list[tuple], tokens: np.ndarray, goals: list[dict]) -> np.ndarray:
    """Weight of each cell such that weight * tokens has the goal shares in every margin (total 1)."""
    x = tokens / tokens.sum()
    codes, aims = [], []
    for m, goal in enumerate(goals):
        names = {k: i for i, k in enumerate(sorted(goal))}
        codes.append(np.array([names[k[m]] for k in keys]))
        aims.append(np.array([goal[k] for k in sorted(goal)]))
    for _ in range(ROUNDS):
        off = 0.0
        for code, aim in zip(codes, aims, strict=True):
            now = np.bincount(code, weights=x, minlength=len(aim))
            factor = np.divide(aim, now, out=np.zeros_like(aim), where=now > 0)
            off = max(off, float(np.abs(now - aim).max()))
            x = x * factor[code]
        if off < CLOSE_TO:
            break
    else:
        _warn(off)
    return x * tokens.sum() / tokens


def _warn(off: float) -> None:
    warnings.warn(f"margins are off their targets by up to {off:.1e} after {ROUNDS} rounds; are the targets at odds with the cells?", RuntimeWarning, stacklevel=3)


def rake_on_spark(cells: DataFrame, goals: list[DataFrame]) -> DataFrame:
    """As rake, for cells(margins, tokens) too many for the driver; goals are (margin, goal) tables."""
    total = cells.agg(F.sum("tokens")).first()[0]
    x, last = cells.withColumn("x", F.col("tokens") / F.lit(total)), None
    for _ in range(ROUNDS):
        x = x.withColumn("off", F.lit(0.0))
        for m, goal in zip(MARGINS, goals, strict=True):
            now = x.groupBy(m).agg(F.sum("x").alias("now")).join(goal, m)
            now = now.select(m, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("f"), F.abs(F.col("now") - F.col("goal")).alias("d"))
            x = x.join(now, m).withColumns({"x": F.col("x") * F.col("f"), "off": F.greatest("off", "d")}).drop("f", "d")
        x = durable(x, "rake")
        forget(last)
        last = x
        off = x.agg(F.max("off")).first()[0]
        if off < CLOSE_TO:
            break
    else:
        _warn(off)
    return x.withColumn("weight", F.col("x") * F.lit(total) / F.col("tokens")).drop("x", "off")


def cell_weights(rows: DataFrame, given: dict[str, dict] | None = None, max_cells: int = MAX_CELLS) -> DataFrame:
    """(margins, weight) of each cell of rows(margins, tokens)."""
    spark, given = rows.sparkSession, given or {}
    cells = durable(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    schema = "_m_source string, _m_lang string, _m_topic string, weight double"
    if cells.count() <= max_cells:
        found = sorted(tuple(r) for r in cells.collect())
        if not found:
            return spark.createDataFrame([], schema)
        keys, tokens = [r[:3] for r in found], np.array([float(r[3]) for r in found])
        goals = []
        for i, m in enumerate(MARGINS):
            sums: dict = {}
            for k, n in zip(keys, tokens, strict=True):
                sums[k[i]] = sums.get(k[i], 0.0) + n
            goals.append(targets(sums, given.get(m[3:])))
        weights = rake(keys, tokens, goals)
        return spark.createDataFrame([(*k, float(w)) for k, w in zip(keys, weights, strict=True)], schema)
    goals = []
    for m in MARGINS:
        sums = cells.groupBy(m).agg(F.sum("tokens").alias("n"))
        chosen = given.get(m[3:])
        raw = F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for kv in chosen.items() for y in (kv[0], float(kv[1]))]), F.col(m)), F.lit(0.0)) if chosen else F.pow("n", F.lit(TEMPER))
        sums = sums.withColumn("raw", raw)
        whole = _above_zero(sums.agg(F.sum("raw")).first()[0])
        goals.append(durable(sums.select(m, (F.col("raw") / F.lit(whole)).alias("goal")), "goals"))
    return rake_on_spark(cells, goals).select(*MARGINS, "weight")


def scale_for(cells: DataFrame, budget: float) -> float:
    """c such that the sum of min(1, c weight) tokens over cells(weight, tokens) is the budget, or all that can be had.

    Each pass over the cells tries TRIES scales at once and keeps the interval that holds the answer.
    """
    some = cells.where("weight > 0 and tokens > 0")
    low, high, all_tokens = some.agg(F.sum(F.col("weight") * F.col("tokens")), F.min("weight"), F.sum("tokens")).first()
    if not all_tokens or budget <= 0:
        return 0.0
    low, high = budget / low, 1 / high
    if budget >= all_tokens or low >= high:
        return high
    for _ in range(PASSES):
        tries = np.geomspace(low, high, TRIES)
        got = some.agg(*[F.sum(F.least(F.col("weight") * F.lit(float(c)), F.lit(1.0)) * F.col("tokens")) for c in tries]).first()
        k = int(np.clip(np.searchsorted(np.array(got), budget), 1, TRIES - 1))
        low, high = float(tries[k - 1]), float(tries[k])
    return high


def mixed(rows: DataFrame, given: dict[str, dict] | None = None, budget: float | None = None) -> DataFrame:
    """rows of measured() with topic, tokens, weight, probability and sampled; texts are not looked at, so rows should be durable.

    Without a budget the largest weight has probability 1, and the margins meet their targets. With one, probabilities are min(1, c weight),
    where c makes the expected tokens of the sample meet it; cells at probability 1 then fall short of their targets.
    """
    named = with_topics(rows).withColumn("_m_topic", F.col("topic"))
    weights = durable(cell_weights(named, given), "weights")
    if budget is None:
        scale = 1 / (weights.agg(F.max("weight")).first()[0] or 1.0)
    else:
        scale = scale_for(durable(named.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")).join(sized(weights), list(MARGINS)).select("weight", "tokens"), "budget"), budget)
    out = named.join(sized(weights), list(MARGINS), "left").withColumn("probability", F.least(F.col("weight") * F.lit(scale), F.lit(1.0)))
    return out.withColumn("sampled", F.col("_m_unit") < F.col("probability")).drop(*MARGINS, "_m_unit", "_m_sketch", "_m_blank")
