"""Host-level quality rules: rule failures by host, rates shrunk with an empirical beta prior, verdicts joined back.

DataFrame functions only. Document measures are higher-order functions within the row; the only rows that move are one
partial sum for each host and task, and the hosts' verdicts.

Every host has a shrunk failure rate for each graded rule (repeated words, symbols, repeated lines). Its verdict is how strictly
the rule is held there: the rate over the prior's mean, between 1 / SWAY and SWAY, and one on a host like the corpus. A document goes
if it fails the base rules, or if a measure times the strictness of its host is above the rule's limit. A document that has none of
what a rule measures is kept wherever it comes from.

Null, empty or blank text has no words: all measures are 0 and base_failed is true. A null host is no host: such
documents are judged with a strictness of one. Repeated rows are judged alike, ties do not matter, an empty table gives an empty result,
and columns of the input pass through (inner columns are named `_q_*`; a column with the name of a result is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import BLANKS

WINDOW = 8
#: Graded rules with the measure and its limit for each word.
GRADED = {"repeats": ("n_repeat_words", 0.3), "symbols": ("n_symbols", 0.3), "lines": ("n_dup_lines", 0.2)}
SWAY = 2.0
#: A broadcast of hosts is used up to this many; a shuffle join beyond it.
BROADCAST_HOSTS = 50_000


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.withColumns({
        "_q_words": F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != ""),
        "_q_lines": F.when(body.contains("\n"), lines),
        "word_chars": F.length(F.translate(body, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
    })
    step = step.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "n_dup_lines": F.coalesce(F.size("_q_lines") - F.size(F.array_distinct("_q_lines")), F.lit(0)).cast("long"),
        "_q_windows": F.when(
            F.size("_q_words") > WINDOW,
            F.expr(f"transform(sequence(1, size(_q_words) - {WINDOW - 1}), i -> xxhash64(slice(_q_words, i, {WINDOW})))"),
        ),
    })
    step = step.withColumn("n_repeat_words", F.when(F.size("_q_windows") > F.size(F.array_distinct("_q_windows")), _covered(F.col("_q_windows"))).otherwise(F.lit(0)).cast("long"))
    step = step.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return step.drop("_q_words", "_q_lines", "_q_windows")


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more.

    Sorted by (hash, place), a window repeats if a neighbour has its hash. The places of those, sorted, cover up to
    WINDOW words each, less where the next one starts sooner.
    """
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    prior = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), placed)
    after = F.concat(F.slice(placed, 2, F.greatest(F.size(placed) - 1, F.lit(0))), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    rows = F.arrays_zip(placed.alias("x"), prior.alias("p"), after.alias("n"))
    twice = F.filter(rows, lambda r: r["x"].isNotNull() & (F.coalesce(r["x"]["h"] == r["p"]["h"], F.lit(False)) | F.coalesce(r["x"]["h"] == r["n"]["h"], F.lit(False))))
    places = F.array_sort(F.transform(twice, lambda r: r["x"]["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(
        places,
        start,
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def host_rates(measures: DataFrame, host: str = "source") -> DataFrame:
    """One row for each host: documents, and for `any` rule and each graded one the failures (failed_*), the failure rate shrunk
    towards the corpus (rate_*, of six digits), and the strictness (strict_*, of four).

    The beta prior of a rule is fitted by moments over hosts: with mean m and variance v of the hosts' rates (v less what
    sampling of n documents explains), the prior counts are s = m(1-m)/v - 1, a = m s, b = (1-m) s, s held in [1, 1000].
    """
    fails = {r: F.col(c) > F.lit(limit) * F.col("n_words") for r, (c, limit) in GRADED.items()}
    any_rule = F.col("base_failed")
    for f in fails.values():
        any_rule = any_rule | f
    fails["any"] = any_rule
    hosts = measures.where(F.col(host).isNotNull()).groupBy(host).agg(
        F.count("*").alias("host_docs"), *[F.sum(f.cast("long")).alias(f"failed_{r}") for r, f in fails.items()]
    )
    n = F.col("host_docs")
    fit = hosts.agg(F.avg(1 / n).alias("w"), *[x for r in fails for x in (F.avg(F.col(f"failed_{r}") / n).alias(f"m_{r}"), F.var_pop(F.col(f"failed_{r}") / n).alias(f"v_{r}"))]).first()
    out = hosts
    for r in fails:
        m = fit[f"m_{r}"] or 0.0
        s = min(1000.0, max(1.0, m * (1 - m) / max((fit[f"v_{r}"] or 0.0) - m * (1 - m) * (fit["w"] or 0.0), 1e-9) - 1))
        rate = F.round((F.col(f"failed_{r}") + F.lit(m * s)) / (n + F.lit(s)), 6)
        strict = F.round(F.least(F.greatest(rate / F.lit(m), F.lit(1 / SWAY)), F.lit(SWAY)), 4) if m > 0 else F.lit(1.0)
        out = out.withColumns({f"rate_{r}": rate, f"strict_{r}": strict})
    return out


def judged(measures: DataFrame, rates: DataFrame, host: str = "source") -> DataFrame:
    """measures with host_rate (any rule; null: no host), n_soft (graded rules failed at the host's strictness) and kept."""
    measures = measures.drop("host_rate", "n_soft", "kept")
    hosts = rates.select(F.col(host).alias("_q_host"), F.col("rate_any").alias("host_rate"), *[F.col(f"strict_{r}").alias(f"_q_{r}") for r in GRADED])
    small = hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = measures.join(F.broadcast(hosts) if small else hosts, F.col(host) == F.col("_q_host"), "left")
    soft = sum((F.coalesce(F.col(c) * F.coalesce(f"_q_{r}", F.lit(1.0)) > F.lit(limit) * F.col("n_words"), F.lit(False)).cast("int") for r, (c, limit) in GRADED.items()), F.lit(0))
    return joined.withColumn("n_soft", soft).drop("_q_host", *[f"_q_{r}" for r in GRADED]).withColumn("kept", ~F.col("base_failed") & (F.col("n_soft") == 0))
