"""Incremental blob ledger for secret scans: every version of a text is one blob, scanned once for each rule version.

DataFrame functions only. A blob is named by the SHA-256 of its UTF-8 text. The ledger holds one row for each blob and
rule version that was scanned, with what was found; a run scans only pairs that the ledger lacks and joins findings back
to every path (here: document) that holds the blob.

Null text is the empty text. Repeated rows and copies share one scan; every row gets its findings. Ties cannot occur
(spans of a kind never overlap). An empty table gives an empty ledger and result. Only the columns named by `text` and
`path` are read; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import durable, match_spans, sized, spans_text

#: The base kinds in the order of the contract, then those that this scanner adds.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
RULES = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{14,}+",
    "hex": r"[0-9a-f]{16,}+",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "webhook": r"(?<![A-Za-z0-9])(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk_live|rk_live)[_-][A-Za-z0-9_-]{16,}+",
    "userinfo": r"[a-z][a-z0-9+]{1,12}://[A-Za-z0-9._-]{1,64}:[^\s/@:]{3,128}@[A-Za-z0-9]",
}
RULE_VERSION = 1
#: A text without any of these holds no match of its kind: a plain search spares the pattern.
HINTS = {"access": "AKIA", "pem": "-----BEGIN ", "jwt": "eyJ", "userinfo": "://"}
LEDGER = "blob string, rule_version int, n_assign long, n_access long, n_hex long, base string, spans string"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _found(text: Column, kind: str, rank: int) -> Column:
    """array<struct<start,rank,end,kind>> of one kind."""
    spans = match_spans(text, RULES[kind])
    if kind == "assign":  # only the value's length decides, and a failing match is dropped, not tried again
        spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["hit"], r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", 1)) >= 12)
    shaped = F.transform(spans, lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), s["end"], F.lit(kind).alias("kind")))
    if kind in HINTS:
        shaped = F.when(text.contains(HINTS[kind]), shaped)
    return F.coalesce(shaped, F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string>>)"))


def scanned(blobs: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
    """Ledger rows for blobs(blob, text)."""
    text = F.col("text")
    step = blobs.select("blob", *[_found(text, k, i).alias(k) for i, k in enumerate(RULES)])
    base = F.concat(*[F.col(k) for k in BASE_KINDS])
    every = F.concat(*[F.col(k) for k in RULES])
    return step.select(
        "blob", F.lit(rule_version).alias("rule_version"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        spans_text(base).alias("base"), spans_text(every).alias("spans"),
    )


def unseen(docs: DataFrame, ledger: DataFrame | None, rule_version: int = RULE_VERSION, text: str = "text") -> DataFrame:
    """(blob, text) once for each blob of docs that the ledger has not scanned with these rules.

    Names alone meet the ledger; only texts of new blobs move, one for each blob and task.
    """
    named = docs.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob")
        new = durable(named.select("blob").distinct().join(seen, "blob", "left_anti"), "unseen")
        named = named.join(sized(new), "blob", "left_semi")
    return named.dropDuplicates(["blob"])


def kept_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at a path, None if there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.schema(LEDGER).parquet(path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def scan_incrementally(docs: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION, text: str = "text") -> DataFrame:
    """The new ledger of one session: the old rows and one for each unseen blob, as a durable table. For many increments see scan_into."""
    new = durable(scanned(unseen(docs, ledger, rule_version, text), rule_version), "ledger")
    return new if ledger is None else ledger.select(new.columns).unionByName(new)


def scan_into(docs: DataFrame, path: str, rule_version: int = RULE_VERSION, text: str = "text") -> DataFrame:
    """The ledger at `path`, to which a row for each unseen blob is added first.

    One Parquet table with a folder for each rule version, so plans stay as they are however many increments there were. Rows of a
    run that fails are not committed; the next run finds their blobs unseen and scans them again.
    """
    new = scanned(unseen(docs, kept_ledger(docs.sparkSession, path), rule_version, text), rule_version)
    new.write.mode("append").partitionBy("rule_version").parquet(path)
    return kept_ledger(docs.sparkSession, path)


def findings(docs: DataFrame, ledger: DataFrame, rule_version: int = RULE_VERSION, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs as (path, blob) with its blob's findings; blobs without any are not joined."""
    hits = ledger.where((F.col("rule_version") == rule_version) & (F.col("spans") != "")).drop("rule_version")
    named = docs.select(F.col(path), blob_id(F.col(text)).alias("blob"))
    out = named.join(sized(hits), "blob", "left")
    return out.select(path, "blob", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE_KINDS], F.coalesce("base", F.lit("")).alias("base"), F.coalesce("spans", F.lit("")).alias("spans"))
