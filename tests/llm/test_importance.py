"""Importance resampling against a plain version, with windows of several lengths, and its SQL on a small table."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest
from tests_data import prose

from tilewright.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, lengths):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in range(lengths[0], lengths[1] + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, lengths=(1, 1), buckets=10_000, percent=10, least=20):
    """(id, features, weight, score, rank) in order of rows, from (id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    docs = [(d, *grams(x, lengths)) for d, x in rows]
    s, t = Counter(bucket(f) for _, _, fs in docs for f in fs), Counter(bucket(f) for x in target for f in grams(x, lengths)[1])
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for d, words, fs in docs:
        total = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in map(bucket, fs))
        weight = total // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return [(*r, rank.get(id(r))) for r in out]


@pytest.mark.parametrize(("lengths", "percent"), [((1, 1), 10), ((1, 3), 50), ((2, 2), 100), ((1, 1), 0)])
def test_plain(spark, hard, lengths, percent):
    rows = [(r.doc_id, r.text) for r in hard.collect()] + [(1000 + k, prose(15 + k % 20, k) + " ÀÉ_x9'y Ünï\x00z") for k in range(120)]
    target = [prose(40, 3), None, "", "alpha beta", prose(30, 5).upper()]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, rank string, weight int").repartition(5)
    got = importance.resampled(docs, spark.createDataFrame([(x,) for x in target], "text string"), lengths=lengths, percent=percent, least_words=5).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, target, lengths, percent=percent, least=5), key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resampled(none, none).count() == 0
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert [tuple(r)[2:4] for r in importance.resampled(one, none).collect()] == [(30, plain([(1, "word " * 30)], [])[0][3])]


def test_windows_are_slices_of_joined_words():
    cut = importance.Buckets((2, 3), 1 << 20)
    n, got = cut("One, two-three é4 a b")
    want = [zlib.crc32(f.encode()) % (1 << 20) for f in grams("One, two-three é4 a b", (2, 3))[1]]
    assert n == 6 and got.tolist() == want


def test_query_and_sql(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op13_importance_resampling(spark, sf).collect())
    assert got == sorted((d, *rest) for d, _, *rest in plain(docs, target))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(con.execute(queries.oracle_sql()["op13_importance_resampling"]).fetchall()) == got
