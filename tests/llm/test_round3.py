"""The ledger as a table, added kinds of secrets, budgets of tokens, wordless texts, and columns that redaction must keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import common, mixing, pii, secrets


def test_ledger_table(spark, hard, tmp_path):
    path = str(tmp_path / "ledger")
    assert secrets.kept_ledger(spark, path) is None
    more = hard.union(hard.withColumn("text", F.concat("text", F.lit(" v2"))))
    for part in [more.where(F.pmod("doc_id", F.lit(2)) == k) for k in (0, 1)] + [more.where("doc_id is null"), more, more.limit(0)]:
        kept = secrets.scan_into(part, path)
    once = secrets.scan_incrementally(more)
    names = once.columns
    assert sorted(map(str, kept.select(names).collect())) == sorted(map(str, once.collect()))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1  # one table, however many increments
    again = secrets.scan_into(hard, path, rule_version=2)
    assert again.where("rule_version = 2").count() == hard.select("text").na.fill("").distinct().count() and again.where("rule_version = 1").count() == once.count()


KINDS = [
    ("a -----BEGIN RSA PRIVATE KEY----- b", "pem", (2, 33)), ("a -----BEGIN PUBLIC KEY----- b", "pem", None),
    ("x eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK y", "jwt", (2, 40)), ("x eyJhbGciOiJI.abcdefghijk.SflKxwRJSMeK", "jwt", None),
    ("é ghp_abcdefghij0123456789 z", "webhook", (2, 26)), ("xghp_abcdefghij0123456789", "webhook", None), ("ghp_short", "webhook", None),
    ("see https://user:pass1@host now", "userinfo", (4, 24)), ("see https://host:8080/a@b", "userinfo", None),
]


def test_added_kinds(spark):
    docs = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(KINDS)], "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in secrets.findings(docs, secrets.scan_incrementally(docs)).collect()}
    for i, (_, kind, span) in enumerate(KINDS):
        assert [s for s in got[i] if s.startswith(kind + ":")] == ([f"{kind}:{span[0]}:{span[1]}"] if span else [])


def test_broadcasts_are_bounded_in_bytes(spark):
    rows = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("s"))
    shown = lambda t: "strategy=broadcast" in t._jdf.queryExecution().analyzed().toString()
    assert shown(common.sized(rows)) and not shown(common.sized(rows, size=50_000)) and not shown(common.sized(rows, most=99))


def test_budget_of_tokens(spark):
    rng = np.random.default_rng(1)
    cells = [(float(w), int(t)) for w, t in zip(rng.lognormal(size=300), rng.integers(1, 10_000, 300), strict=True)] + [(0.0, 50), (1e-9, 10)]
    table = spark.createDataFrame(cells, "weight double, tokens long")
    total = sum(t for w, t in cells if w > 0)
    for budget in (1, 1000, total // 3, total - 5000):
        c = mixing.scale_for(table, budget)
        assert sum(min(1, c * w) * t for w, t in cells) == pytest.approx(budget, rel=1e-4)
    assert mixing.scale_for(table, 2 * total) == pytest.approx(1e9) and mixing.scale_for(table, 0) == 0 and mixing.scale_for(table.limit(0), 10) == 0
    docs = spark.createDataFrame([(k, f"word{k % 50} " * (1 + k % 9), "en" if k % 3 else "de", f"s{k % 5}", 0) for k in range(3000)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = common.durable(mixing.measured(docs), "measured")
    for budget in (2000, 9000):
        out = mixing.mixed(rows, budget=budget)
        assert out.agg(F.sum(F.col("probability") * F.col("tokens"))).first()[0] == pytest.approx(budget, rel=1e-3)
        assert 0.7 * budget < out.where("sampled").agg(F.sum("tokens")).first()[0] < 1.3 * budget


def test_topic_none_is_for_texts_without_words(spark):
    """Two words whose counters cancel are words all the same."""
    rows = [(k, f"w{k} v{k}") for k in range(3000)] + [(5000, None), (5001, ""), (5002, " \n\t")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    none = {r.doc_id for r in mixing.with_topics(common.durable(mixing.measured(docs), "measured")).where("topic = 'none'").collect()}
    assert none == {5000, 5001, 5002}
    assert sum(not s.any() for s in mixing.sketches([r[1] for r in rows[:3000]])[1]) > 0


def test_redaction_keeps_columns_named_as_results(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc now", "kept", 7, "r", [1]), (2, None, None, None, None, None)], "doc_id long, text string, base string, n_email long, _r_text string, pii_spans array<int>")
    out = pii.redacted(docs)
    assert out.columns == docs.columns
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "mail [EMAIL] now", "kept", 7, "r", [1]), (2, None, None, None, None, None)]


def plain_links(docs, percent):
    from test_operators import shingles

    sets = [(d, shingles(x)) for d, x in docs]
    return {(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i] if s and t and 100 * len(s & t) >= percent * len(s | t)}


def template(n, seed=3, changed=6):
    from tests_data import prose

    base, rng = prose(200, 60).split(), np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.choice(200, changed, replace=False):
            words[at] = f"new{i}x{at}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_rarest_shingles_meet_at_every_link(spark, percent):
    """Sets of many sizes and likenesses: each linked pair shares a posting."""
    from tests_data import prose

    from tilewright.llm import neardup

    rng, rows = np.random.default_rng(8), template(40, changed=2) + template(40, 4, changed=4)
    rows = [(i, x) for i, (_, x) in enumerate(rows)]
    for k in range(120):
        words = prose(int(rng.integers(3, 90)), 900 + k // 3).split()
        cut = int(rng.integers(0, 4))
        rows.append((1000 + k, " ".join(words[cut:] + [f"end{k}"] * int(rng.integers(0, 3)))))
    names = [str(d).encode() for d, _ in rows]
    sets = [(n, s.view(np.int64).tolist()) for n, s in zip(names, neardup.shingle_sets([x for _, x in rows]), strict=True) if len(s)]
    table = spark.createDataFrame(sets, "cls binary, members array<long>").withColumn("component", F.col("cls")).repartition(3)
    held = {}
    for r in neardup.postings(table, percent).collect():
        held.setdefault(r.region, []).append((r.side, int(bytes(r.cls))))
    met = {(a, b) for v in held.values() for p, a in v for q, b in v if p == q == 2 or p + q == 1}
    links = plain_links(rows, percent)
    assert len(links) > 20 and links <= met


def test_templates_grow_in_proportion(spark, monkeypatch):
    """Documents of one template that are no near-duplicates: rows of the last look grow no faster than documents, and planted links stay."""
    from tilewright.llm import neardup

    seen = []
    taken = neardup._pairs_of

    def counted(rows, chooser):
        if "asks" in rows.columns:
            seen.append(rows.count())
        return taken(rows, chooser)

    monkeypatch.setattr(neardup, "_pairs_of", counted)
    for n in (1000, 3000):
        rows = template(n)
        near = [(10_000 + k, rows[k * 7][1].replace(rows[k * 7][1].split()[100], "other", 1)) for k in range(20)]
        got = {r.doc_id: r.component_id for r in neardup.components(spark.createDataFrame(rows + near, "doc_id long, text string")).collect()}
        assert all(got[10_000 + k] == k * 7 for k in range(20)) and sum(d != c for d, c in got.items()) == 20
        seen.append(0) if len(seen) < (1 if n == 1000 else 2) else None
    assert max(seen) < 3000


def test_one_worker_stores_and_describes_media(spark, hard, sf):
    """Two passes had two workers for each task, and media went through both."""
    from tilewright.llm import media, queries

    plan = queries.op4_wav_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    got, want = media.stored_and_described(hard, slice_rows=2), media.describe(media.encode(hard).drop("text"))
    assert got.columns == want.columns and got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == hard.count()
    clash = hard.selectExpr("text", "1 AS media", "2 AS codes")
    assert media.stored_and_described(clash).exceptAll(media.describe(media.encode(clash).drop("text"))).count() == 0
    assert media.stored_and_described(hard.limit(0)).count() == 0
