"""Each operator against a brute-force version, on hard rows and on a small given table."""

import hashlib
import html as html_lib
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from tests_data import prose

from tilewright.llm import html, media, mixing, neardup, packing, pii, quality, queries, secrets, sharding, urls
from tilewright.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def documents(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def measures(x):
    x = x or ""
    w = WORD.findall(x)
    lines = [s for s in x.split("\n") if WORD.search(s)]
    seen = defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    cover = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)}
    return len(w), sum(map(len, w)), sum(x.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def verdicts(rows):
    """Whether each row (source, text) is kept, host by host, and each host's rate of any failure."""
    seen = [(s, *measures(x)) for s, x in rows]
    fails = [{"repeats": r[5] > 0.3 * r[1], "symbols": r[3] > 0.3 * r[1], "lines": r[4] > 0.2 * r[1]} for r in seen]
    for r, f in zip(seen, fails, strict=True):
        f["any"] = r[6] or any(f.values())
    hosts = Counter(r[0] for r in seen if r[0] is not None)
    strict, shrunk = defaultdict(dict), {}
    for rule in ("repeats", "symbols", "lines", "any"):
        bad = Counter(r[0] for r, f in zip(seen, fails, strict=True) if f[rule])
        rates = np.array([bad[h] / n for h, n in hosts.items()])
        m, w = (rates.mean(), np.mean([1 / n for n in hosts.values()])) if len(rates) else (0, 0)
        s = min(1000, max(1, m * (1 - m) / max((rates.var() if len(rates) else 0) - m * (1 - m) * w, 1e-9) - 1))
        for h, n in hosts.items():
            rate = round((bad[h] + m * s) / (n + s), 6)
            strict[rule][h] = round(min(max(rate / m, 0.5), 2), 4) if m else 1
            if rule == "any":
                shrunk[h] = rate
    kept = [
        not (r[6] or r[5] * strict["repeats"].get(r[0], 1) > 0.3 * r[1] or r[3] * strict["symbols"].get(r[0], 1) > 0.3 * r[1] or r[4] * strict["lines"].get(r[0], 1) > 0.2 * r[1])
        for r in seen
    ]
    return kept, shrunk


def test_quality(spark, hard, sf):
    got = quality.judged(m := quality.measured(hard), quality.host_rates(m)).collect()
    assert len(got) == hard.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(r.text)
        assert r.kept in (True, False) and not (r.base_failed and r.kept)
    docs = {r.doc_id: (r.source, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept, rates = verdicts(docs.values())
    want = dict(zip(docs, kept, strict=True))
    for r in queries.op1_quality_rules(spark, sf).collect():
        assert tuple(r[1:7]) == measures(docs[r.doc_id][1]) and r.kept == want[r.doc_id] and r.host_rate == pytest.approx(rates[r.source], abs=2e-6)


def test_quality_hosts(spark):
    """One text has just as many symbols on three hosts: the host with many failures holds it more strictly, the one with few less."""
    junk, half, clean = prose(60, 97).replace(" ", "*** "), prose(60, 98).replace(" ", "* ", 12), prose(60, 99)
    rows = [(i, h, junk if i % 100 < n else prose(60, i), None) for k, (h, n) in enumerate({"bad": 90, "mid": 30, "good": 1}.items()) for i in range(100 * k, 100 * k + 100)]
    rows += [(1000 + k, h, half, None) for k, h in enumerate(("bad", "mid", "good", None))] + [(2000, "bad", clean, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, host_rate double")
    m = quality.measured(docs)
    out = {r.doc_id: r for r in quality.judged(m, quality.host_rates(m)).collect()}
    assert [out[1000 + k].kept for k in range(4)] == [False, True, True, True] and not out[1000].base_failed
    assert out[1003].host_rate is None and out[1000].host_rate > out[1001].host_rate > out[1002].host_rate
    assert out[2000].kept  # a clean document of a bad host stays
    kept, _ = verdicts([r[1:3] for r in rows])
    assert [out[r[0]].kept for r in rows] == kept
    empty = docs.limit(0)
    assert quality.judged(m := quality.measured(empty), quality.host_rates(m)).count() == 0


def test_sharding(spark, hard, sf):
    for rows, shards in ((hard, 5), (spark.range(1003), 40), (hard.limit(0), 3)):
        out = sharding.shard_rows(rows, shards).collect()
        assert len(out) == rows.count()
        by = defaultdict(list)
        for r in out:
            by[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
        sizes = [len(by.get(j, [])) for j in range(shards)]
        assert max(sizes) - min(sizes) <= 1
    docs = documents(spark, sf)
    for r in queries.op2_hypergeometric_shards(spark, sf).collect():
        data = (docs[r.doc_id] or "").encode()
        assert r["size"] == len(data) + 16 and r.text_crc32 == zlib.crc32(data)


def test_hypergeometric_draws():
    rng = np.random.default_rng(0)
    big = [sharding.hypergeometric(rng, 6 * 10**9, 4 * 10**9, 1000) for _ in range(400)]
    assert abs(np.mean(big) - 600) < 5 and 12 < np.std(big) < 19
    m = sharding.communication_matrix([10, 0, 7], [6, 6, 5], 1)
    assert m.sum(axis=1).tolist() == [10, 0, 7] and m.sum(axis=0).tolist() == [6, 6, 5]


def test_communication_matrix_is_that_of_a_uniform_shuffle():
    """Means and variances of its entries against multivariate hypergeometric draws."""
    lanes, shards = [30, 50, 20], [40, 35, 25]
    got = np.array([sharding.communication_matrix(lanes, shards, seed) for seed in range(3000)])
    n = sum(lanes)
    for i, a in enumerate(lanes):
        for j, b in enumerate(shards):
            mean, var = a * b / n, a * b / n * (n - a) / n * (n - b) / (n - 1)
            assert abs(got[:, i, j].mean() - mean) < 5 * (var / 3000) ** 0.5 and abs(got[:, i, j].var() / var - 1) < 0.15


def shingles(x):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows, percent=85):
    """(component, set size) by id, from all pairs."""
    sets = [(d, shingles(x)) for d, x in rows]
    root = {d: d for d, _ in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and len(s & t) and 100 * len(s & t) >= percent * len(s | t):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: (find(d), len(s)) for d, s in sets}


def test_neardup(spark, hard, sf):
    rows = [(r.doc_id, r.text) for r in hard.collect() if r.doc_id is not None]
    want = components(dict(rows).items())
    for r in neardup.components(hard).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    want = components(documents(spark, sf).items())
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in queries.op3_lsh_forest(spark, sf).collect()} == want
    assert neardup.components(hard.limit(0)).count() == 0


def test_neardup_large_regions(spark, monkeypatch):
    """Near copies in numbers above the region size go deeper and still meet; a chain of links is one group."""
    monkeypatch.setattr(neardup, "REGION", 40)
    base = prose(200, 50).split()
    rows = [(i, " ".join(base[:i] + [f"new{i}"] + base[i + 1 :])) for i in range(150)] + [(500, prose(200, 51))]
    got = {r.doc_id: r.component_id for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(150)} | {500: 500}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 6), (6, 5), (9, 9), (None, 4)] + [(1000, 1000 + k) for k in range(1, 80)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5, 6: 5, 9: 9} | {i: 1000 for i in range(1000, 1080)}


def brute_fingerprint(samples):
    """Peaks by sums over each frame, and pairs by loops."""
    taper, wave, strongest = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(576) / 575), np.exp(-2j * np.pi * np.outer(np.arange(289), np.arange(576)) / 576), []
    for frame in samples.reshape(-1, 576).astype(float):
        power = np.abs(wave @ ((frame - frame.mean()) * taper)) ** 2
        tops = [k for k in range(1, 288) if power[k] > power[k - 1] and power[k] >= power[k + 1] and power[k] > 1e-3]
        strongest.append(sorted(tops, key=lambda k: (-power[k], k))[:3])
    found = sorted((t, a << 20 | b << 4 | d) for t, here in enumerate(strongest) for d in (1, 2, 3) if t + d < len(strongest) for a in here for b in strongest[t + d])
    return [t for t, _ in found], [c for _, c in found]


def test_media(spark, hard, sf):
    out = media.describe(media.encode(hard)).collect()
    assert len(out) == hard.count()
    for r in out:
        raw = (r.text or "").encode()
        whole = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, bytes(r.tail)) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), whole[-32:])
        assert media.from_wav(bytes(r.media)) == whole and len(r.times) == len(r.codes) and list(r.times) == sorted(r.times)
    rng = np.random.default_rng(5)
    for frames in (1, 2, 7):
        x = rng.integers(0, 256, 576 * frames).astype(np.uint8)
        assert list(brute_fingerprint(x)) == [v.tolist() for v in media.fingerprint(x)]
    tone = (127 + 100 * np.sin(np.arange(576 * 4) * 2 * np.pi * 40 / 576)).astype(np.uint8)
    assert (media.peaks(tone)[:, 0] == 40).all()
    got = queries.op4_wav_fingerprints(spark, sf).collect()
    assert len(got) == len(documents(spark, sf))


def test_urls(spark, sf):
    rows = [
        (1, "https://www.a.net/x/", None), (2, "http://a.net/x#top", '<link rel="canonical" href="https://b.net/y">'), (3, "http://b.net/y?utm_source=q", ""), (4, None, None), (5, "no url", "x"),
        (6, "http://c.example.org/es/1", '<META HTTP-EQUIV=refresh content="0; URL=http://d.net/z">'), (7, "http://d.net/z", None), (8, "http://Shop.COM/fr/1", '<link rel=canonical href=http://e.com/de/2>'), (9, "http://e.com/de/2", None), (10, "http://org", None),
    ]
    out = {r.page_id: r for r in urls.judged(spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, verdict string")).collect()}
    assert out[1].alias == out[2].alias == out[3].alias and out[1].verdict == "allow"
    assert (out[4].host, out[4].path, out[4].rule, out[4].verdict) == ("", "", None, "allow")
    assert out[6].rule == "example.org/es/" and out[6].verdict == out[7].verdict == "block"  # a block reaches its redirect's target
    assert [out[k].via for k in (4, 6, 7, 9)] == ["default", "rule", "class", "rule"]
    slash = [(1, "http://x.com/de/", None), (2, "https://www.x.com/de?utm_id=1", None), (3, "http://x.com/de.html", None), (4, "http://y.com/de", None)]
    spread = {r.page_id: (r.rule, r.verdict, r.via) for r in urls.judged(spark.createDataFrame(slash, "page_id long, url string, html string")).collect()}
    assert spread == {1: ("com/de/", "block", "rule"), 2: (None, "block", "class"), 3: (None, "block", "class"), 4: (None, "allow", "default")}
    assert out[8].rule == "com/fr/" and out[8].verdict == "allow" and out[9].verdict == "block"  # own rules stay
    assert out[10].rule is None
    assert urls.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert queries.op5_redirect_verdicts(spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()


def test_html(spark, sf):
    page = '<html><head><title>t</title></head><body><header>Top</header><nav><a href=1>Home</a></nav><div class="cookie-notice">We use</div><main><h1>A &amp; B</h1><p>One\n two<b>three<br>four<p>Short.</main><div id=comments><p>' + "reader words " * 40 + "</div><form>x<input></form><footer>f</footer>"
    assert html.main_text(page) == "A & B One twothree four Short."
    plain = "<html><body><div class=menu><a>a</a><a>b</a></div><div><p>" + "long text here " * 30 + "</p><p>end.</p></div><div><a>1</a></div></body>"
    assert html.main_text(plain) == " ".join(["long text here"] * 30) + " end."
    assert [html.main_text(x) for x in (None, "", "</p></p>", "<script>if(a<b){}", "&lt;b")] == ["", "", "", "", "<b"]
    assert len(html.main_text("<div>" * 5000 + "deep")) == 4
    assert html.main_text("<html><head><title>x</title><body><article><p>Head left open.</article>") == "Head left open."
    assert html.main_text("<body><form>x<main><p>Form around the page.</p></main><p>after</form>") == "Form around the page."
    assert html.main_text('<div class="page has-sidebar"><p>Words of it.</p><div class="sidebar">s</div></div>') == "Words of it."
    assert html.main_text('<article><p>Body text.</p></article><article class="comment">by a reader</article>') == "Body text."
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op6_main_text(spark, sf).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(html_lib.unescape(re.sub(r"</?(?:p|h1|br)>", " ", body).replace("<b>", "").replace("</b>", "")).split())
        assert r.text == want and r.n_chars == len(want)
    assert html.extract(spark.createDataFrame([(1, None, 5)], "page_id long, html string, text long")).first().text == ""


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(x):
    spans, counts = [], []
    for rank, (kind, p) in enumerate(BASE.items()):
        n = 0
        for m in p.finditer(x or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(q) < 256 for q in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                n += 1
                spans.append((m.start(), rank, m.end(), kind))
        counts.append(n)
    return (*counts, ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)))


def test_pii(spark, hard, sf):
    for r in pii.detect(hard).collect():
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base) == personal(r.text)
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    docs = documents(spark, sf)
    for r in queries.op7_boosted_pii(spark, sf).collect():
        *counts, base = personal(docs[r.doc_id])
        assert tuple(r[1:5]) == tuple(counts) and r.base_sha256 == sha(base)
    red = {r.doc_id: r.text for r in pii.redacted(hard).collect()}
    assert red[13].startswith("mail [EMAIL], ip [IP] or 300.1.2.3, card [CARD], phone [PHONE] and") and red[6] == prose(150, 1)
    assert pii.detect(hard.limit(0)).count() == 0


def test_pii_model_finds_more():
    cells = [(3, 5, 4, 0, 0, 0, 0, h, 1, 500) for h in (0, 1)] + [(2, 4, 0, 0, 1, 1, 0, h, 0, 500) for h in (0, 1)]
    m = pii.fit(cells)
    good, bad = m.score(np.array([[3, 5, 4, 0, 0, 0, 0], [2, 4, 0, 0, 1, 1, 0]]))
    assert good > m.cuts["phone"] - 1e-9 > bad and "email" not in m.cuts
    assert pii.fit([]) is None


def test_pii_recall_of_further_formats(spark):
    """Trained on base formats in and out of context, the trees add held-out further formats and leave their likes out of context."""
    r = random.Random(3)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card(sep):
        while not luhn(d := "4" + digits(15)):
            pass
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    base = []
    for k in range(400):
        name = f"{prose(1, k)}.{prose(1, k + 1)}"
        base += [
            f"please write mail to {name}@mail.example.org today", f"call phone +1 ({digits(3)}) {digits(3)}-{digits(4)} now", f"credit card {card('-')} paid", f"host ip {k % 255}.0.0.{k % 200} up",
            f"part x{digits(16)}y listed", f"total +{digits(3)}-{digits(20)} of stock", f"release {300 + k}.1.2.3 out", f"odd .{name}.@-x.a1 sign",
        ]
    planted = []
    for k in range(60):
        planted += [(f"please write mail to {prose(1, k)}.b (at) mail.example.org today", "email"), (f"call phone 555-{digits(3)}-{digits(4)} now", "phone"), (f"credit card {card('/')} paid", "card")]
    decoys = [f"part x{digits(4)}/{digits(4)}/{digits(4)}/{digits(4)}y listed" for _ in range(60)]
    texts = base + [p[0] for p in planted] + decoys
    out = [(r.doc_id, r.base, r.spans) for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    added = {d: s for d, b, s in out if s != b}
    hit = sum(added.get(len(base) + k, "").startswith(kind) for k, (_, kind) in enumerate(planted))
    assert hit >= 0.9 * len(planted)
    assert sum(d >= len(base) + len(planted) for d in added) <= 0.05 * len(decoys)


def test_spans_of_texts_with_many_matches(spark):
    """100,000 matches in one text; overlaps are settled as by comparing all with all."""
    many = "x a@b.cc " * 100_000
    docs = spark.createDataFrame([(1, many), (2, "token=abcdefghijklmnop " * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    assert got[1].n_email == 100_000 and got[1].base.endswith(f"email:{9 * 99_999 + 2}:{9 * 99_999 + 8}")
    found = {r.doc_id: r for r in secrets.findings(docs, secrets.scan_incrementally(docs)).collect()}
    assert found[2].n_assign == 100_000
    r = random.Random(5)
    cases = []
    for _ in range(200):
        spans = sorted({(a := r.randrange(60), a + r.randrange(1, 9)) for _ in range(r.randrange(12))})
        base, end = [], 0
        for a, b in spans:
            if a >= end and r.random() < 0.4:
                base.append((a, b))
                end = b
        cases.append((base, [(a, b, r.random()) for a, b in spans if (a, b) not in base]))
    rows = [(k, [(a, 0, b, "email") for a, b in base], [(a, b, s, 1, "ip") for a, b, s in cand]) for k, (base, cand) in enumerate(cases)]
    t = spark.createDataFrame(rows, f"k long, base {pii.SPAN}, cand array<struct<start:int,end:int,score:double,rank:int,kind:string>>")
    for row in t.select("k", pii.apart(F.col("base"), F.col("cand")).alias("out")).collect():
        base, cand = cases[row.k]
        want, last = [], None
        for a, b, s in sorted(c for c in cand if all(c[1] <= x or y <= c[0] for x, y in base)):
            if last and a < last[1]:
                last = (a, b, s) if s > last[2] else last
                continue
            if last:
                want.append(last)
            last = (a, b, s)
        assert [(x.start, x.end, x.score) for x in row.out] == want + ([last] if last else [])


def test_packing(spark, hard, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    for docs in (hard.where("doc_id is not null").dropDuplicates(["doc_id"]), spark.read.parquet(f"{sf}/documents.parquet")):
        texts = {r.doc_id: r.text for r in docs.collect()}
        by, seq = defaultdict(dict), defaultdict(dict)
        for r in packing.pack(docs, path).collect():
            by[r.doc_id][r.start] = np.frombuffer(bytes(r.ids), "<u4")
            seq[r.sequence_id][r.offset] = r.length
            assert len(by[r.doc_id][r.start]) == r.length
        for d, x in texts.items():
            want = [*t.encode(x or "", add_special_tokens=False).ids, 0]
            assert np.concatenate([by[d][k] for k in sorted(by[d])]).tolist() == want
        for s in seq.values():
            assert list(np.cumsum([0, *[s[k] for k in sorted(s)]]))[:-1] == sorted(s) and sum(s.values()) <= 1024
        full = sum(sum(s.values()) for s in seq.values())
        assert 1024 * len(seq) - full < max(4 * 1024, 0.01 * full)  # less than four sequences or one percent is padding
    assert packing.pack(hard.limit(0), path).count() == 0
    other = public_tokenizers.path("word_bpe_49k.json")  # a file of another kind goes to the library
    assert packing.encoder(other)("Some words, a few.").tolist() == Tokenizer.from_file(other).encode("Some words, a few.", add_special_tokens=False).ids
    h = np.zeros(1025, int)
    h[[1024, 700, 324, 100]] = [3, 5, 7, 11]
    used = np.zeros(1025, int)
    for lengths, k in packing.plan(h):
        for n in lengths:
            used[n] += k
    assert (used == h).all()


def test_mixing(spark, hard, sf):
    rows = [(i, prose(20 + i % 50, i), ["en", "de"][i % 5 == 0], f"s{i % 3 if i % 2 else 0}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    given = {"lang": {"en": 0.5, "de": 0.5}}
    out = mixing.mixed(mixing.measured(docs), given).collect()
    total = sum(r.tokens * r.weight for r in out)
    de = sum(r.tokens * r.weight for r in out if r.lang == "de") / total
    assert abs(de - 0.5) < 1e-9 and max(r.probability for r in out) == pytest.approx(1)
    assert abs(sum(r.sampled for r in out) - sum(r.probability for r in out)) < 4 * len(out) ** 0.5
    for margin in ("source", "topic"):
        natural = Counter()
        for r in out:
            natural[r[margin]] += r.tokens
        z = sum(v**mixing.TEMPER for v in natural.values())
        for s, v in natural.items():
            assert abs(sum(r.tokens * r.weight for r in out if r[margin] == s) / total - v**mixing.TEMPER / z) < 1e-9
    got = mixing.mixed(mixing.measured(hard)).collect()
    assert len(got) == hard.count() and {r.topic for r in got if not WORD.search(r.text or "")} == {"none"}
    assert Counter((r.doc_id, r.tokens) for r in got) == Counter((r.doc_id, max(1, len(WORD.findall(r.text or "")))) for r in hard.collect())
    assert mixing.mixed(mixing.measured(hard.limit(0))).count() == 0
    with pytest.raises(ValueError, match="target above zero"):
        mixing.mixed(mixing.measured(docs), {"lang": {"xx": 1.0}})
    texts = documents(spark, sf)
    whole = queries.op9_raked_mixture(spark, sf).collect()
    assert len(whole) == len(texts) and all(r.tokens == max(1, len(WORD.findall(texts[r.doc_id]))) for r in whole)
    again = queries.op9_raked_mixture(spark, sf).repartition(7).collect()
    assert {r.doc_id: (r.topic, r.sampled) for r in again} == {r.doc_id: (r.topic, r.sampled) for r in whole}


def test_mixing_topics_follow_the_words(spark):
    """Two kinds of words in two languages: topics part the kinds, not the languages, as a direct computation does."""
    r = random.Random(1)
    kinds = {k: [f"{k}{r.randrange(10**6)}" for _ in range(40)] for k in ("law", "sea")}
    rows = [(i, " ".join(r.choice(kinds[("law", "sea")[i % 2]] + [f"of{i % 4 // 2}"]) for _ in range(60)), f"l{i % 4 // 2}", "s") for i in range(400)]
    out = {x.doc_id: x.topic for x in mixing.mixed(mixing.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    seen = [Counter(out[i] for i in range(400) if i % 2 == k) for k in (0, 1)]
    assert sum((seen[0] & seen[1]).values()) <= 20  # hardly any topic holds both kinds
    x = mixing.sketches([t for _, t, _, _ in rows])[1].astype(float)
    lang = np.array([i % 4 // 2 for i in range(400)])
    for k in (0, 1):
        x[lang == k] -= x[lang == k].mean(axis=0)
    first = np.linalg.svd(x, full_matrices=False)[2][0]
    side = x @ (first * np.sign(first[np.abs(first).argmax()])) > 0
    assert [int(out[i][1:]) & 1 for i in range(400)] == side.astype(int).tolist()


def test_mixing_on_spark_agrees(spark):
    r = random.Random(9)
    cells = [(f"h{r.randrange(300)}", f"l{r.randrange(9)}", f"t{r.randrange(8)}", r.randrange(1, 10**6)) for _ in range(900)]
    cells = list({c[:3]: c for c in cells}.values())
    rows = spark.createDataFrame(cells, "_m_source string, _m_lang string, _m_topic string, tokens long")
    small = {tuple(r)[:3]: r.weight for r in mixing.cell_weights(rows).collect()}
    large = {tuple(r)[:3]: r.weight for r in mixing.cell_weights(rows, max_cells=0).collect()}
    assert small.keys() == large.keys() and all(abs(small[k] - large[k]) < 1e-9 * max(1, small[k]) for k in small)
    with pytest.raises(ValueError, match="target above zero"):
        mixing.cell_weights(rows, {"lang": {"xx": 1.0}}, max_cells=0)


SECRET = {"assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def secret(x):
    spans = [(m.start(), k, m.end(), n) for k, (n, p) in enumerate(SECRET.items()) for m in p.finditer(x or "") if (len(m[2]) >= 12 if n == "assign" else len(m[0]) >= (18 if n == "access" else 16))]
    return (*[sum(s[3] == n for s in spans) for n in SECRET], ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(spans)))


def test_secrets(spark, hard, sf):
    ledger = secrets.scan_incrementally(hard)
    assert ledger.count() == len({r.text or "" for r in hard.collect()})
    texts = hard.select("doc_id", "text").collect()
    found = secrets.findings(hard, ledger).collect()
    assert len(found) == len(texts)
    for r in found:
        want = [secret(x.text) for x in texts if x.doc_id == r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex, r.base) in want
    assert secrets.unseen(hard, ledger).count() == 0  # nothing is scanned twice
    more = hard.union(hard.withColumn("text", F.concat("text", F.lit(" v2"))))
    assert secrets.unseen(more, ledger).count() == len({r.text + " v2" for r in texts if r.text is not None})
    assert secrets.unseen(hard, ledger, rule_version=2).count() == ledger.count()  # new rules scan all blobs again
    parts = [more.where(F.pmod("doc_id", F.lit(2)) == k) for k in (0, 1)] + [more.where("doc_id is null")]
    kept = None
    for part in parts:  # a ledger that is carried on finds what one scan finds, and no blob twice
        kept = secrets.scan_incrementally(part, kept)
    once = secrets.scan_incrementally(more)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(str, secrets.findings(more, kept).collect())) == sorted(map(str, secrets.findings(more, once).collect()))
    docs = documents(spark, sf)
    for r in queries.op10_secret_ledger(spark, sf).collect():
        *counts, base = secret(docs[r.doc_id])
        assert tuple(r[1:4]) == tuple(counts) and r.base_sha256 == sha(base)
