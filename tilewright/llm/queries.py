"""The registered queries of this subpackage: thin forms over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm import quality
    from tilewright.llm.common import durable

    docs = _table(spark, sf_dir, "documents")
    measures = durable(quality.measured(docs.select("doc_id", "source", "text")).drop("text"), "quality")
    out = quality.judged(measures, durable(quality.host_rates(measures), "hosts"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "source", "host_rate", "n_soft")


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm import sharding

    docs = _table(spark, sf_dir, "documents")
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    out = sharding.shard_rows(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm import neardup

    return neardup.components(_table(spark, sf_dir, "documents"))


def op4_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm import media

    out = media.stored_and_described(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    pairs = F.concat_ws(",", F.transform(F.arrays_zip("times", "codes"), lambda p: F.concat_ws(":", p["times"].cast("string"), p["codes"].cast("string"))))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", F.crc32("tail").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.lit("pairs"), F.size("codes").cast("string"), F.sha2(pairs.cast("binary"), 256)).alias("feature"),
    )


def op5_redirect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm import urls

    out = urls.judged(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "host", "path", "rule", "verdict", "alias", "via")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm import html

    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op7_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm import pii

    out = pii.detect(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tilewright.llm import packing

    out = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm import mixing
    from tilewright.llm.common import durable

    out = mixing.mixed(durable(mixing.measured(_table(spark, sf_dir, "documents")).drop("text"), "measured"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "sampled")


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from tilewright.llm import secrets
    from tilewright.llm.common import shared_folder

    docs = _table(spark, sf_dir, "documents")
    # sources are delivered in two parts; the second is scanned against the ledger that the first has left
    part = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(2))
    path = f"{shared_folder(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    secrets.scan_into(docs.where(part == 0), path)
    ledger = secrets.scan_into(docs.where(part == 1), path)
    found = secrets.findings(docs, ledger)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "blob")


def op11_branch_and_bound_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm import conversations

    return conversations.digests(_table(spark, sf_dir, "conversations"))


def op12_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tilewright.llm import bpe

    file = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), file)
    digits = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tilewright.llm import importance

    out = importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], chr(32)) AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 6, 1))) AS i FROM w) WHERE len(ws) >= 8),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(8) r(k) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(list_sum(list_transform(list_append(ws, ''), lambda x: length(x))) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN cover USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f AS (SELECT *, n_repeat_words > 0.3::DOUBLE * n_words AS fr, n_symbols > 0.3::DOUBLE * n_words AS fs, n_dup_lines > 0.2::DOUBLE * n_words AS fl FROM b),
u AS (SELECT source, n, unnest(['any', 'repeats', 'symbols', 'lines']) AS rule, unnest([a, r, s, l]) AS f FROM (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR fr OR fs OR fl) AS a,
  count(*) FILTER (WHERE fr) AS r, count(*) FILTER (WHERE fs) AS s, count(*) FILTER (WHERE fl) AS l FROM f WHERE source IS NOT NULL GROUP BY 1)),
p AS (SELECT rule, avg(f / n) AS m, var_pop(f / n) AS v, avg(1 / n) AS w FROM u GROUP BY 1),
q AS (SELECT rule, m, least(1000.0::DOUBLE, greatest(1.0::DOUBLE, m * (1 - m) / greatest(v - m * (1 - m) * w, 1e-9) - 1)) AS s FROM p),
h AS (SELECT source, rule, rate, CASE WHEN m > 0 THEN round(least(greatest(rate / m, 0.5::DOUBLE), 2.0::DOUBLE), 4) ELSE 1.0 END AS strict FROM (SELECT source, rule, m, round((f + m * s) / (n + s), 6) AS rate FROM u JOIN q USING (rule))),
j AS (SELECT source, max(rate) FILTER (WHERE rule = 'any') AS host_rate, max(strict) FILTER (WHERE rule = 'repeats') AS xr, max(strict) FILTER (WHERE rule = 'symbols') AS xs, max(strict) FILTER (WHERE rule = 'lines') AS xl FROM h GROUP BY 1),
o AS (SELECT f.*, host_rate, CAST(n_repeat_words * coalesce(xr, 1) > 0.3::DOUBLE * n_words AS INTEGER) + CAST(n_symbols * coalesce(xs, 1) > 0.3::DOUBLE * n_words AS INTEGER) + CAST(n_dup_lines * coalesce(xl, 1) > 0.2::DOUBLE * n_words AS INTEGER) AS n_soft FROM f LEFT JOIN j USING (source))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_soft = 0 AS kept, source, host_rate, n_soft FROM o
"""

OP3 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], chr(32))) WHEN len(ws) > 0 THEN [array_to_string(ws, chr(32))] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM r JOIN links l ON r.other = l.a),
least_other AS (SELECT doc_id, min(other) AS o FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(o, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(o, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_other USING (doc_id)
"""

#: The given pages name no canonical links or redirects, so here a class is a plain form with the urls that lead to it.
OP5 = r"""
WITH a AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path,
  list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_\w*|ref|fbclid|gclid)=')) AS q FROM pages),
b AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/' WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
  CASE WHEN contains(url, '://') THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '/+$', ''), '\.html?$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END END AS plain FROM a),
c AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS own FROM b),
d AS (SELECT plain, least(plain, min(url)) AS alias, count(*) FILTER (WHERE own = 'block') > 0 AND count(*) FILTER (WHERE own = 'allow') = 0 AS blocked FROM c WHERE plain IS NOT NULL GROUP BY plain)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict, alias, CASE WHEN own IS NOT NULL THEN 'rule' WHEN blocked THEN 'class' ELSE 'default' END AS via
FROM c LEFT JOIN d ON c.plain = d.plain
"""


#: CRC-32 by its table of 256 entries, a step for each byte of every w of the table `{0}`.
_CRC = r"""
crc_table AS (SELECT i, list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i)),
crc_hex AS (SELECT w, hex(encode(w)) AS x FROM {0}),
crc_steps AS (SELECT w, x, 0 AS k, 4294967295::BIGINT AS c FROM crc_hex
  UNION ALL SELECT w, x, k + 1, xor(c >> 8, v) FROM crc_steps JOIN crc_table ON i = xor(c & 255, 16 * (strpos('0123456789ABCDEF', substr(x, 2 * k + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(x, 2 * k + 2, 1)) - 1) WHERE 2 * k < length(x)),
crc AS (SELECT w, xor(c, 4294967295::BIGINT) AS crc FROM crc_steps WHERE 2 * k = length(x))"""

OP13 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS w FROM benchmark),
every AS (SELECT w FROM dw UNION SELECT w FROM bw),
{_CRC.format("every")},
db AS (SELECT doc_id, crc % 10000 AS b FROM dw JOIN crc USING (w)),
s AS (SELECT b, count(*) AS s FROM db GROUP BY 1), t AS (SELECT crc % 10000 AS b, count(*) AS t FROM bw JOIN crc USING (w) GROUP BY 1),
a AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
g AS (SELECT s.b, CAST(floor(1000 * ln(((coalesce(t.t, 0) + 1) * (a.s + 10000))::DOUBLE / ((s.s + 1) * (a.t + 10000))::DOUBLE)) AS BIGINT) AS gain FROM a, s LEFT JOIN t ON s.b = t.b),
v AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS total FROM db JOIN g USING (b) GROUP BY 1),
n AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, CASE WHEN len(ws) > 0 THEN (total - ((total % len(ws)) + len(ws)) % len(ws)) // len(ws) ELSE 0 END AS weight FROM d LEFT JOIN v USING (doc_id)),
h AS (SELECT *, list_reduce([0::BIGINT] || list_transform(range(1, 9), lambda k: strpos('0123456789abcdef', substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), k, 1)) - 1), lambda x, y: 16 * x + y) AS h FROM n),
sc AS (SELECT *, CAST(weight AS BIGINT) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM sc)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM r
"""

#: The cheapest (cost, audit) from each state (start, after system, after user, after assistant) and row, from the last row back.
OP11 = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS w FROM conversations),
every AS (SELECT DISTINCT w FROM c),
{_CRC.format("every")},
d AS (SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role, CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN crc % 20 = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c JOIN crc USING (w) WHERE crc % 20 <> 0),
p AS (SELECT coalesce(conv_id::VARCHAR, '') AS k, *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d),
f AS (SELECT *, left(role, 1) AS ini, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY k ORDER BY i) AS before FROM p),
h AS (SELECT DISTINCT k, n AS i, {{'c': 0, 'a': ''}} AS h0, {{'c': 10, 'a': 'II'}} AS h1, {{'c': 5, 'a': 'I'}} AS h2, {{'c': 0, 'a': ''}} AS h3 FROM f
  UNION ALL SELECT k, i, list_min([x0, {{'c': x2.c + 5, 'a': 'I' || x2.a}}]), list_min([x1, {{'c': x2.c + 5, 'a': 'I' || x2.a}}]), list_min([x2, {{'c': x3.c + 5, 'a': 'I' || x3.a}}]), list_min([x3, {{'c': x2.c + 5, 'a': 'I' || x2.a}}])
  FROM (SELECT k, i, list_min([b0, {{'c': b2.c + 5, 'a': 'I' || b2.a}}]) AS x0, list_min([b1, {{'c': b2.c + 5, 'a': 'I' || b2.a}}]) AS x1, list_min([b2, {{'c': b3.c + 5, 'a': 'I' || b3.a}}]) AS x2, list_min([b3, {{'c': b2.c + 5, 'a': 'I' || b2.a}}]) AS x3
  FROM (SELECT h.k, h.i - 1 AS i,
    list_min([{{'c': h0.c + 2, 'a': 'D' || h0.a}}, {{'c': CASE WHEN ok AND ini = 's' THEN h1.c + t WHEN ok AND ini = 'u' THEN h2.c + t ELSE 1000000000 END, 'a': 'K' || CASE WHEN ini = 's' THEN h1.a ELSE h2.a END}}, {{'c': CASE WHEN ok THEN h2.c + t + 1 ELSE 1000000000 END, 'a': 'R' || h2.a}}]) AS b0,
    list_min([{{'c': h1.c + 2, 'a': 'D' || h1.a}}, {{'c': CASE WHEN ok AND ini = 'u' THEN h2.c + t ELSE 1000000000 END, 'a': 'K' || h2.a}}, {{'c': CASE WHEN ok THEN h2.c + t + 1 ELSE 1000000000 END, 'a': 'R' || h2.a}}]) AS b1,
    list_min([{{'c': h2.c + 2, 'a': 'D' || h2.a}}, {{'c': CASE WHEN ok AND ini = 'a' THEN h3.c + t ELSE 1000000000 END, 'a': 'K' || h3.a}}, {{'c': CASE WHEN ok THEN h3.c + t + 1 ELSE 1000000000 END, 'a': 'R' || h3.a}}]) AS b2,
    list_min([{{'c': h3.c + 2, 'a': 'D' || h3.a}}, {{'c': CASE WHEN ok AND ini = 'u' THEN h2.c + t ELSE 1000000000 END, 'a': 'K' || h2.a}}, {{'c': CASE WHEN ok THEN h2.c + t + 1 ELSE 1000000000 END, 'a': 'R' || h2.a}}]) AS b3
    FROM h JOIN (SELECT k, i, ini, fault IN ('', 'truncated') AS ok, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS t FROM f) r ON r.k = h.k AND r.i = h.i))),
best AS (SELECT k, h0.c AS cost, h0.a AS audit FROM h WHERE i = 0),
letters AS (SELECT k, g, substr(audit, g::INTEGER, 1) AS e FROM (SELECT k, audit, unnest(range(1, length(audit) + 1)) AS g FROM best)),
placed AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER (PARTITION BY k ORDER BY g) AS i, count(*) FILTER (WHERE e <> 'D') OVER (PARTITION BY k ORDER BY g) AS o FROM letters),
made AS (SELECT placed.k, o, e, role, text, ini, max(CASE WHEN o = 1 AND e = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY placed.k) AS s FROM placed LEFT JOIN f ON f.k = placed.k AND f.i = placed.i AND e <> 'I' WHERE e <> 'D'),
rep AS (SELECT k, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY o)) AS sha FROM made GROUP BY k),
g AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY k)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
  coalesce(sha, sha256('')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS k FROM conversations) LEFT JOIN g USING (k) LEFT JOIN best USING (k) LEFT JOIN rep USING (k)
"""

def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1, "op3_lsh_forest": OP3, "op5_redirect_verdicts": OP5, "op11_branch_and_bound_repair": OP11, "op13_importance_resampling": OP13}
