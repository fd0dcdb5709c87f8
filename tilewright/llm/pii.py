"""Personal data by candidate gradient boosting: generators propose overlapping spans, boosted trees judge them.

DataFrame functions only on the path of the rows. Each text gives an array of candidates with small integer features of
their format and context. Equal feature vectors form a cell; cells are counted over all documents, and as there are at
most MAX_CELLS of them by construction, the counts alone go to the driver, where trees are boosted on them. The trees
return to the rows as nested CASE expressions.

What the base formats find always stays. The trees learn from the base formats' candidates, valid or not, which formats and
contexts go with valid data. What makes one valid (Luhn, octets, digit counts, an address's labels) is no feature, nor do
features tell it. Half of the documents fit the trees, the other half calibrates their scores, and each kind's threshold is
the least score from which on calibrated precision is PRECISION. Candidates of further formats above it are added where no
base span is; of two such in a row that overlap, the one with the higher score stays.

Null text is the empty text, without spans. Ties between candidates go to the earlier start, then the kind listed
first. Repeated rows are judged alike, an empty table or one without candidates gives no model and so no added spans.
Columns of the input pass through (inner columns are named `_p_*`).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import ascii_lower, let, match_spans, scanned, spans_text

KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Base formats as Java patterns that cannot recurse: repeated groups are flat classes over a text of the same length,
#: in which a dot or separator that would end the repetition has been replaced by a character outside the class.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x20-]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidate forms by kind: written-out at signs, eight-group addresses, other separators, national numbers.
MORE = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{2,24}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}[./_][0-9]{4}[./_][0-9]{4}[./_][0-9]{2,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
CONTEXT = {"email": "mail|contact|write", "ip": r"\bip\b|host|server|addr", "card": "card|visa|credit|pay", "phone": "phone|tel|call|fax|mobil"}
#: Features and how many values each takes; their product bounds the cells.
FEATURES = {"kind": 4, "split": 6, "groups": 5, "letters": 3, "before": 4, "after": 4, "words": 2}
MAX_CELLS = int(np.prod(list(FEATURES.values())))
NEAR = 24
FOUND = "array<struct<start:int,end:int,hit:string,left:string,next:string>>"
PRECISION = 0.95


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    places = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    """The contract's check of a base match."""
    n = F.length(_digits(hit))
    return {
        "email": F.lit(True),
        "ip": hit.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"),
        "card": n.between(14, 19) & luhn(_digits(hit)),
        "phone": n.between(10, 15),
    }[kind]


def _plausible(kind: str, hit: Column) -> Column:
    """The label of a base candidate: its check, and for an address labels that a host can have and a name of letters at the end."""
    if kind != "email":
        return _valid(kind, hit)
    odd = hit.contains("..") | hit.contains(".@") | hit.contains("@-") | hit.contains("-.") | hit.contains(".-") | hit.startswith(".")
    return ~odd & hit.rlike(r"\.[A-Za-z]{2,24}$")  # flat patterns: repeated groups recurse and could end the JVM's stack


def _flat(text: Column, kind: str) -> Column:
    """text for the base pattern of a kind, null where a plain search shows that nothing can match."""
    if kind == "email":
        return F.when(text.contains("@"), F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", "%"))
    if kind == "card":
        return F.when(text.rlike(r"[0-9][0-9\x20-]{12}"), F.regexp_replace(text, r"[\x20-](?![0-9])", "\t"))
    if kind == "phone":
        return F.when(text.contains("+"), text)
    return F.when(text.rlike(r"[0-9]\.[0-9]"), text)


def _found(text: Column, kind: str) -> Column:
    return F.coalesce(match_spans(_flat(text, kind), BASE[kind], NEAR), F.expr(f"cast(array() as {FOUND})"))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `_p_text`, `_p_all_<kind>` (base matches before their check) and `_p_<kind>` (those that pass)."""
    step = docs.withColumn("_p_text", F.coalesce(F.col(text), F.lit("")))
    step = step.withColumns({f"_p_all_{k}": _found(F.col("_p_text"), k) for k in KINDS})
    return step.withColumns({f"_p_{k}": F.filter(f"_p_all_{k}", _checked(k)) for k in KINDS})


def _checked(kind: str):
    return lambda s: _valid(kind, s["hit"])


def shaped(spans: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(spans, lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), s["end"], F.lit(kind).alias("kind")))


def base_spans() -> Column:
    return F.concat(*[shaped(F.col(f"_p_{k}"), k) for k in KINDS])


def _side(c: Column) -> Column:
    """0 edge or blank, 1 letter, 2 digit, 3 other."""
    return F.when((c == "") | c.rlike(r"\s"), 0).when(c.rlike(r"\p{L}"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)


def _candidate(kind: str, s: Column) -> Column:
    hit, left = s["hit"], ascii_lower(s["left"])
    split = F.when(hit.contains("("), 5).when(hit.contains("-"), 1).when(hit.contains(" "), 2).when(hit.rlike(r"[0-9][./_:][0-9]"), 3).when(hit.rlike("[0-9]"), 4).otherwise(0)
    return F.struct(
        s["start"], s["end"],
        F.lit(KINDS.index(kind)).alias("kind"), split.alias("split"),
        F.least(F.regexp_count(hit, F.lit("[^A-Za-z0-9]+")), F.lit(4)).alias("groups"),
        F.when(~hit.rlike("[A-Za-z]"), 0).when(hit.rlike("[A-Z]"), 2).otherwise(1).alias("letters"),
        _side(F.right(left, F.lit(1))).alias("before"), _side(s["next"]).alias("after"),
        F.when(left.rlike(CONTEXT[kind]), 1).otherwise(0).alias("words"),
    )


def _former(kind: str):
    return lambda s: _candidate(kind, s)


def _good(kind: str):
    return lambda s: F.struct(_plausible(kind, s["hit"]).alias("good"), _candidate(kind, s).alias("c"))


def examples() -> Column:
    """array<struct<good,c>> of the base formats' candidates, valid or not."""
    return F.concat(*[F.transform(F.col(f"_p_all_{k}"), _good(k)) for k in KINDS])


def further(text: Column) -> Column:
    """array<struct<start,end,FEATURES>> of the further formats; card numbers must pass the Luhn check."""
    parts = []
    for k in KINDS:
        hint = text.contains("at)") | text.contains("at]") if k == "email" else text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]" if k == "ip" else r"[0-9][0-9]{2}")
        more = F.coalesce(F.when(hint, match_spans(text, MORE[k], NEAR)), F.expr(f"cast(array() as {FOUND})"))
        more = F.filter(more, lambda s: luhn(_digits(s["hit"]))) if k == "card" else more
        parts.append(F.transform(more, _former(k)))
    return F.concat(*parts)


@dataclass
class Model:
    """Boosted trees of depth two over the features, a sigmoid calibration, and a threshold for each kind."""

    start: float = 0.0
    trees: list = field(default_factory=list)  # (feature, cut, feature, cut, feature, cut, four leaves)
    slope: float = 1.0
    shift: float = 0.0
    cuts: dict = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        names = list(FEATURES)
        out = np.full(len(x), self.start)
        for f, c, fl, cl, fr, cr, leaf in self.trees:
            left = x[:, names.index(f)] <= c
            low = np.where(left, x[:, names.index(fl)] <= cl, x[:, names.index(fr)] <= cr)
            out += np.where(left, np.where(low, leaf[0], leaf[1]), np.where(low, leaf[2], leaf[3]))
        return out

    def column(self, s: Column) -> Column:
        def leaf(f: str, c: int, a: float, b: float) -> Column:
            return F.when(s[f] <= c, F.lit(a)).otherwise(F.lit(b))

        trees = [F.when(s[f] <= c, leaf(fl, cl, *v[:2])).otherwise(leaf(fr, cr, *v[2:])) for f, c, fl, cl, fr, cr, v in self.trees]
        return reduce(lambda a, b: a + b, trees, F.lit(self.start))


def _best_cut(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, int]:
    """Gain, feature and cut of the best split of weighted gradients g with curvatures h."""
    best = (0.0, 0, 0)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f in range(x.shape[1]):
        for c in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= c
            gain = g[low].sum() ** 2 / (h[low].sum() + 1) + g[~low].sum() ** 2 / (h[~low].sum() + 1) - whole
            if gain > best[0] + 1e-9:
                best = (gain, f, int(c))
    return best


def fit(cells: list[tuple], rounds: int = 24, rate: float = 0.4) -> Model | None:
    """A model from cells (features..., half, good, count); none if there are no two classes."""
    if not cells:
        return None
    a = np.array(cells, dtype=np.float64)
    x, half, good, n = a[:, : len(FEATURES)], a[:, -3], a[:, -2], a[:, -1]
    fit_on = half == 0
    if min(n[fit_on & (good == 1)].sum(), n[fit_on & (good == 0)].sum()) == 0:
        return None
    names = list(FEATURES)
    mean = np.average(good[fit_on], weights=n[fit_on])
    m = Model(start=float(np.log(mean / (1 - mean))))
    xs, ys, ws = x[fit_on], good[fit_on], n[fit_on]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m.score(xs)))
        g, h = ws * (ys - p), ws * p * (1 - p)
        gain, f, c = _best_cut(xs, g, h)
        if gain <= 1e-6:
            break
        low, node = xs[:, f] <= c, []
        for side in (low, ~low):
            _, f2, c2 = _best_cut(xs[side], g[side], h[side])
            part = xs[side][:, f2] <= c2
            step = [float(rate * g[side][q].sum() / (h[side][q].sum() + 1)) for q in (part, ~part)]
            node.append((names[f2], c2, step))
        (fl, cl, vl), (fr, cr, vr) = node
        m.trees.append((names[f], c, fl, cl, fr, cr, vl + vr))
    other = ~fit_on if (~fit_on).any() else fit_on
    z, y, w = m.score(x[other]), good[other], n[other]
    for _ in range(25):  # Newton steps of the sigmoid's slope and shift, slightly held to 1 and 0
        p = 1 / (1 + np.exp(-np.clip(m.slope * z + m.shift, -30, 30)))
        grad = np.array([(w * (y - p) * z).sum() - (m.slope - 1), (w * (y - p)).sum() - m.shift])
        v = w * p * (1 - p)
        hess = np.array([[(v * z * z).sum() + 1, (v * z).sum()], [(v * z).sum(), v.sum() + 1]])
        d = np.linalg.solve(hess, grad)
        m.slope, m.shift = m.slope + float(d[0]), m.shift + float(d[1])
    for k, kind in enumerate(KINDS):
        mine = x[other][:, 0] == k
        order = np.argsort(-z[mine], kind="stable")
        hits, seen = np.cumsum((w * y)[mine][order]), np.cumsum(w[mine][order])
        p = 1 / (1 + np.exp(-np.clip(m.slope * z[mine][order] + m.shift, -30, 30)))
        ok = np.flatnonzero((hits >= PRECISION * seen) & (p >= PRECISION))
        if len(ok):
            m.cuts[kind] = float(z[mine][order][ok.max()])
    return m


def trained(step: DataFrame, text: str = "text") -> Model | None:
    """The model of all documents of with_spans(): cells are counted on Spark, trees are boosted from the counts."""
    half = F.pmod(F.xxhash64("_p_text"), F.lit(2)).cast("int")
    each = step.select(half.alias("_p_half"), F.explode(examples()).alias("e"))
    cells = each.select(*[F.col(f"e.c.{f}").alias(f) for f in FEATURES], "_p_half", F.col("e.good").cast("int").alias("good"))
    counted = cells.groupBy(*FEATURES, "_p_half", "good").count()
    return fit([tuple(r) for r in counted.collect()])  # at most 4 x MAX_CELLS rows


def apart(base: Column, cand: Column) -> Column:
    """Elements of cand(start, end, score, rank, kind) that overlap no base span, and of those in a row that overlap the best one.

    Three passes in the order of places, none of which compares all with all: what ends before the base spans so far,
    what starts behind it, and a sweep over the rest.
    """
    whole = "struct<start:int,end:int,score:double,rank:int,kind:string,free:boolean>"
    empty = F.expr(f"cast(array() as array<{whole}>)")

    def row(x: Column, score: Column, free: Column) -> Column:
        return F.struct(x["start"], x["end"], score.alias("score"), x["rank"], x["kind"], free.alias("free"))

    both = F.concat(F.transform(base, lambda b: row(b, F.lit(None).cast("double"), F.lit(False))), F.transform(cand, lambda c: row(c, c["score"], F.lit(True))))
    is_base = lambda x: x["score"].isNull()
    # nulls come first in array_sort's structs of one start and end; a base span of the same start must be seen before
    by_start = F.transform(F.array_sort(F.transform(both, lambda x: F.struct(x["start"], (~is_base(x)).alias("late"), x.alias("x")))), lambda p: p["x"])
    seen = scanned(by_start, F.lit(0), lambda at, x: F.when(is_base(x), F.greatest(at, x["end"])).otherwise(at), lambda at, x: row(x, x["score"], x["free"] & (x["start"] >= at)), whole)
    far = F.lit(2**31 - 1)
    left = scanned(F.reverse(seen), far, lambda at, x: F.when(is_base(x), F.least(at, x["start"])).otherwise(at), lambda at, x: row(x, x["score"], x["free"] & (x["end"] <= at)), whole)
    free = F.reverse(F.filter(left, lambda x: x["free"]))
    nothing = F.struct(F.lit(None).cast("int").alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"), F.lit("").alias("kind"), F.lit(False).alias("free"))
    # the state is the span that may still lose to the next one; it is let go when the next one starts behind it
    winner = lambda at, x: F.when(at["start"].isNull() | (x["start"] >= at["end"]) | (x["score"] > at["score"]), x).otherwise(at)
    closed = F.concat(free, F.when(F.size(free) > 0, F.array(row(F.struct(far.alias("start"), far.alias("end"), F.lit(0).alias("rank"), F.lit("").alias("kind")), F.lit(0.0), F.lit(False)))).otherwise(empty))
    out = scanned(closed, nothing, winner, lambda at, x: F.when(x["start"] >= at["end"], at).otherwise(nothing), whole)
    return F.filter(out, lambda x: x["start"].isNotNull())


def judged(step: DataFrame, model: Model | None) -> DataFrame:
    """step with `_p_spans`: base spans, and further candidates above their kind's threshold that overlap none."""
    if model is None or not model.cuts:
        return step.withColumn("_p_spans", base_spans())
    kinds = F.array(*[F.lit(k) for k in KINDS])
    cut = F.create_map(*[x for k, v in model.cuts.items() for x in (F.lit(KINDS.index(k)), F.lit(v))])
    rated = F.transform(further(F.col("_p_text")), lambda c: F.struct(c["start"], c["end"], model.column(c).alias("score"), c["kind"].alias("rank"), F.element_at(kinds, c["kind"] + 1).alias("kind")))
    step = step.withColumns({"_p_base": base_spans(), "_p_cand": F.filter(rated, lambda c: c["score"] >= F.coalesce(F.element_at(cut, c["rank"]), F.lit(float("inf"))))})
    added = F.transform(apart(F.col("_p_base"), F.col("_p_cand")), lambda x: F.struct(x["start"], x["rank"], x["end"], x["kind"]))
    return step.withColumn("_p_spans", F.concat("_p_base", F.when(F.size("_p_cand") > 0, added).otherwise(F.expr(f"cast(array() as {SPAN})"))))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base (spans as text), spans (all, as text) and pii_spans (array)."""
    step = with_spans(docs, text)
    out = judged(step, trained(step, text))
    out = out.withColumns({f"n_{k}": F.size(f"_p_{k}").cast("long") for k in KINDS} | {"base": spans_text(base_spans()), "spans": spans_text(F.col("_p_spans")), "pii_spans": F.col("_p_spans")})
    return out.drop(*[c for c in out.columns if c.startswith("_p_")])


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs whose text has [EMAIL], [IP], [CARD] or [PHONE] for each span; where spans overlap, the first names the gap."""
    made = [*(f"n_{k}" for k in KINDS), "base", "spans", "pii_spans", "_r_text"]
    held = {c: f"_r_held_{i}" for i, c in enumerate(docs.columns) if c.lower() in made and c != text}  # columns of the input that results are named like
    out = detect(docs.withColumnsRenamed(held).select("*", F.col(text).alias("_r_text")), "_r_text")

    def pieces(spans: Column) -> Column:
        end = F.struct(F.length("_r_text").alias("start"), F.lit(0).alias("rank"), F.length("_r_text").alias("end"), F.lit(None).cast("string").alias("kind"))
        tag = lambda s: F.coalesce(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")), F.lit(""))
        cut = lambda at, s: F.concat(F.substring(F.col("_r_text"), at + 1, s["start"] - at), tag(s))
        return scanned(F.concat(spans, F.array(end)), F.lit(0), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.when(s["start"] < at, "").otherwise(cut(at, s)), "string")

    body = F.array_join(pieces(F.array_sort("pii_spans")), "")
    body = F.when(F.size("pii_spans") > 0, body).otherwise(F.col("_r_text"))
    return out.select(*[body.alias(c) if c == text else F.col(held.get(c, c)).alias(c) for c in docs.columns])
