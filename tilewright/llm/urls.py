"""URL filters by redirect equivalence: block decisions spread over aliases, explicit allow rules come first.

DataFrame functions only. Urls that stand for one page are joined into classes. Edges lead from every url to its plain form (as
a server redirects schemes, `www.` and `m.` hosts, page suffixes, closing slashes and tracking parameters), and from plain form to
plain form where a page names another by a canonical link or refresh redirect, absolute or relative to the page's own url or its
base element. Classes are the connected components of these edges, found on Spark. Within a class an explicit allow beats a
block, and a block reaches each member that no rule of its own decides; `via` tells whether a verdict came by rule, by class or
by default.

A null url, or one without `://`, has empty host and path, no rule and no alias: it is allowed. A null html names no
other url. Repeated rows and ties are judged alike (rules of one length are tried in text order), empty tables give
empty results, and columns of the input pass through (inner columns are named `_u_*`).
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import ascii_lower, connected_components, let

#: Fixed values of the contract, by rule (host and path) with its verdict.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
BROADCAST_CLASSES = 100_000
PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, else null. rules is a short list given by the caller, tried longest first."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return out if out is not None else F.lit(None).cast("string")


def plain_form(url: Column) -> Column:
    """What a url redirects to: no scheme, `www.` or `m.`, fragment, tracking parameter, page suffix or closing slash; else null."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/+$", ""), r"\.html?$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_\w*|ref|fbclid|gclid)="))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
    return F.when(url.contains("://"), F.concat(host, path, asked))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, quoted or not, with its character references resolved; '' if there is none."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))"""
    return let(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]), decoded)


def decoded(value: Column) -> Column:
    """value with its character references (&amp; &#38; &#x26;) resolved once; names need their semicolon."""
    names = F.from_json(F.lit(json.dumps({k: v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")
    pieces = F.regexp_extract_all(value, F.lit(r"(?s)&#[0-9]{1,7};?|&#[xX][0-9a-fA-F]{1,6};?|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"), F.lit(0))

    def character(code: Column) -> Column:
        fits = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
        return F.decode(F.unhex(F.lpad(F.hex(F.when(fits, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")

    def piece(p: Column) -> Column:
        return (
            F.when(p.rlike("^&#[xX]"), character(F.conv(F.regexp_extract(p, "([0-9a-fA-F]+);?$", 1), 16, 10).cast("long")))
            .when(p.startswith("&#"), character(F.regexp_extract(p, "([0-9]+)", 1).cast("long")))
            .when(p.rlike("^&.+;$"), F.coalesce(F.try_element_at(names, F.substring(p, 2, 64)), p)).otherwise(p)
        )

    return F.when(value.contains("&"), F.array_join(F.transform(pieces, piece), "")).otherwise(value)


def resolved(target: Column, url: Column) -> Column:
    """The absolute url that a target names on a page of this url, without dot segments; null for other schemes or without any url."""
    return let(F.regexp_replace(target, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), lambda t: let(_joined(t, url), _without_dots))


def _joined(target: Column, url: Column) -> Column:
    scheme, root = F.regexp_extract(url, "^([^:/?#]+)://", 1), F.regexp_extract(url, "^([^:/?#]+://[^/?#]*)", 1)
    path = path_of(url)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).when(~url.contains("://"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, path, target)).when((target == "") | target.startswith("#"), url)
        .otherwise(F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path, "^(.*/)", 1), F.lit("")), F.lit("/")), target))
    )


def _without_dots(url: Column) -> Column:
    none = F.expr("cast(array() as array<string>)")
    steps = F.aggregate(
        F.split(path_of(url), "/"), none,
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x))),
    )
    plain = F.concat(F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1), F.array_join(steps, "/"), F.regexp_extract(url, r"(?s)^[^?#]*(.*)$", 1))
    return F.when(path_of(url).rlike(r"/\.\.?(/|$)"), plain).otherwise(url)


def named_targets(html: Column, url: Column) -> Column:
    """array<string> of the absolute urls that the canonical links and refresh redirects of a page of this url name."""
    none = F.expr("cast(array() as array<string>)")
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta|base)\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags, lambda t: t.rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b"""))
    refresh = F.filter(tags, lambda t: t.rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""))
    asked = r"""(?is)\burl\s*=\s*(?:"([^"]*)|'([^']*)|([^"'].*))"""
    base = F.filter(tags, lambda t: t.rlike(r"""(?is)^<base\b.*[\s"'/]href\s*="""))
    page = F.when(F.size(base) > 0, F.coalesce(resolved(_attribute(F.get(base, F.lit(0)), "href"), url), url)).otherwise(url)

    def redirect(t: Column) -> Column:
        return let(_attribute(t, "content"), lambda c: F.concat(*[F.regexp_extract(c, asked, k) for k in (1, 2, 3)]))

    found = F.filter(F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), F.transform(refresh, redirect)), lambda u: u != "")
    absolute = let(page, lambda p: F.transform(found, lambda u: resolved(u, p)))
    return F.when(html.rlike("(?i)canonical|http-equiv"), F.filter(absolute, lambda u: u.isNotNull())).otherwise(none)


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): each url with its plain form, and plain forms that a page's canonical link or redirect joins."""
    plain = plain_form(F.col(url))
    own = pages.select(F.col(url).alias("a"), plain.alias("b")).where("b is not null")
    named = pages.select(plain.alias("a"), F.explode(named_targets(F.col(html), F.col(url))).alias("_u_t"))
    return own.union(named.select("a", plain_form(F.col("_u_t")).alias("b")).where("a is not null and b is not null and a <> b"))


def judged(pages: DataFrame, rules: dict[str, str] = RULES, url: str = "url", html: str = "html") -> DataFrame:
    """pages with host, path, rule, alias (its class: the smallest url or plain form that can be reached), verdict and via."""
    classes = connected_components(alias_edges(pages, url, html)).withColumnsRenamed({"node": "_u_plain", "component": "_u_class"})
    host, path = host_of(F.col(url)), path_of(F.col(url))
    step = pages.withColumns({"host": host, "path": path, "_u_plain": plain_form(F.col(url))})
    step = step.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    step = step.join(_sized(classes), "_u_plain", "left").withColumn("alias", F.coalesce("_u_class", "_u_plain")).drop("_u_class", "_u_plain")
    verdicts = F.create_map(*[F.lit(x) for r in rules.items() for x in r]) if rules else F.expr("cast(map() as map<string,string>)")
    own = F.when(F.col("rule").isNotNull(), F.element_at(verdicts, F.col("rule")))
    step = step.withColumn("_u_own", own)
    spread = (
        step.where("_u_own is not null and alias is not null").groupBy("alias")
        .agg(F.max((F.col("_u_own") == "allow").cast("int")).alias("_u_allow"), F.max((F.col("_u_own") == "block").cast("int")).alias("_u_block"))
        .where("_u_block = 1 and _u_allow = 0").select("alias", F.lit("block").alias("_u_spread"))
    )
    out = step.join(_sized(spread), "alias", "left")
    via = F.when(F.col("_u_own").isNotNull(), "rule").when(F.col("_u_spread").isNotNull(), "class").otherwise("default")
    return out.withColumns({"verdict": F.coalesce("_u_own", "_u_spread", F.lit("allow")), "via": via}).drop("_u_own", "_u_spread")


def _sized(small: DataFrame) -> DataFrame:
    """Broadcast only what is counted and small; else a shuffle join, whose large keys adaptive execution splits."""
    return F.broadcast(small) if small.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES else small
