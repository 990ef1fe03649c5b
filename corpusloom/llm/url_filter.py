"""URL rules with redirect equivalence.

A rule blocks or allows a host, its subdomains and a path prefix; the longest
rule that fits an url wins. Urls without a rule follow their aliases: redirects
(``<meta http-equiv=refresh>``) and canonical links (``<link rel=canonical>``)
are edges between urls, their connected components are found by distributed
star contraction, and a block of any member blocks the whole component, but for
urls that a rule allows explicitly.

All tags of a page are read, but for those in comments, scripts, styles and text areas.
Targets are decoded (numeric entities and those of HTML's own marks, once) and resolved
against the page's first ``<base href>`` or else its url: absolute, ``//host``,
``/path``, ``?query`` and relative ones with dot segments. For aliases urls count as
equal but for the case of scheme and host and for fragments.

Only DataFrame functions run here. Defined results: a null url or one without
``://`` has empty host and path, fits no rule and has no aliases; rows that
repeat a page are each judged; an edge is taken from a page with html even if
no other page has its target; empty targets and those with another scheme are
ignored; long html is searched whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, written
from .components import connected_components

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_TAG = r"(?i)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"(?i)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
_REFRESH = r"(?i)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"
_HREF = r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
_URL = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"
_BASE = r"(?i)<base\b[^>]*?\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"
#: Stretches of html whose tags don't count, up to their end or the page's.
_NO_TAGS = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style|textarea)\b.*?(?:</(?:script|style|textarea)\s*>|\z)"
_ENTITY = r"&(?:#[0-9]{1,7};?|#[xX][0-9a-fA-F]{1,6};?|lt;|gt;|quot;|apos;|amp;)"
# Entities of HTML's own marks.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _mark(entity: Column) -> Column:
    """The sign that an entity stands for; U+FFFD for numbers of no character."""
    n = entity["n"]
    sign = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    out = F.when((n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), sign).otherwise("\ufffd")
    for name, sign in ENTITIES:
        out = F.when(entity["e"] == name, sign).otherwise(out)
    return out


def _number(entity: Column) -> Column:
    """An entity e and the number n that it gives, if it does."""
    digits = F.nullif(F.regexp_extract(entity, "^&#([0-9]+)", 1), F.lit(""))
    n = F.coalesce(digits, F.conv(F.regexp_extract(entity, "^&#[xX]([0-9a-fA-F]+)", 1), 16, 10)).cast("int")
    return F.struct(entity.alias("e"), n.alias("n"))


def unescaped(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the entities of the column ``text`` decoded, each once."""
    found = rows.withColumn("marks__", F.when(F.col(text).contains("&"), F.transform(F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)), _number), _mark)))
    parts = F.transform(F.split(text, _ENTITY, -1), lambda x, i: F.concat(x, F.coalesce(F.get("marks__", i), F.lit(""))))
    return found.withColumn(text, F.when(F.size("marks__") > 0, F.array_join(parts, "")).otherwise(F.col(text))).drop("marks__")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def ruled(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and own (the rule's verdict)."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, own = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(longest):
        fits = _fits(F.col("host"), F.col("path"), r)
        rule, own = F.when(fits, F.lit(r[1] + r[2])).otherwise(rule), F.when(fits, F.lit(r[0])).otherwise(own)
    return rows.select("*", rule.alias("rule"), own.alias("own"))


def _origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?s)(.*?://[^/?#]*)", 1)


def _dots_resolved(path: Column) -> Column:
    """A path without its segments . and .., as a browser resolves them."""
    parts = F.split(path, "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts, empty,
        lambda a, x: F.when(x == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))
        .when(x == ".", a).otherwise(F.concat(a, F.array(x))),
    )
    last = F.element_at(parts, -1)
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolved(rows: DataFrame, url: str, target: str) -> DataFrame:
    """``rows`` with the column ``target``, a link's, as an absolute url against the column
    ``url``; null where it has none. Step by step, so that no expression holds another
    more than once."""
    t, u = F.col(target), F.col(url)
    step = unescaped(rows, target).withColumn(target, F.regexp_replace(target, "#.*$", ""))
    step = step.withColumns({"base__": F.regexp_extract(u, r"^(?s)([^?#]*)", 1), "path__": F.regexp_extract(t, r"^([^?]*)", 1), "query__": F.regexp_extract(t, r"^[^?]*(.*)$", 1)})
    step = step.withColumn("above__", F.regexp_replace(F.regexp_extract("base__", r"^(?s).*?://[^/]*(/.*)?$", 1), "[^/]*$", ""))
    whole = F.when(F.col("path__").startswith("/"), F.col("path__")).otherwise(F.concat(F.when(F.col("above__") == "", "/").otherwise(F.col("above__")), "path__"))
    step = step.withColumn("whole__", whole)
    out = (
        F.when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), t).when((t == "") | t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(t.startswith("//"), F.concat(F.regexp_extract(u, r"^(?s)(.*?:)//", 1), t))
        .when(t.startswith("?"), F.concat("base__", t))
        .otherwise(F.concat(_origin(u), _dots_resolved(F.col("whole__")), "query__"))
    )
    return step.withColumn(target, out).drop("base__", "path__", "query__", "above__", "whole__")


def alias_key(url: Column) -> Column:
    """What aliases go by: scheme and host in lower case, no fragment."""
    return F.concat(ascii_lower(_origin(url)), F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^#]*)", 1))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v) for every canonical link and refresh target found in the html."""
    hinted = pages.filter("url LIKE '%://%' AND html IS NOT NULL").filter(
        F.col("html").rlike(r"(?i)\bcanonical\b|\brefresh\b")
    )
    clean = hinted.select("url", F.regexp_replace("html", _NO_TAGS, " ").alias("html"))
    tags = clean.select("url", F.nullif(F.regexp_extract("html", _BASE, 1), F.lit("")).alias("base"), F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).alias("tag"))
    target = F.when(F.col("tag").rlike(_CANONICAL), F.regexp_extract("tag", _HREF, 1)).when(F.col("tag").rlike(_REFRESH), F.regexp_extract("tag", _URL, 1))
    # written before each resolution, else the optimizer copies one's expressions into the next
    links = written(tags.select("url", "base", target.alias("target")), "alias-tags").filter("target <> ''")
    based = written(resolved(links, "url", "base"), "alias-bases")
    found = written(resolved(based.withColumn("base", F.coalesce("base", "url")), "base", "target"), "alias-targets").filter("target LIKE '%://%'")
    return found.select(alias_key(F.col("url")).alias("u"), alias_key(F.col("target")).alias("v")).filter("u <> v")


def judge_urls(pages: DataFrame, edges: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict. ``edges`` (u, v): more alias pairs of urls,
    such as redirects that a crawler has logged."""
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(alias_key(F.col("u")).alias("u"), alias_key(F.col("v")).alias("v")))
    members = connected_components(links)
    rows = ruled(pages.select("page_id", "url"), rules)
    # blocked components: of urls that a page has, or that are only link targets
    roots = members.select("component").distinct().select(F.col("component").alias("node"), "component")
    nodes = members.unionByName(roots)
    blocked = (
        ruled(nodes.select(F.col("component").alias("page_id"), F.col("node").alias("url")), rules)
        .filter("own = 'block'").select(F.col("page_id").alias("component")).distinct()
    )
    tainted = nodes.join(blocked, "component", "left_semi").select(F.col("node").alias("t_url"))
    free = rows.join(tainted.distinct(), alias_key(F.col("url")) == F.col("t_url"), "left")
    return free.select(
        "page_id", "host", "path", "rule",
        F.coalesce("own", F.when(F.col("t_url").isNotNull(), "block").otherwise("allow")).alias("verdict"),
    )


def _sql() -> str:
    key = r"concat(translate(regexp_extract({0}, '^((?s:.*?)://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), regexp_extract({0}, '^(?s:.*?)://[^/?#]*([^#]*)', 1))"
    marks = " ".join(f"WHEN '{e}' THEN '{m.replace(chr(39), chr(39) * 2)}'" for e, m in ENTITIES)

    def resolve(name: str, source: str) -> str:
        """``name`` (url, target): raw of ``source`` (url, via, raw) resolved against via."""
        return rf"""
{name}0 AS (SELECT url, via, string_split_regex(raw, '{_ENTITY}') AS parts, regexp_extract_all(raw, '{_ENTITY}') AS ents FROM {source} WHERE raw <> ''),
{name}1 AS (SELECT url, via, parts, list_transform(ents, lambda e: CASE e {marks} ELSE chr(CASE WHEN num(e) = 0 OR num(e) > 1114111 OR num(e) BETWEEN 55296 AND 57343 THEN 65533 ELSE num(e) END) END) AS marks FROM {name}0),
{name}2 AS (SELECT url, via, regexp_replace(array_to_string(list_transform(parts, lambda x, i: concat(x, coalesce(marks[i], ''))), ''), '#.*$', '') AS t, regexp_extract(via, '^([^?#]*)', 1) AS base FROM {name}1),
{name}3 AS (SELECT *, regexp_extract(t, '^([^?]*)', 1) AS tp, regexp_extract(t, '^[^?]*(.*)$', 1) AS tq,
    regexp_replace(regexp_extract(base, '^(?s:.*?)://[^/]*(/.*)?$', 1), '[^/]*$', '') AS above FROM {name}2),
{name}4 AS (SELECT *, string_split(CASE WHEN starts_with(tp, '/') THEN tp WHEN above = '' THEN concat('/', tp) ELSE concat(above, tp) END, '/') AS s FROM {name}3),
{name}5 AS (SELECT *, list_reduce(list_transform(s, lambda q: [q]), lambda m, q: CASE WHEN q[1] = '..' THEN CASE WHEN len(m) > 1 THEN m[:len(m) - 1] ELSE m END
    WHEN q[1] = '.' THEN m ELSE list_concat(m, q) END) AS k FROM {name}4),
{name} AS (SELECT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN t WHEN t = '' OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(t, '//') THEN concat(regexp_extract(via, '^((?s:.*?):)//', 1), t) WHEN starts_with(t, '?') THEN concat(base, t)
    ELSE concat(regexp_extract(via, '^((?s:.*?)://[^/?#]*)', 1), array_to_string(k, '/'), CASE WHEN s[-1] IN ('.', '..') THEN '/' ELSE '' END, tq) END AS target FROM {name}5),""".replace(
            "num(e)", "CASE WHEN e[3:3] IN ('x', 'X') THEN CAST(concat('0x', rtrim(e[4:], ';')) AS INT) ELSE CAST(rtrim(e[3:], ';') AS INT) END"
        )

    no_tags = _NO_TAGS.replace("'", "''")
    return r"""
WITH RECURSIVE b AS (SELECT page_id, url, regexp_replace(html, '""" + no_tags + r"""', ' ', 'g') AS html,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
c AS (SELECT row_number() OVER () AS at_row, url, html FROM b WHERE url LIKE '%://%'),
bs AS (SELECT CAST(at_row AS VARCHAR) AS url, url AS via, regexp_extract(html, '""" + _BASE.replace("'", "''") + r"""', 1) AS raw FROM c),
""" + resolve("bl", "bs") + r"""
g AS (SELECT c.url, coalesce(bl.target, c.url) AS via, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM c LEFT JOIN bl ON bl.url = CAST(c.at_row AS VARCHAR)),
w AS (SELECT url, via, CASE WHEN regexp_matches(tag, '(?i)^<link\b(?s:.*)\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta\b(?s:.*)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS raw FROM g),
""" + resolve("l", "w") + r"""
p AS (SELECT """ + key.format("url") + " AS u, " + key.format("target") + r""" AS v FROM l WHERE target LIKE '%://%'),
e AS (SELECT u, v FROM p WHERE u <> v UNION SELECT v, u FROM p WHERE u <> v),
n AS (SELECT u AS url, translate(regexp_extract(u, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path, false AS page FROM e UNION SELECT url, host, path, true FROM b),
r AS (SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM n),
t AS (SELECT url FROM r WHERE NOT page AND rule IN ('net/', 'example.com/de/') UNION SELECT e.v FROM t JOIN e ON e.u = t.url)
SELECT b.page_id, b.host, b.path, r.rule,
  CASE WHEN r.rule IN ('net/', 'example.com/de/') THEN 'block' WHEN r.rule IS NOT NULL THEN 'allow'
       WHEN """ + key.format("b.url") + r""" IN (SELECT url FROM t WHERE url IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM b LEFT JOIN r ON r.page AND r.url IS NOT DISTINCT FROM b.url
"""


#: DuckDB SQL for the rows of judge_urls over ``pages``.
URL_SQL = _sql()
