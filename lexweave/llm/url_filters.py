"""URL filters with redirect equivalence, in DataFrame functions only.

A url is judged by the longest rule that fits its host and path. Where none fits, the verdict comes from its aliases: addresses
that redirects (a table of them, and meta refresh) and canonical links join, taken as connected components. A component with a
url that a rule allows is allowed (allow precedence), else one with a url that a rule blocks is blocked, else the verdict is
allow. An address is a url apart from its scheme and fragment, its host lower-cased; with `rewrite` (off unless asked for)
tracking parameters, default ports, index pages and a last slash or .html don't tell addresses apart either.

Nulls: a null url, or one without ://, has empty host and path, no rule and no aliases: it is allowed. A null html has no
links. Repeated rows are judged alike. An empty table gives an empty result; very long urls and pages are read whole. Other
columns of the pages are not looked at, whatever their names. Joins are merge joins at every size, since addresses grow with the
pages; what is alike on very many pages (one address, one host) is combined before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import ascii_lower, components, stored

#: (verdict, rule): the rule's host up to the first slash, then the path its urls start with.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Query parameters that don't tell pages apart.
TRACKING = r"(?:utm_\w+|ref|gclid|fbclid)=[^&]*"

_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'>\s]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*[\"']?([^\"'>\s]+)"


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host and path."""
    rest = F.coalesce(F.when(F.instr(F.col(url_col), "://") > 0, F.regexp_extract(F.col(url_col), r"(?s)^.*?://(.*)$", 1)), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    return df.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, start = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def address(rest: Column, rewrite: bool = False) -> Column:
    """One form for the urls of a page, from what follows ://; null if that is empty."""
    plain = F.regexp_replace(rest, r"(?s)#.*$", "")
    if not rewrite:
        host = ascii_lower(F.regexp_extract(plain, r"(?s)^([^/?]*)", 1))
        return F.when(rest != "", F.concat(host, F.regexp_extract(plain, r"(?s)^[^/?]*(.*)$", 1)))
    place, query = F.regexp_extract(plain, r"(?s)^([^?]*)", 1), F.regexp_extract(plain, r"(?s)^[^?]*\??(.*)$", 1)
    host = F.regexp_replace(ascii_lower(F.regexp_extract(place, r"(?s)^([^/]*)", 1)), r":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, r"(?s)^[^/]*(.*)$", 1), r"(?:/index)?\.html?$|/+$", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}$"))), "&")
    return F.when(rest != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def resolved(link: Column, host: Column, path: Column) -> Column:
    """What follows :// of a link in a page; null if it doesn't lead to a web page."""
    text = F.regexp_replace(link, "&amp;", "&")
    return (
        F.when(text.rlike(r"(?i)^https?://"), F.regexp_extract(text, r"(?is)^https?://(.*)$", 1))
        .when(text.startswith("//"), F.regexp_extract(text, r"(?s)^//(.*)$", 1))
        .when(text.startswith("/"), F.concat(host, text))
        .when(text.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(text.startswith("#") | (text == ""), F.lit(None).cast("string"))
        .when(text.startswith("?"), F.concat(host, path, text))
        .otherwise(F.concat(host, F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1), F.when(path.contains("/"), "").otherwise("/"), text))
    )


def judge(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None, rewrite: bool = False) -> DataFrame:
    """(id, host, path, rule, verdict, address, component) of each page. redirects: (from_url, to_url) of HTTP redirects that a crawl saw."""
    after = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    own = with_parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    links = F.array_distinct(F.concat(*[F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(p), F.lit(1)) for p in (_CANONICAL, _REFRESH)]))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.select("id", "host", "path", rule.alias("rule"), verdict.alias("said"), address(after(F.col("url")), rewrite).alias("address"), links.alias("links"))
    own = stored(own, "judged")
    edges = own.where("address is not null").select("address", F.explode("links").alias("link"), "host", "path")
    edges = edges.select(F.col("address").alias("a"), address(resolved(F.col("link"), F.col("host"), F.col("path")), rewrite).alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(address(after(F.col("from_url")), rewrite), address(after(F.col("to_url")), rewrite)))
    joined = stored(components(edges, "aliases"), "components")
    told = own.where("address is not null").groupBy("address").agg(F.bool_or(F.col("said") == "allow").alias("allows"), F.bool_or(F.col("said") == "block").alias("blocks"))
    # addresses without links are judged where they stand; only components meet others
    spoken = told.join(joined.hint("merge"), told.address == joined.node).select("address", "component", "allows", "blocks")
    ends = spoken.groupBy("component").agg(F.bool_or(F.coalesce("allows", F.lit(False))).alias("allows"), F.bool_or(F.coalesce("blocks", F.lit(False))).alias("blocks"))
    passed = joined.join(ends.hint("merge"), "component").select(F.col("node").alias("address"), "component", F.when(F.col("blocks") & ~F.col("allows"), "block").otherwise("allow").alias("passed"))
    alone = told.join(joined.hint("merge"), told.address == joined.node, "left_anti").select("address", F.col("address").alias("component"), F.when(F.coalesce("blocks", F.lit(False)) & ~F.coalesce("allows", F.lit(False)), "block").otherwise("allow").alias("passed"))
    out = own.join(passed.union(alone).hint("merge"), "address", "left")
    return out.select("id", "host", "path", "rule", F.coalesce("said", "passed", F.lit("allow")).alias("verdict"), "address", "component")


def _case(column: str, rules: tuple = RULES) -> str:
    out = "CASE"
    for said, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        own, _, start = text.partition("/")
        out += f" WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{start}') THEN '{text if column == 'rule' else said}'"
    return out + " END"


def _address(rest: str) -> str:
    plain = f"regexp_replace({rest}, '(?s)#.*$', '')"
    host = f"regexp_extract({plain}, '^[^/?]*')"
    return f"CASE WHEN {rest} <> '' THEN translate({host}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr({plain}, length({host}) + 1) END"


#: The same by DuckDB over pages, with links and their components by recursion, in the columns of the query.
SQL = rf"""
WITH RECURSIVE own AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path, {_address('rest')} AS address FROM own),
judged AS (SELECT *, {_case('rule')} AS rule, {_case('verdict')} AS said FROM parts),
tags AS (SELECT address, host, path, unnest(list_concat(
  list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\brel\s*=\s*["'']?canonical\b')), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''>\s]+)', 1)),
  list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda t: regexp_extract(t, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''>\s]+)', 1)))) AS link FROM judged WHERE address IS NOT NULL),
links AS (SELECT address, host, path, replace(link, '&amp;', '&') AS link FROM tags WHERE link <> ''),
targets AS (SELECT address AS a, CASE WHEN regexp_matches(link, '(?i)^https?://') THEN substr(link, instr(link, '://') + 3) WHEN starts_with(link, '//') THEN substr(link, 3) WHEN starts_with(link, '/') THEN host || link WHEN regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*:') OR starts_with(link, '#') THEN NULL
  WHEN starts_with(link, '?') THEN host || path || link ELSE host || regexp_extract(path, '(?s)^(.*/)[^/]*$', 1) || CASE WHEN contains(path, '/') THEN '' ELSE '/' END || link END AS rest FROM links),
edges AS (SELECT a, {_address('rest')} AS b FROM targets WHERE rest IS NOT NULL),
sides AS (SELECT a, b FROM edges WHERE a <> b AND b IS NOT NULL UNION SELECT b, a FROM edges WHERE a <> b AND b IS NOT NULL),
reach AS (SELECT DISTINCT a AS x, a AS y FROM sides UNION SELECT r.x, e.b FROM reach r JOIN sides e ON r.y = e.a),
told AS (SELECT address, bool_or(said = 'allow') AS allows, bool_or(said = 'block') AS blocks FROM judged WHERE address IS NOT NULL GROUP BY address),
ends AS (SELECT x, coalesce(bool_or(allows), false) AS allows, coalesce(bool_or(blocks), false) AS blocks FROM (SELECT x, y FROM reach UNION SELECT address, address FROM told) JOIN told ON told.address = y GROUP BY x)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN blocks AND NOT allows THEN 'block' ELSE 'allow' END) AS verdict FROM judged LEFT JOIN ends ON ends.x = judged.address
"""
