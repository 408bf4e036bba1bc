"""URL filters up to redirect equivalence.

Spellings of one address (scheme, ``www.`` or ``m.``, fragment, tracking
parameters, dot segments, trailing slash) are one node. Redirects and canonical links are
edges between nodes; their connected components are found in a distributed
way, and a block decision on any address of a component holds for all of them.
An address that is explicitly allowed is never blocked; its aliases may be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import connected_components, cut

BLOCK = (r"^(?i:https?)://(?:[^/?#]*[.-])?(?:casino|bets?|pills?|spam|ads|adult|porn|xxx|viagra|escorts?|warez)[.-]", r"[?&]ref=")
ALLOW = (r"^https?://(?:[^/?#]*[.])?tionble[.]example[.]org/", r"^https?://(?:[^/?#]*[.])?thther[.]example[.]org/")
CANONICAL = (
    "(?i)<link[^>]*rel=[\"']?canonical[\"']?[^>]*href=[\"']([^\"']+)[\"']",
    "(?i)<link[^>]*href=[\"']([^\"']+)[\"'][^>]*rel=[\"']?canonical",
)
REFRESH = "(?i)<meta[^>]*http-equiv=[\"']?refresh[\"']?[^>]*url=[\"']?([^\"'> ]+)"
PORTAL = "https://portal.example.com/start"
#: The SQL has the two above; pages are read tag by tag.
TAG = "(?i)<(?:link|meta)\\b[^>]*>"


def address(url: Column) -> Column:
    """The node of a URL: host in lower case without ``www.`` or ``m.``, path and query; null if it has no host."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, "^(?i:https?)://([^/?]+)", 1)), "^(?:www|m)[.]|:(?:80|443)$", "")
    rest = F.regexp_extract(u, "^(?i:https?)://[^/?]+(.*)$", 1)
    path, query = F.regexp_extract(rest, "^([^?]*)", 1), F.regexp_extract(rest, "[?](.*)$", 1)
    path = F.regexp_replace(F.when(path.contains("/."), _without_dots(path)).otherwise(path), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)(?:utm_[^=&]*|ref|fbclid|gclid)=[^&]*", ""), "^&+|&+$", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..``; what would go above the root stays there."""
    last = F.split(path, "/")
    folded = F.aggregate(
        last, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(1), F.size(acc) - 1))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(folded, "/")


def _absolute(target: Column, url: Column) -> Column:
    """``target`` as a link on the page ``url``: absolute, or relative to its scheme, host, path or folder. Null if it is empty or a fragment."""
    origin = F.regexp_extract(url, "^((?i:https?)://[^/?#]+)", 1)
    scheme = F.regexp_extract(url, "^((?i:https?):)//", 1)
    path = F.regexp_extract(url, "^(?i:https?)://[^/?#]+([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, "^/(.*/)", 1))
    return (
        F.when((target == "") | target.startswith("#"), None)
        .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, path, target))
        .otherwise(F.concat(origin, folder, target))
    )


def _attribute(tag: Column, name: str) -> Column:
    """Value of a tag's attribute, quoted or not; empty if there is none."""
    pattern = f"(?i)[\\s\"'/]{name}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'>]+))"
    return F.trim(F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3))))


def _target(tag: Column) -> Column:
    """What a tag ties its page to, if it is a canonical link or a refresh; attributes may stand in any order."""
    to = F.regexp_extract(_attribute(tag, "content"), "(?i)url\\s*=\\s*[\"']?([^\"'> ]+)", 1)
    link = tag.rlike("(?i)^<link") & _attribute(tag, "rel").rlike("(?i)(?:^|\\s)canonical(?:\\s|$)")
    meta = tag.rlike("(?i)^<meta") & (F.lower(_attribute(tag, "http-equiv")) == "refresh")
    return F.when(link, _attribute(tag, "href")).when(meta, to)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): nodes that a page's canonical links and refreshes, all of them, tie together."""
    url, html = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    targets = F.transform(F.regexp_extract_all(html, F.lit(TAG), F.lit(0)), lambda tag: _absolute(_target(tag), url))
    some = html.contains("canonical") | html.contains("CANONICAL") | F.lower(html).contains("refresh") | F.lower(html).contains("canonical")
    return (
        pages.where(some).select(address(url).alias("a"), F.explode(targets).alias("t")).select("a", address(F.col("t")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()
    )


def _any(url: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(url.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False)) if patterns else F.lit(False)


def decide(
    pages: DataFrame,
    block: tuple[str, ...] = BLOCK,
    allow: tuple[str, ...] = ALLOW,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """(page_id, url, node, decision) of every row: ``allow``, ``block``, ``block alias`` or ``none``.

    ``redirects`` has columns (source, target) of URLs, beside the links found
    in the pages. ``node`` is the least address of the component. A null URL,
    or one without a host, has a null node and takes part in no component; only rules
    that match it directly hold. Repeated rows are kept; an empty table gives no rows.
    Other columns are not looked at, and pages are read whole.
    """
    url = F.col(url_col).cast("string")
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(address(F.col("source").cast("string")).alias("a"), address(F.col("target").cast("string")).alias("b")))
    comps = connected_components(edges).select(F.col("node").alias("own"), "root")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), address(url).alias("own")).withColumns(
        {"blocked": _any(F.col("url"), block), "allowed": _any(F.col("url"), allow)}
    )
    rows = cut(rows.join(comps, "own", "left").select("page_id", "url", F.coalesce("root", "own").alias("node"), "blocked", "allowed"))
    # nodes that only redirects name can be blocked too
    named = edges.select(F.explode(F.array("a", "b")).alias("own")).distinct().where(_any(F.concat(F.lit("https://"), F.col("own")), block)).join(comps, "own")
    bad = rows.where("blocked AND node IS NOT NULL").select("node").union(named.select("root")).distinct().withColumn("bad", F.lit(True))
    decision = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").when(F.col("bad"), "block alias").otherwise("none")
    return rows.join(bad, "node", "left").select("page_id", "url", "node", decision.alias("decision"))


def derived_redirects(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(source, target) of redirects made up for pages that have none, by their ids in groups of eight.

    Pages 1 to 3 lead on to the page before, 4 to 6 in a circle, across hosts
    as these come, and page 7 of every group leads to one and the same portal.
    """
    p = pages.select(F.col(id_col).alias("i_"), F.col(url_col).alias("source"))
    r = F.pmod("i_", F.lit(8))
    to = F.when(r.isin(1, 2, 3, 5, 6), F.col("i_") - 1).when(r == 4, F.col("i_") + 2)
    hops = p.withColumn("to_", to).join(pages.select(F.col(id_col).alias("to_"), F.col(url_col).alias("target")), "to_").select("source", "target")
    return hops.union(p.where(r == 7).select("source", F.lit(PORTAL)))


def _sql_address(u: str) -> str:
    bare = f"regexp_replace(trim({u}), '#.*$', '')"
    host = f"regexp_replace(lower(regexp_extract({bare}, '^(?i:https?)://([^/?]+)', 1)), '^(?:www|m)[.]|:(?:80|443)$', '', 'g')"
    rest = f"regexp_extract({bare}, '^(?i:https?)://[^/?]+(.*)$', 1)"
    path = f"regexp_replace(regexp_extract({rest}, '^([^?]*)', 1), '/+$', '')"
    query = f"regexp_replace(regexp_replace(regexp_extract({rest}, '[?](.*)$', 1), '(^|&)(?:utm_[^=&]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+|&+$', '', 'g')"
    return f"CASE WHEN {host} <> '' THEN {host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"


def _sql_absolute(t: str) -> str:
    return (
        f"CASE WHEN starts_with({t}, '//') THEN regexp_extract(url, '^((?i:https?):)//', 1) || {t} "
        f"WHEN starts_with({t}, '/') THEN regexp_extract(url, '^((?i:https?)://[^/?#]+)', 1) || {t} WHEN {t} <> '' THEN {t} END"
    )


def _quoted(p: str) -> str:
    return p.replace("'", "''")


ORACLE_SQL = f"""
WITH RECURSIVE t AS (
  SELECT url, unnest([regexp_extract(html, '{_quoted(CANONICAL[0])}', 1), regexp_extract(html, '{_quoted(CANONICAL[1])}', 1),
                      regexp_extract(html, '{_quoted(REFRESH)}', 1)]) AS t FROM pages),
a AS (SELECT url, {_sql_absolute("t")} AS t FROM t),
h AS (SELECT p.url, q.url AS t FROM pages p JOIN pages q ON q.page_id = CASE WHEN p.page_id % 8 IN (1, 2, 3, 5, 6) THEN p.page_id - 1 WHEN p.page_id % 8 = 4 THEN p.page_id + 2 END
      UNION ALL SELECT url, '{PORTAL}' FROM pages WHERE page_id % 8 = 7 UNION ALL SELECT url, t FROM a),
l AS (SELECT {_sql_address("url")} AS a, {_sql_address("t")} AS b FROM h),
e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.other = e.a),
comps AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
p AS (SELECT page_id, url, {_sql_address("url")} AS own, regexp_matches(url, '{"|".join(f"(?:{p})" for p in BLOCK)}') AS blocked,
             regexp_matches(url, '{"|".join(f"(?:{p})" for p in ALLOW)}') AS allowed FROM pages),
r AS (SELECT p.*, coalesce(root, own) AS n FROM p LEFT JOIN comps ON comps.node = p.own),
bad AS (SELECT n FROM r WHERE blocked
        UNION SELECT root FROM comps WHERE regexp_matches('https://' || node, '{"|".join(f"(?:{p})" for p in BLOCK)}'))
SELECT page_id, url, n AS node, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block'
       WHEN n IN (SELECT n FROM bad) THEN 'block alias' ELSE 'none' END AS decision FROM r
"""
