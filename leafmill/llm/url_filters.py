"""URL rules whose block decisions reach aliases through redirects and canonical links, in built-in functions only.

A url that a rule fits gets that rule's verdict. Urls that redirect or declare a canonical url are joined with the
target by an edge; over connected components of these edges, a url without a rule of its own is blocked when some alias
is blocked by a rule, unless an alias is explicitly allowed by one: an explicit allow takes precedence. Everything else
is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm._shared import written
from leafmill.llm.components import connected_components

#: (host, path, verdict): the example policy that the registered query applies.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_LISTED_RULES = 64  #: rules up to this number become one expression; more are joined by host suffix

_LINK = "(?is)<link\\b[^>]*?\\brel\\s*=\\s*[\"']?canonical\\b[^>]*>"
_META = "(?is)<meta\\b[^>]*?\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b[^>]*>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _resolved(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments, at least ``/``."""
    step = lambda done, part: F.when(part == ".", done).when(part == "..", F.regexp_replace(done, "/[^/]*$", "")).otherwise(F.concat(done, F.lit("/"), part))
    folded = F.concat(F.aggregate(F.slice(F.split(path, "/"), 2, 1_000_000), F.lit(""), step), F.when(path.rlike("/[.][.]?$"), "/").otherwise(""))
    return F.when(path == "", "/").when(path.contains("/."), folded).otherwise(path)


def with_parts(rows: DataFrame, url_col: str, prefix: str = "") -> DataFrame:
    """Adds host, path and alias of a url (names after ``prefix``).

    host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or
    the end; both empty without ``://`` or for null. alias: what names a url in an edge, its host, path and query without
    scheme, default port and fragment, dot segments resolved, an empty path being ``/``; null without a host.
    """
    # One step a column, so that none is computed more than once.
    url, rest, host, path = f"`{url_col}`", f"{prefix}rest", f"{prefix}host", f"{prefix}path"
    rows = rows.withColumn(rest, F.expr(f"CASE WHEN locate('://', {url}) > 0 THEN substring({url}, locate('://', {url}) + 3) ELSE '' END"))
    rows = rows.withColumn(host, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER))
    rows = rows.withColumn(path, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))
    alias = F.when(F.col(host) != "", F.concat(F.regexp_replace(host, ":(80|443)$", ""), _resolved(F.col(path)), F.regexp_extract(rest, "^[^?#]*(\\?[^#]*)", 1)))
    return rows.withColumn(f"{prefix}alias", alias).drop(rest)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) urls of the canonical links and meta refreshes in pages; relative targets are made absolute."""
    # Cheap tests first: only pages with such a tag are searched by pattern. Comments hold no tags.
    html = F.when(F.col("html").contains("<!--"), F.regexp_replace("html", "(?s)<!--.*?-->", "")).otherwise(F.col("html"))
    rows = pages.select(F.col(f"`{url_col}`").alias("src"), F.col(f"`{html_col}`").alias("html"))
    canonical = F.when(F.lower("html").contains("canonical"), F.regexp_extract(F.regexp_extract(html, _LINK, 0), "(?i)\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)", 1))
    refresh = F.when(F.lower("html").contains("refresh"), F.regexp_extract(F.regexp_extract(html, _META, 0), "(?i)\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)", 1))
    found = rows.select("src", F.explode(F.array(canonical, refresh)).alias("target")).filter("target <> ''")
    found = with_parts(found.withColumn("target", F.regexp_replace("target", "&amp;", "&")), "src", "src_")
    found = found.withColumn("scheme", F.regexp_extract("src", "^([^:]*)://", 1)).withColumn("folder", F.regexp_replace("src_path", "[^/]*$", ""))
    target, root = F.col("target"), F.concat("scheme", F.lit("://"), "src_host")
    dst = (
        F.when(target.rlike("(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat("scheme", F.lit(":"), "target"))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(root, "src_path", target))
        .otherwise(F.concat(root, F.when(F.col("folder") == "", F.lit("/")).otherwise(F.col("folder")), target))
    )
    return found.select("src", dst.alias("dst")).filter("dst IS NOT NULL")


def rule_name(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def _listed(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null, for a short list of rules."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def _joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (key, host, path) with rule and verdict, for rules of any number: an equi-join on the host's suffixes."""
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = rows.select("key", "path", F.explode(suffixes).alias("_suffix"))
    r = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "verdict")
    met = each.join(r, F.col("_suffix") == F.col("_host")).filter(F.col("path").startswith(F.col("_path")))
    best = F.max_by(F.struct(rule_name(F.col("_host"), F.col("_path")).alias("rule"), "verdict"), F.struct(F.length("_host") + F.length("_path"), F.length("_host"), "_host", "_path"))
    fitted = met.groupBy("key").agg(best.alias("own")).withColumnRenamed("key", "_key")
    return rows.join(fitted, F.col("key") == F.col("_key"), "left").drop("_key")


def judge_urls(pages: DataFrame, rules, edges: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """id, host, path, rule, verdict (allow or block), via (own, alias or default): one row a row of ``pages``.

    ``rules``: a short list of (host, path, verdict) or a DataFrame with these columns. A rule fits its host and all
    subdomains if the path starts with the rule's; the longest (host and path together, then host) wins. ``edges``:
    further redirects, as columns src and dst of urls; the pages' own canonical links and refreshes are added when
    ``html_col`` is given. Urls that no page has can link pages and carry rules too. Null urls, and urls without
    ``://``, have empty host and path, fit no rule, have no aliases and are allowed. Repeated rows are judged alike.
    Other columns are not read. Empty tables give empty results.
    """
    url = F.col(f"`{url_col}`")
    rows = with_parts(pages.select(F.col(f"`{id_col}`").alias("id"), url.alias("url")), "url")
    links = page_edges(pages, url_col, html_col) if html_col else None
    if edges is not None:
        links = edges.select("src", "dst") if links is None else links.union(edges.select("src", "dst"))

    def ruled(frame: DataFrame) -> DataFrame:
        if isinstance(rules, DataFrame) or len(rules) > MAX_LISTED_RULES:
            listed = rules if isinstance(rules, DataFrame) else frame.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
            keyed = frame.select(*frame.columns, F.struct("host", "path").alias("key"))
            distinct = _joined(keyed.select("key", "host", "path").distinct(), listed).select(F.col("key").alias("_k"), "own")
            return keyed.join(distinct, F.col("key") == F.col("_k")).drop("key", "_k")
        return frame.withColumn("own", _listed(F.col("host"), F.col("path"), list(rules)))

    own = ruled(rows)
    if links is None:
        spread = own.withColumn("component_verdict", F.lit(None).cast("string"))
    else:
        # Written once: finding the links reads every page's html.
        named = written(with_parts(with_parts(links, "src", "src_"), "dst", "dst_").drop("src", "dst"), "links")
        component = connected_components(named.select(F.col("src_alias").alias("a"), F.col("dst_alias").alias("b")), "aliases")
        ends = named.select("src_alias", "src_host", "src_path").union(named.select("dst_alias", "dst_host", "dst_path")).toDF("node", "host", "path")
        ends = ruled(ends.filter("node IS NOT NULL").distinct())
        ends = ends.withColumnRenamed("node", "_n").join(component, F.col("_n") == F.col("node"))
        decided = ends.groupBy("component").agg(F.max(F.expr("coalesce(own.verdict = 'allow', false)")).alias("allowed"), F.max(F.expr("coalesce(own.verdict = 'block', false)")).alias("blocked"))
        decided = decided.select(F.col("component").alias("_c"), F.expr("CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END").alias("component_verdict"))
        by_node = component.join(decided, F.col("component") == F.col("_c")).filter("component_verdict IS NOT NULL").select(F.col("node").alias("_node"), "component_verdict")
        spread = own.join(by_node, F.col("alias") == F.col("_node"), "left")
    return spread.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "component_verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("component_verdict").isNotNull(), "alias").otherwise("default").alias("via"),
    )


def op8_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge_urls(pages, RULES)


def _rule_case(value) -> str:
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in longest) + " END"


def _node(host: str, path: str, query: str) -> str:
    """The SQL of an alias."""
    folded = (
        f"list_reduce(list_prepend('', string_split({path}, '/')[2:]), lambda done, part: CASE WHEN part = '.' THEN done "
        "WHEN part = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || '/' || part END)"
        f" || CASE WHEN regexp_matches({path}, '/[.][.]?$') THEN '/' ELSE '' END"
    )
    return f"CASE WHEN {host} <> '' THEN regexp_replace({host}, ':(80|443)$', '') || CASE WHEN {path} = '' THEN '/' WHEN contains({path}, '/.') THEN {folded} ELSE {path} END || {query} END"


_REACHED = f"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) END AS rest FROM pages
), hp AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1), '') AS query FROM parts
), targets AS (
  SELECT url AS src, host AS src_host, path AS src_path, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\\b[^>]*?\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*?\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)]) AS raw FROM (SELECT url, host, path, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM hp)
), absolute AS (
  SELECT src, CASE WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(src, '^([^:]*)://', 1) || ':' || t
    WHEN starts_with(t, '/') THEN regexp_extract(src, '^([^:]*)://', 1) || '://' || src_host || t
    WHEN starts_with(t, '?') THEN regexp_extract(src, '^([^:]*)://', 1) || '://' || src_host || src_path || t
    ELSE regexp_extract(src, '^([^:]*)://', 1) || '://' || src_host || coalesce(nullif(regexp_replace(src_path, '[^/]*$', ''), ''), '/') || t END AS dst
  FROM (SELECT src, src_host, src_path, replace(raw, '&amp;', '&') AS t FROM targets WHERE raw <> '')
), ends AS (
  SELECT DISTINCT u, host, path, {_node('host', 'path', 'query')} AS node FROM (
    SELECT u, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^?#]*(\\?[^#]*)', 1), '') AS query
    FROM (SELECT u, CASE WHEN strpos(u, '://') > 0 THEN substring(u, strpos(u, '://') + 3) END AS rest FROM (SELECT src AS u FROM absolute UNION SELECT dst FROM absolute)))
), edges AS (
  SELECT DISTINCT a.node AS a, b.node AS b FROM absolute e JOIN ends a ON e.src = a.u JOIN ends b ON e.dst = b.u WHERE a.node IS NOT NULL AND b.node IS NOT NULL
), reach AS (
  SELECT a AS node, a AS other FROM edges UNION SELECT b, b FROM edges
  UNION SELECT r.node, CASE WHEN r.other = e.a THEN e.b ELSE e.a END FROM reach r JOIN edges e ON r.other IN (e.a, e.b)
)"""
OP8_SQL = f"""{_REACHED}
, judged AS (
  SELECT node, {_rule_case(lambda h, p, v: v)} AS v FROM ends WHERE node IS NOT NULL
), spread AS (
  SELECT r.node, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v FROM reach r JOIN judged j ON r.other = j.node GROUP BY r.node
), own AS (
  SELECT page_id, host, path, {_node('host', 'path', 'query')} AS node, {_rule_case(lambda h, p, v: h + p)} AS rule, {_rule_case(lambda h, p, v: v)} AS v FROM hp
)
SELECT page_id, host, path, rule, coalesce(own.v, spread.v, 'allow') AS verdict, CASE WHEN rule IS NOT NULL THEN 'own' WHEN spread.v IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM own LEFT JOIN spread USING (node)
"""
