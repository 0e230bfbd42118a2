"""URL filter: rules by host and path, and block decisions that spread over redirect equivalence.

Rules name a host, which stands for its subdomains too, and the start of a path; the longest rule that
fits decides, of equally long ones an allowing rule.  A url that no rule fits gets its alias class's
decision.  Aliases are urls with one canonical form (scheme, ``www.`` and ``m.``, fragment, tracking
parameters and a last slash don't count), and pages that name each other by canonical links or
refresh redirects in their html, over any number of hops: connected components of those edges.  In a
class an allowed member outweighs blocked ones; without either the verdict is allow.

That urls of one form are aliases without any edge is this module's own choice: ``canonical_of`` is the
place to change it.  Edges that join a form to itself need no component; only edges between different forms are iterated.
Everything is DataFrame functions and joins; a url that holds a large share of all rows is dealt out
by page_id.  The rules are a literal of checked size (``MOST_RULES``); larger sets are joined by host.

Defined results: of a null url or one without ``://`` host and path are empty, no rule fits, and the
verdict is allow; of a null html or a link that leads nowhere there is no edge; urls and pages of any length
are read whole; all links of a page count, and ``.`` and ``..`` in them are resolved; repeated rows are judged
alike; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcloom.llm.arrays import running
from srcloom.llm.components import connected_components, salted_join
from srcloom.llm.storage import materialize

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MOST_RULES = 500
TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid)(?:=[^&]*)?"
#: What no link stands in.  Patterns here give back nothing that they have taken, so each reads a page once.
NO_MARKUP = r"(?i)<!--(?:-?>|[\s\S]*?(?:-->|--!>|\z))|" + "|".join(rf"<{x}[\s/>][\s\S]*?(?:</{x}[\s/>]|\z)" for x in ("script", "style", "template", "textarea", "title"))
#: A tag up to its end; one that doesn't end has no ``>``.
TAG = r"""(?i)<(?:link|meta)[\s/](?:[^>"']++|"[^"]*+"|'[^']*+')*+>?"""
ATTRIBUTE = r"""[^\s"'>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))?"""


def _rest(url: F.Column) -> F.Column:
    """What stands behind the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_of(url: F.Column) -> F.Column:
    """The canonical form, and key of the alias class; of a url without ``://`` null."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(query, rf"(?<=^|&){TRACKING}(?=&|$)", ""), "&+", "&"), "^&|&$", "")
    host = F.regexp_replace(host_of(url), r"^(?:(?:www|m)\.(?=[^.]++\.))++", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    return F.when(_rest(url).isNotNull(), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def links_of(html: F.Column) -> F.Column:
    """Where all of a page's canonical links and refreshes lead, as an array; ampersands are decoded.
    Comments, scripts and other text that isn't markup hold none; of an attribute's repeats the first counts."""
    tags = F.filter(F.regexp_extract_all(F.regexp_replace(html, NO_MARKUP, " "), F.lit(TAG), F.lit(0)), lambda t: t.endswith(">"))

    def target(tag):
        own = F.regexp_extract_all(F.regexp_replace(tag, r"^<\w+", ""), F.lit(ATTRIBUTE), F.lit(0))
        value = lambda name: F.regexp_replace(F.regexp_replace(F.element_at(F.concat(F.filter(own, lambda x: x.rlike(rf"(?i)^{name}(?:\s*=|$)")), F.array(F.lit("="))), 1), r"^[^=]*+=?\s*+", ""), """^["']|["']$""", "")
        link = F.when(F.concat(F.lit(" "), F.lower(value("rel")), F.lit(" ")).rlike(r"\scanonical\s"), value("href"))
        refresh = F.when(F.lower(F.trim(value("http-equiv"))) == "refresh", F.regexp_extract(value("content"), r"""(?i)(?:^|[\s;,])url\s*+=\s*+["']?([^"'\s]+)""", 1))
        return F.trim(F.when(F.lower(F.substring(tag, 2, 4)) == "link", link).otherwise(refresh))

    found = F.array_distinct(F.filter(F.transform(tags, target), lambda x: x.isNotNull() & (x != "")))
    return F.transform(found, lambda x: F.regexp_replace(x, "(?i)&(?:amp|#0*38|#x0*26);", "&"))


def absolute(url: F.Column, found: F.Column) -> F.Column:
    """A link found on the page at ``url``, absolute."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*)://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(url), r"^[^/?#]*", 0))
    folder = F.concat(root, F.regexp_extract(path_of(url), r"^(.*/)?", 0))
    whole = F.when(found.contains("://"), found).when(found.startswith("//"), F.concat(scheme, F.lit(":"), found)).when(found.startswith("/"), F.concat(root, found)).otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), found))
    return F.when(whole.rlike(r"/\.\.?(/|$|\?|#)"), _without_dots(whole)).otherwise(whole)


def _without_dots(url: F.Column) -> F.Column:
    """A url whose path has no ``.`` and ``..`` segments any more."""
    segments = F.split(F.regexp_replace(path_of(url), "^/", ""), "/")
    # from the last to the first: how many segments a ".." behind has yet to take
    nothing = F.array().cast("array<string>")
    step = lambda skip, x: (F.when(x == "..", skip + 1).when((x == ".") | (skip == 0), skip).otherwise(skip - 1), F.when((skip == 0) & ~x.isin(".", ".."), F.array(x)).otherwise(nothing))
    kept = F.reverse(running(F.reverse(segments), F.lit(0), "array<string>", step))
    # a path that ends in a dot segment ends in a slash
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    front = F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*", 0)
    return F.concat(front, F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, tail).otherwise(F.lit("")), F.regexp_extract(_rest(url), r"^[^?#]*(.*)$", 1))


def _by_literal(pages: DataFrame, rules) -> DataFrame:
    """Adds decision (size, allow, rule, verdict) of the rule that decides, from a literal list."""
    fits = [
        F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(int(v == "allow")).alias("allow"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return pages.withColumn("decision", F.greatest(*fits) if len(fits) > 1 else fits[0] if fits else F.lit(None).cast("struct<size:int,allow:int,rule:string,verdict:string>"))


def _by_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The same from a table of rules (host, path, verdict) of any size, by the host's suffixes."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    urls = pages.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    near = rules.select(F.col("host").alias("suffix"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    hit = urls.join(near, "suffix").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("suffix", "rule_path")
    best = hit.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("size"), (F.col("rule_verdict") == "allow").cast("int").alias("allow"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("decision"))
    place = F.struct("host", "path").alias("place")
    return salted_join(pages.withColumn("place", place), best.select(place, "decision"), "place", F.rand(1) if "page_id" not in pages.columns else F.col("page_id"), "left").drop("place")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, alias (canonical form) of every row of pages (page_id, url, html)."""
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), canonical_of(url).alias("alias"))
    if isinstance(rules, DataFrame):
        small = rules.limit(MOST_RULES + 1).count() <= MOST_RULES
        rules = [(r["host"], r["path"], r["verdict"]) for r in rules.select("host", "path", "verdict").collect()] if small else rules
    decide = lambda urls: _by_join(urls, rules) if isinstance(rules, DataFrame) else _by_literal(urls, rules)
    ruled = decide(rows).select("page_id", "host", "path", "alias", F.col("decision.rule").alias("rule"), F.col("decision.verdict").alias("ruled"))
    found = materialize(pages.where(url.isNotNull() & F.col("html").rlike("(?i)canonical|refresh")).select("url", F.explode(links_of(F.col("html"))).alias("link")), "found")
    targets = materialize(found.select("url", absolute(url, F.col("link")).alias("target")), "targets")
    links = targets.select(canonical_of(url).alias("u"), canonical_of(F.col("target")).alias("v"))
    edges = materialize(links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct(), "links")
    # what links lead to has a say too, be it a page of the table or not
    there = F.col("target")
    led = decide(targets.select(host_of(there).alias("host"), path_of(there).alias("path"), canonical_of(there).alias("alias"))).select("alias", F.col("decision.rule").alias("rule"), F.col("decision.verdict").alias("ruled"))
    flags = ruled.select("alias", "rule", "ruled").unionByName(led).where("rule IS NOT NULL AND alias IS NOT NULL").groupBy("alias").agg(F.max(F.col("ruled") == "allow").alias("allow"))
    if not edges.isEmpty():
        roots = connected_components(edges, "aliases").select(F.col("node").alias("alias"), "root")
        flags = flags.join(roots, "alias", "full").withColumn("root", F.coalesce("root", "alias"))
        known = flags.where("allow IS NOT NULL").groupBy("root").agg(F.max("allow").alias("allow"))
        flags = salted_join(flags.drop("allow"), known, "root", F.col("alias")).select("alias", "allow")
    flags = flags.where("NOT allow").select("alias", F.lit("block").alias("spread"))
    out = salted_join(ruled, flags, "alias", F.col("page_id"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "spread", F.lit("allow")).alias("verdict"), "alias")


#: The same in SQL, but for ``.`` and ``..`` in the paths of links.
SQL = r"""
WITH RECURSIVE tags AS (
  SELECT DISTINCT url, unnest(regexp_extract_all(regexp_replace(html, '<!--(?:-?>|[\s\S]*?(?:-->|--!>|\z))|<script[\s>/][\s\S]*?(?:</script[\s>/]|\z)|<style[\s>/][\s\S]*?(?:</style[\s>/]|\z)|<template[\s>/][\s\S]*?(?:</template[\s>/]|\z)|<textarea[\s>/][\s\S]*?(?:</textarea[\s>/]|\z)|<title[\s>/][\s\S]*?(?:</title[\s>/]|\z)', ' ', 'gi'),
    '<(?:link|meta)[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*>?', 0, 'i')) AS tag FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
attrs AS (SELECT url, lower(substr(tag, 2, 4)) AS kind, regexp_extract_all(regexp_replace(tag, '^<\w+', ''), '[^\s"''>/=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]+))?', 0) AS own FROM tags WHERE ends_with(tag, '>')),
named AS (SELECT url, kind, list_transform(['rel', 'href', 'http-equiv', 'content'], lambda n: regexp_replace(regexp_replace(coalesce(list_filter(own, lambda x: regexp_matches(x, '^' || n || '(?:\s*=|$)', 'i'))[1], '='), '^[^=]*=?\s*', ''), '^["'']|["'']$', '', 'g')) AS v FROM attrs),
found AS (SELECT DISTINCT url, regexp_replace(link, '&(amp|#0*38|#x0*26);', '&', 'gi') AS link FROM (SELECT url, trim(CASE
    WHEN kind = 'link' THEN CASE WHEN regexp_matches(' ' || lower(v[1]) || ' ', '\scanonical\s') THEN v[2] END
    WHEN lower(trim(v[3])) = 'refresh' THEN regexp_extract(v[4], '(?:^|[\s;,])url\s*=\s*["'']?([^"''\s]+)', 1, 'i') END) AS link FROM named) WHERE link <> ''),
parts AS (SELECT url, link, regexp_extract(url, '^([^:/?#]*)://', 1) AS scheme, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM found),
rooted AS (SELECT url, link, scheme, scheme || '://' || regexp_extract(rest, '^[^/?#]*') AS root, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
led AS (SELECT url, CASE WHEN strpos(link, '://') > 0 THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link WHEN starts_with(link, '/') THEN root || link
  ELSE root || CASE WHEN strpos(path, '/') > 0 THEN regexp_extract(path, '^(.*/)', 1) ELSE '/' END || link END AS target FROM rooted),
every AS (SELECT page_id, url, CAST(NULL AS VARCHAR) AS came FROM pages UNION ALL SELECT NULL, target, url FROM led),
r AS (SELECT page_id, url, came, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM every),
p AS (SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '') AS query FROM r),
q AS (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_full_match(x, '(utm_[^=&]*|ref|fbclid|gclid)(=[^&]*)?')), '&') AS kept FROM p),
d AS (SELECT page_id, url, came, host, path,
  CASE WHEN rest IS NOT NULL THEN regexp_replace(host, '^(www\.|m\.)+([^.]+\.)', '\2') || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS alias,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM q),
v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM d),
edges AS (SELECT DISTINCT a.alias AS u, b.alias AS w FROM v b JOIN v a ON b.came = a.url WHERE b.came IS NOT NULL AND a.alias IS NOT NULL AND b.alias IS NOT NULL AND a.alias <> b.alias),
both_ways AS (SELECT u, w FROM edges UNION SELECT w, u FROM edges),
reached AS (SELECT u AS node, u AS root FROM both_ways UNION SELECT b.w, x.root FROM reached x JOIN both_ways b ON b.u = x.node),
roots AS (SELECT node, min(root) AS root FROM reached GROUP BY node),
f AS (SELECT coalesce(roots.root, v.alias) AS root, bool_or(v.ruled = 'allow') AS allow FROM v LEFT JOIN roots ON roots.node = v.alias WHERE v.ruled IS NOT NULL AND v.alias IS NOT NULL GROUP BY 1)
SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.ruled, CASE WHEN NOT f.allow THEN 'block' END, 'allow') AS verdict, v.alias
FROM v LEFT JOIN roots ON roots.node = v.alias LEFT JOIN f ON f.root = coalesce(roots.root, v.alias) WHERE v.came IS NULL
"""
