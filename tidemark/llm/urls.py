"""URL filters with redirect equivalence.

Rules (host, path prefix) block or allow a url; the longest that fits wins. Pages that
redirect to each other or name each other as canonical are one site by another name:
connected components over those links carry decisions to urls that no rule
names. An explicit allow anywhere in a component goes before a block. Only DataFrame
functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, materialize, split_join

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref" + _VALUE
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent" + _VALUE
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null if none does; of equally long ones an allow goes first."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict != ALLOW, r.name))
    name = verdict = F.lit(None).cast("string")
    for rule in reversed(ordered):
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _first(html: Column, pattern: str) -> Column:
    got = F.concat(*[F.regexp_extract(html, pattern, i) for i in (1, 2, 3)])
    return F.when(html.isNotNull() & (got != ""), F.replace(got, F.lit("&amp;"), F.lit("&")))


def _absolute(target: Column, url: Column) -> Column:
    """A link's target as a url; relative ones are resolved against the page's."""
    site = F.concat(F.regexp_extract(url, r"^(.*?://)", 1), host_of(url))
    whole = F.when(F.contains(target, F.lit("://")), target)
    whole = F.when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target)).otherwise(whole)
    whole = F.when(whole.isNull() & F.startswith(target, F.lit("/")), F.concat(site, target)).otherwise(whole)
    folder = F.regexp_replace(path_of(url), "[^/]*$", "")
    return F.coalesce(whole, F.concat(site, F.when(folder == "", "/").otherwise(folder), target))


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) of the canonical and refresh links in pages' html."""
    html = F.col("html")
    refresh = F.regexp_extract(_first(html, REFRESH), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1)
    found = pages.where(html.rlike("(?i)canonical|refresh")).select("url", F.explode(F.array(_first(html, CANONICAL), refresh)).alias("target"))
    return found.where("target is not null and target <> '' and url is not null").select("url", _absolute(F.trim("target"), F.col("url")).alias("target"))


def node_of(url: Column) -> Column:
    """The name of a url in the graph of aliases: its host, and all that follows up to ``#``; null for a url without a host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)))


def filter_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``redirects`` (url, target) adds to the links in the pages. A url that no rule names
    takes its component's decision: allow if any alias has an allowing rule, else block
    if any has a blocking one, else allow. Null urls have an empty host and path. Repeated
    rows each come back; other columns are not read.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("url").cast("string").alias("url"), F.col("target").cast("string").alias("target")))
    edges = links.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b")).where("a <> b")
    roots = connected_components(edges, "urls-aliases")

    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("own", verdict)
    if not roots.limit(1).count():
        return rows.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit(ALLOW)).alias("verdict"))
    parts = [F.regexp_extract("node", r"(?s)^([^/?]*)([^?]*)", i) for i in (1, 2)]
    named = roots.select("node", "root", parts[0].alias("host"), parts[1].alias("path"))
    _, own = rule_of(F.col("host"), F.col("path"), rules)
    judged = named.withColumn("own", own).groupBy("root").agg(F.min("own").alias("shared")).where("shared is not null")
    judged = materialize(roots.join(judged, "root").select("node", "shared"), "urls-judged")  # 'allow' < 'block'
    # Most urls have no alias, and stay where they are.
    out = split_join(rows, judged, ["node"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", "shared", F.lit(ALLOW)).alias("verdict"))
