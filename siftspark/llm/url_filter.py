"""URL filters: longest-rule verdicts, and blocks that reach aliases along redirect and canonical links."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

#: (verdict, host, path): the default rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PARTS = r"://([^/?#]*)([^?#]*)"
CANONICAL = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. The list of rules is a parameter of the query."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def _resolve(base: Column, link: Column) -> Column:
    """The link as an absolute address: absolute, //host, /path or relative to the base's folder."""
    scheme = F.regexp_extract(base, r"^([^:/?#]*):", 1)
    origin = F.regexp_extract(base, r"^([^/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^?#]*/)", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link != "", F.concat(F.when(folder.rlike("://.+/$"), folder).otherwise(F.concat(origin, F.lit("/"))), link))
    )


def node_of(url: Column) -> Column:
    """An address as a node: without its fragment, which no server sees, and the host in lower case."""
    bare = F.regexp_replace(url, "#[\\s\\S]*$", "")
    return F.concat(F.regexp_extract(bare, r"^([\s\S]*?://)", 1), host_of(bare), F.regexp_replace(bare, r"^[\s\S]*?://[^/?#]*", ""))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): a page's address and the address it redirects to or names as canonical."""
    canonical = F.regexp_extract(F.regexp_extract("html", CANONICAL, 0), r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]*)", 1)
    refresh = F.regexp_extract(F.regexp_extract("html", REFRESH, 0), r"(?i)\burl\s*=\s*['\"]?([^\"'\s>;]*)", 1)
    x = pages.where("url like '%://%' and html is not null").select("url", F.explode(F.array(canonical, refresh)).alias("link")).where("link <> ''")
    return x.select(node_of(F.col("url")).alias("u"), node_of(_resolve(F.col("url"), F.col("link"))).alias("v")).where("v is not null")


def judge(pages: DataFrame, scratch: Scratch, rules=RULES) -> DataFrame:
    """Verdicts for pages (page_id, url, html): page_id, host, path, rule, verdict.

    The longest rule that fits the address decides. Where none fits, the page takes the block of any
    alias: addresses joined by redirects (meta refresh) and canonical links form components, found
    by distributed connected components, and a component with a blocked member blocks all members
    without a rule, unless a member is allowed by a rule of its own, which takes precedence. All
    else is allowed. Null addresses, or such without ://, have an empty host and path and are
    allowed; null html has no links; repeated rows are judged each; other columns are ignored.
    """
    edges = scratch.save(alias_edges(pages), "url-edges")
    p = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    p = p.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        return p.select("page_id", "host", "path", "own.rule", F.coalesce("own.verdict", F.lit("allow")).alias("verdict"))
    nodes = components(edges, scratch, "url-cc")
    flags = nodes.withColumn("own", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
    flags = flags.groupBy("component").agg(
        F.max(F.coalesce(F.col("own.verdict") == "block", F.lit(False))).alias("any_block"),
        F.max(F.coalesce(F.col("own.verdict") == "allow", F.lit(False))).alias("any_allow"),
    )
    blocked = nodes.join(flags.where("any_block and not any_allow").select("component"), "component", "left_semi").select("node")
    blocked = blocked.withColumn("aliased", F.lit(True))
    p = p.withColumn("node", node_of(F.col("url"))).join(blocked, "node", "left")
    verdict = F.coalesce("own.verdict", F.when(F.col("aliased"), "block"), F.lit("allow"))
    return p.select("page_id", "host", "path", "own.rule", verdict.alias("verdict"))
