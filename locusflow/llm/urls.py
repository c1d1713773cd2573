"""URL filters with redirect equivalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise
from .components import connected_components

#: Fixed values of the contract: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls. A rule fits its host and all
    subdomains where the path starts with the rule's. Of two of a length the one named first."""
    name = verdict = None
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path) if name is None else name.when(fits, rule_host + rule_path)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def address_of(url: Column) -> Column:
    """A digest of an address: scheme and host in lower case, path and query as they are, no fragment,
    which no server sees. Null without ://."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.md5(F.concat_ws("\n", scheme, host_of(url), rest)))


# Patterns of the links that name a page's other address: canonical link, shared address, redirect.
LINKS = (
    r"""(?i)<link\b(?=[^<>]*\brel=["']?canonical\b)[^<>]*\bhref=["']?([^"'\s<>]+)""",
    r"""(?i)<meta\b(?=[^<>]*\bproperty=["']?og:url\b)[^<>]*\bcontent=["']?([^"'\s<>]+)""",
    r"""(?i)<meta\b(?=[^<>]*\bhttp-equiv=["']?refresh\b)[^<>]*\burl=["']?([^"'\s<>]+)""",
)


def links_of(html: Column, url: Column) -> Column:
    """The full addresses that LINKS find; those from the root are completed by the page's host."""
    found = F.concat(*[F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in LINKS])
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    full = F.transform(found, lambda x: F.when(x.rlike("^/[^/]"), F.concat(site, x)).otherwise(x))
    return F.filter(F.transform(full, lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))), lambda x: F.contains(x, F.lit("://")))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row, with blocked_alias and allowed_alias.

    A page whose own rule says so is allowed or blocked. Others take the verdict of their aliases:
    all addresses that redirects (from_url, to_url) and the pages' html connect (canonical links,
    og:url, refresh), directly or over others; rows of one address are aliases of each other. One
    alias with a rule that allows is enough to allow; else one that blocks is enough to block; else
    the page is allowed. Addresses that are null or lack :// have empty parts, no aliases and are
    allowed. Without html and redirects only the rules decide. Other columns are ignored."""
    url = F.col("url").cast("string")
    html = F.coalesce(F.col("html").cast("string"), F.lit("")) if "html" in pages.columns else F.lit("")
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    own = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), links_of(html, url).alias("links"))
    judged = materialise(own.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), address_of(F.col("url")).alias("key"), "links"), "pages")
    ends = judged.where("key is not null").select("key", F.explode("links").alias("u"))
    edges = ends.select(F.col("key").alias("a"), address_of(F.col("u")).alias("b"))
    others = ends.select("u")
    if redirects is not None:
        real = redirects.select(F.col("from_url").cast("string"), F.col("to_url").cast("string")).where("from_url like '%://%' and to_url like '%://%'")
        edges = edges.union(real.select(address_of(F.col("from_url")), address_of(F.col("to_url"))))
        others = others.union(real.select(F.explode(F.array("from_url", "to_url"))))
    u = F.col("u")  # an address that no page has is judged by the rules as well
    facts = others.select(address_of(u).alias("key"), rule_for(host_of(u), path_of(u), rules)[1].alias("said")).where("said is not null")
    labels = materialise(connected_components(edges), "aliases")
    facts = facts.union(judged.where("said is not null and key is not null").select("key", "said"))
    named = facts.distinct().join(labels, F.col("key") == F.col("node")).select("component", "said")
    sums = materialise(named.groupBy("component").agg(F.max((F.col("said") == "allow").cast("int")).alias("allows"), F.max((F.col("said") == "block").cast("int")).alias("blocks")), "verdicts")
    by_key = materialise(labels.join(sums, "component").select("node", "allows", "blocks"), "by-key")
    allowed, blocked = F.coalesce("allows", F.lit(0)) == 1, F.coalesce("blocks", F.lit(0)) == 1
    verdict = F.coalesce("said", F.when(allowed, "allow").when(blocked, "block").otherwise("allow"))
    out = judged.join(by_key, F.col("key") == F.col("node"), "left")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), blocked.alias("blocked_alias"), allowed.alias("allowed_alias"))
