"""URL filters: host and path rules, and block decisions that follow redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewmetrics.llm.components import components

#: rules travel in the plan; longer lists are refused, not cut
MAX_RULES = 10_000

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TO = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _AZ, _az), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct ``rule, action``; null without one.

    ``rules`` are (host, path, ``allow`` or ``block``); of equally long ones an allowing one wins, then the first
    by text.  The rules of each suffix of the host are looked up in one literal map: the work for a url is its labels.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules are more than {MAX_RULES}")
    by_host: dict[str, list[Column]] = {}
    for name, start, action in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r[0] + r[1])):
        rule = F.struct(F.lit(name + start).alias("rule"), F.lit(action).alias("action"), F.lit(start).alias("start"), F.lit(-len(name + start)).alias("rank"), F.lit(int(action != "allow")).alias("later"))
        by_host.setdefault(name, []).append(rule)
    if not by_host:
        return F.lit(None).cast("struct<rule:string,action:string>")
    table = F.create_map(*[x for name, held in by_host.items() for x in (F.lit(name), F.array(*held))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    held = F.flatten(F.filter(F.transform(suffixes, lambda s: F.element_at(table, s)), lambda x: x.isNotNull()))
    fits = F.filter(held, lambda r: F.startswith(path, r["start"]))
    best = F.array_min(F.transform(fits, lambda r: F.struct(r["rank"], r["later"], r["rule"], r["action"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["action"].alias("action")))


def page_key(url: Column) -> Column:
    """A url without its fragment, the scheme and host lower-cased: what names a page."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(plain, r"^[^:/?#]+://[^/?#]*", 0)
    return F.concat(F.translate(head, _AZ, _az), F.substring(plain, F.length(head) + 1, 2**31 - 1))


def absolute(target: Column, url: Column) -> Column:
    """A link's target as a whole url, seen from the page at ``url``."""
    scheme, site = F.regexp_extract(url, r"^[^:/?#]+", 0), F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*", 0)
    folder = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(F.coalesce(target, F.lit("")) == "", None).when(target.rlike(r"^[^:/?#]+://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?") | target.startswith("#"), F.concat(F.regexp_extract(url, r"^[^?#]*", 0), target))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), target))
    )


def links_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a, b``: the page keys that canonical links and refreshing redirects in the html make equal."""
    def pointed(tag: str, to: str) -> Column:
        return absolute(F.regexp_extract(F.regexp_extract(F.col(html), tag, 0), to, 1), F.col(url))

    targets = pages.where(F.col(url).isNotNull()).select(
        page_key(F.col(url)).alias("a"), F.explode(F.array_compact(F.array(pointed(_LINK, _HREF), pointed(_REFRESH, _TO)))).alias("to")
    )
    return targets.select("a", page_key(F.col("to")).alias("b")).where("a <> b").distinct()


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", html: str = "html",
    redirects: DataFrame | None = None,
) -> DataFrame:
    """``key, host, path, rule, verdict, component`` for each row, repeated rows and null keys included.

    A url's own longest rule decides.  Others ask their component: pages joined by canonical links, refreshes
    and ``redirects`` (``from_url, to_url``), and rows with the same url.  There an allowing rule of any alias takes
    precedence, else one blocking alias blocks; without either the url is allowed.  Aliases that are no rows count
    too.  A null url or one without ``://`` has an empty host and path, no rule and no aliases.  Other columns
    are not read; their names do not matter.
    """
    named = pages.select(F.col(key).alias("_id"), F.col(url).alias("_url"), page_key(F.col(url)).alias("_page"))
    edges = links_of(pages.select(url, html), url, html)
    if redirects is not None:
        told = redirects.select(page_key(F.col("from_url")).alias("a"), page_key(F.col("to_url")).alias("b"))
        edges = edges.unionByName(told.where("a <> b"))
    groups = components(edges)
    host, path = host_of(F.col("node")), path_of(F.col("node"))
    ruled = groups.withColumn("action", rule_for(host, path, rules)["action"])
    decided = ruled.groupBy("root").agg(
        F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False)).alias("allowed"),
        F.coalesce(F.bool_or(F.col("action") == "block"), F.lit(False)).alias("blocked"),
    )
    known = groups.join(decided, "root").select(F.col("node").alias("_page"), "root", "allowed", "blocked")
    host, path = host_of(F.col("_url")), path_of(F.col("_url"))
    own = named.withColumn("_rule", rule_for(host, path, rules)).join(known, "_page", "left")
    by_alias = F.when(~F.coalesce("allowed", F.lit(False)) & F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return own.select(
        F.col("_id").alias(key), host.alias("host"), path.alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.action"), by_alias).alias("verdict"), F.coalesce("root", "_page").alias("component"),
    )
