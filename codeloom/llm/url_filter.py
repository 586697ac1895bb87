"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with a verdict. Each rule is filed
under the rarest of the tokens that every URL it matches must contain; a URL's tokens
fetch the rules filed under them, and only those run their expression. All of it is
row-local: the index is a literal map inside the plan, in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_RULES = 500  # rules that one literal index holds; more go in further blocks
TOKEN = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``tokens`` are complete runs of a-z and 0-9 (of
    the lower-cased URL) that any match contains; ``weight`` decides: the greatest wins,
    then the greatest name."""

    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    weight: int


def site_rule(name: str, verdict: str) -> Rule:
    """``host/path``: fits the host and all its subdomains, if the path starts with the rule's.

    The longest rule wins. A last run that no separator closes may go on in a URL, so it
    is no token.
    """
    host, slash, path = name.partition("/")
    parts = re.split(TOKEN, name.lower())
    if parts and not re.search("[^a-z0-9]$", name.lower()):
        parts.pop()
    return Rule(name, "^([^/]*\\.)?" + re.escape(host + slash + path), verdict, tuple(x for x in parts if x), len(name))


#: The site rules that must hold, host and path as given.
SITE_RULES = (site_rule("net/", "block"), site_rule("example.net/en/", "allow"), site_rule("example.com/de/", "block"), site_rule("org/fr/", "allow"))

#: Patterns for URLs that no site rule fits; weights below those of any site rule.
PATTERN_RULES = (
    Rule("login page", "/(?:login|signin)(?:/|$)", "block", (), -1),
    Rule("advert host", "^(?:[^/]*\\.)?(?:ads|adserver|doubleclick)\\.", "block", (), -1),
    Rule("shopping cart", "/shop/cart(?:/|$)", "block", ("shop", "cart"), -1),
    Rule("tag listing", "/wiki/special/tags(?:/|$)", "block", ("wiki", "special", "tags"), -1),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    known = at > 0
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(known, F.translate(host, upper, lower)).otherwise(""), F.when(known, path).otherwise("")


def token_counts(urls: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """In how many URLs of the whole table each of the rules' tokens stands."""
    if not tokens:
        return {}
    host, path = url_parts(F.col(url))
    listed = F.array(*[F.lit(t) for t in tokens])
    found = F.array_intersect(F.split(F.lower(F.concat(host, path)), TOKEN), listed)
    rows = urls.select(F.explode(found).alias("token")).groupBy("token").count().collect()  # at most one row per rule token
    return {r["token"]: r["count"] for r in rows}


def index_rules(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by their rarest token (ties: the longer, then the lesser), and those without any."""
    index: dict[str, list[Rule]] = {}
    free = []
    for rule in rules:
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(rule)
        else:
            free.append(rule)
    return index, free


def _as_rule(rule: Rule) -> Column:
    return F.struct(F.lit(rule.weight).alias("weight"), F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"), F.lit(rule.pattern).alias("pattern"))


def _best(address: Column, tokens: Column, index: dict[str, list[Rule]], free: list[Rule]) -> Column:
    """The winning rule of one block of rules, or null."""
    fetched = F.array(*[_as_rule(r) for r in free]) if free else None
    if index:
        places = F.create_map(*[x for t, rules in index.items() for x in (F.lit(t), F.array(*[_as_rule(r) for r in rules]))])
        known = F.filter(tokens, lambda t: F.array_contains(F.map_keys(places), t))
        filed = F.flatten(F.transform(F.array_distinct(known), lambda t: F.element_at(places, t)))
        fetched = F.concat(fetched, filed) if fetched is not None else filed
    return F.array_max(F.filter(fetched, lambda r: F.rlike(address, r["pattern"])))


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = SITE_RULES + PATTERN_RULES, default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``matched`` (name of the winning rule or null) and ``verdict``.

    A column of ``pages`` with one of these names is replaced. Null URLs and those without
    a scheme have an empty host and path; only rules that match empty text fit them.
    """
    counts = Counter(token_counts(pages, url, sorted({t for r in rules for t in r.tokens})))
    host, path = url_parts(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    out = out.withColumn("__tokens", F.split(F.lower(F.concat("host", "path")), TOKEN))
    best = []
    for k in range(0, len(rules), BLOCK_RULES):
        index, free = index_rules(rules[k : k + BLOCK_RULES], counts)
        best.append(_best(F.concat("host", "path"), F.col("__tokens"), index, free))
    winner = F.array_max(F.array(*best)) if best else F.lit(None).cast("struct<weight:int,name:string,verdict:string,pattern:string>")
    out = out.withColumn("__won", winner)
    return out.withColumns({"matched": F.col("__won.name"), "verdict": F.coalesce("__won.verdict", F.lit(default))}).drop("__tokens", "__won")
