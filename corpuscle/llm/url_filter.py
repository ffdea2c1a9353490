"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a regular expression over host and path and the literal tokens that any
URL it fits must contain; a rule whose words may be joined has several such sets of
tokens. Over all URLs the rules' tokens are counted, and each rule is filed under the
rarest one of each of its sets. A URL's tokens fetch the rules filed under them, and
only these run their expression; the longest that fits decides.

The index grows with the rules, not with the URLs. Up to ``most_rules`` rules it is a
literal map within the plan, so that URLs are judged where they are read, without an
exchange; beyond that, distinct URLs meet the index in a join, which is broadcast up to
``MOST_BROADCAST`` entries. Rules without a token are literals in either case.

Defined cases: a null URL, or one without ``://``, has an empty host and path and is
judged by the rules without tokens alone; ties of length go to the rule that blocks,
then to the greater name; repeated rows each get a row; an empty table gives an empty
result; no rule at all allows everything; ``keep`` must not name a column of the result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]+"
MOST_BROADCAST = 200_000
RESULT = ("host", "path", "rule", "verdict", "matched")


@dataclass(frozen=True)
class Rule:
    """``pattern`` (Java syntax) is searched in host + path; every fitting URL has all of ``tokens``, or all of one of ``joined``, as whole tokens."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    named: bool = True
    joined: tuple[tuple[str, ...], ...] = ()

    @property
    def spellings(self) -> tuple[tuple[str, ...], ...]:
        return (self.tokens, *self.joined)


def site_rule(verdict: str, site: str) -> Rule:
    """A rule like ``example.net/en/``: the host and its subdomains, paths that start so."""
    host, slash, path = site.partition("/")
    path = slash + path
    # A path's last token may go on in the URL; only a closed one is whole.
    closed = path if path[-1:] == "/" else path[: max(0, path.rfind("/")) + 1]
    tokens = re.findall(TOKEN, host.lower()) + re.findall(TOKEN, closed.lower())
    literal = lambda s: re.sub(r"([^A-Za-z0-9])", r"\\\1", s)
    return Rule(site, verdict, rf"^(?:[^/?#]*\.)?{literal(host.lower())}{literal(path)}", tuple(dict.fromkeys(tokens)), len(site))


def word_rule(*words: str, verdict: str = "block") -> Rule:
    """A rule on consecutive words of the host, apart from each other by any separator."""
    # Words without a separator are one token; each gap may have one or not.
    spelt = [tuple("".join(x for pair in zip(words, (*gaps, "")) for x in pair).split(" ")) for gaps in product((" ", ""), repeat=len(words) - 1)]
    return Rule("-".join(words), verdict, r"(?i)^[^/]*\b" + r"[-_.]?".join(words) + r"\b", spelt[0], 0, named=False, joined=tuple(spelt[1:]))


def read_rules(table: DataFrame) -> list[Rule]:
    """Rules from a table (verdict, kind, value): kind ``site`` with values like ``net/``, or ``words`` with words by spaces. Rows with a null are left out."""
    made = {"site": lambda v, x: site_rule(v, x), "words": lambda v, x: word_rule(*x.split(), verdict=v)}
    rows = table.select("verdict", "kind", "value").dropna().distinct().orderBy("kind", "value", "verdict").collect()
    return [made[r["kind"]](r["verdict"], r["value"]) for r in rows]


#: The method's own verdicts, below any site rule.
WORD_RULES = (word_rule("casino"), word_rule("free", "bets"), word_rule("cheap", "pills"), word_rule("spam", "farm"), word_rule("adult", "cams"), word_rule("viagra"), word_rule("warez"))


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(host: Column, path: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat(host, path)), F.lit(f"({TOKEN})"), 1))


def index_rules(pages: DataFrame, rules: Sequence[Rule], url: str) -> dict[str, list[Rule]]:
    """Rules by the rarest token, over all URLs, of each of their spellings; under "" those without one."""
    known = sorted({t for r in rules for s in r.spellings for t in s})
    seen: dict[str, int] = {}
    if known:
        marks = F.array_intersect(tokens_of(host_of(F.col(url)), path_of(F.col(url))), F.array(*map(F.lit, known)))
        seen = {r[0]: r[1] for r in pages.select(F.explode(marks).alias("t")).groupBy("t").count().collect()}  # a row for each of the rules' tokens
    index: dict[str, list[Rule]] = {}
    for r in rules:
        for token in {min(s, key=lambda t: (seen.get(t, 0), t), default=""): None for s in r.spellings}:
            index.setdefault(token, []).append(r)
    return index


_RULE = "struct<weight:int,blocks:boolean,name:string,pattern:string,named:boolean>"


def _literal(r: Rule) -> Column:
    return F.struct(F.lit(r.weight).alias("weight"), F.lit(r.verdict == "block").alias("blocks"), F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.lit(r.named).alias("named"))


def judge(pages: DataFrame, rules: Sequence[Rule], url: str = "url", keep: Sequence[str] = ("page_id",), most_rules: int = 2_000) -> DataFrame:
    """``keep`` plus host, path, rule (of the deciding site rule, else null), verdict and matched (any deciding rule)."""
    if clash := set(keep) & set(RESULT):
        raise ValueError(f"columns of the result cannot be kept: {sorted(clash)}")
    index = index_rules(pages, rules, url)
    parts = pages.select(*keep, F.col(url).alias("_url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    best = _by_map(parts, index) if len(rules) <= most_rules else _by_join(parts, index)
    named = F.when(F.col("_best.named"), F.col("_best.name"))
    verdict = F.when(F.col("_best.blocks"), "block").otherwise("allow")
    return best.select(*keep, "host", "path", named.alias("rule"), verdict.alias("verdict"), F.col("_best.name").alias("matched"))


def _fits(parts_host: Column, path: Column, pattern: Column) -> Column:
    return F.rlike(F.concat(parts_host, path), pattern)


def _order(r) -> Column:
    """Sorts last what decides: longest, then blocking."""
    return F.struct(*[r[c].alias(c) for c in ("weight", "blocks", "name", "pattern", "named")])


def _by_map(parts: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    empty = F.array().cast(f"array<{_RULE}>")
    filed = [x for token, rules in sorted(index.items()) if token for x in (F.lit(token), F.array(*map(_literal, sorted(rules, key=lambda r: r.name))))]
    always = F.array(*map(_literal, index[""])) if index.get("") else empty
    if filed:
        # Only tokens that a rule is filed under look into the map.
        keys = F.array(*map(F.lit, sorted(t for t in index if t)))
        known = F.array_intersect(tokens_of(F.col("host"), F.col("path")), keys)
        fetched = F.flatten(F.transform(known, lambda t: F.element_at(F.create_map(*filed), t)))
        candidates = F.concat(always, F.coalesce(fetched, empty))
    else:
        candidates = always
    staged = parts.select("*", candidates.alias("_c"))
    fitting = F.filter(F.col("_c"), lambda r: _fits(F.col("host"), F.col("path"), r["pattern"]))
    return staged.select("*", F.array_max(F.transform(fitting, _order)).alias("_best")).drop("_c")


def _by_join(parts: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    spark = parts.sparkSession
    rows = [(t, r.weight, r.verdict == "block", r.name, r.pattern, r.named) for t, rules in index.items() if t for r in rules]
    filed = spark.createDataFrame(rows, "_token string, weight int, blocks boolean, name string, pattern string, named boolean")
    distinct = parts.select("host", "path").distinct()
    looked = distinct.select("*", F.explode(tokens_of(F.col("host"), F.col("path"))).alias("_token"))
    met = looked.join(F.broadcast(filed) if len(rows) <= MOST_BROADCAST else filed, "_token")
    fitting = met.where(_fits(F.col("host"), F.col("path"), F.col("pattern")))
    best = fitting.groupBy("host", "path").agg(F.max(_order({c: F.col(c) for c in ("weight", "blocks", "name", "pattern", "named")})).alias("_filed"))
    out = parts.join(best, ["host", "path"], "left")
    always = F.array(*map(_literal, index.get("", []))) if index.get("") else F.array().cast(f"array<{_RULE}>")
    free = F.array_max(F.transform(F.filter(always, lambda r: _fits(F.col("host"), F.col("path"), r["pattern"])), _order))
    # The greater of both decides; a null is never it.
    return out.select("*", F.array_max(F.array("_filed", free)).alias("_best")).drop("_filed")
