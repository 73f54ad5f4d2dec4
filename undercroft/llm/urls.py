"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a pattern with literal tokens: runs of letters and digits that every url it fits has whole,
lower-cased.  The rarest of them by the corpus (urls that have it) is the rule's place in the index;
a rule without one stands under the empty token.  Tokens of a url fetch candidate rules from the index,
and only those run their regular expression.  Everything is one projection over the urls after one
count of the rules' tokens; no url is shuffled.

The rule list is a parameter of the job, at most ``MAX_RULES`` (an error beyond it), and so are the index
and the counts that the driver sees.

Of the host rules that fit, the longest wins; where none fits, the first pattern rule that fits decides; where
none does, the url is allowed.  Defined results: a null url, or one without ``://``, has an empty host
and path and is allowed without a rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undercroft.llm.common import fresh

MAX_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a regular expression over ``host + path``; ``weight`` ranks host rules, 0 marks a pattern rule."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int = 0


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains where the url's path starts with the rule's."""
    tokens = re.findall("[a-z0-9]+", host.lower()) + [t.lower() for t in re.findall(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)]
    return Rule(host + path, verdict, rf"\A(?:[^/]*\.)?\Q{host}\E\Q{path}\E", tuple(tokens), len(host + path))


def pattern_rule(verdict: str, pattern: str, *tokens: str) -> Rule:
    """A regular expression and the whole tokens that each url it fits must have."""
    return Rule(pattern, verdict, pattern, tokens)


#: The default policy behind the host rules.
PATTERNS = (
    pattern_rule("block", r"(?i)\A[^/]*\bcheap-(?:pills|meds|watches)\b", "cheap"),
    pattern_rule("block", r"(?i)\A[^/]*\b(?:free|hot)-(?:casino|slots|poker)\b"),
    pattern_rule("block", r"(?i)\bxxx\b", "xxx"),
    pattern_rule("block", r"(?i)\Awww\.ads?[0-9]*\.", "www"),
)


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    u = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(u, r"(?s)\A.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    u = F.coalesce(F.col(url), F.lit(""))
    return F.regexp_extract(u, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Whole tokens of a url once each, and the empty one."""
    return F.array_distinct(F.split(F.concat(F.lit("."), F.lower(F.concat(host, path))), r"[^a-z0-9]+"))


def token_index(tokens: DataFrame, rules: tuple[Rule, ...]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; ``tokens`` is a frame of one array column."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    literal = sorted({t for r in rules for t in r.tokens})
    seen = F.explode(F.array_intersect(F.col(tokens.columns[0]), F.array(*[F.lit(t) for t in literal]).cast("array<string>")))
    counts = {r[0]: r[1] for r in tokens.select(seen.alias("t")).groupBy("t").count().collect()}
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def filter_urls(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = (), patterns: tuple[Rule, ...] = PATTERNS, default: str = "allow") -> DataFrame:
    """The rows with ``host, path, rule`` (of the host rule that decides), ``verdict``, and ``pattern`` (of the pattern rule that decides)."""
    every = (*rules, *patterns)
    host, path, tokens, hits, best = fresh(pages, "host_", "path_", "tokens_", "hits_", "best_")
    base = pages.withColumns({host: host_of(url_col), path: path_of(url_col)})
    base = base.withColumn(tokens, url_tokens(F.col(host), F.col(path)))
    index = token_index(base.select(tokens), every)
    order = {r: k for k, r in enumerate(every)}

    def entry(r: Rule) -> Column:
        return F.struct(F.lit(r.weight).alias("weight"), F.lit(-order[r]).alias("place"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))

    if not every:
        return base.withColumns({"host": F.col(host), "path": F.col(path), "rule": F.lit(None).cast("string"), "verdict": F.lit(default), "pattern": F.lit(None).cast("string")}).drop(host, path, tokens)
    lookup = F.create_map(*[x for t, rs in index.items() for x in (F.lit(t), F.array(*[entry(r) for r in rs]))])
    known = F.array(*[F.lit(t) for t in index])
    fetched = F.flatten(F.transform(F.array_intersect(F.col(tokens), known), lambda t: lookup[t]))
    where = F.concat(F.col(host), F.col(path))
    met = base.withColumn(hits, F.filter(fetched, lambda r: F.regexp(where, r["pattern"])))
    met = met.withColumn(best, F.array_max(F.col(hits)))
    by_host = F.col(best)["weight"] > 0
    return met.select(
        *[F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict", "pattern")], F.col(host).alias("host"), F.col(path).alias("path"),
        F.when(by_host, F.col(best)["name"]).alias("rule"), F.coalesce(F.col(best)["verdict"], F.lit(default)).alias("verdict"),
        F.when(~by_host, F.col(best)["name"]).alias("pattern"))


#: Host rules of the registered query.
FIXED = (host_rule("allow", "com", "/"), host_rule("block", "example.com", "/en/"), host_rule("allow", "www.example.com", "/en/"), host_rule("block", "net", "/es/"), host_rule("block", "net", "/fr/"))

URL_SQL = r"""
WITH u AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1)) AS host, regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(h, p, v)),
m AS (SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.v,
             row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
      FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(v, CASE
         WHEN regexp_matches(host || path, '(?i)^[^/]*\bcheap-(pills|meds|watches)\b') OR regexp_matches(host || path, '(?i)^[^/]*\b(free|hot)-(casino|slots|poker)\b')
           OR regexp_matches(host || path, '(?i)\bxxx\b') OR regexp_matches(host || path, '(?i)^www\.ads?[0-9]*\.') THEN 'block' ELSE 'allow' END) AS verdict
FROM m WHERE k = 1"""
