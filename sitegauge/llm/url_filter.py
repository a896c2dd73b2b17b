"""Operator 2: URL rules indexed by their rarest literal token."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import unused, write_out
from sitegauge.sources.tables import read_table

#: Rules of a host and a path prefix. Order of fit: the longest wins.
PREFIX_RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: Whole-word patterns of unwanted hosts and paths, for urls that no prefix rule fits.
PATTERN_RULES = (
    ("spam farm", r"(?i)^[^/]*\bspam-farm\b"),
    ("casino", r"(?i)^[^/]*\bcasino\b"),
    ("bets", r"(?i)^[^/]*\bfree-bets\b"),
    ("pills", r"(?i)^[^/]*\b(?:cheap|buy)-pills\b"),
    ("adult", r"(?i)^[^/]*\badult\b"),
    ("tracker", r"(?i)^[^/]*\bads-track\b"),
    ("archive file", r"(?i)/[^/]*\.zip$"),
    ("program file", r"(?i)/[^/]*\.exe$"),
)
#: The tokens that stand in whatever a pattern rule matches.
PATTERN_TOKENS = {
    "spam farm": ("spam", "farm"),
    "casino": ("casino",),
    "bets": ("free", "bets"),
    "pills": ("pills",),
    "adult": ("adult",),
    "tracker": ("ads", "track"),
    "archive file": ("zip",),
    "program file": ("exe",),
}
#: The index is part of the plan; more rules than this are judged by in several passes.
MOST_RULES = 50_000
INDEX_TYPE = "array<array<struct<token:string,pattern:string,rule:string,verdict:string,rank:int>>>"


@dataclass(frozen=True)
class Rule:
    """A regular expression over host and path, and tokens of which all stand whole in any match.

    Of the rules that fit a url, the one of the highest rank decides.
    """

    name: str | None
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    rank: int


def prefix_rule(rule: str, verdict: str) -> Rule:
    """A rule for a host with all its subdomains and a path prefix.

    The last token of a path that ends in the middle of a word may go on in the url, so it is no literal token.
    """
    host, _, path = rule.partition("/")
    whole = re.findall(r"[A-Za-z0-9]+(?![A-Za-z0-9]|\Z)", f"/{path}")
    literal = re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", f"{host}/{path}")
    return Rule(rule, rf"(?s)^(?:[^/]*\.)?{literal}", tuple(t.lower() for t in re.findall(r"[A-Za-z0-9]+", host) + whole), verdict, 1000 + len(rule))


def default_rules() -> list[Rule]:
    own = [Rule(None, pattern, PATTERN_TOKENS[name], "block", 0) for name, pattern in PATTERN_RULES]
    return [prefix_rule(r, v) for r, v in PREFIX_RULES] + own


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: str) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; null or no ``://``: empty."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return ascii_lower(found)


def path_of(url: str) -> Column:
    """From the host's end up to ?, # or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(address: Column) -> Column:
    """Distinct runs of ASCII letters and digits, A-Z lower-cased."""
    return F.array_distinct(F.split(ascii_lower(address), "[^a-z0-9]+"))


def token_counts(addresses: DataFrame, address: str, tokens: set[str]) -> dict[str, int]:
    """In how many rows each of the rules' tokens stands; one row for each token of a rule comes back."""
    listed = F.from_json(F.lit(json.dumps(sorted(tokens))), "array<string>")
    wanted = addresses.sparkSession.range(1).select(F.explode(listed).alias("token"))  # a row for each token of a rule
    found = addresses.select(F.explode(url_tokens(F.col(address))).alias("token"))
    own = found.join(F.broadcast(wanted) if len(tokens) <= 1_000_000 else wanted, "token", "left_semi")
    return {r["token"]: r["n"] for r in own.groupBy("token").agg(F.count("*").alias("n")).collect()}


def index_rules(rules: list[Rule], counts: dict[str, int]) -> tuple[Column, int]:
    """Hash slots of (token, rule), each rule under its rarest token only; and the number of slots."""
    slots = 1 << max(4, (2 * len(rules)).bit_length())
    table: list[list[dict]] = [[] for _ in range(slots)]
    for r in rules:
        rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
        entry = {"token": rarest, "pattern": r.pattern, "rule": r.name, "verdict": r.verdict, "rank": r.rank}
        table[slot_of(rarest, slots)].append(entry)
    return F.from_json(F.lit(json.dumps(table)), INDEX_TYPE), slots


def slot_of(token: str, slots: int) -> int:
    """The same slot as ``F.crc32(token)`` modulo ``slots``."""
    import zlib

    return zlib.crc32(token.encode()) % slots


def best_rule(address: Column, rules: list[Rule], counts: dict[str, int]) -> Column:
    """(rank, rule, verdict) of the fitting rule of the highest rank: a url's tokens fetch the candidate rules from
    their slots, and only those run their regular expressions."""
    index, slots = index_rules(rules, counts)

    def candidates(token: Column) -> Column:
        return F.filter(F.get(index, F.pmod(F.crc32(F.encode(token, "utf-8")), F.lit(slots)).cast("int")), lambda r: r["token"] == token)

    fetched = F.flatten(F.transform(url_tokens(address), candidates))
    fitting = F.filter(fetched, lambda r: F.regexp_like(address, r["pattern"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["rank"].alias("rank"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def judge_urls(
    df: DataFrame, rules: list[Rule] | None = None, url: str = "url", otherwise: str = "allow", most: int = MOST_RULES
) -> DataFrame:
    """``df`` with host, path, rule and verdict of ``url``, without a shuffle of ``df``.

    First the frequency of the rules' tokens in all urls is counted. Each rule then goes into a hash
    index under its rarest token, see ``best_rule``. The fitting rule of the highest rank decides, of equal ranks
    the last in order of rule and verdict; without one the verdict is ``otherwise`` and the rule null. More than ``most`` rules
    are looked up in as many passes, whose best rules so far are written out in between. A rule without
    tokens can't be indexed and is refused. Null urls and urls without ``://`` have an empty host and path and
    fit no rule. Repeated rows give repeated results. Columns named like the new ones are replaced.
    """
    rules = default_rules() if rules is None else rules
    if bare := [r.pattern for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token: {bare}")
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    address, best = unused(kept, "__address"), unused(kept, "__best")
    found = df.select(*kept, host_of(url).alias("host"), path_of(url).alias("path")).withColumn(address, F.concat("host", "path"))
    counts = token_counts(found, address, {t for r in rules for t in r.tokens})
    found = found.withColumn(best, F.lit(None).cast("struct<rank:int,rule:string,verdict:string>"))
    for k in range(0, len(rules), most):
        if k:
            found = write_out(found)
        found = found.withColumn(best, F.greatest(best, best_rule(F.col(address), rules[k : k + most], counts)) if k else best_rule(F.col(address), rules[:most], counts))
    return found.select(
        *kept, "host", "path", F.col(f"{best}.rule").alias("rule"), F.coalesce(F.col(f"{best}.verdict"), F.lit(otherwise)).alias("verdict")
    )


def op2_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    fits = []
    for rule, verdict in PREFIX_RULES:
        host, _, path = rule.partition("/")
        fits.append((len(rule), rule, verdict, f"((host = '{host}' OR suffix(host, '.{host}')) AND starts_with(path, '/{path}'))"))
    fits.sort(reverse=True)
    rule = " ".join(f"WHEN {c} THEN '{r}'" for _, r, _, c in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for _, _, v, c in fits)
    own = " OR ".join(f"regexp_matches(host || path, '{p}')" for _, p in PATTERN_RULES)
    return f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN {own} THEN 'block' ELSE 'allow' END AS verdict
FROM parts"""


ORACLE = _oracle()
