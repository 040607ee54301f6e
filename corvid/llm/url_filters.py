r"""URL filters: rules indexed by their rarest literal token.

Every rule, whether given as host and path or as a free pattern, is a regular expression
with the literal tokens that any URL it fits must hold. One pass over all URLs counts how
often those tokens occur; a rule is filed under its rarest one. The index is a literal
table of buckets, addressed by a token's hash: a URL's tokens fetch the few rules filed
under them, and only those run their expressions. Row by row, without a shuffle: a host or
URL that a third of all rows have costs no more than any other.

Lists of more than ``PLANNED`` rules are a table instead: distinct URLs meet the rules filed
under their tokens in a join, each distinct URL is judged once, and rows take its verdict.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters and digits between which a URL is cut into tokens.
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """A rule on "host/path": its name, what it decides, its expression and the tokens that must occur."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    #: Host rules name themselves in the result; the longest decides. Patterns only decide where no host rule fits.
    host_rule: bool


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """The host and all its subdomains, where the URL's path starts with ``path`` (case counts in paths)."""
    tokens = tuple(re.findall(TOKEN, host.lower()))
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{_quoted(host)}{_quoted(path)}", tokens, True)


def pattern_rule(name: str, verdict: str, pattern: str, *tokens: str) -> Rule:
    """A free expression on "host/path"; ``tokens`` are lower-case words of which it needs every one, letters and digits only."""
    if not tokens or not all(re.fullmatch(TOKEN, t) for t in tokens):
        raise ValueError(f"rule {name!r} needs literal tokens")
    return Rule(name, verdict, pattern, tokens, False)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


#: The contract's rules.
HOST_RULES = (
    host_rule("block", "net", "/"),
    host_rule("allow", "example.net", "/en/"),
    host_rule("block", "example.com", "/de/"),
    host_rule("allow", "org", "/fr/"),
)
#: The method's own: words that block a URL where they are a whole path segment or host label, by subject.
WORDS = {
    "advertising": ("adserver", "adservice", "adsystem", "adnetwork", "adclick", "adsense", "adwords", "advertising", "banners", "popunder", "popads", "doubleclick", "sponsored", "affiliates"),
    "tracking": ("tracking", "tracker", "clicktrack", "pixel", "beacon", "analytics", "telemetry", "fingerprinting"),
    "gambling": ("casino", "casinos", "poker", "roulette", "blackjack", "sportsbook", "betting", "slots", "jackpot", "lottery"),
    "adult": ("porn", "porno", "xxx", "nsfw", "escorts", "camgirls", "hentai", "onlyfans"),
    "fraud": ("phishing", "scam", "cryptodoubler", "freegiftcards", "getrichquick", "replica", "fakeid"),
    "malware": ("malware", "ransomware", "keylogger", "warez", "keygen", "cracked", "torrents", "serials"),
    "spam": ("clickbait", "linkfarm", "essaymills", "payday", "viagra", "cialis", "pharmacy", "weightloss"),
}
PATTERN_RULES = tuple(pattern_rule(f"{subject}:{w}", "block", rf"(?i)(?:^|[./]){w}(?:[./]|$)", w) for subject, some in WORDS.items() for w in some)
RULES = HOST_RULES + PATTERN_RULES
#: Rules that the plan itself can hold; longer lists are joined.
PLANNED = 2_000


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _parts(url: Column) -> tuple[Column, Column]:
    """host and path of a URL; empty for a null one or one without "://"."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def _tokens(at: Column) -> Column:
    return F.array_distinct(F.filter(F.split(lower_ascii(at), "[^a-z0-9]+"), lambda t: t != ""))


def token_counts(urls: DataFrame, url: str, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URLs hold each literal token of the rules; at most one row for each such token reaches the driver."""
    wanted = sorted({t for r in rules for t in r.tokens})
    host, path = _parts(F.col(url))
    held = F.array_intersect(_tokens(F.concat(host, path)), F.array(*[F.lit(t) for t in wanted]))
    rows = urls.select(F.explode(held).alias("token")).groupBy("token").count().collect()
    return {t: 0 for t in wanted} | {r.token: r["count"] for r in rows}


def _index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[int, Column]:
    """(buckets, table): an array of buckets, each the rules whose rarest token hashes there."""
    buckets = 1 << max(4, (4 * len(rules)).bit_length())
    by_token: dict[str, list[Rule]] = defaultdict(list)
    for r in rules:
        by_token[min(r.tokens, key=lambda t: (counts[t], t))].append(r)
    where: dict[int, list[tuple[str, Rule]]] = defaultdict(list)
    for token, filed in by_token.items():
        where[_bucket(token, buckets)] += [(token, r) for r in filed]
    entry = "array<struct<token:string,name:string,verdict:string,pattern:string,rank:int>>"
    column = [
        F.array(*[F.struct(F.lit(t).alias("token"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.lit(len(r.name) if r.host_rule else -1).cast("int").alias("rank")) for t, r in where[b]]).cast(entry)
        for b in range(buckets)
    ]
    return buckets, F.array(*column)


def _bucket(token: str, buckets: int) -> int:
    """The same in Python and (as _bucket_column) in SQL."""
    total = 0
    for c in token[:24]:
        total = (total * 31 + ord(c)) % 65_521
    return total % buckets


def _bucket_column(token: Column, buckets: int) -> Column:
    chars = F.filter(F.split(F.substring(token, 1, 24), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: (a * 31 + F.ascii(c)) % 65_521) % buckets


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict.

    rule is the longest host rule that fits, else null; verdict is that rule's, else that
    of the first pattern rule that fits (block before allow), else ``otherwise``. A null
    URL, or one without "://", has an empty host and path, no rule and the verdict
    ``otherwise``. Rows are judged each for itself, repeats included. Columns of pages
    stay; one that has the name of an added column is replaced.
    """
    if len(rules) > PLANNED:
        rows = [(r.name, r.verdict, r.pattern, list(r.tokens), r.host_rule) for r in rules]
        return judge_by_table(pages, pages.sparkSession.createDataFrame(rows, RULE_TABLE), url, otherwise)
    buckets, table = _index(rules, token_counts(pages, url, rules))
    host, path = _parts(F.col(url))
    at = F.concat(F.col("host"), F.col("path"))
    filed_, fits_, best_ = (_free(pages, n) for n in ("filed", "fits", "best"))
    filed = F.flatten(F.transform(_tokens(at), lambda t: F.filter(F.get(table, _bucket_column(t, buckets)), lambda r: r["token"] == t)))
    fits = F.filter(F.col(filed_), lambda r: F.call_function("rlike", at, r["pattern"]))
    # Host rules before patterns, longer before shorter, block before allow.
    best = F.array_max(F.transform(F.col(fits_), lambda r: F.struct(r["rank"].alias("rank"), (r["verdict"] == "block").alias("block"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    return (
        pages.withColumns({"host": host, "path": path})
        .withColumn(filed_, filed)
        .withColumn(fits_, F.when(F.size(filed_) > 0, fits))
        .withColumn(best_, best)
        .withColumns({"rule": F.when(F.col(best_)["rank"] >= 0, F.col(best_)["name"]), "verdict": F.coalesce(F.col(best_)["verdict"], F.lit(otherwise))})
        .drop(filed_, fits_, best_)
    )


def _free(pages: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column has."""
    while name in (*pages.columns, "host", "path", "rule", "verdict"):
        name = f"_{name}"
    return name


#: A table of rules, of any length.
RULE_TABLE = "name string, verdict string, pattern string, tokens array<string>, host_rule boolean"


def judge_by_table(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """judge, with the rules of a table (RULE_TABLE) of any length."""
    host, path = _parts(F.col(url))
    at_, token, n, best = (_free(pages, x) for x in ("at", "token", "n", "best"))
    base = pages.withColumns({"host": host, "path": path}).withColumn(at_, F.concat("host", "path"))
    tokens = base.select(at_).distinct().select(at_, F.explode(_tokens(F.col(at_))).alias(token))
    listed = rules.select("name", "verdict", "pattern", F.when(F.col("host_rule"), F.length("name")).otherwise(-1).alias("rank"), F.explode("tokens").alias(token))
    counts = tokens.join(listed.select(token).distinct(), token, "left_semi").groupBy(token).agg(F.count("*").alias(n))
    rarest = F.min(F.struct(F.coalesce(n, F.lit(0)).alias("n"), F.col(token).alias("token")))["token"]
    filed = listed.join(counts, token, "left").groupBy("name", "verdict", "pattern", "rank").agg(rarest.alias(token))
    fits = tokens.join(filed, token).where(F.call_function("rlike", F.col(at_), F.col("pattern")))
    top = F.max(F.struct(F.col("rank"), (F.col("verdict") == "block").alias("block"), F.col("name"), F.col("verdict")))
    judged = base.join(fits.groupBy(at_).agg(top.alias(best)), at_, "left")
    told = judged.withColumns({"rule": F.when(F.col(best)["rank"] >= 0, F.col(best)["name"]), "verdict": F.coalesce(F.col(best)["verdict"], F.lit(otherwise))})
    return told.select(*[F.col(f"`{c}`") for c in (*pages.columns, *(x for x in ("host", "path", "rule", "verdict") if x not in pages.columns))])


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every url of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


#: DuckDB's form of the query; the method's own rules are listed as the words they look for.
ORACLE_SQL = rf"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/'
    END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host || path, '(?i)(?:^|[./])(?:{'|'.join(w for some in WORDS.values() for w in some)})(?:[./]|$)') THEN 'block'
  ELSE 'allow' END AS verdict
FROM j
"""
